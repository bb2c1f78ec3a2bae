"""The corpus operators against brute force on small tables with the awkward cases in them."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from relaytrail.llm import (
    bpe, exact_dedup, fm_index, mixing, patricia, quality, sharding, simhash, substring_dedup, token_files, toxicity, url_filters,
)

#: Columns whose names the operators use inside.
CLASHES = "row id n hash sha points keep_id fp shard key seg u1 u2 _u1 _u2 _n chunk band kept tokens rate copies component_id ids words line".split()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    passage, long = words(rng, 60), words(rng, 6000, 5000)
    base = words(rng, 120)
    out = [None, "", " \n\t ", "one", "One two", "a b c d", passage, f"{words(rng, 30)} {passage} {words(rng, 30)}", f"{words(rng, 40)}\n{passage}"]
    out += [base] * 5 + [base.replace("w1", "x", 1), base + " ", " " + base.replace(" ", "  ", 3), base.upper()]
    out += [long, long[: len(long) // 2] + " changed " + long[len(long) // 2 :], "same " * 200, "x" * 3000, "ab" * 500, "é ü 漢字漢字 🙂 don't  stop\r\n\x0bnow \x85 end"]
    out += ["\n".join(["All rights reserved.", words(rng, 30), words(rng, 25), "All rights reserved."]) for _ in range(12)]
    out += [words(rng, rng.randrange(1, 90)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts())]
    rows += [(3, "one", "en", "src0", 3), (3, "one", "en", "src0", 3), (None, "one", None, None, None), (None, None, None, None, None)]
    wide = [r + tuple(f"c{j}" for j in range(len(CLASHES))) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def word_list(text):
    return (text or "").encode().split()


# 1 substring dedup

def cut(rows, window=35):
    lists = [word_list(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    for (ident, _), w in zip(rows, lists):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        yield ident, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()


@pytest.mark.parametrize("hot_words", [substring_dedup.HOT_WORDS, 20])
def test_substring_dedup(docs, rows, none, hot_words, monkeypatch):
    plain = substring_dedup.repeated_segments
    monkeypatch.setattr(substring_dedup, "repeated_segments", lambda s, h: plain(s, hot_words))
    same(substring_dedup.kept_digests(docs).collect(), cut(rows))
    assert substring_dedup.kept_digests(none).count() == 0


def test_substring_texts(docs, rows):
    got = substring_dedup.without_repeats(docs).collect()
    same([(r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got], cut(rows))


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for n_symbols, width in ((3, 5), (40, 4), (4, 12)):
        sequences = [rng.integers(1, n_symbols, rng.integers(width, 90)) for _ in range(20)]
        times = [1] * 18 + [2, 3]
        index = fm_index.FMIndex(sequences, times, n_symbols)
        seen = collections.Counter()
        for s, t in zip(sequences, times):
            for i in range(len(s) - width + 1):
                seen[tuple(s[i : i + width])] += t
        marks = index.repeated(np.arange(len(sequences)), width)
        for s, start in zip(sequences, index.starts):
            assert [bool(marks[start + i]) for i in range(len(s) - width + 1)] == [seen[tuple(s[i : i + width])] > 1 for i in range(len(s) - width + 1)]


def test_equal_windows_have_equal_minimizers():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    found = []
    for _ in range(2):
        h = np.r_[rng.integers(0, 1 << 62, 20).astype(np.uint64), shared, rng.integers(0, 1 << 62, 9).astype(np.uint64)]
        keys, first, n, _ = substring_dedup.segments(h)
        found.append(np.repeat(keys, n)[20 : 20 + 50 - 34])
        assert n.sum() == len(h) - 34
    assert (found[0] == found[1]).all()


# 2 exact dedup

def test_exact_dedup(docs, rows, none):
    table = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for ident, text in rows:
        groups[(text or "").translate(table)].append((-len(text or ""), ident is None, ident or 0, ident))
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want += [(m[3], members[0][3], len(members), i == 0, digest) for i, m in enumerate(members)]
    same(exact_dedup.exact_duplicates(docs).collect(), want)
    stays = exact_dedup.drop_exact_duplicates(docs)
    assert stays.columns == docs.columns
    same([(r.doc_id,) for r in stays.collect()], [(w[0],) for w in want if w[3]])
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_trie_keeps_every_key_and_merges_equal_ones():
    rng = random.Random(3)
    keys = [bytes(rng.choices(b"ab\x00", k=rng.randrange(0, 12))) for _ in range(3000)]
    trie = patricia.PatriciaTrie(lambda a, b: a + b)
    for k in keys:
        trie.add(k, 1)
    assert dict(trie.items()) == dict(collections.Counter(keys))


def test_owner_gives_complete_groups_when_its_trie_is_full():
    import pyarrow as pa

    rows = sorted((len(k), hash(k) % 97, k, 5, i, 1) for i, k in enumerate([b"aa", b"ab", b"aa", b"b", b"aa", b"b" * 50]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdef"))
    out = [r for b in exact_dedup.own_partition(iter([batch]), budget=1) for r in b.to_pylist()]
    assert sorted(r["group_size"] for r in out) == [1, 1, 1, 3]


# 3 token files, 5 byte-level BPE

def test_token_files(docs, rows, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, str(tmp_path / "ids"), path, public_tokenizers.PATTERN, end_id=2)
    got = token_files.read_token_files(files, str(tmp_path / "ids")).collect()
    tokenizer = Tokenizer.from_file(path)
    at, want = 0, []
    for ident, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((ident, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    same(got, want)
    empty = token_files.write_token_files(none, str(tmp_path / "no"), path, public_tokenizers.PATTERN, end_id=2)
    assert token_files.read_token_files(empty, str(tmp_path / "no")).count() == 0


def test_added_tokens_in_a_text_get_their_ids(spark, tmp_path):
    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [f"a {end} b", f"x{end}{end}y  z", f"{end}some words {end}", end, "before after", "<|endoftext |>", f"two\n {end}\n", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.write_token_files(table, str(tmp_path / "ids"), path, public_tokenizers.PATTERN, end_id=2)
    got = sorted(token_files.read_token_files(files, str(tmp_path / "ids")).collect())
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want and want[0] == [64, 220, 50256, 275, 2]
    assert [r.start for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]


def test_plane_file_round_trip(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 100)
    from pyarrow import fs

    local, path = fs.LocalFileSystem(), str(tmp_path / "x.bpl")
    rng = np.random.default_rng(0)
    documents = [(i if i != 2 else None, rng.integers(0, 1 << s, n).astype("<u4")) for i, (s, n) in enumerate([(8, 5), (16, 250), (31, 0), (20, 100), (4, 45)])]
    writer = token_files.PlaneWriter(local.open_output_stream(path))
    for d in documents:
        writer.add(*d)
    writer.close()
    with local.open_input_file(path) as source:
        back = list(token_files.PlaneReader(source).documents())
    assert [d for d, _ in back] == [d for d, _ in documents]
    assert all((a == b).all() for (_, a), (_, b) in zip(back, documents))


def test_byte_bpe(docs, rows, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(RANKS).splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    same(got, [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows])
    again = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    same(again.collect(), got)
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_and_stops_between_rounds(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(RANKS).splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "KEPT_ROWS", 2000)
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(4)
    pieces = ["a" * 1000, "ab" * 300, "".join(rng.choices("abcdeé漢", k=700)), "=" * 333] + ["".join(rng.choices("thenigr", k=rng.randrange(1, 120))) for _ in range(300)]
    pieces = list(dict.fromkeys(pieces))
    assert [np.frombuffer(b, "<u4").tolist() for b in codec.merge_pieces(pieces)] == [library.encode_ordinary(p) for p in pieces]


# 4 mixing

def test_mixing(spark, docs, none):
    rng = random.Random(10)
    mark = ["", " meh meh", " zorgol"]
    table = spark.createDataFrame([(i, words(rng, 50) + mark[i % 3] + " " + words(rng, 20)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(200)] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    rated = mixing.mixing_rates(table, labels, targets={"good": 0.6, "plain": 0.3, "toxic": 0.1}).collect()
    assert len(rated) == 300 and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in rated)
    assert np.mean([int(np.argmax(r.posterior)) == r.doc_id % 3 for r in rated]) > 0.99
    p, t, rate = (np.array(x) for x in ([r.posterior for r in rated], [r.tokens for r in rated], [r.rate for r in rated]))
    assert np.abs((rate * t) @ p / (rate * t).sum() - [0.6, 0.3, 0.1]).max() < 0.01
    once = mixing.mixing_rates(table, labels, targets={"good": 0.9, "plain": 0.05, "toxic": 0.05}, most=1.0).collect()
    assert all(r.copies == 1 for r in once if r.doc_id % 3 == 0) and all(r.copies <= 1 for r in once)
    assert len(mixing.mixing_rates(docs, labels).collect()) == docs.count()
    mixed = mixing.mix(docs, labels, most=1.0)
    assert mixed.columns == docs.columns and mixed.count() <= docs.count()
    assert mixing.mix(none, labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).columns == docs.columns


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([2, 1, 1], 500)
    t = rng.integers(1, 100, 500)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens long, posterior array<double>")
    pull = mixing.fit_rates(members, {"good": 0.2, "plain": 0.2, "toxic": 0.6})
    rate = np.maximum(0, 1 - p @ np.array(pull))
    got = [r.rate for r in members.select(mixing.rate_of(members.posterior, pull).alias("rate")).collect()]
    assert np.allclose(rate, got) and np.abs((rate * t) @ p / t.sum() - [0.2, 0.2, 0.6]).max() < 1e-3


def bounded_least_squares(t, p, goal, most, steps=60_000):
    """Residuals of the best rates in [0, most], by plain accelerated projected gradients."""
    a, b = t[:, None] * p / t.sum(), goal
    scale = t / t.sum()  # a diagonal change of variables, which keeps the box a box
    top = np.linalg.eigvalsh(a.T @ (a / scale[:, None]))[-1]
    r = y = np.ones(len(t))
    for k in range(steps):
        new = np.clip(y - (a @ (a.T @ y - b)) / scale / top, 0, most)
        y = new + k / (k + 3) * (new - r)
        r = new
    return a.T @ r - b


@pytest.mark.parametrize("soft", ["sharp", "fifth", "dirichlet"])
def test_bounded_rates_reach_the_optimum(spark, soft):
    rng = np.random.default_rng(1)
    n = 400
    kind = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    level = {"sharp": 0.02, "tenth": 0.1, "fifth": 0.2, "dirichlet": 0}[soft]
    p = rng.dirichlet([6, 2, 1], n) if soft == "dirichlet" else np.eye(3)[kind] * (1 - level) + level * rng.dirichlet([1, 1, 1], n)
    t = rng.integers(20, 500, n)
    members = spark.createDataFrame([(int(x), [float(v) for v in y]) for x, y in zip(t, p)], "tokens long, posterior array<double>").coalesce(1).cache()
    targets = {"good": 0.96, "plain": 0.01, "toxic": 0.03}
    share = np.array(list(targets.values()))
    goal = share * (t @ p[:, 0]) / t.sum() / share[0]
    rate = np.clip(1 - p @ np.array(mixing.fit_rates(members, targets, most=1.0, keep_first=True)), 0, 1)
    off, best = (rate * t) @ p / t.sum() - goal, bounded_least_squares(t, p, goal, 1.0)
    assert (off**2).sum() <= 1.01 * (best**2).sum() + 1e-9 and np.abs(off - best).max() < 1e-3
    assert soft == "dirichlet" or rate[kind == 0].min() > 0.99


# 6 quality rules

def quality_of(rows):
    for ident, text in rows:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        windows = collections.defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        yield ident, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(docs, rows, none):
    got = quality.quality_rules(docs).collect()
    same([tuple(r[:7]) for r in got], quality_of(rows))
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.quality_rules(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_depleted_documents_go_and_copies_do_not_make_boilerplate(spark):
    rng = random.Random(6)
    menu = words(rng, 90)
    own = lambda: "".join(rng.choices("abcdefgh", k=9))
    clean = "\n".join(words(rng, 30) for _ in range(4))
    rows = [(i, "\n".join([menu, own(), own()]), "a") for i in range(8)] + [(100 + i, clean, "a") for i in range(8)]
    rows += [(200, f"{menu}\n{words(rng, 60)}", "a"), (300, menu, "b")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=5).collect()}
    assert not any(got[i].kept for i in range(8)) and all(got[100 + i].kept for i in range(8)) and got[200].kept and got[300].kept
    cleaned = quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), host_col="source")
    assert cleaned.filter("doc_id = 100").first().text == clean


@pytest.mark.parametrize("n_own", [0, 1, 2])
def test_pages_of_shared_lines_count_each(spark, n_own):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared = [" ".join(letters(6) for _ in range(6)) for _ in range(20)]
    pages = ["\n".join(rng.sample(shared, 20) + [letters(9) for _ in range(n_own)]) for _ in range(30)]
    few = [(100 + i, p, "b") for i, p in enumerate(pages[:20])]
    copies = [(200 + i, pages[0] + " " * (i % 2), "c") for i in range(30)]
    table = spark.createDataFrame([(i, p, "a") for i, p in enumerate(pages)] + few + copies, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_rules(table, max_documents=20).collect()}
    assert got == {i: i >= 100 for i in got} and len(got) == 80


# 7 URL filters

def test_url_filters(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG/es/x?q#f", "https://a.example.org/en/12", "https://notexample.org/es/", "http://org/",
        "http://example.org", "http://x.com/fr/a", "http://x.com/de/b", "http://x.com/", "http://casino.net/x", "http://a.net/Poker/1", "http://pokers.net/",
        "http://10.1.2.3/x", "ftp://com/de/", "http://x.com/DE/b", "http://y.net/?u=http://x.com/de/",
    ]
    want = {
        4: ("example.org", "/es/x", "example.org/es/", "block"), 5: ("a.example.org", "/en/12", "example.org/en/1", "block"), 6: ("notexample.org", "/es/", "org/", "allow"),
        7: ("org", "/", "org/", "allow"), 8: ("example.org", "", None, "allow"), 9: ("x.com", "/fr/a", "com/fr/", "allow"), 10: ("x.com", "/de/b", "com/de/", "block"),
        11: ("x.com", "/", None, "allow"), 12: ("casino.net", "/x", None, "block"), 13: ("a.net", "/Poker/1", None, "block"), 14: ("pokers.net", "/", None, "allow"),
        15: ("10.1.2.3", "/x", None, "block"), 16: ("com", "/de/", "com/de/", "block"), 17: ("x.com", "/DE/b", None, "allow"), 18: ("y.net", "/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, host string, token string")
    got = {r.page_id: tuple(r[1:]) for r in url_filters.url_verdicts(pages).collect()}
    assert {i: got[i] for i in want} == want and all(got[i] == ("", "", None, "allow") for i in (None, 0, 1, 2, 3))
    assert url_filters.url_verdicts(pages.limit(0)).count() == 0
    long = "http://x.com/" + "a/" * 200_000
    many = spark.createDataFrame([(1, long + "casino"), (1, long + "casino"), (2, long)], "page_id int, url string")
    same([(r.page_id, r.verdict) for r in url_filters.url_verdicts(many).collect()], [(1, "block"), (1, "block"), (2, "allow")])
    assert {r.verdict for r in url_filters.url_verdicts(pages, url_filters.default_rules(spark).limit(0)).collect()} == {"allow"}


def test_ten_thousand_rules_give_what_trying_all_gives(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(1500)]
    hosts = [".".join(rng.sample(names, rng.randrange(1, 3)) + [rng.choice(["net", "org", "com"])]) for _ in range(3000)]
    rules = {(f"{rng.choice(hosts)}/" + rng.choice(["", "a/", f"{rng.choice(names)}/", rng.choice(names), rng.choice(names)[:-1]]), "prefix") for _ in range(7000)}
    rules |= {(rng.choice(["net/", "a.b/", "org/x\\E", "com/q+(", f"{rng.choice(names)}.org/"]), "prefix") for _ in range(50)}
    rules |= {(rng.choice(names).upper() if rng.random() < 0.5 else f"{rng.choice(names)}", "word") for _ in range(300)}
    shapes = ["/{a}/{b}", "^{a}\\.{b}\\.", "-{a}/*{b}", "/{a}-?{b}/", "/{a}.{b}$", "_{a}$", "/({a}|{b})/", "={a}\\.", "/[ab]{a}/", "^\\d+\\.", "/+{a}/", "/{a}/{{0,2}}z", "{a}{b}"]
    rules |= {(rng.choice(shapes).format(a=rng.choice(names), b=rng.choice(names)), "regex") for _ in range(3200)}
    rules = [(r, k, rng.choice(["allow", "block"]), rng.randrange(3)) for r, k in sorted(rules)]
    assert len(rules) > 9_500
    targets = {"", "org/x\\E/1", "y.com/q+(", "9.8/"} | {rng.choice(hosts) for _ in range(20)}
    for r, k, _, _ in rng.sample(rules, 250):
        piece = r.replace("\\.", ".").replace("^", "").replace("$", "").replace("/*", "").replace("?", "")
        targets |= {piece, f"sub.{piece}", f"x.net/{piece}", f"x.net{piece}/q", f"x.net/{piece}z", f"x.net/-{piece}K"}
    java = [(re.compile(r) if k == "regex" else re.compile(rf"(?ai)(?:^|[^a-z0-9]){re.escape(r)}(?:[^a-z0-9]|$)") if k == "word" else None, r, k, v, p) for r, k, v, p in rules]

    def fits(target, pattern, rule):
        if pattern is not None:
            return pattern.search(target) is not None
        (host, _, path), (rh, _, rp) = target.partition("/"), rule.partition("/")
        return "/" in target and (host == rh or host.endswith("." + rh)) and path.startswith(rp)

    want = set()
    for t in targets:
        best = max(((k == "prefix", len(r) if k == "prefix" else p, r, v) for x, r, k, v, p in java if fits(t, x, r)), default=None)
        if best:
            want.add((t, best[2] if best[0] else None, best[3]))
    urls = spark.createDataFrame([(t,) for t in targets], "target string")
    table = spark.createDataFrame(rules + rules[:50] + [(None, "word", "block", 1), ("n1", None, "block", 1), ("n2", "word", None, 1)], url_filters.RULE_SCHEMA)
    assert {tuple(r) for r in url_filters.judge(urls, table).collect()} == want and len(want) > 300
    tokenless = url_filters.compiled(table).filter("size(tokens) = 0").count()
    assert url_filters.candidates(urls, table).count() < len(targets) * (tokenless + 100)


# 8 sharding

def test_sharding(docs, rows, none, spark):
    got = sharding.assign_shards(docs, shards=3).collect()
    sizes, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert sharding.assign_shards(none, shards=8).count() == 0
    hot = spark.createDataFrame([(i, "copy of one text") for i in range(4000)] + [(9000 + i, f"text number {i}") for i in range(500)], "doc_id long, text string")
    filled = {r.shard: r["sum(size)"] for r in sharding.assign_shards(hot, shards=8).groupBy("shard").sum("size").collect()}
    assert len(filled) == 8 and max(filled.values()) < 1.02 * min(filled.values())


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(7)
    for _ in range(50):
        sizes, capacity, free, want = [rng.randrange(1, 60) for _ in range(80)], 60, [], []
        for i in sorted(range(80), key=lambda i: (-sizes[i], i)):
            fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
            if fits:
                b = min(fits)[1]
            else:
                b = len(free)
                free.append(capacity)
            free[b] -= sizes[i]
            want.append((i, b))
        assert sharding.best_fit_decreasing(sizes, capacity) == [b for _, b in sorted(want)]


# 9 toxicity

def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    rows = [(i, words(rng, 60) + (" you Zorgol! " if i % 6 == 0 else " ") + words(rng, 60)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) and 0 <= got[i].score <= 1 for i in got)
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert toxicity.toxicity(docs, labels).count() == docs.count() and toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    knots, values = toxicity.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()


# 10 SimHash

def components(fingerprints, radius=4):
    parent = {f: f for f in fingerprints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in ordered}


def slow_fingerprint(text):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = (text or "").encode().translate(lower).split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, none):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    roots, least = components({f for _, f in prints}), {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = [(i, f"{f:016x}", least.get(roots[f])) for i, f in prints]
    same(simhash.near_duplicates(docs).collect(), want)
    stays = simhash.drop_near_duplicates(docs)
    assert stays.columns == docs.columns and {r.doc_id for r in stays.select("doc_id").collect()} == set(least.values())
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_near_group_stays(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 300, 5000) for _ in range(4))
    rows = [(1, a), (1, a + " "), (1, a + "  "), (2, a), (None, a)]  # one id, several texts
    rows += [(None, b), (None, b + " "), (None, b)]  # no id at all
    rows += [(7, c), (7, c), (None, c)] + [(1, d), (9, d)]  # repeated rows; an id of another group
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    got = simhash.drop_near_duplicates(table).collect()
    same([(r.text.strip(), r.doc_id) for r in got], [(a, 1), (b, None), (c, 7), (d, 1)])
    assert simhash.drop_near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("shard_points, dense, radius", [(10**9, 16, 4), (40, 10**6, 4), (40, 10**6, 3), (40, 0, 4), (5, 16, 2)])
def test_near_links_lose_none(spark, shard_points, dense, radius, monkeypatch):
    """One tree, shards by vantage points, and all shards cut into bands."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(9)
    points = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            points.add(centre)
            for _ in range(rng.randrange(0, 5)):
                centre ^= 1 << rng.randrange(64)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    from relaytrail.llm.components import connected_components

    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), radius, shard_points)
    root = {r.u % (1 << 64): r.root % (1 << 64) for r in connected_components(links).collect()}
    want = components(points, radius)
    pairs = lambda m: {frozenset(p for p in points if m.get(p, p) == r) for r in {m.get(p, p) for p in points}}
    assert pairs(root) == pairs(want)


def test_vantage_point_tree_finds_all_pairs_of_a_dense_set():
    rng = np.random.default_rng(3)
    points = np.unique(np.r_[rng.integers(0, 1 << 14, 3000).astype(np.uint64), rng.integers(0, 1 << 63, 2000).astype(np.uint64)])
    links = simhash.Links(len(points))
    simhash.tree_links(points, 2, links)
    direct = simhash.Links(len(points))
    simhash._near(points, points, np.arange(len(points)), np.arange(len(points)), 2, direct)
    assert (links.roots() == direct.roots()).all()


@pytest.mark.parametrize("radius, spread", [(4, 64), (4, 12), (3, 64), (2, 20), (1, 64), (0, 64)])
def test_trees_over_parts_cross_boundaries_and_lose_none(radius, spread):
    """Random centres with neighbours up to ``radius`` bits away, and points that differ in few bits only."""
    rng = np.random.default_rng(radius + spread)
    centres = rng.integers(0, 1 << 63, 400).astype(np.uint64) if spread == 64 else rng.integers(0, 1 << spread, 1200).astype(np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(centres), k)).astype(np.uint64), axis=1) for k in range(1, radius + 1)]
    points = np.unique(np.concatenate([centres, *[centres ^ f for f in flips]]))
    links, direct, at = simhash.Links(len(points)), simhash.Links(len(points)), np.arange(len(points))
    for mask in simhash.part_masks(radius):
        simhash.part_links(points, mask, radius // (radius // 2 + 1), radius, links)
    simhash._near(points, points, at, at, radius, direct)
    assert (links.roots() == direct.roots()).all()


def test_cost_grows_below_the_power_of_one_and_a_half(spark, monkeypatch):
    """Comparisons over shards and trees at three sizes of random fingerprints."""
    made = []
    near = simhash._near
    monkeypatch.setattr(simhash, "_near", lambda x, y, *rest: (made.append(len(x) * len(y)), near(x, y, *rest)))
    rng, costs = np.random.default_rng(1), []
    for n in (2_000, 8_000, 32_000):
        made.clear()
        points = rng.integers(-(1 << 63), 1 << 63, n)
        shards = simhash.vantage_shards(spark.createDataFrame([(int(p),) for p in points], "fp long"), 4, simhash.vantage_levels(n, 1000)).toPandas()
        for (part, _), group in shards.groupby(["part", "shard"]):
            inside = group["fp"].to_numpy().view(np.uint64)
            simhash.part_links(inside, simhash.part_masks()[part], 1, 4, simhash.Links(len(inside)))
        costs.append(sum(made))
    assert costs[2] / costs[0] < 16**1.5 and costs[2] / costs[1] < 4**1.5
