"""The prefix trie against a plain one built of dictionaries."""

import collections
import hashlib
import random
import zlib

import pytest

from relaytrail.llm import common, prefix_trie


def by_hand(rows, family=100, heads=6):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32]
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(*t[1:])))
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % heads
        donor = own.get(conv - (abs(conv) % family) * (1 if conv >= 0 else -1), [])
        built[conv] = [t[1:] for t in donor[:h] + turns[h:]]
    nodes = collections.defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    children = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(n))))
        yield (
            min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], leaves[n], saved[n],
            hashlib.sha256(ends.encode()).hexdigest(),
        )


def check(spark, rows, width=prefix_trie.WIDTH, clashes=()):
    schema = "conv_id long, turn long, role string, text string" + "".join(f", `{c}` string" for c in clashes)
    df = spark.createDataFrame([(*r, *clashes) for r in rows], schema).repartition(4)
    got = prefix_trie.prefix_trie(df, width=width)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in got.schema.fields[:-1]} == {"bigint"}
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(by_hand(rows))


def dialogues(seed, convs, most, words=3):
    rng = random.Random(seed)
    for conv in convs:
        for turn in range(rng.randrange(1, most)):
            yield conv, turn, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", f"text {rng.randrange(words)}" * rng.randrange(1, 3)


AWKWARD = [
    (7, None, None, None), (7, None, "user", None), (7, 3, None, ""), (7, 3, "user", "é🙂漢"), (7, 3, "user", "é🙂漢"), (7, 1, "u", "ser"), (8, 1, "us", "er"),
    (None, 1, "user", "of nobody"), (None, None, None, None), (-5, 0, "user", "below zero"), (-105, 1, "user", "a"), (-100, 0, "user", "b"), (-100, 1, "user", "c"),
    (500, 0, "user", "only one"), (501, 0, "user", "x"), (502, 0, "user", "y"), (503, 0, "user", "z"), (504, 0, "user", "w"), (2000, -4, "user", "early"), (2000, 9, "user", "late"),
    (2001, 0, "user", "long " * 50_000), (2002, 0, "user", "long " * 50_000),
]


def test_awkward_conversations(spark):
    clashes = "id at size part row block level weight n depth s1 s2 p1 p2 k1 k2 t1 l1 e1 donor head total last before above".split()
    check(spark, AWKWARD + list(dialogues(1, range(0, 40), 12)), clashes=clashes)


def test_none_and_one(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    check(spark, [(None, 1, "user", "x")])
    check(spark, [(100, 1, "user", "x")])


@pytest.mark.parametrize(("hot", "run", "piece"), [(common.HOT, prefix_trie.RUN, prefix_trie.PIECE), (2, 2, 8)])
def test_long_conversations_and_copies(spark, monkeypatch, hot, run, piece):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = list(dialogues(2, range(90, 230), 9, 2))
    rows += [(300, t, "user", f"turn {t % 5}") for t in range(150)] + [(301, t, "user", f"turn {t % 5}") for t in range(77)]
    rows += [(c, t, "user", "copy") for c in range(400, 460) for t in range(5)]
    check(spark, rows, width=3)


def test_turnless_conversations_end_at_the_root(spark):
    # families without a first conversation: whoever has too few turns is left with none
    check(spark, [(c, 0, "user", str(c)) for c in range(101, 160)])
