"""What the corpus operators hold and do for each word, beside their results."""

import re

import numpy as np
from pyspark.sql import functions as F

from relaytrail.llm import mixing, pieces, substring_dedup

AWKWARD = ["", " \n\t ", "one", " two\x0bwords\r\n", "é 漢字\x85 \x1cend", "a" * 700 + " b " + "c" * 70 + "  d", "plain ab1 1 AB -- ab1"]


def test_memo_of_pieces_is_bounded_and_keeps_what_is_frequent(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 50)
    learned, held = [], []

    def encode(new):
        learned.extend(new)
        return [p.encode() for p in new]

    encoder = pieces.PieceEncoder(r" ?[^\s\d]+| ?\d|\s+", encode)
    for i in range(40):
        texts = [" ".join(["the", *(f"{c}{d}x{'abcdefghij'[i % 10] * (i + 1)}" for c in "pqrst"), "the"]) + end for d, end in zip("123", ["", " \n y", " "])]
        assert encoder.encode(texts) == [t.encode() for t in texts]
        held += [len(vars(memo)[k]) for memo in (encoder.chunks, encoder.pieces) for k in ("newer", "older")]
    assert max(held) < 100 and learned.count(" the") == 1
    assert encoder.encode([]) == []


def test_a_text_is_split_once_for_words_and_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    labels = rows.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))
    tokens = [t for text in AWKWARD for t in re.findall("[^\x20\x09-\x0d]+", text)]
    weights = {h: [1.5, -0.5] for h in [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(F.xxhash64(F.lower("t"))).collect()]}
    assert mixing.mixing_rates(rows, labels).count() == len(AWKWARD)
    got = rows.select("doc_id", mixing.weighed(F.col("text"), [0.1, 0.2, 0.3], weights).alias("of"), mixing.tokens_of(F.col("text")).alias("hashes"))
    for r in got.collect():
        words = re.findall("[^\x20\x09-\x0d]+", AWKWARD[r["doc_id"]].lower())
        logits = np.array([0.1, 0.2 + 1.5 * len(set(words)), 0.3 - 0.5 * len(set(words))])
        assert r["of"]["tokens"] == len(words)
        assert np.allclose(r["of"]["posterior"], np.exp(logits) / np.exp(logits).sum())
        shapes = {re.sub("[a-z]", "", w) for w in words or [""]}
        assert len(r["hashes"]) == len(set(r["hashes"])) == len(set(words or [""])) + len({w[:5] for w in words or [""]}) + len(shapes)


def test_word_hashes_follow_the_bytes_of_the_words(monkeypatch):
    for piece in (1 << 18, 64):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        by_word = {}
        for text in [*AWKWARD, " ".join(AWKWARD), "x " + "\n".join(AWKWARD)]:
            words, want = substring_dedup.Words(text.encode()), text.encode().split()
            assert [text.encode()[a:b] for a, b in zip(words.starts, words.ends)] == want
            for word, h in zip(want, words.hashes.tolist(), strict=True):
                assert by_word.setdefault(word, h) == h
            assert not want or words.content(0, len(want)) == b" ".join(want)
        assert len(set(by_word.values())) == len(by_word)
