"""Substring dedup: words of passages that occur elsewhere, by an FM-index for every shard.

Equal windows of ``WINDOW`` words have the same minimizer (the least hash of their ``GRAM``-word
runs), so a document is cut into segments of consecutive windows with one minimizer, and a segment
goes to the shard that owns the minimizer. Minimizers that occur once in the corpus leave at once, as
8-byte keys. Equal segments are merged and counted before they move. Each shard builds an FM-index
(BWT in a wavelet matrix) over its segments and streams them through it: backward search gives how
far each end matches a second place, and intervals of at least ``WINDOW`` words are reported.

A minimizer with more than ``HOT_WORDS`` words of distinct segments (say a third of the corpus as
near copies of one document) is split: its windows are counted one by one under their own hash.

Defined results: null and empty texts have no words; documents shorter than a window lose none;
repeated rows are documents that repeat each other; null ids are kept; an empty table gives an empty
result; other columns are ignored. Very long documents are held whole by one task, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from relaytrail.llm.common import SPACE, durable_table, identity, out_batches, small_batches, text_of
from relaytrail.llm.fm_index import FMIndex
from relaytrail.llm.quality import n_words_of

WINDOW, GRAM = 35, 8
#: Words of one index, and of one minimizer's segments above which it is split into windows.
SHARD_WORDS, HOT_WORDS = 400_000, 400_000
#: Bytes hashed at a time; a longer word is hashed on its own.
PIECE = 1 << 18
_GAP = np.zeros(256, bool)
_GAP[list(SPACE.encode())] = True
# a number for each byte, none for white space; odd powers and their inverses modulo 2 ** 64
_BYTE = np.where(_GAP, 0, np.frombuffer(xxhash.xxh3_128_digest(b"bytes") * 128, np.uint64)[:256] * np.arange(1, 512, 2, np.uint64)).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (
    np.r_[np.uint64(1), np.full(PIECE, x, np.uint64)].cumprod(dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))
)


class Words:
    """The words of a text as places in its bytes, with a hash of each.

    The hash is a polynomial in the word's bytes modulo 2 ** 64. It only chooses minimizers: equal words
    have equal hashes, and whether words are equal is decided by their bytes.
    """

    def __init__(self, text: bytes) -> None:
        self.text, data = text, np.frombuffer(text, np.uint8)
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = _GAP[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            a = int(self.starts[at])
            to = int(np.searchsorted(self.ends, a + PIECE, "right"))
            if to == at:
                self.hashes[at] = xxhash.xxh3_64_intdigest(text[a : int(self.ends[at])])
                at += 1
                continue
            values = _BYTE[data[a : int(self.ends[to - 1])]]
            values *= _POWERS[: len(values)]
            places = self.starts[at:to] - a
            self.hashes[at:to] = np.add.reduceat(values, places) * _INVERSES[places]
            at = to

    def content(self, first: int, words: int) -> bytes:
        """Some words, joined by one space."""
        return b" ".join(self.text[int(self.starts[first]) : int(self.ends[first + words - 1])].split())


def segments(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of a document's segments, and the hashes of all its runs."""
    n = len(hashes) - window + 1
    if n < 1:
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty, empty, empty.view(np.uint64)
    runs = hashes[: len(hashes) - gram + 1].copy()
    for j in range(1, gram):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs += hashes[j : len(hashes) - gram + 1 + j]
    runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(29)
    width, least, size = window - gram + 1, runs, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[width - size : width - size + n])
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first], first, np.diff(first, append=n), runs


def repeats(keys: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """2 where a minimizing run occurs twice in the document, else 1."""
    ordered = np.sort(runs)
    return np.minimum(np.searchsorted(ordered, keys, "right") - np.searchsorted(ordered, keys, "left"), 2)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u1, key, repeats) of every segment."""
    for batch in batches:
        parts = [segments(Words(t).hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(p[0]) for p in parts])
        if sizes.sum():
            owner = np.repeat(np.asarray(batch.column(0)), sizes)
            key = np.concatenate([p[0] for p in parts]).view(np.int64)
            times = np.concatenate([repeats(p[0], p[3]) for p in parts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(key), pa.array(times)], ["u1", "key", "repeats"])


def _suspect_segments(with_text: bool):
    schema = pa.schema([
        ("u1", pa.int64()), ("u2", pa.int64()), ("first", pa.int32()), ("seg", pa.binary()), ("key", pa.int64()), ("content", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                for u1, u2, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3)):
                    words = Words(text)
                    keys, first, n, _ = segments(words.hashes)
                    signed = keys.view(np.int64)
                    for i in np.flatnonzero(np.isin(signed, wanted.values.to_numpy())).tolist():
                        content = words.content(int(first[i]), int(n[i]) + WINDOW - 1)
                        yield u1, u2, int(first[i]), xxhash.xxh3_128_digest(content), int(signed[i]), content if with_text else None

        yield from out_batches(rows(), schema)

    return run


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seg, key, content, times) sorted by key; gives (seg, firsts, lasts) of repeated windows."""
    schema = pa.schema([("seg", pa.binary()), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32()))])

    def searched(held: list[tuple]):
        symbols: dict[bytes, int] = {}
        number = lambda w: symbols.setdefault(w, len(symbols) + 1)
        sequences = [np.fromiter(map(number, content.split(b" ")), np.int64) for _, content, _ in held]
        times = [t for *_, t in held]
        alone = np.flatnonzero(np.array(times) < 2)
        if len(alone):
            index = FMIndex(sequences, times, len(symbols) + 1)
            marks = index.repeated(alone, WINDOW)
        for i, ((seg, _, t), s) in enumerate(zip(held, sequences)):
            n = len(s) - WINDOW + 1
            if t >= 2:
                yield seg, [0], [n - 1]
                continue
            change = np.diff(np.r_[0, marks[index.starts[i] : index.starts[i] + n].astype(np.int8), 0])
            if change.any():
                yield seg, np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) - 1).tolist()

    def rows():
        held, size, last = [], 0, None
        for batch in batches:
            for seg, key, content, times in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size > SHARD_WORDS:
                    yield from searched(held)
                    held, size = [], 0
                last = key
                held.append((seg, content, times))
                size += content.count(b" ") + 1
        if held:
            yield from searched(held)

    yield from out_batches(rows(), schema)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, seg, place, times) of every window of the segments of a hot minimizer."""
    schema = pa.schema([("window", pa.binary()), ("seg", pa.binary()), ("place", pa.int32()), ("times", pa.int64())])

    def rows():
        for batch in batches:
            for seg, content, times in zip(*(c.to_pylist() for c in batch.columns)):
                words = content.split(b" ")
                for i in range(len(words) - WINDOW + 1):
                    yield xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])), seg, i, times

    yield from out_batches(rows(), schema)


def repeated_segments(suspects: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """(seg, firsts, lasts): runs of windows, by place in their segment, that occur elsewhere."""
    rows = suspects.select("u1", "u2", "text", "keys").mapInArrow(
        _suspect_segments(True), "u1 long, u2 long, first int, seg binary, key long, content binary"
    )
    distinct = durable_table(
        rows.groupBy("seg").agg(F.first("key").alias("key"), F.first("content").alias("content"), F.count(F.lit(1)).alias("times")), "segments"
    )
    hot = (
        distinct.groupBy("key").agg(F.sum(F.octet_length("content")).alias("bytes")).filter(F.col("bytes") > 6 * hot_words)
        .select("key", F.lit(True).alias("hot"))
    )
    marked = distinct.join(hot, "key", "left")
    found = (
        marked.filter("hot IS NULL").select("seg", "key", "content", "times").repartition("key").sortWithinPartitions("key")
        .mapInArrow(_search_shards, "seg binary, firsts array<int>, lasts array<int>")
    )
    windows = marked.filter("hot").select("seg", "content", "times").mapInArrow(_single_windows, "window binary, seg binary, place int, times long")
    twice = windows.groupBy("window").agg(F.sum("times").alias("n")).filter("n > 1").select("window")
    single = windows.join(twice, "window").groupBy("seg").agg(F.collect_list("place").alias("firsts"))
    return found.unionByName(single.withColumn("lasts", F.col("firsts")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u1, u2, n_removed, kept) of documents and their repeated windows."""
    schema = pa.schema([("u1", pa.int64()), ("u2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def rows():
        for batch in batches:
            for u1, u2, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [s["a"] for s in spans], 1)
                np.add.at(change, [s["b"] + WINDOW for s in spans], -1)
                gone = change.cumsum()[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                yield u1, u2, int(gone.sum()), b" ".join(kept).decode()

    yield from out_batches(rows(), schema)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """(all rows as (doc_id, u1, u2, text), the rows that lose words as (u1, u2, n_removed, kept))."""
    small_batches(docs.sparkSession, rows=500)
    u1, u2 = identity(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), u1.alias("u1"), u2.alias("u2"), text_of(text_col).alias("text"))
    keys = durable_table(rows.select("u1", "text").mapInArrow(_keys, "u1 long, key long, repeats int"), "minimizers")
    repeated = keys.groupBy("key").agg(F.sum("repeats").alias("n")).filter("n > 1").select("key")
    wanted = keys.select("u1", "key").join(repeated, "key", "left_semi").groupBy("u1").agg(F.collect_set("key").alias("keys"))
    suspects = durable_table(rows.select("u1", "u2", "text").join(wanted, "u1"), "suspects")
    found = repeated_segments(suspects, hot_words)
    places = suspects.mapInArrow(_suspect_segments(False), "u1 long, u2 long, first int, seg binary, key long, content binary").select("u1", "u2", "first", "seg")
    # equal rows bring equal spans: any one set of them does
    spans = places.join(found, "seg").select("u1", "u2", F.explode(F.arrays_zip("firsts", "lasts")).alias("x"), "first").select(
        "u1", "u2", F.struct((F.col("first") + F.col("x.firsts")).alias("a"), (F.col("first") + F.col("x.lasts")).alias("b")).alias("span")
    )
    removed = spans.groupBy("u1", "u2").agg(F.collect_set("span").alias("spans"))
    cut = suspects.dropDuplicates(["u1", "u2"]).select("u1", "u2", "text").join(removed, ["u1", "u2"])
    return rows, cut.select("u1", "u2", "text", "spans").mapInArrow(_cut, "u1 long, u2 long, n_removed long, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row."""
    rows, cut = cut_documents(docs, id_col, text_col)
    kept = F.coalesce("kept", single_spaced(F.col("text")))
    return rows.join(cut, ["u1", "u2"], "left").select(
        "doc_id", n_words_of(F.col("text")).alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text")
    )


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256); digests join, so whole texts need not move again."""
    rows, cut = cut_documents(docs, id_col, text_col)
    whole = rows.select("doc_id", "u1", "u2", n_words_of(F.col("text")).alias("n_words"), F.sha2(single_spaced(F.col("text")), 256).alias("whole"))
    changed = cut.select("u1", "u2", "n_removed", F.sha2("kept", 256).alias("sha"))
    return whole.join(changed, ["u1", "u2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256")
    )


def single_spaced(text):
    return F.regexp_replace(F.btrim(text, F.lit(SPACE)), r"[ \t-\r]+", " ")
