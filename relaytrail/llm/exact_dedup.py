"""Exact dedup: partitions by length and content hash own Patricia tries of whole byte strings.

Every input partition first merges its own equal texts in a trie (a map-side combine, so a group of
copies sends one row per partition). The owners of a (length, hash) pair insert the byte strings
into their trie; terminal nodes keep the row that stays and the number of rows. Rows reach an owner
sorted by length and hash, so a subtree is complete once the stream has passed its pair: when the
trie outgrows its budget, complete subtrees are given out and dropped, and Spark's external sort
holds the rest on disk.

Defined results: a null text is empty; null ids come after all others; repeated rows count in the
group's size and one of them stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relaytrail.llm.common import out_batches, small_batches, text_of, without_space, wrapped
from relaytrail.llm.patricia import PatriciaTrie

TRIE_BYTES = 32 << 20
_PART = pa.schema([
    ("n_bytes", pa.int64()), ("hash", pa.int64()), ("norm", pa.binary()), ("points", pa.int64()),
    ("id", pa.int64()), ("rows", pa.int64()),
])
_OWNED = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("keep_points", pa.int64()), ("group_size", pa.int64())])


def _better(a: tuple, b: tuple) -> tuple:
    """Terminal value (points, id, rows): most code points, then smallest id; rows add up."""
    rank = lambda v: (-v[0], v[1] is None, v[1] or 0)
    best = a if rank(a) <= rank(b) else b
    return best[0], best[1], a[2] + b[2]


def combine_partition(batches: Iterator[pa.RecordBatch], budget: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of this partition (or of each trie full of it)."""

    def rows():
        trie, hashes = PatriciaTrie(_better), {}

        def given():
            for key, (points, ident, n) in trie.items():
                digest = hashlib.blake2b(key, digest_size=8).digest()
                yield len(key), int.from_bytes(digest, "little", signed=True), key, points, ident, n

        for batch in batches:
            for norm, points, ident in zip(*(c.to_pylist() for c in batch.columns)):
                trie.add(norm.encode(), (points, ident, 1))
                if trie.bytes_held > budget:
                    yield from given()
                    trie = PatriciaTrie(_better)
        yield from given()

    yield from out_batches(rows(), _PART)


def own_partition(batches: Iterator[pa.RecordBatch], budget: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """The row that stays of each distinct text; the input is sorted by length and hash."""

    def rows():
        trie, last = PatriciaTrie(_better), None
        for batch in batches:
            for n_bytes, digest, norm, points, ident, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (n_bytes, digest) != last and trie.bytes_held > budget:
                    yield from given(trie)
                    trie = PatriciaTrie(_better)
                last = n_bytes, digest
                trie.add(norm, (points, ident, n))
        yield from given(trie)

    def given(trie: PatriciaTrie):
        for key, (points, ident, n) in trie.items():
            yield hashlib.sha256(key).hexdigest(), ident, points, n

    yield from out_batches(rows(), _OWNED)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.char_length(text_of(text_col)).cast("long").alias("points"),
        without_space(text_of(text_col)).alias("norm"),
    )
    parts = rows.select("norm", "points", "doc_id").mapInArrow(
        combine_partition, "n_bytes long, hash long, norm binary, points long, id long, rows long"
    )
    owned = (
        parts.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
        .mapInArrow(own_partition, "sha string, keep_id long, keep_points long, group_size long")
    )
    members = rows.select("doc_id", "points", F.sha2("norm", 256).alias("sha"))
    # rows that agree on id and text are told apart by a number, so that one of them stays
    again = Window.partitionBy("sha", "doc_id", "points").orderBy("doc_id")
    members = members.withColumn("_n", F.row_number().over(again))
    return members.join(owned, "sha", "left").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (F.col("_n") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = exact_duplicates(docs, id_col, text_col).filter("kept").select("keep_id", F.col("text_sha256").alias("keep_sha"))
    marked = wrapped(
        docs, id=F.col(id_col).cast("long"), sha=F.sha2(without_space(text_of(text_col)), 256), points=F.char_length(text_of(text_col))
    )
    first = Window.partitionBy("sha", "id").orderBy(F.desc("points"))
    return (
        marked.join(stays, (F.col("sha") == F.col("keep_sha")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
        .withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*")
    )
