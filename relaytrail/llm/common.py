"""Shared parts: white space, row identities, Arrow batches and folders of intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relaytrail.operators.durable import durable_folder, durable_table  # noqa: F401

#: The white space of the word rule ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits at.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of texts takes in a Python worker, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """The same bounds for what runs inside only; the session gets its own settings back."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
    before = {key: spark.conf.get(key) for key in bounds}
    for key, value in bounds.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: One more than the most keys that can each hold over one ``HOT``-th of all rows.
HOT = 1024


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their key, where any key may be in a third of the rows.

    ``facts`` has one row a key and its number of rows in ``weight``. Fewer than ``HOT`` keys can be in
    more than a ``HOT``-th of the rows: those are sent to the rows. All others are joined by a shuffle in
    which no key is large. Both tables should be stored, as each is read twice.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.where(F.col(weight) * HOT > total)
    some = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return some.unionByName(rest.join(facts.where(F.col(weight) * HOT <= total), keys, how))


def identity(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of a row's values: rows that agree on all of them share them."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    absent = [c.isNull() for c in cols]
    return [
        F.xxhash64(*cols, *absent).alias("_u1"),
        F.xxhash64(F.lit("second"), *cols, *absent).alias("_u2"),
    ]


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows in a struct ``row`` beside new columns, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without_space(column: Column) -> Column:
    return F.translate(column, SPACE, "")


def out_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded length (and, for long values, of bounded bytes)."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= size or weight > 16 << 20:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list as a table whose size Spark knows, so that joins choose by it."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [f.split(maxsplit=1)[1] for f in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in zip(names, types)])
    structs = [
        F.struct(*[
            (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(t).alias(n)
            for n, t, v in zip(names, types, row)
        ])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
