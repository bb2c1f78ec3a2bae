"""Acquisition of raw messages: files, pasted text, base64url payloads and wrapped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import let

RAW_SCHEMA = (
    "org_id string, filename string, source string, acquired_at timestamp, content binary"
)


def read_eml_files(spark: SparkSession, path: str, org_id: str, stream: bool = False) -> DataFrame:
    """Message files as raw messages, in batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.eml")
    if stream:
        files = files.schema("path string, modificationTime timestamp, length long, content binary")
    return files.load(path).select(
        F.lit(org_id).alias("org_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.lit("upload").alias("source"),
        F.col("modificationTime").alias("acquired_at"),
        "content",
    )


def pasted_bytes(text: Column) -> Column:
    """Pasted message text as UTF-8 bytes."""
    return F.encode(text, "UTF-8")


def base64url_bytes(payload: Column) -> Column:
    """Decode base64url with padding restored; NULL for text that cannot be decoded.

    Characters outside the alphabet (line breaks of a wrapped payload) are skipped.
    """
    bare = F.regexp_replace(payload, r"[^\w+/-]+", "")  # \w is A-Za-z0-9_ here, and one look-up a character

    def decoded(digits: Column) -> Column:
        padding = F.repeat(F.lit("="), F.pmod(-F.length(digits), F.lit(4)).cast("int"))
        return F.when(
            F.length(digits) % 4 != 1, F.try_to_binary(F.concat(digits, padding), F.lit("base64"))
        )

    # replace() works on bytes, where translate() looks every character up
    return let(F.replace(F.replace(bare, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")), decoded)


def _looks_raw(text: Column) -> Column:
    return text.rlike(fv.RAW_HEADER_PROBE)


def unwrap_page(body: Column) -> Column:
    """Raw message served as is, or inside the first suitable ``<pre>`` of a page.

    Entities of the page are decoded (``&amp;`` last, so nothing is decoded twice). NULL when
    no candidate starts like a message.
    """

    def decoded(text: Column) -> Column:
        bare = F.regexp_replace(text, r"(?s)<[^>]*>", "")
        for entity, plain in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&amp;", "&"),
        ):
            bare = F.replace(bare, F.lit(entity), F.lit(plain))
        return bare

    marked = F.regexp_extract_all(
        body,
        F.lit(r"(?is)<[a-z]+[^>]*(?:id|class)=[\"']?[^\"'>]*raw_message_text[^>]*>(.*?)</"),
        1,
    )
    plain = F.regexp_extract_all(body, F.lit(r"(?is)<pre\b[^>]*>(.*?)</pre>"), 1)
    inner = F.get(
        F.filter(F.transform(F.concat(marked, plain), decoded), _looks_raw), 0
    )
    is_page = body.rlike(r"(?i)^\s*<(!doctype|html)")
    return F.when(_looks_raw(body) & ~is_page, body).otherwise(inner)


def acquire(raw: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Digest, size and a deterministic case key, taken from the bytes before any parsing.

    Every row is kept; ``reject_reason`` is NULL for those that may be parsed. Messages of any size
    are parsed, unless the caller sets ``max_bytes``.
    """
    size = F.length("content")
    return raw.select(
        "*",
        size.cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.when(F.col("content").isNull(), "undecodable")
        .when(size == 0, "empty")
        .when(size > F.lit(max_bytes), "too_large")
        .alias("reject_reason"),
    ).withColumn("case_id", F.sha2(F.concat_ws("\u0000", "org_id", "sha256"), 256))


def accepted(acquired: DataFrame) -> DataFrame:
    return acquired.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(acquired: DataFrame) -> DataFrame:
    return acquired.where(F.col("reject_reason").isNotNull()).drop("content")


