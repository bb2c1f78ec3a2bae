"""Quality rules: per-document repetition measures and cross-document line frequency.

Built-in functions only. A line is normalised (lower case, digits as 0, white space single) and
hashed; for every host (the ``source`` column) the distinct documents that hold it are counted, and
lines above ``max_documents`` are removed. Documents that lose more than ``max_removed`` of their
words this way, and documents that fail the base rules, are rejected.

Copies of one document are one document here: documents that hold a line are told apart by a
128-bit hash of their whole text without white space, the text by which exact deduplication compares.
So a popular clean document does not make its own lines boilerplate; copies are the business of
deduplication. Every other document counts, however many lines it shares; so do near copies.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host
of its own; repeated rows get equal verdicts; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail.llm.common import SPACE, durable_table, identity, text_of, without_space, wrapped

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of a host when more distinct documents than this hold it.
MAX_DOCUMENTS = 100
#: A document is depleted when more than this share of its words is in boilerplate lines.
MAX_REMOVED = 0.8


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable is not expanded again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words; without a word the only element is empty."""
    return F.split(F.btrim(text, F.lit(SPACE)), r"[ \t-\r]+")


def n_words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows that occur twice or more in the array."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            same = lambda k, x: F.coalesce(F.get(s, k).getField("h") == x.getField("h"), F.lit(False))
            twice = F.transform(s, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x.getField("i")).otherwise(-1))
            return F.sort_array(F.filter(twice, lambda p: p >= 0))

        def length(d: Column) -> Column:
            steps = F.transform(d, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(d, k + 1) - p, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return bound(pairs, lambda s: bound(starts(s), length))

    def windows_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))

    def judged(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound(hashes, lambda h: F.when(F.size(h) < window, F.lit(0).cast("long")).otherwise(bound(windows_of(h), judged)))


def worded_lines(text: Column) -> Column:
    """The ``\\n``-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != "")


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), r"[ \t-\r]+", " "))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"),
        *identity(id_col, host_col, text_col),
    )
    bare = F.translate("text", SPACE, "")

    def counted(words: Column) -> Column:
        n = F.when(F.get(words, F.lit(0)) == "", 0).otherwise(F.size(words)).cast("long")
        return F.struct(n.alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    rows = rows.withColumn("counted", bound(word_array(F.col("text")), counted))
    return rows.select(
        "doc_id", "host", "_u1", "_u2", "counted.n_words",
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(worded_lines(F.col("text")), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        "counted.n_repeat_words",
    )


def line_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(host, u1, u2, d1, d2, place, line, words) of every line with a word of every document."""

    def hashed(norm: Column) -> Column:
        words = F.char_length(norm) - F.char_length(F.translate(norm, " ", "")) + 1
        return F.struct(F.xxhash64(norm).alias("line"), words.alias("words"))

    lines = F.transform(worded_lines(text_of(text_col)), lambda line: bound(normal_line(line), hashed))
    d1, d2 = identity(without_space(text_of(text_col)))
    rows = docs.select(
        F.col(host_col).alias("host"), *identity(id_col, host_col, text_col), d1.alias("_d1"), d2.alias("_d2"), lines.alias("lines"),
    )
    rows = rows.select("host", "_u1", "_u2", "_d1", "_d2", F.posexplode("lines").alias("place", "x"))
    return rows.select("host", "_u1", "_u2", "_d1", "_d2", "place", F.col("x.line").alias("line"), F.col("x.words").alias("words"))


def boilerplate(lines: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line) of the lines that more distinct documents of the host hold than allowed."""
    # distinct (host, line, document) first: no hot key
    return (
        lines.groupBy("host", "line", "_d1", "_d2").agg(F.lit(1).alias("one")).groupBy("host", "line")
        .agg(F.count("one").alias("documents")).filter(F.col("documents") > max_documents).select("host", "line")
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """(doc_id, measures, base_failed, removed_words, removed_lines, kept) of every row."""
    measured = measures(docs, id_col, text_col, host_col).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    )
    lines = durable_table(line_rows(docs, id_col, text_col, host_col), "lines")
    frequent = boilerplate(lines, max_documents).withColumnRenamed("line", "f_line").withColumnRenamed("host", "f_host")
    removed = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")))
        # repeated rows bring the same places of the same text: each counts once
        .groupBy("_u1", "_u2", "place").agg(F.max("words").alias("words"), F.max("line").alias("line"))
        .groupBy("_u1", "_u2").agg(F.sum("words").alias("words"), F.collect_set("line").alias("removed_lines"))
    )
    removed_words = F.coalesce(F.col("words"), F.lit(0)).cast("long")
    return measured.join(removed, ["_u1", "_u2"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        removed_words.alias("removed_words"), "removed_lines",
        (~F.col("base_failed") & (removed_words <= max_removed * F.col("n_words"))).alias("kept"), "_u1", "_u2",
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose normalised hash is in ``removed``."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(removed, F.xxhash64(normal_line(line))))
    return F.array_join(kept, "\n")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept rows as (doc_id, host, text), with boilerplate lines removed from their text."""
    found = quality_rules(docs, id_col, text_col, host_col).filter("kept").select("_u1", "_u2", "removed_lines").dropDuplicates(["_u1", "_u2"])
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("removed_lines")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), *identity(id_col, host_col, text_col))
    return rows.join(found, ["_u1", "_u2"]).select("doc_id", "host", text.alias("text"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` the rules keep, with all their columns and whole texts."""
    found = quality_rules(docs, id_col, text_col, host_col).filter("kept").select("_u1", "_u2")
    u1, u2 = identity(id_col, host_col, text_col)
    return wrapped(docs, _u1=u1, _u2=u2).join(found, ["_u1", "_u2"], "left_semi").select("row.*")


ORACLE_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base
), win AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS s FROM words, unnest(generate_series(1, len(w) - 7)) AS t(i) WHERE len(w) >= 8
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hit) GROUP BY r
), line AS (
  SELECT r, source, raw, trim(regexp_replace(translate(lower(raw), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS raw FROM base) WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT raw) AS n_dup_lines FROM line GROUP BY r
), frequent AS (
  SELECT source, norm FROM line GROUP BY source, norm HAVING count(DISTINCT r) > 100
), maybe AS (
  SELECT r, sum(n) AS removed FROM line WHERE EXISTS (SELECT 1 FROM frequent f WHERE f.norm = line.norm AND f.source IS NOT DISTINCT FROM line.source) GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(removed, 0) AS removed
  FROM base JOIN words USING (r) LEFT JOIN cover USING (r) LEFT JOIN dup USING (r) LEFT JOIN maybe USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed <= 0.8 * n_words AS kept
FROM measured
"""
