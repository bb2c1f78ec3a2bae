"""Text shapes, templates and sketches as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from relaytrail import fixed_values as fv
from relaytrail.functions.core import before_first, bound, let, strip


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation; Spark has no built-in for it."""
    return values.str.normalize("NFKC")


def confusable_skeleton(c: Column, normalise: bool = False) -> Column:
    """Visual skeleton: lower case with confusable characters mapped to ASCII.

    ``normalise`` adds NFKC through an Arrow UDF; leave it off for text that is already
    normalised, as the parser's sender domains are.
    """
    text = nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)) if normalise else None
    text = F.coalesce(text, c) if normalise else c
    return F.translate(
        F.lower(text), "".join(fv.CONFUSABLES), "".join(fv.CONFUSABLES.values())
    )


@bound
def shannon_entropy(c: Column) -> Column:
    """Entropy of the characters of a string in bits; 0 for the empty string."""
    n = F.length(c).cast("double")
    total = let(
        F.split(c, ""),
        lambda chars: F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda s, ch: s
            - let(
                F.size(F.filter(chars, lambda x: x == ch)) / n,
                lambda p: p * F.log2(p),
            ),
        ),
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def char_shape(c: Column) -> Column:
    """Character-class skeleton of the text, runs cut to three."""
    shaped = F.regexp_replace(
        F.regexp_replace(c, r"\p{Nd}", "9"), r"\p{L}", "a"
    )
    return F.regexp_replace(shaped, r"(?s)(.)\1{2,}", "$1$1$1")


def token_shape(c: Column) -> Column:
    """Each alphanumeric run becomes ``w<length>``."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)([A-Za-z0-9]+|[^A-Za-z0-9])"), 1)
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike("^[A-Za-z0-9]"), F.concat(F.lit("w"), F.length(p).cast("string"))
            ).otherwise(p),
        ),
        "",
    )


@bound
def message_id_template(c: Column) -> Column:
    """Local part of a Message-ID with hexadecimal runs, then digit runs, replaced."""
    local = before_first(F.regexp_replace(c, "^[<>]+|[<>]+$", ""), "@")
    marked = F.regexp_replace(
        F.regexp_replace(local, fv.MESSAGE_ID_HEX_PATTERN, "H"), r"\d+", "N"
    )
    return F.when(c != "", marked)


@bound
def trigrams(c: Column) -> Column:
    """Sorted distinct character trigrams."""
    return F.when(F.length(c) < 3, F.array().cast("array<string>")).otherwise(
        F.array_sort(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length(c) - 2), lambda i: c.substr(i, F.lit(3))
                )
            )
        )
    )


@bound
def name_features(domain: Column) -> Column:
    """[label length, hyphens, digits, entropy (2 decimals), number of labels]."""
    label = before_first(domain, ".")
    return F.array(
        F.length(label).cast("double"),
        (F.length(label) - F.length(F.replace(label, F.lit("-"), F.lit("")))).cast("double"),
        F.length(F.regexp_replace(label, r"[^\p{Nd}]", "")).cast("double"),
        F.bround(shannon_entropy(label), 2),
        F.size(F.split(domain, r"\.")).cast("double"),
    )


def placeholder_text(body: Column) -> Column:
    """Lower-cased text with numbers, links, addresses and times replaced, in that order."""
    text = F.lower(body)
    for pattern, token in fv.PLACEHOLDER_PATTERNS:
        text = F.regexp_replace(text, "(?U)" + pattern, token)
    return text


def content_tokens(body: Column) -> Column:
    return F.regexp_extract_all(placeholder_text(body), F.lit(f"({fv.CONTENT_TOKEN_PATTERN})"), 1)


def html_to_text(html: Column) -> Column:
    """Tags removed, blanks collapsed, trimmed."""
    bare = F.regexp_replace(html, f"(?s){fv.TAG_PATTERN}", " ")
    return strip(F.regexp_replace(bare, fv.BLANK_PATTERN, " "))


def extract_urls(text: Column, html: Column) -> Column:
    """Ordered distinct URLs of text, html and href attributes, refanged and trimmed."""

    def found(c: Column, pattern: str) -> Column:
        return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 1)

    url_pattern = "(?=[hfHF])(?iU)" + fv.URL_PATTERN  # the first letter is cheaper to test than a boundary
    hrefs = F.filter(
        F.transform(found(html, "(?iU)" + fv.HREF_PATTERN), strip),
        lambda h: F.lower(h).rlike("^(https?|hxxps?)://"),
    )
    trailers = "[" + "".join("\\" + ch for ch in fv.URL_TRAILERS) + "]+$"

    def refang(u: Column) -> Column:
        plain = F.replace(
            F.replace(u, F.lit("hxxp"), F.lit("http")), F.lit("[.]"), F.lit(".")
        )
        return F.regexp_replace(plain, trailers, "")

    return F.array_distinct(
        F.transform(F.concat(found(text, url_pattern), found(html, url_pattern), hrefs), refang)
    )


def header_values(headers: Column, name: str) -> Column:
    """All values of a header in emission order, matched without regard to case."""
    return F.transform(
        F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"]
    )


def header_value(headers: Column, name: str) -> Column:
    """First value of a header, NULL when absent."""
    return F.get(header_values(headers, name), 0)


def tag_map(record: Column) -> Column:
    """``tag=value; tag=value`` as a map: keys lower-cased, last occurrence wins."""
    parts = F.filter(F.split(record, ";"), lambda p: p.contains("="))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(strip(before_first(p, "="))).alias("key"),
            strip(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("value"),
        ),
    )
    # keep the last entry of every key
    n = F.size(entries)
    kept = F.filter(
        F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda x: ~F.exists(
            F.slice(entries, x["i"] + 2, F.greatest(n, F.lit(1))),
            lambda later: later["key"] == x["e"]["key"],
        ),
    )
    return F.map_from_entries(F.transform(kept, lambda x: x["e"]))


def quote_around(
    body: Column, lowered: Column, term: Column, margin: int = 60
) -> Column:
    """Up to ``margin`` characters on both sides of the first hit of a lower-case term."""

    def cut(at: Column) -> Column:
        start = F.greatest(at - margin, F.lit(1))
        part = body.substr(start, at + F.length(term) + margin - start)
        cleaned = strip(F.replace(part, F.lit("\n"), F.lit(" ")))
        return F.when(at > 0, cleaned).otherwise(term)

    return let(F.instr(lowered, term), cut)


def collapse_spaces(c: Column) -> Column:
    """White space collapsed, trimmed, lower-cased: the form quotes are compared in."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")))


