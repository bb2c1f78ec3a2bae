"""Similarity and sketch functions on arrays and strings, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relaytrail.functions.core import bound, let

_LANE_MASK = 0x0101010101010101
_LANE_SLICE = 127  # a lane is 8 bits wide and the top lane must stay positive


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two string arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))
    )


def set_overlap(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays that hold no element twice: one pass instead of two."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda n: F.when(n == 0, F.lit(0.0)).otherwise(n / (F.size(a) + F.size(b) - n)),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 for unequal sizes or a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(
        F.try_divide(dot(a, b), norm)
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    zeros = F.array_repeat(F.lit(0), F.size(b) + 1)

    def next_row(prev: Column, x: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            up_left, up = F.element_at(prev, j), F.element_at(prev, j + 1)
            value = F.when(F.element_at(b, j) == x, up_left + 1).otherwise(
                F.greatest(up, F.element_at(row, -1))
            )
            return F.concat(row, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    table = F.aggregate(a, zeros, next_row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(
        F.element_at(table, -1)
    )


def lcs_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)
    ).otherwise(lcs_length(a, b) / F.greatest(longest, F.lit(1)))


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance with adjacent transpositions (optimal string alignment)."""
    la, lb = F.length(a), F.length(b)
    first = F.sequence(F.lit(0), lb)
    zero = F.struct(
        first.alias("prev"), F.array_repeat(F.lit(0), lb + 1).alias("before"), F.lit(1).alias("i")
    )

    def char(s: Column, at: Column) -> Column:
        return s.substr(at, F.lit(1))

    def next_row(state: Column, i: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            cost = F.when(char(a, i) == char(b, j), 0).otherwise(1)
            best = F.least(
                F.element_at(row, -1) + 1,
                F.element_at(state["prev"], j + 1) + 1,
                F.element_at(state["prev"], j) + cost,
            )
            swapped = (
                (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
            )
            return F.concat(
                row,
                F.array(
                    F.when(
                        swapped, F.least(best, F.element_at(state["before"], j - 1) + cost)
                    ).otherwise(best)
                ),
            )

        row = F.aggregate(F.sequence(F.lit(1), lb), F.array(i), cell)
        return F.struct(row.alias("prev"), state["prev"].alias("before"), (i + 1).alias("i"))

    table = F.aggregate(F.sequence(F.lit(1), la), zero, next_row, lambda s: s["prev"])
    return (
        F.when(a == b, F.lit(0))
        .when((la == 0) | (lb == 0), la + lb)
        .otherwise(F.element_at(table, -1))
    )


def within_osa(a: Column, b: Column, limit: int) -> Column:
    """``osa_distance(a, b) <= limit``, with the native edit distance as a cheap first test.

    One transposition is at most two plain edits, so a pair further apart than ``2 * limit``
    plain edits cannot qualify.
    """
    near = F.levenshtein(a, b, 2 * limit) != -1
    return F.when(near, osa_distance(a, b) <= limit).otherwise(F.lit(False))


def token_hash64(token: Column) -> Column:
    """Low 64 bits of the MD5 of a token, as a signed long."""
    return F.conv(F.substring(F.md5(token), 17, 16), 16, -10).cast("long")


@bound
def simhash64(tokens: Column) -> Column:
    """64-bit SimHash of a token array as a signed long, counting every occurrence.

    Bit counts are kept in eight longs of eight 8-bit lanes, so a token costs eight additions
    instead of 64; lanes are emptied every 127 tokens, before they can overflow.
    """

    def long(value: int) -> Column:
        return F.lit(value).cast("long")

    def lane_sum(part: Column, j: int) -> Column:
        return F.aggregate(
            part,
            long(0),
            lambda s, h: s + F.shiftrightunsigned(h, j).bitwiseAND(long(_LANE_MASK)),
        )

    def lanes(part: Column) -> Column:
        return F.array(*[lane_sum(part, j) for j in range(8)])

    def ones(counts: Column, b: int) -> Column:
        j, lane = b % 8, b // 8
        return F.aggregate(
            counts,
            long(0),
            lambda s, c: s + F.shiftrightunsigned(c[j], 8 * lane).bitwiseAND(long(255)),
        )

    def bits(counts: Column, n: Column) -> Column:
        value = long(0)
        for b in range(64):
            bit = F.when(ones(counts, b) * 2 > n, F.shiftleft(long(1), b)).otherwise(long(0))
            value = value.bitwiseOR(bit)
        return value

    def fold(hashes: Column) -> Column:
        n = F.size(hashes)
        slices = F.transform(
            F.sequence(F.lit(0), ((n - 1) / _LANE_SLICE).cast("int")),
            lambda s: lanes(F.slice(hashes, s * _LANE_SLICE + 1, _LANE_SLICE)),
        )
        return let(slices, lambda c: bits(c, n))

    return F.when(F.size(tokens) == 0, F.lit(0).cast("long")).otherwise(
        let(F.transform(tokens, token_hash64), fold)
    )


def hex16(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def hamming_similarity(a: Column, b: Column) -> Column:
    """1 - d/64 of two 64-bit sketches."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / 64.0


def saturating_fold(magnitudes: Column) -> Column:
    """Strongest first, each further one adding half of what is left; 4 decimals, at most 1."""
    folded = F.aggregate(
        F.sort_array(magnitudes, asc=False),
        F.lit(0.0),
        lambda s, m: F.when(s == 0, m).otherwise(s + m * (F.lit(1.0) - s) * 0.5),
    )
    return F.bround(F.least(F.lit(1.0), folded), 4)
