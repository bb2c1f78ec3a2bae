"""RFC 5322 dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from relaytrail.functions.core import bound, let, map_lookup

_DATE = (
    r"(?i)^\s*(?:[a-z]+\s*,?\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{2,4})\s+"
    r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*([+-]\d{4}|[a-z]+)?"
)
# fixed values: month numbers and named zones (minutes east of UTC)
_MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "oct": 10, "nov": 11, "dec": 12,
}
_ZONES = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}


def _offset_seconds(zone: Column) -> Column:
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    numeric = sign * (
        F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60
    )
    named = F.coalesce(map_lookup(_ZONES, F.lower(zone)) * 60, F.lit(0))
    return F.when(zone.rlike(r"^[+-]\d{4}$"), numeric).otherwise(named)


@bound
def parse_mail_date(c: Column) -> Column:
    """Timestamp of a mail date, NULL when it does not parse.

    Weekday and trailing comment are ignored; a missing, unknown or ``-0000`` zone is UTC.
    """

    def part(i: int) -> Column:
        return F.regexp_extract(c, _DATE, i)

    year = F.try_to_number(part(3), F.lit("9999")).cast("int")
    year = F.when(F.length(part(3)) > 2, year).when(year > 68, year + 1900).otherwise(year + 2000)
    seconds = F.when(part(6) == "", "0").otherwise(part(6))
    text = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
        map_lookup(_MONTHS, F.lower(part(2))).cast("string"), F.lit("-"), part(1),
        F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), seconds, F.lit(" +00:00"),
    )
    wall = F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s XXX")))
    moment = let(
        _offset_seconds(part(7)),
        lambda off: F.when(F.abs(off) < 86400, F.timestamp_seconds(wall - off)),
    )
    return F.when(c.rlike(_DATE), moment)
