"""Addresses, hosts and domains as column expressions.

IPv4 and IPv6 are both handled without Python workers: an address becomes text in its
canonical form, a class, a /24 or /48 prefix, or a hexadecimal key that can be masked for
longest-prefix joins.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import after_first, before_first, bound, constant, let, strings

_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def is_ipv4(c: Column) -> Column:
    return c.rlike(_IPV4)


@bound
def ipv4_number(c: Column) -> Column:
    """The 32-bit value of a valid dotted quad as a long, NULL otherwise."""
    return F.when(
        is_ipv4(c),
        let(
            F.transform(F.split(c, r"\."), lambda o: o.cast("long")),
            lambda o: ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3],
        ),
    )


def _hex16(high: Column, low: Column) -> Column:
    return F.lower(F.hex(high.cast("long") * 256 + low.cast("long")))


@bound
def _inline_quad(c: Column) -> Column:
    """Rewrite a trailing dotted quad (``::ffff:1.2.3.4``) as two hexadecimal groups."""
    quad = F.regexp_extract(c, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    head = F.regexp_extract(c, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1)
    return F.when(
        is_ipv4(quad),
        let(
            F.split(quad, r"\."),
            lambda o: F.concat(head, _hex16(o[0], o[1]), F.lit(":"), _hex16(o[2], o[3])),
        ),
    ).otherwise(c)


@bound
def ipv6_groups(c: Column) -> Column:
    """Eight groups without leading zeros, or NULL when the text is no IPv6 address."""

    def side(text: Column) -> Column:
        return F.when(text == "", strings([])).otherwise(F.split(text, ":"))

    def expand(s: Column) -> Column:
        gapped = s.contains("::")
        left = side(before_first(s, "::"))
        right = F.when(gapped, side(after_first(s, "::"))).otherwise(strings([]))
        missing = F.lit(8) - F.size(left) - F.size(right)
        usable = F.when(gapped, missing >= 1).otherwise(missing == 0)
        return F.when(
            usable,
            F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right),
        )

    groups = let(_inline_quad(F.lower(c)), expand)
    return let(
        groups,
        lambda g: F.when(
            c.contains(":") & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
            F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", "")),
        ),
    )


def _ipv6_text(groups: Column) -> Column:
    """Canonical text: the longest run of zero groups (the first of equals) becomes ``::``."""

    def squeeze(text: Column) -> Column:
        out = None
        for run in range(8, 1, -1):
            pattern = r"^(|.*?:)0(?::0){%d}(?:|:(.*))$" % (run - 1)
            hit = F.concat(
                F.regexp_replace(F.regexp_extract(text, pattern, 1), ":$", ""),
                F.lit("::"),
                F.regexp_extract(text, pattern, 2),
            )
            cond = text.rlike(pattern)
            out = F.when(cond, hit) if out is None else out.when(cond, hit)
        return out.otherwise(text)

    return let(F.array_join(groups, ":"), squeeze)


def _octets(group: Column) -> Column:
    n = F.conv(group, 16, 10).cast("int")
    return F.concat_ws(".", (n / 256).cast("int").cast("string"), (n % 256).cast("string"))


def _ipv6_canonical(c: Column) -> Column:
    def render(g: Column) -> Column:
        mapped = (F.array_join(F.slice(g, 1, 5), "") == "00000") & (g[5] == "ffff")
        return F.when(mapped, F.concat_ws(".", _octets(g[6]), _octets(g[7]))).otherwise(
            _ipv6_text(g)
        )

    return let(ipv6_groups(c), lambda g: F.when(g.isNotNull(), render(g)))


@bound
def ip_canonical(c: Column) -> Column:
    """Canonical address text (IPv4-mapped unwrapped), NULL when it is no address."""
    return F.when(is_ipv4(c), c).when(c.contains(":"), _ipv6_canonical(c))


def ip_normalised(c: Column) -> Column:
    """Canonical form for addresses; trimmed lower case for anything else."""
    return F.coalesce(ip_canonical(c), F.lower(F.trim(c)))


def _ranges(classes) -> Column:
    """Ranges by class as first and last hexadecimal keys, in order of precedence."""
    rows = []
    for name, nets in classes:
        for net in map(ipaddress.ip_network, nets):
            digits = net.max_prefixlen // 4
            first, last = int(net.network_address), int(net.broadcast_address)
            rows.append({"lo": f"{first:0{digits}x}", "hi": f"{last:0{digits}x}", "name": name})
    return constant(rows, "array<struct<lo:string,hi:string,name:string>>")


def _range_name(canonical: Column, v4: Column, v6: Column) -> Column:
    """Name of the first range that holds the address, NULL when none does."""
    return let(
        F.struct(ip_hex(canonical).alias("key"), canonical.contains(":").alias("wide")),
        lambda a: F.get(
            F.filter(
                F.when(a["wide"], v6).otherwise(v4),
                lambda r: a["key"].between(r["lo"], r["hi"]),
            ),
            0,
        )["name"],
    )


def ip_class(c: Column) -> Column:
    """Address class; NULL, empty and malformed text are ``unknown``."""
    known = let(
        ip_canonical(c),
        lambda a: F.when(a.isNull(), "unknown").otherwise(
            F.coalesce(
                _range_name(a, _ranges(fv.IPV4_CLASSES), _ranges(fv.IPV6_CLASSES)),
                F.lit("public"),
            )
        ),
    )
    return F.when(c.isNull(), "unknown").otherwise(known)


@bound
def is_documentation_range(c: Column) -> Column:
    v4 = tuple(n for n in fv.DOCUMENTATION_PREFIXES if ":" not in n)
    v6 = tuple(n for n in fv.DOCUMENTATION_PREFIXES if ":" in n)
    return F.coalesce(
        _range_name(c, _ranges((("doc", v4),)), _ranges((("doc", v6),))) == "doc", F.lit(False)
    )


@bound
def ip_prefix(c: Column) -> Column:
    """The covering /24 of an IPv4 address, or the first three groups of an IPv6 one as /48."""
    return F.when(
        c.contains(":"),
        F.concat(F.array_join(F.slice(F.split(c, ":"), 1, 3), ":"), F.lit("::/48")),
    ).otherwise(F.concat(F.substring_index(c, ".", 3), F.lit(".0/24")))


def ip_version(c: Column) -> Column:
    return F.when(c.contains(":"), 6).when(c.isNotNull(), 4)


@bound
def ip_hex(c: Column) -> Column:
    """Fixed-width hexadecimal key of a canonical address: 8 digits for v4, 32 for v6."""
    v6 = F.array_join(F.transform(ipv6_groups(c), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(c.contains(":"), v6).otherwise(
        F.lpad(F.lower(F.hex(ipv4_number(c))), 8, "0")
    )


def hex_prefix(key: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a hexadecimal key, as text."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(key.substr(whole + 1, F.lit(1)), 16, 10).cast("int")
    kept = digit - digit % F.pow(F.lit(2), 4 - rest).cast("int")
    return F.concat(
        key.substr(F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(kept))).otherwise("")
    )


def host_suffix(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host name."""
    return F.when(host != "", F.substring_index(trim_dots(host), ".", -labels))


def trim_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"^\.+|\.+$", "")


@bound
def last_two_labels(domain: Column) -> Column:
    """Registrable domain by the last-two-labels rule."""
    clean = F.lower(trim_dots(domain))
    return F.when(
        domain != "",
        F.when(clean.contains("."), F.substring_index(clean, ".", -2)).otherwise(domain),
    )


@bound
def registrable_domain(domain: Column, suffixes: Column) -> Column:
    """Registrable domain by public suffix: the longest listed suffix plus one label.

    Falls back to the last two labels when no listed suffix fits or the domain is itself a
    suffix. ``suffixes`` is a short literal array; for a full suffix list use
    ``operators.attribution.with_registrable_domain``, which joins.
    """

    def pick(labels: Column) -> Column:
        n = F.size(labels)
        # start positions from left to right: the first listed tail is the longest suffix
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: F.array_contains(suffixes, F.array_join(F.slice(labels, i, n), ".")),
        )
        at = F.get(starts, 0)
        return F.when(at >= 2, F.array_join(F.slice(labels, at - 1, n), "."))

    clean = F.lower(trim_dots(domain))
    fallback = F.when(clean.contains("."), F.substring_index(clean, ".", -2)).otherwise(
        F.lower(domain)
    )
    return F.when(
        domain.isNotNull(), F.coalesce(let(F.split(clean, r"\."), pick), fallback)
    )


def url_authority(url: Column) -> Column:
    """Text between ``//`` and the next ``/``."""
    return before_first(after_first(url, "//"), "/")


@bound
def url_host(url: Column) -> Column:
    """Lower-cased host without a port."""
    return before_first(url_authority(F.lower(url)), ":")


@bound
def url_path(url: Column) -> Column:
    """Path of a URL without its query; ``/`` when it has none."""
    path = let(
        after_first(url, "//"),
        lambda tail: F.when(
            tail.contains("/"), F.concat(F.lit("/"), after_first(tail, "/"))
        ).otherwise("/"),
    )
    return before_first(path, "?")


def address_domain(address: Column) -> Column:
    """Domain after the last ``@``; NULL when there is none."""
    return F.when(address.contains("@"), F.substring_index(address, "@", -1))
