"""Six-locus message fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions import net, text
from relaytrail.functions.core import before_first, blank_to_null, strings, strip
from relaytrail.functions.similarity import hex16, simhash64

LOCI = tuple(fv.LOCUS_WEIGHTS)


def _sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def locus_infrastructure() -> Column:
    public = F.filter(
        "hops", lambda h: (h["ip_class"] == "public") & h["observed_ip"].isNotNull()
    )
    return F.struct(
        net.ip_prefix(F.col("feos_ip")).alias("feos_prefix"),
        _sorted_set(F.transform(public, lambda h: net.ip_prefix(h["observed_ip"]))).alias(
            "prefixes"
        ),
        net.host_suffix(F.get("hops", F.col("boundary_seq"))["by_host"], 2).alias(
            "boundary_provider"
        ),
        _sorted_set(F.transform("hops", lambda h: net.host_suffix(h["rdns_claim"], 2))).alias(
            "rdns_suffixes"
        ),
    )


def locus_identity() -> Column:
    def organisation(address: str) -> Column:
        return net.last_two_labels(F.substring_index(address, "@", -1))

    tokens = F.regexp_extract_all(
        F.coalesce("from_display", F.lit("")), F.lit("([A-Za-z]{2,})"), 1
    )
    local = F.when(
        F.col("from_address").contains("@"), F.substring_index("from_address", "@", 1)
    ).otherwise("")
    return F.struct(
        net.last_two_labels(F.col("from_domain")).alias("from_domain"),
        organisation("reply_to_address").alias("reply_to_domain"),
        organisation("return_path").alias("return_path_domain"),
        F.array_sort(F.transform(tokens, F.lower)).alias("display_tokens"),
        text.char_shape(F.coalesce(local, F.lit(""))).alias("local_part_shape"),
    )


def locus_naming() -> Column:
    primary = F.coalesce(
        blank_to_null(F.col("from_domain")),
        blank_to_null(F.lower(net.url_authority(F.get("urls", F.lit(0))))),
    )
    return F.struct(
        F.when(primary.contains("."), F.substring_index(primary, ".", -1)).alias("tld"),
        F.coalesce(
            F.when(primary.isNotNull(), text.name_features(primary)),
            F.array().cast("array<double>"),
        ).alias("features"),
        F.coalesce(text.trigrams(before_first(primary, ".")), strings([])).alias("trigrams"),
    )


def locus_tooling() -> Column:
    order = F.array_distinct(
        F.filter(
            F.transform("headers", lambda h: F.lower(h["name"])),
            lambda n: n.isin(*fv.FINGERPRINT_HEADERS),
        )
    )

    def header(name: str) -> Column:
        return text.header_value(F.col("headers"), name)

    content_type = F.coalesce(header("Content-Type"), F.lit(""))
    mailer = F.coalesce(blank_to_null(header("X-Mailer")), header("User-Agent"))
    boundary = blank_to_null(F.regexp_extract(content_type, r'boundary="?([^";]+)"?', 1))
    return F.struct(
        order.alias("header_order"),
        F.substring(F.sha2(F.to_json(order), 256), 1, 32).alias("header_order_hash"),
        blank_to_null(strip(mailer)).alias("x_mailer"),
        blank_to_null(F.lower(strip(before_first(content_type, ";")))).alias("mime_root"),
        F.array_sort(F.transform("attachments", lambda a: a["content_type"])).alias("mime_parts"),
        text.token_shape(boundary).alias("boundary_shape"),
        text.message_id_template(F.col("message_id")).alias("message_id_template"),
    )


def locus_content() -> Column:
    tokens = text.content_tokens(F.col("text_body"))
    markers = F.transform(
        F.filter("findings", lambda f: f["signal_group"] == "content"), lambda f: f["rule_id"]
    )
    return F.transform(
        F.array(tokens),
        lambda t: F.struct(
            simhash64(t).alias("simhash"),
            F.size(t).alias("token_count"),
            _sorted_set(markers).alias("template_markers"),
        ),
    )[0]


def locus_payload() -> Column:
    urls = F.col("urls")
    return F.struct(
        F.array_sort(F.transform("attachments", lambda a: a["sha256"])).alias("attachment_hashes"),
        _sorted_set(F.transform(urls, lambda u: text.char_shape(net.url_path(u)))).alias(
            "url_path_shapes"
        ),
        _sorted_set(F.transform(urls, lambda u: F.lower(net.url_authority(u)))).alias("url_hosts"),
    )


def flatten_locus(locus: str, scalars: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    """A locus as a sorted set of ``key=value`` strings."""
    named = [F.concat(F.lit(f"{k}="), F.col(f"{locus}.{k}")) for k in scalars]
    items = F.concat(
        F.array(*named) if named else strings([]), *[_labelled(locus, k) for k in lists]
    )
    return _sorted_set(items)


def _labelled(locus: str, key: str) -> Column:
    return F.transform(f"{locus}.{key}", lambda v: F.concat(F.lit(f"{key}="), v))


def fingerprint(analysed: DataFrame, *keys: str) -> DataFrame:
    """Six locus structs, their set forms, a 48-digit barcode and the version."""
    loci = analysed.select(
        *keys,
        locus_infrastructure().alias("i"),
        locus_identity().alias("d"),
        locus_naming().alias("n"),
        locus_tooling().alias("m"),
        locus_content().alias("c"),
        locus_payload().alias("p"),
    )
    bands = [F.substring(F.sha2(F.to_json(k, {"ignoreNullFields": "false"}), 256), 1, 8) for k in LOCI]
    return loci.select(
        "*",
        flatten_locus(
            "i", ("feos_prefix", "boundary_provider"), ("prefixes", "rdns_suffixes")
        ).alias("i_set"),
        flatten_locus(
            "d",
            ("from_domain", "reply_to_domain", "return_path_domain", "local_part_shape"),
            ("display_tokens",),
        ).alias("d_set"),
        flatten_locus("p", (), ("attachment_hashes", "url_path_shapes", "url_hosts")).alias(
            "p_set"
        ),
        hex16(F.col("c.simhash")).alias("simhash_hex"),
        F.concat(*bands).alias("barcode"),
        F.lit(fv.FINGERPRINT_VERSION).alias("dna_version"),
    )
