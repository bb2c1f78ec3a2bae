"""Links between messages by fingerprint similarity.

A link needs one of infrastructure, tooling or payload at 0.60 or more. That makes exact
blocking possible:

* two sets at 0.60 have sizes near each other and share one of their rarest elements, so a set's
  keys are its rare prefix for every size a partner may have;
* tooling at 0.60 needs an equal mailer, an equal Message-ID template, or an equal boundary shape in
  an equal header order. A block of one of these that grows large is cut by what the gate asks for
  besides: infrastructure, identity and payload must add up to what perfect naming and content
  leave open, so two messages share an element outside the most frequent ones, or, with all three
  tooling parts equal and nothing else shared, a rare trigram of their domain.

Only sketches move: an identifier and the hashed elements of a fingerprint. Within that:

* identical fingerprints are one form with a number of copies, so a wave of copies costs one row;
* a popular block is cut into chunks and chunk pairs become separate join keys, so it spreads
  over many tasks instead of landing in one;
* blocks of the same forms are one block;
* every pair is scored once, under the first block its two forms share, small blocks first, many pairs
  at a time, and only accepted pairs leave the stage;
* where only the links that decide are asked for, what the small blocks gave is the floor that a pair
  of a popular block has to reach to get more than a rough score;
* block keys can be stored, so a batch of new forms meets stored ones without any pair of stored
  forms being looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import let
from relaytrail.functions.similarity import cosine, hamming_similarity, lcs_ratio, set_overlap
from relaytrail.operators.durable import durable_table
from relaytrail.operators.fingerprint import LOCI
from relaytrail.operators.hot_keys import join_popular
from relaytrail.operators.link_tiles import LINK_SCHEMA, group_links, small_block_links

_FORM_COLUMNS = (*LOCI, "i_set", "d_set", "p_set")
#: similarities are rounded to four decimals before the gate
_BLOCK_THRESHOLD = fv.NON_CONTENT_THRESHOLD - 0.0001
CHUNK_ROWS = 8192
#: Pairs of one task of small blocks, on average.
PAIRS_A_TASK = 1_000_000
#: Pairs from which a block is scored by matrices, chunk against chunk, and pairs of one task of that.
TILED_PAIRS = 16_384
TILED_PAIRS_A_TASK = 100_000_000
#: Forms of a tooling block above which it is cut by a further element. Each form of a cut block moves under many keys,
#: and matrices score a whole block sooner than that.
REFINE_ROWS = 32_768
#: Set sizes up to which every size is a class of its own.
_EXACT_SIZES = 8
#: What rounding similarities to four decimals can hide in a weighted sum, and more.
_SLACK = 0.001


def with_form_id(dna: DataFrame) -> DataFrame:
    """Add ``fp_id``: equal exactly for equal fingerprints of one organisation and version."""
    return dna.withColumn(
        "fp_id",
        F.sha2(
            F.to_json(
                F.struct("org_id", "dna_version", *LOCI), {"ignoreNullFields": "false"}
            ),
            256,
        ),
    )


def distinct_forms(dna: DataFrame) -> DataFrame:
    """One row per distinct fingerprint with its number of copies and first case."""
    return (
        with_form_id(dna)
        .groupBy("org_id", "dna_version", "fp_id")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("case_id").alias("first_case"),
            F.max("case_id").alias("last_case"),
            F.any_value(F.struct(*_FORM_COLUMNS)).alias("form"),
        )
    )


def merged_forms(forms: DataFrame) -> DataFrame:
    """Forms of several batches, each once."""
    return forms.groupBy("org_id", "dna_version", "fp_id").agg(
        F.sum("copies").alias("copies"), F.min("first_case").alias("first_case"), F.max("last_case").alias("last_case"),
        F.any_value("form").alias("form"),
    )


def _same(a: Column, b: Column, field: str) -> Column:
    left, right = a["m"][field], b["m"][field]
    return F.coalesce((left == right) & (left != ""), F.lit(False))


def _rounded(value: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), value), 4)


def quick_similarities(a: Column, b: Column) -> dict[str, Column]:
    """The loci that cost little: set overlaps and the content sketch."""
    content = (
        F.greatest(F.lit(0.0), hamming_similarity(a["c"]["simhash"], b["c"]["simhash"])) * 0.7
        + set_overlap(a["c"]["template_markers"], b["c"]["template_markers"]) * 0.3
    )
    return {
        "i": _rounded(set_overlap(a["i_set"], b["i_set"])),
        "d": _rounded(set_overlap(a["d_set"], b["d_set"])),
        "c": _rounded(content),
        "p": _rounded(set_overlap(a["p_set"], b["p_set"])),
    }


def tooling_parts(a: Column, b: Column) -> Column:
    """Tooling similarity of everything but the header order."""
    w = fv.TOOLING_WEIGHTS

    def part(field: str, weight: float) -> Column:
        return F.when(_same(a, b, field), F.lit(weight)).otherwise(0.0)

    return (
        part("x_mailer", w["mailer"]) + part("message_id_template", w["msgid"])
        + part("boundary_shape", w["boundary"])
    )


def order_bound(a: Column, b: Column) -> Column:
    """No header order similarity is above the share of headers two messages have in common."""
    left, right = a["m"]["header_order"], b["m"]["header_order"]
    longest = F.greatest(F.size(left), F.size(right), F.lit(1))
    common = F.size(F.array_intersect(left, right)) / longest
    share = F.when(_same(a, b, "header_order_hash"), F.lit(1.0)).otherwise(common)
    return share * fv.TOOLING_WEIGHTS["order"]


def slow_similarities(a: Column, b: Column) -> dict[str, Column]:
    """Naming (a cosine and an overlap) and tooling (a longest common subsequence)."""
    w = fv.TOOLING_WEIGHTS

    def part(field: str, weight: float) -> Column:
        return F.when(_same(a, b, field), F.lit(weight)).otherwise(0.0)

    # summed in this order: the last digit of a sum depends on it
    order = F.when(_same(a, b, "header_order_hash"), F.lit(w["order"])).otherwise(
        lcs_ratio(a["m"]["header_order"], b["m"]["header_order"]) * w["order"]
    )
    tooling = (
        order + part("x_mailer", w["mailer"]) + part("message_id_template", w["msgid"])
        + part("boundary_shape", w["boundary"])
    )
    naming = (
        cosine(a["n"]["features"], b["n"]["features"]) * 0.4
        + F.when(a["n"]["tld"] == b["n"]["tld"], F.lit(0.2)).otherwise(0.0)
        + set_overlap(a["n"]["trigrams"], b["n"]["trigrams"]) * 0.4
    )
    return {"n": _rounded(naming), "m": _rounded(tooling)}


def _weighted(sims: Column) -> Column:
    total = sum((sims[k] * w for k, w in fv.LOCUS_WEIGHTS.items()), F.lit(0.0))
    return F.bround(total, 4)


def _gate(sims: Column, score: Column) -> Column:
    """Accept: total, number of agreeing loci, and one strong locus that is not content."""
    agreeing = sum(
        (F.when(sims[k] >= fv.LOCUS_AGREEMENT, 1).otherwise(0) for k in LOCI), F.lit(0)
    )
    strongest = F.greatest(*[sims[k] for k in fv.NON_CONTENT_LOCI])
    return (
        (score >= fv.LINK_THRESHOLD)
        & (agreeing >= fv.MIN_AGREEING_LOCI)
        & (strongest >= fv.NON_CONTENT_THRESHOLD)
    )


def link_of(a: Column, b: Column) -> Column:
    """The link of two forms as an array of no or one struct(score, sim_<locus>...).

    Every value is computed once. Pairs whose quick loci cannot reach the threshold even with
    perfect naming and the best header order possible are dropped before the slow ones are looked at.
    """
    w = fv.LOCUS_WEIGHTS

    def finish(pair: Column, quick: Column) -> Column:
        slow = slow_similarities(pair["a"], pair["b"])
        values = {**{k: quick[k] for k in ("i", "d", "c", "p")}, **slow}
        return let(
            F.struct(*[values[k].alias(k) for k in LOCI]),
            lambda sims: F.struct(
                _weighted(sims).alias("score"), *[sims[k].alias(f"sim_{k}") for k in LOCI]
            ),
        )

    def score(pair: Column, quick: Column) -> Column:
        best = sum((quick[k] * w[k] for k in ("i", "d", "c", "p")), F.lit(0.0)) + w["n"]
        tooling = tooling_parts(pair["a"], pair["b"]) + order_bound(pair["a"], pair["b"])
        best = best + tooling * w["m"]
        return F.when(best >= fv.LINK_THRESHOLD - 0.001, finish(pair, quick))

    def both(pair: Column) -> Column:
        quick = quick_similarities(pair["a"], pair["b"])
        return let(F.struct(*[v.alias(k) for k, v in quick.items()]), lambda q: score(pair, q))

    def accepted(link: Column) -> Column:
        return link.isNotNull() & let(
            F.struct(*[link[f"sim_{k}"].alias(k) for k in LOCI]),
            lambda sims: _gate(sims, link["score"]),
        )

    links = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), both)
    return F.filter(links, accepted)


def similarity_of(a: Column, b: Column) -> Column:
    """struct(score, sim_<locus>...) of two forms, whatever they score."""
    values = {**quick_similarities(a, b), **slow_similarities(a, b)}
    return let(
        F.struct(*[values[k].alias(k) for k in LOCI]),
        lambda sims: F.struct(
            _weighted(sims).alias("score"), *[sims[k].alias(f"sim_{k}") for k in LOCI]
        ),
    )


def _size_class(n: Column) -> Column:
    """Sizes as classes, wider ones for larger sets; never decreasing."""
    step = F.floor(F.ln(F.greatest(n, F.lit(_EXACT_SIZES)) / _EXACT_SIZES) / F.ln(F.lit(1 / _BLOCK_THRESHOLD)))
    return F.when(n <= _EXACT_SIZES, n).otherwise(F.lit(_EXACT_SIZES) + step).cast("int")


def _least_size(size_class: Column) -> Column:
    """A lower bound of the sizes in a class."""
    grown = F.floor(F.lit(_EXACT_SIZES) * F.pow(F.lit(1 / _BLOCK_THRESHOLD), size_class - _EXACT_SIZES) - 0.000001)
    return F.when(size_class <= _EXACT_SIZES, size_class).otherwise(grown).cast("int")


def _key(*parts) -> Column:
    """A block key as 64 bits; a collision adds candidates and loses none."""
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def sketches(forms: DataFrame) -> DataFrame:
    """What scoring needs of a form, small: its identifier, and hashes in place of its strings.

    Two different elements of one pair of forms are taken for equal once in 2**64.
    """

    def hashed(values: str) -> Column:
        return F.transform(values, lambda v: F.xxhash64(v))

    def one(field: str) -> Column:
        return F.when(F.col(field) != "", F.xxhash64(F.col(field)))

    m, n = "form.m.", "form.n."
    feature = [F.coalesce(F.get(n + "features", F.lit(i)).cast("double"), F.lit(0.0)) for i in range(_FEATURES)]
    norm = F.lit(0.0)
    for f in feature:
        norm = norm + f * f
    return forms.select(
        "org_id", "dna_version", F.unhex("fp_id").alias("fid"),
        F.struct(
            hashed("form.i_set").alias("i"), hashed("form.d_set").alias("d"), hashed("form.p_set").alias("p"),
            hashed(n + "trigrams").alias("trigrams"), F.when(F.col(n + "tld").isNotNull(), F.xxhash64(n + "tld")).alias("tld"),
            F.size(n + "features").alias("features"), *[f.alias(f"f{i}") for i, f in enumerate(feature)], F.sqrt(norm).alias("norm"),
            hashed(m + "header_order").alias("order"), one(m + "header_order_hash").alias("order_hash"),
            one(m + "x_mailer").alias("mailer"), one(m + "message_id_template").alias("msgid"), one(m + "boundary_shape").alias("boundary"),
            F.col("form.c.simhash").alias("simhash"), hashed("form.c.template_markers").alias("markers"),
        ).alias("s"),
    )


#: Numbers that describe a domain's name; all fingerprints have as many, or none.
_FEATURES = 5


@dataclass(frozen=True)
class LinkIndex:
    """What block keys depend on besides a form: stored with the keys, the same for every batch.

    ``elements`` (org_id, locus, element, freq), ``trigrams`` (org_id, trigram, freq), ``large``
    (org_id, key, rows): the tooling blocks that are cut further. Elements that came later count as the
    rarest, and blocks that grew later stay whole, until the index is built anew.
    """

    elements: DataFrame
    trigrams: DataFrame
    large: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def link_index(sketched: DataFrame, refine_rows: int = REFINE_ROWS) -> LinkIndex:
    elements = _each_element(sketched).groupBy("org_id", "locus", "element").agg(F.count(F.lit(1)).alias("freq"))
    trigrams = sketched.select("org_id", F.explode("s.trigrams").alias("trigram")).groupBy("org_id", "trigram").agg(F.count(F.lit(1)).alias("freq"))
    sizes = tooling_keys(sketched).groupBy("org_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    stored = {"elements": elements, "trigrams": trigrams, "large": sizes.where(F.col("rows") > refine_rows)}
    return LinkIndex(**{name: durable_table(table, name) for name, table in stored.items()})


def _each_element(sketched: DataFrame) -> DataFrame:
    def of(k: str) -> Column:
        return F.transform(f"s.{k}", lambda e: F.struct(F.lit(k).alias("locus"), e.alias("element"), F.size(f"s.{k}").alias("n")))

    return sketched.select("org_id", "fid", F.explode(F.concat(of("i"), of("d"), of("p"))).alias("x")).select("org_id", "fid", "x.*")


def _elements(sketched: DataFrame, index: LinkIndex) -> DataFrame:
    """(org_id, fid, e): the elements of each form's sets, rarest first, as structs."""
    known = join_popular(_each_element(sketched), index.elements, ["org_id", "locus", "element"], "freq", how="left")
    # bounded: the elements of one message's fingerprint
    entry = F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "locus", "element", "n")
    return known.groupBy("org_id", "fid").agg(F.array_sort(F.collect_list(entry)).alias("e"))


def set_keys(elements: DataFrame, locus: str, threshold: float = _BLOCK_THRESHOLD) -> DataFrame:
    """Block keys of a set locus: rare prefixes for every size class of a partner.

    Sets of n and m elements with Jaccard of at least ``t`` share ``o = ceil(t / (1 + t) * (n + m))``
    elements, so both have one of them among their rarest ``n - o + 1``.
    """
    own = elements.select("org_id", "fid", F.filter("e", lambda e: e["locus"] == locus).alias("e")).where(F.size("e") > 0)
    n = F.size("e")
    low = _size_class(F.ceil(n * threshold - 0.000001))
    high = _size_class(F.floor(n / threshold + 0.000001))
    partners = own.withColumns({"n": n, "own": _size_class(n)}).withColumn("other", F.explode(F.sequence(low, high)))
    smallest = F.greatest(_least_size(F.col("other")), F.ceil(F.col("n") * threshold - 0.000001))
    common = F.ceil((F.col("n") + smallest) * (threshold / (1 + threshold)) - 0.000001)
    keep = F.greatest(F.least(F.col("n") - common + 1, F.col("n")), F.lit(1)).cast("int")
    return partners.select("org_id", "fid", "own", "other", F.explode(F.slice("e", F.lit(1), keep)).alias("x")).select(
        "org_id", "fid", _key(locus, F.least("own", "other"), F.greatest("own", "other"), F.col("x.element")).alias("key"),
    )


def tooling_keys(sketched: DataFrame) -> DataFrame:
    """Block keys of the tooling locus: (org_id, fid, kind, key).

    The header order alone gives at most 0.45, so a pair at 0.60 has equal mailers or equal
    Message-ID templates, or an equal boundary shape together with an equal header order.
    """
    s = {k: F.col(f"s.{k}") for k in ("mailer", "msgid", "boundary", "order_hash")}
    kinds = {"mailer": (s["mailer"],), "msgid": (s["msgid"],), "shape": (s["boundary"], s["order_hash"])}
    pairs = []
    for kind, parts in kinds.items():
        there = parts[0].isNotNull() if len(parts) == 1 else parts[0].isNotNull() & parts[1].isNotNull()
        pairs.append(F.when(there, F.struct(F.lit(kind).alias("kind"), _key(kind, *parts).alias("key"))))
    return sketched.select("org_id", "fid", F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("org_id", "fid", "x.kind", "x.key")


def _open_part(parts: list[str], order: float = 1.0) -> float:
    """What infrastructure, identity and payload must add when just these tooling parts agree."""
    w = fv.LOCUS_WEIGHTS
    tooling = order * fv.TOOLING_WEIGHTS["order"] + sum(fv.TOOLING_WEIGHTS[p] for p in parts)
    return fv.LINK_THRESHOLD - w["m"] * tooling - w["n"] - w["c"] - _SLACK


def _telling(elements: Column, least: float) -> Column:
    """The elements without the most frequent ones that together cannot add ``least``.

    Sharing one of a set's n elements adds at most a n-th of the locus weight. ``elements`` are
    rarest first: an element stays while the more frequent ones after it, with itself, reach ``least``.
    """
    share = F.transform(elements, lambda e: sum(
        (F.when(e["locus"] == k, F.lit(fv.LOCUS_WEIGHTS[k])).otherwise(0.0) for k in ("i", "d", "p")), F.lit(0.0)
    ) / e["n"])
    return F.filter(elements, lambda e, at: F.aggregate(
        F.slice(share, at + 1, F.greatest(F.size(share) - at, F.lit(0))), F.lit(0.0), lambda a, v: a + v
    ) >= least)


def refined_keys(large: DataFrame, sketched: DataFrame, elements: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Keys in place of those of large tooling blocks: tooling parts together with an element.

    ``large``: (org_id, fid, kind, key). A pair with equal mailers is left to the mailer's block, so the
    keys of the other kinds are for pairs without.
    """
    rows = large.join(sketched.select("org_id", "fid", "s.msgid", "s.boundary"), ["org_id", "fid"]).join(
        elements, ["org_id", "fid"], "left"
    ).withColumn("e", F.coalesce("e", F.array().cast(elements.schema["e"].dataType)))
    key, msgid, boundary = F.col("key"), F.col("msgid"), F.col("boundary")
    combinations = {
        "mailer": [("1", (), ["mailer"]), ("2", (msgid,), ["mailer", "msgid"]), ("3", (boundary,), ["mailer", "boundary"]),
                   ("4", (msgid, boundary), ["mailer", "msgid", "boundary"])],
        "msgid": [("1", (), ["msgid"]), ("3", (boundary,), ["msgid", "boundary"])],
        "shape": [("1", (), ["boundary"])],
    }
    none = F.array().cast("array<bigint>")

    def with_elements(number: str, parts: tuple, equal: list[str]) -> Column:
        return F.transform(_telling(F.col("e"), _open_part(equal)), lambda e: _key(number, key, *parts, e["locus"], e["element"]))

    keys = none
    for kind, choices in combinations.items():
        for number, parts, equal in choices:
            there = F.col("kind") == kind
            for part in parts:
                there = there & part.isNotNull()
            keys = F.concat(keys, F.when(there, with_elements(number, parts, equal)).otherwise(none))
    refined = rows.select("org_id", "fid", F.explode(keys).alias("key"))
    # all three parts equal and no element shared: naming has to make up for it
    alone = rows.where((F.col("kind") == "mailer") & msgid.isNotNull() & boundary.isNotNull())
    named = alone.join(trigrams, ["org_id", "fid"]).select("org_id", "fid", _key("5", key, msgid, boundary, F.col("trigram")).alias("key"))
    return refined.unionByName(named)


def _trigram_keys(sketched: DataFrame, index: LinkIndex) -> DataFrame:
    """(org_id, fid, trigram): rare prefixes for the overlap that naming needs when nothing else is shared."""
    w = fv.LOCUS_WEIGHTS
    naming = (fv.LINK_THRESHOLD - w["m"] - w["c"] - _SLACK) / w["n"]
    least = (naming - 0.6) / 0.4
    each = sketched.select("org_id", "fid", F.size("s.trigrams").alias("n"), F.explode("s.trigrams").alias("trigram"))
    known = join_popular(each, index.trigrams, ["org_id", "trigram"], "freq", how="left")
    # bounded: the trigrams of one domain label
    entry = F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "trigram")
    rare = known.groupBy("org_id", "fid", "n").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int")
    return rare.select("org_id", "fid", F.explode(F.slice("e", F.lit(1), keep)).alias("x")).select("org_id", "fid", "x.trigram")


def block_keys(sketched: DataFrame, index: LinkIndex) -> DataFrame:
    """(org_id, fid, key): the blocks each form belongs to. ``sketched`` should be stored."""
    elements = durable_table(_elements(sketched, index), "elements")
    large = join_popular(tooling_keys(sketched), index.large.withColumn("is_large", F.lit(True)), ["org_id", "key"], "rows", how="left")
    tooling = durable_table(large, "tooling_keys")
    whole = tooling.where("is_large IS NULL").select("org_id", "fid", "key")
    keys = set_keys(elements, "i").unionByName(set_keys(elements, "p")).unionByName(whole)
    cut = tooling.where("is_large").select("org_id", "fid", "kind", "key")
    if cut.limit(1).count():
        keys = keys.unionByName(refined_keys(cut, sketched, elements, _trigram_keys(sketched, index)))
    return keys.distinct()


def block_sides(
    sketched: DataFrame, keys: DataFrame, stored: DataFrame | None = None, stored_keys: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """The forms under each block they share, the blocks of each form, and the numbers of pairs to come in small and in ``tiled`` blocks.

    (org_id, fid, known, blocks): small blocks come first, then by key, and of blocks with the same forms there is
    one. The forms are the new ones and those they may meet. ``keys`` and the stored tables should be stored; of the
    stored forms only those in a block of a new one are read further.
    """
    on = ["org_id", "key"]
    every, forms = keys.withColumn("known", F.lit(False)), sketched
    if stored is not None:
        fresh = keys.select(*on).distinct()
        every = every.unionByName(stored_keys.select("org_id", "fid", "key").withColumn("known", F.lit(True)).join(fresh, on, "left_semi"))
        forms = sketched.unionByName(stored)
    every = durable_table(every, "block_keys")
    # two sets of forms are taken for equal once in 2**128
    forms_of = [F.bit_xor(F.xxhash64("fid", F.lit(n))).alias(f"forms{n}") for n in range(2)]
    sizes = every.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("known")).alias("new_rows"), *forms_of).where("rows > 1")
    count = F.col("new_rows") * F.col("rows")
    chunks = [F.ceil(F.col(rows) / chunk_rows).cast("int").alias(name) for rows, name in (("new_rows", "new_chunks"), ("rows", "chunks"))]
    shared = durable_table(
        sizes.groupBy("org_id", "rows", "new_rows", "forms0", "forms1").agg(F.min("key").alias("key"))
        .select(*on, "new_rows", "rows", *chunks, (count >= TILED_PAIRS).alias("tiled")),
        "block_sizes",
    )
    pairs = shared.agg(F.coalesce(F.sum(F.when(~F.col("tiled"), count)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("tiled"), count)), F.lit(0))).first()
    useful = join_popular(every, shared, on, "rows")
    # bounded: the blocks of one form
    per_form = durable_table(
        useful.groupBy("org_id", "fid", "known").agg(F.array_sort(F.collect_list(F.struct("tiled", "key", "new_chunks", "chunks"))).alias("blocks")), "form_blocks"
    )
    return forms, per_form, (int(pairs[0]), int(pairs[1]))


def _under_blocks(forms: DataFrame, per_form: DataFrame, tiled_: bool) -> DataFrame:
    """A row for each form and block, with the keys of the blocks before that one as ``earlier``."""
    there = per_form.where(F.exists("blocks", lambda b: b["tiled"] == F.lit(tiled_)))
    each = forms.join(there, ["org_id", "fid"]).select("org_id", "dna_version", "fid", "known", "s", "blocks", F.posexplode("blocks").alias("at", "b"))
    return each.where(F.col("b.tiled") == F.lit(tiled_)).select(
        "org_id", "dna_version", F.col("b.key").alias("key"), "fid", "known", "s",
        F.slice(F.transform("blocks", lambda b: b["key"]), F.lit(1), F.col("at")).alias("earlier"), "b",
    )


def _hex_links(links: DataFrame) -> DataFrame:
    return links.select(
        "org_id", F.lower(F.hex("a_fid")).alias("a_fp"), F.lower(F.hex("b_fid")).alias("b_fp"), "score", *[f"sim_{k}" for k in LOCI],
    )


def small_links(forms: DataFrame, per_form: DataFrame, pairs: int, strongest: int | None = None) -> DataFrame:
    """Links within the small blocks, as ``link_of`` has them; a block's rows lie one after another in a task."""
    on = ["org_id", "dna_version", "key"]
    tasks = max(4 * forms.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS_A_TASK)
    rows = _under_blocks(forms, per_form, False).drop("b").repartition(tasks, *on).sortWithinPartitions(*on)
    return rows.mapInArrow(small_block_links(strongest), LINK_SCHEMA)


def tiled(
    forms: DataFrame, per_form: DataFrame, pairs: int, strongest: int | None = None, half: bool = False, floors: DataFrame | None = None
) -> DataFrame:
    """Links within the large blocks, chunk against chunk; with ``strongest`` the decisive links alone.

    ``half``: no form is stored, so a pair of chunks is looked at once. ``floors`` (org_id, fid, floor): the score that a
    form's links reach already.
    """
    on = ["org_id", "dna_version", "key", "x", "y"]
    tasks = max(4 * forms.sparkSession.sparkContext.defaultParallelism, pairs // TILED_PAIRS_A_TASK)
    rows = _under_blocks(forms, per_form, True)
    if floors is not None:
        rows = rows.join(floors, ["org_id", "fid"], "left")

    def side(own: str, other: str, x: str, y: str) -> DataFrame:
        last = F.col(f"b.{other}") - 1
        at = rows.withColumn(x, F.pmod(F.xxhash64("fid"), F.col(f"b.{own}")).cast("int"))
        first, last = (F.lit(0), last) if not half else (F.col(x), last) if x == "x" else (F.lit(0), F.col(x))
        # both sides come from the same tables: new names for their columns
        columns = [F.col(c).alias(c) for c in (*on, "fid", "known", "s", "earlier", *(["floor"] if floors is not None else []))]
        return at.withColumn(y, F.explode(F.sequence(first, last))).select(*columns).repartition(tasks, *on)

    def links(key: tuple, left, right):
        return group_links(key, left, right, strongest, half)

    a, b = side("new_chunks", "chunks", "x", "y").where("NOT known"), side("chunks", "new_chunks", "y", "x")
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(links, LINK_SCHEMA)


def common_order(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays without repeats, at most 60 long.

    Bit-parallel: one addition for each element of ``a``.
    """
    def bit_at(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), n)

    full = bit_at(F.size(b)) - 1

    def step(v: Column, x: Column) -> Column:
        at = F.array_position(b, x).cast("int")
        bit = F.when(at > 0, bit_at(at - 1)).otherwise(F.lit(0).cast("long"))
        return (v + v.bitwiseAND(bit)).bitwiseOR(v.bitwiseAND(full.bitwiseXOR(bit))).bitwiseAND(full)

    return F.size(b) - F.bit_count(F.aggregate(a, full, step))


def form_links(
    forms: DataFrame, chunk_rows: int = CHUNK_ROWS, refine_rows: int = REFINE_ROWS, strongest: int | None = None
) -> DataFrame:
    """Accepted links between distinct forms: every unordered pair once, ``a_fp < b_fp``.

    With ``strongest`` only the links that decide, whose number does not grow with the square of a
    popular block: the first ``strongest`` links of every form (equal ones by the partner's first case, or
    by its form where ``strongest`` is 1) are among them, and they have the components of all links.
    """
    sketched = durable_table(sketches(forms), "sketches")
    keys = durable_table(block_keys(sketched, link_index(sketched, refine_rows)), "block_keys")
    if strongest is not None and strongest > 1:
        ties = forms.select("org_id", "dna_version", F.unhex("fp_id").alias("fid"), F.col("first_case").alias("tie"))
        sketched = durable_table(
            sketched.join(ties, ["org_id", "dna_version", "fid"]).withColumn("s", F.col("s").withField("tie", F.col("tie"))).drop("tie"), "tied_sketches"
        )
    return new_links(sketched, keys, chunk_rows=chunk_rows, strongest=strongest)


def new_links(
    sketched: DataFrame, keys: DataFrame, stored: DataFrame | None = None, stored_keys: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS,
    strongest: int | None = None,
) -> DataFrame:
    """Links of new forms among each other and with stored ones; no pair of stored forms is met.

    Forms come as ``sketches`` and their ``block_keys``, both of one ``LinkIndex``, and a form must not
    be new and stored.
    """
    forms, per_form, (few, many) = block_sides(sketched, keys, stored, stored_keys, chunk_rows)
    links = small_links(forms, per_form, few, strongest)
    if many:
        floors = None
        if strongest is not None:
            links = durable_table(links, "small_links")
            floors = link_floors(links, strongest)
        links = links.unionByName(tiled(forms, per_form, many, strongest, stored is None, floors))
    return _hex_links(links).withColumns({"a_fp": F.least("a_fp", "b_fp"), "b_fp": F.greatest("a_fp", "b_fp")})


def link_floors(links: DataFrame, strongest: int) -> DataFrame:
    """(org_id, fid, floor): the score of the ``strongest``-th link of each form that has as many."""
    ends = [links.select("org_id", F.col(side).alias("fid"), "score") for side in ("a_fid", "b_fid")]
    ranked = Window.partitionBy("org_id", "fid").orderBy(F.desc("score"))
    return ends[0].unionByName(ends[1]).withColumn("n", F.row_number().over(ranked)).where(F.col("n") == strongest).select(
        "org_id", "fid", F.col("score").alias("floor")
    )


def copy_links(forms: DataFrame) -> DataFrame:
    """Forms with copies whose copies link to each other, scored against themselves."""
    return forms.where("copies > 1").select(
        "org_id", F.col("fp_id").alias("a_fp"), F.col("fp_id").alias("b_fp"),
        F.inline(link_of(F.col("form"), F.col("form"))),
    )


def case_links(dna: DataFrame, links: DataFrame) -> DataFrame:
    """Links between cases, both directions, from links between forms (copies included).

    The result has one row per linked ordered pair, which is what it costs; campaigns and best
    links are computed from forms and never need it.
    """
    members = with_form_id(dna).select("org_id", "case_id", "fp_id")
    a = members.select("org_id", F.col("case_id").alias("case_id"), F.col("fp_id").alias("a_fp"))
    b = members.select("org_id", F.col("case_id").alias("other_case"), F.col("fp_id").alias("b_fp"))
    flipped = links.where("a_fp <> b_fp").select(
        "org_id", F.col("b_fp").alias("a_fp"), F.col("a_fp").alias("b_fp"), "score",
        *[f"sim_{k}" for k in LOCI],
    )
    return (
        links.unionByName(flipped)
        .join(a, ["org_id", "a_fp"])
        .join(b, ["org_id", "b_fp"])
        .where(F.col("case_id") != F.col("other_case"))
        .drop("a_fp", "b_fp")
    )


def linked_cases(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every linked pair of cases once: (org_id, a, b, score, sim_<locus>...), the smaller ``case_id`` in ``a``.

    ``members``: (org_id, fp_id, case_id, ...). ``a`` and ``b`` hold all that is there of a case, so nothing has
    to be looked up for a pair later. A small stored table of members is sent to the links, which then stay
    where they were found.
    """
    case = F.struct(*[name for name in members.columns if name not in ("org_id", "fp_id")])
    x = members.select("org_id", F.col("fp_id").alias("a_fp"), case.alias("x"))
    y = members.select("org_id", F.col("fp_id").alias("b_fp"), case.alias("y"))
    pairs = links.join(x, ["org_id", "a_fp"]).join(y, ["org_id", "b_fp"])
    in_order = F.col("x.case_id") < F.col("y.case_id")
    return pairs.where((F.col("a_fp") != F.col("b_fp")) | in_order).select(
        "org_id", F.when(in_order, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(in_order, F.col("y")).otherwise(F.col("x")).alias("b"),
        "score", *[f"sim_{k}" for k in LOCI],
    )


def shareable_values(indicators: DataFrame, idf: DataFrame) -> DataFrame:
    """(org_id, case_id, shareable): the discriminative values of a case that another case has too, sorted."""
    useful = idf.where(~F.col("is_hub") & (F.col("df") > 1)).select("org_id", "normalised")
    values = indicators.select("org_id", "case_id", "normalised").distinct().join(useful, ["org_id", "normalised"])
    # bounded: the indicators of one case
    return values.groupBy("org_id", "case_id").agg(F.sort_array(F.collect_list("normalised")).alias("shareable"))


def top_form_links(forms: DataFrame, links: DataFrame, dna: DataFrame, limit: int) -> DataFrame:
    """The strongest links of every case, ties by the other case: (org_id, case_id, other_case, link_rank, score, sim_...).

    ``links`` are form links (those of ``strongest=limit + 1`` are enough) and copy links together. The rank is taken between forms, where it is cut
    down before the shuffle, and a form stands for its first few cases; only what is kept is given out to
    cases, so nothing of the size of all linked pairs is made.
    """
    few = limit + 1  # a case is no partner of its own
    loci = [f"sim_{k}" for k in LOCI]
    both = links.select("org_id", F.col("a_fp").alias("fp_id"), F.col("b_fp").alias("partner"), "score", *loci).unionByName(
        links.where("a_fp <> b_fp").select("org_id", F.col("b_fp").alias("fp_id"), F.col("a_fp").alias("partner"), "score", *loci)
    )
    members = with_form_id(dna).select("org_id", "case_id", "fp_id")
    order = Window.partitionBy("org_id", "fp_id").orderBy("case_id")
    first = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= few)
    cases = durable_table(
        first.groupBy("org_id", F.col("fp_id").alias("partner")).agg(F.array_sort(F.collect_list("case_id")).alias("cases"), F.count(F.lit(1)).alias("n")),
        "first_cases",
    )
    first_case = forms.select("org_id", F.col("fp_id").alias("partner"), "first_case")
    strongest = Window.partitionBy("org_id", "fp_id").orderBy(F.desc("score"), "first_case")
    kept = both.join(first_case, ["org_id", "partner"]).withColumn("n", F.row_number().over(strongest)).where(F.col("n") <= few).drop("n", "first_case")
    options = kept.join(cases.drop("n"), ["org_id", "partner"]).select(
        "org_id", "fp_id", F.explode("cases").alias("other_case"), F.struct("score", *loci).alias("link")
    )
    # bounded: a few cases for each of a few forms
    best = options.groupBy("org_id", "fp_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("link.score")).alias("s"), "other_case", "link"))), 1, few).alias("best")
    )
    weights = forms.select("org_id", "fp_id", F.col("copies").alias("weight"))
    facts = durable_table(best.join(weights, ["org_id", "fp_id"]), "best_of_forms")
    own = join_popular(members, facts, ["org_id", "fp_id"], "weight").select(
        "org_id", "case_id", F.slice(F.filter("best", lambda x: x["other_case"] != F.col("case_id")), 1, limit).alias("best")
    )
    return own.select("org_id", "case_id", F.posexplode("best").alias("at", "x")).select(
        "org_id", "case_id", "x.other_case", (F.col("at") + 1).alias("link_rank"), "x.link.*"
    )


def top_member_links(members: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, links): the strongest link of every member as it enters its chain."""
    refs = cases.select(F.col("case_id").alias("partner_case"), F.col("case_ref").alias("partner_ref"))
    link = F.struct(F.col("partner_ref").alias("case_ref"), F.col("dna_score").alias("score"), F.col("locus_breakdown").alias("loci"))
    return members.join(refs, "partner_case").select("case_id", F.array(link).alias("links"))


def best_links(forms: DataFrame, links: DataFrame) -> DataFrame:
    """Strongest link of every form: score, loci and the first case of the partner.

    ``links`` are form links and copy links together. Aggregates before it shuffles, so a form
    with very many partners is no burden.
    """
    loci = F.struct(*[F.col(f"sim_{k}").alias(k) for k in LOCI])
    both = links.select(
        "org_id", F.col("a_fp").alias("fp_id"), F.col("b_fp").alias("partner"), "score",
        loci.alias("loci"),
    ).unionByName(
        links.where("a_fp <> b_fp").select(
            "org_id", F.col("b_fp").alias("fp_id"), F.col("a_fp").alias("partner"), "score",
            loci.alias("loci"),
        )
    )
    best = both.groupBy("org_id", "fp_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "partner", "loci")).alias("best")
    )
    partners = forms.select(
        "org_id", F.col("fp_id").alias("partner"), F.col("first_case").alias("partner_case")
    )
    return best.select(
        "org_id", "fp_id", (-F.col("best.s")).alias("dna_score"), "best.partner",
        F.col("best.loci").alias("locus_breakdown"),
    ).join(partners, ["org_id", "partner"])


def shared_indicators(
    pairs: DataFrame, indicators: DataFrame, idf: DataFrame
) -> DataFrame:
    """Discriminative values two linked cases share: their number and the values.

    Hub values are dropped before the join, so nothing is joined on them.
    """
    useful = idf.where(~F.col("is_hub")).select("org_id", "normalised")
    values = (
        indicators.select("org_id", "case_id", "normalised").distinct()
        .join(useful, ["org_id", "normalised"])
    )
    mine = pairs.select("org_id", "case_id", "other_case").join(values, ["org_id", "case_id"])
    theirs = values.select("org_id", F.col("case_id").alias("other_case"), "normalised")
    common = mine.join(theirs, ["org_id", "other_case", "normalised"], "left_semi")
    # bounded: the indicators of one case
    return common.groupBy("org_id", "case_id", "other_case").agg(
        F.count(F.lit(1)).alias("shared_count"),
        F.sort_array(F.collect_set("normalised")).alias("shared_indicators"),
    )


def link_reason(shared_count: Column) -> Column:
    """Sentence naming the dominant locus (first of equals) and the shared indicators."""
    top = F.greatest(*[F.col(f"sim_{k}") for k in LOCI])
    name = None
    for k in LOCI:
        cond = F.col(f"sim_{k}") == top
        name = F.when(cond, fv.LOCUS_REASONS[k]) if name is None else name.when(cond, fv.LOCUS_REASONS[k])
    count = F.coalesce(shared_count, F.lit(0))
    return F.concat(
        name,
        F.format_string(" (%.2f)", top),
        F.when(
            count > 0, F.format_string("; %d discriminative indicator(s) in common", count)
        ).otherwise(""),
    )
