"""Mixing sources to target weights by soft membership.

Built-in functions only. A naive Bayes classifier over hashed tokens, counted on the labelled table,
gives every document a posterior over quality domains. Projected gradient descent fits one nonnegative rate per document
so that the expected domain token totals (sum of rate * tokens * posterior) match the targets with as
little change from rate one as possible. Every step is one distributed sum over all documents; only
the domains' totals reach the driver, and a document's rate follows from the summed gradients, one
number a domain. With ``most`` (a greatest rate), the projection is onto [0, most] and the mixture is
as large as the first domain fills at rate one; targets out of reach are met as far as least squares
of the totals allow, which spares documents that are surely of the first domain.

Domains: ``toxic`` (labelled toxic), ``plain`` (labelled of low quality), ``good`` (the others).

Defined results: a null or empty text has no words, so its posterior is the prior, and zero tokens,
so it never moves a total; null ids join no label; several labels of one id count by the greatest
toxic and the least quality; without labels every document is ``good``; repeated rows have equal
rates; an empty table gives an empty result; other columns are kept where rows are mixed.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from relaytrail.llm.common import durable_table, text_of, wrapped
from relaytrail.llm.quality import bound, word_array

DOMAINS = ("good", "plain", "toxic")
#: Shares of the mixture's tokens.
TARGETS = {"good": 0.90, "plain": 0.07, "toxic": 0.03}
#: Labelled rows the classifier is fitted on (by a hash of their id); tokens chosen for each domain
#: and the likelihood ratio (G statistic) a token needs, far above that of chance.
MAX_FIT, TOKENS, LEAST_EVIDENCE = 20_000, 200, 25.0
#: Parts the chosen tokens are looked up in, by the remainder of the hash.
LOOKUP = 64
#: Log-odds are divided by this, as the tokens of a text are not independent.
TEMPERATURE = 1.0
#: Weights of the change of the rates, one round each; steps of a round at most, as fractions of a
#: Newton step; and the gradient, in shares of all tokens, at which a round ends.
CHANGES, STEPS, LENGTHS, TOLERANCE = (1e-1, 1e-3, 1e-5, 1e-6), 20, (1.0, 0.5, 0.2, 0.05, 0.01, 1e-3, 1e-5), 1e-6


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 2).when(quality < 1, 1).otherwise(0)


def token_hashes(lowered: Column, words: Column) -> Column:
    """Hashes of the words of a lower-cased text, of their beginnings, and of what is not a plain letter in them."""
    # the letters are taken out of the whole text; a word of letters only leaves nothing and counts once
    left = word_array(F.regexp_replace(lowered, "[a-z]+", ""))
    shapes = bound(left, lambda s: F.when(F.size(s) < F.size(words), F.concat(s, F.array(F.lit("")))).otherwise(s))
    return F.concat(
        F.transform(words, lambda w: F.xxhash64(w)),
        F.transform(words, lambda w: F.xxhash64(F.lit("begin"), F.substring(w, 1, 5))),
        F.transform(shapes, lambda s: F.xxhash64(F.lit("shape"), s)),
    )


def tokens_of(text: Column) -> Column:
    """The distinct token hashes of a text."""
    return bound(F.lower(text), lambda t: bound(word_array(t), lambda ws: F.array_distinct(token_hashes(t, ws))))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_fit: int) -> DataFrame:
    known = (
        labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg(domain_of(F.min("quality"), F.coalesce(F.max("toxic"), F.lit(0))).alias("domain"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    )
    # at most max_fit ids, so they are sent to the texts
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(known), "_id").select("text", "domain")


def likelihood_ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """G statistic of a token held by ``a`` of ``n_a`` and ``b`` of ``n_b`` documents."""

    def part(x: Column, n: int, share: Column) -> Column:
        return F.when((x > 0) & F.lit(n > 0), x * F.log(x / (share * n))).otherwise(0.0)

    share = (a + b) / max(1, n_a + n_b)
    return 2 * (part(a, n_a, share) + part(b, n_b, share) + part(n_a - a, n_a, 1 - share) + part(n_b - b, n_b, 1 - share))


def fit_weights(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT,
) -> tuple[list[float], dict[int, list[float]]]:
    """Logits of the domains without any chosen token, and what each adds against the first domain."""
    sample = durable_table(labelled(docs, labels, id_col, text_col, max_fit).select("domain", tokens_of(F.col("text")).alias("tokens")), "mixing_sample")
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    n, total = [sizes.get(k, 0) for k in range(len(DOMAINS))], sum(sizes.values())
    if not total:
        return [0.0] + [-50.0] * (len(DOMAINS) - 1), {}
    seen = sample.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(
        *[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS))]
    )
    held = [(F.col(f"n{k}") + 0.5) / (n[k] + 1) for k in range(len(DOMAINS))]
    odds, absent = [F.log(h / (1 - h)) for h in held], [F.log(1 - h) for h in held]
    chosen: dict[int, list[float]] = {}
    bias = [math.log((c + 1e-3) / total) for c in n]
    for k in range(1, len(DOMAINS)):
        evidence = likelihood_ratio(F.col(f"n{k}"), F.col("n0"), n[k], n[0])
        best = seen.withColumn("g", evidence).filter(F.col("g") >= LEAST_EVIDENCE).orderBy(F.desc("g"), "token").limit(TOKENS)
        others = range(1, len(DOMAINS))
        for r in best.select("token", *[(odds[j] - odds[0]).alias(f"w{j}") for j in others], *[(absent[j] - absent[0]).alias(f"b{j}") for j in others]).collect():
            if r["token"] not in chosen:
                chosen[r["token"]] = [r[f"w{j}"] for j in others]
                for j in others:  # what the token's absence says; its presence takes that back
                    bias[j] += r[f"b{j}"]
    return bias, chosen


def _posterior(lowered: Column, words: Column, bias: list[float], weights: dict[int, list[float]]) -> Column:
    d = range(1, len(DOMAINS))
    none = F.struct(*[F.lit(0.0).alias(f"d{k}") for k in d])
    sums = none
    if weights:
        tokens = sorted(weights, key=lambda t: (t % LOOKUP, t))
        listed = F.expr("array(" + ", ".join(f"{t}L" if t > -(1 << 63) else "(-9223372036854775807L - 1L)" for t in tokens) + ")")
        tables = [F.expr("array(" + ", ".join(f"{weights[t][k - 1]!r}D" for t in tokens) + ")") for k in d]
        sizes = np.bincount([t % LOOKUP for t in tokens], minlength=LOOKUP)
        starts, sizes = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (sizes.cumsum() - sizes, sizes))

        def add(total: Column, token: Column) -> Column:
            part = F.pmod(token, F.lit(LOOKUP)).cast("int")
            start = F.get(starts, part)
            at = start + F.array_position(F.slice(listed, start + 1, F.get(sizes, part)), token).cast("int") - 1
            return bound(at, lambda i: F.struct(*[(total[f"d{k}"] + F.get(t, i)).alias(f"d{k}") for k, t in zip(d, tables)]))

        # a text holds few of the chosen tokens; only those are looked up, each once
        hits = F.array_intersect(token_hashes(lowered, words), listed)
        sums = F.when(F.get(words, F.lit(0)) == "", none).otherwise(F.aggregate(hits, none, add))

    def shares(total: Column) -> Column:
        logits = [F.lit(bias[0])] + [F.lit(bias[k]) + total[f"d{k}"] / TEMPERATURE for k in d]
        top = F.greatest(*logits)
        powers = [F.exp(x - top) for x in logits]
        whole = reduce(lambda a, b: a + b, powers)
        return F.array(*[p / whole for p in powers])

    return bound(sums, shares)


def weighed(text: Column, bias: list[float], weights: dict[int, list[float]]) -> Column:
    """(tokens, posterior): the number of words of a text and the domains' posteriors, from one split of it."""

    def of(lowered: Column, words: Column) -> Column:
        n = F.when(F.get(words, F.lit(0)) == "", 0).otherwise(F.size(words)).cast("long")
        return F.struct(n.alias("tokens"), _posterior(lowered, words, bias, weights).alias("posterior"))

    return bound(F.lower(text), lambda t: bound(word_array(t), lambda ws: of(t, ws)))


def posteriors(text: Column, bias: list[float], weights: dict[int, list[float]]) -> Column:
    """Array of the domains' posteriors of a text."""
    return weighed(text, bias, weights)["posterior"]


def rate_of(posterior: Column, pull: list[float], most: float | None = None) -> Column:
    """The document's rate: one, less what the summed gradient takes along its posterior, projected."""
    moved = F.lit(1.0) - _along(posterior, pull)
    return F.greatest(F.lit(0.0), moved if most is None else F.least(F.lit(float(most)), moved))


def _along(posterior: Column, pull: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [posterior[k] * float(pull[k]) for k in range(len(DOMAINS))])


def _sums(members: DataFrame, pulls: list[list[float]], most: float | None) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(token totals, curvature, potential) of the rates under each pull: one pass over the documents.

    The pulls are one array of constants, so that every pass runs the same generated code.
    """
    d = range(len(DOMAINS))
    listed = ", ".join(f"struct({n} AS n, " + ", ".join(f"{float(g)!r}D AS g{k}" for k, g in enumerate(pull)) + ")" for n, pull in enumerate(pulls))
    rows = members.select("tokens", "posterior", F.expr(f"inline(array({listed}))"))
    x = reduce(lambda a, b: a + b, [F.col("posterior")[k] * F.col(f"g{k}") for k in d])
    at = rows.select("n", "tokens", *[F.col("posterior")[k].alias(f"p{k}") for k in d], x.alias("x"))
    rest = 1.0 - F.col("x")  # the rate before its projection
    rate = F.greatest(F.lit(0.0), rest if most is None else F.least(F.lit(float(most)), rest))
    free = (rest > 0) if most is None else (rest > 0) & (rest <= most)
    area = F.when(rest > 0, rest * rest / 2 if most is None else F.when(rest > most, most * (rest - most / 2)).otherwise(rest * rest / 2)).otherwise(0.0)
    totals = at.withColumns({"moved": F.col("tokens") * rate, "held": F.when(free, F.col("tokens")).otherwise(0.0), "area": F.col("tokens") * area})
    sums = totals.groupBy("n").agg(
        *[F.sum(F.col("moved") * F.col(f"p{k}")).alias(f"s{k}") for k in d],
        *[F.sum(F.col("held") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}{j}") for i in d for j in d if i <= j], F.sum("area").alias("v"),
    )
    found = {r["n"]: r for r in sums.collect()}  # a row for each pull
    return [
        (np.array([r[f"s{k}"] for k in d]), np.array([[r[f"m{min(i, j)}{max(i, j)}"] for j in d] for i in d]), r["v"])
        for r in (found[n] for n in range(len(pulls)))
    ]


def fit_rates(members: DataFrame, targets: dict[str, float], most: float | None = None, keep_first: bool = False) -> list[float]:
    """The summed gradient (a number for each domain) whose projection gives the fitted rates of (tokens, posterior) rows.

    Least squares of the domains' token totals less their targets, over rates in [0, ``most``], by
    projected gradient steps with the projection taken last: a rate is the projection of one less the
    sum of all gradients, so the state is one number a domain. A small weight on the squared change of
    the rates makes the answer unique, the least change that reaches the optimum; it shrinks from round
    to round. A step is scaled by the inverse curvature of the documents whose rate is free to move, and
    the longest of ``LENGTHS`` that lowers the (convex) dual potential enough is taken, all of them
    evaluated in one pass; a round ends when its gradient is gone.
    """
    d = range(len(DOMAINS))
    share = np.array([targets[k] / sum(targets.values()) for k in DOMAINS])
    sizes = members.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col("posterior")[k]).alias(f"s{k}") for k in d]).first()
    if not sizes["tokens"]:
        return [0.0] * len(DOMAINS)
    total = float(sizes["tokens"])
    goal = share * (sizes["s0"] / total / share[0] if keep_first and share[0] > 0 else 1.0)
    pull = np.zeros(len(DOMAINS))

    def at(pulls: list[np.ndarray], change: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(potential, its gradient, its curvature) for each pull, in shares of all tokens."""
        return [
            (
                change / 2 * float(x @ x) + float(goal @ x) + v / total,
                change * x + goal - s / total, change * np.eye(len(DOMAINS)) + m / total,
            )
            for x, (s, m, v) in zip(pulls, _sums(members, [list(x) for x in pulls], most))
        ]

    before = None
    for change in CHANGES:
        # out of reach, the pull grows as its weight shrinks
        starts = [pull] if before is None else [pull, pull * (before / change) ** 0.5, pull * (before / change)]
        starts += [starts[-1]] * (len(LENGTHS) - len(starts))
        pull, (value, slope, curve) = min(zip(starts, at(starts, change)), key=lambda y: y[1][0])
        before = change
        for _ in range(STEPS):
            if np.abs(slope).max() <= TOLERANCE:
                break
            step = np.linalg.solve(curve + 1e-12 * np.eye(len(DOMAINS)), -slope)
            tried = [pull + length * step for length in LENGTHS]
            lower = [
                (x, f) for x, f, length in zip(tried, at(tried, change), LENGTHS) if f[0] <= value + 1e-4 * length * float(slope @ step)
            ]
            if not lower:
                break  # rounding is all that is left
            pull, (value, slope, curve) = min(lower, key=lambda y: y[1][0])
    return [float(x) for x in pull]


def copies_of(rate: Column, row_key: Column) -> Column:
    """Whole copies of a document: its rate rounded by a hash of the row, equal in expectation."""
    chance = F.pmod(row_key, F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """(doc_id, text_hash, tokens, posterior, rate, copies) of every row."""
    bias, weights = fit_weights(docs, labels, id_col, text_col)
    text = text_of(text_col)
    members = durable_table(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), weighed(text, bias, weights).alias("of"),
        ).select("doc_id", "text_hash", "of.tokens", "of.posterior"),
        "mixing_members",
    )
    rate = rate_of(F.col("posterior"), fit_rates(members, targets or TARGETS, most, keep_first=most is not None), most)
    rated = members.withColumn("rate", rate)
    return rated.withColumn("copies", copies_of(F.col("rate"), F.xxhash64("doc_id", "text_hash")))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """Every row of ``docs`` as often as its copies say, with all its columns."""
    rated = mixing_rates(docs, labels, id_col, text_col, targets, most).select("doc_id", "text_hash", "copies").distinct()
    rows = wrapped(docs, id=F.col(id_col).cast("long"), hash=F.xxhash64(text_of(text_col)))
    joined = rows.join(rated, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).filter("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
