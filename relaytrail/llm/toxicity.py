"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a learned lexicon (words and word beginnings over-represented in toxic
training documents), hits near second-person words, capitals, punctuation, and obfuscated spellings
(a hit only after undoing digit and symbol substitutions). The lexicon, the trees and the
calibration are cross-fitted on a sample of at most ``MAX_FIT`` labelled rows that are not held out;
every document is then scored from its whole text.

Defined results: null and empty texts have all-zero features and get the score of those; a null id
counts as the empty string for the hold-out rule and joins no label; several labels of one id count
as toxic if one of them is; without both classes among the labels the score is the share of toxic
ones (0 without labels); repeated rows score equally; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relaytrail.llm.common import durable_table, out_batches, small_batches, text_of

#: Bound of the labelled rows the model is fitted on, by the order of a hash of their id.
MAX_FIT = 12_000
#: Entries of the lexicon, documents an entry needs, and its least log-odds.
MAX_LEXICON, MIN_TOXIC, MIN_ODDS = 2_000, 4, 2.0
#: Parts of the sample for features and calibration that did not see their own rows.
PARTS = 4
PREFIXES = (4, 5, 6)
ROUNDS, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 10
FOLDS = 5

# fixed values: second-person words
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
_PLAIN = str.maketrans("0134578@$!|+", "oieastbasiit")
_EDGE = re.compile(r"^\W+|\W+$")
_OBFUSCATED = re.compile(r"[^\W\d_][\d@$!*|+]+[^\W\d_]")
_TOUCHING = 5

FEATURES = (
    "log_words", "hits", "hit_density", "odds_sum", "odds_density", "odds_max", "near_second_person", "second_person_density",
    "capital_share", "capital_words", "punctuation_share", "exclamation_share", "digit_share", "obfuscated_density", "hidden_hits",
)


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a lower-case word: itself and its beginnings."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def cleaned(word: str) -> str:
    return _EDGE.sub("", word.lower())


class WordWeights(dict):
    """Weight of a raw word and whether it needed its substitutions undone; bounded memo."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> tuple[float, bool, bool]:
        word = cleaned(raw)
        weight = max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0)
        hidden = False
        if not weight and _OBFUSCATED.search(raw):
            plain = _EDGE.sub("", raw.lower().translate(_PLAIN))
            weight = max((self.lexicon.get(k, 0.0) for k in keys_of(plain)), default=0.0)
            hidden = weight > 0
        if len(self) > 300_000:
            self.clear()
        found = self[raw] = (weight, hidden, word in SECOND_PERSON)
        return found


def dense_features(text: str | None, weights: WordWeights) -> list[float]:
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    found = [(i, v) for i, v in enumerate(map(weights.__getitem__, words)) if v[0] or v[2]]
    hits = [(i, v[0]) for i, v in found if v[0]]
    second = [i for i, v in found if v[2]]
    near = 0
    if second and hits:
        at = np.array(second)
        where = np.array([i for i, _ in hits])
        right = np.searchsorted(at, where)
        gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - where), np.abs(at[np.maximum(right - 1, 0)] - where))
        near = int((gap <= _TOUCHING).sum())
    odds = sum(w for _, w in hits)
    letters = sum(map(text.count, ".,;:!?"))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return [
        float(np.log1p(n)), len(hits), len(hits) / n, odds, odds / n, max((w for _, w in hits), default=0.0), near, len(second) / n,
        upper / chars, sum(map(str.isupper, words)) / n, letters / chars, text.count("!") / chars,
        len(re.findall(r"[0-9]", text)) / chars, len(_OBFUSCATED.findall(text)) / n, sum(v[1] for _, v in found),
    ]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, toxic documents, other documents) of the lexicon keys of this partition."""
    counts: defaultdict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
    memo: dict[str, list[str]] = {}
    for batch in batches:
        for text, toxic, part in zip(*(c.to_pylist() for c in batch.columns)):
            keys = set()
            for raw in set((text or "").split()):
                if raw not in memo:
                    memo[raw] = keys_of(cleaned(raw))
                keys.update(memo[raw])
            for key in keys:
                counts[key, part][0 if toxic else 1] += 1
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("toxic", pa.int64()), ("other", pa.int64())])
    yield from out_batches(((k, p, a, b) for (k, p), (a, b) in counts.items() if k), schema)


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss, in numpy."""

    def __init__(self) -> None:
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.edges = [np.unique(np.r_[e, c.min()]) for e, c in zip(self.edges, x.T)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            tree, leaf = self._grow(binned, grad, hess)
            self.trees.append(tree)
            margin += leaf
        return self

    def _grow(self, binned, grad, hess):
        leaf = np.zeros(len(grad))

        def node(rows, depth):
            g, h = grad[rows].sum(), hess[rows].sum()
            value = RATE * g / (h + 1.0)
            best = (1e-3, None, None)
            if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                for f in range(binned.shape[1]):
                    b = binned[rows, f]
                    size = len(self.edges[f]) + 1
                    gs, hs = np.bincount(b, grad[rows], size).cumsum(), np.bincount(b, hess[rows], size).cumsum()
                    ns = np.bincount(b, minlength=size).cumsum()
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = 0
                    at = int(gain.argmax())
                    if gain[at] > best[0] and at < len(self.edges[f]):
                        best = (gain[at], f, at)
            if best[1] is None:
                leaf[rows] = value
                return value
            _, f, at = best
            left = binned[rows, f] <= at
            return f, float(self.edges[f][at]), node(rows[left], depth + 1), node(rows[~left], depth + 1)

        return node(np.arange(len(grad)), 0), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows, out):
            if not isinstance(tree, tuple):
                out[rows] += tree
                return
            f, edge, left, right = tree
            low = x[rows, f] <= edge
            walk(left, rows[low], out)
            walk(right, rows[~low], out)

        out = np.full(len(x), self.base)
        for tree in self.trees:
            walk(tree, np.arange(len(x)), out)
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, values), values never falling; smoothed by half a row each way."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first margin, last margin
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    knots, values = [], []
    for s, w, first, last in blocks:
        value = (s + 0.5 * len(y) ** -0.5) / (w + len(y) ** -0.5)
        knots += [first, last] if last > first else [first]
        values += [value] * (2 if last > first else 1)
    return np.array(knots), np.maximum.accumulate(np.array(values))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.constant)
        margin = self.trees.margin(x)
        calibrated = np.interp(margin, self.knots, self.values)
        # isotonic steps are flat: a small share of the plain score keeps their order strict
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-margin)), 0, 1)


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> Model:
    """Fit on at most ``max_fit`` labelled rows outside the held-out fold.

    The sample has ``PARTS`` parts. Features of a part come from the other parts' lexicon, and the
    calibration from margins of trees that did not see the part; the final lexicon and trees use all.
    """
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold_of(id_col) != 0))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_fit)
    )
    # at most max_fit ids, so they are sent to the texts
    sample = durable_table(
        docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(known), "_id")
        .select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(PARTS)).cast("int").alias("part")),
        "toxicity_sample",
    )
    sizes = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    n = {t: np.array([sum(c for (p, x), c in sizes.items() if p == q and bool(x) == t) for q in range(PARTS)]) for t in (True, False)}
    total = int(n[True].sum() + n[False].sum())
    if not n[True].sum() or not n[False].sum():
        return Model({}, None, np.zeros(1), np.zeros(1), float(n[True].sum() / total) if total else 0.0)
    lexicons = lexicon_of(sample, n)
    got = featured(sample, lexicons).collect()  # at most max_fit rows of len(FEATURES) numbers
    got.sort(key=lambda r: (r["part"], r["features"]))
    x, y = np.array([r["features"] for r in got]), np.array([float(bool(r["toxic"])) for r in got])
    part = np.array([r["part"] for r in got])
    margin = np.zeros(len(y))
    for q in np.unique(part):
        margin[part == q] = Trees().fit(x[part != q], y[part != q]).margin(x[part == q]) if (part != q).any() else 0
    knots, values = isotonic(margin, y)
    return Model(lexicons[PARTS], Trees().fit(x, y), knots, values, float(y.mean()))


def lexicon_of(sample: DataFrame, n: dict[bool, np.ndarray]) -> list[dict[str, float]]:
    """The lexicon without each part, and last the one of all parts: bounded by ``MAX_LEXICON``."""
    counted = sample.select("text", "toxic", "part").mapInArrow(_word_counts, "key string, part int, toxic long, other long")
    sums = [F.sum(F.when(F.col("part") == q, F.col(c)).otherwise(0)).alias(f"{c}{q}") for c in ("toxic", "other") for q in range(PARTS)]
    odds = F.log((F.col("toxic") + 0.5) / int(n[True].sum() + 1)) - F.log((F.col("other") + 0.5) / int(n[False].sum() + 1))
    entries = (
        counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *sums)
        .filter(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
        .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "key").limit(MAX_LEXICON).collect()
    )
    lexicons: list[dict[str, float]] = []
    for q in range(PARTS + 1):
        own = lambda r, c: r[f"{c}{q}"] if q < PARTS else 0  # noqa: E731, B023
        t = n[True].sum() - (n[True][q] if q < PARTS else 0)
        o = n[False].sum() - (n[False][q] if q < PARTS else 0)
        found = {}
        for r in entries:
            seen = r["toxic"] - own(r, "toxic")
            weight = np.log((seen + 0.5) / (t + 1)) - np.log((r["other"] - own(r, "other") + 0.5) / (o + 1))
            if seen >= MIN_TOXIC - 1 and weight >= MIN_ODDS:
                found[r["key"]] = float(weight)
        lexicons.append(found)
    return lexicons


def featured(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """(toxic, part, features) of each row of the sample, by the lexicon that did not see its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [WordWeights(x) for x in lexicons]
        for batch in batches:
            got = [dense_features(t, weights[p]) for t, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(got, pa.list_(pa.float64()))], ["toxic", "part", "features"]
            )

    return rows.select("text", "toxic", "part").mapInArrow(run, "toxic int, part int, features array<double>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = WordWeights(model.lexicon)
        for batch in batches:
            x = np.array([dense_features(t, weights) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")


