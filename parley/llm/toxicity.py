"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Learning takes a bounded sample of labelled documents, drawn by a hash of the id so that each class has about
``PER_CLASS`` rows; weights restore the classes' true shares. A lexicon is counted over the sample on the executors: words
and word beginnings that stand far more often in toxic documents. Features are densities: lexicon hits and their
strength, hits near a second-person word, hits that appear only once disguise is undone (digits for letters, signs
between letters), capitals, punctuation, repeats. Trees are grown by histograms. Learning is crossed: the sample has ``PARTS``
parts, the features of a part come from a lexicon counted over the others, and the isotonic curve that turns margins into
probabilities is fitted to margins that trees of the other parts give. So no row judges itself, and every row serves both the
trees and the curve. Scoring is one pass over the rows, without a shuffle.

Defined results: a null text counts as empty; an empty text has a score like any other; a label of null is no label; a
document with several labels is toxic if one of them says so; without labels of both classes every score is the share of
toxic labels (0 without labels). Repeated rows get equal scores. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Scratch, fold, packed, pick, restored, share

#: Labelled rows of each class that learning takes at most, on average.
PER_CLASS = 6_000
#: Entries of the lexicon, documents an entry must stand in, and how much likelier in toxic ones.
LEXICON, LEAST_DOCS, LEAST_RATIO = 4_000, 3, 8.0
#: Parts of the sample that lexicon, trees and curve are crossed over.
PARTS = 8
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5, 6)
HEAD = min(STEMS)
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT = 60, 3, 0.2, 32, 8.0
#: Second-person words of the languages at hand.
YOU = frozenset("you your yours yourself u ur ya tu te ton ta tes toi vous votre du dich dir dein deine ihr euch usted ustedes vosotros os".split())
#: Signs that stand for letters.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "+": "t"})
NEAR = 4
#: Signs around a word that are no part of it; behind it, also those that may stand for a first letter.
EDGES = ".,;:!?\"'()[]{}<>«»„“”¿¡…#%&*|~^=+/\\_-"
ENDS = EDGES + "$@"
FEATURES = ("words", "hit_density", "hits", "strength", "strongest", "stem_density", "stem_hits", "stem_strength", "you_density", "near_you", "disguised", "capitals", "all_caps", "exclaims", "asks", "punctuation", "repeats", "digits")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHOUT = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")
DIGIT = re.compile(r"[0-9]")
MARK_RUN = re.compile(r"[!?]{2,}")


def units(text: str) -> set[str]:
    """What may enter the lexicon: words as they stand, and marked beginnings of longer words."""
    out = set()
    for word in text.lower().split():
        word = word.rstrip(ENDS).lstrip(EDGES)
        if 2 < len(word) <= 40 and not any(c.isdigit() for c in word):
            out.add(word)
            out.update(word[:n] + "~" for n in STEMS if len(word) > n)
    return out


def features(text: str, words: dict[str, float], stems: dict[str, float], heads: set[str]) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES. heads: the first letters of all stems."""
    tokens = text.lower().split()
    bare = [t.rstrip(ENDS).lstrip(EDGES) for t in tokens]
    different = set(bare)
    hit = {w: words[w] for w in different & words.keys()}
    begun = {}
    for w in [w for w in different if w[:HEAD] in heads and w not in hit]:
        if (strength := max((stems.get(w[:k] + "~", 0.0) for k in STEMS if len(w) > k), default=0.0)) > 0:
            begun[w] = strength
    hidden = {}
    for w in [w for w in different if not w.isalpha()]:
        undone = w.translate(PLAIN)
        if len(undone) > 2 and undone != w and undone in words:
            hidden[w] = words[undone]
    you = different & YOU
    n = max(1, len(tokens))
    hits: list[tuple[int, float]] = []
    stem_hits: list[float] = []
    addressed: list[int] = []
    disguised = 0
    if hit or begun or hidden:
        for i, w in enumerate(bare):
            if w in hit:
                hits.append((i, hit[w]))
            elif w in begun:
                stem_hits.append(begun[w])
            elif w in hidden:
                disguised += 1
                hits.append((i, hidden[w]))
            elif w in you:
                addressed.append(i)
    # single letters in a row: a word spelled out
    singles = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(singles) > 2:
        run = [singles[0]]
        for i in [*singles[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) > 2 and (w := words.get("".join(tokens[j] for j in run))) is not None:
                disguised += 1
                hits.append((run[-1], w))
            run = [i]
        hits.sort()
    at = near = 0
    for i, _ in hits:
        while at < len(addressed) and addressed[at] < i - NEAR:
            at += 1
        near += at < len(addressed) and abs(addressed[at] - i) <= NEAR
    chars = max(1, len(text))
    return [
        math.log1p(len(tokens)), 1000 * len(hits) / n, math.log1p(len(hits)), math.log1p(sum(w for _, w in hits)), max((w for _, w in hits), default=0.0),
        1000 * len(stem_hits) / n, math.log1p(len(stem_hits)), math.log1p(sum(stem_hits)), 1000 * len(addressed) / n, math.log1p(near), 1000 * disguised / n,
        len(CAPITAL.findall(text)) / chars, len(SHOUT.findall(text)) / n, 1000 * text.count("!") / chars, 1000 * text.count("?") / chars,
        1000 * (text.count(",") + text.count(".") + text.count(";") + text.count(":")) / chars, len(MARK_RUN.findall(text)) / n, len(DIGIT.findall(text)) / chars,
    ]


@dataclass
class Tree:
    """A tree of fixed depth as arrays: feature and cut of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.value[node - (2**DEPTH - 1)]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: The calibration curve; without trees it is one constant.
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    heights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.margin(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, texts) -> np.ndarray:
        if not self.trees:
            return np.full(len(texts), float(self.heights[0]))
        heads = {s[:HEAD] for s in self.stems}
        x = np.array([features(t, self.words, self.stems, heads) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return np.interp(self.margins(x), self.knots, self.heights)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[Tree]]:
    """Boosted trees for the logistic loss, splits from histograms of quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [np.unique(np.append(c, v[v > v.min()].min() / 2 + v.min() / 2)) if len(v := np.unique(col)) > 1 else c for c, col in zip(cuts, x.T, strict=True)]
    width = max(map(len, cuts)) + 1
    binned = np.column_stack([np.searchsorted(c, col) for c, col in zip(cuts, x.T, strict=True)])
    share_of_one = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4))
    start = math.log(share_of_one / (1 - share_of_one))
    margin = np.full(len(y), start)
    trees = []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            slot = node - first
            best = np.full(n, 1e-6)
            for f in range(x.shape[1]):
                key = slot * width + binned[:, f]
                gs, hs, ws = (np.bincount(key, v, n * width).reshape(n, width).cumsum(axis=1) for v in (g, h, weight))
                total_g, total_h, total_w = gs[:, -1:], hs[:, -1:], ws[:, -1:]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ws < LEAST_WEIGHT) | (total_w - ws < LEAST_WEIGHT)] = 0
                gain[:, len(cuts[f]) :] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(n), at] > best
                best = np.where(better, gain[np.arange(n), at], best)
                for i in np.flatnonzero(better):
                    feature[first + i], cut[first + i] = f, cuts[f][at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        tree = Tree(feature, cut, -RATE * gs / (hs + 1))
        margin = margin + tree.value[leaf]
        trees.append(tree)
    return start, trees


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve that fits y best, by pooling neighbours that fall."""
    places, at = np.unique(x, return_inverse=True)  # equal margins share a value
    pools: list[list[float]] = []  # [sum of y, weight, first x, last x]
    for a, total, w in zip(places, np.bincount(at, y * weight), np.bincount(at, weight), strict=True):
        pools.append([total, w, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, w, _, last = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += w
            pools[-1][3] = last
    knots = [v for p in pools for v in (p[2], p[3])]
    heights = [v for p in pools for v in (p[0] / p[1],) * 2]
    return np.array(knots), np.array(heights)


Lexicon = tuple[dict[str, float], dict[str, float]]


def _unit_counts(sample: DataFrame) -> DataFrame:
    """Documents with a unit, clean and toxic ones, in each part of the sample."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, part, t) for text, part, t in zip(batch["text"], batch["part"], batch["toxic"], strict=True) for u in units(text)]
            got = pd.DataFrame(rows, columns=["unit", "part", "toxic"])
            yield got.groupby(["unit", "part"])["toxic"].agg(n="count", p="sum").reset_index()

    counts = sample.mapInPandas(spread, "unit string, part int, n long, p long")

    def held(value: Column, part: int) -> Column:
        return F.sum(F.when(F.col("part") == part, value).otherwise(0))

    sums = [held(value, k).alias(f"{name}{k}") for name, value in (("p", F.col("p")), ("q", F.col("n") - F.col("p"))) for k in range(PARTS)]
    return counts.groupBy("unit").agg(*sums)


def _lexicon(counts: DataFrame, parts: list[int], n_toxic: int, n_clean: int) -> Lexicon:
    """Strengths of words and of word beginnings, by their counts in some parts; at most LEXICON of them."""
    p, q = (sum((F.col(f"{name}{k}") for k in parts), F.lit(0)) for name in "pq")
    ratio = ((F.col("p") + 0.5) / (n_toxic + 1)) / ((F.col("q") + 0.5) / (n_clean + 1))
    likelier = counts.select("unit", p.alias("p"), q.alias("q")).where(F.col("p") >= LEAST_DOCS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    rows = likelier.orderBy((F.col("p") * F.log("ratio")).desc(), "unit").limit(LEXICON).collect()
    found = {r.unit: math.log(r.ratio) for r in rows}
    return {k: v for k, v in found.items() if not k.endswith("~")}, {k: v for k, v in found.items() if k.endswith("~")}


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from the labelled documents given. Ids select and join rows only; they are no feature."""
    marked = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    n = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(heights=np.array([n_toxic / max(1, n_toxic + n_clean)]))
    rate = F.when(F.col("toxic") == 1, min(1.0, per_class / n_toxic)).otherwise(min(1.0, per_class / n_clean))
    chosen = marked.where(share("doc_id", seed="toxicity") < rate)  # about 2 * per_class ids, whatever the input: fit to broadcast
    texts = pick(documents, "doc_id", "text").where("doc_id IS NOT NULL")
    scratch = Scratch(documents.sparkSession)
    part = F.floor(share("doc_id", seed="calibrate") * PARTS).cast("int").alias("part")
    sample = scratch.stage(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", part))
    size = np.zeros((2, PARTS), np.int64)
    for r in sample.groupBy("toxic", "part").count().collect():
        size[r.toxic, r.part] = r["count"]
    clean, toxic = size.sum(axis=1)
    if not clean or not toxic:
        return Model(heights=np.array([n_toxic / (n_toxic + n_clean)]))
    every = list(range(PARTS))
    others = [[j for j in every if j != k] for k in every]
    crossed = all(size[:, o].sum(axis=1).all() for o in others)  # both classes are met without any part
    counts = scratch.stage(_unit_counts(sample))

    def lexicon(parts: list[int]) -> Lexicon:
        return _lexicon(counts, parts, int(size[1, parts].sum()), int(size[0, parts].sum()))

    words, stems = lexicon(every)
    used = [lexicon(o) for o in others] if crossed else [(words, stems)] * PARTS
    known = [(*u, {s[:HEAD] for s in u[1]}) for u in used]

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t, *known[k]) for t, k in zip(batch["text"], batch["part"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "part": batch["part"], "x": x})

    rows = sample.mapInPandas(dense, "doc_id long, toxic int, part int, x array<double>").orderBy("doc_id", "x").toPandas()
    scratch.clear()
    x, y, at = np.stack(rows["x"]), rows["toxic"].to_numpy(np.float64), rows["part"].to_numpy()
    weight = np.where(y == 1, n_toxic / toxic, n_clean / clean)
    weight *= len(y) / weight.sum()
    model = Model(words, stems, *grow(x, y, weight))
    margins = model.margins(x)
    if crossed:
        for k in np.unique(at):
            rest = at != k
            margins[~rest] = Model({}, {}, *grow(x[rest], y[rest], weight[rest])).margins(x[~rest])
    model.knots, model.heights = isotonic(margins, y, weight)
    return model


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """documents with the probability of being toxic as a last column."""

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:  # the model travels with the function; LEXICON and TREES bound it
            yield pd.Series(model.scores(batch.fillna("").tolist()))

    return documents.withColumn(name, toxic(F.col(text)))


def learned(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents that are not held out; labels of the others are not even counted."""
    return fit(documents.where(fold() != 1), pick(labels, "doc_id", "toxic").where(fold() != 1))


def keep_harmless(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    rows = score(packed(documents, "doc_id", "text"), learned(pick(documents, "doc_id", "text"), labels))
    return restored(rows.where(F.col("score") < threshold), documents)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = pick(documents, "doc_id", "text")
    scored = score(rows, learned(rows, labels)).withColumn("held_out", fold() == 1)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
