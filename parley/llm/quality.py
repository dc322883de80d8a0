"""Quality of documents by histogram gradient-boosted trees over document statistics.

Learning takes a bounded sample of labelled documents, drawn by a hash of the id so that each class has about ``PER_CLASS``
rows; weights restore the classes' true shares. Statistics of a document are read from its whole text: counts of bytes by
kind, lengths and repeats of words, pairs of words and lines, marks that end words and lines, and how far the text can be
compressed. Trees are grown level by level from histograms of quantile bins; a fifth of the sample decides how many stay.
All trees are flattened into arrays of nodes, whose leaves lead to themselves, and a batch of documents walks down all trees
at once with numpy. Scoring is one pass over the rows, without a shuffle.

Defined results: a null text counts as empty; an empty text has a score like any other; a label of null is no label; a
document with several labels is good if all of them say so; without labels of both classes every score is the share of good
labels (0 without labels). Repeated rows get equal scores; a null doc_id is scored and never learned from; an empty table
gives no row. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import pick, share

#: Labelled rows of each class that learning takes at most, on average.
PER_CLASS = 8_000
#: Shape of the trees: how many at most, levels, step, bins of a feature, least weight of a leaf, penalty of its value.
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, PENALTY = 120, 4, 0.15, 64, 6.0, 1.0
#: Trees without progress on the rest of the sample after which growing ends.
PATIENCE = 20
#: Share of the sample that decides how many trees stay.
JUDGES = 0.2
#: Documents that walk down the trees together: bounds the array of nodes.
TOGETHER = 2_048

UPPER, LOWER, DIGIT, BLANK = (np.frombuffer(s.encode(), np.uint8) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r"))
STOPS, PAUSES, BRACKETS, ODD = (np.frombuffer(s.encode(), np.uint8) for s in (".!?", ",;:", "()[]{}<>", "#$%&*+=@\\^_`|~/"))
ENDS = frozenset(".!?:;\"')»”…")
FEATURES = (
    "chars", "words", "lines", "mean_word", "longest_word", "spread_of_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "top_pair",
    "one_letter", "shouted", "titled", "no_letter", "odd_end", "word_ends_sentence", "mean_sentence", "upper", "lower", "digits", "blanks", "stops", "exclaims",
    "pauses", "brackets", "odd", "pipes", "control", "beyond_ascii", "entropy", "compressed", "mean_line", "distinct_lines", "copied_lines", "short_lines", "ended_lines",
)


def features(text: str) -> list[float]:
    """Statistics of a whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    n_bytes = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    part = kinds[kinds > 0] / n_bytes
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = Counter(zip(words, words[1:], strict=False))
    n_pairs = max(1, len(words) - 1)
    same = sum(k for (a, b), k in pairs.items() if a == b)
    shouted = titled = no_letter = odd_end = ends = 0
    for word, k in counts.items():
        upper = word.isupper()
        shouted += k * (upper and len(word) > 1)
        titled += k * (not upper and word[:1].isupper())
        last = word[-1]
        ends += k * (last in ".!?")
        if not last.isalnum() and last not in ENDS and last != ",":
            odd_end += k
        no_letter += k * (not upper and word.lower() == word.upper())
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    n_lines = max(1, len(lines))
    seen = Counter(lines)
    copied = sum(len(s) * (k - 1) for s, k in seen.items())
    total = {name: int(kinds[which].sum()) for name, which in (("u", UPPER), ("l", LOWER), ("d", DIGIT), ("b", BLANK), ("s", STOPS), ("p", PAUSES), ("k", BRACKETS), ("o", ODD))}
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), float(length.mean()), np.log1p(int(length.max())), float(length.std()),
        len(counts) / n, max(counts.values(), default=0) / n, same / n_pairs, len(pairs) / n_pairs, max(pairs.values(), default=0) / n_pairs,
        float((length == 1).mean()), shouted / n, titled / n, no_letter / n, odd_end / n, ends / n, n / (1 + ends),
        total["u"] / n_bytes, total["l"] / n_bytes, total["d"] / n_bytes, total["b"] / n_bytes, total["s"] / n_bytes, int(kinds[33]) / n_bytes,
        total["p"] / n_bytes, total["k"] / n_bytes, total["o"] / n_bytes, int(kinds[124]) / n_bytes, int(kinds[:9].sum() + kinds[14:32].sum() + kinds[127]) / n_bytes,
        int(kinds[128:].sum()) / n_bytes, float(-(part * np.log2(part)).sum()), len(zlib.compress(raw, 1)) / (n_bytes + 20), len(text) / n_lines,
        len(seen) / n_lines, copied / max(1, len(text)), sum(len(s) < 30 for s in lines) / n_lines, sum(s[-1] in ENDS for s in lines) / n_lines,
    ]


@dataclass
class Forest:
    """All trees as one set of arrays: feature and cut of a node, its left child (the right one follows), value of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def margins(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        """Sum of the leaves that rows end in, over the first so many trees (all, if not said)."""
        out = np.full(len(x), self.start)
        roots = self.roots[:trees]
        for a in range(0, len(x), TOGETHER):
            rows = x[a : a + TOGETHER]
            node = np.broadcast_to(roots, (len(rows), len(roots))).copy()
            who = np.arange(len(rows))[:, None]
            for _ in range(DEPTH):  # a leaf leads to itself: its cut is infinite
                node = self.left[node] + (rows[who, self.feature[node]] > self.cut[node])
            out[a : a + TOGETHER] += self.value[node].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


@dataclass
class Model:
    """A forest, or one score for all documents where there was nothing to learn."""

    forest: Forest | None
    constant: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.forest is None or not texts:
            return np.full(len(texts), self.constant)
        return self.forest.scores(np.array([features(t) for t in texts], np.float64))


def binned(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cuts between the quantile bins of each feature, and the bins of the rows."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) > BINS - 1:
            places = np.searchsorted(middle, np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
            middle = np.unique(middle[np.minimum(places, len(middle) - 1)])
        cuts.append(middle)
    return cuts, np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)])


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, judge_x: np.ndarray, judge_y: np.ndarray, judge_weight: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss; as many as serve the judges best."""
    cuts, bins = binned(x)
    n_features, width = x.shape[1], max(map(len, cuts)) + 1
    usable = np.zeros((n_features, width), bool)
    for f, c in enumerate(cuts):
        usable[f, : len(c)] = True
    offset = np.arange(n_features) * width
    good = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4))
    start = float(np.log(good / (1 - good)))
    feature, cut, left, value, roots = [], [], [], [], []
    margin, judged = np.full(len(y), start), np.full(len(judge_y), start)
    best, kept = np.inf, 0

    def leaf(weight_of: float) -> int:
        feature.append(0)
        cut.append(np.inf)
        left.append(len(left))
        value.append(weight_of)
        return len(left) - 1

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        root = leaf(-RATE * g.sum() / (h.sum() + PENALTY))
        roots.append(root)
        node = np.full(len(y), root)
        level = [root]
        for _ in range(DEPTH):
            slot_of = np.full(len(left), -1)
            slot_of[level] = np.arange(len(level))
            slot = slot_of[node]
            inside = slot >= 0
            key = (slot[inside, None] * (n_features * width) + offset + bins[inside]).ravel()
            size = len(level) * n_features * width
            sums = [np.bincount(key, np.repeat(v[inside], n_features), size).reshape(len(level), n_features, width) for v in (g, h, weight)]
            gs, hs, ws = (s.cumsum(axis=2) for s in sums)
            gt, ht, wt = (s[:, :, -1:] for s in (gs, hs, ws))
            gain = gs**2 / (hs + PENALTY) + (gt - gs) ** 2 / (ht - hs + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(ws < LEAST_WEIGHT) | (wt - ws < LEAST_WEIGHT) | ~usable] = 0
            flat = gain.reshape(len(level), -1)
            at = flat.argmax(axis=1)
            below = []
            for i, parent in enumerate(level):
                if flat[i, at[i]] <= 1e-6:
                    continue
                f, b = divmod(int(at[i]), width)
                g_left, h_left = gs[i, f, b], hs[i, f, b]
                pair = [leaf(-RATE * g_left / (h_left + PENALTY)), leaf(-RATE * (gt[i, f, 0] - g_left) / (ht[i, f, 0] - h_left + PENALTY))]
                feature[parent], cut[parent], left[parent] = f, float(cuts[f][b]), pair[0]
                below += pair
            if not below:
                break
            lefts, features_of, cuts_of = np.array(left), np.array(feature), np.array(cut)
            node = lefts[node] + (x[np.arange(len(y)), features_of[node]] > cuts_of[node])
            level = below
        margin = margin + np.array(value)[node]
        so_far = Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array([root]), 0.0)
        judged = judged + so_far.margins(judge_x)
        loss = float(np.average(np.logaddexp(0, np.where(judge_y == 1, -judged, judged)), weights=judge_weight))
        if loss < best - 1e-6:
            best, kept = loss, len(roots)
        elif len(roots) - kept >= PATIENCE:
            break
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots[: max(1, kept)]), start)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from the labelled documents given. Ids select and join rows only; they are no feature."""
    marked = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") != 0).cast("int")).alias("good"))
    n = {r.good: r["count"] for r in marked.groupBy("good").count().collect()}
    constant = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model(None, constant)
    rate = F.when(F.col("good") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    chosen = marked.where(share("doc_id", seed="quality") < rate)  # about 2 * per_class ids, whatever the input: fit to broadcast
    texts = pick(documents, "doc_id", "text").where("doc_id IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "good", share("doc_id", seed="judges").alias("draw"))

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "good": batch["good"], "draw": batch["draw"], "x": [features(t) for t in batch["text"]]})

    rows = sample.mapInPandas(dense, "doc_id long, good int, draw double, x array<double>").dropDuplicates(["doc_id", "x"]).orderBy("doc_id", "x").toPandas()
    sizes = rows["good"].value_counts()
    if len(sizes) < 2:
        return Model(None, constant)
    x, y, draw = np.stack(rows["x"]), rows["good"].to_numpy(np.float64), rows["draw"].to_numpy()
    weight = np.where(y == 1, n[1] / sizes[1], n[0] / sizes[0])
    weight *= len(y) / weight.sum()
    judge = draw < JUDGES
    if len(set(y[judge])) < 2 or len(set(y[~judge])) < 2:
        judge = np.zeros(len(y), bool)
    judges = judge if judge.any() else ~judge
    return Model(grow(x[~judge], y[~judge], weight[~judge], x[judges], y[judges], weight[judges]), constant)


def learned(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents that are not held out; labels of the others are not even counted."""
    return fit(documents.where(~held_out()), pick(labels, "doc_id", "quality").where(~held_out()))


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """documents with the probability of being good as a last column."""

    @F.pandas_udf("double")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:  # the model travels with the function; TREES and DEPTH bound it
            yield pd.Series(model.scores(batch.fillna("").tolist()))

    return documents.withColumn(name, good(F.col(text)))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = pick(documents, "doc_id", "text")
    scored = score(rows, learned(rows, labels)).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
