"""Benchmark decontamination by a BM25 inverted index of the test items, searched with block-max WAND.

Test items are indexed as word postings in the order of items, cut into blocks with the largest weight of each. Weights
are BM25 weights divided by what the item scores against itself, so that a score says which share of the item's weight a
passage covers. Every document is cut into overlapping passages, twice as long as the longest item with a margin, so that
any copy of an item lies whole in one of them. Every passage is a query: all items above ``THRESHOLD`` are retrieved;
pivots and block maxima skip what cannot reach it. A hit counts if the passage also holds the item's question (share of
its five-word shingles) and its answer (share of its words); the answer is the item's last sentence.

The index is read in shards of a bounded number of items; every shard sees all documents. Number of items, document
frequencies, mean and largest length are counted once over all items and given to every shard, so scores and passages do
not depend on the number of shards. Passages are made inside the task from the whole text, so no document is shuffled and no
key can be hot.

Defined results: null or empty texts match nothing; an item without words takes no part; items with equal text both match; an
item's question of fewer than five words is read
together with the answer; repeated rows match each on their own. Other columns are ignored or
pass through. A document reports an item once, with its best passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import packed, pick, restored
from parley.session import stage

#: Items of one shard of the index, on average; bounds what travels to the tasks.
SHARD_ITEMS = 20_000
K1, B = 1.2, 0.75
#: Share of an item's weight that a passage must cover; share of question shingles and of answer words to confirm.
THRESHOLD, OVERLAP = 0.5, 0.75
SHINGLE = 5
#: Words by which passages advance at least; entries of a posting block; ranges of items bounded together.
STRIDE, BLOCK, RANGES = 64, 32, 64
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class Item:
    """An item's id, words, question shingles and answer words."""

    def __init__(self, item_id, text: str):
        self.item_id = item_id
        self.words = words_of(text)
        sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
        answer = sentences[-1] if sentences else []
        question = self.words[: len(self.words) - len(answer)]
        if len(question) < SHINGLE:  # too short to tell anything: read together with the answer
            question = self.words
        self.width = min(SHINGLE, len(question))
        self.question = shingles(question, self.width)
        self.answer = Counter(answer)

    def overlaps(self, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that the passage holds."""
        have = shingles(passage, self.width)
        count = Counter(passage)
        total = sum(self.answer.values())
        return sum(s in have for s in self.question) / len(self.question), sum(min(n, count[w]) for w, n in self.answer.items()) / total


@dataclass
class Whole:
    """What is counted over all items: their number, words and largest length, and items by word, for the words of a shard at least."""

    items: int
    words: int
    longest: int
    in_items: dict[str, int]


class Index:
    """Postings of a shard of items, with block maxima and bounds by range of items."""

    def __init__(self, items: list[tuple], whole: Whole | None = None):
        self.items = [i for i in (Item(*x) for x in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) if x[1]) if i.words]
        whole = whole or Whole(len(self.items), sum(len(i.words) for i in self.items), max((len(i.words) for i in self.items), default=0), Counter(w for i in self.items for w in set(i.words)))
        self.longest, in_items = whole.longest, whole.in_items
        mean = whole.words / max(1, whole.items)
        self.vocabulary = {w: t for t, w in enumerate(sorted({w for i in self.items for w in i.words}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for d, item in enumerate(self.items):
            weights = {}
            for w, tf in Counter(item.words).items():
                idf = math.log(1 + (whole.items - in_items[w] + 0.5) / (in_items[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(item.words) / mean))
            own = sum(weights.values())
            for w, x in weights.items():
                postings[self.vocabulary[w]].append((d, x / own))
        self.docs = [[d for d, _ in p] for p in postings]
        self.weights = [[x for _, x in p] for p in postings]
        self.blocks = [[(p[min(i + BLOCK, len(p)) - 1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for p in postings]
        self.most = [max(x) for x in self.weights]
        self.span = -(-len(self.items) // RANGES) or 1
        self.bounds = np.zeros((len(postings), RANGES), np.float32)
        for t, p in enumerate(postings):
            for d, x in p:
                self.bounds[t, d // self.span] = max(self.bounds[t, d // self.span], x)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score with these distinct terms is at least the threshold."""
        if sum(map(self.most.__getitem__, terms)) < threshold:
            return []
        ranges = np.flatnonzero(self.bounds[terms].sum(axis=0) >= threshold - 1e-4)
        return [hit for r in ranges.tolist() for hit in self._wand(terms, threshold, r * self.span, (r + 1) * self.span)]

    def _wand(self, terms: list[int], threshold: float, low: int, high: int) -> list[tuple[int, float]]:
        """Block-max WAND over the items from low up to high."""
        cursors = []  # [item, position, block, term]
        for t in terms:
            docs = self.docs[t]
            at = _seek(docs, 0, low)
            if at < len(docs) and docs[at] < high:
                cursors.append([docs[at], at, at // BLOCK, t])
        hits = []
        while cursors:
            cursors.sort()
            # the pivot: first item that the terms up to it could lift to the threshold
            reach, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                reach += self.most[c[3]]
                if reach >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that hold the pivot say more sharply what can be reached, and up to which item
            bound, end = 0.0, high
            for c in cursors[: pivot + 1]:
                blocks = self.blocks[c[3]]
                b = c[2]
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                c[2] = b
                if b < len(blocks):
                    bound += blocks[b][1]
                    end = min(end, blocks[b][0] + 1)
            if bound < threshold - 1e-9:
                following = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else high
                target = max(item + 1, min(end, following))
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = math.fsum(self.weights[c[3]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    hits.append((item, score))
                target, moved = item + 1, cursors[: pivot + 1]
            else:
                target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                docs = self.docs[c[3]]
                c[1] = _seek(docs, c[1], target)
                c[0] = docs[c[1]] if c[1] < len(docs) else high
            cursors = [c for c in cursors if c[0] < high]
        return hits

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Confirmed items of a whole text: number in the shard -> best score, question and answer overlap."""
        if not text or not self.items:
            return {}
        stride = max(STRIDE, -(-5 * self.longest // 4))
        words = words_of(text)
        known = list(map(self.vocabulary.get, words))
        found: dict[int, tuple[float, float, float]] = {}
        for at in range(0, max(1, len(words) - stride), stride):
            terms = set(known[at : at + 2 * stride])
            terms.discard(None)
            for d, score in self.search(list(terms), THRESHOLD):
                question, answer = self.items[d].overlaps(words[at : at + 2 * stride])
                if question >= OVERLAP and answer >= OVERLAP:
                    found[d] = max(found.get(d, (0.0, 0.0, 0.0)), (score, question, answer))
        return found


def _seek(docs: list[int], at: int, target: int) -> int:
    """First position from ``at`` on with an item not before the target, by doubling steps and halving."""
    step = 1
    low = at
    while at < len(docs) and docs[at] < target:
        low, at, step = at + 1, at + step, 2 * step
    high = min(at, len(docs))
    while low < high:
        mid = (low + high) // 2
        if docs[mid] < target:
            low = mid + 1
        else:
            high = mid
    return low


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The index shard by shard; a shard holds SHARD_ITEMS items on average, chosen by a hash."""
    items = pick(benchmark, "item_id", "text").where("text IS NOT NULL AND text <> ''")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    if shards == 1:  # the shard is the whole
        yield Index([(r.item_id, r.text) for r in items.collect()])
        return
    words = stage(items.select("shard", "text").mapInPandas(_distinct_words, "shard long, word string, length long"))
    totals = words.agg(F.count_if(F.col("length") > 0).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")).first()
    counts = stage(words.groupBy("word").agg(F.count("*").alias("n")))
    for s in range(shards):
        own = words.where(F.col("shard") == s).select("word").distinct()
        known = {r.word: r.n for r in counts.join(own, "word", "left_semi").collect()}  # the words of one shard
        yield Index([(r.item_id, r.text) for r in items.where(F.col("shard") == s).collect()], Whole(totals.n, totals.words, totals.longest, known))


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every distinct word of an item; the item's number of words stands beside the first."""
    for batch in batches:
        rows = []
        for shard, text in zip(batch["shard"], batch["text"], strict=True):
            words = words_of(text)
            rows += [(shard, w, 0 if i else len(words)) for i, w in enumerate(dict.fromkeys(words))]
        yield pd.DataFrame(rows, columns=["shard", "word", "length"])


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every confirmed match."""
    rows = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for index in indexes(benchmark):
        found = rows.mapInPandas(_matcher(index), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionAll(found)
    return out


def _matcher(index: Index):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(d, index.items[i].item_id, *m) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, m in sorted(index.matches(t).items())]
            yield pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return match


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    rows = packed(documents, "text")
    for index in indexes(benchmark):
        rows = rows.where(_is_clean(index)(F.col("text")))
    return restored(rows, documents)


def _is_clean(index: Index):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: not index.matches(t if isinstance(t, str) else None)).astype(bool)

    return clean
