"""Near-duplicate documents by min-max hashing, every link confirmed on full shingle sets.

Signature. A document is the set of its distinct five-word shingles, as 64-bit hashes. Under each of ``PERMUTATIONS`` hash
permutations both the smallest and the largest value are kept, which gives two nearly independent values for one evaluation.
Values go into bands of ``ROWS`` (two permutations): two documents meet in a bucket if they agree on a whole band. At a
similarity of 0.75 a pair misses all 40 bands with a chance of 3e-7.

Confirmation without all pairs. Documents with equal sets form a class and are handled once. A bucket is worked off in
rounds: each round takes a few of its classes as pivots, compares them on full sets with all classes of the bucket that
are not yet in the same component, adds the confirmed links, and takes the pivots out: their links are all known. Pivots
are those with most links so far, so a group around one original is joined in about two rounds, with as many comparisons
as it has members. Buckets that are not done then hold classes that share a passage rather than a text: their classes are
put into buckets by their rarest shingles instead, which loses no link, and these are worked off with a number of pivots
that grows from round to round. A bucket is done when all its classes are in one component or have been pivots; one of no
more classes than pivots is done at once, and a round without new links leaves the components as they are. So there are few
rounds, and the plans, threads and tasks that the driver has to hold stay few.

No group meets in one task: buckets, classes and components are only ever counted, reduced to a minimum or joined on rows of
two numbers; the joins are split by the engine where a key is hot.

Defined results: null text, and text without words, has no shingle, is linked with nothing and is kept; fewer than five words
are one shingle. Rows with equal text are one class whatever their ids, so repeated rows get equal results; a component is
named by its smallest id; a null id is never that name unless all ids of the component are null. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import Scratch, packed, pick, restored
from parley.llm.lines import _same, picked
from parley.session import stage

SHINGLE = 5
#: Similarity in percent from which documents are linked.
PERCENT = 75
PERMUTATIONS, ROWS = 80, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Rounds with one pivot per bucket before the buckets that are not done are refined by rare shingles.
REFINED = 2
#: Pivots per bucket after that, fourfold from round to round.
PIVOTS = 16
_draw = np.random.default_rng(20_240_501)
FACTORS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
PLACES = _draw.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; only A to Z are lower-cased."""
    words = text.encode().lower().split() if text else []  # on bytes: ASCII letters, and blanks 09 to 0D and 20
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    total = np.full(n, len(h) if len(h) < SHINGLE else 0, np.uint64)
    for k in range(width):
        total += h[k : k + n] * PLACES[k]
    return np.unique(mixed(total))


def bands(shingles: np.ndarray) -> np.ndarray:
    """Bucket keys of a non-empty set."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(shingles), 2048):  # bounds the matrix for very long texts
        values = shingles[a : a + 2048, None] * FACTORS + SHIFTS
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    pairs = np.column_stack([low, high]).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in pairs.T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"], strict=True):
            s = shingle_set(text if isinstance(text, str) else None)
            key = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            rows.append((doc_id, mark, len(s), int(key[0]), int(key[1]), bands(s) if len(s) else None))
        yield pd.DataFrame(rows, columns=["doc_id", "mark", "n_shingles", "set_a", "set_b", "bands"]).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"cls": batch["cls"], "shingles": [shingle_set(t).view(np.int64) for t in batch["text"]]})


def _rows(*rows: tuple[str | Column, ...], names: tuple[str, ...]) -> Column:
    """Several rows from one, in columns of these names: unlike a union it reads its input once."""
    return F.inline(F.array(*(F.struct(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(row, names, strict=True))) for row in rows)))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u and its component (smallest member) for all ends of the edges (u, v), by stars in turn.

    First every node hangs its larger neighbours under its smallest one, then each node its smaller ones; the number of
    rounds grows with the logarithm of the longest path. Stops when all nodes hang directly under their smallest one.
    """
    e = scratch.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # rows have u > v; each table is staged once and read at most twice, so that the plans of a round stay small
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = scratch.stage(e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = scratch.stage(joined.select(_rows(("u", "m"), ("v", "m"), names=("u", "v"))).where("u <> v").distinct())
        # done when every node hangs under one other that hangs under none
        roles = e.select(_rows(("u", F.lit(1), F.lit(0)), ("v", F.lit(0), F.lit(1)), names=("x", "below", "above")))
        roles = roles.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if roles.where("below > 1 OR (below = 1 AND above = 1)").isEmpty():
            return e.select("u", F.col("v").alias("component"))


def _once(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (bucket, cls, place) of buckets with several classes; of buckets with the same classes the first in order."""
    spread = F.xxhash64("cls").cast("decimal(38,0)")
    counts = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(spread).alias("s"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.sum("place").alias("at")).where("n > 1")
    once = counts.groupBy("n", "s", "lo", "hi").agg(F.min(F.struct("at", "bucket"))["bucket"].alias("bucket")).select("bucket")
    return scratch.stage(members.join(once, "bucket"))


def _refined(live: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets by rare shingles for the classes of buckets that are not done.

    All shingles of these classes are put in one order, the rarest first. Two sets alike enough share a shingle among the
    first n - ceil(0.75 n) + 1 of each: the rest alone could not make up the overlap. Nor can what follows the first shared
    shingle, if its place is too late; so the place is kept for the comparison of sizes. Classes that have nothing but a
    common passage in common no longer meet, and no link is lost.
    """
    ids = scratch.stage(live.select("cls", "label").distinct())
    own = sets.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "cls")
    rows = scratch.stage(own.select("cls", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket")))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("often")).where("often > 1")
    rarest = Window.partitionBy("cls").orderBy("often", "bucket")
    ordered = rows.join(shared, "bucket", "left").withColumn("place", F.row_number().over(rarest))
    first = ordered.where(F.col("often").isNotNull() & (F.col("place") <= F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1)).select("bucket", "cls", "label", (F.col("place") - 1).cast("long").alias("place"))
    first = scratch.stage(first)
    across = first.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return _once(first.join(across, "bucket").select("bucket", "cls", "place"), scratch)


#: Ids that may be broadcast to pick the sets of a round: 8 MB. More are joined.
FEW_IDS = 1_000_000


def _needed(sets: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets that occur in the pairs."""
    ids = scratch.stage(pairs.select(_rows(("u",), ("v",), names=("cls",))).distinct())
    return sets.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "cls", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sets are alike enough."""
    sets = _needed(sets, pairs, scratch)
    a = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("set_u"))
    b = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("set_v"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.join(a, "u").join(b, "v").where(100 * both >= PERCENT * (F.size("set_u") + F.size("set_v") - both)).select("u", "v").distinct()


def _single(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per class of the staged rows (cls, shingles, row): a document that stands k times gives k rows of its class.

    Only numbers of rows move; the sets are written again where some are surplus.
    """
    often = rows.groupBy("cls").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("cls", "first")
    surplus = scratch.stage(rows.select("cls", "row").join(often, "cls").where("row <> first").select("row"))
    n = surplus.count()
    if not n:
        return rows
    return scratch.stage(rows.join(F.broadcast(surplus) if n <= FEW_IDS else surplus, "row", "left_anti"))


def linked_classes(documents: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """cls and label of all classes that share a bucket with another; label names the component."""
    buckets = _once(classes.select(F.explode("bands").alias("bucket"), "cls", F.lit(0).cast("long").alias("place")), scratch)
    wanted = scratch.stage(buckets.select("cls").distinct().join(classes.select("cls", "n_shingles", "doc_id", "mark"), "cls"))
    texts = _same(picked(documents.select("doc_id", "mark", "text"), wanted), wanted.select("cls", "doc_id", "mark"), ("doc_id", "mark"), "inner")
    sets = _single(scratch.stage(texts.select("cls", "text").mapInPandas(_sets, "cls long, shingles array<long>").withColumn("row", F.monotonically_increasing_id())), scratch)
    labels = unlinked = wanted.select("cls", "n_shingles", F.col("cls").alias("label"), F.lit(0).cast("long").alias("links"))
    pivots_per_bucket = 1
    tested: list[DataFrame] = []
    for turn in count():
        live = buckets.join(labels, "cls")
        split = live.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("bucket", "members")
        live = scratch.stage(live.join(split, "bucket"))
        scratch.clear(classes, sets, live, labels, *tested, *([wanted] if labels is unlinked else []))  # what earlier rounds left
        if live.isEmpty():
            return labels.select("cls", "label")
        if turn == REFINED:
            buckets, pivots_per_bucket = _refined(live, sets, scratch), PIVOTS
            continue
        # a bucket of no more classes than that is done in this round: all of them are pivots
        slot = F.when(F.col("members") <= pivots_per_bucket, F.col("cls")).otherwise(F.pmod(F.xxhash64("cls", F.lit(pivots_per_bucket)), F.lit(pivots_per_bucket)))
        pivots = live.groupBy("bucket", slot.alias("slot")).agg(F.max(F.struct("links", F.xxhash64("cls").alias("order"), "cls", "label", "n_shingles", "place")).alias("p"))
        pivots = scratch.stage(pivots.select("bucket", "p.cls", "p.label", "p.n_shingles", "p.place"))
        near = pivots.select("bucket", F.col("cls").alias("v"), F.col("label").alias("v_label"), F.col("n_shingles").alias("v_n"), F.col("place").alias("v_place"))
        # at most so many shingles can be shared from this one on, and so many have to be
        most = F.least(F.col("n_shingles") - F.col("place"), F.col("v_n") - F.col("v_place"))
        pairs = live.join(near, "bucket").where((F.col("label") != F.col("v_label")) & ((100 + PERCENT) * most >= PERCENT * (F.col("n_shingles") + F.col("v_n"))))
        pairs = pairs.select(F.greatest("cls", "v").alias("u"), F.least("cls", "v").alias("v")).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionAll, tested), ["u", "v"], "left_anti")
        pairs = scratch.stage(pairs)
        tested.append(pairs)
        links = scratch.stage(_confirmed(pairs, sets, scratch))
        if not links.isEmpty():
            ends = links.select(_rows(("u",), ("v",), names=("cls",))).groupBy("cls").agg(F.count("*").alias("more"))
            name = labels.select(F.col("cls").alias("u"), F.col("label").alias("a"))
            named = links.join(name, "u").join(name.select(F.col("u").alias("v"), F.col("a").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
            moved = components(named, scratch).select(F.col("u").alias("label"), "component")
            labels = labels.join(moved, "label", "left").join(ends, "cls", "left")
            labels = scratch.stage(labels.select("cls", "n_shingles", F.coalesce("component", "label").alias("label"), (F.col("links") + F.coalesce("more", F.lit(0))).alias("links")))
        # staged, as the next round reads it twice
        buckets = scratch.stage(live.select("bucket", "cls", "place").join(pivots.select("bucket", "cls"), ["bucket", "cls"], "left_anti"))
        pivots_per_bucket *= 1 if turn < REFINED else 4


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id and kept of every document."""
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    scratch = Scratch(documents.sparkSession)
    signed = stage(docs.mapInPandas(_sign, "doc_id long, mark long, n_shingles long, set_a long, set_b long, bands array<long>"))
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = scratch.stage(classes.select("set_a", "set_b", "least", "one.doc_id", "one.mark", "n_shingles", "bands").withColumn("cls", F.monotonically_increasing_id()))
    labels = linked_classes(docs, classes, scratch)
    named = classes.select("cls", "set_a", "set_b", "least").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = stage(named)
    scratch.clear()
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "label").select("set_a", "set_b", "component_id")
    out = signed.drop("bands").join(of_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, with all columns. Rows equal in id and text are one document and stay together."""
    rows = packed(documents, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    gone = near_duplicates(documents).where(~F.col("kept")).select("doc_id", "mark").distinct()
    kept = rows.withColumn("doc_id", F.col("doc_id").cast("long")).join(gone.select(F.col("doc_id").alias("g"), F.col("mark").alias("h")), F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("mark") == F.col("h")), "left_anti")
    return restored(kept, documents)
