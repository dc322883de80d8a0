"""Hard negatives by angular triangle filtering.

Vectors become whole components, floor(256 * component). Every row stores its angles to a few reference directions and its
norm. By the triangle inequality on the sphere, the angle between an anchor and a row lies between the largest difference
and the smallest sum of their angles to the references; cosines of these ends, times both norms, widened by more than
rounding can amount to, bound their inner product. First the five best rows of the anchor's label are sought: rows whose
upper bound is below the fifth found so far are left out. Then each of these positives opens a window of scores, and rows of
other labels whose bounds meet no window are left out; a window closes from below as it fills. Only what is left is scored,
in whole numbers, so the result is exact. The test runs on whole blocks first and then on rows.

Rows are sorted by their nearest reference and the angle to it, so that a block is a narrow cone, and packed into blocks.
Work is a grid: chunks of anchors times groups of blocks, each cell a bounded number of rows read as a stream, so neither a
frequent vector nor a frequent label is a hot key. References come from a bounded sample; they decide speed, not results.

Defined results: rows without id or label, or whose vector is null or holds null or non-finite components, take no part;
vectors may differ in length (a missing component is 0); a row's own id is no partner of it; the anchor of a repeated id is
the row with the smallest label and then vector; repeated rows each take a place among positives and a rank among negatives
(``positive_rank`` tells equal positives apart); ties go to the smaller vec_id; an anchor without positives, and a positive
without negatives, gives no row; an empty table gives none. Scores of more than 62 bits are refused. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import Scratch, pick

#: Reference directions, and rows of the sample they are chosen from.
REFERENCES, SAMPLE = 8, 256
#: Rows of a block (fewer where vectors are long), blocks' worth of anchors in a chunk, blocks of a cell at most, and cells
#: wanted before cells grow.
BLOCK_ROWS, CHUNK_BLOCKS, CELL_BLOCKS, CELLS = 2048, 4, 64, 64
#: Kinds of packed rows; in a cell the anchors come first.
ANCHORS, BLOCK = 0, 1
#: Anchors that meet a block at a time: bounds the arrays of bounds and scores.
TOGETHER = 512
#: What angles and products are widened by; rounding stays below 1e-7 even where a cosine is close to 1.
SAFE = 1e-6
#: Found pairs that are held before they are thinned out to the best.
HELD = 200_000

PACKED = pa.schema([("kind", pa.int32()), ("rows", pa.int32()), ("item", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "x", "norms", "angles", "low", "high"))])
PACKED_DDL = "kind int, rows int, item int, ids binary, labels binary, x binary, norms binary, angles binary, low binary, high binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole components of every row that takes part."""
    return (
        pick(vectors, "vec_id", "label", "embedding")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, e -> e IS NOT NULL AND abs(e) < double('Infinity'))")
        .select("vec_id", "label", F.expr("transform(x, e -> floor(256 * e))").alias("x"))
    )


def references(rows: DataFrame) -> np.ndarray:
    """Unit vectors far from each other, chosen from the rows with the smallest hashes; any, if all rows are zeros."""
    sample = rows.where("exists(x, e -> e <> 0)").select("x").orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).collect()
    if not sample:
        return np.ones((1, 1))
    width = max(len(r.x) for r in sample)
    unit = np.array([list(r.x) + [0] * (width - len(r.x)) for r in sample], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(REFERENCES, len(unit)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to the longest."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(value)) - np.repeat(np.cumsum(length) - length, length)] = value
    return out


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """The matrix with so many columns: zeros are put behind shorter rows."""
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def measured(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows and their angles to the references; a row of zeros has norm 0 and, whatever they mean, angles 0."""
    y = x.astype(np.float64)
    norms = np.sqrt((y * y).sum(axis=1))
    width = max(y.shape[1], refs.shape[1])
    cosine = fitted(y, width) @ fitted(refs, width).T / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def _cones(refs: np.ndarray):
    """Adds the nearest reference and the angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, angles = measured(matrix(batch["x"]), refs)
            cone = angles.argmin(axis=1)
            columns = [pa.array(cone, pa.int32()), pa.array(angles[np.arange(len(cone)), cone], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], *columns], ["vec_id", "label", "x", "cone", "angle"])

    return place


def _packer(refs: np.ndarray, rows: int, kind: int, windows: bool = False):
    """Packs the rows of a partition into blocks of at most so many rows, or all into one if rows is 0.

    Anchors may bring the ends of their windows as arrays low and high.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held) if rows else batch.num_rows
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if rows and sum(b.num_rows for b in held) == rows:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()

        def whole(name: str) -> pa.Array:
            column = table[name].combine_chunks()
            return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column

        x = matrix(whole("x"))
        norms, angles = measured(x, refs)
        most = max(abs(int(x.min(initial=0))), int(x.max(initial=0)))
        item = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        ends = [matrix(whole(c)).tobytes() for c in ("low", "high")] if windows else [None, None]
        parts = [ids.tobytes(), labels.tobytes(), x.astype(f"i{item}").tobytes(), norms.tobytes(), angles.tobytes(), *ends]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([kind, len(ids), item, *parts], PACKED, strict=True)], schema=PACKED)

    return pack


class Rows:
    """A block read back: ids, labels, components, norms, angles, ends of windows."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        def read(name: str, kind: str) -> np.ndarray:
            value = batch[name][i]
            return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)

        n = batch["rows"][i].as_py()
        self.ids, self.labels, self.norms = read("ids", "i8"), read("labels", "i8"), read("norms", "f8")
        self.x = read("x", f"i{batch['item'][i].as_py()}").reshape(n, -1)
        self.angles = read("angles", "f8").reshape(n, -1)
        self.low, self.high = (read(c, "i8").reshape(n, -1) for c in ("low", "high"))


def bounds(angles: np.ndarray, norms: np.ndarray, least: np.ndarray, most: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products: anchors down, rows or blocks of rows across.

    Angles of a row (or of all rows of a block) to the references lie between least and most, norms between small and large.
    """
    near = np.zeros((len(angles), len(least)))
    far = np.full((len(angles), len(least)), np.pi)
    for j in range(angles.shape[1]):
        a = angles[:, j, None]
        np.maximum(near, a - most[None, :, j], out=near)
        np.maximum(near, least[None, :, j] - a, out=near)
        np.minimum(far, a + most[None, :, j], out=far)
        np.minimum(far, 2 * np.pi - a - least[None, :, j], out=far)
    high = np.cos(np.maximum(near - SAFE, 0))
    low = np.cos(np.minimum(far + SAFE, np.pi))
    high *= np.where(high > 0, large, small) * norms[:, None]
    low *= np.where(low > 0, small, large) * norms[:, None]
    slack = SAFE * (1 + norms[:, None] * large)
    return low - slack, high + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by floating point where that is exact, else by longs, else by unbounded numbers."""
    width = max(a.shape[1], b.shape[1], 1)
    a, b = fitted(a, width), fitted(b, width)
    most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    bound = most[0] * most[1] * width
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = a.astype(object) @ b.astype(object).T
    if out.size and max(abs(out.min()), abs(out.max())) >= 1 << 62:
        raise ValueError("a score has more than 62 bits")
    return out.astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each slot, from pairs that come in any order."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, slots: int, k: int):
        self.k = k
        self.found = [np.zeros(0, np.int64)] * 3  # slot, score, id
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.last_score = np.full(slots, self.NONE)
        self.last_id = np.full(slots, np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score > self.last_score[slot]) | ((score == self.last_score[slot]) & (ids < self.last_id[slot]))
        if good.any():
            self.new.append((slot[good], score[good], ids[good]))
            self.waiting += int(good.sum())
            if self.waiting > HELD:
                self.thin()

    def thin(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip(self.found, *self.new, strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.found, self.new, self.waiting = [slot[keep], score[keep], ids[keep]], [], 0
        full = rank == self.k - 1
        self.last_score[slot[full]], self.last_id[slot[full]] = score[full], ids[full]

    def result(self) -> list[np.ndarray]:
        self.thin()
        return self.found


def meet(anchors: Rows, rows: Rows, best: Best, low: np.ndarray, high: np.ndarray, same: bool) -> int:
    """Add what rows hold for the anchors' windows (low to high, some a row); returns how many pairs were scored.

    same: rows of the anchor's label take part, else those of other labels.
    """
    windows, scored = low.shape[1], 0
    least, most = rows.angles.min(axis=0, keepdims=True), rows.angles.max(axis=0, keepdims=True)
    small, large = rows.norms.min(keepdims=True), rows.norms.max(keepdims=True)
    here = np.unique(rows.labels)
    slots = np.arange(len(anchors.ids) * windows).reshape(-1, windows)

    def open_to(who: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
        """Which bounds meet a window that still takes something."""
        out = np.zeros(floor.shape, bool)
        for w in range(windows):
            start = np.maximum(low[who, w], best.last_score[slots[who, w]])
            out |= (floor <= high[who, w, None]) & (ceiling >= start[:, None]) & (low[who, w] <= high[who, w])[:, None]
        return out

    possible = np.isin(anchors.labels, here) if same else (len(here) > 1) | (anchors.labels != here[0])
    for start in range(0, len(anchors.ids), TOGETHER):
        who = start + np.flatnonzero(possible[start : start + TOGETHER])
        if not len(who):
            continue
        who = who[open_to(who, *bounds(anchors.angles[who], anchors.norms[who], least, most, small, large))[:, 0]]
        if not len(who):
            continue
        partner = (anchors.labels[who, None] == rows.labels) == same
        partner &= anchors.ids[who, None] != rows.ids
        partner &= open_to(who, *bounds(anchors.angles[who], anchors.norms[who], rows.angles, rows.angles, rows.norms, rows.norms))
        across, down = np.flatnonzero(partner.any(axis=0)), np.flatnonzero(partner.any(axis=1))
        if not len(across):
            continue
        at, row = np.nonzero(partner[np.ix_(down, across)])
        score = products(anchors.x[who[down]], rows.x[across])[at, row]
        scored += len(at)
        anchor, ids = who[down][at], rows.ids[across][row]
        for w in range(windows):
            inside = (score >= low[anchor, w]) & (score <= high[anchor, w])
            best.add(slots[anchor[inside], w], score[inside], ids[inside])
    return scored


FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searcher(k: int, same: bool):
    """Reads cells one after the other: a chunk of anchors, then its blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, best, low, high = -1, None, None, None, None

        def done() -> pa.RecordBatch:
            slot, score, ids = best.result()
            windows = low.shape[1]
            columns = [anchors.ids[slot // windows], slot % windows + 1, ids, score]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

        for batch in batches:
            for i in range(batch.num_rows):
                if batch["kind"][i].as_py() == ANCHORS:
                    if anchors is not None:
                        yield done()
                    cell, anchors = batch["cell"][i].as_py(), Rows(batch, i)
                    whole = np.iinfo(np.int64)
                    low = np.full((len(anchors.ids), 1), whole.min) if same else anchors.low
                    high = np.full((len(anchors.ids), 1), whole.max) if same else anchors.high
                    best = Best(low.size, k)
                elif batch["cell"][i].as_py() == cell:
                    meet(anchors, Rows(batch, i), best, low, high, same)
        if anchors is not None:
            yield done()

    return search


def searched(chunks: DataFrame, n_chunks: int, blocks: DataFrame, n_blocks: int, k: int, same: bool) -> DataFrame:
    """anchor_id, positive_rank, vec_id and score of the k best of each window in each group of blocks.

    Chunks and blocks carry their number as ``at``; a cell is a chunk and a group of blocks, which follow it in the stream.
    """
    groups = max(1, min(n_blocks, max(-(-n_blocks // CELL_BLOCKS), -(-CELLS // n_chunks))))
    a = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("cell", F.col("at") * groups + F.col("part"))
    b = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).withColumn("cell", F.col("chunk") * groups + F.pmod("at", F.lit(groups)))
    stream = a.select("cell", *PACKED.names).unionByName(b.select("cell", *PACKED.names)).repartition(n_chunks * groups, "cell")
    return stream.sortWithinPartitions("cell", "kind").mapInArrow(_searcher(k, same), "anchor_id long, positive_rank int, vec_id long, score long")


def ranked(found: DataFrame, k: int, *slot: str) -> DataFrame:
    """The k best of each slot over all groups of blocks, with their rank."""
    order = Window.partitionBy(*slot).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ``every``: rows of another label, the best first.

    Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank. A positive is one of the
    best rows of the anchor's label; its negatives score between ``least`` and ``most`` hundredths of what it scores.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = quantised(vectors)
    refs = references(rows)
    n_rows = rows.count()
    block_rows = max(64, min(BLOCK_ROWS, BLOCK_ROWS * 128 // refs.shape[1]))
    n_blocks = max(1, -(-n_rows // block_rows))
    cones = rows.mapInArrow(_cones(refs), "vec_id long, label long, x array<long>, cone int, angle double").withColumn("copy", F.monotonically_increasing_id())
    along = cones.repartitionByRange(n_blocks, "cone", "angle", "vec_id", "copy").sortWithinPartitions("cone", "angle", "vec_id", "copy").select("vec_id", "label", "x")
    blocks = along.mapInArrow(_packer(refs, block_rows, BLOCK), PACKED_DDL).withColumn("at", F.spark_partition_id())
    blocks = scratch.stage(blocks)
    one = F.min(F.struct("label", "x")).alias("one")
    anchors = scratch.stage(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(one).select("vec_id", "one.label", "one.x"))
    n_chunks = max(1, -(-anchors.count() // (CHUNK_BLOCKS * block_rows)))

    def chunked(df: DataFrame, windows: bool) -> DataFrame:
        packed = df.repartition(n_chunks).mapInArrow(_packer(refs, 0, ANCHORS, windows), PACKED_DDL)
        return scratch.stage(packed.withColumn("at", F.spark_partition_id()))

    near = ranked(searched(chunked(anchors, False), n_chunks, blocks, n_blocks, positives, True), positives, "anchor_id")
    near = scratch.stage(near.select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    hundreds, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100
    ends = near.select(
        "anchor_id",
        "positive_rank",
        F.when(F.col("positive_score") >= 0, hundreds * least + F.ceil(rest * least / 100)).otherwise(1).alias("low"),
        F.when(F.col("positive_score") >= 0, hundreds * most + F.floor(rest * most / 100)).otherwise(0).alias("high"),
    )
    ends = ends.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("positive_rank", F.struct("low", "high")))).alias("w"))
    low, high = (F.expr(f"transform(sequence(1, {positives}), i -> coalesce(element_at(w, i).{c}, CAST({d} AS LONG)))") for c, d in (("low", 1), ("high", 0)))
    opened = anchors.join(ends, "vec_id").select("vec_id", "label", "x", low.alias("low"), high.alias("high"))
    found = ranked(searched(chunked(opened, True), n_chunks, blocks, n_blocks, negatives, False), negatives, "anchor_id", "positive_rank")
    found = found.select("anchor_id", "positive_rank", F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
