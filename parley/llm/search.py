"""Exact top-k search by term-at-a-time accumulation.

A vector is a sparse row of (term, weight): the place of a component and floor(256 * component), zeros left out. Candidate
rows are packed into blocks and a block is inverted into postings. For a block of queries every term scatters query
weight times posting weight into a dense array of scores, one line per candidate; partition selection then keeps the k
best of the block for each query, and the winners of all blocks are merged. Nothing is skipped, so the result is exact.

Candidate blocks lie in groups of a bounded number, each read once; query blocks travel to every group and are streamed past
it. A group holds a bounded number of rows whatever the data, so a frequent vector or id is no hot key.

Defined results: a vector that is null, or holds null or non-finite components, or whose vec_id is null, takes no part;
vectors may differ in length (a missing component is 0); if a query id is repeated, its smallest vector is the query;
repeated candidates each take a rank; a query without candidates gives no row; ties go to the smaller vec_id. Scores that
might leave 64 bits are added up as unbounded integers; only one that does leave them, among those returned, is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import pick
from parley.session import stage

#: Rows of a block of queries and of candidates, and the most candidate blocks of a group.
QUERY_ROWS, BLOCK_ROWS, CELL_BLOCKS = 1024, 2048, 64
#: Queries whose scores are accumulated at a time: bounds the dense array.
TOGETHER = 128

#: Scores are below it; its negative stands for a query's own row.
NONE_YET = 1 << 63

BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("terms", pa.binary()), ("weights", pa.binary())])
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer components of every vector that takes part."""
    return (
        pick(vectors, "vec_id", "embedding")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        .where("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, e -> e IS NOT NULL AND abs(e) < double('Infinity'))")
        .select("vec_id", F.expr("transform(x, e -> floor(256 * e))").alias("x"))
    )


def _packer(rows: int):
    """Packs the rows of a partition into sparse blocks of at most ``rows`` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == rows:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["vec_id"].to_numpy()
        lists = table["x"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(length)])
        term = np.arange(len(value)) - np.repeat(start[:-1], length)
        row = np.repeat(np.arange(len(ids)), length)
        used = value != 0
        ends = np.cumsum(np.bincount(row[used], minlength=len(ids)))
        held_bytes = [[x.astype(kind).tobytes()] for x, kind in ((ids, np.int64), (ends, np.int64), (term[used], np.int32), (value[used], np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.array(x, pa.binary()) for x in held_bytes)], schema=BLOCK)

    return pack


def blocks(vectors: DataFrame, n: int, rows: int) -> DataFrame:
    """Sparse blocks of at most ``rows`` vectors, numbered by partition."""
    columns = "block long, ids binary, ends binary, terms binary, weights binary"
    return vectors.repartition(max(1, n)).mapInArrow(_packer(rows), columns).withColumn("block", F.spark_partition_id().cast("long"))


def _read(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, ends = (np.frombuffer(row[prefix + x], np.int64) for x in ("ids", "ends"))
    return ids, np.concatenate([[0], ends]), np.frombuffer(row[prefix + "terms"], np.int32), np.frombuffer(row[prefix + "weights"], np.int64)


def top_of_block(queries, candidates, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of the k best candidates of one block for each query of another."""
    q_ids, q_ends, q_terms, q_weights = queries
    ids, ends, terms, weights = candidates
    by_id = np.argsort(ids, kind="stable")  # ties go to the smaller id
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    ids = ids[by_id]
    rows = place[np.repeat(np.arange(len(ids)), np.diff(ends))]
    order = np.lexsort((rows, terms))
    terms, rows, weights = terms[order], rows[order], weights[order]
    known, first = np.unique(terms, return_index=True)
    last = np.append(first[1:], len(terms))
    postings = {t: (rows[a:b], weights[a:b]) for t, a, b in zip(known.tolist(), first.tolist(), last.tolist(), strict=True)}
    wide = _largest(q_weights) * _largest(weights) * max(1, len(known)) >= NONE_YET
    kind, own = (object, -(1 << 256)) if wide else (np.int64, -NONE_YET)
    if wide:
        q_weights, postings = q_weights.astype(object), {t: (r, w.astype(object)) for t, (r, w) in postings.items()}
    n, take = len(ids), min(k, len(ids))
    out = []
    for a in range(0, len(q_ids), TOGETHER):
        b = min(a + TOGETHER, len(q_ids))
        scores = np.zeros((n, b - a), kind)
        lo, hi = q_ends[a], q_ends[b]
        who = np.repeat(np.arange(b - a), np.diff(q_ends[a : b + 1]))
        by_term = np.argsort(q_terms[lo:hi], kind="stable")
        term, who, weight = q_terms[lo:hi][by_term], who[by_term], q_weights[lo:hi][by_term]
        starts = np.flatnonzero(np.diff(term, prepend=-1)).tolist()
        for s, e in zip(starts, [*starts[1:], len(term)][: len(starts)], strict=True):
            if (found := postings.get(int(term[s]))) is None:
                continue
            at, w = found
            if 2 * (e - s) >= b - a:  # most queries have the term: whole lines
                line = np.zeros(b - a, kind)
                line[who[s:e]] = weight[s:e]
                if len(at) == n:
                    scores += np.multiply.outer(w, line)
                else:
                    scores[at] += np.multiply.outer(w, line)
            else:
                scores[np.ix_(at, who[s:e])] += np.multiply.outer(w, weight[s:e])
        scores[ids[:, None] == q_ids[None, a:b]] = own
        least = (np.sort(scores, axis=0) if wide else np.partition(scores, n - take, axis=0))[n - take]
        above, level = scores > least, scores == least
        # candidates are in the order of ids: the first of those that tie fill what is left
        best = (above | (level & (np.cumsum(level, axis=0) <= take - above.sum(axis=0)))) & (scores != own)
        at, which = np.nonzero(best)
        found = scores[at, which]
        if wide and any(not -NONE_YET <= x < NONE_YET for x in found):
            raise ValueError("a score does not fit 64 bits")
        out.append((q_ids[a:b][which], ids[at], found.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _largest(weights: np.ndarray) -> int:
    return max(int(weights.max(initial=0)), -int(weights.min(initial=0)))


def _scorer(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                hits = top_of_block(_read(row, "q_"), _read(row, ""), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in hits], schema=HITS)

    return score


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates with the highest inner product for each query.

    Both frames hold vec_id and an integer array x, as `quantised` gives them; a query's own id is no candidate of it.
    """
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    n_queries, n_rows = queries.count(), candidates.count()
    n_q, n_c = -(-n_queries // QUERY_ROWS), -(-n_rows // BLOCK_ROWS)
    groups = max(1, -(-n_c // CELL_BLOCKS), min(n_c, 2 * queries.sparkSession.sparkContext.defaultParallelism))
    q = stage(blocks(queries, n_q, QUERY_ROWS))
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in q.columns))
    c = stage(blocks(candidates, n_c, BLOCK_ROWS)).withColumn("part", F.pmod("block", F.lit(groups)))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = q.select("part", "q_ids", "q_ends", "q_terms", "q_weights").repartition(groups, "part")
    c = c.select(F.col("part").cast("int").alias("part"), "ids", "ends", "terms", "weights").repartition(groups, "part")
    # the streamed side are the queries: a task holds one group of candidates
    hits = q.join(c.hint("merge"), "part").drop("part").mapInArrow(_scorer(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top k of all vectors for those whose vec_id is divisible by ``every``."""
    rows = quantised(vectors)
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
