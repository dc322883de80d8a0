"""Alignment of the tokens that two tokenizers make of the same text.

Side A is a byte-level vocabulary over a blank and the text, side B a piece vocabulary over the text, to which it adds the
blank itself. Tokens become ranges of bytes. Documents are read in blocks of bounded length and laid end to end; in a block
`merge_asof`, keyed by document, finds the token of the other side that covers each token's start, in both directions, and
the union of both is every pair of overlapping tokens. Pairs whose ranges end together are links; the ends they share cut
the tokens of a document into groups.

How often an id pair is linked is counted over the whole corpus. A block stages its distinct pairs with their counts beside
its documents, so what is shuffled by pair is one row for each pair of a block, not one for each link, and a pair that
stands everywhere has at most one row a block. The counts return to the blocks by the number of the block.

Defined results: a text that is null, empty, or whose tokens of either side do not spell a blank and the text has no tokens,
zeros, and an empty digest; strings of special tokens are plain text; a null doc_id is kept; repeated rows are aligned and
counted each; very long texts are a block of their own; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm.common import Scratch, per_worker, pick

#: Bytes of text that close a block, and blocks whose counts and documents meet in a partition on average.
BLOCK_BYTES, TOGETHER = 2_000_000, 8
#: How byte-level vocabularies of the kind at hand split a text before pairs are merged (a fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with longer runs without a change of kind take the tokenizer itself instead of the rank encoder.
LONG_RUN = 50_000


class Bytes:
    """Side A: ids of a blank and a text, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.table = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            if token not in special:
                self.table[i] = bytes(byte[c] for c in token)
        self.ranks = self._ranks(spec, special)

    def _ranks(self, spec: dict, special: dict) -> tiktoken.Encoding | None:
        """The same vocabulary as a rank encoder; only where pairs are merged in the order of their ids."""
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merged]
        first = spec.get("pre_tokenizer") or {}
        usual = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not spec.get("normalizer")
        if not usual or order != sorted(order) or len(set(order)) < len(order):
            return None
        ranks = {b: i for i, b in enumerate(self.table) if b and i not in special.values()}
        return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or (len(text) > LONG_RUN and max(map(len, text.split(" "))) > LONG_RUN):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


class Pieces:
    """Side B: ids of a text, before which the model puts a blank, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Sides:
    """Both vocabularies with what a block needs of them: lengths in bytes and the decimal texts of ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        self.width_a, self.width_b = (np.array([len(t) for t in s.table], np.int64) for s in (self.a, self.b))
        self.names_a = {end: np.array([f"{i}{end}" for i in range(len(self.a.table))], object) for end in ",|"}
        self.names_b = {end: np.array([f"{i}{end}" for i in range(len(self.b.table))], object) for end in (",", ";", "")}


def sides(path_a: str, path_b: str) -> Sides:
    """One pair of vocabularies for each Python worker."""
    return per_worker(("alignment", path_a, path_b), lambda: Sides(path_a, path_b))


@dataclass
class Block:
    """Tokens of some documents laid end to end: document, id, first byte and byte behind the last, of either side."""

    doc_a: np.ndarray
    id_a: np.ndarray
    start_a: np.ndarray
    end_a: np.ndarray
    doc_b: np.ndarray
    id_b: np.ndarray
    start_b: np.ndarray
    end_b: np.ndarray


def tokens(texts: list[str | None], side: Sides) -> Block:
    """Tokens of the texts that both sides spell out."""
    rows = [i for i, t in enumerate(texts) if t]
    got_b = side.b.ids([texts[i] for i in rows])
    docs, ids_a, ids_b = [], [], []
    bytes_a, bytes_b = side.a.table, side.b.table
    for i, b in zip(rows, got_b, strict=True):
        text = f" {texts[i]}"
        whole = text.encode()
        if b"".join([bytes_b[t] for t in b]) != whole:
            continue
        a = side.a.ids(text)
        if b"".join([bytes_a[t] for t in a]) == whole:
            docs.append(i)
            ids_a.append(a)
            ids_b.append(b)

    def laid(ids: list[list[int]], width: np.ndarray) -> tuple[np.ndarray, ...]:
        doc = np.repeat(np.array(docs, np.int64), [len(x) for x in ids])
        flat = np.concatenate([np.array(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
        end = np.cumsum(width[flat])
        return doc, flat, end - width[flat], end

    return Block(*laid(ids_a, side.width_a), *laid(ids_b, side.width_b))


def overlaps(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens of A and of B that share a byte, pair by pair.

    Tokens of a side follow each other without a gap, so of two that overlap one starts inside the other: the token of B that
    covers a start of A, and the other way round. Pairs that start together are found twice and kept once.
    """
    a = pd.DataFrame({"at": block.start_a, "doc": block.doc_a, "a": np.arange(len(block.doc_a))})
    b = pd.DataFrame({"at": block.start_b, "doc": block.doc_b, "b": np.arange(len(block.doc_b))})
    into_b = pd.merge_asof(a, b, on="at", by="doc")
    into_a = pd.merge_asof(b, a, on="at", by="doc")
    new = block.start_a[into_a["a"].to_numpy(np.int64)] != into_a["at"].to_numpy()
    return tuple(np.concatenate([into_b[x].to_numpy(np.int64), into_a[x].to_numpy(np.int64)[new]]) for x in ("a", "b"))


def links(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of the overlapping tokens that end together, in the order of the text."""
    a, b = overlaps(block)
    same = block.end_a[a] == block.end_b[b]
    a, b = a[same], b[same]
    order = np.lexsort((b, a))
    return a[order], b[order]


def group_texts(block: Block, a: np.ndarray, b: np.ndarray, n: int, side: Sides) -> tuple[np.ndarray, list[str]]:
    """Number of groups and their ids as ``a1,a2|b1;a3|b2,b3`` for each of the n documents."""

    def groups(doc: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each token in the block, and whether it is the last of its group."""
        last = np.zeros(len(doc), bool)
        last[closing] = True
        return np.cumsum(last) - last, last

    in_a, last_a = groups(block.doc_a, a)
    in_b, last_b = groups(block.doc_b, b)
    n_groups = int(last_a.sum())
    of_doc = np.bincount(block.doc_a[last_a], minlength=n)
    size_a, size_b = (np.bincount(x, minlength=n_groups) for x in (in_a, in_b))
    before_b = np.cumsum(size_b) - size_b
    until_a = np.cumsum(size_a)
    parts = np.empty(len(in_a) + len(in_b), object)
    parts[np.arange(len(in_a)) + before_b[in_a]] = np.where(last_a, side.names_a["|"][block.id_a], side.names_a[","][block.id_a])
    closes = np.zeros(len(in_b), bool)
    if len(in_b):
        closes[np.flatnonzero(np.append(np.diff(block.doc_b) != 0, True))] = True
    names = np.where(last_b, side.names_b[";"][block.id_b], side.names_b[","][block.id_b])
    parts[np.arange(len(in_b)) + until_a[in_b]] = np.where(closes, side.names_b[""][block.id_b], names)
    sizes = np.bincount(block.doc_a, minlength=n) + np.bincount(block.doc_b, minlength=n)
    ends = np.cumsum(sizes).tolist()
    every = parts.tolist()
    return of_doc, ["".join(every[e - s : e]) for s, e in zip(sizes.tolist(), ends, strict=True)]


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, where each begins, and how often it stands."""
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], first, np.diff(np.append(first, len(codes)))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Number, doc_ids and texts of the blocks of a partition."""
    base, seq, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            text = text.as_py()
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_BYTES // 100:
                yield base + seq, ids, texts
                seq, ids, texts, size = seq + 1, [], [], 0
    if ids:
        yield base + seq, ids, texts


PER_DOC = ("n_a", "n_b", "n_groups", "n_pairs")
STAGED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((c, pa.binary()) for c in PER_DOC), ("digest", pa.list_(pa.string())), ("at", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
STAGED_DDL = "block long, doc_id array<long>, n_a binary, n_b binary, n_groups binary, n_pairs binary, digest array<string>, at binary, times binary, pairs array<long>, counts array<long>"


def _aligner(path_a: str, path_b: str):
    """Blocks of aligned documents: sizes and digests per document, links per document as places among the block's pairs."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = sides(path_a, path_b)
        for number, ids, texts in _batched(batches):
            n = len(ids)
            block = tokens(texts, side)
            a, b = links(block)
            n_groups, groups = group_texts(block, a, b, n, side)
            pair = block.id_a[a] * len(side.b.table) + block.id_b[b]
            order = np.argsort(pair, kind="stable")  # links stand in the order of documents, and so do those of a pair
            pairs, _, counts = runs(pair[order])
            at = np.empty(len(pair), np.int64)
            at[order] = np.repeat(np.arange(len(pairs)), counts)
            own, _, times = runs(np.sort(block.doc_a[a] * (len(pairs) + 1) + at))
            n_pairs = np.bincount(own // (len(pairs) + 1), minlength=n)
            per_doc = (np.bincount(block.doc_a, minlength=n), np.bincount(block.doc_b, minlength=n), n_groups, n_pairs)
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            columns = [[number], [ids], *([x.astype(np.int32).tobytes()] for x in per_doc), [digest], [(own % (len(pairs) + 1)).astype(np.int32).tobytes()], [times.astype(np.int32).tobytes()], [pairs], [counts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, STAGED, strict=True)], schema=STAGED)

    return align


ALIGNED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from blocks that know the counts of their pairs over the corpus."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            read = {c: np.frombuffer(row[c][0].as_buffer(), np.int32).astype(np.int64) for c in (*PER_DOC, "at", "times")}
            answers = row["answers"].flatten()
            total, best = (answers.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("total", "best"))
            doc = np.repeat(np.arange(len(read["n_a"])), read["n_pairs"])

            def per_doc(values: np.ndarray) -> np.ndarray:
                out = np.zeros(len(read["n_a"]), np.int64)
                np.add.at(out, doc, values)
                return out

            at, times = read["at"], read["times"]
            sums = [per_doc(times), per_doc(times * best[at]), per_doc(times * total[at])]
            columns = [row["doc_id"].flatten(), read["n_a"], read["n_b"], read["n_groups"], *sums, row["digest"].flatten()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ALIGNED, strict=True)], schema=ALIGNED)


def aligned_blocks(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of documents, as `_aligner` makes them."""
    rows = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_aligner(path_a, path_b), STAGED_DDL)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair (id of A times size_b plus id of B), total over the corpus, and whether no id of A is linked to that id of B more often."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = each.groupBy("pair").agg(F.sum("n").alias("total"))
    scratch = Scratch(blocks.sparkSession)
    totals = scratch.stage(totals).withColumn("b", F.col("pair") % size_b)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))  # at most size_b rows, whatever the corpus
    return totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    n_best counts the links that are the most frequent of their id of B, ties included; count_sum adds up, over the links of
    a document, how often their id pair is linked in the corpus.
    """
    spark = documents.sparkSession
    blocks = Scratch(spark).stage(aligned_blocks(documents, path_a, path_b))
    counts = pair_counts(blocks, len(Pieces(path_b).table))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("answers"))
    parts = max(1, -(-blocks.count() // TOGETHER))  # bounds the blocks that a task holds and hands to Python
    rows = blocks.drop("pairs", "counts").repartition(parts, "block").join(answers.repartition(parts, "block").hint("shuffle_merge"), "block", "left")
    rows = rows.withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<place:int,total:bigint,best:bigint>>"))).drop("block")
    return rows.mapInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and the groups of every document in order, each with its ids of A and of B, as text ``a1,a2|b1;a3|b2,b3``."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = sides(path_a, path_b)
        for _, ids, texts in _batched(batches):
            block = tokens(texts, side)
            _, spelled = group_texts(block, *links(block), len(ids), side)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spelled, pa.string())], ["doc_id", "groups"])

    rows = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(spell, "doc_id long, groups string")
