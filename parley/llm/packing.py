"""Packing along a space-filling curve.

Every document becomes token ids and a hashed vector: each id has a fixed sign in a few dimensions, drawn from a hash, and
the vector is the mean over the document, squeezed into a small grid. The Hilbert curve through that grid orders documents
so that neighbours on it are alike. Documents are range-partitioned and sorted by their place on the curve and laid end to
end; the line is cut every ``window`` tokens. A document is cut only where a window ends. The rest at the end of a range
is cut into lengths that are powers of two, a window of its own each, so that nothing is padded.

Ids are staged with their place on the curve (compressed, two bytes an id where the vocabulary allows), so a document is
read once and moves once. Texts are encoded in blocks, each distinct word of a block once. Ties on the curve go by doc_id
and then by row, so equal documents spread over ranges.

Defined results: a null text counts as empty and gives the closing id alone; a null doc_id is kept; repeated rows are
packed each; an empty table gives no piece; very long texts take as many windows as they need. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm.common import per_worker, pick
from parley.session import staging_root

WINDOW = 2048
#: Id that closes a document.
CLOSING = 1
#: Dimensions of the hashed vector and bits of the grid in each.
DIMS, BITS = 4, 8
#: Tokens that a range holds on average.
RANGE_TOKENS = 4_000_000
#: Bytes of text encoded at once (a longer text stands alone): each of their words is looked at once.
BLOCK_BYTES = 8_000_000
#: Unusual words whose ids a worker remembers; then it starts anew.
REMEMBERED = 300_000
#: Words of these characters are split in the same way by both libraries; others take the plain path.
USUAL = "^[!-&(-~¡-¬®-±´-¸º»¿-ſ]+$"
#: What the tokenizer takes apart in a usual word, after lower-casing.
PARTS = r"\p{L}+|[0-9]|[^\p{L}0-9 ]+"
#: The word end, and what stands between words that are encoded together: no usual word contains them.
ENDED, BETWEEN = "\x01", "\x02"


class Words:
    """Ids of texts by the words between blanks, each distinct word of a block of texts encoded once.

    For a vocabulary of pieces with word ends, whose splitting never joins what a blank separates, the ids of a text are
    those of its words. Usual words go through the rank-based encoder with the word end as a closing byte; the rest, and any
    other kind of vocabulary, through the tokenizer itself, and the ids of the rest are remembered.
    """

    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._by_word(spec)
        self.wide = max(spec["model"]["vocab"].values() if isinstance(spec["model"]["vocab"], dict) else [1 << 16], default=0) >= 1 << 16 or any(t["id"] >= 1 << 16 for t in spec.get("added_tokens") or [])
        self.kind = np.uint32 if self.wide else np.uint16
        self.memory: dict[str, bytes] = {}
        self.ranked = self._ranked(spec) if self.by_word else None
        self.between = self.ranked.encode_ordinary(BETWEEN + ENDED)[0] if self.by_word else -1
        self.marks = [t["content"] for t in spec.get("added_tokens") or []]

    def _by_word(self, spec: dict) -> bool:
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return spec["model"].get("end_of_word_suffix") == "</w>" and normal == ["NFC", "Replace", "Lowercase"] and parts[:1] == [self.SPLIT]

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {}
        for piece, i in spec["model"]["vocab"].items():
            ends = i >= 256 and piece.endswith("</w>")
            ranks[bytes(byte[c] for c in (piece[:-4] if ends else piece)) + ENDED.encode() * ends] = i
        return tiktoken.Encoding("pieces", pat_str=f"[^{ENDED} ]+{ENDED}", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, words: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in words]

    def _ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and the start and number of those of each word.

        The usual words are encoded together, a mark that none contains between them.
        """
        usual = pc.match_substring_regex(words, USUAL)
        for m in self.marks:
            usual = pc.and_not(usual, pc.match_substring(words, m))
        rest = words.filter(pc.invert(usual)).to_pylist()
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = [w for w in rest if w not in self.memory]
        self.memory.update(zip(new, self._plain(new), strict=True))
        ids, lengths = [self.memory[w] for w in rest], np.zeros(len(words), np.int64)
        usual = usual.to_numpy(zero_copy_only=False)
        lengths[~usual] = [len(i) // np.dtype(self.kind).itemsize for i in ids]
        ids = np.frombuffer(b"".join(ids), self.kind)
        if usual.any():
            line = pa.ListArray.from_arrays([0, int(usual.sum())], words.filter(pa.array(usual)))
            line = pc.binary_join(line, f" {BETWEEN} ")[0].as_py().lower()
            line = pc.replace_substring_regex(pa.array([line], pa.large_string()), PARTS, rf"\0{ENDED}")[0].as_py()
            found = np.array(self.ranked.encode_ordinary(line), self.kind)
            ends = np.flatnonzero(found == self.between)
            lengths[usual] = np.diff(ends, prepend=-1, append=len(found)) - 1
            ids = np.append(ids, found[found != self.between])
        order = np.concatenate([np.flatnonzero(~usual), np.flatnonzero(usual)])
        starts = np.empty_like(lengths)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return ids, starts, lengths

    def closed(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the id that closes it, and where each text ends."""
        if not self.by_word:
            each = [i + self.kind(CLOSING).tobytes() for i in self._plain(texts.to_pylist())]
            return np.frombuffer(b"".join(each), self.kind), np.cumsum([len(i) // np.dtype(self.kind).itemsize for i in each], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids, starts, lengths = self._ids(words.dictionary)
        until = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        at = np.insert(words.indices.to_numpy(), until, len(starts))  # the closing id is one more word
        starts, lengths = np.append(starts, len(ids)), np.append(lengths, 1)
        ends = np.cumsum(lengths[at])
        take = np.repeat(starts[at] - ends + lengths[at], lengths[at]) + np.arange(ends[-1] if len(ends) else 0)
        return np.append(ids, self.kind(CLOSING))[take], ends[until + np.arange(len(until))]

    def encode(self, text: str) -> bytes:
        return self.closed(pa.array([text], pa.string()))[0][:-1].tobytes()


def signs(ids: np.ndarray) -> np.ndarray:
    """A fixed sign per id and dimension, from a multiplicative hash."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2 ** bits, one row each."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the curve, from the coarsest cell down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swapped)
            x[i] ^= swapped
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def blocks(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches that begin within the same BLOCK_BYTES."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // BLOCK_BYTES
    first = np.flatnonzero(np.diff(block, prepend=-1))
    yield from zip(first.tolist(), np.diff(first, append=len(block)).tolist(), strict=True)


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(("words", path), lambda: Words(path))  # with the ids of the unusual words met so far
        table = per_worker(("signs", words.wide), lambda: signs(np.arange(1 << (20 if words.wide else 16))).astype(np.int32).T.copy())
        for batch in batches:
            texts = batch["text"].cast(pa.string()).fill_null("")
            for first, n in blocks(texts):
                ids, ends = words.closed(texts.slice(first, n))
                length = np.diff(ends, prepend=0)
                sums = np.stack([np.add.reduceat(t[ids], ends - length) for t in table], axis=1)
                mean = (sums / length[:, None]).astype(np.float32)
                grid = np.clip((0.5 + 0.5 * np.tanh(4 * mean)) * (1 << BITS), 0, (1 << BITS) - 1)
                bounds = np.append(0, ends * ids.itemsize).astype(np.int64)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                columns = [batch["doc_id"].slice(first, n), pa.array(hilbert(grid)), pa.array(length), binary.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "curve", "doc_tokens", "ids"])

    return encode


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def cuts(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents laid end to end: document, start in it, length, sequence, offset in the sequence.

    Sequences end at each multiple of the window; what is left at the end is cut into powers of two, largest first.
    """
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    bounds = list(range(0, total, window)) + [total]
    if len(rest := bounds[-2:]) == 2 and 0 < (left := rest[1] - rest[0]) < window:
        bounds, at = bounds[:-1], rest[0]
        while left:
            at += 1 << (left.bit_length() - 1)
            left -= 1 << (left.bit_length() - 1)
            bounds.append(at)
    bounds = np.array(bounds)
    points = np.unique(np.concatenate([bounds, ends]))
    begin, length = points[:-1], np.diff(points)
    doc = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(bounds, begin, side="right") - 1
    return doc, begin - (ends - lengths)[doc], length, sequence, begin - bounds[sequence]


def _packer(window: int, wide: bool):
    """Lays the sorted documents of a range end to end. Holds one stretch of windows at a time."""
    kind = np.uint32 if wide else np.uint16

    def stretch(docs: list[tuple], first: int, base: int, last: bool) -> tuple[pa.RecordBatch, list[tuple], int]:
        """Pieces of all full windows (of everything, if last); the documents that remain; sequences used."""
        lengths = np.array([len(d[3]) for d in docs])
        whole = int(lengths.sum()) if last else int(lengths.sum()) // window * window
        ends = np.cumsum(lengths)
        n = int(np.searchsorted(ends, whole)) + 1
        taken = lengths[:n].copy()
        taken[-1] -= int(ends[n - 1]) - whole
        doc, start, length, sequence, offset = cuts(taken, window)
        rows = [docs[i] for i in doc]
        ids = [r[3][s : s + m].astype("<u4").tobytes() for r, s, m in zip(rows, start.tolist(), length.tolist(), strict=True)]
        columns = [[r[0] for r in rows], [r[2] + s for r, s in zip(rows, start.tolist(), strict=True)], length, [r[1] for r in rows], base + first + sequence, offset, ids]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)
        rest = docs[n:]
        if int(ends[n - 1]) > whole:
            d = docs[n - 1]
            rest = [(d[0], d[1], d[2] + int(taken[-1]), d[3][taken[-1] :]), *rest]
        return out, rest, int(sequence[-1]) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        first, docs, held = 0, [], 0
        for batch in batches:
            for doc_id, n, ids in zip(batch["doc_id"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["ids"], strict=True):
                docs.append((doc_id, n, 0, np.frombuffer(ids.as_buffer(), kind)))
                held += n
                if held >= 64 * window:
                    out, docs, used = stretch(docs, first, base, last=False)
                    first, held = first + used, sum(len(d[3]) for d in docs)
                    yield out
        if held:
            yield stretch(docs, first, base, last=True)[0]

    return pack


def encoded(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, place on the curve, number of ids and the ids themselves, staged in the shared folder."""
    spark = documents.sparkSession
    rows = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.mapInArrow(_encoder(tokenizer), "doc_id long, curve long, doc_tokens long, ids binary")
    path = f"{staging_root(spark)}/stage-{uuid.uuid4().hex}"
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id long, curve long, doc_tokens long, ids binary, row long").parquet(path)


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, and ids as unsigned 32-bit numbers."""
    rows = encoded(documents, tokenizer)
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_TOKENS))
    along = rows.repartitionByRange(ranges, "curve", "doc_id", "row").sortWithinPartitions("curve", "doc_id", "row")
    wide = Words(tokenizer).wide
    return along.select("doc_id", "doc_tokens", "ids").mapInArrow(_packer(window, wide), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
