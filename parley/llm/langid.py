"""Language identification by a bidirectional gated recurrent network over bytes.

Text is cut into segments of bytes. A forward and a backward recurrence, each with a gate that mixes the old state with a
candidate, run over a segment; at every position both states together give a probability per language, and a document's
probabilities are the mean over all its positions. The network is trained in numpy by backpropagation through time on
pieces of a bounded, documented sample of labelled documents. A prediction sees nothing but the bytes of the text.

The gate is a clipped line and the candidate x / (1 + |x|): both cheap enough to run over every byte of a corpus. Segments
of many documents advance together, one position per step; memory is bounded by ``TOGETHER`` segments.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all if nothing could be learned; a
null language is no label; a tie goes to the language first in order; repeated rows get equal results; very long texts run
in as many segments as they need. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, pick, share

#: Labelled documents that are sampled per language on average, pieces taken of each, and characters of a piece.
PER_LANG, PIECES, PIECE = 400, 6, 96
#: State of one direction, bytes of a training piece and of a segment, segments that advance together.
HIDDEN, STEPS, SEGMENT, TOGETHER = 8, 64, 128, 1024
ROUNDS, BATCH, LEARN = 260, 192, 0.02
#: Languages that ROUNDS are enough for, and that TOGETHER segments have room for; more take more rounds and fewer segments.
LANGS, WIDE = 4, 16
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of both directions side by side: columns 0 to HIDDEN - 1 run forward, the others backward."""

    langs: list[str]
    gate_in: np.ndarray
    cand_in: np.ndarray
    gate: np.ndarray
    cand: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.gate_in, self.cand_in, self.gate, self.cand, self.out, self.bias]


def _start(langs: list[str], rng: np.random.Generator) -> Network:
    h = 2 * HIDDEN
    own = np.kron(np.eye(2), np.ones((HIDDEN, HIDDEN)))  # a direction sees its own state alone
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(langs, draw(256, h, scale=0.3), draw(256, h, scale=0.8), draw(h, h, scale=0.3) * own.astype(np.float32), draw(h, h, scale=0.4) * own.astype(np.float32), draw(h, len(langs), scale=0.3), np.zeros(len(langs), np.float32))


def _gate(a: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * a + 0.5, 0, 1)


def _soft(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


def _inputs(net: Network, step: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = HIDDEN
    return np.hstack((net.gate_in[step, :h], net.gate_in[back, h:])), np.hstack((net.cand_in[step, :h], net.cand_in[back, h:]))


def states(net: Network, data: np.ndarray, keep: bool = False):
    """States at every position of equally long rows of bytes; with keep, also what the way back needs."""
    n, steps = data.shape
    h = HIDDEN
    held = np.empty((steps, n, 2 * h), np.float32)
    state = np.zeros((n, 2 * h), np.float32)
    trace = []
    for t in range(steps):
        first, second = _inputs(net, data[:, t], data[:, steps - 1 - t])
        a = first + state @ net.gate
        f = _gate(a)
        gated = f * state
        b = second + gated @ net.cand
        c = _soft(b)
        new = state + f * (c - state)
        if keep:
            trace.append((state, a, f, gated, b, c))
        state = new
        held[t, :, :h] = new[:, :h]
        held[steps - 1 - t, :, h:] = new[:, h:]
    return (held, trace) if keep else held


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(net: Network, data: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions, and its gradients by backpropagation through time."""
    n, steps = data.shape
    h = HIDDEN
    held, trace = states(net, data, keep=True)
    p = _softmax(held @ net.out + net.bias)
    loss = float(-np.log(p[:, np.arange(n), lang] + 1e-9).mean())
    d = p
    d[:, np.arange(n), lang] -= 1
    d /= n * steps
    g_out = np.einsum("tnh,tnc->hc", held, d)
    g_bias = d.sum(axis=(0, 1))
    d_held = d @ net.out.T
    g_gate_in, g_cand_in, g_gate, g_cand = (np.zeros_like(x) for x in (net.gate_in, net.cand_in, net.gate, net.cand))
    d_state = np.zeros((n, 2 * h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, a, f, gated, b, c = trace[t]
        d_state[:, :h] += d_held[t, :, :h]
        d_state[:, h:] += d_held[steps - 1 - t, :, h:]
        d_b = d_state * f / (1 + np.abs(b)) ** 2
        d_gated = d_b @ net.cand.T
        d_f = d_state * (c - state) + d_gated * state
        d_a = d_f * 0.25 * ((a > -2) & (a < 2))
        g_cand += gated.T @ d_b
        g_gate += state.T @ d_a
        step, back = data[:, t], data[:, steps - 1 - t]
        for g, x in ((g_gate_in, d_a), (g_cand_in, d_b)):
            np.add.at(g[:, :h], step, x[:, :h])
            np.add.at(g[:, h:], back, x[:, h:])
        d_state = d_state * (1 - f) + d_gated * f + d_a @ net.gate.T
    own = np.kron(np.eye(2), np.ones((h, h))).astype(np.float32)
    return loss, [g_gate_in, g_cand_in, g_gate * own, g_cand * own, g_out, g_bias]


def rounds_for(langs: int) -> int:
    """Rounds in which every language is drawn as often as LANGS are in ROUNDS."""
    return max(ROUNDS, -(-ROUNDS * langs // LANGS))


def train(texts: list[bytes], langs: list[str], rounds: int | None = None, seed: int = 7) -> Network:
    """Adam on random pieces, every language drawn equally often."""
    names = sorted(set(langs))
    rounds = rounds_for(len(names)) if rounds is None else rounds
    rng = np.random.default_rng(seed)
    net = _start(names, rng)
    per_lang = [[np.frombuffer(t, np.uint8) for t, g in zip(texts, langs, strict=True) if g == name and t] for name in names]
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    for k in range(rounds):
        lang = rng.integers(0, len(names), BATCH)
        data = np.full((BATCH, STEPS), 32, np.uint8)
        for i, g in enumerate(lang):
            piece = per_lang[g][rng.integers(len(per_lang[g]))]
            at = rng.integers(0, max(1, len(piece) - STEPS + 1))
            piece = piece[at : at + STEPS]
            data[i, : len(piece)] = piece
        _, grads = gradients(net, data, lang)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = LEARN * (1 - k / rounds) * np.sqrt(1 - 0.99 ** (k + 1)) / (1 - 0.9 ** (k + 1))
        for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


class Reader:
    """The trained network laid out for reading: both directions in one array, the gate's line folded into its weights."""

    def __init__(self, net: Network):
        h = HIDDEN
        sides = [np.hstack((0.25 * net.gate_in[:, s] + 0.5, net.cand_in[:, s])) for s in (slice(h), slice(h, None))]
        self.table = np.ascontiguousarray(np.vstack(sides), np.float32)
        self.gate = np.stack([0.25 * net.gate[:h, :h], 0.25 * net.gate[h:, h:]]).astype(np.float32)
        self.cand = np.stack([net.cand[:h, :h], net.cand[h:, h:]]).astype(np.float32)
        self.out = [net.out[:h].astype(np.float32), net.out[h:].astype(np.float32)]
        self.bias = net.bias

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (language, position, row) of equally long rows of bytes."""
        n, steps = data.shape
        h = HIDDEN
        held = np.empty((2, steps, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        f, c, size = (np.empty_like(state) for _ in range(3))
        columns = data.T.astype(np.int16)
        index = np.empty((2, n), np.int16)
        for t in range(steps):
            index[0] = columns[t]
            np.add(columns[steps - 1 - t], 256, out=index[1])
            x = self.table[index]
            np.matmul(state, self.gate, out=f)
            f += x[:, :, :h]
            np.clip(f, 0, 1, out=f)
            np.multiply(f, state, out=size)
            np.matmul(size, self.cand, out=c)
            c += x[:, :, h:]
            np.abs(c, out=size)
            size += 1
            c /= size
            c -= state
            c *= f
            state += c
            held[0, t], held[1, steps - 1 - t] = state
        logits = (held[0].reshape(-1, h) @ self.out[0] + held[1].reshape(-1, h) @ self.out[1] + self.bias).T.copy()
        np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, steps, n)


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of the probabilities per language, for every text."""
    reader = Reader(net)
    total = np.zeros((len(texts), len(net.langs)))
    length = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), -(-length // SEGMENT))
    whole = np.frombuffer(b"".join(t + b" " * (-len(t) % SEGMENT) for t in texts), np.uint8).reshape(-1, SEGMENT)
    used = np.full(len(whole), SEGMENT)
    last = np.cumsum(-(-length // SEGMENT))[length > 0] - 1
    used[last] = (length[length > 0] - 1) % SEGMENT + 1
    together = max(1, min(TOGETHER, TOGETHER * WIDE // len(net.langs)))
    for a in range(0, len(whole), together):  # the last segment of a text is filled up with blanks that do not count
        b = a + together
        p = reader.labels(whole[a:b])
        if used[a:b].min() < SEGMENT:
            p *= np.arange(SEGMENT)[:, None] < used[a:b][None, :]
        np.add.at(total, owner[a:b], p.sum(axis=1).T)
    return total / np.maximum(1, length)[:, None]


def sample(documents: DataFrame, per_lang: int = PER_LANG) -> tuple[list[bytes], list[str]]:
    """Pieces of about per_lang documents of every language, drawn by a hash of the id."""
    rows = pick(documents, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rates = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count("*")).alias("rate"))
    places = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), F.greatest(F.lit(1), F.length("text") - PIECE + 1)) + 1).cast("int"), F.lit(PIECE)))
    chosen = rows.join(F.broadcast(rates), "lang").where(share("doc_id", seed="language") < F.col("rate")).select("doc_id", "lang", F.explode(F.array_distinct(places)).alias("piece"))
    got = sorted((r.doc_id or 0, r["lang"], r.piece) for r in chosen.collect())
    return [p.encode() for _, _, p in got], [g for _, g, _ in got]


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """documents (doc_id and text) with lang_pred and score."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = np.array([t is not None and net is not None and LETTER.search(t) is not None for t in batch["text"]], bool)
            names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if known.any():
                p = probabilities(net, [t.encode() for t in batch["text"][known]])
                names[known] = np.array(net.langs, object)[p.argmax(axis=1)]
                scores[known] = np.minimum(1.0, p.max(axis=1))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores})

    return documents.select("doc_id", "text").mapInPandas(label, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those not held out."""
    rows = pick(documents, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts, langs = sample(rows.where(fold() != 1))
    net = train(texts, langs) if texts else None
    return predict(rows, net).select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
