import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import packing
from parley.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def words():
    return packing.Words(tokenizer_path())


def plain(words, text):
    return words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(words):
    rng = random.Random(1)
    parts = [*"aB's tr eveΣσİ¼²½ª­éÉßſ12_-.!?\n\t\r\x01\x02\x1c 漢字😀", "<|endoftext|>", "<|startoftext|>", "don't", "'re", "I'm", "é", "word", "  ", "\n\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(words.encode(text), words.kind).tolist() == plain(words, text)


def test_forgetting_changes_nothing(words, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    text = "some words here and more words there"
    assert np.frombuffer(words.encode(text), words.kind).tolist() == plain(words, text)


def test_curve_visits_every_cell_in_steps_of_one():
    grid = np.array(np.meshgrid(*[np.arange(4)] * 4, indexing="ij")).reshape(4, -1).T
    key = packing.hilbert(grid, 2)
    path = grid[np.argsort(key)]
    assert sorted(key) == list(range(256)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(words, docs, window=packing.WINDOW):
    pieces = packing.pack(docs, tokenizer_path(), window).collect()
    want = sorted(zlib.crc32(np.array([*plain(words, r.text), packing.CLOSING], "<u4").tobytes()) for r in docs.select("text").collect())
    by_sequence, by_doc = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 0 < p.length <= window
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for s in by_sequence.values():
        ends = [0]
        for offset, length in sorted(s):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] == window or ends[-1] & (ends[-1] - 1) == 0
    return pieces, want, by_doc


def test_round_trip(words, documents):
    _, want, by_doc = check(words, documents)
    got = []
    for pieces in by_doc.values():
        pieces.sort(key=lambda p: p.start)
        ids = b"".join(p.ids for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert len(ids) == 4 * pieces[0].doc_tokens
        got.append(zlib.crc32(ids))
    assert sorted(got) == want


def test_odd_rows(words, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 50)
    pieces, _, _ = check(words, odd, window=16)
    lengths = sorted(len(plain(words, r.text)) + 1 for r in odd.collect())
    assert sum(p.length for p in pieces) == sum(lengths)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def closed(words, texts):
    ids, ends = words.closed(pa.array(texts, pa.string()))
    return [i.tolist() for i in np.split(ids, ends)[:-1]]


def test_every_usual_character_alone_and_between_letters(words):
    usual = [chr(c) for c in range(33, 0x180) if c != ord("'") and not 127 <= c < 161]
    texts = [f"{c} a{c}b 1{c}2 {c}{c} .{c}! {c.upper()}x" for c in usual]
    assert closed(words, texts) == [[*plain(words, t), packing.CLOSING] for t in texts]


def test_words_of_a_block_are_encoded_in_one_go(words, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(40)) for _ in range(50)]
    texts[3:3] = ["", "a<|endoftext|>b 漢字\t \n\n don't", " ", "\n"]
    asked, lines = [], []
    real, ranked = words._plain, words.ranked
    monkeypatch.setattr(words, "memory", {})
    monkeypatch.setattr(words, "_plain", lambda some: asked.extend(some) or real(some))
    monkeypatch.setattr(words, "ranked", type("Counted", (), {"encode_ordinary": staticmethod(lambda line: lines.append(line) or ranked.encode_ordinary(line))}))
    want = [[*plain(words, t), packing.CLOSING] for t in texts]
    assert closed(words, texts) == want
    assert len(lines) == 1 and sorted(asked) == ["", "a<|endoftext|>b", "don't", "漢字\t"]
    monkeypatch.setattr(words, "by_word", False)
    assert closed(words, texts) == want


def test_blocks_change_nothing(words, monkeypatch):
    texts = pa.array([None, "one two", "", "three " * 30, None, "four", "x" * 200, ""], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), texts], names=["doc_id", "text"]).slice(1)
    whole = pa.Table.from_batches(packing._encoder(tokenizer_path())([batch])).to_pylist()
    for size in (1, 40, 200):
        monkeypatch.setattr(packing, "BLOCK_BYTES", size)
        parts = list(packing._encoder(tokenizer_path())([batch, batch.slice(0, 0)]))
        assert len(parts) > 1 and pa.Table.from_batches(parts).to_pylist() == whole
    assert [r["doc_id"] for r in whole] == list(range(1, 8))
    for r, text in zip(whole, texts.slice(1).to_pylist(), strict=True):
        assert np.frombuffer(r["ids"], words.kind).tolist() == [*plain(words, text), packing.CLOSING] and r["doc_tokens"] == len(r["ids"]) // 2
