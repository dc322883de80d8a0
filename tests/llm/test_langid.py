import copy

import numpy as np

from parley.llm import langid
from parley.llm.common import fold


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid._start(["a", "b", "c"], rng)
    for name in ("gate_in", "cand_in", "gate", "cand", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    data, lang = rng.integers(97, 105, (4, 7)).astype(np.uint8), rng.integers(0, 3, 4)
    _, grads = langid.gradients(net, data, lang)
    for name, grad in zip(("gate_in", "cand_in", "gate", "cand", "out", "bias"), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        ends = []
        for step in (1e-3, -1e-3):
            other = copy.deepcopy(net)
            getattr(other, name)[at] += step
            ends.append(langid.gradients(other, data, lang)[0])
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[at]) < 1e-3 * max(1, abs(grad[at])) + 1e-4


def test_reader_equals_the_plain_network():
    rng = np.random.default_rng(1)
    net = langid._start(["a", "b"], rng)
    data = rng.integers(0, 256, (3, langid.SEGMENT)).astype(np.uint8)
    plain = langid._softmax(langid.states(net, data) @ net.out + net.bias)
    assert np.abs(langid.Reader(net).labels(data) - plain.transpose(2, 0, 1)).max() < 1e-4
    texts = [data[0].tobytes(), b"", data[1].tobytes() + b"rest"]
    alone = np.vstack([langid.probabilities(net, [t]) for t in texts])
    assert np.abs(langid.probabilities(net, texts) - alone).max() < 1e-6


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(i, f"some words {i}", f"l{i % 70:02d}") for i in range(210)], "doc_id long, text string, lang string")
    texts, langs = langid.sample(df)
    net = langid.train(texts, langs, rounds=1)
    assert net.langs == [f"l{i:02d}" for i in range(70)] and net.out.shape[1] == 70
    assert langid.rounds_for(4) == langid.ROUNDS and langid.rounds_for(70) * langid.BATCH / 70 >= langid.ROUNDS * langid.BATCH / 4
    many = [b"word " * 40] * 500  # more segments than advance together
    assert np.abs(langid.probabilities(net, many) - langid.probabilities(net, many[:1])).max() < 1e-6


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(true) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.97
    marks = {r.doc_id: r["h"] for r in docs.select("doc_id", (fold() == 1).alias("h")).collect()}
    assert all(marks[r.doc_id] == r.held_out for r in rows)


def test_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7)} == {langid.UNKNOWN}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {langid.UNKNOWN}
