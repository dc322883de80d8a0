import random

from parley.llm import decontam

rng = random.Random(9)
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
ITEMS = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(12, 30))) + "? " + " ".join(rng.choices(VOCABULARY, k=4)) + ".") for i in range(150)]


def test_search_equals_exhaustive_scores():
    index = decontam.Index(ITEMS)
    for _ in range(200):
        item = rng.choice(index.items)
        terms = list({index.vocabulary[w] for w in item.words if rng.random() < 0.8} | {rng.randrange(len(index.vocabulary)) for _ in range(30)})
        for threshold in (0.15, 0.3, 0.5):
            scores = {}
            for t in terms:
                for d, w in zip(index.docs[t], index.weights[t]):
                    scores[d] = scores.get(d, 0.0) + w
            want = {d: s for d, s in scores.items() if s >= threshold + 1e-9}
            got = dict(index.search(terms, threshold))
            assert want.keys() <= got.keys() and all(abs(got[d] - scores[d]) < 1e-9 and got[d] >= threshold - 1e-9 for d in got)


def planted(at):
    filler = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    rows = [(i, f"{filler(at)} {text.upper()} {filler(700 - at)}") for i, text in ITEMS[:40]]
    return rows + [(1000 + i, filler(rng.randint(1, 600))) for i in range(40)]


def test_planted_items_are_found_wherever_they_lie(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    for at in (0, 63, 350, 700):
        docs = spark.createDataFrame(planted(at), "doc_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()}
        assert got == {(i, i) for i in range(40)}
    assert sorted(r.doc_id for r in decontam.keep_clean(docs, benchmark).collect()) == list(range(1000, 1040))


def test_shards_give_the_same_result(spark, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(planted(100), "doc_id long, text string")
    # passages about the threshold: some of an item's words, and an item that is longer than those of most shards
    near = [(5000 + i, " ".join(w for w in text.split() if rng.random() < 0.9)) for i, text in ITEMS]
    docs = docs.union(spark.createDataFrame(near, docs.schema))
    benchmark = benchmark.union(spark.createDataFrame([(7777, " ".join(rng.choices(VOCABULARY, k=150)) + ".")], benchmark.schema))
    whole = sorted(map(tuple, decontam.contaminated(docs, benchmark).collect()))
    assert any(d >= 5000 for d, *_ in whole)
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 40)
    assert sorted(map(tuple, decontam.contaminated(docs, benchmark).collect())) == whole


def test_question_without_answer_does_not_count():
    text = "how many books did the old man from the far north carry home? exactly seventeen green volumes."
    index = decontam.Index([*ITEMS, (999, text)])
    number = [i for i, x in enumerate(index.items) if x.item_id == 999][0]
    assert number in index.matches(text)
    assert number not in index.matches(text.split("?")[0])
    assert number not in index.matches(text.split("?")[1])


def test_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "the same text of a few words here"), (4, "the same text of a few words here")], "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.item_id) for r in decontam.contaminated(odd, benchmark).collect())))
    assert got == sorted(map(str, [(d, i) for d in (1, 1, 2, None) for i in (None, 4)]))
    clean = decontam.keep_clean(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4
    assert decontam.keep_clean(odd, benchmark.where("false")).count() == odd.count()
    assert decontam.contaminated(empty, benchmark).count() == 0
