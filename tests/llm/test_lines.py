import random
import re
from collections import defaultdict

from parley.llm import lines


def brute(rows):
    """rows of (doc_id, text) -> new texts, by the definition, on sets of strings."""
    spots = []
    for d, text in {(d, t) for d, t in rows if t is not None}:
        for place, line in enumerate(text.split("\n")):
            words = tuple("<*>" if re.search("[0-9]", w) else w for w in line.lower().split())
            if len(words) >= lines.SHORTEST:
                spots.append(((d is not None, d or 0, text), place, words, tuple(line.lower().split())))
    leaves = defaultdict(set)
    for _, _, w, _ in spots:
        leaves[len(w), w[: lines.DEPTH]].add(w)
    template = {}
    for (n, _), members in leaves.items():
        seen = defaultdict(set)
        for w in members:
            for at in range(lines.DEPTH, n):
                if w[at] != "<*>":
                    seen[at, w[at]].add(w)
        for w in members:
            fixed = tuple((at, w[at]) for at in range(lines.DEPTH, n) if len(seen.get((at, w[at]), ())) > 1)
            lead = sum(x != "<*>" for x in w[: lines.DEPTH])
            if n > lines.DEPTH and len(members) > 1 and fixed and len(fixed) + lead >= lines.SIMILAR * n:
                template[w] = (n, w[: lines.DEPTH], fixed)
    docs = defaultdict(set)

    def of(w, plain):  # rows of numbers stand for themselves with their digits
        return template.get(w) or (plain if 2 * w.count("<*>") > len(w) else w)

    for doc, _, w, plain in spots:
        docs[of(w, plain)].add(doc)
    # the first document of a template is the smallest id; ties between texts of one id are not planted here
    drop = defaultdict(set)
    for doc, place, w, plain in spots:
        owners = docs[of(w, plain)]
        if len(owners) > 1 and doc != min(owners):
            drop[doc].add(place)
    out = []
    for d, text in rows:
        gone = drop.get((d is not None, d or 0, text), ())
        out.append((d, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(r.doc_id, r.text) for r in lines.drop_recurring(df).collect()], key=str) == brute(rows)


def test_random_documents_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta", "x1", "22", "eps"])
    common = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(8)]

    def line():
        if rng.random() < 0.6:
            w = rng.choice(common).split()
            if rng.random() < 0.5 and len(w) > 4:
                w[rng.randrange(3, len(w))] = f"w{rng.choice('abcdef')}"
            return "  ".join(w)
        return " ".join(word() + rng.choice("abcd") for _ in range(rng.randint(0, 8)))

    check(spark, [(i, "\n".join(line() for _ in range(rng.randint(0, 7)))) for i in range(60)])


def test_fields_are_generalised(spark):
    rows = [(1, "The server took user bob in at last"), (2, "the server took user eve in at last"), (3, "page 3 of 7\nown line of three"), (4, "page 4 of 9"), (None, "a line of its own"), (5, None), (6, "")]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_recurring(df).collect()}
    assert got[2] == ("", 1) and got[4] == ("", 1) and got[3] == ("page 3 of 7\nown line of three", 0) and got[5] == (None, 0)


def test_long_passages_stay_once(spark, documents):
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"own words of {chr(97 + i)} here{chr(97 + i)}\n{passage}") for i in range(20)]
    out = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out if passage in r.text] == [0]
    assert all(f"own words of {chr(97 + r.doc_id)}" in r.text for r in out)


def test_rows_of_numbers_are_compared_exactly(spark):
    rows = ["2019-03-04 17.5 22", "2021-07-08 3.1 9", "2019-03-04  17.5 22\n1 a 2", "1 b 2\n1 c 2 d 3"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_recurring(df).collect()}
    assert got == {0: rows[0], 1: rows[1], 2: "1 a 2", 3: rows[3]}


def test_variable_leading_words_are_not_fixed(spark):
    rows = [(1, "12 7 3 total north"), (2, "99 1 4 total south"), (3, "the sum 4 of today is seven"), (4, "the sum 5 of today is eight"), (5, "12 7  3 total north")]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.drop_recurring(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_long_lines_without_blanks_recur(spark):
    rows = ["版权所有，未经许可不得转载\nhttps://example.com/legal/terms/of/use\nshort one", "版权所有，未经许可不得转载\nhttps://example.com/legal/terms/of/use\nshort one", "2024年版权所有未经许可不得转载", "2023年版权所有未经许可不得转载", "未经许可\n未经许可"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_recurring(df).collect()}
    assert got == {0: rows[0], 1: "short one", 2: rows[2], 3: rows[3], 4: rows[4]}


def test_odd_rows(odd, empty):
    out = lines.drop_recurring(odd)
    assert len(out.columns) == len(set(out.columns)) and out.count() == odd.count()
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (3, None) in got and (4, "") in got and (None, "the same text of a few words here") in got and (1, "") in got
    rest = lines.keep_rest(odd)
    assert rest.columns == odd.columns and rest.count() == odd.count() - 3
    assert lines.drop_recurring(empty).count() == 0
