import random

import numpy as np

from parley.llm import neardup
from parley.llm.common import Scratch


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    have = [(d, sets(t)) for d, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(have):
        for j in range(i):
            b = have[j][1]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                label[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(have):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(s), names.get(find(i)) if s else d) for i, (d, s) in enumerate(have)), key=str)


def check(spark, rows):
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_random_copies_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        rows.append(base)
        rows += [edited(rng, base, rng.randint(0, max(1, len(base) // 16))) for _ in range(rng.randint(0, 5))]
    rng.shuffle(rows)
    check(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])


def test_star_and_chain_of_copies(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    star = [base] + [edited(rng, base, 7) for _ in range(25)]  # alike to the base, hardly to each other
    chain = [[f"c{i}" for i in range(100)]]
    for k in range(9):
        chain.append([f"k{k}_{i}" if 10 * k <= i < 10 * k + 10 else w for i, w in enumerate(chain[-1])])
    rows = [" ".join(w) for w in star + chain]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_repeated_rows_keep_their_links_when_refined(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REFINED", 0)  # every bucket goes on by rare shingles
    monkeypatch.setattr(Scratch, "clear", lambda self, *keep: None)  # no round before has staged the labels
    base = [f"b{i}" for i in range(104)]
    rows = [(k, " ".join(base[:90] + [f"k{k}_{i}" for i in range(14)])) for k in range(2)]  # 86 of 114 shingles
    rows += [(9, " ".join(base[:60] + [f"o{i}" for i in range(44)]))]
    check(spark, rows * 3)


def test_bucket_of_few_classes_is_done_in_one_round(spark, monkeypatch):
    rounds, clear = [], Scratch.clear
    monkeypatch.setattr(neardup, "REFINED", 0)
    monkeypatch.setattr(Scratch, "clear", lambda self, *keep: (rounds.append(keep), clear(self, *keep)))
    rows = [(k, " ".join([f"b{i}" for i in range(100)] + [f"k{k}_{i}" for i in range(20)])) for k in range(16)]  # 96 of 136 shingles
    check(spark, rows)
    assert len(rounds) == 4  # refined, 16 pivots, none left, and the last of near_duplicates


def test_one_set_per_class(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW_IDS", 0)
    rows = spark.createDataFrame([(1, [1], 0), (1, [1], 1), (2, [2], 2), (1, [1], 3)], "cls long, shingles array<long>, row long")
    assert sorted((r.cls, r.shingles) for r in neardup._single(rows, Scratch(spark)).collect()) == [(1, [1]), (2, [2])]


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(spark, rows)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "1", "3", "4", "5", "6", "7", "None"]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_short_texts_and_white_space(spark):
    check(spark, [(1, "A b"), (2, "a\x0bB "), (3, "a b"), (4, "É b"), (5, "é b"), (6, "a b c d"), (7, "a"), (8, " ")])


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.u: r.component for r in neardup.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and got[101] == got[102] == 100


def test_components_of_a_random_graph(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (99, 99)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = neardup.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    assert sorted((r.u, r.component) for r in got) == sorted((n, least) for n, least in label.items() if n != least)
    assert neardup.components(spark.createDataFrame([(1, 1)], "u long, v long"), Scratch(spark)).collect() == []


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for _ in range(200):
        both, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (75, 12, 13))
        one, two = np.sort(np.append(both, a)), np.sort(np.append(both, b))
        assert (neardup.bands(one) == neardup.bands(two)).any()
