import zlib

import numpy as np

import corpus_pipeline
from parley.llm import decontam, neardup, packing, toxicity
from parley.llm.queries import tokenizer_path
from parley.session import stage


def test_every_stage_on_its_own_input(spark, documents, folder):
    docs, seen = documents, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        new = stage(step(spark, docs, folder))
        assert new.columns == documents.columns
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, new))
        assert set(after) <= set(before)
        seen.append((name, before, after, docs))
        docs = new
    stages = {name: (before, after, given) for name, before, after, given in seen}

    before, after, given = stages["toxicity"]
    scored = {r.doc_id: r.predicted for r in toxicity.classify(given, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(after) == {d for d, p in scored.items() if not p}

    before, after, _ = stages["line_dedup"]
    count = {}
    for r in after.values():
        assert set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n")) and r.n_chars == len(r.text)
        for line in set(r.text.lower().split("\n")):
            if len(line.split()) >= 3:
                count[" ".join(line.split())] = count.get(" ".join(line.split()), 0) + 1
    assert max(count.values()) == 1

    before, after, given = stages["near_dedup"]
    assert set(after) == {r.component_id for r in neardup.near_duplicates(given).collect()}

    before, after, given = stages["decontamination"]
    hits = {r.doc_id for r in decontam.contaminated(given, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert set(after) == set(before) - hits

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    words = packing.Words(tokenizer_path())
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == set(after)
    for d, parts in by_doc.items():
        ids = np.array([*words.tokenizer.encode(after[d].text, add_special_tokens=False).ids, packing.CLOSING], "<u4")
        for p in parts:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
