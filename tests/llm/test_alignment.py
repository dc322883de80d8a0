import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from parley.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text as (id, bytes), by the libraries themselves."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    marks = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    marks |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in marks)}
    byte = {c: b for b, c in marks.items()}

    def of(text):
        a = [(i, bytes(byte[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(f" {text}", add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, model.id_to_piece(i)) for i in model.encode(text))]
        return a, b

    return of


def brute(rows, of):
    """All results by a walk over bytes, one document after the other."""
    done, total = [], Counter()
    for doc_id, text in rows:
        a, b = of(text) if text else ([], [])
        whole = f" {text}".encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            done.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, x in a:
            at += len(x)
            ends_a[at] = i
        at = 0
        for i, x in b:
            at += len(x)
            ends_b[at] = i
        common = sorted(ends_a.keys() & ends_b.keys())
        links = [(ends_a[e], ends_b[e]) for e in common]
        total.update(links)
        spelled, low = [], 0
        for e in common:
            spelled.append(",".join(str(i) for p, i in ends_a.items() if low < p <= e) + "|" + ",".join(str(i) for p, i in ends_b.items() if low < p <= e))
            low = e
        done.append((doc_id, len(a), len(b), links, ";".join(spelled)))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, n_a, n_b, links, spelled in done:
        digest = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
        out.append((doc_id, n_a, n_b, len(links), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), digest))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark, documents, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    given = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert rows(alignment.align(df.repartition(5), A, B)) == brute(given, plain)


def test_odd_texts(spark, plain):
    rng = random.Random(4)
    signs = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "语", "日本", "👩‍👩‍👧", "́", "▁", "<s>", "<unk>", "<|endoftext|>", "<0x41>", "'s", "'LL", "7", "١", "\x00", " ", "　", "!?", "ﬁ", "’", "​", "\r\n"]
    given = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    given += [(900, s) for s in signs] + [(901, None), (902, ""), (None, "a null id"), (903, " leading and trailing  "), (904, "x" * 3_000)]
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert rows(alignment.align(df, A, B)) == brute(given, plain)
    spelled = {(r.doc_id, r.groups) for r in alignment.groups(df, A, B).collect()}
    assert (901, "") in spelled and (902, "") in spelled and any(i is None and ";" in g for i, g in spelled)


def test_overlaps_are_all_pairs_that_share_a_byte():
    side = alignment.sides(A, B)
    block = alignment.tokens(["The misaligned tokenizers' naïveté, 12345!", None, "zweites Stück"], side)
    got = set(zip(*(x.tolist() for x in alignment.overlaps(block)), strict=True))
    want = {
        (i, j)
        for i in range(len(block.id_a))
        for j in range(len(block.id_b))
        if block.start_a[i] < block.end_b[j] and block.start_b[j] < block.end_a[i]
    }
    assert got == want and len(alignment.overlaps(block)[0]) == len(want)


def test_repeats_nulls_and_clashing_names(spark, odd, empty, plain):
    given = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    named = odd.selectExpr("*", "1 AS block", "1 AS pairs", "1 AS DOC_ID_A", "1 AS total")
    short = [(i, t) for i, t in given if len(t or "") < 1_000]
    got = rows(alignment.align(named, A, B))
    assert len(got) == len(given)
    assert rows(alignment.align(named.where("text IS NULL OR length(text) < 1000"), A, B)) == brute(short, plain)
    assert alignment.align(empty, A, B).count() == 0


def test_rank_encoder_equals_the_tokenizer():
    side = alignment.Bytes(A)
    assert side.ranks is not None
    for text in [" " * 500, "a" * 2_000, "\n\n \n x", "can't we'll I'D", "x y z", "١٢٣ 4५", "é" * 40, " \t" * 50 + "end"]:
        assert side.ranks.encode_ordinary(text) == side.tokenizer.encode(text, add_special_tokens=False).ids
    run = "ab" * alignment.LONG_RUN
    assert b"".join(side.table[i] for i in side.ids(run)) == run.encode()
