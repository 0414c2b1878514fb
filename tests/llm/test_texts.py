import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import chunking, packing, tokenizer

RANKS = tokenizer.read_ranks(f"{tokenizer.TOKENIZER_DIR}/{tokenizer.VOCABULARY}")
MODEL = tokenizer.sentencepiece_model(RANKS)
ENCODER = tokenizer.Encoder(MODEL)
PUBLIC = tiktoken.Encoding("public", pat_str=tokenizer.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "\n\n  x", "a\u0000b", "don't I'LL", "😀👩‍👩‍👧 ﷽", "<|endoftext|>", "▁x <unk> <s>", "é́" * 50, "ab" * 20000, "漢字" * 4000, "  \x85 \x1c", "same", "same"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_public_tokenizer_s(text):
    ids = ENCODER.encode([text])[0]
    assert ids == PUBLIC.encode_ordinary(text)
    assert ENCODER.decode(ids) == text


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_encode(spark):
    got = {r.doc_id: r.ids for r in tokenizer.encode(docs(spark, ODD)).collect()}
    assert got == {i: PUBLIC.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    back = {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(docs(spark, ODD))).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert {r.doc_id: r.n_tokens for r in tokenizer.token_counts(docs(spark, ODD)).collect()} == {i: len(v) for i, v in got.items()}
    assert tokenizer.encode(docs(spark, [])).count() == tokenizer.token_counts(docs(spark, [])).count() == 0


def test_best_fit_against_brute_force():
    rnd = random.Random(5)
    for _ in range(30):
        capacity, most = rnd.randrange(5, 40), rnd.randrange(1, 6)
        bins, open_, number = packing.BestFit(capacity, most), {}, 0
        for _ in range(200):
            size = rnd.randrange(0, capacity + 1)
            got = bins.place(size)
            fits = {k: f for k, f in open_.items() if f >= size}
            if fits:
                least = min(fits.values())
                assert got in fits and fits[got] == least
            else:
                if len(open_) >= most:
                    least = min(open_.values())
                    # which of equally full containers closes is not laid down: follow the operator
                    gone = [k for k in open_ if open_[k] == least and k not in [x for v in bins.free.values() for x in v]]
                    del open_[gone[0]]
                assert got == number
                open_[got], number = capacity, number + 1
            open_[got] -= size
            if open_[got] == 0 and size:
                del open_[got]


def test_pack(spark):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000]), "clash") for i in range(3000)] + [(7, 40, ""), (3001, None, ""), (3002, -5, "")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, shard string").repartition(5)
    out = packing.pack(df, capacity=100, open_bins=16, shards=3)
    rows = out.collect()
    assert sum(r.n_tokens for r in rows) == sum(max(0, s or 0) for _, s, _ in sizes)
    assert packing.containers(out, 100).filter("used > 100").count() == 0
    for i, s, _ in sizes[:300]:
        own = sorted((r.start, r.n_tokens) for r in rows if r.doc_id == i)
        if i != 7:
            assert len(own) == max(1, -(-s // 100)) and sum(n for _, n in own) == s
    assert packing.containers(out, 100).agg(F.avg("unused")).first()[0] < 5
    again = packing.pack(df.repartition(2), capacity=100, open_bins=16, shards=3)
    assert sorted(rows) == sorted(again.collect())
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


TEXT = "One sentence here. And another one, with a clause; all right?\n" * 4


@pytest.mark.parametrize("limit,overlap", [(20, 5), (64, 0), (40, 30)])
def test_split(spark, limit, overlap):
    texts = [*ODD, TEXT, TEXT * 30, "\n\n".join([TEXT] * 5), "word" * 3000, "a" * 9000, "日本語。" * 300, "{'k': [1, 2]}, " * 100]
    rows = chunking.split_texts(docs(spark, texts), limit=limit, overlap=overlap).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece_no)
        ids = PUBLIC.encode_ordinary(t or "")
        assert own[0].start_token == 0 and own[-1].end_token == len(ids)
        back, end, last = "", 0, 0
        for r in own:
            assert r.end_token - r.start_token <= limit
            assert r.start_token + r.overlap_tokens == end
            if r.piece_no:
                assert min(overlap, end) <= r.overlap_tokens <= overlap + 3
            if t is not None:
                assert r.text == t[r.start_char : r.end_char]
                assert PUBLIC.decode(ids[r.start_token : r.end_token]) == r.text
                back += r.text[last - r.start_char :]
            end, last = r.end_token, r.end_char
        assert back == (t or "")
        if len(ids) <= limit:
            assert len(own) == 1 and own[0].text == t


def test_cuts_are_natural(spark):
    rows = chunking.split_texts(docs(spark, ["\n\n".join([TEXT.strip()] * 12)]), limit=150, overlap=10).collect()
    assert {r.boundary for r in rows} == {None, "paragraph"}
    rows = chunking.split_texts(docs(spark, [TEXT.replace("\n", " ") * 5]), limit=60, overlap=10).collect()
    assert {r.boundary for r in rows} <= {None, "sentence"}
    with pytest.raises(ValueError):
        chunking.split_texts(docs(spark, []), limit=10, overlap=9)
    assert chunking.split_texts(docs(spark, [])).count() == 0
