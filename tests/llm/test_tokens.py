"""Token counts, BPE and packing against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitgauge.llm import bpe, packing, token_counts

JSON, RANKS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
REFERENCE = Tokenizer.from_file(JSON)
PARTS = ["a", "aa", "er", "tion", " ", "  ", "\n", "\r\n", "'s", "'ll", "12", "é", "漢", "🙂", "<|endoftext|>", " ", "\t", "!", "..", "\x1c", " ", "the", " the", "́", "x" * 9]


def ids_of(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s))))
def test_backtracking_equals_the_merges(text):
    b = bpe.load(JSON)
    ids = b.encode(text)
    assert ids.tolist() == ids_of(text)
    assert b.decode(ids) == REFERENCE.decode(ids.tolist(), skip_special_tokens=False) == text
    assert token_counts.load(JSON)([text]) == [len(ids)]


def test_long_runs_take_linear_work():
    text = "ab" * 20_000 + " " * 5_000 + "é" * 5_000
    assert bpe.load(JSON).encode(text).tolist() == ids_of(text)


def test_ids_that_form_no_characters():
    ids = [i for i in range(128, 256)]
    assert bpe.load(JSON).decode(np.array(ids)) == REFERENCE.decode(ids, skip_special_tokens=False)


def test_memo_keeps_results_over_generations():
    counter = token_counts.JsonCounter(JSON)
    counter.memo.entries = 3
    texts = [f"w{i} x{i % 4} y z{i}" for i in range(40)]
    assert counter(texts) == [len(ids_of(t)) for t in texts]


def test_odd_rows(odd_docs):
    got = token_counts.count_tokens(odd_docs, JSON).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == 10
    for r in got:
        text = r["text"] or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(ids_of(text)) and r["over_limit"] == (r["n_tokens"] > 1024)
    for r in bpe.round_trip(odd_docs, JSON, keep=["doc_id", "text"]).collect():
        ids = ids_of(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["lossless"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(odd_docs, JSON), JSON)
    assert all((r["text"] or "") == r["decoded"] for r in back.select("text", "decoded").collect())


def test_empty_tables(no_docs):
    assert token_counts.count_tokens(no_docs, JSON).count() == 0
    assert bpe.round_trip(no_docs, JSON).count() == 0
    assert packing.pack_documents(no_docs, RANKS).count() == 0


def test_other_kinds_of_tokenizers(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, None)], "doc_id long, text string")
    assert [r["n_tokens"] for r in token_counts.count_tokens(df, MODEL).orderBy("doc_id").collect()][1] == 0
    word = public_tokenizers.path("word_bpe_49k.json")
    assert not token_counts.load(word).splits
    assert token_counts.count_tokens(df, word).orderBy("doc_id").first()["n_tokens"] == len(Tokenizer.from_file(word).encode("a b  c", add_special_tokens=False).ids)


def plain_best_fit(lengths, size):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k in range(len(rows)) if room[k] >= lengths[i]]
        if fits:
            k = min(fits, key=lambda k: room[k])
        else:
            k = len(rows)
            rows.append([]), room.append(size)
        rows[k].append(i)
        room[k] -= lengths[i]
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_segment_tree_finds_the_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, size) for _ in range(200)]
    rows = packing.best_fit_decreasing(lengths, size)
    assert sorted(i for r in rows for i in r) == list(range(200))
    assert sorted(size - sum(lengths[i] for i in r) for r in rows) == plain_best_fit(lengths, size)


def test_packing_is_lossless(odd_docs):
    size = 256
    rows = packing.pack_documents(odd_docs.repartition(3), RANKS, size=size, shard_tokens=3_000).collect()
    matrix = packing.matrix_of(rows, size)
    found = {}
    for r, ids in zip(rows, matrix):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= size and r["position_resets"] == cu[:-1]
        assert (ids[cu[-1]:] == packing.load(RANKS).pad).all()
        assert [int(p) for p in packing.positions(cu)] == [p for a, b in zip(cu, cu[1:]) for p in range(b - a)]
        for doc, offset, a, b in zip(r["doc_ids"], r["doc_offsets"], cu, cu[1:]):
            found.setdefault((doc, offset), []).append(ids[a:b].tolist())
    assert len({r["row_id"] for r in rows}) == len(rows)
    encode = packing.load(RANKS).encoding.encode_ordinary
    want = {}
    for r in odd_docs.select("doc_id", "text").collect():
        ids = encode(r["text"] or "")
        for k in range(0, len(ids), size):
            want.setdefault((r["doc_id"], k), []).append(ids[k:k + size])
    assert found == want
