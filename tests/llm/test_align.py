"""Tokenizer alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitgauge.llm import align
from pitgauge.llm.bpe import stand_ins

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
A.encode_special_tokens = True
NAMES = {i: t for t, i in A.get_vocab(with_added_tokens=False).items()}
PARTS = ["a", "er", "tion", "straße", " ", "  ", "   ", "\n", "\r\n", "\t", "'s", "12", "2024", "é", "漢字", "🙂", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", " ", "　", "\x1c", "!", "...", "the", " the", "́", "x" * 9, "\x00", "ﬁ"]


def plain(text):
    """Tokens with byte ranges of both sides, links and groups of a whole text, by loops."""
    if not text:
        return [], [], [], []
    whole, byte = (" " + text).encode(), stand_ins()
    sides = []
    for ids, spell in ((A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in NAMES[i])),
                       (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spell(i))))
            at = side[-1][2]
        if b"".join(spell(i) for i in ids) != whole:
            return [], [], [], []
        sides.append(side)
    a, b = sides
    links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = [([i for i, _, e in a if lo < e <= hi], [i for i, _, e in b if lo < e <= hi]) for lo, hi in zip([0, *ends], ends)]
    return a, b, links, groups


def plain_rows(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links) of each text, counts over all of them."""
    found = [plain(t) for t in texts]
    count = Counter(x for _, _, links, _ in found for x in links)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for a, b, links, groups in found:
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(listed.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_segments_equal_whole_texts(text):
    a, b, links, groups = plain(text)
    aligner = align.load(JSON, MODEL)
    out = [c[0] for c in aligner([text])]
    assert out[:5] == [len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups)]
    assert dict(zip(out[6].tolist(), out[7].tolist())) == Counter(i * aligner.size[1] + j for i, j in links)


def test_chunks_and_blocks_equal_whole_texts(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += ["a bad ▁ sign " * 9, "ok"]
    aligner = align.load(JSON, MODEL)
    whole = aligner(texts)
    monkeypatch.setattr(align, "BLOCK_BYTES", 200)
    monkeypatch.setattr(align.chunks, "__defaults__", (7,))
    assert max(map(len, map(align.chunks, texts))) > 5 and all(" " + " ".join(align.chunks(t)) == " " + t for t in texts)
    for a, b in zip(whole, aligner(texts)):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert [c[-2] for c in whole[:5]] == [0] * 5 and whole[0][-1] > 0


def test_both_libraries_give_the_same_ids():
    fast = align.load(JSON, MODEL).encode_a
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(40)) for _ in range(50)]
    assert [x.tolist() for x in fast(texts)] == [A.encode(t, add_special_tokens=False).ids for t in texts]


def dense(m):
    out = np.zeros((m.rows, m.columns), dtype=np.int64)
    for i in range(m.rows):
        np.add.at(out[i], m.index[m.start[i]:m.start[i + 1]], m.value[m.start[i]:m.start[i + 1]])
    return out


@pytest.mark.parametrize("seed", range(8))
def test_products_of_compressed_rows(seed):
    rng = np.random.default_rng(seed)

    def some(rows, columns):
        cells = [np.sort(rng.choice(columns, rng.integers(0, columns + 1), replace=False)) for _ in range(rows)]
        start = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
        return align.Csr(start, np.concatenate(cells).astype(np.int64), rng.integers(1, 9, start[-1]), columns)

    a, b = some(7, 5), some(5, 9)
    product = align.gustavson(a, b)
    assert (dense(product) == dense(a) @ dense(b)).all()
    assert (dense(a.transpose()) == dense(a).T).all() and (dense(a.part(2, 5)) == dense(a)[2:5]).all()
    assert all((np.diff(product.index[s:e]) > 0).all() for s, e in zip(product.start, product.start[1:]))


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_overlap_and_group_links(block):
    rng = random.Random(block)
    for _ in range(20):
        n = rng.randint(1, 40)
        a, b = (np.array(sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))})) for _ in range(2))
        spans = [list(zip([0, *e[:-1]], e)) for e in (a, b)]
        want = [(i, j, min(e, v) - max(s, u)) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(*(x.tolist() for x in align.overlap_links(a, b, block)))) == want
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        group = lambda e: sum(x < e for x in shared)
        links = dense(align.group_links(a, b))
        assert links.tolist() == [[int(group(e) == group(v)) for v in b] for e in a]


def test_corpus_counts_both_ways(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["the the the"] * 20 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {k: row for k, row in enumerate(plain_rows(texts))}
    for most in (align.BROADCAST_PAIRS, 5):
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align_documents(docs, JSON, MODEL, broadcast_pairs=most).collect()}
        assert got == want


def test_query_equals_brute_force(spark):
    from pitgauge.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in docs if len(r["text"]) < 3_000]
    assert len(got) == len(docs) and len(short) > 100
    for r, row in zip(short, plain_rows([r["text"] for r in short])):
        have = got[r["doc_id"]]
        assert have[:4] == row[:4] and have[6:] == row[6:] and have[5] >= row[5]  # counts grow with the documents left out here


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = align.align_documents(odd_docs, JSON, MODEL).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_a"] == by[2]["n_a"] == by[2]["count_sum"] == 0 and by[3]["groups_sha256"] == ""
    assert by[4]["n_groups"] > 0 and by[6]["n_a"] == 30_001 == by[6]["n_links"]
    assert by[5]["n_links"] > 0
    kept = align.alignments(odd_docs, JSON, MODEL)
    assert {"a.b", "text", "pair", "groups_sha256"} <= set(kept.columns) and kept.count() == len(rows)
    for most in (align.BROADCAST_PAIRS, -1):
        assert align.align_documents(no_docs, JSON, MODEL, broadcast_pairs=most).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["n_best"] for r in align.align_documents(empty, JSON, MODEL).collect()] == [0, 0]
