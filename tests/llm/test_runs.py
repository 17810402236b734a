"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitgauge.llm import runs


def plain_runs(words, least=6, exponent=4):
    """Every maximal stretch of every period, kept under its smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((b, e - b, q) for (b, e), q in found.items())


def as_lists(texts):
    return [[tuple(r) for r in found.tolist()] for found in runs.runs_of(texts)]


def noisy_text(rng):
    """Repetitions of repetitions, with cuts and changed words."""
    letters = [bytes([97 + k]) for k in range(rng.choice([1, 2, 3, 26]))]
    out = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 16, 17, 31, 33, 64, 70]))]
        for _ in range(rng.choice([0, 0, 1])):
            block = block * rng.randint(2, 6) + [rng.choice(letters)]
        out += (block * rng.randint(1, 9))[:rng.randint(1, 900)]
        if out and rng.random() < 0.3:
            out[rng.randrange(len(out))] = b"odd"
    return out


@pytest.mark.parametrize("seed", range(30))
def test_equals_the_plain_search(seed):
    rng = random.Random(seed)
    texts = [noisy_text(rng) for _ in range(4)]
    assert as_lists(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=90), max_size=4))
def test_small_alphabets(texts):
    assert as_lists(texts) == [plain_runs(t) for t in texts]


def test_structured_words():
    """Fibonacci and Thue-Morse words and their powers: many repetitions, few long ones."""
    fib = [b"a"], [b"a", b"b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    morse = [bytes([97 + bin(i).count("1") % 2]) for i in range(512)]
    texts = [fib[1], morse, fib[1][:89] * 6, morse[:100] * 5 + morse, [b"a"] * 700 + [b"b"] + [b"a"] * 700]
    assert as_lists(texts) == [plain_runs(t) for t in texts]


def test_sliding_min_and_sets_are_local():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 60, 101, dtype=np.uint64)
    for width in (1, 2, 9, 101):
        assert runs.sliding_min(values, width).tolist() == [min(values[i:i + width]) for i in range(101 - width + 1)]


def test_long_periods_and_long_texts():
    rng = random.Random(4)
    block = [b"%d" % rng.randrange(500) for _ in range(9_000)]
    text = [b"x"] * 5 + block * 4 + block[:7] + [b"y"]
    assert as_lists([text, text[:100], []]) == [[(5, 36_007, 9_000)], [], []]
    assert as_lists([[b"a", b"b"] * 400_000]) == [[(0, 800_000, 2)]]


def test_smallest_exponent_is_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.arange(5), [4], exponent=3)


def plain_row(key, text):
    words = (text or "").encode().split()
    h, n = (1 if key is None else zlib.crc32(str(key).encode())), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    s, m, q = top[0] if top else (None, None, None)
    return (key, len(found), s, m, q, 1000 * m // q if top else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_equals_brute_force(spark):
    from pitgauge.llm.queries import QUERIES

    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    small = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) < 1_500}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got) > 5
    assert sorted(r for r in got if r[0] in small) == sorted(plain_row(k, t) for k, t in small.items())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 1_000), key=str)
    got = [tuple(r) for r in runs.digest_runs(odd_docs).collect()]
    assert len(got) == len(rows)
    assert [r for r in sorted(got, key=str) if r in want] == want
    repeated = [r for r in got if r[0] == 6]
    assert repeated[0][1:6] == (1, 0, 30_000, 1, 30_000_000)
    cut = {r["doc_id"]: r["text"] for r in runs.collapse_runs(odd_docs).collect()}
    assert cut[6] == "word" and cut[3] is None and cut[2] == "" and cut[5] == " \n\t "
    assert runs.collapse_runs(odd_docs).columns == odd_docs.columns
    listed = {r["doc_id"]: r["runs"] for r in runs.periodic_runs(odd_docs).select("doc_id", "runs").collect()}
    assert [tuple(x) for x in listed[6]] == [(0, 30_000, 1)] and listed[3] == []
    assert runs.digest_runs(no_docs).count() == 0 and runs.periodic_runs(no_docs).count() == 0
