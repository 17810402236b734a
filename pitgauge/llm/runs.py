"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``exponent`` periods long, that no neighbouring word extends. At scale t (a
power of two) a position is synchronising if the least hash among the t + 1 windows of t words from it is the first or the last of them:
that depends on the 2t words from there alone, so both ends of a repetition choose alike. A run with t <= q < 2t and four periods has a
synchronising position whose next equal context, of 2t words, lies exactly q further: such pairs propose periods, and each proposal is
extended word by word. Windows inside runs of a period up to t / 4 choose nothing, or they would choose at every period; their runs are
known from the scales below, and periods under ``SMALLEST`` are found by comparing neighbours.

Why none is missed: let a run with t <= q < 2t begin at a. If all windows of t words from a to a + 2t - 1 lay in such small runs, they
would be one small run of period p <= t / 4 over 3t - 1 words, and as 3t - 1 >= q + p the period of the run would not be q. So one
of the first t positions is synchronising, and it, its context and the same q further fit in 4q words. No nearer position has the same
context, as a block of q words is not a power. Hashes only choose; every run is compared word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from pitgauge.llm.common import append_columns, col, field
from pitgauge.llm.minhash import mix

SMALLEST = 8
LEAST_LENGTH, EXPONENT = 6, 4
NEVER = ~np.uint64(0)
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: str) -> list[bytes]:
    """Words as ASCII white space separates them."""
    return text.encode().split()


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by least values from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, NEVER, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def extend(w: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``s`` and ``s + d`` in which words ``d`` apart are equal: start and end."""
    n = len(w)
    at, step = s, 64
    while at + d < n:
        other = w[at + d:at + d + step]
        differ = np.flatnonzero(w[at:at + len(other)] != other)
        if len(differ):
            at += int(differ[0])
            break
        at, step = at + len(other), min(2 * step, 1 << 16)
    end, at, step = at + d, s, 64
    while at > 0:
        lo = max(0, at - step)
        differ = np.flatnonzero(w[lo:at] != w[lo + d:at + d])
        if len(differ):
            at = lo + int(differ[-1]) + 1
            break
        at, step = lo, min(2 * step, 1 << 16)
    return at, end


def synchronising_set(h: np.ndarray, small: np.ndarray, t: int) -> np.ndarray:
    """Positions chosen at scale ``t`` from the hashes of all windows of ``t`` words; windows flagged ``small`` never are the least."""
    value = np.where(small, NEVER, h >> np.uint64(1))
    least = sliding_min(value, t + 1)
    return np.flatnonzero((least != NEVER) & ((least == value[:len(least)]) | (least == value[t:])))


def find_runs(w: np.ndarray, lengths: Sequence[int], least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of the runs of texts laid one after the other, by start and period.

    ``w`` has a number for each word, and after each text a number that comes nowhere else, so no run leaves its text.
    ``lengths`` are the words of the texts, the longest first: larger scales look at the first texts alone.
    """
    if exponent < 4:
        raise ValueError("runs of fewer than four periods may be missed")
    found: dict[tuple[int, int], int] = {}
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)

    def front(need: int) -> int:
        """End of the texts of at least ``need`` words."""
        k = int(np.searchsorted(-np.asarray(lengths), -need, side="right"))
        return int(ends[k - 1]) if k else 0

    for q in range(1, SMALLEST):
        here = w[:front(max(least, exponent * q))]
        if not len(here):
            break
        start, end = stretches(here[q:] == here[:-q])
        end = end + q
        for i in np.flatnonzero(end - start >= max(least, exponent * q)):
            found.setdefault((int(start[i]), int(end[i])), q)  # smaller periods came first
    t = SMALLEST
    h = mix(w.astype(np.uint64) * _ODD + _ODD)
    k = 1
    while n := front(exponent * t):
        here = w[:n]
        while k <= t:  # hashes of 2, 4, ... words: here up to 2t
            if k == t:
                at_t = h[:n - t + 1]
            h = h[:n - k + 1]
            h = mix(h[:-k] * _ODD + (h[k:] ^ np.uint64(k)))
            k *= 2
        cover = np.zeros(n + 1, dtype=np.int32)
        for (b, e), p in found.items():
            if 4 * p <= t <= e - b and e <= n:
                cover[b] += 1
                cover[e - t + 1] -= 1
        chosen = synchronising_set(at_t, np.cumsum(cover)[:len(at_t)] > 0, t)
        context = h[chosen]
        order = np.argsort(context, kind="stable")
        a, b = chosen[order[:-1]], chosen[order[1:]]
        pair = (context[order[:-1]] == context[order[1:]]) & (b - a >= t) & (b - a < 2 * t)
        a, d = a[pair], (b - a)[pair]
        order = np.lexsort((a, d))
        a, d, i = a[order], d[order], 0
        while i < len(a):
            q, last = int(d[i]), int(np.searchsorted(d, d[i], side="right"))
            begin, end = extend(here, int(a[i]), q)
            if end - begin >= max(least, exponent * q):
                found.setdefault((begin, end), q)
            i += max(1, int(np.searchsorted(a[i:last], end - q)))  # the others of this stretch say the same
        t *= 2
    rows = np.array([(b, e, p) for (b, e), p in found.items()], dtype=np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text, by start and period; starts are word numbers."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    names: dict[bytes, int] = {}
    parts, firsts, first = [], [], 0
    for k, i in enumerate(order):
        for word in set(texts[i]):
            names.setdefault(word, len(names))
        parts += [np.fromiter(map(names.__getitem__, texts[i]), dtype=np.int64, count=len(texts[i])), np.array([-1 - k])]
        firsts.append(first)
        first += len(texts[i]) + 1
    if not order:
        return []
    found = find_runs(np.concatenate(parts), [len(texts[i]) for i in order], least, exponent)
    owner = np.searchsorted(firsts, found[:, 0], side="right") - 1
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for k in np.unique(owner):
        start, end, period = found[owner == k].T
        out[order[k]] = np.stack([start - firsts[k], end - start, period], axis=1)
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside of what runs repeat: of each run its first period stays, unless another run repeats it."""
    if not len(runs):
        return words
    dropped = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0)]


def longest(runs: np.ndarray) -> tuple[int | None, ...]:
    """Start, length, period and exponent (in thousandths) of the longest run; of equal ones the first, then that of the smaller period."""
    if not len(runs):
        return None, None, None, None
    start, length, period = map(int, min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2])))
    return start, length, period, 1000 * length // period


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``runs``: (start, length, period) in words, by start and period, over whole texts.

    Null, empty and wordless texts have none. Repeated rows repeat their runs; a column ``runs`` of ``docs`` is replaced; an
    empty table stays empty. Memory is bounded by a slice of texts or by the longest text.
    """

    def make():
        def run(texts):
            return [[[dict(zip(("start", "length", "period"), r)) for r in found.tolist()] for found in runs_of([words_of(t) for t in texts], least, exponent)]]

        return run

    return append_columns(docs, text, [field("runs", RUNS)], make)


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with each run of a text cut down to one period; words are joined by one space where something was cut, else the text stays as it is."""

    def make():
        def run(texts):
            words = [words_of(t or "") for t in texts]
            return [[t if not len(r) else b" ".join(kept_words(w, r)).decode() for t, w, r in zip(texts, words, runs_of(words, least, exponent))]]

        return run

    return append_columns(docs, text, [field(text, "string")], make, nulls=True).select(*[col(c) for c in docs.columns])


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by crc32 of its id, repeats a part of itself to its end: the rule of the registered query. A null id changes nothing."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def digest_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable = planted) -> DataFrame:
    """One row per document row: ``n_runs``, the longest run (nulls without one) and digests of all runs and of the words that stay.

    ``change(id, words)`` may alter the words first. Null and empty texts have no words; their digests are those of the empty string.
    """

    def make():
        def run(texts, keys):
            words = [change(k, words_of(t)) for k, t in zip(keys, texts)]
            runs = runs_of(words)
            listed = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in r.tolist()).encode()).hexdigest() for r in runs]
            kept = [hashlib.sha256(b" ".join(kept_words(w, r))).hexdigest() for w, r in zip(words, runs)]
            return [[len(r) for r in runs], *map(list, zip(*map(longest, runs))), listed, kept]

        return run

    fields = [field(n, "long") for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [field(n, "string") for n in ("runs_sha256", "collapsed_sha256")]
    return append_columns(docs, text, fields, make, keep=[key], key=key)
