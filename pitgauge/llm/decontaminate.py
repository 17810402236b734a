"""Benchmark decontamination: every training passage queries a BM25 index of the test items by block-max WAND.

A weight is divided by its item's whole weight, so a score is the share of an item that a passage covers and one threshold holds for
all items. Items are indexed by octaves of their length; passages are windows of twice the octave, half overlapping, so every
occurrence of an item lies whole in one window, from the first word of a text to the last. All items above the threshold
are retrieved and then verified word for word: question and answer each have to be there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field as plain
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgauge.llm.common import append_columns, col, field

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
BLOCK = 8
SHARD_ITEMS, SHARD_BYTES = 5_000, 32 << 20
GRAM = 3
#: Items of fewer words have to be there as a whole, word after word.
SHORT = 6
FOUND = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,first_word:bigint>>"
COLUMNS = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")
_BLANK = bytes.maketrans(b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII signs separate them."""
    return text.lower().encode().translate(_BLANK).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: the answer is its last sentence, or the last third of a single sentence."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    cut = len(only) - len(only) // 3
    return only[:cut], only[cut:]


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: set[tuple[bytes, ...]], passage: list[bytes]) -> float:
    """Share of the word n-grams of a part that are in the passage; a part without words is there."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    return len(part & {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}) / len(part)


@dataclass
class Octave:
    """Index of the items of up to ``size`` words: postings by term, and the largest weight of each block of items."""

    size: int
    items: list[int] = plain(default_factory=list)
    postings: dict[int, tuple[list[int], list[float]]] = plain(default_factory=dict)
    block_max: dict[int, dict[int, float]] = plain(default_factory=dict)
    top: dict[int, float] = plain(default_factory=dict)
    need: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


@dataclass
class Index:
    terms: dict[bytes, int]
    octaves: list[Octave]
    parts: dict[int, tuple[set, set]]


def build_index(rows: list[tuple[int, str]], frequency: dict[bytes, int], total: int, threshold: float = THRESHOLD, mean: float | None = None) -> Index:
    """Index of a shard of items; ``frequency``, ``total`` and the ``mean`` number of words are those of the items of all shards.

    ``need`` is for skipping blocks of items by whole windows: an item's commonest terms, up to half the threshold, can't carry
    it there alone, so its other terms in a passage have to sum to what is missing. The need of a term and block is its
    largest share of that over the block's items. A block whose needs in a window sum to less than 1 has no item there.
    """
    octaves: dict[int, Octave] = {}
    need: dict[int, dict[tuple[int, int], float]] = {}
    terms: dict[bytes, int] = {}
    parts = {}
    texts = {i: words_of(t) for i, t in rows}
    mean = mean or sum(map(len, texts.values())) / max(1, len(texts))
    for i, text in sorted(rows):
        words = texts[i]
        if not words:
            continue
        parts[i] = tuple(grams(p) for p in split_item(text)) if len(words) >= SHORT else ({tuple(words)},) * 2
        size = 1 << max(3, (len(words) - 1).bit_length())
        o, needs = octaves.setdefault(size, Octave(size)), need.setdefault(size, {})
        tf: dict[bytes, int] = {}
        for w in words:
            tf[w] = tf.get(w, 0) + 1
        weight = {w: float(np.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean))) for w, n in tf.items()}
        whole = sum(weight.values())
        at, common = len(o.items), 0.0
        o.items.append(i)
        for w in sorted(weight, key=lambda w: (-frequency[w], len(w), w)):
            t, v = terms.setdefault(w, len(terms) + 1), weight[w] / whole
            o.postings.setdefault(t, ([], []))[0].append(at)
            o.postings[t][1].append(v)
            blocks = o.block_max.setdefault(t, {})
            blocks[at // BLOCK] = max(blocks.get(at // BLOCK, 0.0), v)
            o.top[t] = max(o.top.get(t, 0.0), v)
            if common + v <= threshold / 2:
                common += v
            else:
                needs[t, at // BLOCK] = max(needs.get((t, at // BLOCK), 0.0), v / (threshold - threshold / 2))
    for size, o in octaves.items():
        cells = sorted(need[size].items())
        start = np.zeros(len(terms) + 2, dtype=np.int64)
        np.add.at(start, [t + 1 for (t, _), _ in cells], 1)
        o.need = np.cumsum(start), np.array([b for (_, b), _ in cells], dtype=np.int64), np.array([v for _, v in cells])
    return Index(terms, [octaves[k] for k in sorted(octaves)], parts)


def block_max_wand(o: Octave, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items that score ``threshold`` or more for the distinct terms of a passage, with their scores.

    Cursors stand on the next item of each term, sorted by item. The pivot is the first at which the terms' largest weights
    reach the threshold; the blocks there are asked next, and a block that can't reach it is left as a whole.
    """
    eps = 1e-9
    cursors = [[o.postings[t][0][0], 0, t] for t in query if t in o.postings]
    out = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            bound += o.top[t]
            if bound >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // BLOCK
        if sum(o.block_max[t].get(block, 0.0) for _, _, t in cursors[:pivot + 1]) < threshold - eps:
            beyond = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                beyond = min(beyond, cursors[pivot + 1][0])
            beyond = max(beyond, item + 1)
            moved = cursors[:pivot + 1]
        else:
            beyond, moved = item, [c for c in cursors if c[0] < item]
            if not moved:
                score = sum(o.postings[t][1][p] for d, p, t in cursors if d == item)
                if score >= threshold - eps:
                    out.append((item, score))
                beyond, moved = item + 1, cursors[:pivot + 1]
        gone = False
        for c in moved:
            items = o.postings[c[2]][0]
            p = c[1]
            while p < len(items) and items[p] < beyond:
                p += 1
            if p == len(items):
                c[2], gone = 0, True
            else:
                c[0], c[1] = items[p], p
        if gone:
            cursors = [c for c in cursors if c[2]]
    return out


def windows(ids: np.ndarray, window: np.ndarray, o: Octave) -> np.ndarray:
    """Windows in which some block of items may reach the threshold.

    ``window`` numbers the step of the octave's size in which each word lies; a window is that step and the next, so a word lies in two.
    Sums the needs of each window's distinct terms by block.
    """
    start, block, value = o.need
    at = np.flatnonzero(start[ids + 1] - start[ids])
    if not len(at):
        return at
    pairs = np.unique(np.concatenate([window[at], window[at] - 1]) * len(start) + np.concatenate([ids[at]] * 2))
    term = pairs % len(start)
    n = start[term + 1] - start[term]
    cell = np.arange(n.sum()) + np.repeat(start[term] - (np.cumsum(n) - n), n)
    blocks = -(-len(o.items) // BLOCK)
    sums = np.bincount(np.repeat(pairs // len(start), n) * blocks + block[cell], weights=value[cell])
    return np.unique(np.flatnonzero(sums >= 1 - 1e-6) // blocks)


def search(texts: list[str], index: Index, threshold: float, overlaps: tuple[float, float]) -> list[list[tuple]]:
    """Of each text its verified items: (item, score, question overlap, answer overlap, first word), the best window of each.

    Windows of all texts are bounded at once: those of each text have numbers of their own, after one that stands for the place before it.
    """
    words = [words_of(t) for t in texts]
    out: list[dict[int, tuple]] = [{} for _ in texts]
    lens = np.array([len(w) for w in words], dtype=np.int64)
    if not index.octaves or not lens.sum():
        return [[] for _ in texts]
    ids = np.concatenate([np.fromiter(map(index.terms.get, w, repeat(0)), dtype=np.int64, count=len(w)) for w in words])
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
    for o in index.octaves:
        steps = -(-lens // o.size) + 1
        base = np.cumsum(steps) - steps
        for k in windows(ids, np.repeat(base, lens) + 1 + place // o.size, o).tolist():
            doc = int(np.searchsorted(base, k, side="right")) - 1
            start = (k - 1 - int(base[doc])) * o.size
            if start < 0:  # the first step alone is in the first window
                continue
            passage = words[doc][start:start + 2 * o.size]
            query = {index.terms[w] for w in passage if w in index.terms}
            for at, score in block_max_wand(o, sorted(query), threshold):
                item, best = o.items[at], out[doc]
                q, a = (overlap(p, passage) for p in index.parts[item])
                if q >= overlaps[0] and a >= overlaps[1] and (item not in best or (score, -start) > (best[item][1], -best[item][4])):
                    best[item] = (item, score, q, a, start)
    return [[best[i] for i in sorted(best)] for best in out]


def shards(items: DataFrame, key: str, text: str, threshold: float) -> Iterator[Index]:
    """Indexes of about ``SHARD_ITEMS`` items or ``SHARD_BYTES`` of text each, so that what is broadcast has a bound however many items there are."""
    rows = items.where(col(key).isNotNull() & col(text).isNotNull()).select(col(key).cast("long").alias("i"), col(text).alias("t")).dropDuplicates(["i"])

    @F.udf(T.ArrayType(T.BinaryType()))
    def distinct_words(t):
        return sorted(set(words_of(t)))

    @F.udf("long")
    def n_words(t):
        return len(words_of(t))

    total, size, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.sum(n_words("t")), F.lit(0))).first()
    n = max(1, -(-total // (SHARD_ITEMS * 4 // 5)), -(-size // (SHARD_BYTES * 4 // 5)))  # items are hashed to shards; a fifth is left for unevenness
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(n))).withColumn("ws", distinct_words("t"))
    counts = keyed.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for shard in range(n):
        own = keyed.where(F.col("shard") == shard)
        held = {bytes(r["w"]): r["df"] for r in counts.join(own.select(F.explode("ws").alias("w")).distinct(), "w").collect()}
        yield build_index([(r["i"], r["t"]) for r in own.select("i", "t").collect()], held, total, threshold, words / max(1, total))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlaps: tuple[float, float] = (OVERLAP, OVERLAP),
                 key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and item found in it: id, ``item_id``, ``score`` (share of the item's BM25 weight), ``question_overlap``,
    ``answer_overlap``, ``first_word`` (of the window).

    Null, empty and wordless texts and items find nothing; an item of fewer than ``SHORT`` words is found where all of them stand together;
    repeated rows repeat their findings; of repeated item ids one row counts.
    No items give no rows. Each shard of items is one pass over the documents, without a shuffle.
    """
    spark = docs.sparkSession
    out = None
    for index in shards(items, item_key, item_text, threshold):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def run(texts):
                return [[[dict(zip(COLUMNS, f)) for f in found] for found in search(texts, shared.value, threshold, overlaps)]]

            return run

        found = append_columns(docs.select(col(key).alias("_id"), col(text).alias("_t")), "_t", [field("found", FOUND)], make, keep=["_id"])
        found = found.select(F.col("_id").alias(key), F.explode("found").alias("f")).select(col(key), *[F.col(f"f.{c}").alias(item_key if c == "item_id" else c) for c in COLUMNS])
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows with a null id stay."""
    hit = contaminated(docs, items, key=key, text=text, **settings).select(col(key).alias("_hit")).distinct()
    return docs.join(hit, col(key) == F.col("_hit"), "left_anti")
