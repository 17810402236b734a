"""Near duplicates by fast similarity sketches, banding and exact verification.

Sketch: in each round every shingle is thrown into one of the bins with a value that grows with the round, and a bin keeps its least
value; after as many rounds as bins, round ``bins + i`` throws everything into bin ``i``, so each bin is filled. Rounds stop once all
bins are: later values are larger. Bins agree with the probability of the Jaccard similarity, and more sharply than
independent hashes would.

Texts with the same set are one class. A class is compared with the leader of the band that it shares most bands with, and that joins
most of a large group at one comparison each. What is still apart within a group of candidates is compared in tiles, whole tiles
against whole tiles, and pairs of one band that no leader brings into one group are compared one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgauge.llm.common import append_columns, col, field, without
from pitgauge.llm.graph import connected_components, forest
from pitgauge.session import cut_lineage

BINS = 200
#: A link at the threshold is missed by the bands with at most this probability.
MISS = 1.3e-7
#: Sets of a tile, and shingles that they may have together: what a tile pair costs in memory does not grow with the texts.
TILE, TILE_SHINGLES = 256, 400_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of a published 64-bit mixer
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, 2 * BINS, dtype=np.uint64) | np.uint64(1)
_VALUE = np.uint64(48)


def band_plan(percent: int) -> tuple[int, int]:
    """Bands and bins of each band: the longest bands that miss a pair at the threshold with a probability of ``MISS`` at most (40 of 5 at 80)."""
    rows = [r for r in range(1, 21) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISS]
    if not rows or not 0 < percent <= 100:
        raise ValueError(f"no plan of {BINS} bins finds similarities of {percent} percent")
    return BINS // max(rows), max(rows)


def least_bits(percent: int) -> int:
    """Sketch bits, one of each bin, that agree at the threshold, less six standard deviations: half of the bins that differ agree by chance."""
    p = (1 + percent / 100) / 2
    return math.ceil(BINS * p - 6 * math.sqrt(BINS * p * (1 - p)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a text; of its whole word sequence if it has fewer words.

    Words are what ASCII white space separates, with A-Z lower-cased.
    """
    parts = text.encode().lower().split()
    if len(memo) > 50_000:
        memo.clear()
    for w in set(parts):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _MIX[1] + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of a set of 64-bit hashes; all rounds of a block are drawn at once, which cannot change a least value."""
    best = np.full(bins, ~np.uint64(0), dtype=np.uint64)
    done, block = 0, max(1, int(1.3 * bins * np.log(bins) / len(items)))
    while done < 2 * bins:
        rounds = np.arange(done, min(2 * bins, done + block))
        if done < bins:
            rounds = rounds[rounds < bins]
        h = mix(items[None, :] ^ _SEEDS[rounds, None])
        value = (rounds.astype(np.uint64)[:, None] << _VALUE) | (h >> (np.uint64(64) - _VALUE))
        place = (h & np.uint64(0xFFFF)) * np.uint64(bins) >> np.uint64(16) if done < bins else np.broadcast_to(rounds[:, None] - bins, h.shape)
        np.minimum.at(best, place.ravel().astype(np.intp), value.ravel())
        done = int(rounds[-1]) + 1
        if best.max() != ~np.uint64(0):
            break
        block *= 2
    return best


def band_keys(best: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A 64-bit key of each band of ``width`` bins."""
    rows = best[:bands * width].reshape(bands, width)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(width):
        out = mix(out * _MIX[0] + rows[:, i])
    return out.view(np.int64)


def sketch_documents(docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, set_hi, set_lo, bands, bits): the digest names the set, ``bits`` are four longs of one bit a bin. Nulls for the empty set."""
    plan = band_plan(percent)

    def make():
        memo: dict[bytes, int] = {}

        def run(texts):
            n, hi, lo, bands, bits = [], [], [], [], []
            for t in texts:
                s = shingle_set(t, words, memo)
                n.append(len(s))
                if not len(s):
                    hi.append(None), lo.append(None), bands.append(None), bits.append(None)
                    continue
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                best = sketch(s)
                flags = np.packbits(np.concatenate([(best >> np.uint64(7)) & np.uint64(1), np.zeros(256 - BINS, np.uint64)]).astype(np.uint8)).view(np.int64)
                hi.append(int(d[0])), lo.append(int(d[1])), bands.append(band_keys(best, *plan)), bits.append(flags)
            return n, hi, lo, pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))

        return run

    fields = [field("n_shingles", "long"), field("set_hi", "long"), field("set_lo", "long"), field("bands", "array<long>"), field("bits", "array<long>")]
    return append_columns(docs.select(col(key).alias("_id"), col(text).alias("_text0")), "_text0", fields, make, keep=["_id"])


def may_link(a: str, b: str, percent: int) -> Column:
    """What can reach the similarity by size (exact) and by agreement of sketch bits."""
    size_a, size_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    same = F.lit(256) - sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4))
    return (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)) & (same >= least_bits(percent) + 256 - BINS)


def full_sets(ids: DataFrame, docs: DataFrame, words: int, key: str, text: str, repeated: DataFrame | None = None) -> DataFrame:
    """(id, shingles) of the given ids, from their texts: one row each, so ``repeated`` ids are cut to one of their equal rows."""
    texts = docs.select(col(key).alias("_id"), col(text).alias("_text0")).join(ids, "_id", "left_semi")
    if repeated is not None:
        once = texts.join(repeated, "_id", "left_semi").groupBy("_id").agg(F.min("_text0").alias("_text0"))
        texts = texts.join(repeated, "_id", "left_anti").unionByName(once)

    def make():
        memo: dict[bytes, int] = {}
        return lambda rows: [pa.array([shingle_set(t, words, memo).view(np.int64) for t in rows], pa.list_(pa.int64()))]

    return cut_lineage(append_columns(texts, "_text0", [field("shingles", "array<long>")], make, keep=["_id"]))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; a hot ``b`` is split by AQE."""
    of_a = pairs.join(sets.select(F.col("_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = of_a.join(sets.select(F.col("_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb") - shared
    return both.where(100 * shared >= percent * total).select("a", "b")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two lists of sets that reach the similarity: their intersections are products of 0/1 matrices, some columns at a time."""
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (left, right)]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    at = [np.searchsorted(common, f) for f in flat]
    hit = [(k < len(common)) & (common[np.minimum(k, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for k, f in zip(at, flat)]
    cells = []
    for side in (0, 1):
        order = np.argsort(at[side][hit[side]], kind="stable")
        cells.append((at[side][hit[side]][order], owner[side][hit[side]][order]))
    for lo in range(0, len(common), columns):
        block = []
        for (column, row), n in zip(cells, (len(left), len(right))):
            i, j = np.searchsorted(column, (lo, lo + columns))
            m = np.zeros((n, columns), dtype=np.float32)
            m[row[i:j], column[i:j] - lo] = 1
            block.append(m)
        shared += block[0] @ block[1].T
    return np.nonzero(100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared))


def tiled_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between what is still apart in a candidate group, as a spanning forest (a, b).

    ``members`` has (rep, n, cand, part). Of each group the largest part is one already, so the other members are compared with all.
    Members are dealt by size into classes, of which only neighbours can be similar enough, and by hash into tiles of
    about ``TILE`` sets or ``TILE_SHINGLES`` shingles; a pair of tiles is one group of rows, and no pair of members becomes a row.
    """
    parts = members.groupBy("cand", "part").agg(F.count(F.lit(1)).alias("k"))
    mains = parts.groupBy("cand").agg(F.max(F.struct("k", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("cand", F.col("main.part").alias("main"))
    by_size = F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    here = cut_lineage(members.join(mains, "cand").select("rep", "cand", "n", (F.col("part") != F.col("main")).alias("apart"), by_size.alias("class")))
    cells = here.groupBy("cand", "class").agg(F.count(F.lit(1)).alias("all"), F.count_if("apart").alias("own"), F.max("n").alias("longest"))
    tiles = lambda c: F.ceil(F.col(c) / F.least(F.lit(TILE), F.ceil(TILE_SHINGLES / F.col("longest"))))
    cells = cells.withColumns({"own_tiles": tiles("own"), "all_tiles": tiles("all")}).drop("longest")
    tile = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    x = cells.where("own > 0").withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_tiles") - 1))).withColumn("cy", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)]))).select("cand", F.col("class").alias("cx"), "tx", "cy")
    y = cells.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_tiles") - 1))).select("cand", F.col("class").alias("cy"), "ty")
    meets = cut_lineage(x.join(y, ["cand", "cy"]))
    placed = here.join(cells, ["cand", "class"]).select("rep", "cand", "class", F.when(F.col("apart"), tile("own_tiles")).alias("tx"), tile("all_tiles").alias("ty"))
    left = placed.where("tx is not null").select("rep", "cand", F.col("class").alias("cx"), "tx").join(meets, ["cand", "cx", "tx"]).select("rep", "cand", "cx", "tx", "cy", "ty", F.lit(0).alias("side"))
    right = placed.select("rep", "cand", F.col("class").alias("cy"), "ty").join(meets, ["cand", "cy", "ty"]).select("rep", "cand", "cx", "tx", "cy", "ty", F.lit(1).alias("side"))
    rows = left.union(right).join(sets.select(F.col("_id").alias("rep"), "shingles"), "rep").withColumn("meet", F.struct("cand", "cx", "tx", "cy", "ty"))

    def compare(table: pa.Table) -> pa.Table:
        side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("shingles")]
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        if not len(at[0]) or not len(at[1]):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = tile_links([sets[k] for k in at[0]], [sets[k] for k in at[1]], percent)
        i, j = rep[at[0][i]], rep[at[1][j]]
        names, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
        top = forest(flat[:len(i)], flat[len(i):], len(names))
        far = np.flatnonzero(top != np.arange(len(names)))
        return pa.table({"a": names[far], "b": names[top[far]]})

    return rows.select("meet", "side", "rep", "shingles").groupBy("meet").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept`` (the smallest id of its component).

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. Null, empty and wordless texts have
    an empty set and stay alone. A repeated id must repeat its text; its rows are all returned. An empty table
    gives an empty result. Other columns are ignored. Bands follow from ``percent`` (``band_plan``): a link at the threshold is missed with a probability
    of 1.3e-7, a nearer one with less; a ``percent`` that the sketch is too small for is an error.
    """
    sketches = cut_lineage(sketch_documents(docs, words, percent, key, text))
    sets = (sketches.where("set_hi is not null").groupBy("set_hi", "set_lo")
            .agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("_id", "n_shingles", "bands", "bits")).alias("x")))
    sets = cut_lineage(sets.select("set_hi", "set_lo", "rep", "copies", F.col("x.n_shingles").alias("n"), "x.bands", *[F.col("x.bits")[i].alias(f"s{i}") for i in range(4)]))
    repeated = cut_lineage(sketches.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"))
    repeated = None if repeated.isEmpty() else repeated
    member = F.struct("rep", "n", "s0", "s1", "s2", "s3")
    rows = sets.select(F.explode("bands").alias("band"), member.alias("m"))
    full = cut_lineage(rows.groupBy("band").agg(F.min("m").alias("lead"), F.max("m.rep").alias("most")).where("lead.rep <> most").select("band", "lead"))
    led = rows.join(full, "band").where("m.rep <> lead.rep").where(may_link("m", "lead", percent))
    pairs = cut_lineage(led.groupBy(F.col("m.rep").alias("a"), F.col("lead.rep").alias("b")).agg(F.count(F.lit(1)).alias("shared")))
    cands = cut_lineage(connected_components(pairs.select("a", "b")))
    shingles = full_sets(ends(pairs), docs, words, key, text, repeated)
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("nb"))).alias("x")).select("a", (-F.col("x.nb")).alias("b"))
    links = cut_lineage(verify(best, shingles, percent))
    parts = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    members = cands.select(F.col("node").alias("rep"), F.col("component").alias("cand")).join(sets.select("rep", "n"), "rep").join(parts, "rep", "left")
    members = cut_lineage(members.select("rep", "n", "cand", F.coalesce("part", "rep").alias("part")))
    links = links.union(cut_lineage(tiled_links(members, shingles, percent)))
    rest = cut_lineage(open_pairs(rows, full, cands, percent))
    if not rest.isEmpty():
        links = links.union(verify(rest, full_sets(ends(rest), docs, words, key, text, repeated), percent))
    parts = cut_lineage(connected_components(links))
    named = sets.join(parts, F.col("rep") == F.col("node"), "left").where("copies > 1 or component <> rep")
    named = named.select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("_id", "n_shingles", "set_hi", "set_lo").join(named, ["set_hi", "set_lo"], "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"), (component == F.col("_id")).alias("kept"))


def open_pairs(rows: DataFrame, full: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of one band that may be linked although their candidate groups differ.

    Bands that are one group are left out before anything meets; the join is on the band and AQE splits hot ones.
    """
    here = rows.join(full.select("band"), "band", "left_semi").withColumn("node", F.col("m.rep"))
    here = here.join(parts, "node", "left").select("band", "m", F.coalesce("component", "node").alias("part"))
    mixed = here.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("band")
    here = cut_lineage(here.join(mixed, "band", "left_semi"))
    x, y = here.select("band", F.col("m").alias("x"), F.col("part").alias("px")), here.select("band", F.col("m").alias("y"), F.col("part").alias("py"))
    met = x.join(y, (x["band"] == y["band"]) & (F.col("px") > F.col("py")) & may_link("x", "y", percent))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component, those with the smallest id. Rows with a null id stay."""
    gone = near_duplicates(docs, words, percent, key, text).where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, col(key) == F.col("_gone"), "left_anti").select(*[col(c) for c in without(docs, [])])
