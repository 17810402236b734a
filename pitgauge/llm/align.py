"""Alignment of two tokenizers by sparse token-byte incidence matrices in compressed rows.

A matrix has a row for each token and a column for each byte of the text; B is turned over, so the product A·Bᵀ, taken row by row
(Gustavson: each entry of a row of A brings in the row of Bᵀ that it names, and equal columns are summed), has the tokens that share
bytes, and how many. Offsets where tokens of both end cut the text into groups; the product of the token-group matrices links all tokens of a group.

Long texts are cut before a single space between visible characters: a token of neither kind crosses such a place, so the tokens, groups
and links of a chunk are its own, and many chunks are one product. Links are counted over the whole corpus in a second step,
on pairs of ids: the vocabularies bound them. Counts are broadcast below a checked number of pairs and joined beyond it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitgauge.llm.bpe import PATTERN, gather, offset_table, stand_ins
from pitgauge.llm.common import append_columns, col, field
from pitgauge.session import cut_lineage

SAFE = re.compile(r"(?<! ) (?=\S)").search
CHUNK, BLOCK_BYTES, BLOCK_PAIRS = 32 << 10, 1 << 20, 1 << 20
#: Id pairs up to which counts are broadcast: 13 to 17 bytes each.
BROADCAST_PAIRS = 3_000_000
_LOADED: dict[tuple[str, str], "Aligner"] = {}


@dataclass
class Csr:
    """A sparse matrix in compressed rows: row ``i`` has columns ``index[start[i]:start[i + 1]]`` and their values."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def transpose(self) -> "Csr":
        order = np.argsort(self.index, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.index, minlength=self.columns))])
        return Csr(start, np.repeat(np.arange(self.rows), np.diff(self.start))[order], self.value[order], self.rows)

    def part(self, lo: int, hi: int) -> "Csr":
        a, b = self.start[lo], self.start[hi]
        return Csr(self.start[lo:hi + 1] - a, self.index[a:b], self.value[a:b], self.columns)


def incidence(ends: np.ndarray, columns: int) -> Csr:
    """Tokens by bytes, or groups by tokens: row ``i`` holds the columns from the end of row ``i - 1`` to ``ends[i]``."""
    return Csr(np.concatenate([[0], ends]), np.arange(columns), np.ones(columns, dtype=np.int64), columns)


def gustavson(a: Csr, b: Csr) -> Csr:
    """The product a·b by rows: what the entries of a row name in ``b`` is strung together, and equal columns are summed."""
    width = np.diff(b.start)[a.index]
    total = int(width.sum())
    taken = np.arange(total) + np.repeat(b.start[a.index] - (np.cumsum(width) - width), width)
    row = np.repeat(np.repeat(np.arange(a.rows), np.diff(a.start)), width)
    column, value = b.index[taken], np.repeat(a.value, width) * b.value[taken]
    cell = row * b.columns + column
    if total and (np.diff(cell) < 0).any():
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if total else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(value, first) if total else value
    cell = cell[first]
    start = np.concatenate([[0], np.cumsum(np.bincount(cell // max(1, b.columns), minlength=a.rows))])
    return Csr(start, cell % max(1, b.columns), sums, b.columns)


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray, block: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B that share bytes, and how many: the entries of A·Bᵀ, some rows at a time."""
    n = int(a_ends[-1]) if len(a_ends) else 0
    a, bt = incidence(a_ends, n), incidence(b_ends, n).transpose()
    out, lo = [], 0
    while lo < a.rows:
        hi = max(lo + 1, int(np.searchsorted(a.start, a.start[lo] + block, side="right")) - 1)
        product = gustavson(a.part(lo, hi), bt)
        out.append((np.repeat(np.arange(lo, hi), np.diff(product.start)), product.index, product.value))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def group_matrices(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[Csr, Csr]:
    """Token-group matrices of both sides; a group ends where tokens of both do."""
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    sides = []
    for ends in (a_ends, b_ends):
        sides.append(Csr(np.arange(len(ends) + 1), np.searchsorted(shared, ends), np.ones(len(ends), dtype=np.int64), len(shared)))
    return sides[0], sides[1]


def group_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """All token pairs of the same group: the product of the token-group matrices. Its size is the sum of products of group sizes."""
    a, b = group_matrices(a_ends, b_ends)
    return gustavson(a, b.transpose())


def chunks(text: str, least: int = CHUNK) -> list[str]:
    """Space and text, cut at the first safe place after each ``least`` characters; each chunk without the space that it begins with."""
    out, lo = [], 0
    while (m := SAFE(text, lo + least)) is not None:
        out.append(text[lo:m.start()])
        lo = m.end()
    return [*out, text[lo:]]


def byte_encoder(path: str, vocab: dict[str, int], byte: dict[str, int]):
    """texts -> arrays of ids of a byte-level file, special strings being text; and the bytes of its tokens.

    Where ids follow the order of the merges the faster of two public libraries gives the same ids; otherwise it is the file's own.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spelled = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
    ids = {d: i for i, d in spelled.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    plain = all(ids.get(bytes(byte[c] for c in x + y)) == 256 + k for k, (x, y) in enumerate(merges)) and len(ids) == 256 + len(merges)
    pre = spec.get("pre_tokenizer") or {}
    if plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        import tiktoken

        encode = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary
        return (lambda texts: [np.array(encode(t), dtype=np.int64) for t in texts]), spelled
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    return (lambda texts: [np.array(e.ids, dtype=np.int64) for e in own.encode_batch_fast(texts, add_special_tokens=False)]), spelled


class Document:
    """What the chunks of a text have come to."""

    def __init__(self):
        self.counts, self.digest, self.pairs, self.good = np.zeros(5, dtype=np.int64), hashlib.sha256(), [], True

    def row(self, kind) -> tuple:
        if not self.good or not self.counts[0]:
            return 0, 0, 0, 0, 0, "", np.zeros(0, kind), np.zeros(0, np.int32)
        pairs, times = self.pairs[0]
        if len(self.pairs) > 1:
            pairs, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([t for _, t in self.pairs])).astype(np.int64)
        return *self.counts.tolist(), self.digest.hexdigest(), pairs.astype(kind), times.astype(np.int32)


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        vocab, byte = Tokenizer.from_file(byte_path).get_vocab(with_added_tokens=False), stand_ins()
        self.encode_a, spelled = byte_encoder(byte_path, {t: i for t, i in vocab.items() if all(c in byte for c in t)}, byte)
        a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("the piece vocabulary has pieces across spaces")
        self.tables = offset_table(a_bytes), offset_table(b_bytes)
        self.size = len(a_bytes), len(b_bytes)
        self.pair_type = np.dtype("int32" if self.size[0] * self.size[1] < 1 << 31 else "int64")
        self.listed = offset_table([b"%d%c" % (i, c) for i in range(max(self.size)) for c in b",|;"])

    def block(self, parts: list[str], owners: list[Document]) -> None:
        """Align chunks, and add each to its document; chunks of one document are neighbours."""
        raw = [(" " + p).encode() for p in parts]
        sides = self.encode_a([" " + p for p in parts]), [np.array(ids, dtype=np.int64) for ids in self.b.encode(parts, num_threads=1)]
        ids = [np.concatenate(side) for side in sides]
        cut = [np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in sides]
        lens = [t[1][i + 1] - t[1][i] for t, i in zip(self.tables, ids)]
        ends = [np.cumsum(x) for x in lens]
        want = np.cumsum([len(r) for r in raw])
        reached = [np.concatenate([[0], e])[c[1:]] for e, c in zip(ends, cut)]
        fits = [np.diff(r, prepend=0) == np.diff(want, prepend=0) for r in reached]
        good = fits[0] & fits[1]
        if good.all():
            text = np.frombuffer(b"".join(raw), dtype=np.uint8)
            for table, i in zip(self.tables, ids):
                good[np.searchsorted(want, np.flatnonzero(gather(i, *table) != text), side="right")] = False
        if not good.all():
            for k in np.flatnonzero(~good):
                owners[k].good = False
            rest = [k for k in np.flatnonzero(good) if owners[k].good]
            if rest:
                self.block([parts[k] for k in rest], [owners[k] for k in rest])
            return
        (a, b), (cut_a, cut_b), (ends_a, ends_b) = ids, cut, ends
        row, column, _ = overlap_links(ends_a, ends_b)
        ga, gb = group_matrices(ends_a, ends_b)
        group_a, group_b = ga.index, gb.index
        in_a, in_b = (np.bincount(g, minlength=ga.columns) for g in (group_a, group_b))
        per_a = in_b[group_a]  # rows of the product of the group matrices hold so many links
        # tokens in the order in which groups are listed, each with the sign that follows it
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a * 3 + np.append(group_a[1:] != group_a[:-1], True)
        code[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = b * 3 + 2 * np.append(group_b[1:] != group_b[:-1], True)
        sign_ends = np.concatenate([[0], np.cumsum(self.listed[1][code + 1] - self.listed[1][code])])[cut_a + cut_b]
        signs = gather(code, *self.listed).tobytes()
        firsts = [k for k in range(len(parts)) if k == 0 or owners[k] is not owners[k - 1]] + [len(parts)]
        space = self.size[0] * self.size[1]
        doc_of = np.repeat(np.arange(len(firsts) - 1), np.diff(cut_a[firsts]))
        keys, times = np.unique(doc_of[row] * space + a[row] * self.size[1] + b[column], return_counts=True)
        key_cut = np.searchsorted(keys, np.arange(len(firsts)) * space)
        link_cut, group_cut = np.searchsorted(row, cut_a), np.concatenate([[0], group_a + 1])[cut_a]
        linked = np.concatenate([[0], np.cumsum(per_a)])[cut_a]
        for d, (lo, hi) in enumerate(zip(firsts, firsts[1:])):
            doc = owners[lo]
            if doc.counts[0]:
                doc.digest.update(b";")
            doc.counts += [c[hi] - c[lo] for c in (cut_a, cut_b, group_cut, link_cut, linked)]
            doc.digest.update(signs[sign_ends[lo]:sign_ends[hi] - 1])
            doc.pairs.append((keys[key_cut[d]:key_cut[d + 1]] - d * space, times[key_cut[d]:key_cut[d + 1]]))

    def __call__(self, texts: list[str]) -> list[tuple]:
        """Columns of ``alignments``."""
        docs = [Document() for _ in texts]
        parts: list[str] = []
        owners: list[Document] = []
        size = 0
        for t, doc in zip(texts, docs):
            for p in chunks(t) if t else []:
                parts.append(p)
                owners.append(doc)
                size += len(p)
                if size >= BLOCK_BYTES:
                    self.block(parts, owners)
                    parts, owners, size = [], [], 0
        if parts:
            self.block(parts, owners)
        return list(zip(*[d.row(self.pair_type) for d in docs]))


def load(byte_path: str, piece_path: str) -> Aligner:
    """One pair of tokenizers per worker process."""
    if (byte_path, piece_path) not in _LOADED:
        _LOADED[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _LOADED[byte_path, piece_path]


def alignments(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_group_links`` (pairs of tokens of one group), ``groups_sha256``, and the
    distinct linked id pairs (``pair``: A's id times the size of B's vocabulary, plus B's id) with ``times``, their links in this text.

    A is a byte-level file of the tokenizers library over space and text, B a sentencepiece model over the text. Null and empty texts,
    and texts whose tokens don't give back the bytes, have no tokens: zeros, an empty digest and no pairs.
    """

    kind = load(byte_path, piece_path).pair_type

    def make():
        aligner = load(byte_path, piece_path)

        def run(texts):
            out = aligner(texts) or [()] * 8
            return [*map(list, out[:6]), pa.array(list(out[6]), pa.list_(pa.from_numpy_dtype(kind))), pa.array(list(out[7]), pa.list_(pa.int32()))]

        return run

    fields = [field(n, "long") for n in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")] + [field("groups_sha256", "string"), field("pair", "array<int>" if kind == np.int32 else "array<long>"), field("times", "array<int>")]
    return append_columns(docs, text, fields, make, keep=keep)


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_PAIRS):
    """Slices of a batch whose arrays sum to about ``most`` entries."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.list_flatten(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, links, best): links of each id pair over all rows, and whether no other pair of the same B id has more.

    Pairs are summed within blocks of rows, so what is shuffled are distinct pairs of blocks. A B id has no more pairs than A has ids.
    """

    def combine(batches):
        for batch in batches:
            for part in blocks(batch, "pair"):
                names, at = np.unique(flat(part, "pair"), return_inverse=True)
                sums = np.bincount(at, weights=flat(part, "times"), minlength=len(names)) if len(names) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums.astype(np.int64))], names=["pair", "links"])

    parts = aligned.select("pair", "times").mapInArrow(combine, "pair long, links long")
    counts = parts.groupBy("pair").agg(F.sum("links").alias("links"))
    return counts.select("pair", "links", (F.col("links") == F.max("links").over(Window.partitionBy(F.col("pair") % b_size))).alias("best"))


def with_corpus_counts(aligned: DataFrame, b_size: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose count is the highest of their B id, ties included) and ``count_sum`` (of the counts of all links).

    ``b_size`` is the size of B's vocabulary. Counts of up to ``broadcast_pairs`` id pairs are broadcast; beyond that the pairs of all rows are
    joined with them, and AQE splits frequent pairs. Rows are told apart by a number of their own, so repeated ids stay apart.
    """
    spark = aligned.sparkSession
    aligned = cut_lineage(aligned)
    counts = cut_lineage(pair_counts(aligned, b_size))
    rest = [c for c in aligned.columns if c not in ("pair", "times")]
    if counts.count() > broadcast_pairs:
        rows = cut_lineage(aligned.withColumn("_row", F.monotonically_increasing_id()))
        links = rows.select("_row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("_row", F.col("x.pair").cast("long").alias("pair"), "x.times")
        sums = links.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
        filled = rows.drop("pair", "times").join(sums, "_row", "left")
        return filled.select(*[col(c) for c in rest], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
    table = counts.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "links", "best")))
    schema = T.StructType([*[aligned.schema[c] for c in rest], field("n_best", "long"), field("count_sum", "long")])
    arrow = to_arrow_schema(schema)
    n = len(rest)

    def sums(batches):
        names, links, best = shared.value
        for batch in batches:
            for part in blocks(batch, "pair"):
                at, k = np.searchsorted(names, flat(part, "pair")), flat(part, "times")
                sizes = pc.list_value_length(part.column("pair")).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                totals = [np.concatenate([[0], np.cumsum(v)]) for v in (k * best[at], k * links[at])] if len(k) else [np.zeros(1, np.int64)] * 2
                arrays = [part.column(j).cast(arrow.field(j).type) for j in range(n)] + [pa.array(t[ends] - t[ends - sizes], pa.int64()) for t in totals]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return aligned.select(*[col(c).alias(f"c{j}") for j, c in enumerate(rest)], "pair", "times").mapInArrow(sums, schema)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep=("doc_id",), broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, counts of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups_sha256``; see ``alignments`` and ``with_corpus_counts``."""
    aligned = alignments(docs, byte_path, piece_path, text, keep=list(keep))
    return with_corpus_counts(aligned, load(byte_path, piece_path).size[1], broadcast_pairs)
