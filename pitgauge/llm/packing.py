"""Token-id output: documents packed into rows of a fixed length by best fit decreasing.

Each task encodes its documents and packs them in shards of a bounded number of tokens, so nothing is shuffled and no
shard grows with the corpus. Documents longer than a row are split without loss. A shard's pieces are placed from the longest to the
shortest, each into the open row with the least room that holds it; a segment tree over the room left finds that row in
logarithmic time.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from pitgauge.llm.bpe import PATTERN
from pitgauge.llm.common import Memo, by_bytes, col, segments

ROW_TOKENS = 2048
SHARD_TOKENS = 4 << 20
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in (
    ("row_id", T.LongType()), ("n_tokens", T.IntegerType()), ("doc_ids", T.ArrayType(T.LongType())), ("doc_offsets", T.ArrayType(T.LongType())),
    ("cu_seqlens", T.ArrayType(T.IntegerType())), ("position_resets", T.ArrayType(T.IntegerType())), ("ids", T.BinaryType()))])
_LOADED: dict[str, "Encoder"] = {}


class Encoder:
    """Ordinary ids of a ``.tiktoken`` vocabulary as little-endian bytes; segments that come again are remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pad = max(ranks.values()) + 1  # free in the vocabulary
        self.dtype = np.dtype("<u2" if self.pad < 1 << 16 else "<u4")
        self.memo = Memo(lambda part: self._ids(" " + part))

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype=self.dtype).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        first, rest = segments(text)
        return np.frombuffer(self._ids(first) + b"".join(map(self.memo.__getitem__, rest)), dtype=self.dtype)


def load(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Rooms:
    """Segment tree over the room left in rows: how many rows have room ``0 .. size``, and which."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.width
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Take out the row with the least room that is at least ``need``: (room, row)."""
        k = need + self.width
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until a right neighbour has rows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.width
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of pieces by row. Pieces of equal length keep their order; a piece of ``size`` fills a row of its own."""
    rooms, rows = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        room, row = found or (size, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


def pack_shard(pieces: list[tuple[int, int, np.ndarray]], size: int, pad: int, dtype, first_row: int) -> pa.RecordBatch:
    """Rows of a shard; ``pieces`` are (document, offset, ids)."""
    rows = best_fit_decreasing([len(p[2]) for p in pieces], size)
    matrix = np.full((len(rows), size), pad, dtype=dtype)
    out: dict[str, list] = {f.name: [] for f in SCHEMA}
    for r, members in enumerate(rows):
        ends = [0]
        for i in members:
            ids = pieces[i][2]
            matrix[r, ends[-1]:ends[-1] + len(ids)] = ids
            ends.append(ends[-1] + len(ids))
        out["row_id"].append(first_row + r)
        out["n_tokens"].append(ends[-1])
        out["doc_ids"].append([pieces[i][0] for i in members])
        out["doc_offsets"].append([pieces[i][1] for i in members])
        out["cu_seqlens"].append(ends)
        out["position_resets"].append(ends[:-1])
        out["ids"].append(matrix[r].tobytes())
    return pa.RecordBatch.from_pydict(out, schema=to_arrow_schema(SCHEMA))


def pack_documents(docs: DataFrame, path: str, size: int = ROW_TOKENS, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of ``size`` ids: ``row_id``, ``n_tokens`` (before padding), ``doc_ids`` and ``doc_offsets`` of the segments, ``cu_seqlens``,
    ``position_resets`` (where positions start again at 0) and ``ids`` (little-endian, 2 or 4 bytes each, padded with the id after the last).

    Every token of every document is in exactly one segment; a document of more than ``size`` tokens has segments at offsets 0, ``size``, ...
    Null and empty texts have no tokens and no segment. Repeated rows are packed as often as they come; other columns are
    ignored; an empty table has no rows. ``row_id`` is the partition and a running number, so a retried task repeats it.
    """

    def run(batches):
        encoder, base, made = load(path), TaskContext.get().partitionId() << 36, 0
        held, tokens = [], 0
        for batch in batches:
            for part in by_bytes(batch, 1):
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder(t or "")
                    for at in range(0, len(ids), size):
                        held.append((doc, at, ids[at:at + size]))
                        tokens += len(held[-1][2])
                        if tokens >= shard_tokens:
                            packed = pack_shard(held, size, encoder.pad, encoder.dtype, base + made)
                            made += packed.num_rows
                            yield packed
                            held, tokens = [], 0
        if held:
            yield pack_shard(held, size, encoder.pad, encoder.dtype, base + made)

    return docs.select(col(key).cast("long").alias("_id"), col(text).cast("string").alias("_text")).mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed table as Parquet at a path that Spark can write."""
    packed.write.parquet(path)


def matrix_of(rows: list, size: int = ROW_TOKENS) -> np.ndarray:
    """The id matrix of collected rows, one row each."""
    data = [bytes(r["ids"]) for r in rows]
    return np.frombuffer(b"".join(data), dtype="<u2" if not data or len(data[0]) == 2 * size else "<u4").reshape(-1, size)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Positions within segments: they start again at 0 at each reset."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
