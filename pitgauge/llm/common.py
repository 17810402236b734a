"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 4 << 20
ODD_SPACE = re.compile(r" \s| $").search
SAFE_SPLIT = re.compile(r" (?=\S)").split


class Memo(dict):
    """Results of a function of one string, in two generations of at most ``entries`` each; long keys are not kept."""

    def __init__(self, compute: Callable, entries: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.entries, self.longest, self.old = compute, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.learn([key], [value])
        return value

    def learn(self, keys, values) -> None:
        for key, value in zip(keys, values):
            if len(key) <= self.longest:
                if len(self) >= self.entries:
                    self.old = dict(self)
                    self.clear()
                self[key] = value


def segments(text: str) -> tuple[str, list[str]]:
    """The text before the first safe boundary, and what follows the space of each boundary.

    A boundary before a space that a visible character follows is safe for byte-level patterns: a
    run of white space gives up its last space to the word behind it, whatever comes before.
    """
    parts = SAFE_SPLIT(text) if ODD_SPACE(text) else text.split(" ")
    return parts[0], parts[1:]


def col(name: str) -> Column:
    """A column by its plain name, dots and spaces included."""
    return F.col(f"`{name.replace('`', '``')}`")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` other than ``names`` (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def by_bytes(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts sum to about ``most`` bytes; a longer single text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def append_columns(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable, keep: Sequence[str] | None = None, nulls: bool = False,
                   key: str | None = None) -> DataFrame:
    """``df`` with columns computed from its texts in Arrow batches.

    ``make()`` runs once per task and returns ``f(texts) -> columns``, which gets a list of
    texts (null: empty, or None with ``nulls``), and the list of ``key`` values if one is named, and returns one list per field. Columns of ``df`` with the name of a new
    column are replaced. A row's result depends on its own text only, so a retried task repeats it. A text that is kept is sent
    to Python once, and a batch is let go before the next is read.
    """
    kept = without(df if keep is None else df.select(*[col(c) for c in keep]), [f.name for f in fields])
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    arrow = to_arrow_schema(schema)
    n = len(kept)
    once = text in kept and df.schema[text].dataType == T.StringType()
    at, key_at = (kept.index(text), n) if once else (n, n + 1)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in by_bytes(batch, at):
                texts = part.column(at).to_pylist()
                new = fn(texts if nulls else [t or "" for t in texts], *([part.column(key_at).to_pylist()] if key else []))
                arrays = [part.column(j).cast(arrow.field(j).type) for j in range(n)]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(n + i).type) for i, v in enumerate(new)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                del part, texts, new, arrays
            del batch
            pa.default_memory_pool().release_unused()

    named = [col(c).alias(f"c{j}") for j, c in enumerate(kept)]  # plain names, as mapInArrow resolves dots
    sent = [] if once else [col(text).cast("string").alias("text")]
    return df.select(*named, *sent, *([col(key).alias("key")] if key else [])).mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind))
