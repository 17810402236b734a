"""The bounded labelled sample that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the labelled rows."""
    return F.crc32(F.col(key).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int, max_chars: int,
                    key: str = "doc_id", text: str = "text") -> tuple[list[str], list[int]]:
    """At most ``per_class`` texts of each label value among the rows that ``learn`` admits, and their labels.

    Both bounds are parameters of the fit alone: rows are taken in the order of a hash of their id, and
    labelled texts of more than ``max_chars`` are not learned from. The ids are few by construction, so they are
    broadcast and no text is shuffled. Rows with a null id, label or text and ids with both labels are left out; a repeated id counts once,
    with the first of its texts in sorted order.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(target).isin(0, 1) & learn).select(F.col(key).alias("_k"), F.col(target).cast("int").alias("_y"))
    rows = rows.groupBy("_k").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    ids = [rows.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(per_class) for y in (0, 1)]
    picked = docs.where(F.length(text) <= max_chars).join(F.broadcast(ids[0].union(ids[1])), F.col(key) == F.col("_k")).select("_k", F.col(text).alias("_t"), "_y")
    found = {k: (t, y) for k, t, y in sorted(map(tuple, picked.where("_t is not null").collect()), reverse=True)}
    return [found[k][0] for k in sorted(found)], [found[k][1] for k in sorted(found)]


def constant(labels: list[int]) -> float | None:
    """The only label value there is, or 0.5 where there is none; null if there are two to tell apart."""
    return None if len(set(labels)) == 2 else float(labels[0]) if labels else 0.5
