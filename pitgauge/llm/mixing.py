"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential draw, from a hash of its id, divided by its quality weight, so a source sorted by key is a weighted
sample without replacement of any length. Sources share a budget of words by weight, up to a number of epochs of their own words; what a source
cannot take is shared again. A source gives its complete epochs first, then documents by key until the rest of its target is reached: sizes
are summed in the order of source and key over ranges of the whole table, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgauge.llm.common import col, without
from pitgauge.operators.prefix import running_sums
from pitgauge.session import cut_lineage

EPOCHS = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Words as ASCII white space separates them; null: 0."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number between 0 and 1 from the id's md5, the same in every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def exponential_key(key: Column, weight: Column) -> Column:
    """-ln(u) / weight; a weight that is null, not a number or not above 0 puts a document behind all others."""
    good = weight.isNotNull() & ~F.isnan(weight) & (weight > 0)
    return F.when(good, -F.log(uniform(key)) / weight).otherwise(F.lit(float("inf")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, rank, source_size, before, target) from (source, source_size): sources in code point order, null last, take ``weights`` in turn.

    All sources share the sum of all sizes. A target is the lesser of ``epochs`` times the source's size and its weight times the one level at which targets
    sum to the budget, which is where sharing the excess again and again ends. ``before`` is the size of the sources ahead.
    """
    placed = running_sums(sizes, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1), "before": F.col("source_size")})
    cycle = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = cut_lineage(placed.withColumn("before", F.col("before") - F.col("source_size")).withColumn("weight", cycle).withColumn("most", epochs * F.col("source_size")))
    share = F.col("most") / F.col("weight").cast("double")
    filled = running_sums(placed, [share, F.col("rank")], {"most_to": F.col("most"), "weight_to": F.col("weight")})
    budget, total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(budget) - (F.col("most_to") - F.col("most"))).cast("double") / (F.lit(total) - (F.col("weight_to") - F.col("weight"))).cast("double")
    open_ = filled.select(level.alias("level"), share.alias("share"), "rank").where("level <= share")
    level = open_.agg(F.min_by("level", F.struct("share", "rank"))).first()[0] or 0.0
    return placed.select("source", "rank", "source_size", "before", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, size: Column, quality: Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: its id, ``source``, ``size``, ``source_size``, ``target`` (of its source), ``epochs`` (complete ones) and ``taken``.

    ``taken`` counts the words that the mix takes of the document, repeats included; the last document of a source gives its first words alone, so a
    source takes its target to the word. ``quality`` weighs documents within a source. Null sources are one source, null ids share a draw,
    repeated rows are documents of their own, a document without words takes nothing, an empty table gives no rows.
    """
    sized = docs.select(col(key).alias("_id"), col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), exponential_key(col(key), quality).alias("draw"))
    rows = cut_lineage(sized)
    targets = cut_lineage(source_targets(cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, epochs))
    ranked = rows.join(targets.select(F.col("source").alias("_s"), "rank"), F.col("source").eqNullSafe(F.col("_s"))).select("_id", "size", "draw", "rank")
    reached = running_sums(cut_lineage(ranked), [F.col(c) for c in ("rank", "draw", "_id", "size")], {"reach": F.col("size")})
    out = reached.join(targets, "rank")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("epochs", full)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least(F.greatest(rest - (F.col("reach") - F.col("before") - F.col("size")), F.lit(0)), F.col("size"))
    return out.select(F.col("_id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixture(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` takes them, with ``epoch`` (from 0) and ``n_words`` (how many words from the start). Ids have to be unique."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    taken = plan.where("taken > 0").select(F.col(key).alias("_key"), "size", "taken", F.explode(F.sequence(F.lit(0), times.cast("int") - 1)).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    return docs.join(taken, col(key) == F.col("_key")).select(*[col(c) for c in without(docs, ["epoch", "n_words"])], "epoch", words.alias("n_words"))
