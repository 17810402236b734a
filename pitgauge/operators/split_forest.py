"""A large forest as several small ones: fitted side by side, each restartable, merged by averaging."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from math import ceil

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.operators.modeling import TASK_ROWS, preprocessing
from pitgauge.operators.setops import digest
from pitgauge.session import cut_lineage, shared_dir
from pitgauge.sources.publish import exists, fingerprint, publish


class SplitForestModel:
    """The mean of all trees of its parts."""

    def __init__(self, prep: PipelineModel, parts: Sequence[RandomForestRegressionModel]):
        self.prep, self.parts = prep, list(parts)

    @property
    def trees(self) -> int:
        return sum(m.getNumTrees for m in self.parts)

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.prep.transform(rows)
        names = [f"_part{k}" for k in range(len(self.parts))]
        for name, m in zip(names, self.parts):
            out = m.copy({m.predictionCol: name}).transform(out)
        total = sum((F.col(name) * m.getNumTrees for name, m in zip(names, self.parts)), F.lit(0.0))
        return out.withColumn("prediction", total / self.trees).drop(*names)


class SplitClassForestModel(SplitForestModel):
    """The class with the most of the summed votes of all trees."""

    @property
    def stages(self) -> list:
        return self.prep.stages

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.prep.transform(rows)
        names = [f"_part{k}" for k in range(len(self.parts))]
        for name, m in zip(names, self.parts):
            out = m.copy({m.rawPredictionCol: name, m.probabilityCol: "", m.predictionCol: ""}).transform(out)
        none = F.array(*[F.lit(0.0)] * self.parts[0].numClasses)
        votes = F.aggregate(F.array(*[vector_to_array(name) for name in names]), none, lambda total, part: F.zip_with(total, part, lambda x, y: x + y))  # each part's vector is named once, so it is worked out once
        first = F.array_position("_votes", F.array_max("_votes")) - 1
        return out.withColumn("_votes", votes).withColumn("prediction", first.cast("double")).drop("_votes", *names)


class SplitForest:
    """``trees`` trees of ``depth`` levels in parts of ``part_trees`` trees, each part with a seed of its own.

    ``fit`` writes the preprocessed rows once; the parts read them, ``parallelism`` at a time (by default the session's, at least 8), in a partition
    for each ``TASK_ROWS`` rows: every partition sends its statistics of all open nodes, so the parts side by side fill the cores and not the partitions. A finished part is published below the shared
    folder (or ``folder``) under a name that depends on the rows and the parameters, so a fit that was broken off goes on with
    the parts that it lacks, and the same fit by another job reads all of them. Rows without a label are the caller's to leave out. The driver holds the
    parts' trees, as with any forest of this library.
    """

    def __init__(self, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), trees: int = 500, depth: int = 12,
                 part_trees: int = 25, parallelism: int | None = None, seed: int = 42, folder: str | None = None, **params):
        self.label, self.numeric, self.categorical = label, list(numeric), list(categorical)
        self.sizes = [min(part_trees, trees - at) for at in range(0, trees, part_trees)]
        self.depth, self.seed, self.parallelism, self.folder, self.params = depth, seed, parallelism, folder, params

    def estimator(self, k: int) -> RandomForestRegressor:
        return RandomForestRegressor(labelCol=self.label, **{"numTrees": self.sizes[k], "maxDepth": self.depth, "seed": self.seed + k, **self.params})

    def stages(self) -> list:
        return preprocessing(self.numeric, self.categorical)

    #: columns of the preprocessed rows beside the features, columns of the given rows beside the features' sources, and the models' classes
    def fitted_columns(self) -> list[str]:
        return [self.label]

    def given_columns(self) -> list[str]:
        return [self.label]

    part_model, whole_model = RandomForestRegressionModel, SplitForestModel

    def fit(self, rows: DataFrame) -> SplitForestModel:
        spark = rows.sparkSession
        rows = rows.select(*self.numeric, *self.categorical, *self.given_columns())
        state = digest(rows).select("digest.*").first()
        name = fingerprint(self.label, self.numeric, self.categorical, self.depth, self.seed, self.params, [str(v) for v in state])
        places = [f"{(self.folder or shared_dir(spark)).rstrip('/')}/forests/{name}/{k}-of-{n}-trees" for k, n in enumerate(self.sizes)]
        prep = Pipeline(stages=self.stages()).fit(rows)
        missing = [k for k, place in enumerate(places) if not exists(spark, place)]
        if missing:
            ready = cut_lineage(prep.transform(rows).select("features", *self.fitted_columns())).coalesce(max(1, ceil(state["n"] / TASK_ROWS)))

        @inheritable_thread_target(spark)
        def part(k: int):
            if k in missing:
                made = self.estimator(k).fit(ready)
                publish(spark, places[k], lambda aside: made.write().save(aside))
                return made
            return self.part_model.load(places[k])

        with ThreadPoolExecutor(self.parallelism or max(8, spark.sparkContext.defaultParallelism)) as pool:
            return self.whole_model(prep, list(pool.map(part, range(len(places)))))


class SplitClassForest(SplitForest):
    """``modeling.forest_classifier`` in parts: 300 trees with at least two rows in a leaf, up to the library's 30 levels, on weighted rows."""

    part_model, whole_model = RandomForestClassificationModel, SplitClassForestModel

    def __init__(self, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), weight: str = "weight", trees: int = 300, depth: int = 30, **params):
        super().__init__(label, numeric, categorical, trees, depth, **{"minInstancesPerNode": 2, **params})
        self.weight = weight

    def estimator(self, k: int) -> RandomForestClassifier:
        return RandomForestClassifier(labelCol="_label", weightCol=self.weight, **{"numTrees": self.sizes[k], "maxDepth": self.depth, "seed": self.seed + k, **self.params})

    def stages(self) -> list:
        return [StringIndexer(inputCol=self.label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc"), *super().stages()]

    def fitted_columns(self) -> list[str]:
        return ["_label", self.weight]

    def given_columns(self) -> list[str]:
        return [self.label, self.weight]
