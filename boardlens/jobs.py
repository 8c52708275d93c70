"""Snapshots: several isolated stages over shared inputs, published together."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.session import workspace

STATUS = "version string, stage string, ok boolean, rows bigint, seconds double, error string"


def write_stage(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """One dataset of a stage; nested columns stay nested in JSON and Parquet."""
    df.write.mode("overwrite").format(fmt).save(folder)


@dataclass
class Snapshot:
    """A job whose stages read the same settled inputs and fail apart from each other.

    Each stage is a function of (spark, folder) giving named datasets. Intermediates
    lie in a workspace of the job and are removed when it ends. A version counts as
    published once its status is written, as the last step; readers take the latest
    status, so they never see half a version.
    """

    target: str
    stages: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]]
    fmt: str = "parquet"
    shared: list[dict] = field(default_factory=list)  # caches of shared tables: the job fills its own

    def run(self, spark: SparkSession, folder: str, version: str) -> DataFrame:
        """Run all stages and publish ``version``; its status rows."""
        rows = []
        with workspace(spark, "snapshot"):
            kept = [dict(cache) for cache in self.shared]
            for cache in self.shared:
                cache.clear()
            try:
                for name, stage in self.stages.items():
                    began, count, error = time.time(), 0, None
                    try:
                        for dataset, df in stage(spark, folder).items():
                            path = f"{self.target}/{version}/{name}/{dataset}"
                            write_stage(df, path, self.fmt)
                            count += spark.read.format(self.fmt).schema(df.schema).load(path).count()
                    except Exception as failure:  # a stage's failure is its status
                        error = f"{type(failure).__name__}: {failure}"[:500]
                    rows.append((version, name, error is None, count if error is None else None, time.time() - began, error))
            finally:
                for cache, before in zip(self.shared, kept, strict=True):
                    cache.clear()
                    cache.update(before)
        status = spark.createDataFrame(rows, STATUS)
        status.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{self.target}/_status/version={version}")
        return status

    def published(self, spark: SparkSession) -> DataFrame:
        """Status rows of the latest version that was published."""
        every = spark.read.schema(STATUS).parquet(f"{self.target}/_status")
        return every.where(F.col("version") == every.agg(F.max("version")).scalar())

    def read(self, spark: SparkSession, stage: str, dataset: str) -> DataFrame:
        """A dataset of the latest published version."""
        version = self.published(spark).select("version").first()[0]
        return spark.read.format(self.fmt).load(f"{self.target}/{version}/{stage}/{dataset}")
