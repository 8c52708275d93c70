"""Mechanisms that may explain an observation: a join of concept sets through an index.

Observations are reduced to their distinct (direction, extents, timing) before they
meet the catalogue, so the ranking runs over few rows however many observations
share one. The catalogue is a fixed table of thirteen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlens import knowledge as K
from boardlens.schema import BOARD_SERIES


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k, name, way, sig, list(spatial), list(temporal), early) for k, (name, way, sig, spatial, temporal, early, _) in enumerate(K.MECHANISMS)]
    return spark.createDataFrame(
        rows, "place int, mechanism string, way string, signature string, spatial array<string>, temporal array<string>, early boolean")


def by_extent(spark: SparkSession) -> DataFrame:
    """The inverted index: a row per extent and mechanism."""
    return catalogue(spark).withColumn("extent", F.explode("spatial")).drop("spatial")


def mapped(column: Column | str, table: dict[str, object]) -> Column:
    """Value of a short fixed table; NULL for other keys."""
    column = F.col(column) if isinstance(column, str) else column
    out = None
    for key, value in table.items():
        literal = F.array(*[F.lit(v) for v in value]) if isinstance(value, tuple) else F.lit(value)
        out = F.when(column == key, literal) if out is None else out.when(column == key, literal)
    return out


def projected(observations: DataFrame, limit: int = K.PROJECTION_LIMIT) -> DataFrame:
    """Adds ``rank`` and ``mechanism`` of up to ``limit`` mechanisms per observation.

    ``observations`` have direction, extents (array) and timing (may be NULL). A
    mechanism fits if it acts in the direction (or both) and shares an extent; exact
    directions come first, then usual timings, then catalogue order. Observations
    that nothing fits are left out.
    """
    cell = ["direction", "extents", "timing"]
    cells = observations.select(*cell).distinct()
    index = F.broadcast(by_extent(observations.sparkSession))
    fits = cells.withColumn("extent", F.explode("extents")).join(index, "extent").where(
        (F.col("way") == F.col("direction")) | (F.col("way") == "BOTH"))
    key = F.struct(
        (F.col("way") != F.col("direction")).alias("both"),
        (~F.coalesce(F.array_contains("temporal", F.col("timing")), F.lit(False))).alias("untimely"), "place")
    once = fits.select(*cell, "mechanism", key.alias("key")).distinct()
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("key"))).where(F.col("rank") <= limit)
    renamed = best.select("rank", "mechanism", *[F.col(c).alias(f"_{c}") for c in cell])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell]
    return observations.join(renamed, same).drop(*[f"_{c}" for c in cell])


def abnormal_causes(abnormals: DataFrame) -> DataFrame:
    """Mechanisms of abnormals; a sporadic one, and one that nothing fits, gets the advice to watch the next board."""
    axis = {k: v[0] for k, v in K.PATTERN_AXES.items()}
    time = {k: v[1] for k, v in K.PATTERN_AXES.items()}
    seen = abnormals.select(
        "abnormal_id", F.col("defect_type").alias("direction"),
        F.when(F.col("abnormal_pattern") != "SPORADIC", F.array(mapped("abnormal_pattern", axis))).alias("extents"),
        mapped("abnormal_pattern", time).alias("timing"))
    found = projected(seen).select("abnormal_id", "rank", "mechanism")
    full = seen.select("abnormal_id").join(found, "abnormal_id", "left")
    known = F.col("mechanism").isNotNull()
    return full.select(
        "abnormal_id", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("mechanism", F.lit("observe_next_board")).alias("mechanism"),
        F.when(known, K.PROJECTION_PRIOR).otherwise(K.FALLBACK_PRIOR).alias("confidence"))


def event_causes(events: DataFrame) -> DataFrame:
    """Mechanisms of failure events, by direction and scope."""
    seen = events.select("event_id", "direction", mapped("scope", K.EVENT_EXTENTS).alias("extents"), F.lit(None).cast("string").alias("timing"))
    return projected(seen).select("event_id", "rank", "mechanism", F.lit(K.PROJECTION_PRIOR).alias("confidence"))


def warning_mechanisms(warnings: DataFrame) -> DataFrame:
    """Mechanisms that drift announces and whose extent is the warning's; any direction, as magnitudes have none."""
    index = F.broadcast(by_extent(warnings.sparkSession).where("early"))
    extent = F.when(F.col("compname") == BOARD_SERIES, K.BOARD).otherwise(K.SINGLE)
    return warnings.select("warning_id", extent.alias("extent")).join(index, "extent").select(
        "warning_id", "mechanism", "place", F.lit(K.PROJECTION_PRIOR).alias("confidence"))


def concepts(spark: SparkSession) -> DataFrame:
    """(kind, label, concept) for every direction and cause, under all spellings; a mechanism wins over a cause of its name."""
    rows = [("direction", label, K.DIRECTION_CONCEPTS[way]) for way, labels in K.DIRECTION_LABELS.items() for label in labels]
    causes = K.CAUSE_CONCEPTS | {name: f"mech.{name}" for name, *_ in K.MECHANISMS}
    rows += [("cause", label, concept) for label, concept in causes.items()]
    return spark.createDataFrame(rows, "kind string, label string, concept string")


def label_to_concept(rows: DataFrame, **columns: str) -> DataFrame:
    """Adds ``<kind>_concept`` for each kind and the column that holds its label; NULL for labels nobody knows."""
    table = concepts(rows.sparkSession)
    for kind, column in columns.items():
        of_kind = F.broadcast(table.where(F.col("kind") == kind).select(
            F.col("label").alias("_label"), F.col("concept").alias(f"{kind}_concept")))
        rows = rows.join(of_kind, F.col(column) == F.col("_label"), "left").drop("_label")
    return rows
