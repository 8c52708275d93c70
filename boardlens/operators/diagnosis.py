"""From an observation to ranked causes: a decision table whose rules are column expressions.

Every rule of the ladder is a struct that is NULL where it does not fire; exploding
them gives all nominations in one pass. Mechanisms bring their signature and usual
extent by a join with the catalogue (thirteen rows). Confidences are exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens import knowledge as K
from boardlens.operators.mechanisms import catalogue, mapped, projected
from boardlens.schema import METRICS

ASSESSED = 3
_NOMINATION = "struct<step:string,place:int,rule:string,mechanism:string,prior:decimal(4,2),factor:decimal(4,2)>"


def cleaning_aligned(gap: Column, frequency: Column) -> Column:
    """Whether a distance between runs is close to a multiple of the cleaning frequency."""
    near = F.greatest(F.bround(gap / frequency), F.lit(1.0))
    fits = F.abs(gap - near * frequency) <= K.ALIGNMENT_TOLERANCE * frequency
    return F.coalesce((gap != 0) & (frequency > 0) & fits, F.lit(False))


def signature_status(signature: Column, verdicts: list[Column]) -> Column:
    """How three observed verdicts agree with what a mechanism allows: matched, conflict, partial or unknown."""
    parts = F.split(signature, r"\|")
    evaluated = agreed = F.lit(0)
    conflict = F.lit(False)
    for k, verdict in enumerate(verdicts):
        allowed = F.get(parts, F.lit(k))
        judged = F.coalesce((allowed != "") & (allowed != "any") & verdict.isNotNull(), F.lit(False))
        evaluated += judged.cast("int")
        agreed += (judged & F.array_contains(F.split(allowed, "/"), verdict)).cast("int")
        against = ((verdict == "up") & (allowed == "down")) | ((verdict == "down") & (allowed == "up"))
        conflict = conflict | (judged & F.coalesce(against, F.lit(False)))
    return (
        F.when(evaluated == 0, "unknown").when(conflict, "conflict")
        .when((agreed == evaluated) & (evaluated >= 2), "matched").otherwise("partial"))


def _verdicts() -> list[Column]:
    return [F.col(f"sig_{m[len('comp_'):]}") for m in METRICS]


def signature_match(observations: DataFrame) -> DataFrame:
    """Every trigger's agreement with the signature of every mechanism of its direction that has one."""
    mechanisms = F.broadcast(catalogue(observations.sparkSession).where("signature <> ''").select("mechanism", "way", "signature"))
    ways = F.array(F.col("direction"), F.lit("BOTH"))
    return observations.withColumn("way", F.explode(ways)).join(mechanisms, "way").select(
        "trigger_id", "mechanism", signature_status(F.col("signature"), _verdicts()).alias("status"))


def _holds(token: str):
    return lambda name: name.contains(token)


def _lacks(token: str):
    return lambda name: ~name.contains(token)


def _rules() -> list[tuple[str, int, str, Column, Column, str, Column]]:
    """The ladder but its projection: step, place in it, rule, condition, mechanism, prior, factor."""
    one = F.lit(None).cast("string")
    name = F.lit
    suspect = F.col("validity") == "spi_suspect"
    cross = F.when(F.col("cross_model"), K.CROSS_MODEL)
    drifted = F.size("drifted_parameters") > 0
    out = [
        ("spi_false_alarm_gate", 0, "spi_false_alarm_review", suspect, name("spi_false_call"), K.PRIORS["spi_false_alarm"], one),
        ("parameter_recovery", 0, "parameter_recovery", (F.col("recovery") == "recovered") & (F.size("recovery_parameters") > 0),
         name("parameter_mismatch"), K.PRIORS["recovery"], one),
    ]
    rest = F.transform("drifted_parameters", F.lower)
    for k, (token, mechanism) in enumerate(K.DRIFT_GROUPS):
        out.append(("parameter_drift", k, f"{token}_parameter_drift", F.exists(rest, _holds(token)), name(mechanism), K.PRIORS["drift"], cross))
        rest = F.filter(rest, _lacks(token))
    out.append(("parameter_drift", len(K.DRIFT_GROUPS), "parameter_drift", F.size(rest) > 0, name("parameter_mismatch"), K.PRIORS["drift"], cross))
    aligned = F.when(cleaning_aligned(F.col("periodic_gap"), F.col("cleaning_frequency")), K.ALIGNED)
    out.append(("periodic_recurrence", 0, "periodic_maintenance_cycle", F.col("periodic"), name("cleaning_cycle_mismatch"), K.PRIORS["periodic"], aligned))
    for (extent, direction), (mechanism, prior) in K.SCOPE_PRIORS.items():
        out.append(("scope_prior", 0, f"{direction.lower()}_{extent}", ~suspect & (F.col("direction") == direction) & (F.col("category") == extent),
                    name(mechanism), prior, one))
    for kind in ("gradual", "step"):
        fires = (F.col("trend_kind") == kind) & (F.lit(kind == "gradual") | ~drifted)
        out.append(("trend_shape", 0, f"trend_{kind}", fires, one, K.PRIORS["trend"], one))
    return out


def nominations(observations: DataFrame) -> DataFrame:
    """All candidates of every trigger with their confidence.

    prior x evidence factor x signature (agreeing or against) x extent (usual or not),
    three decimals, at most 0.95.
    """
    order = dict(K.STEPS)
    decimal = "decimal(4,2)"
    structs = [F.when(F.coalesce(fires, F.lit(False)), F.struct(
        F.lit(step).alias("step"), F.lit(place).alias("place"), F.lit(rule).alias("rule"), mechanism.alias("mechanism"),
        F.lit(prior).cast(decimal).alias("prior"), F.coalesce(factor, F.lit("1")).cast(decimal).alias("factor")))
        for step, place, rule, fires, mechanism, prior, factor in _rules()]
    kept = ["trigger_id", "spatial", *[f"sig_{m[len('comp_'):]}" for m in METRICS]]
    fired = observations.select(*kept, F.inline(F.array_compact(F.array(*structs).cast(f"array<{_NOMINATION}>"))))
    cells = observations.select(*kept, "direction", F.array("spatial").alias("extents"), F.col("temporal").alias("timing"))
    shown = projected(cells).select(
        *kept, F.lit("mechanism_projection").alias("step"), F.col("rank").cast("int").alias("place"), F.concat(F.lit("projected_"), "mechanism").alias("rule"),
        "mechanism", F.lit(str(K.PROJECTION_PRIOR)).cast(decimal).alias("prior"), F.lit("1").cast(decimal).alias("factor"))
    both = fired.unionByName(shown)
    lost = observations.join(both.select("trigger_id").distinct(), "trigger_id", "left_anti").select(
        *kept, F.lit("fallback").alias("step"), F.lit(0).alias("place"), F.lit("local_printing_state").alias("rule"), F.lit("undetermined").alias("mechanism"),
        F.lit(str(K.FALLBACK_PRIOR)).cast(decimal).alias("prior"), F.lit("1").cast(decimal).alias("factor"))
    known = F.broadcast(catalogue(observations.sparkSession).select(F.col("mechanism").alias("_m"), "signature", F.col("spatial").alias("usual")))
    df = both.unionByName(lost).join(known, F.col("mechanism") == F.col("_m"), "left")
    status = F.when(F.coalesce(F.col("signature"), F.lit("")) == "", "unknown").otherwise(signature_status(F.col("signature"), _verdicts()))
    by_signature = F.when(F.col("signature_match") == "matched", K.SIGNATURE_MATCH).when(F.col("signature_match") == "conflict", K.SIGNATURE_CONFLICT)
    by_extent = F.when(F.size("usual") > 0, F.when(F.array_contains("usual", F.col("spatial")), K.TYPICAL).otherwise(K.ATYPICAL))
    df = df.withColumn("signature_match", status).withColumns({
        "signature_factor": F.coalesce(by_signature, F.lit("1")).cast(decimal), "extent_factor": F.coalesce(by_extent, F.lit("1")).cast(decimal)})
    raw = F.col("prior") * F.col("factor") * F.col("signature_factor") * F.col("extent_factor")
    confidence = F.least(F.round(raw, 3).cast("decimal(6,3)"), F.lit(K.CONFIDENCE_CAP).cast("decimal(6,3)"))
    level = F.when(confidence >= F.lit(K.LEVELS[0][0]).cast("decimal(6,3)"), K.LEVELS[0][1]).when(
        confidence >= F.lit(K.LEVELS[1][0]).cast("decimal(6,3)"), K.LEVELS[1][1]).otherwise("LOW")
    return df.select(
        "trigger_id", "step", F.coalesce(mapped("step", order), F.lit(90)).alias("step_order"), "place", "rule", "mechanism",
        F.coalesce("mechanism", "rule").alias("cause"), "prior", "factor", "signature_match", "signature_factor", "extent_factor",
        confidence.alias("confidence"), level.alias("level"))


def assessed(candidates: DataFrame, limit: int = ASSESSED) -> DataFrame:
    """Adds ``priority`` (1 to ``limit``) to the best candidate of each cause, or why a candidate was eliminated.

    Falling confidence; nominations of the ladder's order come first among equals. A
    trigger has as many candidates as the ladder has rules.
    """
    best_first = [F.col("confidence").desc(), "step_order", "place", "rule"]
    within = Window.partitionBy("trigger_id", "cause").orderBy(*best_first)
    first = candidates.withColumn("of_cause", F.row_number().over(within))
    lead = F.struct(-F.col("confidence"), "step_order", "place", "rule")
    df = first.withColumn("lead", F.min(lead).over(Window.partitionBy("trigger_id", "cause")))
    df = df.withColumn("cause_rank", F.dense_rank().over(Window.partitionBy("trigger_id").orderBy("lead")))
    top = F.col("cause_rank") <= limit
    return df.withColumns({
        "priority": F.when(top & (F.col("of_cause") == 1), F.col("cause_rank")),
        "eliminated": F.when(~top, "not_in_top").when(F.col("of_cause") > 1, "same_cause")}).drop("lead", "of_cause", "cause_rank")


def overall(ranked_: DataFrame, observations: DataFrame) -> DataFrame:
    """Confidence in the diagnosis of every trigger."""
    top = ranked_.where("priority = 1").select("trigger_id", "level", "cause")
    return observations.select("trigger_id", "data_status").join(top, "trigger_id").select(
        "trigger_id", F.col("cause").alias("first_cause"),
        F.when(F.col("data_status") != "pass", "LOW").when(F.col("level") == "HIGH", "HIGH").otherwise("MEDIUM").alias("confidence"))


def decision_trace(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Every step of the ladder for every trigger: whether it fired, what it nominated, with which highest confidence."""
    steps = F.array(*[F.struct(F.lit(name).alias("step"), F.lit(order).alias("step_order")) for name, order in K.STEPS])
    every = observations.select("trigger_id", F.inline(steps))
    counts = candidates.groupBy("trigger_id", "step").agg(F.count(F.lit(1)).alias("nominated"), F.max("confidence").alias("highest"))
    fallback = candidates.where("step = 'fallback'").select("trigger_id", "step", "step_order").distinct()
    return every.unionByName(fallback).join(counts, ["trigger_id", "step"], "left").select(
        "trigger_id", "step", "step_order", F.col("nominated").isNotNull().alias("fired"), F.coalesce("nominated", F.lit(0)).alias("nominated"), "highest")


def auto_checks(ranked_: DataFrame, observations: DataFrame) -> DataFrame:
    """Automatic checks of every assessed mechanism: passed, not_seen, mismatch, or why there are no data."""
    table = {name: checks for name, *_, checks in K.MECHANISMS if checks}
    df = ranked_.where("priority IS NOT NULL").select("trigger_id", "mechanism", "signature_match").join(observations, "trigger_id")
    held = {
        "trend_slope": F.col("trend_kind") == "gradual", "parameter_drift": F.size("drifted_parameters") > 0,
        "recovery": (F.col("recovery") == "recovered") & (F.size("recovery_parameters") > 0), "periodic_recurrence": F.col("periodic"),
        "spi_metric_mismatch": F.col("validity") == "spi_suspect",
        "cleaning_frequency_reference": cleaning_aligned(F.col("periodic_gap"), F.col("cleaning_frequency"))}
    status = mapped("check", K.UNAVAILABLE_CHECKS)
    signature = F.when(F.col("signature_match") == "matched", "passed").when(F.col("signature_match") == "conflict", "mismatch").when(
        F.col("signature_match") == "partial", "not_seen")
    for name, holds in held.items():
        status = F.coalesce(status, F.when(F.col("check") == name, F.when(F.coalesce(holds, F.lit(False)), "passed").otherwise("not_seen")))
    none = F.array().cast("array<string>")
    declared = F.filter(F.coalesce(mapped("mechanism", table), none), lambda c: c != "metric_signature")
    every = F.when(signature.isNotNull(), F.array_append(declared, F.lit("metric_signature"))).otherwise(declared)
    return df.withColumn("check", F.explode(every)).select(
        "trigger_id", "mechanism", "check", F.coalesce(status, F.when(F.col("check") == "metric_signature", signature)).alias("status"))


def disposition(observations: DataFrame, grades: DataFrame) -> DataFrame:
    """What to do first, and how urgent it is."""
    rule = (
        F.when(F.col("data_status") != "pass", "data_continuity_review").when(F.col("alarm_status") == "suspect", "spi_program_review")
        .when(F.col("category").isin(K.BOARD, K.COMPONENT, K.LOCAL), "immediate_field_check")
        .when(F.col("recovery") == "not_recovered", "halt_and_contain").when(F.col("confidence") == "HIGH", "confirm_primary_cause")
        .otherwise("fast_single_point_check"))
    return observations.join(grades.select("trigger_id", "confidence"), "trigger_id").withColumn("disposition", rule).select(
        "trigger_id", "disposition", mapped("disposition", K.DISPOSITIONS).alias("priority"))
