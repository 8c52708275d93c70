"""The inspection table.

``spi_rows`` derives it from the ``lineitem`` table the engine is tested on:
every line of an order is a pad of a board, some boards are inspected twice, and
defects follow from quantity, discount and tax. All values are plain IEEE
expressions without rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_2024 = 1_704_067_200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _d(value: str):
    return F.expr(f"CAST({value} AS DOUBLE)")


def spi_rows(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
    )
    board = Window.partitionBy("k")
    order = board.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "q")
    pads = lines.select(
        "k", "q", "disc", "tax",
        F.row_number().over(order).cast("bigint").alias("pi"),
        F.count(F.lit(1)).over(board).alias("n_pads"),
    )
    copies = F.when(F.expr("k % 41 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = pads.withColumn("insp", F.explode(copies)).withColumns({
        "wide": F.expr("n_pads >= 10 AND k % 3 = 0"),
        "burst": F.expr("pi = 1 AND k % 613 BETWEEN 100 AND 104"),
        "ts": F.timestamp_seconds(
            F.lit(EPOCH_2024) + F.expr("(7 * k + 45 * (k div 50) + 5 * insp) * 60")
        ),
    })
    judged = seen.withColumn(
        "comp_errname",
        F.expr("""CASE WHEN insp = 1 AND k % 82 = 0 THEN 'PASS'
                       WHEN burst THEN 'Over Volume'
                       WHEN wide THEN 'Under Height'
                       WHEN q >= 48 AND disc >= CAST(0.08 AS DOUBLE) THEN
                            CASE WHEN tax < CAST(0.03 AS DOUBLE) THEN 'AREAOVER'
                                 WHEN tax < CAST(0.06 AS DOUBLE) THEN 'Over Volume'
                                 ELSE 'Under_Volume' END
                       ELSE 'PASS' END"""),
    ).withColumn("bad", F.expr("comp_errname <> 'PASS'"))
    ramp = "CASE WHEN pi = 2 AND k % 1500 BETWEEN 1000 AND 1100 THEN CAST(k % 1500 - 1000 AS DOUBLE) / CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    return judged.select(
        F.expr("k * 1000 + pi * 10 + insp").alias("row_id"),
        F.format_string("B%06d", "k").alias("barcode"),
        F.expr("concat('M', k div 500 % 3)").alias("cmodel"),
        F.expr("concat('W', k div 100)").alias("work_order"),
        F.expr("concat('L', k div 2000 % 2)").alias("machinename"),
        "ts",
        F.date_format("ts", "yyyy/M/d H:mm").alias("fdate"),
        F.expr("concat('C', (pi - 1) div 2, '_', (pi - 1) % 2 + 1)").alias("compname"),
        "comp_errname",
        F.expr(
            "CAST(10 AS DOUBLE) + q / CAST(5 AS DOUBLE)"
            " + CASE WHEN burst THEN CAST(60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
            f" + {ramp}"
            " + CASE WHEN bad THEN CAST(25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        ).alias("comp_avdp"),
        F.expr(
            "CAST(8 AS DOUBLE) + CAST(50 AS DOUBLE) * tax"
            " + CASE WHEN bad THEN CAST(20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        ).alias("comp_aadp"),
        F.expr("CAST(6 AS DOUBLE) + CAST(40 AS DOUBLE) * disc").alias("comp_ahdp"),
        F.expr("CAST((pi - 1) % 4 * 10 + 5 AS DOUBLE)").alias("comp_px"),
        F.expr("CAST((pi - 1) div 4 * 10 + 5 AS DOUBLE)").alias("comp_py"),
        F.expr("CAST(40 + 5 * (k div 700 % 2) AS DOUBLE)").alias("printspeed_plan"),
        F.expr(
            "CAST(40 + 5 * (k div 700 % 2) AS DOUBLE) + CAST(k % 7 AS DOUBLE) / CAST(100 AS DOUBLE)"
        ).alias("printspeed"),
        F.expr("CAST(k % 7 AS DOUBLE) / CAST(100 AS DOUBLE)").alias("diff_printspeed"),
        F.expr(
            "CAST(k % 7 AS DOUBLE) / CAST(100 AS DOUBLE)"
            " + CASE WHEN k % 613 BETWEEN 100 AND 104 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        ).alias("abs_printspeed"),
        _d("2").alias("snapoffspeed_plan"),
        F.expr("CAST(2 AS DOUBLE) + CAST(k % 5 AS DOUBLE) / CAST(1000 AS DOUBLE)").alias("snapoffspeed"),
        F.expr("CAST(k % 5 AS DOUBLE) / CAST(1000 AS DOUBLE)").alias("diff_snapoffspeed"),
        F.expr("CAST(k % 5 AS DOUBLE) / CAST(1000 AS DOUBLE)").alias("abs_snapoffspeed"),
        F.expr("CAST(k % 3 AS DOUBLE)").alias("markdeviation_plan"),
        F.expr("CAST(5 + k % 2 AS DOUBLE)").alias("frontsqgpress"),
        _d("5").alias("rearsqgpress"),
        F.expr("concat('P', k div 900 % 2)").alias("printmode"),
        _d("3").alias("cleaningfrequency"),
        _d("0").alias("temperature"),
        _d("0").alias("humidity"),
        F.expr("CASE WHEN k % 2 = 0 THEN 'F' ELSE 'R' END").alias("printdirection"),
        F.expr("80 + 80 * (k % 2)").alias("total_pads"),
    )


def limits_rows(spi: DataFrame) -> DataFrame:
    """The limits contract: measured value with upper and lower limit per metric.
    Half of the boards carry the machine's label, the others only limits."""
    from boardlens.functions.scalars import component_of, pad_of

    return spi.select(
        "row_id", "work_order", F.col("cmodel").alias("product_name"),
        F.col("barcode").alias("board_sn"), F.col("ts").alias("inspect_time"),
        F.col("machinename").alias("machine"), F.lit("TOP").alias("side"),
        component_of("compname").alias("component"), pad_of("compname").alias("pad"),
        F.when(F.expr("row_id div 1000 % 2 = 0"), F.col("comp_errname")).alias("raw_ng_type"),
        F.col("comp_avdp").alias("volume"), _d("40").alias("volume_upper"), _d("10.5").alias("volume_lower"),
        F.col("comp_aadp").alias("area"), _d("11.9").alias("area_upper"), _d("8.1").alias("area_lower"),
        F.col("comp_ahdp").alias("height"), _d("9.9").alias("height_upper"), _d("6.1").alias("height_lower"),
        F.col("comp_avdp").alias("volume_deviation_percent"),
        F.col("comp_aadp").alias("area_deviation_percent"),
        F.col("comp_ahdp").alias("height_deviation_percent"),
    )
