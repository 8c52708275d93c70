"""Small cases the test tables do not hold: missing times and keys, ties, exact gaps."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boardlens.functions.ordered import ranked
from boardlens.operators import events as E
from boardlens.operators.inspections import keyed

START = datetime(2024, 1, 9, 3, 0)
SCHEMA = ("row_id long, barcode string, fdate string, ts timestamp, cmodel string, machinename string, "
          "compname string, comp_errname string, temperature double, humidity double")


def board(number, minute, error="Over Volume", machine="L0"):
    ts = None if minute is None else START + timedelta(minutes=minute)
    return (number, f"B{number}", f"t{minute}", ts, "M0", machine, "C1_1", error, None, None)


def spi(spark, rows):
    return keyed(spark.createDataFrame(rows, SCHEMA))


def test_ranked_numbers_ties_and_missing_times_once(spark):
    df = spark.range(200).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(0))).alias("ts")).withColumn("x", F.lit(1))
    got = ranked(df, ("ts", "id"), "no").orderBy("no").collect()
    want = sorted(range(200), key=lambda i: (i % 3 == 0, i))
    assert [r.no for r in got] == list(range(1, 201))
    assert [r.id for r in got] == want
    assert ranked(df.where("id < 0"), ("ts", "id"), "no").count() == 0


def test_a_gap_of_thirty_minutes_stays_and_a_longer_one_splits(spark):
    rows = spi(spark, [board(1, 0), board(2, 30), board(3, 61), board(4, 62, machine=None), board(5, None),
                       board(6, 10, error="PASS"), board(7, 62, error="Under Volume")])
    members = E.event_boards(E.direction_boards(rows))
    events = E.ng_events(members)
    named = E.event_members(members, events)
    got = {}
    for r in named.collect():
        got.setdefault(r.event_id, set()).add(r.barcode)
    assert sorted(map(sorted, got.values())) == [["B1", "B2"], ["B3"], ["B4"], ["B7"]]
    assert sorted(got) == ["EVT001", "EVT002", "EVT003", "EVT004"] and got["EVT001"] == {"B1", "B2"}
    assert {r.duration_minutes for r in events.where("board_count = 2").collect()} == {30}


def test_no_rows_no_events(spark):
    members = E.event_boards(E.direction_boards(spi(spark, [])))
    assert E.ng_events(members).count() == 0
    assert not E.environment_recorded(spi(spark, [])).first().environment_recorded
