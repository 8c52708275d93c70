"""Queries: process dimensions."""

from __future__ import annotations

from boardlens.functions.stats import r6
from boardlens.operators import process as P
from boardlens.operators.inspections import production_boards
from boardlens.plans.oracle import define
from boardlens.plans.registry import query, rows

define("made_boards", """
SELECT *, row_number() OVER (ORDER BY ts, barcode, fdate) - 1 AS place FROM (
 SELECT barcode, fdate, min(ts) AS ts, round(avg(comp_avdp), 9) AS mean_avdp, count(*) FILTER (ng) AS bad, arg_min(cleaningfrequency, row_id) AS cleaningfrequency,
  arg_min(frontsqgpress, row_id) AS frontsqgpress, arg_min(rearsqgpress, row_id) AS rearsqgpress, arg_min(printdirection, row_id) AS printdirection
 FROM firsts GROUP BY barcode, fdate)
""")
define("noise_row", """
SELECT sd AS noise_sd, greatest(1.0::DOUBLE, 0.5::DOUBLE * coalesce(sd, 0)) AS threshold
FROM (SELECT CASE WHEN count(mean_avdp) >= 2 THEN stddev_pop(mean_avdp) END AS sd FROM made_boards)
""")
define("wipe_every", """
SELECT CAST(cleaningfrequency AS BIGINT) AS frequency FROM made_boards WHERE cleaningfrequency <> 0
GROUP BY cleaningfrequency ORDER BY count(*) DESC, cleaningfrequency LIMIT 1
""")
define("wipe_profile", """
SELECT frequency, place % frequency AS position, round(avg(mean_avdp), 2) AS mean, count(*) AS boards FROM made_boards, wipe_every GROUP BY 1, 2
""")


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


@query("noise_sd", "SELECT round(noise_sd, 6) AS noise_sd, round(threshold, 6) AS threshold FROM noise_row")
def noise_sd(spark, sf):
    return _rounded(P.noise(production_boards(rows(spark, sf))), "noise_sd", "threshold")


def _placed(spark, sf):
    return P.in_order(production_boards(rows(spark, sf)))


@query("cleaning_profile", "SELECT * FROM wipe_profile")
def cleaning_profile(spark, sf):
    return P.cleaning_profile(_placed(spark, sf))


@query("cleaning_cycle", """
SELECT CASE WHEN amplitude >= threshold THEN 'effect' ELSE 'no_effect' END AS verdict, frequency, positions,
 round(amplitude, 6) AS amplitude, round(threshold, 6) AS threshold
FROM (SELECT count(*) AS positions, max(mean) - min(mean) AS amplitude FROM wipe_profile), wipe_every, noise_row""")
def cleaning_cycle(spark, sf):
    return _rounded(P.cleaning_cycle(_placed(spark, sf)), "amplitude", "threshold")


@query("first_board_effect", """
SELECT CASE WHEN first_boards < 30 THEN 'insufficient' WHEN m1 - m0 >= threshold THEN 'effect' ELSE 'no_effect' END AS verdict, first_boards, other_boards,
 first_ng_boards, other_ng_boards, round(m1, 6) AS first_mean, round(m0, 6) AS other_mean, round(m1 - m0, 6) AS delta, round(threshold, 6) AS threshold FROM (
 SELECT count(*) FILTER (f) AS first_boards, count(*) FILTER (NOT f) AS other_boards, count(*) FILTER (f AND bad > 0) AS first_ng_boards,
  count(*) FILTER (NOT f AND bad > 0) AS other_ng_boards, avg(mean_avdp) FILTER (f) AS m1, avg(mean_avdp) FILTER (NOT f) AS m0
 FROM (SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY place) >= INTERVAL 30 MINUTE, false) AS f FROM made_boards)), noise_row""")
def first_board_effect(spark, sf):
    return _rounded(P.first_board_effect(_placed(spark, sf)), "first_mean", "other_mean", "delta", "threshold")


@query("print_direction_effect", """
SELECT CASE WHEN delta >= threshold THEN 'effect' ELSE 'no_effect' END AS verdict, directions, round(delta, 6) AS delta,
 round(threshold, 6) AS threshold, round(proxy, 6) AS odd_even_proxy, pressure_varies
FROM (SELECT count(*) AS directions, max(mean) - min(mean) AS delta FROM (SELECT printdirection, round(avg(mean_avdp), 2) AS mean FROM made_boards GROUP BY 1)),
 (SELECT avg(mean_avdp) FILTER (place % 2 = 1) - avg(mean_avdp) FILTER (place % 2 = 0) AS proxy,
  count(DISTINCT (frontsqgpress, rearsqgpress)) > 1 AS pressure_varies FROM made_boards), noise_row""")
def print_direction_effect(spark, sf):
    return _rounded(P.print_direction_effect(_placed(spark, sf)), "delta", "threshold", "odd_even_proxy")
