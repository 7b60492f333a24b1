"""Prices in provider payloads: nested objects, and first keys that cannot be used."""

import json

import pytest
from pyspark.sql import functions as F

from matchgrain.operators import value


def prices(spark, **item):
    rows = spark.createDataFrame([(1, json.dumps({"items": [{"provider": {"id": "p"}, **item}]}))], "match_id long, payload string")
    return {(r.market, r.selection): r.decimal_odds for r in value.parse_payloads(rows).collect()}


@pytest.mark.parametrize(
    ("odds", "want"),
    [({"moneyLine": {"american": "+150"}}, 2.5), ({"moneyLine": "OFF", "decimal": 3.2}, 3.2), ({"moneyLine": {"decimal": "OFF", "american": "+150"}, "odds": 4.5}, 4.5), ({"american": "+150"}, None),
     ("-200", 1.5), (2.25, 2.25), (None, None), ({"value": {"value": {"value": {"value": 1.75}}}}, 1.75), ({"moneyLine": None}, None), ({}, None), ([2.5], None)],
)
def test_side_prices(spark, odds, want):
    assert prices(spark, homeTeamOdds=odds).get(("1x2", "home")) == want


@pytest.mark.parametrize(("odds", "want"), [({"decimal": "OFF", "american": "+120"}, None), ({"american": "+120"}, 2.2), ({"decimal": None, "value": 2.0}, None), ({"odds": 2.0}, None), ("EVEN", 2.0), ({"decimalOdds": {"moneyLine": -110}}, 1.9091)])
def test_total_prices_are_decided_by_the_first_key(spark, odds, want):
    assert prices(spark, overUnder=2.5, overOdds=odds).get(("totals", "over")) == want


def test_double_chance_settles(spark):
    rows = spark.createDataFrame([("home_or_draw", 1, 1), ("home_or_draw", 0, 1), ("home_or_away", 1, 1), ("home_or_away", 2, 1), ("draw_or_away", 2, 1), ("other", 0, 0)], "s string, h int, a int")
    got = rows.select(value.settled(F.lit("double_chance"), F.col("s"), F.lit(""), F.col("h"), F.col("a")).alias("won")).collect()
    assert [r.won for r in got] == [True, False, False, True, False, None]
