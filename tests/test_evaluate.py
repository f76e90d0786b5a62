"""EVL-* / JON-8 on hand-made cases."""

from pyspark.sql import functions as F

import pytest

from wayfare.operators import evaluate as V

CASE = "id string, category string, query string, expected struct<intent: string, required_agents: array<string>, " \
       "slots: map<string,string>, missing_slots: array<string>, need_clarification: boolean>"
PRED = "id string, intent string, required_agents array<string>, slot_departure_city string, slot_arrival_city string, " \
       "slot_travel_date string, slot_city string, slot_fx_date string, missing_slots array<string>, " \
       "need_clarification boolean, error string, latency_ms long"


def _tables(spark):
    label = ("weather_query", ["weather_agent"], {"city": "A", "fx_date": "2024-01-01"}, [], False)
    cases = spark.createDataFrame([(f"weather_0{i}", "weather", "q", label) for i in (1, 2, 3)], CASE)
    good = ("weather_query", ["weather_agent"], None, None, None, "A ", "2024-01-01", [], False, None, 100)
    preds = spark.createDataFrame([
        ("weather_01", *good), ("weather_03", "unknown", *good[1:5], "B", *good[6:]), ("other", *good)], PRED)
    return cases, preds


def test_case_without_prediction_fails(spark):
    scored = V.score(*_tables(spark))
    rows = {r.id: r for r in scored.collect()}
    assert sorted(rows) == ["weather_01", "weather_02", "weather_03"]
    assert not rows["weather_01"].failed and rows["weather_01"].error == ""
    assert rows["weather_02"].error == V.NO_PREDICTION and rows["weather_02"].latency_ms is None
    assert rows["weather_02"].missing_slots_ok and not rows["weather_02"].intent_ok
    total = V.summary(scored).first()
    assert (total.case_count, total.failed_count, total.intent_hits, total.agent_routing_hits) == (3, 2, 1, 2)
    assert total.average_latency_seconds == 0.1
    failed = V.failures(scored).orderBy("position").collect()
    assert [(r.position, r.id, r.failed_checks) for r in failed] == [
        (1, "weather_02", "intent,agent_routing,slot_exact"), (2, "weather_03", "intent,slot_exact")]


def test_no_cases_give_zeros(spark):
    cases, preds = _tables(spark)
    total = V.summary(V.score(cases.limit(0), preds)).first()
    assert (total.case_count, total.intent_accuracy, total.average_latency_seconds) == (0, 0.0, 0.0)


@pytest.mark.parametrize("most", [30, 1 << 20])
def test_percentiles_by_rank_equal_the_aggregate(spark, most):
    from wayfare.operators.evaluate import percentiles
    scored = spark.range(5000).selectExpr("CASE WHEN id < 4500 THEN 'all' WHEN id < 4502 THEN 'two' WHEN id < 4503 THEN 'one' ELSE 'none' END AS category",
                                          "CASE WHEN id >= 4503 THEN NULL WHEN id % 2 = 0 THEN id * 31 % 977 ELSE 500 END AS latency_ms")
    want = scored.groupBy("category").agg(*[F.round(F.percentile("latency_ms", F.lit(p)), 3).alias(c) for c, p in (("p50_ms", 0.5), ("p90_ms", 0.9))])
    assert sorted(map(str, percentiles(scored, most=most).collect())) == sorted(map(str, want.collect()))
    assert percentiles(scored.limit(0)).count() == 0
