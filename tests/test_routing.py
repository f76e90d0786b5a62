"""RTE-1..3: golden routing cases (both negations, flights, admission tickets)."""

import json

import pytest

from wayfare.operators import routing as R

EMPTY = json.dumps({"required_agents": [], "slots": {}})


def model(agents, slots=None):
    return json.dumps({"intent": "whatever", "required_agents": agents, "slots": slots or {}}, ensure_ascii=False)


GOLDEN = [
    ("不要查天气，只查火车票", EMPTY, ["ticket_agent"], "ticket_query"),
    ("不用看车票，只看天气", EMPTY, ["weather_agent"], "weather_query"),
    ("不要查天气，也不要查票", model(["weather_agent", "ticket_agent"]), [], "unknown"),
    ("我不是要机票，是要火车票", EMPTY, ["ticket_agent"], "ticket_query"),
    ("帮我订一张机票", model(["ticket_agent"]), [], "unknown"),
    ("我想买演唱会门票", model(["ticket_agent"]), [], "unknown"),
    ("还有票吗", EMPTY, ["ticket_agent"], "ticket_query"),
    ("帮我看看适不适合出行", model(["weather_agent", "weather_agent"]), ["weather_agent", "weather_agent"],
     "travel_planning"),
    ("帮我看看适不适合出行", model(["hotel_agent"]), [], "unknown"),
    ("天气和火车票都要", EMPTY, ["weather_agent", "ticket_agent"], "travel_planning"),
]


@pytest.mark.parametrize("query,raw,agents,intent", GOLDEN)
def test_golden(spark, query, raw, agents, intent):
    df = spark.createDataFrame([(query, raw)], "query string, model_output string")
    r = R.analyze(df).first()
    assert r.required_agents == agents
    assert r.intent == intent


def test_slot_derivation_and_missing(spark):
    raw = model(["weather_agent", "ticket_agent"],
                {"departure_city": "富山", "arrival_city": "东京", "travel_date": "2026-06-20", "city": "未知"})
    df = spark.createDataFrame([("帮我查天气和车票", raw)], "query string, model_output string")
    r = R.analyze(df).first()
    assert r.slot_city == "东京" and r.slot_fx_date == "2026-06-20"
    assert r.missing_slots == [] and r.need_clarification is False and r.clarification_question == ""


def test_missing_slots_question(spark):
    df = spark.createDataFrame([("帮我查一下天气", EMPTY)], "query string, model_output string")
    r = R.analyze(df).first()
    assert r.missing_slots == ["city", "fx_date"]
    assert r.clarification_question == "请补充以下信息：天气城市、天气日期。"


def test_unparseable_model_text(spark):
    df = spark.createDataFrame([("天气", "抱歉")], "query string, model_output string")
    r = R.analyze(df).first()
    assert r.error is not None and r.required_agents is None
