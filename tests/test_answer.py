"""RES-1 / ART-*: request status over hand-made analyses and faults."""

import json

from pyspark.sql import functions as F

from wayfare.operators.answer import route_batch
from wayfare.operators.lookup import live_rows

Q = "2026-06-20从富山去东京，帮我查天气和火车票"


def _model(agents, slots):
    return json.dumps({"required_agents": agents, "slots": slots}, ensure_ascii=False)


SLOTS = {"departure_city": "富山", "arrival_city": "东京", "travel_date": "2026-06-20"}


def _tables(spark):
    tickets = spark.createDataFrame(
        [("富山", "东京", "2026-06-20 09:21:00", "2026-06-20 11:30:00", "Kagayaki 508", "G", 100, 42, "12760.00"),
         ("富山", "东京", "2026-06-20 14:21:00", "2026-06-20 16:40:00", "Hakutaka 566", "G", 100, 65, "12100.00"),
         ("富山", "东京", "2026-06-20 10:33:00", "2026-06-20 12:40:00", "Hakutaka 560", "G", 100, 86, "12100.00")],
        "departure_city string, arrival_city string, d string, a string, train_number string, seat_type string, "
        "total_seats int, remaining_seats int, p string").select(
        "departure_city", "arrival_city", F.to_timestamp_ntz("d").alias("departure_time"),
        F.to_timestamp_ntz("a").alias("arrival_time"), "train_number", "seat_type", "total_seats",
        "remaining_seats", F.col("p").cast("decimal(10,2)").alias("price"))
    weather = spark.createDataFrame([("东京", "2026-06-20", 25, 18, "晴", 60, "0.0")],
                                    "city string, d string, temp_max int, temp_min int, text_day string, "
                                    "humidity int, p string").select(
        "city", F.to_date("d").alias("fx_date"), "temp_max", "temp_min", "text_day",
        F.lit(None).cast("string").alias("text_night"), F.lit(None).cast("string").alias("wind_dir_day"),
        F.lit(None).cast("string").alias("wind_scale_day"), F.lit(None).cast("int").alias("wind_speed_day"),
        F.col("p").cast("decimal(5,1)").alias("precip"), F.lit(None).cast("int").alias("uv_index"), "humidity",
        F.lit(None).cast("int").alias("pressure"), F.lit(None).cast("int").alias("vis"),
        F.lit(None).cast("int").alias("cloud"), F.lit(None).cast("timestamp_ntz").alias("update_time"))
    payload = spark.createDataFrame([], "name string, latitude double, longitude double, daily struct<"
                                        "time array<string>, temperature_2m_max array<double>, "
                                        "temperature_2m_min array<double>, precipitation_sum array<double>, "
                                        "weather_code array<int>, wind_speed_10m_max array<double>, "
                                        "wind_direction_10m_dominant array<double>>")
    return tickets, weather, live_rows(payload)


def test_statuses(spark):
    tickets, weather, live = _tables(spark)
    both = dict(SLOTS, city="东京", fx_date="2026-06-20")
    reqs = spark.createDataFrame([
        ("ok", Q, _model([], both)),
        ("partial", Q, _model([], both)),
        ("down", Q, _model([], both)),
        ("clarify", "帮我查一下天气", _model([], {})),
        ("none", "随便聊聊", _model(["hotel_agent"], {})),
        ("nf", "2026-06-21从富山去东京的火车票", _model([], dict(SLOTS, travel_date="2026-06-21"))),
    ], "request_id string, query string, model_output string")
    faults = spark.createDataFrame([("partial", "weather_agent", "boom"), ("down", "weather_agent", "boom"),
                                    ("down", "ticket_agent", "boom")], "request_id string, agent string, error string")
    out = {r.request_id: r for r in route_batch(reqs, tickets, live, weather, faults, "2026-06-15",
                                                "2026-06-15T00:00:00").collect()}
    assert out["ok"].status == "success" and out["ok"].artifact_count == 2
    assert out["ok"].ticket_summary.startswith("查询到 富山 到 东京 的车票，共 3 个班次。推荐参考 Kagayaki 508")
    assert "价格约 12760.0 日元，余票 42 张。" in out["ok"].ticket_summary
    assert out["ok"].weather_summary == "东京 2026-06-20 白天天气为晴，气温约 18-25°C，湿度 60%，降水量 0.0mm。"
    assert out["partial"].status == "partial_success" and out["partial"].artifact_count == 1
    assert out["down"].status == "agent_failed" and out["down"].artifact_count == 0
    assert out["clarify"].status == "need_clarification" and out["clarify"].called_agents == []
    assert out["none"].status == "no_supported_agent"
    assert out["nf"].status == "success" and out["nf"].ticket_status == "not_found"


def test_single_request_tools(spark):
    from wayfare.plans.tools import query_train_tickets, query_train_tickets_sql, query_weather
    tickets, weather, live = _tables(spark)
    got = [r.train_number for r in query_train_tickets(spark, tickets, "富山", "东京", "2026-06-20")
           .orderBy("rank").collect()]
    assert got == ["Kagayaki 508", "Hakutaka 560", "Hakutaka 566"]
    tickets.createOrReplaceTempView("tickets_fixture")
    got_sql = [r.train_number for r in query_train_tickets_sql(spark, "tickets_fixture", "富山", "东京",
                                                                "2026-06-20").collect()]
    assert got_sql == got
    assert query_train_tickets(spark, tickets, "富山", "东京", "2026-6-20").count() == 0
    w = query_weather(spark, live, weather, "东京", "2026-06-20", "2026-06-15").first()
    assert w.source == "database" and w.humidity == 60
    assert query_weather(spark, live, weather, "东京", "2026-06-21", "2026-06-15").count() == 0


def test_prompt_parts_join_to_the_prompts(spark):
    from wayfare.operators.answer import prompt_parts, prompt_rows
    from wayfare.operators.lookup import first_departures
    tickets, weather, live = _tables(spark)
    tickets = tickets.unionByName(tickets.withColumn("departure_city", F.lit("大阪")))  # a route nobody asks for
    both = dict(SLOTS, city="东京", fx_date="2026-06-20")
    reqs = spark.createDataFrame([
        ("both", Q, _model([], both)), ("again {artifacts}", Q, _model([], both)), ("partial", Q, _model([], both)),
        ("tickets", "2026-06-20从富山去东京的火车票", _model([], SLOTS)),
        ("nf", "2026-06-21从富山去东京的火车票", _model([], dict(SLOTS, travel_date="2026-06-21"))),
        ("clarify", "帮我查一下天气", _model([], {}))], "request_id string, query string, model_output string")
    faults = spark.createDataFrame([("partial", "ticket_agent", "boom")], "request_id string, agent string, error string")
    run = lambda **k: route_batch(reqs, tickets, live, weather, faults, "2026-06-15", "2026-06-15T00:00:00", with_data=True, **k)
    want = {r.request_id: r.prompt for r in prompt_rows(run()).collect()}
    assert len(want) == 5
    for rows, most in ((2, 2), (1, 3), (1000, 1)):
        parts = {}
        for r in prompt_parts(run(listed=False), tickets, rows).orderBy("request_id", "part_no").collect():
            parts.setdefault(r.request_id, []).append((r.part_no, r.text))
        assert {k: "".join(t for _, t in v) for k, v in parts.items()} == want
        assert [n for n, _ in parts["both"]] == list(range(most + 2)) and [n for n, _ in parts["nf"]] == [0]
    asked = spark.createDataFrame([("富山", "东京", "2026-06-20")], "a string, b string, c string")
    plan = first_departures(asked, tickets, "a", "b", "c", listed=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # other routes aren't gathered
