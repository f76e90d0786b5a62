"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables through ``bindings`` and runs one
operator (or a chain) over the whole tables. Report shapes render dates,
timestamps and lists as text so results compare exactly across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators import cases as K
from wayfare.operators import lookup as L
from wayfare.operators import routing as R
from wayfare.operators.ordering import even_sample
from wayfare.plans import bindings as B
from wayfare.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# --- keys, samples, semi/anti joins ------------------------------------------

@register("route_day_counts")
def route_day_counts(spark, sf):
    return B.route_keys(spark, sf)


@register("reading_keys")
def reading_keys(spark, sf):
    return K.reading_keys(B.readings(spark, sf))


@register("routes_with_readings")
def routes_with_readings(spark, sf):
    return K.routes_with_readings(B.route_keys(spark, sf), K.reading_keys(B.readings(spark, sf)))


@register("routes_without_readings")
def routes_without_readings(spark, sf):
    return K.routes_without_readings(B.route_keys(spark, sf), K.reading_keys(B.readings(spark, sf)))


@register("even_sample")
def even_sample_q(spark, sf):
    keys = cut_lineage(B.route_keys(spark, sf))  # the sampler reads it more than once
    rows = even_sample(keys, K.ROUTE_ORDER, C.CASE_COUNTS["ticket"])
    return rows.select("pick", "departure_city", "arrival_city", "travel_date", "ticket_count")


# --- lookups -------------------------------------------------------------------

@register("route_day_search")
def route_day_search(spark, sf):
    req = B.requests(spark, sf).select("request_id", "departure_city", "arrival_city", "asked_date")
    hits = L.search_tickets(req, B.trips(spark, sf), date="asked_date")
    return hits.select(
        "request_id", "asked_date", "rank", "train_number", "seat_type",
        X.iso_datetime("departure_time").alias("departure_time"),
        X.iso_datetime("arrival_time").alias("arrival_time"),
        "total_seats", "remaining_seats", F.col("price").cast("double").alias("price"))


def _first(spark, sf) -> DataFrame:
    req = B.requests(spark, sf).select("request_id", "departure_city", "arrival_city", "asked_date")
    return L.first_departures(req, B.trips(spark, sf), date="asked_date")


@register("first_departure")
def first_departure(spark, sf):
    return _first(spark, sf).select(
        "request_id", "asked_date", "ticket_count", F.col("first.train_number").alias("first_train"),
        X.iso_datetime("first.departure_time").alias("first_departure"),
        F.col("first.price").cast("double").alias("first_price"))


@register("ticket_summary")
def ticket_summary(spark, sf):
    f = _first(spark, sf)
    return f.select("request_id", "ticket_count",
                    L.ticket_summary_text(F.col("first"), F.col("ticket_count")).alias("summary"))


@register("collated_first_departure")
def collated_first_departure(spark, sf):
    """Requests that spell cities in lower case, with accents and blanks."""
    other = lambda c: F.concat(F.translate(F.lower(c), "aeiou", "\u00e1\u00e8\u00ee\u00f6\u00fc"), F.lit("  ")).alias(c)
    req = B.requests(spark, sf).select("request_id", other("departure_city"), other("arrival_city"), "asked_date")
    out = L.first_departures(*L.same_cities(req, B.trips(spark, sf), ["departure_city", "arrival_city"]), date="asked_date")
    return out.select("request_id", "ticket_count", F.col("first.train_number").alias("first_train"))


@register("collated_reading")
def collated_reading(spark, sf):
    """Weather asked for in lower case and with an accent."""
    req = B.requests(spark, sf).select("request_id", F.translate(F.lower("arrival_city"), "ae", "\u00e0\u00e9").alias("city"), "asked_date")
    out = L.stored_weather(*L.same_cities(req, B.weather_table(spark, sf), ["city"]), date="asked_date")
    return out.select("request_id", F.col("w_source").alias("source"), F.col("w_temp_max").alias("temp_max"), F.col("w_humidity").alias("humidity"))


@register("reading_lookup")
def reading_lookup(spark, sf):
    req = B.requests(spark, sf).select("request_id", "arrival_city", "asked_date")
    out = L.stored_weather(req, B.weather_table(spark, sf), city="arrival_city", date="asked_date")
    return out.select(
        "request_id", F.col("arrival_city").alias("city"), F.col("asked_date").alias("fx_date"),
        F.col("w_source").alias("source"), F.col("w_temp_max").alias("temp_max"),
        F.col("w_temp_min").alias("temp_min"), F.col("w_text_day").alias("text_day"),
        F.col("w_text_night").alias("text_night"), F.col("w_wind_speed_day").alias("wind_speed_day"),
        F.col("w_precip").cast("double").alias("precip"), F.col("w_humidity").alias("humidity"),
        X.iso_datetime("w_update_time").alias("update_time"))


# --- routing -------------------------------------------------------------------

def _analysis(spark, sf) -> DataFrame:
    return R.analyze(B.requests(spark, sf).select("request_id", "query", "model_output"))


@register("domain_flags")
def domain_flags(spark, sf):
    return R.with_flags(B.requests(spark, sf).select("request_id", "query")).select(
        "request_id", *R.FLAG_COLUMNS)


@register("required_agents")
def required_agents(spark, sf):
    a = _analysis(spark, sf)
    return a.select("request_id", X.list_text("required_agents").alias("required_agents"), "intent")


@register("normalized_analysis")
def normalized_analysis(spark, sf):
    return R.analysis_report(_analysis(spark, sf), "request_id")


@register("missing_slots")
def missing_slots(spark, sf):
    a = _analysis(spark, sf)
    return a.select("request_id", X.list_text("missing_slots").alias("missing_slots"), "need_clarification")


@register("clarification")
def clarification(spark, sf):
    a = _analysis(spark, sf)
    return a.filter("need_clarification").select("request_id", "clarification_question")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


# --- live over stored, codes, candidates ------------------------------------

CREATED_AT = "2024-01-15T00:00:00"


@register("live_or_stored")
def live_or_stored(spark, sf):
    req = B.weather_requests(spark, sf)
    out = L.live_or_stored(req, L.live_rows(B.live_payloads(spark, sf)), B.weather_table(spark, sf), B.AS_OF)
    return out.select("city", "fx_date", "source", "weather_city", "weather_date", "temp_max", "temp_min",
                      "text_day", "humidity", "precip")


@register("forecast_window")
def forecast_window(spark, sf):
    e = L.explode_payloads(B.live_payloads(spark, sf))
    return e.select(F.col("name").alias("city"), "fx_date",
                    L.in_forecast_window(F.col("fx_date"), B.AS_OF).alias("in_window"))


@register("landed_forecasts")
def landed_forecasts(spark, sf):
    """SRC-6: payloads landed as JSON lines, read back and laid out by day."""
    from wayfare.sources.files import read_payloads
    from wayfare.streaming.streams import scratch
    path = scratch(spark, "payloads")
    B.live_payloads(spark, sf).write.json(path)
    e = L.explode_payloads(read_payloads(spark, path))
    return e.select(F.col("name").alias("city"), "fx_date", "temp_max", "temp_min", "precip", "weather_code", "wind_speed_day")


@register("code_text")
def code_text(spark, sf):
    e = L.explode_payloads(B.live_payloads(spark, sf))
    return e.select(F.col("name").alias("city"), "fx_date", "weather_code",
                    L.code_text(F.col("weather_code")).alias("text_day"), "wind_speed_day")


@register("first_candidate")
def first_candidate(spark, sf):
    out = L.first_candidate(B.place_names(spark, sf), B.candidates(spark, sf))
    return out.select("name", "cand_name", "latitude", "longitude")


# --- model text and tool text -------------------------------------------------

@register("model_output_json")
def model_output_json(spark, sf):
    from wayfare.functions.modeltext import model_json
    r = B.requests(spark, sf).select("request_id", "model_output")
    return model_json(r, "model_output").select("request_id", "model_json", "model_error")


@register("tool_result_triage")
def tool_result_triage(spark, sf):
    from wayfare.functions.modeltext import triage_tool_text
    return triage_tool_text(B.tool_texts(spark, sf), "tool_text").select("request_id", "raw_status", "status")


# --- tasks, artifacts, status ------------------------------------------------

@register("sql_functions")
def sql_functions(spark, sf):
    """UDF-1 as a SQL user calls it."""
    from wayfare.plans.tools import register_sql_functions
    register_sql_functions(spark)
    B.requests(spark, sf).createOrReplaceTempView("wayfare_requests")
    return spark.sql("SELECT request_id, x.json AS model_json, x.error AS model_error FROM "
                     "(SELECT request_id, extract_model_json(model_output) AS x FROM wayfare_requests)")


@register("ticket_tool")
def ticket_tool(spark, sf):
    """UDF-2 for the first route and day of the tickets."""
    from wayfare.plans.tools import query_train_tickets
    trips = B.trips(spark, sf)
    k = trips.agg(F.min(F.struct("departure_city", "arrival_city", F.to_date("departure_time").cast("string").alias("d"))).alias("k")).first()["k"]
    t = query_train_tickets(spark, trips, k["departure_city"], k["arrival_city"], k["d"])
    return t.select("rank", "train_number", "seat_type", X.iso_datetime("departure_time").alias("departure_time"),
                    X.iso_datetime("arrival_time").alias("arrival_time"), "total_seats", "remaining_seats",
                    F.col("price").cast("double").alias("price"))


@register("weather_tool")
def weather_tool(spark, sf):
    """UDF-3 for the first city and day of the weather table."""
    from wayfare.plans.tools import query_weather
    weather = B.weather_table(spark, sf)
    k = weather.agg(F.min(F.struct("city", F.col("fx_date").cast("string").alias("d"))).alias("k")).first()["k"]
    w = query_weather(spark, L.live_rows(B.live_payloads(spark, sf)), weather, k["city"], k["d"], B.AS_OF)
    return w.select("city", "fx_date", "source", "weather_city", "weather_date", "temp_max", "temp_min", "text_day", "humidity", "precip")


@register("slot_aliases")
def slot_aliases(spark, sf):
    from wayfare.operators.answer import task_slots
    t = B.tasks(spark, sf)
    ts = task_slots(F.col("slots"), F.col("metadata"), C.TICKET_ALIASES)
    ws = task_slots(F.col("slots"), F.col("metadata"), C.WEATHER_ALIASES)
    return t.select("request_id", "shape", *[v.alias(k) for k, v in ts.items()], *[v.alias(k) for k, v in ws.items()])


@register("ticket_tasks")
def ticket_tasks(spark, sf):
    from wayfare.operators.answer import ticket_artifacts
    out = ticket_artifacts(B.tasks(spark, sf), B.trips(spark, sf), CREATED_AT)
    return out.select("request_id", F.col("artifact.artifact_type").alias("artifact_type"),
                      F.col("artifact.agent").alias("agent"), F.col("artifact.status").alias("status"),
                      F.col("artifact.summary").alias("summary"), F.col("artifact.data").alias("data"), "ticket_count",
                      X.list_text("missing").alias("missing"))


@register("weather_tasks")
def weather_tasks(spark, sf):
    from wayfare.operators.answer import weather_artifacts
    out = weather_artifacts(B.tasks(spark, sf), L.live_rows(B.live_payloads(spark, sf)),
                            B.weather_table(spark, sf), B.AS_OF, CREATED_AT)
    return out.select("request_id", F.col("artifact.artifact_type").alias("artifact_type"),
                      F.col("artifact.agent").alias("agent"), F.col("artifact.status").alias("status"),
                      F.col("artifact.summary").alias("summary"), F.col("artifact.data").alias("data"), "source",
                      X.list_text("missing").alias("missing"))


def _batch(spark, sf, **options):
    from wayfare.operators.answer import route_batch as run
    asked = cut_lineage(B.requests(spark, sf).select("request_id", "route_day", "query", "model_output"))  # read for the analysis and the faults
    return run(asked.drop("route_day"), B.trips(spark, sf), L.live_rows(B.live_payloads(spark, sf)),
               B.weather_table(spark, sf), B.agent_faults(asked), B.AS_OF, CREATED_AT, **options)


@register("route_batch")
def route_batch(spark, sf):
    b = _batch(spark, sf)
    return b.select("request_id", "intent", "status", X.list_text("called_agents").alias("called_agents"),
                    "artifact_count", "agent_error_count",
                    F.array_join(F.transform("agent_errors", lambda x: F.concat_ws(": ", x["agent"], x["error"])), "; ")
                    .alias("agent_errors"), "weather_status", "weather_summary",
                    "ticket_status", "ticket_summary", "clarification_question")


@register("request_status")
def request_status(spark, sf):
    return _batch(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def _digest(text: str) -> list:
    """A long text as its length and digest."""
    return [F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias(f"{text}_sha256")]


@register("prompt_rows")
def prompt_rows(spark, sf):
    from wayfare.operators.answer import prompt_rows as build
    return build(_batch(spark, sf, with_data=True))


@register("prompt_parts")
def prompt_parts(spark, sf):
    from wayfare.operators.answer import prompt_parts as build
    parts = build(_batch(spark, sf, with_data=True, listed=False), B.trips(spark, sf), rows=2)
    return parts.select("request_id", "part_no", *_digest("text"))


@register("analyzer_prompts")
def analyzer_prompts(spark, sf):
    from wayfare.operators.answer import analyzer_prompts as build
    return build(B.requests(spark, sf).select("request_id", "query")).select("request_id", *_digest("prompt"))


# --- evaluation cases and scores ---------------------------------------------

def _samples(spark, sf):
    return K.KeySamples(K.reading_keys(B.readings(spark, sf)), B.route_keys(spark, sf))


@register("weather_cases")
def weather_cases(spark, sf):
    return K.flat_cases(K.weather_cases(_samples(spark, sf)))


@register("ticket_cases")
def ticket_cases(spark, sf):
    return K.flat_cases(K.ticket_cases(_samples(spark, sf)))


@register("combined_cases")
def combined_cases(spark, sf):
    return K.flat_cases(K.combined_cases(_samples(spark, sf)))


@register("missing_cases")
def missing_cases(spark, sf):
    return K.flat_cases(K.missing_cases(_samples(spark, sf)))


@register("edge_cases")
def edge_cases(spark, sf):
    return K.flat_cases(K.edge_cases(_samples(spark, sf)))


@register("all_cases")
def all_cases(spark, sf):
    return K.flat_cases(K.all_cases(_samples(spark, sf)))


@register("case_files")
def case_files(spark, sf):
    """SNK-4 and SRC-5: the cases written as a file and read back."""
    from wayfare.sources.files import read_cases
    from wayfare.sources.sinks import write_cases
    from wayfare.streaming.streams import scratch
    path = scratch(spark, "cases")
    write_cases(K.all_cases(_samples(spark, sf)), path)
    return K.flat_cases(read_cases(spark, path, lines=True))


@register("run_files")
def run_files(spark, sf):
    """SNK-5: two runs' results and summaries, the first run's written again."""
    from wayfare.operators import evaluate as V
    from wayfare.sources.sinks import write_results
    from wayfare.streaming.streams import scratch
    cases = cut_lineage(K.all_cases(_samples(spark, sf)))
    answers = B.model_answers(cases)
    path = scratch(spark, "runs")
    runs = {"baseline": V.score(cases, V.model_only(answers)), "rules": V.score(cases, V.predictions(answers))}
    for label in ("baseline", "rules", "baseline"):
        write_results(runs[label], V.summary(runs[label]), path, label)
    written = spark.read.parquet(f"{path}/results").groupBy("run_label").agg(F.count(F.lit(1)).alias("results"))
    sums = spark.read.json(f"{path}/summary")
    return sums.join(written, "run_label").select("run_label", "case_count", "failed_count", "results")


def _scored(spark, sf):
    from wayfare.operators import evaluate as V
    cases = K.all_cases(_samples(spark, sf))
    return V.score(cases, V.predictions(B.model_answers(cases)))


@register("case_checks")
def case_checks(spark, sf):
    from wayfare.operators.evaluate import CHECKS
    return _scored(spark, sf).select("id", "category", *[k + "_ok" for k in CHECKS], "error", "failed", "latency_ms")


@register("eval_summary")
def eval_summary(spark, sf):
    from wayfare.operators.evaluate import summary
    return summary(_scored(spark, sf))


@register("eval_by_category")
def eval_by_category(spark, sf):
    from wayfare.operators.evaluate import by_category
    return by_category(_scored(spark, sf))


@register("category_counts")
def category_counts(spark, sf):
    return K.all_cases(_samples(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("cases"))


@register("eval_failures")
def eval_failures(spark, sf):
    from wayfare.operators.evaluate import failures
    return failures(_scored(spark, sf))


@register("latency_percentiles")
def latency_percentiles(spark, sf):
    from wayfare.operators.evaluate import percentiles
    return percentiles(cut_lineage(_scored(spark, sf).select("category", "latency_ms")))


@register("run_comparison")
def run_comparison(spark, sf):
    from wayfare.operators import evaluate as V
    cases = K.all_cases(_samples(spark, sf))
    answers = B.model_answers(cases)
    runs = {"model_only": V.score(cases, V.model_only(answers)), "rules": V.score(cases, V.predictions(answers))}
    return V.compare_runs(runs, "model_only", "rules")


# --- logs ------------------------------------------------------------------------

@register("log_read")
def log_read(spark, sf):
    from wayfare.operators.logs import read_logs
    logs = read_logs(spark, B.landed_logs(spark, sf))
    return logs.select(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), "level", "event",
                       "trace_id", "agent", "attempt", "elapsed_seconds", "name", "status", "error")


@register("stage_seconds")
def stage_seconds(spark, sf):
    from wayfare.operators.logs import stage_seconds as run
    return run(B.log_events(spark, sf))


@register("call_attempts")
def call_attempts(spark, sf):
    from wayfare.operators.logs import call_attempts as run
    return run(B.log_events(spark, sf))


@register("open_attempts")
def open_attempts(spark, sf):
    from wayfare.operators.logs import open_attempts as run
    return run(B.log_events(spark, sf)).select(
        "trace_id", "agent", "attempt", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"))


@register("trace_outcome")
def trace_outcome(spark, sf):
    from wayfare.operators.logs import trace_outcome as run
    return run(B.log_events(spark, sf))


# --- dialog ---------------------------------------------------------------------

@register("followup_latest")
def followup_latest(spark, sf):
    from wayfare.operators.dialog import followup_latest as run
    return run(B.turns(spark, sf))


@register("followup_nested")
def followup_nested(spark, sf):
    from wayfare.operators.dialog import followup_nested as run
    return run(B.turns(spark, sf))


# --- ingest: snapshot, contract, upsert, report, publish ------------------------

def _newest_tickets(spark, sf):
    """The newer ticket drop: its name and its checked rows."""
    from wayfare.sources import files as S
    newest = S.newest_snapshot(spark, B.ticket_drops(spark, sf), "train_tickets_*.csv")
    return newest.rstrip("/").rsplit("/", 1)[-1], S.read_contract(spark, newest, "train_tickets")


def _ingested(spark, sf, names=("train_tickets", "weather_data")):
    """ING-1: tables published from their older drops, then the newest drops
    put in under the tables' collation; root and load reports."""
    import uuid
    from wayfare.operators.load import ingest, latest_per_key, publish
    from wayfare.session import cut_through, ensure_checkpoint_dir, scratch_tables
    from wayfare.sources import files as S
    root = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex[:8]}"
    drops = B.ticket_drops(spark, sf) if "train_tickets" in names else f"{root}-drops"
    if "weather_data" in names:
        B.weather_drops(spark, sf, drops)
    older = {"train_tickets": B.TICKET_FILES[0], "weather_data": B.WEATHER_FILES[0]}
    with scratch_tables(spark):  # keys are looked at first
        read = {n: cut_through(spark, lambda n=n: S.accepted(S.read_contract(spark, f"{drops}/{older[n]}", n))) for n in names}
        latest = lambda n: lambda df: latest_per_key(df, C.TABLES[n]["key"], ["__order"], X.COLLATION).drop("__order")
        publish(spark, {n: (df, latest(n)) for n, df in read.items()}, root)
    return root, ingest(spark, drops, root, X.COLLATION)


def _ticket_report(df):
    return df.select(X.iso_date("departure_time").alias("departure_day"),
                     F.date_format("departure_time", "yyyy-MM-dd HH:mm:ss").alias("departure_time"),
                     "train_number", "departure_city", "arrival_city", "seat_type", "total_seats",
                     "remaining_seats", F.col("price").cast("double").alias("price"))


@register("newest_snapshot")
def newest_snapshot(spark, sf):
    name, read = _newest_tickets(spark, sf)
    return read.agg(F.count(F.lit(1)).alias("csv_rows")).select(F.lit("train_tickets").alias("table"), F.lit(name).alias("file"), "csv_rows")


@register("csv_contract")
def csv_contract(spark, sf):
    from wayfare.sources.files import accepted
    return _ticket_report(accepted(_newest_tickets(spark, sf)[1]))


@register("rejected_rows")
def rejected_rows(spark, sf):
    from wayfare.sources.files import rejected
    r = rejected(_newest_tickets(spark, sf)[1])
    return r.select(F.col("raw_departure_city").alias("departure_city"), F.col("raw_arrival_city").alias("arrival_city"),
                    F.col("raw_departure_time").alias("departure_time"), F.col("raw_train_number").alias("train_number"),
                    F.col("raw_seat_type").alias("seat_type"), F.col("__reason").alias("reason"))


@register("upsert")
def upsert_q(spark, sf):
    from wayfare.operators.load import read_published
    return _ticket_report(read_published(spark, _ingested(spark, sf, ["train_tickets"])[0], "train_tickets"))


@register("weather_upsert")
def weather_upsert(spark, sf):
    from wayfare.operators.load import read_published
    w = read_published(spark, _ingested(spark, sf, ["weather_data"])[0], "weather_data")
    return w.select("city", X.iso_date("fx_date").alias("fx_date"), "temp_max", "temp_min", "text_day", "text_night",
                    "wind_speed_day", F.col("precip").cast("double").alias("precip"), "humidity",
                    X.iso_datetime("update_time").alias("update_time"))


@register("load_report")
def load_report(spark, sf):
    return _ingested(spark, sf)[1]


def _counts(tables: dict):
    parts = [df.select(F.lit(n).alias("table")) for n, df in tables.items()]
    return parts[0].unionByName(parts[1]).groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


@register("table_counts")
def table_counts(spark, sf):
    """The tickets after the ingest of both drops, and the weather table."""
    from wayfare.operators.load import read_published
    tickets = read_published(spark, _ingested(spark, sf, ["train_tickets"])[0], "train_tickets")
    return _counts({"train_tickets": tickets, "weather_data": B.weather_table(spark, sf)})


@register("published_tables")
def published_tables(spark, sf):
    from wayfare.operators.load import read_published
    root = _ingested(spark, sf)[0]
    return _counts({n: read_published(spark, root, n) for n in ("train_tickets", "weather_data")})


# --- streams ---------------------------------------------------------------------

def _landed_log_folder(spark, sf, copies: int = 1) -> str:
    """Log events landed as JSON in two waves (first half of the days, then
    the rest), each wave ``copies`` times."""
    import time
    from wayfare.operators.logs import LOG_TIME_WRITE_FORMAT
    from wayfare.streaming.streams import scratch
    path = scratch(spark, "log-drops")
    logs = B.log_events(spark, sf).drop("event_id")
    waves = [logs.filter(F.dayofmonth("time") <= 15), logs.filter(F.dayofmonth("time") > 15)]
    for i, w in enumerate(waves):
        for _ in range(copies):
            if i or _:
                time.sleep(1.1)
            w.write.mode("append").option("timestampFormat", LOG_TIME_WRITE_FORMAT).json(path)
    return path


TS = "yyyy-MM-dd'T'HH:mm:ss"
TS_US = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _tumbled(spark, sf):
    """STM-1 over events of which every tenth lands only when all others have
    been counted, then the sentinel; the emitted windows and the landed rows."""
    from wayfare.operators.logs import LOG_TIME_WRITE_FORMAT
    from wayfare.streaming import streams as S
    path, out = S.scratch(spark, "log-waves"), S.scratch(spark, "stm-tumbling")
    logs = B.log_events(spark, sf)
    flat = lambda b, _: b.select(F.date_format("w.start", TS).alias("window_start"), "events", "errors")
    late = F.col("event_id") % 10 == 0
    for wave in (logs.where(~late), logs.where(late), None):
        if wave is None:
            _land_sentinel(spark, path)
        else:
            wave.drop("event_id").write.mode("append").option("timestampFormat", LOG_TIME_WRITE_FORMAT).json(path)
        # a run a wave: it goes on from the checkpoint, watermark included
        S.run_batches(S.tumbling_counts(S.log_stream(spark, path, max_files=10_000)), out, "append", flat)
    return S.final_rows(spark, out, ["window_start"]).where("window_start < '2100'"), logs


@register("stream_tumbling")
def stream_tumbling(spark, sf):
    return _tumbled(spark, sf)[0]


@register("stream_late")
def stream_late(spark, sf):
    """How many landed rows came too late for their window."""
    windows, logs = _tumbled(spark, sf)
    landed = logs.agg(F.count(F.lit(1)).alias("landed"))
    counted = windows.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("counted"))
    return landed.join(counted).select("landed", "counted", (F.col("landed") - F.col("counted")).alias("dropped"))


@register("stream_sliding")
def stream_sliding(spark, sf):
    from wayfare.streaming import streams as S
    out = S.scratch(spark, "stm-sliding")
    flat = lambda b, _: b.select(F.date_format("w.start", TS).alias("window_start"), "name", "timers",
                                 F.col("total").cast("double").alias("total_seconds"))
    S.run_batches(S.sliding_timers(S.log_stream(spark, _landed_log_folder(spark, sf))), out, "update", flat)
    return S.final_rows(spark, out, ["window_start", "name"]).withColumn(
        "mean_seconds", F.col("total_seconds") / F.col("timers"))


SENTINEL_TRACE = "__end_of_input__"


def _land_sentinel(spark, path: str) -> None:
    """A far-future event landed last: it moves the watermark past every real
    session so append mode can emit them; its own session is filtered out."""
    import datetime as dt
    import time
    from wayfare.operators.logs import LOG_TIME_WRITE_FORMAT
    time.sleep(1.1)
    row = [(dt.datetime(2100, 1, 1), "INFO", "sentinel", "end", "end", SENTINEL_TRACE)]
    (spark.createDataFrame(row, "time timestamp, level string, logger string, message string, event string, "
                                "trace_id string")
     .write.mode("append").option("timestampFormat", LOG_TIME_WRITE_FORMAT).json(path))


@register("stream_sessions")
def stream_sessions(spark, sf):
    from wayfare.streaming import streams as S
    src = _landed_log_folder(spark, sf)
    _land_sentinel(spark, src)
    out = S.scratch(spark, "stm-sessions")
    flat = lambda b, _: b.select("trace_id", F.date_format("s.start", TS_US).alias("session_start"),
                                 F.date_format("s.end", TS_US).alias("session_end"), "events")
    S.run_batches(S.trace_sessions(S.log_stream(spark, src), delay="10 minutes"), out, "append", flat)
    return S.final_rows(spark, out, ["trace_id", "session_start"]).filter(F.col("trace_id") != SENTINEL_TRACE)


@register("stream_dedupe")
def stream_dedupe(spark, sf):
    from wayfare.streaming import streams as S
    out = S.scratch(spark, "stm-dedupe")
    flat = lambda b, _: b.select("trace_id", F.date_format("time", TS_US).alias("time"), "event")
    S.run_batches(S.deduped(S.log_stream(spark, _landed_log_folder(spark, sf, copies=2)),
                            ["trace_id", "time", "event"]), out, "append", flat)
    return S.final_rows(spark, out, ["trace_id", "time", "event"])


def _dialog(spark, turns) -> DataFrame:
    """The dialog stream over turns of which the later land first; an end
    far in the future lands last and lets timers expire."""
    import datetime as dt
    from wayfare.streaming import streams as S
    src, out = S.scratch(spark, "turn-drops"), S.scratch(spark, "stm-dialog")
    schema = "conv_id long, turn long, role string, text string, time timestamp"
    timed = turns.withColumn("time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60))
    end = spark.createDataFrame([(-1, 0, "system", "end", dt.datetime(2100, 1, 1))], schema)
    for wave in (timed.filter(F.col("turn") > 3), timed.filter(F.col("turn") <= 3), end):
        wave.write.mode("append").json(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10_000).json(src)
        S.run_batches(S.dialog_stream(stream), out, "append")
    return S.final_rows(spark, out, ["conv_id", "turn"])


@register("stream_dialog")
def stream_dialog(spark, sf):
    return _dialog(spark, B.turns(spark, sf))


@register("stream_dialog_gaps")
def stream_dialog_gaps(spark, sf):
    """Every third conversation never gets its turn 1."""
    return _dialog(spark, B.turns(spark, sf).where("not (conv_id % 3 = 0 and turn = 1)"))


@register("stream_upsert")
def stream_upsert(spark, sf):
    """The two ticket snapshots, one landed after the other; a run of the
    stream a snapshot, the second goes on from the first's checkpoint."""
    from wayfare.operators.load import read_published
    from wayfare.streaming import streams as S
    drops, out = B.ticket_drops(spark, sf), S.scratch(spark, "stm-upsert")
    for name in B.TICKET_FILES:
        S.upsert_stream(spark, B.land_drop(spark, drops, name), "train_tickets", out, max_files=10_000)
    return _ticket_report(read_published(spark, out, "train_tickets"))
