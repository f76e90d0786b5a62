"""Artifacts, per-request status and the request batch (ART-*, RES-*, JON-9, AGG-9, SNK-6).

A task's artifact is one row keyed by (request, agent) whose ``data`` is JSON
text: the missing slots, the lookup's answer without rows, the weather row,
or the route-day's tickets. The tickets are listed only where asked for
(``with_data``); elsewhere the rows behind an artifact come from
``search_tickets`` and ``data`` stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators import lookup as L
from wayfare.operators import routing as R
from wayfare.session import cut_lineage


def task_slots(slots: Column, metadata: Column, aliases: dict[str, list[str]]) -> dict[str, Column]:
    """XPR-9: nested ``slots`` wins when present (even empty), else the flat
    metadata; each slot takes its first truthy alias."""
    src = F.coalesce(slots, metadata)
    return {name: X.first_present([F.try_element_at(src, F.lit(a)) for a in names])
            for name, names in aliases.items()}


def _missing(values: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~X.truthy(v), F.lit(k)) for k, v in values.items()]),
                    lambda x: x.isNotNull())


def artifact(artifact_type: str, agent: str, status: Column, data: Column, summary: Column,
             created_at: Column) -> Column:
    """ART-1: the artifact envelope; ``data`` is JSON text."""
    return F.struct(F.lit(artifact_type).alias("artifact_type"), F.lit(agent).alias("agent"),
                    status.alias("status"), data.alias("data"), summary.alias("summary"),
                    F.struct(created_at.alias("created_at")).alias("metadata"))


def _open(obj: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.substr(obj, F.lit(1), F.length(obj) - 1)


def _around_data(a: Column) -> tuple[Column, Column]:
    """What stands before and after the data in an artifact's JSON."""
    head = X.json_text({k: a[k] for k in ("artifact_type", "agent", "status")})
    tail = X.json_text({k: a[k] for k in ("summary", "metadata")})
    return F.concat(_open(head), F.lit(',"data":')), F.concat(F.lit(","), F.substr(tail, F.lit(2)))


def artifact_json(a: Column) -> Column:
    """An artifact as JSON, its data in place (null without)."""
    before, after = _around_data(a)
    return F.concat(before, F.coalesce(a["data"], F.lit("null")), after)


def _no_rows(template: str, data: Column, **values) -> Column:
    head = X.json_text({"status": F.lit("not_found"), "message": X.render(template, **values)})
    return F.concat(_open(head), F.lit(',"data":'), data, F.lit("}"))


def _missing_data() -> Column:
    return X.json_text({"missing_slots": F.col("missing")})


def ticket_artifacts(tasks: DataFrame, tickets: DataFrame, created_at: str,
                     currency: str = C.DEFAULT_CURRENCY, with_data: bool = True, listed: bool = True) -> DataFrame:
    """ART-2: aliases -> missing (failed) -> search -> not_found / success.
    Without ``listed`` the data of a success stays NULL (see ``prompt_parts``)."""
    s = task_slots(F.col("slots"), F.col("metadata"), C.TICKET_ALIASES)
    t = tasks.select("*", *[v.alias("t_" + k) for k, v in s.items()])
    t = t.withColumn("missing", _missing({k: F.col("t_" + k) for k in C.TICKET_ALIASES}))
    has_missing = F.size("missing") > 0
    key = {k: F.col("t_" + k) for k in C.TICKET_ALIASES}
    # where a slot is missing the lookup's keys are NULL and find nothing
    t = t.withColumns({"__" + k: F.when(~has_missing, v) for k, v in key.items()})
    looked = L.first_departures(t, tickets, dep="__departure_city", arr="__arrival_city", date="__travel_date",
                                listed=with_data and listed)
    data = F.lit(None).cast("string")
    if with_data:
        data = (F.when(has_missing, _missing_data())
                .when(F.col("ticket_count") == 0, _no_rows(C.TICKET_NO_ROWS, F.lit("[]"), **key))
                .otherwise(F.col("tickets") if listed else data))
    status = (F.when(has_missing, F.lit("failed"))
              .when(F.col("ticket_count") == 0, F.lit("not_found")).otherwise(F.lit("success")))
    not_found = X.render(C.TICKET_NOT_FOUND_SUMMARY, **key)
    summary = (F.when(has_missing, F.lit(C.TICKET_MISSING_SUMMARY))
               .when(F.col("ticket_count") == 0, not_found)
               .otherwise(L.ticket_summary_text(F.col("first"), F.col("ticket_count"), currency)))
    return looked.select(
        *tasks.columns, "missing",
        "ticket_count",
        artifact("ticket_result", "ticket_agent", status, data, summary, F.lit(created_at)).alias("artifact"))


def weather_artifacts(tasks: DataFrame, live: DataFrame, weather: DataFrame, as_of: str, created_at: str,
                      live_enabled: bool = True) -> DataFrame:
    """ART-3: aliases -> missing (failed) -> live or stored -> not_found / success."""
    s = task_slots(F.col("slots"), F.col("metadata"), C.WEATHER_ALIASES)
    t = tasks.select("*", *[v.alias("t_" + k) for k, v in s.items()])
    t = t.withColumn("missing", _missing({k: F.col("t_" + k) for k in C.WEATHER_ALIASES}))
    has_missing = F.size("missing") > 0
    t = t.withColumns({"__k_" + k: F.when(~has_missing, F.col("t_" + k)) for k in C.WEATHER_ALIASES})
    looked = L.live_or_stored(t, live, weather, as_of, city="__k_city", date="__k_fx_date", live_enabled=live_enabled)
    found = F.col("source").isNotNull()
    status = (F.when(has_missing, F.lit("failed")).when(~found, F.lit("not_found")).otherwise(F.lit("success")))
    key = {"city": F.col("t_city"), "fx_date": F.col("t_fx_date")}
    not_found = X.render(C.WEATHER_NOT_FOUND_SUMMARY, **key)
    data = (F.when(has_missing, _missing_data())
            .when(~found, _no_rows(C.WEATHER_NO_ROW, F.lit("null"), **key)).otherwise(F.col("data")))
    ok = L.weather_summary_text(found, F.col("weather_city"), F.col("weather_date"), F.col("text_day"),
                                F.col("temp_min_text"), F.col("temp_max_text"), F.col("humidity"),
                                F.col("precip_text"))
    summary = (F.when(has_missing, F.lit(C.WEATHER_MISSING_SUMMARY)).when(~found, not_found).otherwise(ok))
    return looked.select(
        *tasks.columns, "missing", "source",
        artifact("weather_result", "weather_agent", status, data, summary, F.lit(created_at)).alias("artifact"))


def route_batch(requests: DataFrame, tickets: DataFrame, live: DataFrame, weather: DataFrame,
                faults: DataFrame, as_of: str, created_at: str, live_enabled: bool = True,
                with_data: bool = False, listed: bool = True) -> DataFrame:
    """RES-2: requests -> analysis (written once) -> both lookups -> status.

    Requests that need clarification or name no agent stop before the
    lookups (filtered, like the reference's early return). Each called agent
    becomes a task row; a transport fault (``faults``: request_id, agent,
    error) replaces that agent's artifact with an error (JON-9). Artifacts and
    errors of a request are in agent order; ``with_data`` lists the tickets
    (not those found, if not ``listed``).
    """
    # The analysis feeds three branches (weather tasks, ticket tasks, the
    # final status); write it once to the shared checkpoint folder instead
    # of re-running the model-text scan per branch.
    keep = ["request_id", "query", "intent", "required_agents", "missing_slots", "need_clarification",
            "clarification_question", "error", *[f"slot_{n}" for n in C.SLOT_NAMES]]
    a = cut_lineage(R.analyze(requests).select(*keep))
    ready = a.filter(F.col("error").isNull() & ~F.col("need_clarification") & (F.size("required_agents") > 0))
    slots = F.create_map(*[x for n in C.SLOT_NAMES for x in (F.lit(n), F.col("slot_" + n))])
    base = ready.select("request_id", F.map_filter(slots, lambda k, v: v.isNotNull()).alias("slots"),
                        F.create_map(F.lit("trace_id"), F.col("request_id")).alias("metadata"),
                        "required_agents")
    w_tasks = base.filter(F.array_contains("required_agents", "weather_agent")).drop("required_agents")
    t_tasks = base.filter(F.array_contains("required_agents", "ticket_agent")).drop("required_agents")
    w = weather_artifacts(w_tasks, live, weather, as_of, created_at, live_enabled).select(
        "request_id", F.lit("weather_agent").alias("agent"), F.lit(0).alias("agent_pos"), "artifact")
    t = ticket_artifacts(t_tasks, tickets, created_at, with_data=with_data, listed=listed).select(
        "request_id", F.lit("ticket_agent").alias("agent"), F.lit(1).alias("agent_pos"), "artifact")
    calls = w.unionByName(t).join(faults, ["request_id", "agent"], "left")
    # AGG-9: per request, artifacts of the calls that returned, in agent order.
    per_req = calls.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("agent_pos", "agent"))).alias("__called"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("agent_pos", "artifact"))))
        .alias("__arts"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("agent_pos", "agent", "error"))))
        .alias("__errs"),
        F.count(F.col("error")).alias("error_count"))
    out = a.join(per_req, "request_id", "left")
    arts = F.transform("__arts", lambda x: x["artifact"])
    n_art = F.coalesce(F.size(arts), F.lit(0))
    errors = F.coalesce(F.col("error_count"), F.lit(0))
    status = (F.when(F.col("error").isNotNull(), F.lit("analysis_failed"))
              .when(F.col("need_clarification"), F.lit("need_clarification"))
              .when(F.size("required_agents") == 0, F.lit("no_supported_agent"))
              .when((errors > 0) & (n_art == 0), F.lit("agent_failed"))
              .when(errors > 0, F.lit("partial_success"))
              .otherwise(F.lit("success")))

    def art_of(agent, field):
        mine = F.filter(arts, lambda x: x["agent"] == F.lit(agent))
        return F.try_element_at(F.transform(mine, lambda x: x[field]), F.lit(1))

    return out.select(
        "request_id", "query", "intent", "required_agents", "missing_slots", "clarification_question",
        status.alias("status"),
        F.coalesce(F.transform("__called", lambda x: x["agent"]), F.array().cast("array<string>")).alias("called_agents"),
        n_art.alias("artifact_count"), errors.alias("agent_error_count"),
        art_of("weather_agent", "status").alias("weather_status"),
        art_of("weather_agent", "summary").alias("weather_summary"),
        art_of("ticket_agent", "status").alias("ticket_status"),
        art_of("ticket_agent", "summary").alias("ticket_summary"),
        F.coalesce(F.transform("__errs", lambda x: F.struct(x["agent"], x["error"])),
                   F.array().cast("array<struct<agent:string,error:string>>")).alias("agent_errors"),
        "need_clarification", *[f"slot_{n}" for n in C.SLOT_NAMES],
        arts.alias("artifacts"))


def _analysis(slots: Column) -> Column:
    return X.json_text({"intent": "intent", "required_agents": "required_agents", "slots": slots,
                        "missing_slots": "missing_slots", "need_clarification": "need_clarification",
                        "clarification_question": "clarification_question"})


def _slots() -> Column:
    slots = F.create_map(*[x for n in C.SLOT_NAMES for x in (F.lit(n), F.col(f"slot_{n}"))])
    return F.map_filter(slots, lambda k, v: v.isNotNull())


def analyzer_prompts(requests: DataFrame) -> DataFrame:
    """SNK-6: the analyzer's prompt for every request (request_id, query)."""
    return requests.select("request_id", X.render(C.ANALYZE_PROMPT, query=F.col("query")).alias("prompt"))


def prompt_rows(batch: DataFrame) -> DataFrame:
    """SNK-6: the final-answer prompt per request that got artifacts
    (success or partial_success), for offline inference: query, analysis and
    artifacts with their data, as compact JSON. Needs ``with_data``."""
    artifacts = F.concat(F.lit("["), F.array_join(F.transform("artifacts", artifact_json), ","), F.lit("]"))
    prompt = X.render(C.FINAL_PROMPT, query=F.col("query"), analysis=_analysis(_slots()), artifacts=artifacts)
    return (batch.filter(F.col("status").isin("success", "partial_success"))
            .select("request_id", prompt.alias("prompt")))


def prompt_parts(batch: DataFrame, tickets: DataFrame, rows: int = L.BLOCK_ROWS) -> DataFrame:
    """The texts of ``prompt_rows`` as ordered parts (request_id, part_no,
    text), at most ``rows`` tickets in each: a route-day's list is never in
    one row. Needs a batch with data that isn't ``listed``; parts are copied
    to every request of a route-day, so a hot one can be split by AQE."""
    before, _, after = C.FINAL_PROMPT.partition("{artifacts}")
    text = lambda t: X.render(t, query=F.col("query"), analysis=_analysis(_slots()))
    is_list = lambda a: (a["agent"] == "ticket_agent") & (a["status"] == "success")
    mine = F.try_element_at(F.filter("artifacts", is_list), F.lit(1))
    others = F.transform(F.filter("artifacts", lambda a: ~is_list(a)), artifact_json)  # the ticket agent comes last
    head, tail = _around_data(mine)
    key = task_slots(_slots(), F.create_map().cast("map<string,string>"), C.TICKET_ALIASES)
    start = F.concat(text(before), F.lit("["), F.array_join(others, ","))
    end = F.concat(F.lit("]"), text(after))
    base = cut_lineage(batch.filter(F.col("status").isin("success", "partial_success")).select(
        "request_id", key["departure_city"].alias("departure_city"), key["arrival_city"].alias("arrival_city"),
        X.strict_date(key["travel_date"]).alias("__day"), mine.isNotNull().alias("__list"),
        F.when(mine.isNull(), F.concat(start, end))
        .otherwise(F.concat(start, F.when(F.size(others) > 0, F.lit(",")).otherwise(F.lit("")), head, F.lit("["))).alias("__start"),
        F.concat(F.lit("]"), tail, end).alias("__end")))
    asks = base.filter("__list")
    # written before they are ranked, since a range sort reads its input twice
    wanted = cut_lineage(L.requested_tickets(asks, tickets, "departure_city", "arrival_city").select(
        *dict.fromkeys([*L.ROUTE_DAY, *C.TICKET_SEARCH_COLUMNS])))
    blocks = cut_lineage(L.ticket_blocks(wanted, rows))
    ends = blocks.groupBy(*L.ROUTE_DAY).agg((F.max("block") + 1).alias("part_no"))
    comma = F.when(F.col("block") > 1, F.lit(",")).otherwise(F.lit(""))
    return (base.select("request_id", F.lit(0).cast("long").alias("part_no"), F.col("__start").alias("text"))
            .unionByName(asks.join(blocks, L.ROUTE_DAY).select("request_id", F.col("block").alias("part_no"),
                                                               F.concat(comma, "text").alias("text")))
            .unionByName(asks.join(ends, L.ROUTE_DAY).select("request_id", "part_no", F.col("__end").alias("text"))))
