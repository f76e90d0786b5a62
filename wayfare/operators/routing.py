"""Rule-based routing of free-text requests (RTE-1..4, XPR-10/19/20).

The model's raw answer is an input column. Everything after the JSON
extraction is a column pipeline (``when`` chains and higher-order array
functions) inside one projection: no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.functions.modeltext import model_json

FLAG_COLUMNS = ["wants_weather", "wants_train", "wants_flight", "wants_attraction",
                "excludes_weather", "excludes_ticket"]


def domain_flags(query) -> dict[str, Column]:
    """RTE-1: six flags. ``wants_train`` includes the lone-ticket-character rule
    (``票`` alone means a train ticket unless flights or admission tickets are
    named); negation is applied later, in ``required_agents``."""
    q = X.col_of(query)
    flight = X.contains_any(q, C.FLIGHT_KEYWORDS)
    lone_ticket = (F.instr(q, C.TICKET_CHAR) > 0) & ~flight & (F.instr(q, C.ADMISSION_TICKET) == 0)
    return {
        "wants_weather": X.contains_any(q, C.WEATHER_KEYWORDS),
        "wants_train": X.contains_any(q, C.TRAIN_KEYWORDS) | lone_ticket,
        "wants_flight": flight,
        "wants_attraction": X.contains_any(q, C.ATTRACTION_KEYWORDS),
        "excludes_weather": X.contains_any(q, C.NEGATIVE_WEATHER_PATTERNS),
        "excludes_ticket": X.contains_any(q, C.NEGATIVE_TICKET_PATTERNS),
    }


def with_flags(df: DataFrame, query: str = "query") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in domain_flags(query).items()])


def required_agents(model_agents: Column, dedupe: bool = False) -> Column:
    """RTE-2 over the flag columns: flags decide if any domain is named
    (after negation), else the model's supported agents; negated agents are
    removed last. ``dedupe=False`` keeps the model's repeats, as the reference does.
    """
    exw, ext = F.col("excludes_weather"), F.col("excludes_ticket")
    ww = F.col("wants_weather") & ~exw
    wt = F.col("wants_train") & ~ext
    explicit = ww | wt | F.col("wants_flight") | F.col("wants_attraction")
    # Flag-made lists already leave out negated agents; the model's list is
    # filtered to supported agents and negated ones in one pass.
    from_flags = F.filter(F.array(F.when(ww, F.lit("weather_agent")), F.when(wt, F.lit("ticket_agent"))),
                          lambda x: x.isNotNull())
    from_model = F.filter(F.coalesce(model_agents, F.array().cast("array<string>")),
                          lambda x: x.isin(*C.SUPPORTED_AGENTS)
                          & ~(exw & (x == F.lit("weather_agent"))) & ~(ext & (x == F.lit("ticket_agent"))))
    if dedupe:
        from_model = F.array_distinct(from_model)
    return F.when(explicit, from_flags).otherwise(from_model)


def derived_slot(own: Column, source: Column, agents: Column) -> Column:
    """XPR-10 for one slot: take ``source`` when the weather agent is required,
    the slot's own value is not valid and the source is."""
    need = F.array_contains(agents, "weather_agent")
    return F.when(need & ~X.valid_slot(own) & X.valid_slot(source), source).otherwise(own)


def missing_for(slot_cols: dict[str, Column], agent: str) -> Column:
    """One agent's required slots that are not valid, in declared order."""
    return F.filter(F.array(*[F.when(~X.valid_slot(slot_cols[s]), F.lit(s)) for s in C.REQUIRED_SLOTS[agent]]),
                    lambda x: x.isNotNull())


def missing_slots(agents: Column, weather_missing: Column, ticket_missing: Column) -> Column:
    """Missing slots for each required agent in agent order (repeats kept)."""
    return F.flatten(F.transform(agents, lambda a: F.when(a == F.lit("weather_agent"), weather_missing)
                                 .otherwise(ticket_missing)))


def parse_model(df: DataFrame, raw_col: str = "model_output") -> DataFrame:
    """RTE-4 step 1: the model's JSON object, its agent list and slot map.

    A value of the wrong shape reads as empty, like ``isinstance`` checks.
    """
    out = model_json(df, raw_col)
    top = F.from_json(F.col("model_json"), "map<string,string>")
    agents = F.from_json(F.try_element_at(top, F.lit("required_agents")), "array<string>")
    slots = F.from_json(F.try_element_at(top, F.lit("slots")), "map<string,string>")
    return (out.withColumn("model_agents", agents)
            .withColumn("model_slots", F.coalesce(slots, F.create_map().cast("map<string,string>"))))


def normalize(df: DataFrame, query: str = "query", dedupe: bool = False) -> DataFrame:
    """RTE-3 over columns ``model_agents`` / ``model_slots`` / ``model_error``.

    Adds intent, required_agents, slot_<name> (five columns), slots (the
    model's map with the derived weather slots), missing_slots,
    need_clarification, clarification_question and error. Rows whose model
    text had no JSON object keep NULL analysis fields and carry the error.

    Each step reads plain columns of the step before, so the optimizer's
    inlining stays linear in the number of steps.
    """
    ok = F.col("model_error").isNull()
    step = with_flags(df, query).withColumn("required_agents", F.when(ok, required_agents(F.col("model_agents"), dedupe)))
    step = step.select("*", *[F.try_element_at(F.col("model_slots"), F.lit(n)).alias(f"m_{n}") for n in C.SLOT_NAMES])
    agents = F.col("required_agents")
    step = step.select(
        "*",
        derived_slot(F.col("m_city"), F.col("m_arrival_city"), agents).alias("slot_city"),
        derived_slot(F.col("m_fx_date"), F.col("m_travel_date"), agents).alias("slot_fx_date"),
        *[F.col(f"m_{n}").alias(f"slot_{n}") for n in ["departure_city", "arrival_city", "travel_date"]])
    slot_cols = {n: F.col(f"slot_{n}") for n in C.SLOT_NAMES}
    step = step.select("*", missing_for(slot_cols, "weather_agent").alias("__wm"),
                       missing_for(slot_cols, "ticket_agent").alias("__tm"))
    step = (step.withColumn("missing_slots", F.when(ok, missing_slots(agents, F.col("__wm"), F.col("__tm"))))
            .withColumn("intent", F.when(ok, X.intent_of(agents))))
    derived = F.map_concat(
        F.map_filter(F.col("model_slots"), lambda k, v: ~k.isin("city", "fx_date")),
        F.map_filter(F.create_map(F.lit("city"), F.col("slot_city"), F.lit("fx_date"), F.col("slot_fx_date")),
                     lambda k, v: v.isNotNull()))
    return (step.withColumn("slots", F.when(ok, derived))
            .withColumn("need_clarification", F.when(ok, F.size("missing_slots") > 0))
            .withColumn("clarification_question", F.when(ok, X.labels_question(F.col("missing_slots"))))
            .withColumn("error", F.col("model_error"))
            .drop("__wm", "__tm", *[f"m_{n}" for n in C.SLOT_NAMES]))


def analyze(df: DataFrame, query: str = "query", raw_col: str = "model_output", dedupe: bool = False) -> DataFrame:
    """RTE-4: model text -> JSON -> normalized analysis, in one plan."""
    return normalize(parse_model(df, raw_col), query, dedupe)


def analysis_report(df: DataFrame, key: str) -> DataFrame:
    """Report shape: lists as text, the five slots as columns."""
    return df.select(
        key, "intent", X.list_text("required_agents").alias("required_agents"),
        *[F.when(F.col("error").isNull(), F.col(f"slot_{s}")).alias(f"slot_{s}") for s in C.SLOT_NAMES],
        X.list_text("missing_slots").alias("missing_slots"), "need_clarification",
        "clarification_question", "error")
