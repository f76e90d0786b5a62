"""Evaluation cases from table contents (AGG-1, AGG-11, JON-4/5, SMP-1, GEN-*, SET-1).

Cases are table rows: every family is an even sample of a key table joined
to its templates, numbered and rendered column-wise.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators.ordering import EvenSampler
from wayfare.session import cut_lineage

ROUTE_ORDER = ["departure_city", "arrival_city", "travel_date"]
WEATHER_ORDER = ["city", "fx_date"]


def route_day_counts(tickets: DataFrame) -> DataFrame:
    """AGG-1: tickets per (departure, arrival, day); the day as yyyy-MM-dd text."""
    return (tickets.groupBy("departure_city", "arrival_city",
                            X.iso_date(F.to_date("departure_time")).alias("travel_date"))
            .agg(F.count(F.lit(1)).alias("ticket_count")))


def reading_keys(weather: DataFrame) -> DataFrame:
    """AGG-11 / SRT-2: distinct (city, fx_date) with the date as text."""
    return weather.select("city", X.iso_date("fx_date").alias("fx_date")).distinct()


def routes_with_readings(routes: DataFrame, keys: DataFrame) -> DataFrame:
    """JON-4: routes whose (arrival_city, travel_date) has a weather row."""
    k = keys.select(F.col("city").alias("arrival_city"), F.col("fx_date").alias("travel_date"))
    return routes.join(k, ["arrival_city", "travel_date"], "left_semi")


def routes_without_readings(routes: DataFrame, keys: DataFrame) -> DataFrame:
    """JON-5: the complement of JON-4."""
    k = keys.select(F.col("city").alias("arrival_city"), F.col("fx_date").alias("travel_date"))
    return routes.join(k, ["arrival_city", "travel_date"], "left_anti")


def _slots_map(pairs: dict) -> F.Column:
    """Map of the given slots, dropping NULL values."""
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.map_filter(m, lambda k, v: v.isNotNull())


def _case(df: DataFrame, prefix: str, category: str, pick_col: str, query, intent, agents,
          slots, missing) -> DataFrame:
    empty = F.array().cast("array<string>")
    missing = missing if missing is not None else empty
    return df.select(
        X.padded_id(prefix, F.col(pick_col)).alias("id"),
        F.lit(category).alias("category"),
        query.alias("query"),
        F.struct(intent.alias("intent"), agents.alias("required_agents"), slots.alias("slots"),
                 missing.alias("missing_slots"), (F.size(missing) > 0).alias("need_clarification"))
        .alias("expected"))


def _arr(items) -> F.Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


class KeySamples:
    """The three ordered key tables the case families sample, each counted once."""

    def __init__(self, keys: DataFrame, routes: DataFrame):
        self.spark = keys.sparkSession
        # The samplers read their keys more than once: build them once.
        self._keys = cut_lineage(keys.select(*WEATHER_ORDER))
        self._routes = cut_lineage(routes.select(*ROUTE_ORDER))

    @cached_property
    def weather(self) -> EvenSampler:
        return EvenSampler(self._keys, WEATHER_ORDER)

    @cached_property
    def routes(self) -> EvenSampler:
        return EvenSampler(self._routes, ROUTE_ORDER)

    @cached_property
    def usable(self) -> EvenSampler:
        return EvenSampler(cut_lineage(routes_with_readings(self._routes, self._keys)), ROUTE_ORDER)


def weather_cases(ks: KeySamples) -> DataFrame:
    """GEN-1: even sample of the weather keys, one template each in turn."""
    rows = ks.weather.pick(C.CASE_COUNTS["weather"])
    tpl = X.pick_cyclic(C.WEATHER_TEMPLATES, F.col("pick"))
    q = X.render_template_col(tpl, F.col("city"), F.col("fx_date"), F.lit(""), F.lit(""))
    return _case(rows, "weather", "weather", "pick", q, F.lit(C.INTENT_WEATHER), _arr(["weather_agent"]),
                 _slots_map({"city": F.col("city"), "fx_date": F.col("fx_date")}), None)


def _route_query(tpl):
    return X.render_template_col(tpl, F.col("arrival_city"), F.col("travel_date"),
                                 F.col("departure_city"), F.col("arrival_city"))


def ticket_cases(ks: KeySamples) -> DataFrame:
    """GEN-2: even sample of all routes."""
    rows = ks.routes.pick(C.CASE_COUNTS["ticket"])
    q = _route_query(X.pick_cyclic(C.TICKET_TEMPLATES, F.col("pick")))
    slots = _slots_map({"departure_city": F.col("departure_city"), "arrival_city": F.col("arrival_city"),
                        "travel_date": F.col("travel_date")})
    return _case(rows, "ticket", "ticket", "pick", q, F.lit(C.INTENT_TICKET), _arr(["ticket_agent"]), slots, None)


def combined_cases(ks: KeySamples) -> DataFrame:
    """GEN-3: even sample of the routes that have a weather row."""
    rows = ks.usable.pick(C.CASE_COUNTS["combined"])
    q = _route_query(X.pick_cyclic(C.COMBINED_TEMPLATES, F.col("pick")))
    slots = _slots_map({"departure_city": F.col("departure_city"), "arrival_city": F.col("arrival_city"),
                        "travel_date": F.col("travel_date"), "city": F.col("arrival_city"),
                        "fx_date": F.col("travel_date")})
    return _case(rows, "combined", "combined", "pick", q, F.lit(C.INTENT_BOTH),
                 _arr(["weather_agent", "ticket_agent"]), slots, None)


def _spec_frame(spark: SparkSession, specs: list[tuple], with_missing: bool) -> DataFrame:
    rows = []
    for i, spec in enumerate(specs, 1):
        if with_missing:
            tpl, src, idx, intent, agents, kept, missing = spec
        else:
            tpl, src, idx, intent, agents = spec
            kept, missing = None, []
        rows.append((i, tpl, src, None if idx is None else idx + 1, intent, agents, kept, missing))
    schema = ("spec int, template string, src string, pick long, intent string, agents array<string>, "
              "kept array<string>, missing array<string>")
    return spark.createDataFrame(rows, schema)


def _as_slot_row(s: DataFrame, src: str) -> DataFrame:
    for c in ["city", "fx_date", *ROUTE_ORDER]:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("string"))
    return s.select(F.lit(src).alias("src"), "pick", "city", "fx_date", *ROUTE_ORDER)


def missing_cases(ks: KeySamples) -> DataFrame:
    """GEN-4: 22 templates, each naming the slots it leaves out."""
    specs = _spec_frame(ks.spark, C.MISSING_SLOT_SPECS, True)
    picked = (_as_slot_row(ks.weather.pick(C.MISSING_SAMPLE_SIZES["w"]), "w")
              .unionByName(_as_slot_row(ks.routes.pick(C.MISSING_SAMPLE_SIZES["t"]), "t")))
    # The spec table is the fixed 22-row plan; the picks are bounded by it.
    rows = specs.join(F.broadcast(picked), ["src", "pick"], "left")
    city = F.coalesce(F.col("city"), F.col("arrival_city"))
    date = F.coalesce(F.col("fx_date"), F.col("travel_date"))
    q = X.render_template_col(F.col("template"), city, date, F.col("departure_city"), F.col("arrival_city"))
    fields = F.create_map(
        F.lit("city"), F.col("city"), F.lit("fx_date"), F.col("fx_date"),
        F.lit("departure_city"), F.col("departure_city"), F.lit("arrival_city"), F.col("arrival_city"),
        F.lit("travel_date"), F.col("travel_date"))
    kept = F.map_from_entries(F.transform(F.col("kept"), lambda kv: F.struct(
        F.split(kv, "=")[0].alias("key"), F.try_element_at(fields, F.split(kv, "=")[1]).alias("value"))))
    return _case(rows, "missing_slots", "missing_slots", "spec", q, F.col("intent"), F.col("agents"),
                 kept, F.col("missing"))


def unsupported_cases(spark: SparkSession) -> DataFrame:
    """GEN-5: the fixed out-of-scope texts (only ever part of ``all_cases``)."""
    rows = [(i, q) for i, q in enumerate(C.UNSUPPORTED_QUERIES, 1)]
    df = spark.createDataFrame(rows, "n int, q string")
    return _case(df, "unsupported", "unsupported", "n", F.col("q"), F.lit(C.INTENT_UNKNOWN),
                 F.array().cast("array<string>"), F.create_map().cast("map<string,string>"), None)


def edge_cases(ks: KeySamples) -> DataFrame:
    """GEN-6: negations and distractors over two route samples."""
    specs = _spec_frame(ks.spark, C.EDGE_SPECS, False)
    r = ks.routes.pick(C.EDGE_SAMPLE_SIZES["r"]).withColumn("src", F.lit("r"))
    c = ks.usable.pick(C.EDGE_SAMPLE_SIZES["c"]).withColumn("src", F.lit("c"))
    rows = specs.join(F.broadcast(r.unionByName(c)), ["src", "pick"], "left")
    q = X.render_template_col(F.col("template"), F.col("arrival_city"), F.col("travel_date"),
                              F.col("departure_city"), F.col("arrival_city"))
    has_t = F.array_contains("agents", "ticket_agent")
    has_w = F.array_contains("agents", "weather_agent")
    slots = _slots_map({
        "departure_city": F.when(has_t, F.col("departure_city")),
        "arrival_city": F.when(has_t, F.col("arrival_city")),
        "travel_date": F.when(has_t, F.col("travel_date")),
        "city": F.when(has_w, F.col("arrival_city")),
        "fx_date": F.when(has_w, F.col("travel_date")),
    })
    return _case(rows, "routing_edge", "routing_edge", "spec", q, F.col("intent"), F.col("agents"), slots, None)


def all_cases(ks: KeySamples) -> DataFrame:
    """SET-1: the six families in order; the total must match the plan.

    The cases are written once, so that the count, and whatever plan follows,
    starts from one small table and not from the six families again.
    """
    fams = [weather_cases(ks), ticket_cases(ks), combined_cases(ks), missing_cases(ks),
            unsupported_cases(ks.spark), edge_cases(ks)]
    out = fams[0]
    for f in fams[1:]:
        out = out.unionByName(f)
    out = cut_lineage(out)
    total = sum(C.CASE_COUNTS.values())
    n = out.select(F.count(F.lit(1))).scalar()
    check = F.when(n != F.lit(total), F.raise_error(F.format_string("Generated %d cases, expected " + str(total), n)))
    return out.filter(F.coalesce(check.cast("boolean"), F.lit(True)))


def flat_cases(cases: DataFrame) -> DataFrame:
    """Report shape: expected fields as columns, lists and slots as text."""
    e = F.col("expected")
    return cases.select(
        "id", "category", "query",
        e["intent"].alias("intent"),
        X.list_text(e["required_agents"]).alias("required_agents"),
        *[F.try_element_at(e["slots"], F.lit(s)).alias(f"slot_{s}") for s in C.SLOT_NAMES],
        X.list_text(e["missing_slots"]).alias("missing_slots"),
        e["need_clarification"].alias("need_clarification"))
