"""Score predicted analyses against labelled cases (EVL-*, AGG-3..8, AGG-12, JON-8, SET-2).

Cases and predictions are two tables that meet on the case id. Every metric
is emitted with its hits and total; ratios stay unrounded (rounding is a
report-edge concern, see XPR-17).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators import routing as R
from wayfare.operators.ordering import RankSelector, numbered

CHECKS = ["intent", "agent_routing", "slot_exact", "missing_slots", "need_clarification"]
METRICS = dict(zip(CHECKS, ["intent_accuracy", "agent_routing_accuracy", "slot_exact_match",
                            "missing_slot_accuracy", "need_clarification_accuracy"]))
NO_PREDICTION = "no prediction"
ANALYSIS = ["intent", "required_agents", *[f"slot_{n}" for n in C.SLOT_NAMES], "missing_slots", "need_clarification"]


def predictions(answers: DataFrame) -> DataFrame:
    """Rules run (thinking + rules): the analyzer over each model answer.

    ``answers``: id, query, model_output, latency_ms; out: id, the analysis,
    error and latency_ms.
    """
    return R.analyze(answers).select("id", *ANALYSIS, "error", "latency_ms")


def model_only(answers: DataFrame) -> DataFrame:
    """Baseline run: the model's own fields, no rule layer."""
    p = R.parse_model(answers)
    top = F.from_json(F.col("model_json"), "map<string,string>")
    ok = F.col("model_error").isNull()
    return p.select(
        "id",
        F.when(ok, F.try_element_at(top, F.lit("intent"))).alias("intent"),
        F.when(ok, F.coalesce(F.col("model_agents"), F.array().cast("array<string>"))).alias("required_agents"),
        *[F.when(ok, F.try_element_at(F.col("model_slots"), F.lit(s))).alias(f"slot_{s}") for s in C.SLOT_NAMES],
        F.when(ok, F.coalesce(F.from_json(F.try_element_at(top, F.lit("missing_slots")), "array<string>"),
                              F.array().cast("array<string>"))).alias("missing_slots"),
        F.when(ok, F.try_element_at(top, F.lit("need_clarification")) == F.lit("true")).alias("need_clarification"),
        F.col("model_error").alias("error"), "latency_ms")


def _norm(c: Column) -> Column:
    v = X.py_strip(c)
    return F.when(v != F.lit(""), v)


def _slots(value) -> Column:
    """The non-NULL slots as a map, in the fixed slot order."""
    return F.map_filter(F.create_map(*[x for n in C.SLOT_NAMES for x in (F.lit(n), value(n))]),
                        lambda k, v: v.isNotNull())


def score(cases: DataFrame, pred: DataFrame) -> DataFrame:
    """JON-8 / EVL-1: five checks per case against its prediction.

    A case without a prediction, or whose analysis failed, is scored against
    an empty prediction and carries the error text; its latency is the
    prediction's, NULL without one. ``actual`` is the prediction in the shape
    of ``expected``. Predictions of unknown cases are left out.
    """
    e, empty = F.col("expected"), F.array().cast("array<string>")
    p = pred.select("id", *[F.col(c).alias("p_" + c) for c in ANALYSIS],
                    F.coalesce("error", F.lit("")).alias("error"), "latency_ms")
    both = cases.select("id", "category", "query", "expected").join(p, "id", "left")
    agents = F.coalesce(F.col("p_required_agents"), empty)
    missing = F.coalesce(F.col("p_missing_slots"), empty)
    exp_agents = F.coalesce(e["required_agents"], empty)
    w_rel = F.array_contains(exp_agents, "weather_agent")
    t_rel = F.array_contains(exp_agents, "ticket_agent")
    relevant = {"city": w_rel, "fx_date": w_rel, "departure_city": t_rel, "arrival_city": t_rel,
                "travel_date": t_rel}
    slot_ok = F.lit(True)
    for s, rel in relevant.items():
        slot_ok = slot_ok & (~rel | _norm(F.try_element_at(e["slots"], F.lit(s))).eqNullSafe(_norm(F.col(f"p_slot_{s}"))))
    need = F.coalesce(F.col("p_need_clarification"), F.lit(False))
    checks = {
        "intent": F.coalesce(F.col("p_intent") == e["intent"], F.lit(False)),
        "agent_routing": X.same_multiset(agents, exp_agents),
        "slot_exact": slot_ok,
        "missing_slots": X.same_multiset(missing, e["missing_slots"]),
        "need_clarification": need == F.coalesce(e["need_clarification"], F.lit(False)),
    }
    actual = F.struct(F.col("p_intent").alias("intent"), agents.alias("required_agents"),
                      _slots(lambda n: F.col(f"p_slot_{n}")).alias("slots"),
                      missing.alias("missing_slots"), need.alias("need_clarification"))
    out = both.select("id", "category", "query", "expected", actual.alias("actual"),
                      *[v.alias(k + "_ok") for k, v in checks.items()],
                      F.coalesce("error", F.lit(NO_PREDICTION)).alias("error"), "latency_ms")
    all_ok = F.lit(True)
    for k in CHECKS:
        all_ok = all_ok & F.col(k + "_ok")
    return out.withColumn("failed", ~all_ok | (F.col("error") != ""))


def _rates(checks: list[str]) -> list[Column]:
    """Per check the hits and the ratio to all cases (zero of none)."""
    n = F.count(F.lit(1))
    hits = {k: F.count_if(F.col(f"{k}_ok")) for k in checks}
    return [*[h.alias(f"{k}_hits") for k, h in hits.items()],
            *[F.coalesce(F.try_divide(h, n), F.lit(0.0)).alias(METRICS[k]) for k, h in hits.items()]]


def summary(scored: DataFrame) -> DataFrame:
    """EVL-2 / AGG-3 / AGG-7: one row; empty input gives zeros. The count per
    category is ``by_category``'s and the failed ids are ``failures``'s."""
    return scored.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if("failed").alias("failed_count"),
        *_rates(CHECKS),
        F.coalesce(F.avg("latency_ms") / 1000.0, F.lit(0.0)).alias("average_latency_seconds"))


def by_category(scored: DataFrame) -> DataFrame:
    """AGG-4: per category the count, four checks and mean latency."""
    return scored.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"), *_rates(CHECKS[:4]),
        F.coalesce(F.avg("latency_ms") / 1000.0, F.lit(0.0)).alias("average_latency_seconds"))


def failures(scored: DataFrame) -> DataFrame:
    """AGG-6 / EVL-3: the failed cases in case order (category order, then
    id; ``position`` from 1), each with the checks it failed, its query, and
    expected and actual analysis as JSON."""
    names = F.filter(F.array(*[F.when(~F.col(k + "_ok"), F.lit(k)) for k in CHECKS]), lambda x: x.isNotNull())
    place = F.array_position(F.array(*[F.lit(c) for c in C.CASE_COUNTS]), F.col("category"))
    e = F.col("expected")
    expected = e.withField("slots", _slots(lambda n: F.try_element_at(e["slots"], F.lit(n))))
    rows = scored.filter("failed").select(
        place.alias("__place"), "id", "category", F.array_join(names, ",").alias("failed_checks"), "error", "query",
        F.to_json(expected).alias("expected"), F.to_json("actual").alias("actual"), "latency_ms")
    return numbered(rows, ["__place", "category", "id"], "position").drop("__place")


def percentiles(scored: DataFrame, exact: bool = True, most: int = 1 << 20) -> DataFrame:
    """AGG-12: latency percentiles per category (exact, or approximate).

    Exact ones are taken by rank (see ``RankSelector``): a category's values
    are counted in ranges and only the ranges around the percentiles are
    sorted, so no task holds all of a category. ``scored`` is read a few
    times. Between two ranks the value is interpolated.
    """
    points = {"p50_ms": 0.5, "p90_ms": 0.9}
    if not exact:
        return scored.groupBy("category").agg(*[F.round(F.percentile_approx("latency_ms", p).cast("double"), 3).alias(c)
                                                for c, p in points.items()])
    some = scored.where("latency_ms is not null").select("category", F.col("latency_ms").cast("double").alias("__ms"))
    ranks = RankSelector(some, ["__ms"], ["category"], most)
    wanted, weights = [], []
    for group, n in ranks.counts.items():
        for column, p in points.items():
            low = math.floor(p * (n - 1))
            share = p * (n - 1) - low
            for rank, weight in ((low, 1 - share), (low + 1, share)):
                if weight > 0:
                    weights.append((len(wanted), column, weight))
                    wanted.append((group, rank, len(wanted)))
    # a few rows per category
    table = scored.sparkSession.createDataFrame(weights, "__wanted long, column string, weight double")
    values = ranks.rows_at(wanted).join(F.broadcast(table), "__wanted")
    # Interpolation may differ in the last bit between engines: round at the
    # report edge (milliseconds, 3 decimals).
    per = values.groupBy("category").agg(*[F.round(F.sum(F.when(F.col("column") == c, F.col("__ms") * F.col("weight"))), 3).alias(c)
                                           for c in points])
    per = per.withColumnRenamed("category", "__category")
    return scored.select("category").distinct().join(per, F.col("category").eqNullSafe(F.col("__category")), "left").drop("__category")


def compare_runs(runs: dict[str, DataFrame], baseline: str, final: str) -> DataFrame:
    """AGG-8: metrics x runs, plus final minus baseline."""
    metric_cols = list(METRICS.values())
    long = None
    for name, scored in runs.items():
        s = summary(scored).select(F.lit(name).alias("run"), F.stack(
            F.lit(len(metric_cols) + 1),
            *[x for m in metric_cols for x in (F.lit(m), F.col(m))],
            F.lit("failed_count"), F.col("failed_count").cast("double")).alias("metric", "value"))
        long = s if long is None else long.unionByName(s)
    wide = long.groupBy("metric").pivot("run", list(runs)).agg(F.first("value"))
    return wide.withColumn("difference", F.col(final) - F.col(baseline))
