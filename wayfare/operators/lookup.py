"""Batch lookups: ticket search, weather lookup, live-over-stored fallback.

Requests are tables. Work that does not depend on the request (ranking the
tickets of a route-day, folding them to a count and a first departure) is
done once on the ticket side and joined, so a route asked a million times
is ranked once, and a hot route is split across tasks by the range sort in
``rank_in_group`` or pre-aggregated by the partial ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators.hotkeys import left_join
from wayfare.operators.ordering import global_index, rank_in_group
from wayfare.session import cut_lineage

TICKET_ORDER = ["departure_time", "train_number", "seat_type", "arrival_time", "price",
                "total_seats", "remaining_seats"]
LIVE_COLUMNS = ["city", "fx_date", "temp_max", "temp_min", "text_day", "text_night", "precip", "wind_speed_day",
                "wind_dir_day", "source"]
ROUTE_DAY = ["departure_city", "arrival_city", "__day"]
BLOCK_ROWS = 1000  # tickets of one part of a prompt


def _with_day(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("__day", F.to_date("departure_time"))


def same_cities(requests: DataFrame, table: DataFrame, cols: list[str], collation: str = X.COLLATION) -> tuple[DataFrame, DataFrame]:
    """Both tables with their cities in one spelling wherever the collation
    calls them equal (case, accents and trailing blanks don't count), so that
    the lookups, which compare plainly, find what the reference finds. The
    requests are written once, the table is read once for its spellings."""
    requests = cut_lineage(requests)
    spelt = [df.select(*cols).distinct().select(F.explode(F.array(*cols)).alias("name")) for df in (requests, table)]
    names = spelt[0].unionByName(spelt[1])
    # the spellings, a small part of the rows
    mapping = cut_lineage(X.canonical_map(names, "name", collation))
    for c in cols:
        requests, table = X.canonicalize(requests, c, mapping), X.canonicalize(table, c, mapping)
    return requests, table


def ranked_tickets(tickets: DataFrame) -> DataFrame:
    """SRT-1: departure order inside each (route, day), ties broken by every column."""
    t = _with_day(tickets).select(*ROUTE_DAY, *[c for c in C.TICKET_SEARCH_COLUMNS if c not in ROUTE_DAY])
    return rank_in_group(t, ROUTE_DAY, TICKET_ORDER, "rank")


def requested_tickets(req: DataFrame, tickets: DataFrame, dep: str, arr: str) -> DataFrame:
    """The tickets of the routes and days (``__day``) of the requests."""
    asked = req.select(F.col(dep).alias("departure_city"), F.col(arr).alias("arrival_city"), "__day").distinct()
    return _with_day(tickets).join(asked, ROUTE_DAY, "left_semi")


def search_tickets(requests: DataFrame, tickets: DataFrame, dep: str = "departure_city",
                   arr: str = "arrival_city", date: str = "travel_date") -> DataFrame:
    """JON-1 + FLT-1: every ticket of the requested route and day, ranked.

    ``date`` is request text ``yyyy-MM-dd`` (strict). Only tickets of a
    requested route and day are read on; they are put in order once, by a
    range sort that splits a hot route-day, and written. A ticket's rank is
    its place less the place of its route-day's first, which the requests
    get from one row per route-day; requests without one keep one row with
    NULL ticket columns. The tickets then come by an inner join, which AQE
    can split on a hot route.
    """
    req = requests.withColumn("__rday", X.strict_date(date))
    asked = cut_lineage(req)
    t = requested_tickets(asked.withColumnRenamed("__rday", "__day"), tickets, dep, arr).select(
        *ROUTE_DAY, *[c for c in C.TICKET_SEARCH_COLUMNS if c not in ROUTE_DAY])
    placed = cut_lineage(global_index(t, [*ROUTE_DAY, *TICKET_ORDER], "__pos").withColumnsRenamed(
        {"departure_city": "__dep", "arrival_city": "__arr", "__day": "__tday"}))
    firsts = placed.groupBy(F.col("__dep").alias("__fdep"), F.col("__arr").alias("__farr"), F.col("__tday").alias("__fday")).agg(
        F.min("__pos").alias("__first"))
    begun = cut_lineage(left_join(asked, firsts, {dep: "__fdep", arr: "__farr", "__rday": "__fday"}))
    hit = begun.where("__first is not null")
    cond = (hit[dep] == placed["__dep"]) & (hit[arr] == placed["__arr"]) & (hit["__rday"] == placed["__tday"])
    found = hit.join(placed, cond).withColumn("rank", (F.col("__pos") - F.col("__first") + 1).cast("long"))
    return (found.unionByName(begun.where("__first is null"), allowMissingColumns=True)
            .drop("__dep", "__arr", "__tday", "__rday", "__pos", "__first"))


def ticket_fields(row: Column) -> dict[str, Column]:
    """A ticket as the lookup tool reports it: times as ISO text, price as a number."""
    shown = {"departure_time": X.iso_datetime, "arrival_time": X.iso_datetime, "price": lambda c: c.cast("double")}
    return {c: shown.get(c, lambda v: v)(row[c]) for c in C.TICKET_SEARCH_COLUMNS}


def route_day_tickets(tickets: DataFrame) -> DataFrame:
    """AGG-10: the ordered tickets of a (route, day) as one JSON list, their
    number and the first of them.

    A row holds what one answer about that route and day shows, so use it
    where that text is wanted in one piece, ``ticket_blocks`` where a route
    may be hot and ``search_tickets`` elsewhere.
    """
    t = _with_day(tickets)
    cols = [*TICKET_ORDER, *[c for c in C.TICKET_SEARCH_COLUMNS if c not in TICKET_ORDER]]
    listed = t.groupBy(*ROUTE_DAY).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("__l"))
    return listed.select(*ROUTE_DAY, F.size("__l").cast("long").alias("ticket_count"), F.col("__l")[0].alias("first"), F.to_json(
        F.transform("__l", lambda x: F.struct(*[v.alias(k) for k, v in ticket_fields(x).items()])),
        {"ignoreNullFields": "false"}).alias("tickets"))


def ticket_blocks(tickets: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """AGG-10 in pieces: the list of ``route_day_tickets`` as ``block`` 1, 2, ..
    of at most ``rows`` tickets and its ``text`` (objects joined by commas,
    without the brackets), so that no task gathers a hot route."""
    one = F.to_json(F.struct(*[v.alias(k) for k, v in ticket_fields(F.struct(*C.TICKET_SEARCH_COLUMNS)).items()]),
                    {"ignoreNullFields": "false"})
    t = ranked_tickets(tickets).select(*ROUTE_DAY, "rank", one.alias("__j"),
                                       F.expr(f"(rank - 1) div {int(rows)} + 1").alias("block"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "__j")))
    return t.groupBy(*ROUTE_DAY, "block").agg(listed.alias("__l")).select(
        *ROUTE_DAY, "block", F.array_join(F.transform("__l", lambda x: x["__j"]), ",").alias("text"))


def route_day_fold(tickets: DataFrame) -> DataFrame:
    """AGG-10 on the ticket side: count and first departure per (route, day)."""
    t = _with_day(tickets)
    first = F.min_by(F.struct(*[F.col(c) for c in C.TICKET_SEARCH_COLUMNS]),
                     F.struct(*[F.col(c) for c in TICKET_ORDER]))
    return t.groupBy(*ROUTE_DAY).agg(F.count(F.lit(1)).alias("ticket_count"), first.alias("first"))


def first_departures(requests: DataFrame, tickets: DataFrame, dep: str = "departure_city",
                     arr: str = "arrival_city", date: str = "travel_date", listed: bool = False) -> DataFrame:
    """WIN-2 / AGG-10: per request, the ticket count and the first departure;
    with ``listed`` also the route-day's ``tickets`` as one JSON list (NULL
    without one). Both come from one pass over the tickets; lists are made
    for requested route-days only."""
    req = requests.withColumn("__rday", X.strict_date(date))
    if listed:
        req = cut_lineage(req)
        fold = route_day_tickets(requested_tickets(req.withColumnRenamed("__rday", "__day"), tickets, dep, arr))
    else:
        fold = route_day_fold(tickets)
    fold = fold.withColumnsRenamed({"departure_city": "__dep", "arrival_city": "__arr", "__day": "__tday"})
    out = left_join(req, fold, {dep: "__dep", arr: "__arr", "__rday": "__tday"})
    return out.withColumn("ticket_count", F.coalesce("ticket_count", F.lit(0).cast("long"))).drop("__rday")


def ticket_summary_text(first: Column, count: Column, currency: str = C.DEFAULT_CURRENCY) -> Column:
    """XPR-8: summary of the first ticket; absent fields print defaults."""
    def field(name, rendered):
        return F.coalesce(rendered, F.lit(C.TICKET_DEFAULTS[name]))
    s = (C.TICKET_SUMMARY.replace("{currency}", currency))
    out = X.render(
        s,
        departure_city=field("departure_city", first["departure_city"]),
        arrival_city=field("arrival_city", first["arrival_city"]),
        count=count,
        train_number=field("train_number", first["train_number"]),
        departure_time=field("departure_time", X.iso_datetime(first["departure_time"])),
        arrival_time=field("arrival_time", X.iso_datetime(first["arrival_time"])),
        price=field("price", first["price"].cast("double").cast("string")),
        remaining_seats=field("remaining_seats", first["remaining_seats"].cast("string")),
    )
    return F.when(count > 0, out).otherwise(F.lit(C.TICKET_NONE_SUMMARY))


def stored_weather(requests: DataFrame, weather: DataFrame, city: str = "city",
                   date: str = "fx_date") -> DataFrame:
    """JON-2 / FLT-2 / LIM-1: the stored row for (city, day) or NULLs.

    The weather table is unique on its key (it is the upsert's output), so
    the left join keeps one row per request without a rank; a city and day
    that many requests ask for is dealt over tasks.
    """
    w = weather.select(*[F.col(c).alias("w_" + c) for c in C.WEATHER_LOOKUP_COLUMNS], F.col("city").alias("__wcity"),
                       F.col("fx_date").alias("__wday"), F.lit("database").alias("w_source"))
    req = requests.withColumn("__day", X.strict_date(date))
    return left_join(req, w, {city: "__wcity", "__day": "__wday"}).drop("__day")


def code_text(code: Column) -> Column:
    """JON-7: weather code -> text, default for unknown codes.

    The dictionary is a fixed 28-entry literal, evaluated as a map lookup in
    the projection: no join at all.
    """
    m = F.create_map(*[x for k, v in C.WEATHER_CODE_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, code), F.lit(C.UNKNOWN_WEATHER_TEXT))


def in_forecast_window(date_text: Column, as_of: str, days: int = C.FORECAST_MAX_DAYS) -> Column:
    """FLT-3: as_of <= d <= as_of + days; unparseable dates are outside."""
    d = X.strict_date(date_text)
    start = F.lit(as_of).cast("date")
    return F.coalesce(d.between(start, F.date_add(start, days)), F.lit(False))


def explode_payloads(payloads: DataFrame) -> DataFrame:
    """SRC-6: one row per (location, day); short arrays give NULL."""
    d = F.col("daily")

    def arr(field, alias, elem):
        # An absent array reads as empty, so zipping pads it with NULLs.
        return F.coalesce(d[field], F.array().cast(f"array<{elem}>")).alias(alias)

    zipped = F.arrays_zip(
        d["time"].alias("time"), arr("temperature_2m_max", "temp_max", "double"),
        arr("temperature_2m_min", "temp_min", "double"), arr("precipitation_sum", "precip", "double"),
        arr("weather_code", "code", "int"), arr("wind_speed_10m_max", "wind_speed", "double"),
        arr("wind_direction_10m_dominant", "wind_dir", "double"))
    return (payloads.select("name", F.explode(zipped).alias("z"))
            .filter(F.col("z.time").isNotNull())
            .select(F.col("name"), F.col("z.time").alias("fx_date"), F.col("z.temp_max").alias("temp_max"),
                    F.col("z.temp_min").alias("temp_min"), F.col("z.precip").alias("precip"),
                    F.col("z.code").alias("weather_code"), F.col("z.wind_speed").alias("wind_speed_day"),
                    F.col("z.wind_dir").alias("wind_dir_day")))


def live_rows(payloads: DataFrame) -> DataFrame:
    """Live rows in the stored shape (no humidity), ``source = 'open-meteo'``."""
    e = explode_payloads(payloads)
    text = code_text(F.col("weather_code"))
    return e.select(
        F.col("name").alias("city"), "fx_date", "temp_max", "temp_min",
        text.alias("text_day"), text.alias("text_night"), "precip", "wind_speed_day", "wind_dir_day",
        F.lit("open-meteo").alias("source"))


def weather_by_day(live: DataFrame, weather: DataFrame, as_of: str, live_enabled: bool = True) -> DataFrame:
    """JON-3 on the weather side: per (``__city``, ``__wday``) the row that
    answers any request for it. The whole live row if the day is in the
    window, else the whole stored row; row level, not per-column coalesce: a
    live row never borrows the stored humidity. Of several live rows the
    least counts. ``data`` is the chosen row whole, as JSON."""
    stored = weather.select(F.col("city").alias("__city"), F.col("fx_date").alias("__wday"),
                            F.struct(*C.WEATHER_LOOKUP_COLUMNS).alias("__stored"))
    rows = stored
    if live_enabled:
        day = X.strict_date("fx_date")
        fresh = live.where((X.iso_date(day) == F.col("fx_date")) & in_forecast_window(F.col("fx_date"), as_of)).select(
            F.col("city").alias("__city"), day.alias("__wday"), F.struct(*LIVE_COLUMNS).alias("__live"))
        # a group is a live row and a stored one
        rows = stored.unionByName(fresh, allowMissingColumns=True).groupBy("__city", "__wday").agg(
            F.min("__live").alias("__live"), F.first("__stored", ignorenulls=True).alias("__stored"))
    else:
        kinds = live.select(F.struct(*LIVE_COLUMNS).alias("x")).schema["x"].dataType
        rows = stored.withColumn("__live", F.lit(None).cast(kinds))
    lv, st = F.col("__live"), F.col("__stored")
    use_live = lv.isNotNull()

    def pick(live_c, db_c):
        return F.when(use_live, live_c).otherwise(db_c)

    shown = {c: st[c] for c in C.WEATHER_LOOKUP_COLUMNS} | {
        "fx_date": X.iso_date(st["fx_date"]), "update_time": X.iso_datetime(st["update_time"]), "source": F.lit("database")}
    return rows.select(
        "__city", "__wday", pick(lv["source"], F.lit("database")).alias("source"),
        pick(lv["city"], st["city"]).alias("weather_city"), pick(lv["fx_date"], X.iso_date(st["fx_date"])).alias("weather_date"),
        *[pick(lv[c], st[c].cast("double")).alias(c) for c in ("temp_max", "temp_min")],
        pick(lv["text_day"], st["text_day"]).alias("text_day"), pick(F.lit(None).cast("int"), st["humidity"]).alias("humidity"),
        pick(lv["precip"], st["precip"].cast("double")).alias("precip"),
        *[pick(lv[c].cast("string"), st[c].cast("string")).alias(f"{c}_text") for c in ("temp_max", "temp_min", "precip")],
        pick(X.json_text({c: lv[c] for c in LIVE_COLUMNS}), X.json_text(shown)).alias("data"))


def live_or_stored(requests: DataFrame, live: DataFrame, weather: DataFrame, as_of: str,
                   city: str = "city", date: str = "fx_date", live_enabled: bool = True) -> DataFrame:
    """JON-3: per request the live row, else the stored one, else nothing
    (see ``weather_by_day``, whose choice hangs on city and day only). One
    join; a hot city and day is dealt over tasks.

    Adds source, weather_city, weather_date, temp_max, temp_min, text_day,
    humidity, precip (numbers as double), *_text renderings of the numbers
    (int, float or decimal) and ``data``, the chosen row whole as JSON.
    """
    req = requests.withColumn("__day", X.strict_date(date))
    rows = weather_by_day(live, weather, as_of, live_enabled)
    return left_join(req, rows, {city: "__city", "__day": "__wday"}).drop("__day")


def weather_summary_text(found: Column, city: Column, fx_date: Column, text_day: Column, temp_min: Column,
                         temp_max: Column, humidity: Column, precip: Column) -> Column:
    """XPR-7: weather summary; absent and NULL both print the default word."""
    def field(name, c):
        return F.coalesce(c.cast("string"), F.lit(C.WEATHER_DEFAULTS[name]))
    out = X.render(C.WEATHER_SUMMARY, city=field("city", city), fx_date=field("fx_date", fx_date),
                   text_day=field("text_day", text_day), temp_min=field("temp_min", temp_min),
                   temp_max=field("temp_max", temp_max), humidity=field("humidity", humidity),
                   precip=field("precip", precip))
    return F.when(found, out).otherwise(F.lit(C.WEATHER_NONE_SUMMARY))


def first_candidate(names: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """JON-6: geocoder top-1 per name (lowest rank), none -> NULL columns."""
    top = candidates.groupBy(F.col("query_name")).agg(
        F.min_by(F.struct("cand_name", "latitude", "longitude"), F.col("cand_rank")).alias("top"))
    out = names.join(top, names[name] == top["query_name"], "left")
    return out.select(*names.columns, F.col("top.cand_name").alias("cand_name"),
                      F.col("top.latitude").alias("latitude"), F.col("top.longitude").alias("longitude"))
