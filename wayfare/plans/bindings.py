"""Shape the driver tables into the reference's contracts.

The driver tables hold no trips or forecasts, so each binding is a plain
Spark plan over them (joins and projections) whose size grows with the
tables. Every binding has a DuckDB twin in ``plans/oracle.py``.

Sizes and joins: ``lineitem`` and ``orders`` are the big sides and are joined
on their keys (shuffle or AQE's runtime choice); ``nation`` is a fixed
25-row dimension in the TPC-H schema, so it is the only side broadcast by
hint. ``customer`` and ``supplier`` grow with the scale factor and are left
to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X

# Rules that shape requests from the route keys (see ``requests``).
FAMILIES = ["ticket", "weather", "combined"]
EPOCH = "1970-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_names(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    # nation is fixed at 25 rows by the schema: a proven broadcast bound.
    return F.broadcast(table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(f"{prefix}_nationkey"), F.col("n_name").alias(f"{prefix}_city")))


def order_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> customer nation: (o_orderkey, arrival_city, order columns)."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation_names(spark, sf_dir, "arr"), F.col("c_nationkey") == F.col("arr_nationkey")))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train_tickets contract (FIXTURES.md) from lineitem.

    departure_city = supplier nation, arrival_city = customer nation,
    departure_time = l_shipdate, arrival_time = + l_linenumber hours,
    train_number = l_partkey, seat_type = l_returnflag, seats from
    l_quantity, price = l_extendedprice as DECIMAL(10,2).
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    arrivals = order_arrivals(spark, sf_dir).select("o_orderkey", "arr_city")
    supplier = (table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
                .join(nation_names(spark, sf_dir, "dep"), F.col("s_nationkey") == F.col("dep_nationkey"))
                .select("s_suppkey", "dep_city"))
    joined = (line.join(arrivals, line.l_orderkey == arrivals.o_orderkey)
              .join(supplier, line.l_suppkey == supplier.s_suppkey))
    seats = F.col("l_quantity").cast("int")
    return joined.select(
        F.col("dep_city").alias("departure_city"),
        F.col("arr_city").alias("arrival_city"),
        F.col("l_shipdate").alias("departure_time"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("arrival_time"),
        F.col("l_partkey").cast("string").alias("train_number"),
        F.col("l_returnflag").alias("seat_type"),
        seats.alias("total_seats"),
        F.greatest(seats - F.col("l_linenumber"), F.lit(0)).alias("remaining_seats"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.col("l_orderkey"), F.col("l_linenumber"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored weather rows (weather_data contract) from orders, with repeats.

    city = customer nation, fx_date = order day, values from the order;
    ``seq`` = o_orderkey is the write order used by the upsert.
    """
    o = order_arrivals(spark, sf_dir)
    temp_max = F.floor(F.col("o_totalprice") / 10000).cast("int")
    return o.select(
        F.col("arr_city").alias("city"),
        F.to_date("o_orderdate").alias("fx_date"),
        temp_max.alias("temp_max"),
        (temp_max - (F.col("o_custkey") % 7).cast("int")).alias("temp_min"),
        F.col("o_orderpriority").alias("text_day"),
        F.col("o_orderstatus").alias("text_night"),
        F.lit(None).cast("string").alias("wind_dir_day"),
        F.lit(None).cast("string").alias("wind_scale_day"),
        (F.col("o_custkey") % 40).cast("int").alias("wind_speed_day"),
        ((F.floor(F.col("o_totalprice") / 1000) % 1000) / 10).cast("decimal(5,1)").alias("precip"),
        F.lit(None).cast("int").alias("uv_index"),
        (F.col("o_custkey") % 100).cast("int").alias("humidity"),
        F.lit(None).cast("int").alias("pressure"),
        F.lit(None).cast("int").alias("vis"),
        F.lit(None).cast("int").alias("cloud"),
        F.col("o_orderdate").alias("update_time"),
        F.col("o_orderkey").alias("seq"),
    )


def weather_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored weather table after the keyed upsert (last write wins)."""
    from wayfare.operators.load import latest_per_key
    return latest_per_key(readings(spark, sf_dir), C.WEATHER_KEY, ["seq"]).drop("seq")


def route_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1 input: one row per (departure, arrival, day) with its ticket count."""
    from wayfare.operators.cases import route_day_counts
    return route_day_counts(trips(spark, sf_dir))


def epoch_day(c) -> Column:
    return F.datediff(X.col_of(c), F.lit(EPOCH).cast("date"))


def _template_for(family: Column, idx: Column) -> Column:
    return (F.when(family == 0, X.pick_cyclic(C.TICKET_TEMPLATES, idx + 1))
            .when(family == 1, X.pick_cyclic(C.WEATHER_TEMPLATES, idx + 1))
            .otherwise(X.pick_cyclic(C.COMBINED_TEMPLATES, idx + 1)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text requests with the model's raw answer, one per route key.

    Rules, all from the key's day number e (days since 1970-01-01):
    asked day = day + (e % 2), so half ask for a day with no departures;
    family = e % 3 (ticket, weather, combined); template = (e div 3) % size;
    the model leaves out the dates when e % 5 == 0 and the weather city
    when e % 4 == 0; it wraps its JSON in a think block and a fence when
    e % 7 == 0, and in prose when e % 11 == 0.
    """
    keys = trips(spark, sf_dir).select(
        "departure_city", "arrival_city", F.to_date("departure_time").alias("day")).distinct()
    e = epoch_day("day")
    fam = e % 3
    asked = F.date_add(F.col("day"), (e % 2).cast("int"))
    date_text = X.iso_date(asked)
    dep, arr = F.col("departure_city"), F.col("arrival_city")
    no_date = (e % 5) == 0
    no_city = (e % 4) == 0
    wants_w = fam != 0
    wants_t = fam != 1
    slot_vals = {
        "city": F.when(wants_w & ~no_city, arr),
        "fx_date": F.when(wants_w & ~no_date, date_text),
        "departure_city": F.when(wants_t, dep),
        "arrival_city": F.when(wants_t, arr),
        "travel_date": F.when(wants_t & ~no_date, date_text),
    }
    slots = F.map_filter(F.create_map(*[x for k, v in slot_vals.items() for x in (F.lit(k), v)]),
                         lambda k, v: v.isNotNull())
    agents = (F.when(fam == 0, F.array(F.lit("ticket_agent")))
              .when(fam == 1, F.array(F.lit("weather_agent")))
              .otherwise(F.array(F.lit("weather_agent"), F.lit("ticket_agent"))))
    intent = F.when(fam == 0, F.lit("ticket_query")).when(fam == 1, F.lit("weather_query")).otherwise(
        F.lit("travel_planning"))
    body = F.to_json(F.struct(intent.alias("intent"), agents.alias("required_agents"), slots.alias("slots")))
    raw = (F.when((e % 7) == 0, F.concat(F.lit("<think>先判断意图和槽位。</think>\n```json\n"), body, F.lit("\n```")))
           .when((e % 11) == 0, F.concat(F.lit("好的，分析结果如下：\n"), body, F.lit("\n以上。")))
           .otherwise(body))
    return keys.select(
        F.concat_ws("|", dep, arr, X.iso_date("day")).alias("request_id"),
        dep, arr, X.iso_date("day").alias("route_day"),
        date_text.alias("asked_date"),
        fam.alias("family"),
        X.render_template_col(_template_for(fam, F.floor(e / 3)),
                              arr, date_text, dep, arr).alias("query"),
        raw.alias("model_output"),
    )


def live_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 input: landed forecast payloads, one per city, built from events.

    City = ``NATION_<user_id % 25>``; one daily entry per (city, day):
    max/min of ``value`` as temperatures, the sum as precipitation,
    (7 x event count) % 100 as weather code and the value range as wind. Arrays are
    ordered by day. Cities whose id is divisible by 5 have no wind arrays,
    like a payload with missing fields.
    """
    ev = table(spark, sf_dir, "events").select(
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("name"),
        F.to_date("ts").alias("day"), "value")
    daily = ev.groupBy("name", "day").agg(
        F.max("value").alias("tmax"), F.min("value").alias("tmin"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("psum"),
        ((F.count(F.lit(1)) * 7) % 100).cast("int").alias("code"),
        (F.max("value") - F.min("value")).alias("wind"))
    arr = daily.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(
        "day", "tmax", "tmin", "psum", "code", "wind"))).alias("d"))
    no_wind = F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 5 == 0
    return arr.select(
        "name",
        F.lit(35.0).alias("latitude"), F.lit(135.0).alias("longitude"),
        F.struct(
            F.transform("d", lambda s: X.iso_date(s["day"])).alias("time"),
            F.transform("d", lambda s: s["tmax"]).alias("temperature_2m_max"),
            F.transform("d", lambda s: s["tmin"]).alias("temperature_2m_min"),
            F.transform("d", lambda s: s["psum"]).alias("precipitation_sum"),
            F.transform("d", lambda s: s["code"]).alias("weather_code"),
            F.when(~no_wind, F.transform("d", lambda s: s["wind"])).alias("wind_speed_10m_max"),
            F.when(~no_wind, F.transform("d", lambda s: s["wind"])).alias("wind_direction_10m_dominant"),
        ).alias("daily"))


AS_OF = "2024-01-15"


def weather_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, fx_date) requests: every stored key and every live payload day."""
    stored = readings(spark, sf_dir).select("city", X.iso_date("fx_date").alias("fx_date"))
    live = (live_payloads(spark, sf_dir)
            .select(F.col("name").alias("city"), F.explode(F.col("daily.time")).alias("fx_date")))
    return stored.unionByName(live).distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoder candidates: every customer is a candidate for its nation's name,
    ranked by customer key."""
    c = table(spark, sf_dir, "customer")
    return (c.join(nation_names(spark, sf_dir, "q"), F.col("c_nationkey") == F.col("q_nationkey"))
            .select(F.col("q_city").alias("query_name"), F.col("c_name").alias("cand_name"),
                    F.col("c_custkey").alias("cand_rank"), F.col("c_acctbal").alias("latitude"),
                    F.col("c_nationkey").cast("double").alias("longitude")))


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to geocode: every nation and region name (regions have no candidate)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return n.unionByName(r).distinct()


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent tasks as an outside client sends them, one per request.

    shape = (e div 7) % 3: 0 nests standard slot names under ``slots``;
    1 sends flat aliases (origin, destination, date); 2 sends a blank
    departure_city next to ``from``, a weather_date, and no arrival or
    weather city (so both agents report missing slots).
    """
    r = requests(spark, sf_dir)
    e = epoch_day(F.to_date("route_day"))
    shape = F.floor(e / 7) % 3
    dep, arr, d = F.col("departure_city"), F.col("arrival_city"), F.col("asked_date")
    nested = F.create_map(F.lit("departure_city"), dep, F.lit("arrival_city"), arr, F.lit("travel_date"), d,
                          F.lit("city"), arr, F.lit("fx_date"), d)
    flat1 = F.create_map(F.lit("origin"), dep, F.lit("destination"), arr, F.lit("date"), d, F.lit("city"), arr)
    flat2 = F.create_map(F.lit("departure_city"), F.lit(""), F.lit("from"), dep,
                         F.lit("travel_date"), d, F.lit("weather_date"), d)
    return r.select(
        "request_id", "route_day", shape.alias("shape"),
        F.when(shape == 0, nested).alias("slots"),
        F.when(shape == 0, F.create_map(F.lit("trace_id"), F.col("request_id")))
        .when(shape == 1, flat1).otherwise(flat2).alias("metadata"))


def agent_faults(asked: DataFrame) -> DataFrame:
    """Transport faults per (request, agent) of ``requests``, read once: the
    weather call fails when e % 13 == 0 and the ticket call when e % 17 == 0
    (e = route day number)."""
    e = epoch_day(F.to_date("route_day"))
    failing = F.array_compact(F.array(F.when(e % 13 == 0, F.lit("weather_agent")), F.when(e % 17 == 0, F.lit("ticket_agent"))))
    return asked.select("request_id", F.explode(failing).alias("agent")).select(
        "request_id", "agent", F.format_string("TimeoutError('%s call timed out')", F.col("agent")).alias("error"))


def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text a tool sent back, per request: shape = e % 5: 0/1 a JSON object
    with the lookup's status, 2 an error line, 3 a JSON list, 4 an object
    followed by trailing text."""
    from wayfare.operators.lookup import first_departures
    req = requests(spark, sf_dir).select("request_id", "departure_city", "arrival_city", "asked_date", "route_day")
    f = first_departures(req, trips(spark, sf_dir), date="asked_date")
    e = epoch_day(F.to_date("route_day"))
    status = F.when(F.col("ticket_count") > 0, F.lit("success")).otherwise(F.lit("not_found"))
    obj = F.to_json(F.struct(status.alias("status"), F.col("ticket_count").alias("count")))
    text = (F.when(e % 5 <= 1, obj)
            .when(e % 5 == 2, F.lit("Error: tool process exited"))
            .when(e % 5 == 3, F.format_string("[%d]", F.col("ticket_count")))
            .otherwise(F.concat(obj, F.lit(" (cached)"))))
    return f.select("request_id", text.alias("tool_text"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events (LOG_EVENT contract) from ``events``.

    trace = user and day; view/click/error are a call's start/success/error
    (agent by user parity, attempt 1 + event_id % 2); purchase is a stage
    timer (name by event_id % 3, seconds = value); signup ends the trace with
    a status by event_id % 3, or (event_id % 4 == 3) asks for clarification,
    or (event_id % 4 == 1) tells an analysis, which names a supported agent
    when event_id % 8 == 1 and one that isn't otherwise.
    """
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    timer = F.element_at(F.array(*[F.lit(n) for n in C.TIMER_NAMES]), (F.col("event_id") % 3 + 1).cast("int"))
    done = F.element_at(F.array(F.lit("success"), F.lit("partial_success"), F.lit("agent_failed")),
                        (F.col("event_id") % 3 + 1).cast("int"))
    event = (F.when(et == "view", F.lit("a2a_call_start")).when(et == "click", F.lit("a2a_call_success"))
             .when(et == "error", F.lit("a2a_call_error")).when(et == "purchase", F.lit("timer"))
             .when(F.col("event_id") % 4 == 3, F.lit("route_need_clarification"))
             .when(F.col("event_id") % 4 == 1, F.lit("route_analysis_done"))
             .otherwise(F.lit("route_query_done")))
    is_call = et.isin("view", "click", "error")
    return ev.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.when(et == "error", F.lit("WARNING")).otherwise(F.lit("INFO")).alias("level"),
        F.lit("router").alias("logger"),
        event.alias("message"), event.alias("event"),
        F.format_string("u%d-%s", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"),
        F.when(is_call, F.when(F.col("user_id") % 2 == 0, F.lit("weather_agent")).otherwise(F.lit("ticket_agent")))
        .alias("agent"),
        F.lit(None).cast("string").alias("model"),
        F.when(is_call, (F.col("event_id") % 2 + 1).cast("int")).alias("attempt"),
        F.col("value").alias("elapsed_seconds"),
        F.when(et == "purchase", timer).alias("name"),
        F.when(event == "route_query_done", done).alias("status"),
        F.lit(None).cast("string").alias("intent"),
        F.when(event == "route_analysis_done", F.array(F.when(F.col("event_id") % 8 == 1, F.lit("weather_agent"))
                                                       .otherwise(F.lit("attraction_agent")))).alias("required_agents"),
        F.lit(None).cast("array<string>").alias("missing_slots"),
        F.when(et == "error", F.lit("TimeoutError()")).alias("error"),
        F.col("event_id"))


def landed_logs(spark: SparkSession, sf_dir: str) -> str:
    """Write the log events as JSON lines under the shared checkpoint folder
    and return the folder (the log-read source reads it back)."""
    import uuid
    from wayfare.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark)
    path = f"{root}/logs-{uuid.uuid4().hex[:8]}"
    from wayfare.operators.logs import LOG_TIME_WRITE_FORMAT
    (log_events(spark, sf_dir).drop("event_id").write.mode("errorifexists")
     .option("timestampFormat", LOG_TIME_WRITE_FORMAT).json(path))
    return path


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns: ``conversations`` as (conv_id, turn, role, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


NO_JSON_TEXT = "抱歉，我暂时无法给出结构化结果。"


def model_answers(cases: DataFrame) -> DataFrame:
    """A run's answers per case (id, query, model_output, latency_ms), from its label.

    m = case number + len(category). m % 11 == 0: the run has no answer for
    the case. k = m % 6: 0 no JSON at all, 1 agents swapped, 2 slots left
    out, 3 JSON inside a think block and a fence, otherwise the label itself.
    The model also states missing slots and need_clarification (the label's),
    as the prompt asks it to. Latency: 37 ms a character of the query.
    """
    e = F.col("expected")
    m = F.substring_index(F.col("id"), "_", -1).cast("int") + F.length("category")
    k = m % 6
    swapped = F.transform(e["required_agents"], lambda a: F.when(a == "weather_agent", F.lit("ticket_agent"))
                          .otherwise(F.lit("weather_agent")))
    agents = F.when(k == 1, swapped).otherwise(e["required_agents"])
    slots = F.when(k == 2, F.create_map().cast("map<string,string>")).otherwise(e["slots"])
    body = F.to_json(F.struct(e["intent"].alias("intent"), agents.alias("required_agents"), slots.alias("slots"),
                              e["missing_slots"].alias("missing_slots"),
                              e["need_clarification"].alias("need_clarification")))
    raw = (F.when(k == 0, F.lit(NO_JSON_TEXT))
           .when(k == 3, F.concat(F.lit("<think>按规则分析。</think>\n```json\n"), body, F.lit("\n```")))
           .otherwise(body))
    return cases.where(m % 11 != 0).select("id", "query", raw.alias("model_output"),
                                           (F.length("query") * 37).cast("long").alias("latency_ms"))


TICKET_FILES = ["train_tickets_20240101.csv", "train_tickets_20240102.csv"]
DROP_HEADER = ["id", "price", "departure_city", "arrival_city", "departure_time", "arrival_time", "train_number",
               "seat_type", "total_seats", "remaining_seats", "created_at"]


def ticket_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as a feed writes them: train number = part-order-line (unique
    per departure), line number kept for the drop rules. The seat type of
    line 4 has a line break, quotes and a comma."""
    t = trips(spark, sf_dir)
    t = t.withColumn("seat_type", F.when(F.col("l_linenumber") == 4, F.concat("seat_type", F.lit('\n"a,b"\n')
                                         , F.lit("c"))).otherwise(F.col("seat_type")))
    return t.withColumn("train_number", F.concat_ws(
        "-", F.col("train_number"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


def ticket_drops(spark: SparkSession, sf_dir: str) -> str:
    """Write two CSV snapshots of the ticket feed under the shared folder.

    Older file: line numbers 1-4, seats all free. Newer file: line numbers
    3-7 with current seats, so lines 3-4 update, 5-7 insert. Text cells on
    every third line are padded with an ideographic space and blanks; line 7
    has a blank train number, line 6 with return flag R a bad departure time,
    line 5 with flag N an over-long seat type. Columns are written in another
    order, with an extra ``id`` column.
    """
    import uuid
    from wayfare.session import cut_lineage, ensure_checkpoint_dir, scratch_tables
    root = f"{ensure_checkpoint_dir(spark)}/drops-{uuid.uuid4().hex[:8]}"
    ln = F.col("l_linenumber")
    pad = (ln % 3) == 0

    def text(c):
        return F.when(pad, F.concat(F.lit("\u3000"), F.col(c), F.lit("  "))).otherwise(F.col(c))

    def shaped(df, fresh):
        return df.select(
            F.lit("0").alias("id"),
            F.col("price").cast("string").alias("price"),
            text("departure_city").alias("departure_city"),
            text("arrival_city").alias("arrival_city"),
            F.when((ln == 6) & (F.col("seat_type") == "R"), F.lit("not-a-date"))
            .otherwise(F.date_format("departure_time", "yyyy-MM-dd HH:mm:ss")).alias("departure_time"),
            F.date_format("arrival_time", "yyyy-MM-dd HH:mm:ss").alias("arrival_time"),
            F.when(ln == 7, F.lit("")).otherwise(F.col("train_number")).alias("train_number"),
            F.when((ln == 5) & (F.col("seat_type") == "N"), F.lit("X" * 25)).otherwise(text("seat_type"))
            .alias("seat_type"),
            F.col("total_seats").cast("string").alias("total_seats"),
            (F.col("total_seats") if fresh else F.col("remaining_seats")).cast("string").alias("remaining_seats"),
            F.lit("").alias("created_at"))

    with scratch_tables(spark):
        feed = cut_lineage(ticket_feed(spark, sf_dir))  # written twice: build once
        write_csv(shaped(feed.filter(ln <= 4), True), f"{root}/{TICKET_FILES[0]}")
        write_csv(shaped(feed.filter(ln >= 3), False), f"{root}/{TICKET_FILES[1]}")
    return root


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, quotes doubled in quoted cells. Its files are
    compressed: as plain text, drops take more disk than all else."""
    from wayfare.session import no_shuffles_left
    with no_shuffles_left(df.sparkSession):
        df.write.mode(mode).option("header", True).option("escape", '"').option("compression", "lz4").csv(path)


WEATHER_FILES = ["weather_data_20240101.csv", "weather_data_20240102.csv"]


def weather_drops(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Two CSV snapshots of the readings (last one per city and day), beside
    the ticket drops. Older file: orders that 3 doesn't divide. Newer file:
    those that leave no rest of 1, its cities in lower case with an accent
    on every a and blanks at the end, so that they are the same cities only
    under the table's collation; a humidity ending in 3 comes with a bad
    temperature."""
    r = readings(spark, sf_dir)
    newer = F.concat(F.translate(F.lower("city"), "a", "\u00e1"), F.lit("  "))
    for name, rest, city in ((WEATHER_FILES[0], 0, F.col("city")), (WEATHER_FILES[1], 1, newer)):
        from wayfare.operators.load import latest_per_key
        rows = latest_per_key(r.where(F.col("seq") % 3 != rest), C.WEATHER_KEY, ["seq"])
        bad = F.lit(rest == 1) & (F.col("humidity") % 10 == 3)
        known = {"city": city, "fx_date": X.iso_date("fx_date"), "update_time": F.date_format("update_time", "yyyy-MM-dd HH:mm:ss"),
                 "temp_max": F.when(bad, F.lit("warm")).otherwise(F.col("temp_max").cast("string"))}
        has = [c for c in C.WEATHER_COLUMNS if c in rows.columns]
        write_csv(rows.select(*[known.get(c, F.col(c).cast("string") if c in has else F.lit("")).alias(c)
                                for c in C.WEATHER_COLUMNS]), f"{root}/{name}")


def land_drop(spark: SparkSession, root: str, name: str) -> str:
    """The files of a snapshot put into the folder that a stream reads."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path
    folder = f"{root}/incoming"
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(folder))
    for status in fs.globStatus(place(f"{root}/{name}/part-*.csv*")):
        fs.rename(status.getPath(), place(f"{folder}/{status.getPath().getName()}"))
    return folder
