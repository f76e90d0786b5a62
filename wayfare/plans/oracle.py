"""DuckDB twins of the bindings and queries (the correctness oracle).

Each query here is written independently in plain SQL over the driver
tables; only the fixed vocabularies and templates are shared with the
Spark side, as SQL literals.
"""

from __future__ import annotations

from wayfare import contracts as C


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def contains_any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(t)})" for t in terms) + ")"


def render(template: str, **exprs) -> str:
    """Template with ``{name}`` holes -> SQL concatenation (NULL -> '')."""
    out = q(template)
    for name, expr in exprs.items():
        out = out.replace("{" + name + "}", f"' || coalesce(CAST(({expr}) AS VARCHAR), '') || '")
    return out


def render_col(template_expr: str, city: str, date: str, dep: str, arr: str) -> str:
    out = template_expr
    for name, expr in (("city", city), ("date", date), ("dep", dep), ("arr", arr)):
        out = f"replace({out}, {q('{' + name + '}')}, coalesce({expr}, ''))"
    return out


def iso_ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S')"


def iso_date(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def valid(col: str) -> str:
    invalid = ", ".join(q(v) for v in C.INVALID_SLOT_VALUES)
    return f"coalesce(lower(trim({col})) NOT IN ({invalid}), false)"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- bindings ---------------------------------------------------------------

TRIPS = """trips AS MATERIALIZED (
  SELECT sn.n_name AS departure_city, cn.n_name AS arrival_city,
         l.l_shipdate AS departure_time,
         l.l_shipdate + to_hours(l.l_linenumber) AS arrival_time,
         CAST(l.l_partkey AS VARCHAR) AS train_number, l.l_returnflag AS seat_type,
         CAST(l.l_quantity AS INTEGER) AS total_seats,
         greatest(CAST(l.l_quantity AS INTEGER) - l.l_linenumber, 0) AS remaining_seats,
         CAST(l.l_extendedprice AS DECIMAL(10,2)) AS price,
         l.l_orderkey, l.l_linenumber
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey)"""

READINGS = """readings AS (
  SELECT cn.n_name AS city, CAST(o.o_orderdate AS DATE) AS fx_date,
         CAST(floor(o.o_totalprice / 10000) AS INTEGER) AS temp_max,
         CAST(floor(o.o_totalprice / 10000) AS INTEGER) - CAST(o.o_custkey % 7 AS INTEGER) AS temp_min,
         o.o_orderpriority AS text_day, o.o_orderstatus AS text_night,
         CAST(o.o_custkey % 40 AS INTEGER) AS wind_speed_day,
         CAST((floor(o.o_totalprice / 1000) % 1000) / 10 AS DECIMAL(5,1)) AS precip,
         CAST(o.o_custkey % 100 AS INTEGER) AS humidity,
         o.o_orderdate AS update_time, o.o_orderkey AS seq
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey)"""

WEATHER = """weather AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY city, fx_date ORDER BY seq DESC) AS rn FROM readings)
  WHERE rn = 1)"""

ROUTES = """routes AS (
  SELECT departure_city, arrival_city, strftime(CAST(departure_time AS DATE), '%Y-%m-%d') AS travel_date,
         count(*) AS ticket_count
  FROM trips GROUP BY 1, 2, 3)"""

READING_KEYS = """reading_keys AS (
  SELECT DISTINCT city, strftime(fx_date, '%Y-%m-%d') AS fx_date FROM readings)"""


def _tpl_pick(templates: list[str], idx: str) -> str:
    return f"{sql_list(templates)}[({idx}) % {len(templates)} + 1]"


REQUESTS = f"""rkeys AS (
  SELECT DISTINCT departure_city, arrival_city, CAST(departure_time AS DATE) AS day FROM trips),
rke AS (
  SELECT *, date_diff('day', DATE '1970-01-01', day) AS e FROM rkeys),
rkd AS (
  SELECT *, e % 3 AS family, strftime(day + CAST(e % 2 AS INTEGER), '%Y-%m-%d') AS asked_date,
         e % 5 = 0 AS no_date, e % 4 = 0 AS no_city
  FROM rke),
requests AS (
  SELECT departure_city || '|' || arrival_city || '|' || strftime(day, '%Y-%m-%d') AS request_id,
         departure_city, arrival_city, strftime(day, '%Y-%m-%d') AS route_day, asked_date, family, e,
         {render_col(f'''CASE family WHEN 0 THEN {_tpl_pick(C.TICKET_TEMPLATES, 'e // 3')}
                    WHEN 1 THEN {_tpl_pick(C.WEATHER_TEMPLATES, 'e // 3')}
                    ELSE {_tpl_pick(C.COMBINED_TEMPLATES, 'e // 3')} END''',
                     'arrival_city', 'asked_date', 'departure_city', 'arrival_city')} AS query,
         CASE family WHEN 0 THEN ['ticket_agent'] WHEN 1 THEN ['weather_agent']
              ELSE ['weather_agent', 'ticket_agent'] END AS model_agents,
         CASE WHEN family <> 0 AND NOT no_city THEN arrival_city END AS m_city,
         CASE WHEN family <> 0 AND NOT no_date THEN asked_date END AS m_fx_date,
         CASE WHEN family <> 1 THEN departure_city END AS m_departure_city,
         CASE WHEN family <> 1 THEN arrival_city END AS m_arrival_city,
         CASE WHEN family <> 1 AND NOT no_date THEN asked_date END AS m_travel_date
  FROM rkd)"""


def analysis_ctes(src: str, name: str = "analysis") -> str:
    """RTE-1..3 in SQL over ``src`` with columns query, model_agents, m_<slot>."""
    slots = C.SLOT_NAMES
    slot_case = lambda var, prefix: ("CASE " + var + " " + " ".join(
        f"WHEN {q(s)} THEN {prefix}{s}" for s in slots) + " END")
    labels = "CASE s " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.SLOT_LABELS.items()) + " END"
    return f"""{name}_f AS (
  SELECT *,
    {contains_any('query', C.WEATHER_KEYWORDS)} AS wants_weather,
    ({contains_any('query', C.TRAIN_KEYWORDS)} OR (contains(query, {q(C.TICKET_CHAR)})
       AND NOT {contains_any('query', C.FLIGHT_KEYWORDS)} AND NOT contains(query, {q(C.ADMISSION_TICKET)}))) AS wants_train,
    {contains_any('query', C.FLIGHT_KEYWORDS)} AS wants_flight,
    {contains_any('query', C.ATTRACTION_KEYWORDS)} AS wants_attraction,
    {contains_any('query', C.NEGATIVE_WEATHER_PATTERNS)} AS excludes_weather,
    {contains_any('query', C.NEGATIVE_TICKET_PATTERNS)} AS excludes_ticket
  FROM {src}),
{name}_a AS (
  SELECT *,
    list_filter(
      CASE WHEN (wants_weather AND NOT excludes_weather) OR (wants_train AND NOT excludes_ticket)
                OR wants_flight OR wants_attraction
           THEN list_filter([CASE WHEN wants_weather AND NOT excludes_weather THEN 'weather_agent' END,
                             CASE WHEN wants_train AND NOT excludes_ticket THEN 'ticket_agent' END],
                            lambda x: x IS NOT NULL)
           ELSE list_filter(coalesce(model_agents, []::VARCHAR[]), lambda x: x IN ('weather_agent', 'ticket_agent')) END,
      lambda x: NOT (excludes_weather AND x = 'weather_agent') AND NOT (excludes_ticket AND x = 'ticket_agent'))
      AS required_agents
  FROM {name}_f),
{name}_s AS (
  SELECT *,
    CASE WHEN list_contains(required_agents, 'weather_agent') AND NOT {valid('m_city')} AND {valid('m_arrival_city')}
         THEN m_arrival_city ELSE m_city END AS s_city,
    CASE WHEN list_contains(required_agents, 'weather_agent') AND NOT {valid('m_fx_date')} AND {valid('m_travel_date')}
         THEN m_travel_date ELSE m_fx_date END AS s_fx_date,
    m_departure_city AS s_departure_city, m_arrival_city AS s_arrival_city, m_travel_date AS s_travel_date
  FROM {name}_a),
{name}_m AS (
  SELECT *,
    flatten(list_transform(required_agents, lambda a: list_filter(
      CASE WHEN a = 'weather_agent' THEN {sql_list(C.REQUIRED_SLOTS['weather_agent'])}
           ELSE {sql_list(C.REQUIRED_SLOTS['ticket_agent'])} END,
      lambda s: NOT coalesce(lower(trim({slot_case('s', 's_')})) NOT IN ({", ".join(q(v) for v in C.INVALID_SLOT_VALUES)}), false))))
      AS missing_slots
  FROM {name}_s),
{name} AS MATERIALIZED (
  SELECT *,
    CASE WHEN len(required_agents) = 1 AND required_agents[1] = 'weather_agent' THEN 'weather_query'
         WHEN len(required_agents) = 1 AND required_agents[1] = 'ticket_agent' THEN 'ticket_query'
         WHEN len(required_agents) > 1 THEN 'travel_planning' ELSE 'unknown' END AS intent,
    len(missing_slots) > 0 AS need_clarification,
    CASE WHEN len(missing_slots) > 0
         THEN {q(C.CLARIFY_PREFIX)} || array_to_string(list_transform(missing_slots, lambda s: {labels}), {q(C.LABEL_SEPARATOR)}) || {q(C.CLARIFY_SUFFIX)}
         ELSE '' END AS clarification_question
  FROM {name}_m)"""


# --- queries ----------------------------------------------------------------

TICKET_ORDER_SQL = "departure_time, train_number, seat_type, arrival_time, price, total_seats, remaining_seats"


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["route_day_counts"] = with_ctes(TRIPS, ROUTES, body="SELECT * FROM routes")
    s["reading_keys"] = with_ctes(READINGS, READING_KEYS, body="SELECT * FROM reading_keys")
    s["routes_with_readings"] = with_ctes(TRIPS, ROUTES, READINGS, READING_KEYS, body="""
SELECT r.* FROM routes r WHERE EXISTS (
  SELECT 1 FROM reading_keys k WHERE k.city = r.arrival_city AND k.fx_date = r.travel_date)""")
    s["routes_without_readings"] = with_ctes(TRIPS, ROUTES, READINGS, READING_KEYS, body="""
SELECT r.* FROM routes r WHERE NOT EXISTS (
  SELECT 1 FROM reading_keys k WHERE k.city = r.arrival_city AND k.fx_date = r.travel_date)""")
    s["even_sample"] = with_ctes(TRIPS, ROUTES, f"""numbered AS (
  SELECT *, row_number() OVER (ORDER BY departure_city, arrival_city, travel_date) - 1 AS pos,
         count(*) OVER () AS n FROM routes)""", body=f"""
SELECT CAST(i + 1 AS BIGINT) AS pick, departure_city, arrival_city, travel_date, ticket_count
FROM numbered, range({C.CASE_COUNTS['ticket']}) t(i)
WHERE pos = CAST(round_even(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / CAST({C.CASE_COUNTS['ticket'] - 1} AS DOUBLE)), 0) AS BIGINT)""")
    s["route_day_search"] = with_ctes(TRIPS, REQUESTS, f"""hits AS (
  SELECT r.request_id, r.asked_date, t.*,
         row_number() OVER (PARTITION BY r.request_id ORDER BY {', '.join('t.' + c.strip() for c in TICKET_ORDER_SQL.split(','))}) AS rn
  FROM requests r LEFT JOIN trips t
    ON t.departure_city = r.departure_city AND t.arrival_city = r.arrival_city
   AND CAST(t.departure_time AS DATE) = CAST(r.asked_date AS DATE))""", body=f"""
SELECT request_id, asked_date, CASE WHEN train_number IS NULL THEN NULL ELSE rn END AS rank,
       train_number, seat_type, {iso_ts('departure_time')} AS departure_time,
       {iso_ts('arrival_time')} AS arrival_time, total_seats, remaining_seats,
       CAST(price AS DOUBLE) AS price
FROM hits""")
    first_cte = f"""firsts AS (
  SELECT * FROM (
    SELECT departure_city, arrival_city, CAST(departure_time AS DATE) AS day, t.*  EXCLUDE (departure_city, arrival_city),
           row_number() OVER (PARTITION BY departure_city, arrival_city, CAST(departure_time AS DATE)
                              ORDER BY {TICKET_ORDER_SQL}) AS rn,
           count(*) OVER (PARTITION BY departure_city, arrival_city, CAST(departure_time AS DATE)) AS n
    FROM trips t) WHERE rn = 1),
folded AS (
  SELECT r.request_id, r.asked_date, r.departure_city AS req_dep, r.arrival_city AS req_arr,
         coalesce(f.n, 0) AS ticket_count, f.*
  FROM requests r LEFT JOIN firsts f
    ON f.departure_city = r.departure_city AND f.arrival_city = r.arrival_city
   AND f.day = CAST(r.asked_date AS DATE))"""
    s["first_departure"] = with_ctes(TRIPS, REQUESTS, first_cte, body=f"""
SELECT request_id, asked_date, ticket_count, train_number AS first_train,
       {iso_ts('departure_time')} AS first_departure, CAST(price AS DOUBLE) AS first_price
FROM folded""")
    summary = render(C.TICKET_SUMMARY.replace("{currency}", C.DEFAULT_CURRENCY),
                     departure_city="departure_city", arrival_city="arrival_city", count="ticket_count",
                     train_number="train_number", departure_time=iso_ts("departure_time"),
                     arrival_time=iso_ts("arrival_time"), price="CAST(CAST(price AS DOUBLE) AS VARCHAR)",
                     remaining_seats="remaining_seats")
    s["ticket_summary"] = with_ctes(TRIPS, REQUESTS, first_cte, body=f"""
SELECT request_id, ticket_count,
       CASE WHEN ticket_count > 0 THEN {summary} ELSE {q(C.TICKET_NONE_SUMMARY)} END AS summary
FROM folded""")
    s["reading_lookup"] = with_ctes(READINGS, WEATHER, TRIPS, REQUESTS, body=f"""
SELECT r.request_id, r.arrival_city AS city, r.asked_date AS fx_date,
       CASE WHEN w.city IS NOT NULL THEN 'database' END AS source,
       w.temp_max, w.temp_min, w.text_day, w.text_night, w.wind_speed_day,
       CAST(w.precip AS DOUBLE) AS precip, w.humidity, {iso_ts('w.update_time')} AS update_time
FROM requests r LEFT JOIN weather w ON w.city = r.arrival_city AND w.fx_date = CAST(r.asked_date AS DATE)""")
    s["domain_flags"] = with_ctes(TRIPS, REQUESTS, analysis_ctes("requests"), body="""
SELECT request_id, wants_weather, wants_train, wants_flight, wants_attraction, excludes_weather, excludes_ticket
FROM analysis""")
    s["required_agents"] = with_ctes(TRIPS, REQUESTS, analysis_ctes("requests"), body="""
SELECT request_id, array_to_string(required_agents, ',') AS required_agents, intent FROM analysis""")
    s["normalized_analysis"] = with_ctes(TRIPS, REQUESTS, analysis_ctes("requests"), body="""
SELECT request_id, intent, array_to_string(required_agents, ',') AS required_agents,
       s_city AS slot_city, s_fx_date AS slot_fx_date, s_departure_city AS slot_departure_city,
       s_arrival_city AS slot_arrival_city, s_travel_date AS slot_travel_date,
       array_to_string(missing_slots, ',') AS missing_slots, need_clarification, clarification_question,
       CAST(NULL AS VARCHAR) AS error
FROM analysis""")
    s["missing_slots"] = with_ctes(TRIPS, REQUESTS, analysis_ctes("requests"), body="""
SELECT request_id, array_to_string(missing_slots, ',') AS missing_slots, need_clarification FROM analysis""")
    s["clarification"] = with_ctes(TRIPS, REQUESTS, analysis_ctes("requests"), body="""
SELECT request_id, clarification_question FROM analysis WHERE need_clarification""")
    more_sql(s)
    eval_sql(s)
    logs_sql(s)
    ingest_sql(s)
    stream_sql(s)
    return s


# --- live payloads, tasks, batch --------------------------------------------

def _code_case(col: str) -> str:
    return ("CASE " + col + " " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in C.WEATHER_CODE_TEXT.items())
            + f" ELSE {q(C.UNKNOWN_WEATHER_TEXT)} END")


AS_OF = "2024-01-15"
WINDOW = f"BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL {C.FORECAST_MAX_DAYS} DAY"

LIVE = f"""ev AS (
  SELECT 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS name, CAST(ts AS DATE) AS day, value FROM events),
daily AS (
  SELECT name, day, max(value) AS tmax, min(value) AS tmin,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS psum,
         CAST((count(*) * 7) % 100 AS INTEGER) AS code, max(value) - min(value) AS wind
  FROM ev GROUP BY 1, 2),
live AS (
  SELECT name AS city, strftime(day, '%Y-%m-%d') AS fx_date, tmax AS temp_max, tmin AS temp_min,
         psum AS precip, code AS weather_code, {_code_case('code')} AS text_day,
         CASE WHEN CAST(regexp_extract(name, '(\\d+)$', 1) AS INTEGER) % 5 = 0 THEN NULL ELSE wind END AS wind_speed_day
  FROM daily)"""


def los(name: str, src: str, city: str, date: str) -> str:
    """JON-3 in SQL: ``src`` plus the chosen live or stored row."""
    return f"""{name} AS (
  SELECT r.*,
    CASE WHEN l.city IS NOT NULL THEN 'open-meteo' WHEN w.city IS NOT NULL THEN 'database' END AS source,
    CASE WHEN l.city IS NOT NULL THEN l.city ELSE w.city END AS weather_city,
    CASE WHEN l.city IS NOT NULL THEN l.fx_date ELSE strftime(w.fx_date, '%Y-%m-%d') END AS weather_date,
    CASE WHEN l.city IS NOT NULL THEN CAST(to_json({{'city': l.city, 'fx_date': l.fx_date, 'temp_max': l.temp_max,
      'temp_min': l.temp_min, 'text_day': l.text_day, 'text_night': l.text_day, 'precip': l.precip,
      'wind_speed_day': l.wind_speed_day, 'wind_dir_day': l.wind_speed_day, 'source': 'open-meteo'}}) AS VARCHAR)
    WHEN w.city IS NOT NULL THEN CAST(to_json({{'city': w.city, 'fx_date': strftime(w.fx_date, '%Y-%m-%d'),
      'temp_max': w.temp_max, 'temp_min': w.temp_min, 'text_day': w.text_day, 'text_night': w.text_night,
      'wind_dir_day': NULL, 'wind_scale_day': NULL, 'wind_speed_day': w.wind_speed_day, 'precip': w.precip,
      'uv_index': NULL, 'humidity': w.humidity, 'pressure': NULL, 'vis': NULL, 'cloud': NULL,
      'update_time': {iso_ts('w.update_time')}, 'source': 'database'}}) AS VARCHAR) END AS w_data,
    CASE WHEN l.city IS NOT NULL THEN l.temp_max ELSE CAST(w.temp_max AS DOUBLE) END AS temp_max,
    CASE WHEN l.city IS NOT NULL THEN l.temp_min ELSE CAST(w.temp_min AS DOUBLE) END AS temp_min,
    CASE WHEN l.city IS NOT NULL THEN l.text_day ELSE w.text_day END AS text_day,
    CASE WHEN l.city IS NOT NULL THEN NULL ELSE w.humidity END AS humidity,
    CASE WHEN l.city IS NOT NULL THEN l.precip ELSE CAST(w.precip AS DOUBLE) END AS precip,
    CASE WHEN l.city IS NOT NULL THEN CAST(l.temp_max AS VARCHAR) ELSE CAST(w.temp_max AS VARCHAR) END AS temp_max_text,
    CASE WHEN l.city IS NOT NULL THEN CAST(l.temp_min AS VARCHAR) ELSE CAST(w.temp_min AS VARCHAR) END AS temp_min_text,
    CASE WHEN l.city IS NOT NULL THEN CAST(l.precip AS VARCHAR) ELSE CAST(w.precip AS VARCHAR) END AS precip_text
  FROM {src} r
  LEFT JOIN live l ON l.city = r.{city} AND l.fx_date = strftime(try_strptime(r.{date}, '%Y-%m-%d'), '%Y-%m-%d')
       AND CAST(try_strptime(r.{date}, '%Y-%m-%d') AS DATE) {WINDOW}
  LEFT JOIN weather w ON w.city = r.{city} AND w.fx_date = CAST(try_strptime(r.{date}, '%Y-%m-%d') AS DATE))"""


def weather_summary_sql() -> str:
    d = C.WEATHER_DEFAULTS
    return render(C.WEATHER_SUMMARY,
                  city=f"coalesce(weather_city, {q(d['city'])})", fx_date=f"coalesce(weather_date, {q(d['fx_date'])})",
                  text_day=f"coalesce(text_day, {q(d['text_day'])})",
                  temp_min=f"coalesce(temp_min_text, {q(d['temp_min'])})",
                  temp_max=f"coalesce(temp_max_text, {q(d['temp_max'])})",
                  humidity=f"coalesce(CAST(humidity AS VARCHAR), {q(d['humidity'])})",
                  precip=f"coalesce(precip_text, {q(d['precip'])})")


def ticket_summary_sql() -> str:
    return render(C.TICKET_SUMMARY.replace("{currency}", C.DEFAULT_CURRENCY),
                  departure_city="f_dep", arrival_city="f_arr", count="ticket_count",
                  train_number="train_number", departure_time=iso_ts("departure_time"),
                  arrival_time=iso_ts("arrival_time"), price="CAST(CAST(price AS DOUBLE) AS VARCHAR)",
                  remaining_seats="remaining_seats")


TICKET_JSON = f"""CAST(to_json({{'departure_city': departure_city, 'arrival_city': arrival_city,
             'departure_time': {iso_ts('departure_time')}, 'arrival_time': {iso_ts('arrival_time')},
             'train_number': train_number, 'seat_type': seat_type, 'total_seats': total_seats,
             'remaining_seats': remaining_seats, 'price': CAST(price AS DOUBLE)}}) AS VARCHAR)"""

FIRSTS = f"""lists AS (
  SELECT departure_city AS f_dep, arrival_city AS f_arr, CAST(departure_time AS DATE) AS day, count(*) AS n,
         '[' || string_agg({TICKET_JSON}, ',' ORDER BY {TICKET_ORDER_SQL}) || ']' AS tickets,
         arg_min(t, ({TICKET_ORDER_SQL})) AS f
  FROM trips t GROUP BY 1, 2, 3),
firsts AS (SELECT f_dep, f_arr, day, n, tickets, f.train_number AS train_number, f.departure_time AS departure_time,
                  f.arrival_time AS arrival_time, f.price AS price, f.remaining_seats AS remaining_seats FROM lists)"""

def first_lookup(name: str, src: str, dep: str, arr: str, date: str) -> str:
    return f"""{name} AS (
  SELECT r.*, coalesce(f.n, 0) AS ticket_count, f.tickets, f.f_dep, f.f_arr, f.train_number, f.departure_time,
         f.arrival_time, f.price, f.remaining_seats
  FROM {src} r LEFT JOIN firsts f
    ON f.f_dep = r.{dep} AND f.f_arr = r.{arr} AND f.day = CAST(try_strptime(r.{date}, '%Y-%m-%d') AS DATE))"""


def _first_truthy(cols: list[str]) -> str:
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = f"CASE WHEN coalesce({c} <> '', false) THEN {c} ELSE {out} END"
    return out


TASKS = f"""tshape AS (
  SELECT request_id, route_day, (date_diff('day', DATE '1970-01-01', CAST(route_day AS DATE)) // 7) % 3 AS shape,
         departure_city AS dep, arrival_city AS arr, asked_date AS d
  FROM requests),
tkeys AS (
  SELECT request_id, route_day, shape,
    CASE WHEN shape = 0 THEN dep WHEN shape = 2 THEN '' END AS k_departure_city,
    CASE WHEN shape = 0 THEN arr END AS k_arrival_city,
    CASE WHEN shape IN (0, 2) THEN d END AS k_travel_date,
    CASE WHEN shape IN (0, 1) THEN arr END AS k_city,
    CASE WHEN shape = 0 THEN d END AS k_fx_date,
    CASE WHEN shape = 1 THEN dep END AS k_origin, CASE WHEN shape = 1 THEN arr END AS k_destination,
    CASE WHEN shape = 1 THEN d END AS k_date, CASE WHEN shape = 2 THEN dep END AS k_from,
    CAST(NULL AS VARCHAR) AS k_to, CASE WHEN shape = 2 THEN d END AS k_weather_date
  FROM tshape),
tasks AS (
  SELECT request_id, route_day, shape,
    {_first_truthy(['k_departure_city', 'k_origin', 'k_from'])} AS departure_city,
    {_first_truthy(['k_arrival_city', 'k_destination', 'k_to'])} AS arrival_city,
    {_first_truthy(['k_travel_date', 'k_date'])} AS travel_date,
    k_city AS city,
    {_first_truthy(['k_fx_date', 'k_date', 'k_weather_date'])} AS fx_date
  FROM tkeys)"""


def _missing_sql(cols: list[str]) -> str:
    return ("list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c} <> '', false) THEN {q(c)} END" for c in cols)
            + "], lambda x: x IS NOT NULL)")


MISSING_JSON = """'{"missing_slots":["' || array_to_string(missing, '","') || '"]}'"""


def no_rows(message: str, data: str, **values) -> str:
    """A lookup's answer without rows, as JSON."""
    return f"""'{{"status":"not_found","message":' || to_json({render(message, **values)}) || ',"data":{data}}}'"""


def more_sql(s: dict[str, str]) -> None:
    s["forecast_window"] = with_ctes(LIVE, body=f"""
SELECT city, fx_date, CAST(fx_date AS DATE) {WINDOW} AS in_window FROM live""")
    s["code_text"] = with_ctes(LIVE, body="SELECT city, fx_date, weather_code, text_day, wind_speed_day FROM live")
    s["live_or_stored"] = with_ctes(LIVE, READINGS, WEATHER, """wreq AS (
  SELECT DISTINCT city, fx_date FROM (
    SELECT city, strftime(fx_date, '%Y-%m-%d') AS fx_date FROM readings
    UNION ALL SELECT city, fx_date FROM live))""", los("lw", "wreq", "city", "fx_date"), body="""
SELECT city, fx_date, source, weather_city, weather_date, temp_max, temp_min, text_day, humidity, precip FROM lw""")
    s["first_candidate"] = with_ctes("""names AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)""",
                                     """top AS (
  SELECT * FROM (
    SELECT n.n_name AS query_name, c.c_name AS cand_name, c.c_acctbal AS latitude,
           CAST(c.c_nationkey AS DOUBLE) AS longitude,
           row_number() OVER (PARTITION BY n.n_name ORDER BY c.c_custkey) AS rn
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) WHERE rn = 1)""", body="""
SELECT names.name, cand_name, latitude, longitude FROM names LEFT JOIN top ON top.query_name = names.name""")
    slots_json = ("concat_ws(',', " + ", ".join(
        f"""CASE WHEN m_{n} IS NOT NULL THEN '"{n}":"' || m_{n} || '"' END""" for n in C.SLOT_NAMES) + ")")
    s["model_output_json"] = with_ctes(TRIPS, REQUESTS, body=f"""
SELECT request_id,
  '{{"intent":"' || CASE family WHEN 0 THEN 'ticket_query' WHEN 1 THEN 'weather_query' ELSE 'travel_planning' END
  || '","required_agents":[' || CASE family WHEN 0 THEN '"ticket_agent"' WHEN 1 THEN '"weather_agent"'
                                   ELSE '"weather_agent","ticket_agent"' END
  || '],"slots":{{' || {slots_json} || '}}}}' AS model_json,
  CAST(NULL AS VARCHAR) AS model_error
FROM requests""")
    s["tool_result_triage"] = with_ctes(TRIPS, REQUESTS, FIRSTS, first_lookup("fl", "requests", "departure_city",
                                                                               "arrival_city", "asked_date"), """tt AS (
  SELECT request_id, date_diff('day', DATE '1970-01-01', CAST(route_day AS DATE)) AS e,
         '{"status":"' || CASE WHEN ticket_count > 0 THEN 'success' ELSE 'not_found' END || '","count":'
           || CAST(ticket_count AS VARCHAR) || '}' AS obj, ticket_count
  FROM fl)""", """tx AS (
  SELECT request_id, CASE WHEN e % 5 <= 1 THEN obj WHEN e % 5 = 2 THEN 'Error: tool process exited'
                          WHEN e % 5 = 3 THEN '[' || CAST(ticket_count AS VARCHAR) || ']'
                          ELSE obj || ' (cached)' END AS t
  FROM tt)""", """tr AS (
  SELECT request_id,
    CASE WHEN json_valid(t) THEN (CASE WHEN json_type(t) = 'OBJECT' THEN json_extract_string(t, '$.status')
                                       ELSE 'unknown' END)
         ELSE 'unknown' END AS raw_status
  FROM tx)""", body="""
SELECT request_id, raw_status, CASE WHEN raw_status = 'success' THEN 'success' ELSE 'not_found' END AS status FROM tr""")
    s["landed_forecasts"] = with_ctes(LIVE, body="""
SELECT city, fx_date, temp_max, temp_min, precip, weather_code, wind_speed_day FROM live""")
    s["sql_functions"] = s["model_output_json"]
    s["ticket_tool"] = with_ctes(TRIPS, """least AS (
  SELECT min((departure_city, arrival_city, CAST(departure_time AS DATE))) AS k FROM trips),
asked AS (SELECT t.*, row_number() OVER (ORDER BY """ + TICKET_ORDER_SQL + """) AS "rank" FROM trips t, least
          WHERE (departure_city, arrival_city, CAST(departure_time AS DATE)) = k)""", body=f"""
SELECT "rank", train_number, seat_type, {iso_ts('departure_time')} AS departure_time, {iso_ts('arrival_time')} AS arrival_time,
       total_seats, remaining_seats, CAST(price AS DOUBLE) AS price FROM asked""")
    s["weather_tool"] = with_ctes(LIVE, READINGS, WEATHER, """least AS (
  SELECT min({'city': city, 'fx_date': strftime(fx_date, '%Y-%m-%d')}) AS k FROM weather),
asked AS (SELECT k.city AS city, k.fx_date AS fx_date FROM least)""", los("lw", "asked", "city", "fx_date"), body="""
SELECT city, fx_date, source, weather_city, weather_date, temp_max, temp_min, text_day, humidity, precip FROM lw""")
    s["slot_aliases"] = with_ctes(TRIPS, REQUESTS, TASKS, body="""
SELECT request_id, shape, departure_city, arrival_city, travel_date, city, fx_date FROM tasks""")
    tmiss = _missing_sql(["departure_city", "arrival_city", "travel_date"])
    nf_t = render(C.TICKET_NOT_FOUND_SUMMARY, departure_city="departure_city", arrival_city="arrival_city",
                  travel_date="travel_date")
    s["ticket_tasks"] = with_ctes(TRIPS, REQUESTS, TASKS, FIRSTS, f"""tm AS (SELECT *, {tmiss} AS missing FROM tasks)""",
                                  first_lookup("tl", "tm", "departure_city", "arrival_city", "travel_date"), body=f"""
SELECT request_id, 'ticket_result' AS artifact_type, 'ticket_agent' AS agent,
  CASE WHEN len(missing) > 0 THEN 'failed' WHEN ticket_count = 0 THEN 'not_found' ELSE 'success' END AS status,
  CASE WHEN len(missing) > 0 THEN {q(C.TICKET_MISSING_SUMMARY)} WHEN ticket_count = 0 THEN {nf_t}
       ELSE {ticket_summary_sql()} END AS summary,
  CASE WHEN len(missing) > 0 THEN {MISSING_JSON}
       WHEN ticket_count = 0 THEN {no_rows(C.TICKET_NO_ROWS, '[]', departure_city='departure_city', arrival_city='arrival_city', travel_date='travel_date')}
       ELSE tickets END AS data,
  CASE WHEN len(missing) > 0 THEN 0 ELSE ticket_count END AS ticket_count,
  array_to_string(missing, ',') AS missing
FROM tl""")
    wmiss = _missing_sql(["city", "fx_date"])
    nf_w = render(C.WEATHER_NOT_FOUND_SUMMARY, city="city", fx_date="fx_date")
    s["weather_tasks"] = with_ctes(TRIPS, REQUESTS, TASKS, LIVE, READINGS, WEATHER,
                                   f"""wm AS (SELECT *, {wmiss} AS missing FROM tasks)""",
                                   los("wl", "wm", "city", "fx_date"), body=f"""
SELECT request_id, 'weather_result' AS artifact_type, 'weather_agent' AS agent,
  CASE WHEN len(missing) > 0 THEN 'failed' WHEN source IS NULL THEN 'not_found' ELSE 'success' END AS status,
  CASE WHEN len(missing) > 0 THEN {q(C.WEATHER_MISSING_SUMMARY)} WHEN source IS NULL THEN {nf_w}
       ELSE {weather_summary_sql()} END AS summary,
  CASE WHEN len(missing) > 0 THEN {MISSING_JSON}
       WHEN source IS NULL THEN {no_rows(C.WEATHER_NO_ROW, 'null', city='city', fx_date='fx_date')}
       ELSE w_data END AS data,
  source, array_to_string(missing, ',') AS missing
FROM wl""")
    shown_slots = "concat_ws(',', " + ", ".join(
        f"""'"{n}":"' || a.s_{n} || '"'""" for n in C.SLOT_NAMES) + ")"
    batch = [TRIPS, REQUESTS, analysis_ctes("requests"), LIVE, READINGS, WEATHER, FIRSTS,
             """ready AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(route_day AS DATE)) AS re FROM analysis
                WHERE NOT need_clarification AND len(required_agents) > 0)""",
             """wt AS (SELECT request_id, re, s_city AS city, s_fx_date AS fx_date FROM ready
                WHERE list_contains(required_agents, 'weather_agent'))""",
             los("wl", "wt", "city", "fx_date"),
             """tt AS (SELECT request_id, re, s_departure_city AS dep, s_arrival_city AS arr, s_travel_date AS d FROM ready
                WHERE list_contains(required_agents, 'ticket_agent'))""",
             first_lookup("tl", "tt", "dep", "arr", "d"),
             f"""calls AS (
  SELECT request_id, 0 AS pos, 'weather_agent' AS agent, re % 13 = 0 AS failed,
         CASE WHEN source IS NULL THEN 'not_found' ELSE 'success' END AS status,
         CASE WHEN source IS NULL THEN {render(C.WEATHER_NOT_FOUND_SUMMARY, city='city', fx_date='fx_date')}
              ELSE {weather_summary_sql()} END AS summary,
         CASE WHEN source IS NULL THEN {no_rows(C.WEATHER_NO_ROW, 'null', city='city', fx_date='fx_date')}
              ELSE w_data END AS data
  FROM wl
  UNION ALL
  SELECT request_id, 1, 'ticket_agent', re % 17 = 0,
         CASE WHEN ticket_count = 0 THEN 'not_found' ELSE 'success' END,
         CASE WHEN ticket_count = 0 THEN {render(C.TICKET_NOT_FOUND_SUMMARY, departure_city='dep', arrival_city='arr', travel_date='d')}
              ELSE {ticket_summary_sql()} END,
         CASE WHEN ticket_count = 0
              THEN {no_rows(C.TICKET_NO_ROWS, '[]', departure_city='dep', arrival_city='arr', travel_date='d')}
              ELSE tickets END
  FROM tl)""",
             """per AS (
  SELECT request_id,
    array_to_string(list(agent ORDER BY pos), ',') AS called_agents,
    count(*) FILTER (WHERE NOT failed) AS artifact_count,
    count(*) FILTER (WHERE failed) AS agent_error_count,
    max(status) FILTER (WHERE agent = 'weather_agent' AND NOT failed) AS weather_status,
    max(summary) FILTER (WHERE agent = 'weather_agent' AND NOT failed) AS weather_summary,
    max(status) FILTER (WHERE agent = 'ticket_agent' AND NOT failed) AS ticket_status,
    max(summary) FILTER (WHERE agent = 'ticket_agent' AND NOT failed) AS ticket_summary,
    string_agg(agent || ': TimeoutError(''' || agent || ' call timed out'')', '; ' ORDER BY pos) FILTER (WHERE failed) AS agent_errors,
    string_agg('{"artifact_type":"' || CASE pos WHEN 0 THEN 'weather_result' ELSE 'ticket_result' END || '","agent":"'
      || agent || '","status":"' || status || '","data":' || data || ',"summary":' || to_json(summary)
      || ',"metadata":{"created_at":"2024-01-15T00:00:00"}}', ',' ORDER BY pos) FILTER (WHERE NOT failed) AS arts
  FROM calls GROUP BY request_id)""",
             """batch AS (
  SELECT a.request_id, a.query, a.intent, a.required_agents, a.clarification_question,
    """ + shown_slots + """ AS slots,
    CASE WHEN a.need_clarification THEN 'need_clarification'
         WHEN len(a.required_agents) = 0 THEN 'no_supported_agent'
         WHEN coalesce(p.agent_error_count, 0) > 0 AND coalesce(p.artifact_count, 0) = 0 THEN 'agent_failed'
         WHEN coalesce(p.agent_error_count, 0) > 0 THEN 'partial_success'
         ELSE 'success' END AS status,
    coalesce(p.called_agents, '') AS called_agents, coalesce(p.artifact_count, 0) AS artifact_count,
    coalesce(p.agent_error_count, 0) AS agent_error_count, p.weather_status, p.weather_summary,
    p.ticket_status, p.ticket_summary, p.arts, coalesce(p.agent_errors, '') AS agent_errors
  FROM analysis a LEFT JOIN per p ON p.request_id = a.request_id)"""]
    s["route_batch"] = with_ctes(*batch, body="""
SELECT request_id, intent, status, called_agents, artifact_count, agent_error_count, agent_errors, weather_status,
       weather_summary, ticket_status, ticket_summary, clarification_question FROM batch""")
    s["request_status"] = with_ctes(*batch, body="SELECT status, count(*) AS requests FROM batch GROUP BY status")
    analysis = ("""'{"intent":"' || intent || '","required_agents":["' || array_to_string(required_agents, '","') || '"],"""
                """"slots":{' || slots || '},"missing_slots":[],"need_clarification":false,"clarification_question":""}'""")
    text = render(C.FINAL_PROMPT, query='query', analysis=analysis, artifacts="'[' || arts || ']'")
    prompts = f"""prompts AS (SELECT request_id, {text} AS prompt FROM batch WHERE status IN ('success', 'partial_success'))"""
    s["prompt_rows"] = with_ctes(*batch, prompts, body="""
SELECT request_id, prompt FROM prompts""")
    # a prompt with a ticket list falls into what stands before it, parts of two tickets, and what follows
    parts = f"""lists2 AS (
  SELECT f_dep, f_arr, day, (k - 1) // 2 + 1 AS part_no, string_agg(j, ',' ORDER BY k) AS text FROM (
    SELECT departure_city AS f_dep, arrival_city AS f_arr, CAST(departure_time AS DATE) AS day, {TICKET_JSON} AS j,
           row_number() OVER (PARTITION BY departure_city, arrival_city, CAST(departure_time AS DATE)
                              ORDER BY {TICKET_ORDER_SQL}) AS k FROM trips)
  GROUP BY 1, 2, 3, 4),
cut AS (
  SELECT p.request_id, prompt, dep, arr, CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS day,
         CASE WHEN f.agent = 'ticket_agent' THEN f.tickets END AS tickets
  FROM prompts p LEFT JOIN (SELECT request_id, agent, tickets, dep, arr, d FROM (
      SELECT *, 'ticket_agent' AS agent FROM tl) WHERE ticket_count > 0 AND re % 17 <> 0) f ON p.request_id = f.request_id),
parts AS (
  SELECT request_id, 0 AS part_no,
         CASE WHEN tickets IS NULL THEN prompt ELSE substr(prompt, 1, position(tickets IN prompt)) END AS text FROM cut
  UNION ALL
  SELECT request_id, part_no, CASE WHEN part_no > 1 THEN ',' ELSE '' END || l.text
  FROM cut c JOIN lists2 l ON l.f_dep = c.dep AND l.f_arr = c.arr AND l.day = c.day WHERE tickets IS NOT NULL
  UNION ALL
  SELECT request_id, m.part_no, substr(prompt, position(tickets IN prompt) + length(tickets) - 1)
  FROM cut c JOIN (SELECT f_dep, f_arr, day, max(part_no) + 1 AS part_no FROM lists2 GROUP BY 1, 2, 3) m
    ON m.f_dep = c.dep AND m.f_arr = c.arr AND m.day = c.day WHERE tickets IS NOT NULL)"""
    s["prompt_parts"] = with_ctes(*batch, prompts, parts, body="""
SELECT request_id, part_no, length(text) AS n_chars, sha256(text) AS text_sha256 FROM parts""")
    s["analyzer_prompts"] = with_ctes(TRIPS, REQUESTS, f"""prompts AS (
  SELECT request_id, replace({q(C.ANALYZE_PROMPT)}, '{{query}}', query) AS prompt FROM requests)""", body="""
SELECT request_id, length(prompt) AS n_chars, sha256(prompt) AS prompt_sha256 FROM prompts""")


# --- cases and scoring ----------------------------------------------------------

def even_sql(name: str, src: str, order: str, count: int) -> str:
    step = "0" if count == 1 else f"CAST(round_even(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / CAST({count - 1} AS DOUBLE)), 0) AS BIGINT)"
    return f"""{name} AS (
  SELECT x.* EXCLUDE (pos, n), CAST(i + 1 AS BIGINT) AS pick FROM (
    SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {src}) x,
    range({count}) t(i)
  WHERE pos = {step})"""


ROUTE_ORDER_SQL = "departure_city, arrival_city, travel_date"
USABLE = """usable AS (
  SELECT r.departure_city, r.arrival_city, r.travel_date FROM routes r
  WHERE EXISTS (SELECT 1 FROM reading_keys k WHERE k.city = r.arrival_city AND k.fx_date = r.travel_date))"""
CASE_BASE = [TRIPS, ROUTES, READINGS, READING_KEYS, USABLE]


def _flat(prefix: str, cat: str, pick: str, query: str, intent: str, agents: str, slots: dict, missing: str) -> str:
    cols = ", ".join(f"{slots.get(s, 'CAST(NULL AS VARCHAR)')} AS slot_{s}" for s in C.SLOT_NAMES)
    return (f"SELECT {q(prefix + '_')} || lpad(CAST({pick} AS VARCHAR), 2, '0') AS id, {q(cat)} AS category, "
            f"{query} AS query, {intent} AS intent, {agents} AS required_agents, {cols}, "
            f"{missing} AS missing_slots, ({missing}) <> '' AS need_clarification")


def _pick_tpl(templates, pick="pick"):
    return f"{sql_list(templates)}[(({pick}) - 1) % {len(templates)} + 1]"


def case_sqls() -> dict[str, str]:
    out: dict[str, str] = {}
    w = _flat("weather", "weather", "pick",
              render_col(_pick_tpl(C.WEATHER_TEMPLATES), "city", "fx_date", "''", "''"),
              "'weather_query'", "'weather_agent'", {"city": "city", "fx_date": "fx_date"}, "''")
    out["weather"] = (even_sql("wpick", "reading_keys", "city, fx_date", C.CASE_COUNTS["weather"]), w + " FROM wpick")
    t = _flat("ticket", "ticket", "pick",
              render_col(_pick_tpl(C.TICKET_TEMPLATES), "arrival_city", "travel_date", "departure_city", "arrival_city"),
              "'ticket_query'", "'ticket_agent'",
              {"departure_city": "departure_city", "arrival_city": "arrival_city", "travel_date": "travel_date"}, "''")
    out["ticket"] = (even_sql("tpick", "routes", ROUTE_ORDER_SQL, C.CASE_COUNTS["ticket"]), t + " FROM tpick")
    cb = _flat("combined", "combined", "pick",
               render_col(_pick_tpl(C.COMBINED_TEMPLATES), "arrival_city", "travel_date", "departure_city", "arrival_city"),
               "'travel_planning'", "'weather_agent,ticket_agent'",
               {"departure_city": "departure_city", "arrival_city": "arrival_city", "travel_date": "travel_date",
                "city": "arrival_city", "fx_date": "travel_date"}, "''")
    out["combined"] = (even_sql("cpick", "usable", ROUTE_ORDER_SQL, C.CASE_COUNTS["combined"]), cb + " FROM cpick")
    # missing-slot specs as VALUES
    rows = []
    for i, (tpl, src, idx, intent, agents, kept, missing) in enumerate(C.MISSING_SLOT_SPECS, 1):
        kmap = dict(kv.split("=") for kv in kept)
        fields = ", ".join(q(kmap[s]) if s in kmap else "NULL" for s in C.SLOT_NAMES)
        rows.append(f"({i}, {q(tpl)}, {q(src) if src else 'NULL'}, {idx + 1 if idx is not None else 'NULL'}, "
                    f"{q(intent)}, {q(','.join(agents))}, {fields}, {q(','.join(missing))})")
    spec_cols = "spec, template, src, pick, intent, agents, " + ", ".join(f"k_{s}" for s in C.SLOT_NAMES) + ", missing"
    field = lambda s: (f"CASE k_{s} WHEN 'city' THEN p.city WHEN 'fx_date' THEN p.fx_date "
                       f"WHEN 'departure_city' THEN p.departure_city WHEN 'arrival_city' THEN p.arrival_city "
                       f"WHEN 'travel_date' THEN p.travel_date END")
    m = _flat("missing_slots", "missing_slots", "spec",
              render_col("template", "coalesce(p.city, p.arrival_city)", "coalesce(p.fx_date, p.travel_date)",
                         "p.departure_city", "p.arrival_city"),
              "intent", "agents", {s: field(s) for s in C.SLOT_NAMES}, "missing")
    out["missing"] = (
        even_sql("mw", "reading_keys", "city, fx_date", C.MISSING_SAMPLE_SIZES["w"]) + ",\n"
        + even_sql("mt", "(SELECT departure_city, arrival_city, travel_date FROM routes)", ROUTE_ORDER_SQL,
                   C.MISSING_SAMPLE_SIZES["t"]) + ",\n"
        + f"""mpicks AS (
  SELECT 'w' AS src, pick, city, fx_date, NULL AS departure_city, NULL AS arrival_city, NULL AS travel_date FROM mw
  UNION ALL SELECT 't', pick, NULL, NULL, departure_city, arrival_city, travel_date FROM mt),
mspecs({spec_cols}) AS (VALUES {', '.join(rows)})""",
        m + " FROM mspecs s LEFT JOIN mpicks p ON p.src = s.src AND p.pick = s.pick")
    erows = []
    for i, (tpl, src, idx, intent, agents) in enumerate(C.EDGE_SPECS, 1):
        erows.append(f"({i}, {q(tpl)}, {q(src)}, {idx + 1}, {q(intent)}, {q(','.join(agents))})")
    has = lambda a: f"contains(agents, {q(a)})"
    e = _flat("routing_edge", "routing_edge", "spec",
              render_col("template", "p.arrival_city", "p.travel_date", "p.departure_city", "p.arrival_city"),
              "intent", "agents",
              {"departure_city": f"CASE WHEN {has('ticket_agent')} THEN p.departure_city END",
               "arrival_city": f"CASE WHEN {has('ticket_agent')} THEN p.arrival_city END",
               "travel_date": f"CASE WHEN {has('ticket_agent')} THEN p.travel_date END",
               "city": f"CASE WHEN {has('weather_agent')} THEN p.arrival_city END",
               "fx_date": f"CASE WHEN {has('weather_agent')} THEN p.travel_date END"}, "''")
    out["edge"] = (
        even_sql("er", "(SELECT departure_city, arrival_city, travel_date FROM routes)", ROUTE_ORDER_SQL,
                 C.EDGE_SAMPLE_SIZES["r"]) + ",\n"
        + even_sql("ec", "usable", ROUTE_ORDER_SQL, C.EDGE_SAMPLE_SIZES["c"]) + ",\n"
        + f"""epicks AS (SELECT 'r' AS src, * FROM er UNION ALL SELECT 'c', * FROM ec),
especs(spec, template, src, pick, intent, agents) AS (VALUES {', '.join(erows)})""",
        e + " FROM especs s LEFT JOIN epicks p ON p.src = s.src AND p.pick = s.pick")
    urows = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(C.UNSUPPORTED_QUERIES, 1))
    u = _flat("unsupported", "unsupported", "n", "txt", "'unknown'", "''", {}, "''")
    out["unsupported"] = (f"uspecs(n, txt) AS (VALUES {urows})", u + " FROM uspecs")
    return out


def _all_cases_ctes() -> list[str]:
    cs = case_sqls()
    ctes = list(CASE_BASE)
    for k in ["weather", "ticket", "combined", "missing", "edge", "unsupported"]:
        ctes.append(cs[k][0])
        ctes.append(f"fam_{k} AS ({cs[k][1]})")
    ctes.append("cases AS (" + " UNION ALL ".join(f"SELECT * FROM fam_{k}" for k in
                                                   ["weather", "ticket", "combined", "missing", "unsupported", "edge"]) + ")")
    return ctes


NO_JSON_ERROR = "no JSON object in model output"


def shown(intent: str, agents: str, slot: str, missing: str, need: str) -> str:
    """An analysis as compact JSON; a NULL intent and NULL slots are left out."""
    strings = lambda c: f"""'[' || coalesce(array_to_string(list_transform({c}, lambda x: '"' || x || '"'), ','), '') || ']'"""
    slots = ", ".join(f"""'"{n}":"' || {slot}{n} || '"'""" for n in C.SLOT_NAMES)
    return (f"""'{{' || coalesce('"intent":"' || {intent} || '",', '') || '"required_agents":' || {strings(agents)}"""
            f""" || ',"slots":{{' || concat_ws(',', {slots}) || '}},"missing_slots":' || {strings(missing)}"""
            f""" || ',"need_clarification":' || CAST({need} AS VARCHAR) || '}}'""")


def scored_ctes(run: str = "rules") -> list[str]:
    """Cases -> simulated model answer -> (rules | model_only) -> five checks."""
    ctes = _all_cases_ctes()
    ctes.append("""dmg AS (
  SELECT id, category, query, intent AS e_intent, need_clarification AS e_need,
         """ + ", ".join(f"slot_{s} AS e_{s}" for s in C.SLOT_NAMES) + """,
         (CAST(split_part(id, '_', -1) AS INTEGER) + length(category)) % 6 AS k,
         (CAST(split_part(id, '_', -1) AS INTEGER) + length(category)) % 11 = 0 AS unanswered,
         CASE WHEN required_agents = '' THEN []::VARCHAR[] ELSE string_split(required_agents, ',') END AS exp_agents,
         CASE WHEN missing_slots = '' THEN []::VARCHAR[] ELSE string_split(missing_slots, ',') END AS exp_missing
  FROM cases)""")
    ctes.append("""model AS (
  SELECT *,
    CASE WHEN k = 1 THEN list_transform(exp_agents, lambda a: CASE WHEN a = 'weather_agent' THEN 'ticket_agent'
                                                                   ELSE 'weather_agent' END)
         ELSE exp_agents END AS model_agents,
    """ + ", ".join(f"CASE WHEN k = 2 THEN NULL ELSE e_{s} END AS m_{s}" for s in C.SLOT_NAMES) + """
  FROM dmg)""")
    if run == "rules":
        ctes.append(analysis_ctes("model", "an"))
        ctes.append(f"""pred AS (
  SELECT id,
         CASE WHEN k = 0 THEN NULL ELSE an.intent END AS a_intent,
         CASE WHEN k = 0 THEN []::VARCHAR[] ELSE required_agents END AS a_agents,
         CASE WHEN k = 0 THEN []::VARCHAR[] ELSE an.missing_slots END AS a_missing,
         CASE WHEN k = 0 THEN false ELSE an.need_clarification END AS a_need,
         """ + ", ".join(f"CASE WHEN k = 0 THEN NULL ELSE s_{s} END AS a_{s}" for s in C.SLOT_NAMES) + f""",
         CASE WHEN k = 0 THEN {q(NO_JSON_ERROR)} ELSE '' END AS error, CAST(length(query) * 37 AS BIGINT) AS latency_ms
  FROM an WHERE NOT unanswered)""")
    else:
        ctes.append(f"""pred AS (
  SELECT id,
         CASE WHEN k = 0 THEN NULL ELSE e_intent END AS a_intent,
         CASE WHEN k = 0 THEN []::VARCHAR[] ELSE model_agents END AS a_agents,
         CASE WHEN k = 0 THEN []::VARCHAR[] ELSE exp_missing END AS a_missing,
         CASE WHEN k = 0 THEN false ELSE e_need END AS a_need,
         """ + ", ".join(f"CASE WHEN k = 0 THEN NULL ELSE m_{s} END AS a_{s}" for s in C.SLOT_NAMES) + f""",
         CASE WHEN k = 0 THEN {q(NO_JSON_ERROR)} ELSE '' END AS error, CAST(length(query) * 37 AS BIGINT) AS latency_ms
  FROM model WHERE NOT unanswered)""")
    norm = lambda c: f"CASE WHEN trim({c}) <> '' THEN trim({c}) END"
    rel = {"city": "w", "fx_date": "w", "departure_city": "t", "arrival_city": "t", "travel_date": "t"}
    slot_ok = " AND ".join(
        f"(NOT list_contains(exp_agents, {q('weather_agent' if r == 'w' else 'ticket_agent')}) OR "
        f"{norm('e_' + s)} IS NOT DISTINCT FROM {norm('a_' + s)})" for s, r in rel.items())
    ctes.append(f"""scored AS (
  SELECT id, category, query,
    coalesce(a_intent = e_intent, false) AS intent_ok,
    list_sort(coalesce(a_agents, [])) = list_sort(exp_agents) AS agent_routing_ok,
    {slot_ok} AS slot_exact_ok,
    list_sort(coalesce(a_missing, [])) = list_sort(exp_missing) AS missing_slots_ok,
    coalesce(a_need, false) = coalesce(e_need, false) AS need_clarification_ok,
    coalesce(error, 'no prediction') AS error, latency_ms,
    {shown('e_intent', 'exp_agents', 'e_', 'exp_missing', 'e_need')} AS expected,
    {shown('a_intent', 'coalesce(a_agents, [])', 'a_', 'coalesce(a_missing, [])', 'coalesce(a_need, false)')} AS actual
  FROM dmg LEFT JOIN pred USING (id))""")
    ctes.append("""scored2 AS (
  SELECT *, NOT (intent_ok AND agent_routing_ok AND slot_exact_ok AND missing_slots_ok AND need_clarification_ok)
            OR error <> '' AS failed
  FROM scored)""")
    return ctes


CHECK_METRICS = {"intent": "intent_accuracy", "agent_routing": "agent_routing_accuracy", "slot_exact": "slot_exact_match",
                 "missing_slots": "missing_slot_accuracy", "need_clarification": "need_clarification_accuracy"}


def rates(n: int) -> str:
    """Hits and ratio of the first ``n`` checks."""
    return ", ".join(f"count_if({k}_ok) AS {k}_hits, count_if({k}_ok) / count(*) AS {m}"
                     for k, m in list(CHECK_METRICS.items())[:n])


def eval_sql(s: dict[str, str]) -> None:
    cs = case_sqls()
    for key, fam in [("weather_cases", "weather"), ("ticket_cases", "ticket"), ("combined_cases", "combined"),
                     ("missing_cases", "missing"), ("edge_cases", "edge")]:
        s[key] = with_ctes(*CASE_BASE, cs[fam][0], body=cs[fam][1])
    s["all_cases"] = with_ctes(*_all_cases_ctes(), body="SELECT * FROM cases")
    s["category_counts"] = with_ctes(*_all_cases_ctes(), body="SELECT category, count(*) AS cases FROM cases GROUP BY 1")
    sc = scored_ctes("rules")
    s["case_checks"] = with_ctes(*sc, body="""
SELECT id, category, intent_ok, agent_routing_ok, slot_exact_ok, missing_slots_ok, need_clarification_ok,
       error, failed, latency_ms FROM scored2""")
    s["eval_summary"] = with_ctes(*sc, body=f"""
SELECT count(*) AS case_count, count_if(failed) AS failed_count, {rates(5)},
  coalesce(avg(latency_ms) / 1000.0, 0.0) AS average_latency_seconds
FROM scored2""")
    s["eval_by_category"] = with_ctes(*sc, body=f"""
SELECT category, count(*) AS count, {rates(4)}, coalesce(avg(latency_ms) / 1000.0, 0.0) AS average_latency_seconds
FROM scored2 GROUP BY category""")
    s["eval_failures"] = with_ctes(*sc, body=f"""
SELECT row_number() OVER (ORDER BY list_position({sql_list(list(C.CASE_COUNTS))}, category), category, id) AS position,
  id, category, query, expected, actual, latency_ms,
  array_to_string(list_filter([CASE WHEN NOT intent_ok THEN 'intent' END,
    CASE WHEN NOT agent_routing_ok THEN 'agent_routing' END, CASE WHEN NOT slot_exact_ok THEN 'slot_exact' END,
    CASE WHEN NOT missing_slots_ok THEN 'missing_slots' END,
    CASE WHEN NOT need_clarification_ok THEN 'need_clarification' END], lambda x: x IS NOT NULL), ',') AS failed_checks,
  error
FROM scored2 WHERE failed""")
    s["latency_percentiles"] = with_ctes(*sc, body="""
SELECT category, round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms,
       round(quantile_cont(latency_ms, 0.9), 3) AS p90_ms
FROM scored2 GROUP BY category""")

    def metrics(run):
        return with_ctes(*scored_ctes(run), body=f"""
SELECT count_if(failed) AS failed_count, {rates(5)} FROM scored2""")
    names = list(CHECK_METRICS.values())
    unpivot = lambda alias: " UNION ALL ".join(
        [f"SELECT {q(m)} AS metric, CAST({m} AS DOUBLE) AS v FROM {alias}" for m in names]
        + [f"SELECT 'failed_count', CAST(failed_count AS DOUBLE) FROM {alias}"])
    s["run_comparison"] = (f"WITH mo AS ({metrics('model_only')}), ru AS ({metrics('rules')}), "
                           f"lo AS ({unpivot('mo')}), lr AS ({unpivot('ru')}) "
                           "SELECT lo.metric, lo.v AS model_only, lr.v AS rules, lr.v - lo.v AS difference "
                           "FROM lo JOIN lr ON lo.metric = lr.metric")


# --- logs and dialog ---------------------------------------------------------------

LOGS = f"""logs AS (
  SELECT ts AS time, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level,
    CASE event_type WHEN 'view' THEN 'a2a_call_start' WHEN 'click' THEN 'a2a_call_success'
         WHEN 'error' THEN 'a2a_call_error' WHEN 'purchase' THEN 'timer'
         ELSE CASE event_id % 4 WHEN 3 THEN 'route_need_clarification' WHEN 1 THEN 'route_analysis_done'
                                ELSE 'route_query_done' END END AS event,
    event_id % 8 = 1 AS supported,
    'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS trace_id,
    CASE WHEN event_type IN ('view', 'click', 'error')
         THEN CASE WHEN user_id % 2 = 0 THEN 'weather_agent' ELSE 'ticket_agent' END END AS agent,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN CAST(event_id % 2 + 1 AS INTEGER) END AS attempt,
    value AS elapsed_seconds,
    CASE WHEN event_type = 'purchase' THEN {sql_list(C.TIMER_NAMES)}[event_id % 3 + 1] END AS name,
    CASE WHEN event_type NOT IN ('view', 'click', 'error', 'purchase') AND event_id % 4 NOT IN (1, 3)
         THEN ['success', 'partial_success', 'agent_failed'][event_id % 3 + 1] END AS status,
    CASE WHEN event_type = 'error' THEN 'TimeoutError()' END AS error
  FROM events)"""


def _dialog_ctes(turns: str = "conversations") -> list[str]:
    return [f"""u AS (
  SELECT a.conv_id, a.turn, a.text, CASE WHEN n.role = 'assistant' THEN n.text END AS reply
  FROM {turns} a LEFT JOIN {turns} n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1
  WHERE a.role = 'user')""",
            """u2 AS (SELECT *, coalesce(contains(reply, ' the '), false) AS asks FROM u)""",
            """u3 AS (
  SELECT *, coalesce(lag(asks) OVER (PARTITION BY conv_id ORDER BY turn), false) AS prev_asks,
         lag(reply) OVER (PARTITION BY conv_id ORDER BY turn) AS question
  FROM u2)""",
            """u4 AS (
  SELECT *, CAST(sum(CASE WHEN prev_asks THEN 0 ELSE 1 END)
                 OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode
  FROM u3)"""]


def logs_sql(s: dict[str, str]) -> None:
    s["log_read"] = with_ctes(LOGS, body="""
SELECT strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS time, level, event, trace_id, agent, attempt, elapsed_seconds,
       name, status, error FROM logs""")
    cols = ", ".join(
        f"CAST(sum(CAST(elapsed_seconds AS DECIMAL(18,3))) FILTER (WHERE name = {q(n)}) AS DOUBLE) AS {a}"
        for n, a in zip(C.TIMER_NAMES, ["analyze_seconds", "agents_seconds", "answer_seconds"]))
    s["stage_seconds"] = with_ctes(LOGS, body=f"""
SELECT trace_id, {cols} FROM logs WHERE event = 'timer' AND trace_id IS NOT NULL GROUP BY trace_id""")
    s["call_attempts"] = with_ctes(LOGS, """calls AS (
  SELECT * FROM logs WHERE event IN ('a2a_call_start', 'llm_call_start', 'a2a_call_success', 'llm_call_success',
                                     'a2a_call_error', 'llm_call_error'))""", """lastev AS (
  SELECT trace_id, agent, event FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, agent ORDER BY attempt DESC, time DESC, event DESC) AS rn
    FROM calls) WHERE rn = 1)""", body="""
SELECT c.trace_id, c.agent, count_if(c.event IN ('a2a_call_start', 'llm_call_start')) AS starts,
       count_if(c.event IN ('a2a_call_error', 'llm_call_error')) AS errors, max(c.attempt) AS attempts,
       any_value(l.event) AS last_event
FROM calls c JOIN lastev l ON l.trace_id = c.trace_id AND l.agent IS NOT DISTINCT FROM c.agent
GROUP BY c.trace_id, c.agent""")
    s["open_attempts"] = with_ctes(LOGS, body="""
SELECT s.trace_id, s.agent, s.attempt, strftime(s.time, '%Y-%m-%dT%H:%M:%S.%f') AS time
FROM logs s WHERE s.event IN ('a2a_call_start', 'llm_call_start') AND NOT EXISTS (
  SELECT 1 FROM logs e WHERE e.event IN ('a2a_call_success', 'llm_call_success', 'a2a_call_error', 'llm_call_error')
    AND e.trace_id = s.trace_id AND e.agent = s.agent AND e.attempt = s.attempt)""")
    s["trace_outcome"] = with_ctes(LOGS, """done AS (
  SELECT trace_id, status FROM (
    SELECT trace_id, status, row_number() OVER (PARTITION BY trace_id ORDER BY time DESC, status DESC) AS rn
    FROM logs WHERE event = 'route_query_done') WHERE rn = 1)""", """g AS (
  SELECT trace_id, bool_or(event = 'route_need_clarification') AS clar, count(*) AS events
  FROM logs WHERE trace_id IS NOT NULL GROUP BY trace_id)""", """an AS (
  SELECT trace_id, arg_max(supported, (time, supported)) AS supported FROM logs WHERE event = 'route_analysis_done' GROUP BY 1)""", body="""
SELECT g.trace_id, coalesce(d.status, CASE WHEN g.clar THEN 'need_clarification' END,
                            CASE WHEN NOT an.supported THEN 'no_supported_agent' END, 'open') AS outcome, g.events
FROM g LEFT JOIN done d ON d.trace_id = g.trace_id LEFT JOIN an ON an.trace_id = g.trace_id""")
    web = render(C.FOLLOWUP_WEB, original="original", question="coalesce(question, '')", reply="text")
    latest = lambda turns, *more: with_ctes(*more, *_dialog_ctes(turns), """u5 AS (
  SELECT *, first_value(text) OVER (PARTITION BY conv_id, episode ORDER BY turn) AS original FROM u4)""", body=f"""
SELECT conv_id, turn, episode, prev_asks AS follow_up, CASE WHEN prev_asks THEN {web} ELSE text END AS query_sent
FROM u5""")  # noqa: E731
    s["followup_latest"] = latest("conversations")
    s["stream_dialog_gaps"] = latest("gappy", "gappy AS (SELECT * FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1))")
    cli = render(C.FOLLOWUP_CLI, original="acc", reply="x")
    s["followup_nested"] = with_ctes(*_dialog_ctes(), """u5 AS (
  SELECT *, list(text) OVER (PARTITION BY conv_id, episode ORDER BY turn
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS texts FROM u4)""", body=f"""
SELECT conv_id, turn, episode, prev_asks AS follow_up,
       list_reduce(texts, lambda acc, x: {cli}) AS query_sent
FROM u5""")


# --- ingest -------------------------------------------------------------------------

FEED = """feed AS (
  SELECT departure_city, arrival_city, departure_time, arrival_time,
         train_number || '-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS tn,
         CASE WHEN l_linenumber = 4 THEN seat_type || chr(10) || '"a,b"' || chr(10) || 'c' ELSE seat_type END AS seat_type,
         total_seats, remaining_seats, price, l_linenumber AS ln
  FROM trips)""", """newf AS (
  SELECT *, CASE WHEN ln = 7 THEN 'missing train_number'
                 WHEN ln = 6 AND seat_type = 'R' THEN 'bad departure_time'
                 WHEN ln = 5 AND seat_type = 'N' THEN 'too long seat_type' END AS reason
  FROM feed WHERE ln >= 3)""", """oldf AS (SELECT * REPLACE (total_seats AS remaining_seats) FROM feed WHERE ln <= 4)""", \
"""merged AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY departure_time, tn ORDER BY src DESC) AS rn FROM (
      SELECT departure_city, arrival_city, departure_time, tn, seat_type, total_seats, remaining_seats, price, 0 AS src
      FROM oldf
      UNION ALL
      SELECT departure_city, arrival_city, departure_time, tn, seat_type, total_seats, remaining_seats, price, 1
      FROM newf WHERE reason IS NULL)) WHERE rn = 1)"""

# the weather drops, their cities equal as the table's collation has it
WEATHER_FILES = """wold AS (
  SELECT *, city AS spelt FROM (SELECT *, row_number() OVER (PARTITION BY city, fx_date ORDER BY seq DESC) AS rn
                                FROM readings WHERE seq % 3 <> 0) WHERE rn = 1)""", """wnew AS (
  SELECT *, replace(lower(city), 'a', 'á') AS spelt, humidity % 10 = 3 AS bad
  FROM (SELECT *, row_number() OVER (PARTITION BY city, fx_date ORDER BY seq DESC) AS rn
        FROM readings WHERE seq % 3 <> 1) WHERE rn = 1)""", """wmerged AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strip_accents(lower(spelt)), fx_date ORDER BY src DESC) AS k FROM (
      SELECT * EXCLUDE (rn), 0 AS src FROM wold UNION ALL SELECT * EXCLUDE (rn, bad), 1 FROM wnew WHERE NOT bad)) WHERE k = 1)"""

TICKET_REPORT = """strftime(departure_time, '%Y-%m-%d') AS departure_day,
  strftime(departure_time, '%Y-%m-%d %H:%M:%S') AS departure_time, tn AS train_number, departure_city, arrival_city,
  seat_type, total_seats, remaining_seats, CAST(price AS DOUBLE) AS price"""


def ingest_sql(s: dict[str, str]) -> None:
    base = [TRIPS, *FEED]
    s["newest_snapshot"] = with_ctes(*base, body="""
SELECT 'train_tickets' AS "table", 'train_tickets_20240102.csv' AS file, count(*) AS csv_rows FROM newf""")
    s["csv_contract"] = with_ctes(*base, body=f"SELECT {TICKET_REPORT} FROM newf WHERE reason IS NULL")
    s["rejected_rows"] = with_ctes(*base, body="""
SELECT departure_city, arrival_city,
  CASE WHEN reason = 'bad departure_time' THEN 'not-a-date' ELSE strftime(departure_time, '%Y-%m-%d %H:%M:%S') END
    AS departure_time,
  CASE WHEN reason = 'missing train_number' THEN NULL ELSE tn END AS train_number,
  CASE WHEN reason = 'too long seat_type' THEN repeat('X', 25) ELSE seat_type END AS seat_type, reason
FROM newf WHERE reason IS NOT NULL""")
    s["upsert"] = with_ctes(*base, body=f"SELECT {TICKET_REPORT} FROM merged")
    s["weather_upsert"] = with_ctes(READINGS, *WEATHER_FILES, body=f"""
SELECT spelt AS city, strftime(fx_date, '%Y-%m-%d') AS fx_date, temp_max, temp_min, text_day, text_night, wind_speed_day,
       CAST(precip AS DOUBLE) AS precip, humidity, {iso_ts('update_time')} AS update_time FROM wmerged""")
    s["load_report"] = with_ctes(*base, READINGS, *WEATHER_FILES, body="""
SELECT 'train_tickets' AS "table", 'train_tickets_20240102.csv' AS file,
  (SELECT count(*) FROM newf) AS csv_rows, (SELECT count(*) FROM newf WHERE reason IS NOT NULL) AS rejected,
  (SELECT count(*) FROM oldf) AS before, (SELECT count(*) FROM merged) AS after,
  (SELECT count(*) FROM merged) - (SELECT count(*) FROM oldf) AS inserted,
  (SELECT count(*) FROM newf n WHERE reason IS NULL AND EXISTS (
     SELECT 1 FROM oldf o WHERE o.departure_time = n.departure_time AND o.tn = n.tn)) AS updated
UNION ALL
SELECT 'weather_data', 'weather_data_20240102.csv', (SELECT count(*) FROM wnew), (SELECT count(*) FROM wnew WHERE bad),
  (SELECT count(*) FROM wold), (SELECT count(*) FROM wmerged), (SELECT count(*) FROM wmerged) - (SELECT count(*) FROM wold),
  (SELECT count(*) FROM wnew n WHERE NOT bad AND EXISTS (SELECT 1 FROM wold o WHERE o.city = n.city AND o.fx_date = n.fx_date))""")
    s["collated_first_departure"] = f"SELECT request_id, ticket_count, first_train FROM ({s['first_departure']})"
    s["collated_reading"] = f"SELECT request_id, source, temp_max, humidity FROM ({s['reading_lookup']})"
    s["case_files"] = s["all_cases"]
    run = lambda label, mode: with_ctes(*scored_ctes(mode), body=f"""
SELECT '{label}' AS run_label, count(*) AS case_count, count_if(failed) AS failed_count, count(*) AS results FROM scored2""")  # noqa: E731
    s["run_files"] = f"SELECT * FROM ({run('baseline', 'model_only')}) UNION ALL SELECT * FROM ({run('rules', 'rules')})"
    s["published_tables"] = with_ctes(*base, READINGS, *WEATHER_FILES, body="""
SELECT 'train_tickets' AS "table", count(*) AS rows FROM merged
UNION ALL SELECT 'weather_data', count(*) FROM wmerged""")
    s["table_counts"] = with_ctes(*base, READINGS, WEATHER, body="""
SELECT 'train_tickets' AS "table", count(*) AS rows FROM merged
UNION ALL SELECT 'weather_data', count(*) FROM weather""")


# --- streams (batch SQL over the same rows) -------------------------------------------

def stream_sql(s: dict[str, str]) -> None:
    waves = """mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS wm FROM events WHERE event_id % 10 <> 0)""", \
        """counted AS (
  SELECT time_bucket(INTERVAL 1 minute, ts) AS w, event_type FROM events, mark
  WHERE event_id % 10 <> 0 OR time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 MINUTE > wm)"""
    s["stream_tumbling"] = with_ctes(*waves, body="""
SELECT strftime(w, '%Y-%m-%dT%H:%M:%S') AS window_start, count(*) AS events, count_if(event_type = 'error') AS errors
FROM counted GROUP BY 1""")
    s["stream_late"] = with_ctes(*waves, body="""
SELECT (SELECT count(*) FROM events) AS landed, (SELECT count(*) FROM counted) AS counted,
       (SELECT count(*) FROM events) - (SELECT count(*) FROM counted) AS dropped""")
    s["stream_sliding"] = with_ctes(LOGS, """sl AS (
  SELECT time_bucket(INTERVAL 1 minute, time) - to_minutes(CAST(i AS BIGINT)) AS ws, name, elapsed_seconds
  FROM logs, range(10) r(i) WHERE event = 'timer')""", body="""
SELECT strftime(ws, '%Y-%m-%dT%H:%M:%S') AS window_start, name, count(*) AS timers,
       CAST(sum(CAST(elapsed_seconds AS DECIMAL(18,3))) AS DOUBLE) AS total_seconds,
       CAST(sum(CAST(elapsed_seconds AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS mean_seconds
FROM sl GROUP BY ws, name""")
    s["stream_sessions"] = with_ctes(LOGS, """lg AS (
  SELECT trace_id, time,
    CASE WHEN lag(time) OVER (PARTITION BY trace_id ORDER BY time) IS NULL
           OR time - lag(time) OVER (PARTITION BY trace_id ORDER BY time) >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS new
  FROM logs WHERE trace_id IS NOT NULL)""", """sg AS (
  SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS sid FROM lg)""", body="""
SELECT trace_id, strftime(min(time), '%Y-%m-%dT%H:%M:%S.%f') AS session_start,
       strftime(max(time) + INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') AS session_end, count(*) AS events
FROM sg GROUP BY trace_id, sid""")
    s["stream_dedupe"] = with_ctes(LOGS, body="""
SELECT DISTINCT trace_id, strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS time, event FROM logs""")
    s["stream_dialog"] = s["followup_latest"]
    s["stream_upsert"] = s["upsert"]
