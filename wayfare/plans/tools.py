"""Parameterized table tools (UDF-1..3): one request at a time, as DataFrame
functions over the batch operators and as parameterized SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators import lookup as L


def query_train_tickets(spark: SparkSession, tickets: DataFrame, departure_city: str, arrival_city: str,
                        travel_date: str) -> DataFrame:
    """UDF-2: tickets of one route and day, in departure order. The literals
    filter the tickets on the scan (the day as a range of departure times)
    before anything is ranked; a day that isn't ``yyyy-MM-dd`` has none."""
    day = X.strict_date(F.lit(travel_date))
    start = day.cast("timestamp_ntz")
    asked = tickets.where((F.col("departure_city") == departure_city) & (F.col("arrival_city") == arrival_city)
                          & (F.col("departure_time") >= start)
                          & (F.col("departure_time") < F.date_add(day, 1).cast("timestamp_ntz")))
    # one route's day is what the caller gets back: its window is the answer's size
    ranked = asked.withColumn("rank", F.row_number().over(
        Window.partitionBy("departure_city", "arrival_city").orderBy(*L.TICKET_ORDER)).cast("long"))
    return ranked.select("rank", *[c for c in C.TICKET_SEARCH_COLUMNS if c not in ("departure_city", "arrival_city")])


def query_train_tickets_sql(spark: SparkSession, view: str, departure_city: str, arrival_city: str,
                            travel_date: str) -> DataFrame:
    """UDF-2, SQL form with bound parameters (no string splicing)."""
    cols = ", ".join(C.TICKET_SEARCH_COLUMNS)
    return spark.sql(
        f"SELECT {cols} FROM {view} WHERE departure_city = :dep AND arrival_city = :arr "
        "AND to_date(departure_time) = try_to_date(:d, 'yyyy-MM-dd') ORDER BY departure_time, train_number, seat_type",
        args={"dep": departure_city, "arr": arrival_city, "d": travel_date})


def query_weather(spark: SparkSession, live: DataFrame, weather: DataFrame, city: str, fx_date: str,
                  as_of: str, live_enabled: bool = True) -> DataFrame:
    """UDF-3: live row if in the window, else the stored row, else no row.
    The literals filter both tables on their scans."""
    day = X.strict_date(F.lit(fx_date))
    stored = weather.where((F.col("city") == city) & (F.col("fx_date") == day))
    fresh = live.where((F.col("city") == city) & (F.col("fx_date") == fx_date))
    out = L.weather_by_day(fresh, stored, as_of, live_enabled).drop("__city", "__wday")
    return out.select(F.lit(city).alias("city"), F.lit(fx_date).alias("fx_date"), "*")


def register_sql_functions(spark: SparkSession) -> None:
    """UDF-1 for SQL users: ``extract_model_json(text)`` and ``triage_tool_text(text)``."""
    from wayfare.functions import modeltext as M
    spark.udf.register("extract_model_json", M._extract_batch)
    spark.udf.register("triage_tool_text", M._triage_batch)
