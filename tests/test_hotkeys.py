"""Left joins with hot keys: same rows as a plain join, hot rows in many tasks."""

import random

from pyspark.sql import functions as F

from wayfare.operators.hotkeys import hot_keys, left_join


def frames(spark, n=4000):
    r = random.Random(7)
    rows = []
    for i in range(n):
        city = "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"c{r.randint(0, 400)}"
        rows.append((i, city, r.randint(1, 1) if city == "hot" else r.randint(1, 4), {"k": str(i)}))
    left = spark.createDataFrame(rows, "id long, city string, day int, slots map<string,string>")
    right = spark.createDataFrame([(c, d, f"{c}-{d}") for c in ["hot", *(f"c{k}" for k in range(0, 400, 2))] for d in (1, 2)]
                                  + [(None, 1, "never")], "rcity string, rday int, text string")
    return left, right


def test_equals_a_plain_left_join(spark):
    left, right = frames(spark)
    got = left_join(left, right, {"city": "rcity", "day": "rday"}, salts=16)
    assert got.columns == ["id", "city", "day", "slots", "text"]
    want = left.join(right, (left.city == right.rcity) & (left.day == right.rday), "left").select("id", "city", "day", "text")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.drop("slots").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    empty = left_join(left.limit(0), right, {"city": "rcity", "day": "rday"})
    assert empty.count() == 0 and left_join(left, right.limit(0), {"city": "rcity", "day": "rday"}).count() == left.count()


def test_a_third_of_the_rows_on_one_key_goes_to_many_tasks(spark):
    left, right = frames(spark)
    assert len(hot_keys(left, ["city", "day"], 16)) == 1
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for salts, least in ((1, 1), (16, 6)):
            got = left_join(left, right, {"city": "rcity", "day": "rday"}, salts=salts)
            tasks = got.where("city = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
            nulls = got.where("city is null").select(F.spark_partition_id().alias("p")).distinct().count()
            assert len(tasks) >= least and nulls >= least and sum(t["count"] for t in tasks) == left.where("city = 'hot'").count()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
