"""SNK-1..3 and SRC-1..3: upsert, contract read, publish."""

import datetime as dt
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.operators.load import (create_if_absent, expire, ingest, latest_version, manifest, publish, read_published,
                                    upsert, upsert_published)
from wayfare.sources.files import accepted, newest_snapshot, read_contract, rejected

HEADER = ",".join(["id", *C.TICKET_COLUMNS, "extra"])


def _csv(folder, name, lines, bom=False, header=HEADER):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(header + "\n" + "\n".join(lines) + "\n")
    return path


ROW = '1,富山,東京,2026-06-20 09:21:00,2026-06-20 11:30:00,Kagayaki 508,Ordinary,100,42,12760.00,,x'


def test_contract_read_edges(spark):
    d = tempfile.mkdtemp(prefix="wayfare-csv-")
    lines = [
        ROW,
        '2,　富山  ,東京,2026-06-20 10:33:00,2026-06-20 12:40:00,Hakutaka 560,Ordinary,100,86,12100.00,,x',
        '3,富山,東京,2026-06-20 14:21:00,2026-06-20 16:40:00,,Ordinary,100,65,12100.00,,x',
        '4,富山,東京,2026-6-20 14:21,2026-06-20 16:40:00,X1,Ordinary,100,65,12100.00,,x',
        '5,富山,東京,2026-06-20 15:00:00,2026-06-20 16:40:00,' + "Y" * 21 + ',Ordinary,100,65,1.00,,x',
    ]
    path = _csv(d, "train_tickets_20260101.csv", lines, bom=True)
    df = read_contract(spark, path, "train_tickets")
    ok = {r.train_number: r for r in accepted(df).collect()}
    bad = sorted(r["__reason"] for r in rejected(df).collect())
    assert set(ok) == {"Kagayaki 508", "Hakutaka 560"}
    assert ok["Hakutaka 560"].departure_city == "富山"
    assert str(ok["Kagayaki 508"].price) == "12760.00"
    assert bad == ["bad departure_time", "missing train_number", "too long train_number"]


def test_missing_column_raises(spark):
    d = tempfile.mkdtemp(prefix="wayfare-csv-")
    path = _csv(d, "train_tickets_x.csv", ["1,a"], header="id,departure_city")
    with pytest.raises(ValueError, match="missing columns"):
        read_contract(spark, path, "train_tickets")


def test_newest_snapshot_is_lexicographic(spark):
    d = tempfile.mkdtemp(prefix="wayfare-csv-")
    _csv(d, "train_tickets_20260102.csv", [ROW])
    _csv(d, "train_tickets_20260101.csv", [ROW])
    assert newest_snapshot(spark, d, "train_tickets_*.csv").endswith("train_tickets_20260102.csv")
    assert newest_snapshot(spark, d, "weather_data_*.csv", required=False) is None
    with pytest.raises(FileNotFoundError):
        newest_snapshot(spark, d, "weather_data_*.csv")


def test_upsert_replaces_all_columns_and_is_idempotent(spark):
    schema = "k string, v string, n int, o long"
    old = spark.createDataFrame([("a", "x", 1, 0), ("b", "y", 2, 0)], schema).drop("o")
    new = spark.createDataFrame([("a", None, 5, 1), ("a", "z", 6, 2), ("c", "w", 7, 3)], schema)
    once = upsert(old, new, ["k"], ["o"])
    got = sorted(tuple(r) for r in once.collect())
    assert got == [("a", "z", 6), ("b", "y", 2), ("c", "w", 7)]
    twice = upsert(once, new, ["k"], ["o"])
    assert sorted(tuple(r) for r in twice.collect()) == got
    null_wins = upsert(old, new.filter("o = 1"), ["k"], ["o"])
    assert sorted(tuple(r) for r in null_wins.collect())[0] == ("a", None, 5)


def test_publish_follows_manifest(spark):
    root = tempfile.mkdtemp(prefix="wayfare-pub-")
    assert latest_version(spark, root) is None
    publish(spark, {"t": spark.range(3)}, root)
    v2 = publish(spark, {"t": spark.range(5)}, root)
    assert latest_version(spark, root) == v2
    assert read_published(spark, root, "t").count() == 5


def test_quoted_csv_cells(spark, tmp_path):
    from wayfare.sources.files import read_contract
    cells = ["departure_city", "arrival_city", "departure_time", "arrival_time", "train_number", "seat_type", "total_seats",
             "remaining_seats", "price", "created_at"]
    row = ['"A, ""x"""', '"B\nC"', "2026-06-20 09:21:00", "2026-06-20 11:00:00", '"K ""508"""', "s", "10", "5", "12.50", ""]
    (tmp_path / "t.csv").write_text(",".join(cells) + "\n" + ",".join(row) + "\n", encoding="utf-8")
    got = read_contract(spark, str(tmp_path / "t.csv"), "train_tickets").collect()
    assert [(r.departure_city, r.arrival_city, r.train_number) for r in got] == [('A, "x"', "B\nC", 'K "508"')]


def test_ingest_reads_both_contracts(spark):
    d = tempfile.mkdtemp(prefix="wayfare-csv-")
    _csv(d, "train_tickets_20260101.csv", [ROW])
    header = ",".join(C.WEATHER_COLUMNS)

    def day(**cells):
        return ",".join(str(cells.get(c, "")) for c in C.WEATHER_COLUMNS)

    _csv(d, "weather_data_20251231.csv", [day(city="old", fx_date="2026-06-20")], header=header)
    _csv(d, "weather_data_20260101.csv", [
        day(city="東京", fx_date="2026-06-20", temp_max=20, precip="0.5", update_time="2026-06-19 08:00:00"),
        day(city="東京 ", fx_date="2026-06-20", temp_max=25, sunrise="04:25:00"), day(city="富山", fx_date="2026-06-21", humidity=60),
        day(city="富山", fx_date="2026-6-2x"), day(fx_date="2026-06-20"), day(city="富山", fx_date="2026-06-22", temp_max="warm")],
        bom=True, header=header)
    root = tempfile.mkdtemp(prefix="wayfare-pub-")
    first = {r.table: tuple(r) for r in ingest(spark, d, root).collect()}
    assert first["train_tickets"] == ("train_tickets", "train_tickets_20260101.csv", 1, 0, 0, 1, 1, 0)
    assert first["weather_data"] == ("weather_data", "weather_data_20260101.csv", 6, 3, 0, 2, 2, 0)
    assert latest_version(spark, root) and manifest(spark, root)["seq"] == 1  # both tables, one version
    weather = read_published(spark, root, "weather_data")
    assert sorted((r.city, str(r.fx_date), r.temp_max, r.sunrise, r.precip, r.humidity) for r in weather.collect()) == [
        ("富山", "2026-06-21", None, None, None, 60), ("東京", "2026-06-20", 25, "04:25:00", None, None)]
    again = {r.table: tuple(r) for r in ingest(spark, d, root).collect()}
    assert again["weather_data"][4:] == (2, 2, 0, 2)
    with pytest.raises(FileNotFoundError):
        ingest(spark, tempfile.mkdtemp(prefix="wayfare-csv-"), root)


def test_upsert_under_a_collation(spark):
    schema = "city string, day int, v string, o int"
    old = spark.createDataFrame([("Genève", 1, "old", 0), ("Ulm", 1, "old", 0)], schema).drop("o")
    new = spark.createDataFrame([("GENEVE  ", 1, "new", 1), ("ulm", 2, "new", 2)], schema)
    got = upsert(old, new, ["city", "day"], ["o"], "UNICODE_CI_AI_RTRIM")
    assert sorted(map(tuple, got.collect())) == [("GENEVE  ", 1, "new"), ("Ulm", 1, "old"), ("ulm", 2, "new")]
    assert upsert(old, new, ["city", "day"], ["o"]).count() == 4


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, part string, v string")


def files_of(root, seq_manifest):
    out = {}
    for folder in seq_manifest["tables"]["t"].values():
        for f in sorted(os.listdir(f"{root}/{folder}")):
            path = f"{root}/{folder}/{f}"
            out[path] = (open(path, "rb").read(), os.stat(path).st_mtime_ns)
    return out


def put(spark, root, rows, **more):
    return upsert_published(spark, root, {"t": table(spark, rows)}, keys={"t": ["k", "part"]}, parts={"t": F.col("part")}, **more)


def test_a_small_drop_leaves_other_files_untouched(spark):
    root = tempfile.mkdtemp(prefix="wayfare-cow-")
    put(spark, root, [(k, f"p{k % 50}" if k % 50 else None, "old") for k in range(5000)])
    before = files_of(root, manifest(spark, root))
    put(spark, root, [(k, f"p{k % 50}" if k % 50 else None, "new") for k in range(0, 5000, 50)] + [(9999, "p/x=1", "new")])  # 2 % of the keys
    after = files_of(root, manifest(spark, root))
    assert len(set(before) & set(after)) >= len(before) - 2 and all(after[p] == before[p] for p in set(before) & set(after))
    rows = {(r.k, r.part): r.v for r in read_published(spark, root, "t").collect()}
    assert len(rows) == 5001 and rows[(50, None)] == "new" and rows[(51, "p1")] == "old" and rows[(9999, "p/x=1")] == "new"
    put(spark, root, [(9999, "p/x=1", "newer")])
    assert read_published(spark, root, "t").where("k = 9999").collect()[0].v == "newer" and read_published(spark, root, "t").count() == 5001
    put(spark, root, [])
    assert read_published(spark, root, "t").count() == 5001


def test_writers_at_once_lose_nothing(spark):
    root = tempfile.mkdtemp(prefix="wayfare-race-")
    publish(spark, {"t": table(spark, [(0, "a", "first")])}, root, {"t": lambda: F.col("part")})
    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(put, spark, root, [(k, "a", f"w{k}"), (100 + k, f"b{k}", f"w{k}")]) for k in range(1, 7)]
        jobs.append(pool.submit(publish, spark, {"u": spark.range(3)}, root))
        versions = {j.result() for j in jobs}
    assert len(versions) == 7 and manifest(spark, root)["seq"] == 8
    got = {r.k: r.v for r in read_published(spark, root, "t").collect()}
    assert got == {0: "first", **{k: f"w{k}" for k in range(1, 7)}, **{100 + k: f"w{k}" for k in range(1, 7)}}
    assert read_published(spark, root, "u").count() == 3
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: create_if_absent(spark, f"{root}/one", str(k)), range(16)))
    assert sum(won) == 1 and open(f"{root}/one").read() == str(won.index(True))
    assert sorted(os.listdir(root)) == sorted(["_manifests", "one", *(f for f in os.listdir(root) if f.startswith("v="))])  # no drafts


def test_stamped_versions_expire_and_replays_are_harmless(spark):
    root = tempfile.mkdtemp(prefix="wayfare-exp-")
    sizes = []
    for batch in range(20):
        put(spark, root, [(k, f"p{batch % 3}", f"b{batch}") for k in range(20)], stamp={"batch": batch})
        assert put(spark, root, [(0, "p0", "replayed")], stamp={"batch": batch}) is None
        expire(spark, root, keep=2)
        sizes.append(sum(len(f) for _, _, f in os.walk(root)))
    assert max(sizes[5:]) <= max(sizes[:5]) + 4 and len(os.listdir(f"{root}/_manifests")) <= 2 * 3
    rows = read_published(spark, root, "t")
    assert rows.count() == 60 and {r.v for r in rows.select("v").distinct().collect()} == {"b17", "b18", "b19"}


def test_plain_keys_of_a_collation(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from wayfare.functions import text as X
    r = random.Random(1)
    signs = [chr(c) for c in range(32, 127)]
    words = ["", " ", *signs, *(s + " " for s in signs), *("".join(r.choice("aAáÀbB1- é") for _ in range(3)) for _ in range(300)),
             "ﬀ", "ff", "Ａ", "ß", "ss", "SS ", "日", "日  ", None]
    for some in (words, [w for w in words if w is None or w.isascii()]):
        df = spark.createDataFrame([(w,) for w in some], "w string")
        per = X.collated_keys(df, ["w"], ["k"]).withColumn("same", F.collate("w", X.COLLATION))
        got = per.groupBy("same").agg(F.count_distinct("k").alias("n")).agg(F.max("n"), F.count("*")).first()
        assert per.count() == len(some) and got[0] == 1
        assert per.select("k").distinct().count() == got[1]
    pairs = spark.createDataFrame(list(itertools.product(signs, signs)), "a string, b string").where("a <> ' ' and b <> ' '")
    assert pairs.where((F.collate("a", X.COLLATION) == F.collate("b", X.COLLATION)) != (F.lower("a") == F.lower("b"))).count() == 0


@pytest.fixture
def one_order(spark, tmp_path):
    """An order of seven lines."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    day = dt.datetime(2024, 1, 16)
    put("nation", [(k, f"NATION_{k}") for k in range(2)], "n_nationkey int, n_name string")
    put("customer", [(1, 0)], "c_custkey long, c_nationkey int")
    put("supplier", [(1, 1)], "s_suppkey long, s_nationkey int")
    put("orders", [(1, 1, "O", 10.0, day, "1-URGENT")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    put("lineitem", [(1, 1, 1, n, 20.0, 30.0, "A", day) for n in range(1, 8)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_shipdate timestamp_ntz")
    put("events", [(1, 1, day, 2.0)], "event_id long, user_id long, ts timestamp_ntz, value double")
    return str(tmp_path)


def test_table_counts_are_those_after_the_ingest(spark, one_order):
    from wayfare.plans.catalog import table_counts
    # line 7 comes without a train number and is rejected
    assert {tuple(r) for r in table_counts(spark, one_order).collect()} == {("train_tickets", 6), ("weather_data", 1)}


def test_prompt_rows_are_whole_texts(spark, one_order):
    from wayfare.plans.catalog import prompt_rows
    df = prompt_rows(spark, one_order)
    assert df.columns == ["request_id", "prompt"]
    for r in df.collect():
        assert "NATION_" in r.prompt and len(r.prompt) > 100


def test_many_rows_are_merged_in_slices(spark, monkeypatch):
    from wayfare.operators import load
    monkeypatch.setattr(load, "SLICE_ROWS", 30)
    jobs, write = [], load._write
    monkeypatch.setattr(load, "_write", lambda df, *rest: jobs.append(df.count()) or write(df, *rest))
    root = tempfile.mkdtemp(prefix="wayfare-slice-")
    rows = [(k, f"p{k % 7}" if k % 7 else None, "old") for k in range(70)]
    put(spark, root, [*rows, *rows])
    assert jobs == [10] * 7  # 20 rows of a partition come in, two partitions would be 40
    put(spark, root, [(k, p, "new") for k, p, _ in rows if k % 7 in (2, 3, 4)] + [(99, "p3", "new")])
    assert jobs[7:] == [20 + 1, 10]
    got = {(r.k, r.part): r.v for r in read_published(spark, root, "t").collect()}
    assert read_published(spark, root, "t").count() == 71 and got.pop((99, "p3")) == "new"
    assert got == {(k, p): "new" if k % 7 in (2, 3, 4) else "old" for k, p, _ in rows}
    monkeypatch.setattr(load, "SLICE_BYTES", 1)
    put(spark, root, [(k, f"p{k}", "newest") for k in (1, 2, 3)])
    assert jobs[9:] == [10, 10, 11]

    del jobs[:]
    last = lambda df: load.latest_per_key(df, ["k", "part"], ["v"])
    publish(spark, {"t": (table(spark, [*rows, *[(k, p, "zz") for k, p, _ in rows]]), last), "u": spark.range(5)}, root, {"t": lambda: F.col("part")})
    assert jobs == [10] * 7 + [5]
    assert sorted(r.v for r in read_published(spark, root, "t").collect()) == ["zz"] * 70
    publish(spark, {"t": (table(spark, []), last)}, root, {"t": lambda: F.col("part")})
    assert read_published(spark, root, "t").count() == 0


def tables_left(spark):
    from urllib.parse import urlparse

    from wayfare.session import ensure_checkpoint_dir
    folder = f"{urlparse(ensure_checkpoint_dir(spark)).path}/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_an_ingest_leaves_what_it_publishes_and_reports(spark, one_order):
    import glob

    from wayfare.plans.catalog import _ingested
    tables = tables_left(spark)
    root, reports = _ingested(spark, one_order)
    assert len(tables_left(spark) - tables) == 2  # the checked rows of a newest drop, for its report
    assert {tuple(r) for r in reports.collect()} == {
        ("train_tickets", "train_tickets_20240102.csv", 5, 1, 4, 6, 2, 2), ("weather_data", "weather_data_20240102.csv", 0, 0, 1, 1, 0, 0)}
    drops = glob.glob(f"{root.rsplit('/', 1)[0].removeprefix('file:')}/drops-*/*.csv/part-*")
    assert drops and all(f.endswith(".csv.lz4") for f in drops)


def test_a_written_table_leaves_no_shuffle(spark):
    import time

    from wayfare.session import CLEANUP, cut_lineage, cut_through, scratch_tables
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
                     if "/shuffle_" in f}
    setting, before, tables = spark.conf.get(CLEANUP, None), files(), tables_left(spark)
    with scratch_tables(spark):
        df = cut_through(spark, lambda: cut_lineage(spark.range(1000)).repartition(7).groupBy((F.col("id") % 5).alias("k")).count())
        assert len(tables_left(spark) - tables) == 1 and len(df.collect()) == 5
    assert tables_left(spark) == tables and spark.conf.get(CLEANUP, None) == setting
    until = time.time() + 30
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
