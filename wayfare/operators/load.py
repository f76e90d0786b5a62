"""Keyed upsert, load report and all-or-nothing publish (SNK-1..3, ING-1).

No table format with MERGE is installed, so an upsert is a last-write-wins
aggregate per key over the current and the incoming rows (``max_by``
combines map-side, so a hot key doesn't gather its rows in one place). A
published table is a set of Parquet folders, one per partition value (the
day, as a rule); a manifest names them. An upsert reads and rewrites only
the partitions that the incoming rows fall in, into new folders, and puts
the others into the next manifest as they are. Manifests are numbered and
created only if absent, so of two writers one wins a number and the other
goes on from there; readers see whole versions only. Many rows are merged a
slice of the partitions after the other, so that the shuffles and sorts of a
large load take the disk of one slice only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.session import cut_through, no_shuffles_left
from wayfare.sources.files import accepted, newest_snapshot, read_contract

#: The partition of a published table's rows (a day where months are large).
PARTS = {"train_tickets": lambda: F.date_format("departure_time", "yyyy-MM"), "weather_data": lambda: F.date_format("fx_date", "yyyy-MM")}

#: Incoming rows, and bytes of files that are read again, that one job merges (or else one partition's).
SLICE_ROWS, SLICE_BYTES = 1 << 23, 256 << 20


def _grouped(df: DataFrame, key: list[str], collation: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its key as the collation compares it, as columns to group
    by; a hash of them comes first, so that sorts seldom compare texts."""
    text = [c for c in key if df.schema[c].dataType.typeName() in ("string", "varchar", "char")]
    if collation == X.COLLATION:
        df = X.collated_keys(df, text, [f"__c_{c}" for c in text], collation)
        same = [f"__c_{c}" if c in text else c for c in key]
        return df.withColumn("__hash", F.xxhash64(*same)), ["__hash", *same]
    return df.withColumns({f"__c_{c}": F.collate(c, collation) for c in text}), [f"__c_{c}" if c in text else c for c in key]


def latest_per_key(df: DataFrame, key: list[str], order: list[str], collation: str | None = None) -> DataFrame:
    """WIN-3: keep, per key, the row with the greatest ``order`` (all columns).
    With a collation, keys are equal as it says and the row's own spelling
    stays; ``df`` is then read more than once."""
    rank = F.struct(*[F.col(c) for c in order])
    if collation is None:
        values = F.struct(*[F.col(c) for c in df.columns if c not in key])
        winner = df.groupBy(*key).agg(F.max_by(values, rank).alias("__w"))
        return winner.select(*[c if c in key else F.col("__w")[c].alias(c) for c in df.columns])
    keyed, same = _grouped(df, key, collation)
    keyed = keyed.select(F.struct(*df.columns).alias("__row"), rank.alias("__rank"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(same)])
    return keyed.groupBy(*[f"__k{i}" for i in range(len(same))]).agg(F.max_by("__row", "__rank").alias("__w")).select("__w.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None,
           collation: str | None = None) -> DataFrame:
    """SNK-1: on key match replace every column (NULLs included); later rows win.

    ``order`` columns order the incoming rows (file, then row position);
    existing rows always lose to incoming ones.
    """
    order = order or []
    cols = existing.columns
    new = incoming.select(*cols, F.lit(1).alias("__src"), *[F.col(c).alias(c + "__o") for c in order])
    both = existing.withColumn("__src", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return latest_per_key(both, key, ["__src", *[c + "__o" for c in order]], collation).select(*cols)


def load_report(table_name: str, file_name: str, read: DataFrame, before: DataFrame, key: list[str],
                collation: str | None = None) -> DataFrame:
    """SNK-2: one row: file, csv_rows (all rows read), rejected, before, after,
    inserted = after - before, updated = accepted keys that already existed.
    One pass: each key's part in the old table and in the file says what
    becomes of it, so the table after the load isn't read."""
    ok = F.col("__reason").isNull()
    rows = (before.select(*key, F.lit(1).cast("tinyint").alias("side"))
            .unionByName(read.where(ok).select(*key, F.lit(2).cast("tinyint").alias("side"))))
    rows, same = _grouped(rows, key, collation) if collation else (rows, key)
    per = rows.groupBy(*same).agg(F.bit_or("side").alias("sides"))  # 1 in the old table, 2 in the file, 3 in both
    keys = per.agg(F.count_if(F.col("sides") != 2).alias("before"), F.count(F.lit(1)).alias("after"),
                   F.count_if(F.col("sides") == 2).alias("inserted"), F.count_if(F.col("sides") == 3).alias("updated"))
    lines = read.agg(F.count(F.lit(1)).alias("csv_rows"), F.count_if(~ok).alias("rejected"))  # one row each
    return lines.crossJoin(keys).select(F.lit(table_name).alias("table"), F.lit(file_name).alias("file"), "csv_rows", "rejected",
                                        "before", "after", "inserted", "updated")


# --- published tables -------------------------------------------------------------

def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _bytes(spark: SparkSession, path: str) -> int:
    hadoop, fs = _file(spark, path)
    return fs.getContentSummary(hadoop).getLength()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A small file with ``text``, whole at once and only if there is none of
    that name; False otherwise."""
    target, fs = _file(spark, path)
    draft, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # renaming would replace; a link doesn't
            files, place = spark._jvm.java.nio.file.Files, lambda p: fs.pathToFile(p).toPath()
            files.createLink(place(target), place(draft))
        else:
            jvm = spark._jvm
            never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(
                draft, target, never)
    except Exception as e:  # noqa: BLE001 - the JVM's exceptions come wrapped
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


def _manifests(spark: SparkSession, root: str) -> list[int]:
    folder, fs = _file(spark, f"{root}/_manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, seq: int | None = None) -> dict:
    """The live manifest, or that of a number: ``seq`` (0: nothing
    published), ``version``, for each table its folder by partition, and the
    ``stamps`` that writers leave."""
    if seq is None:
        seq = max(_manifests(spark, root), default=0)
    if seq == 0:
        return {"seq": 0, "version": None, "tables": {}, "stamps": {}}
    return json.loads(spark.read.text(f"{root}/_manifests/{seq:012d}.json", wholetext=True).first()[0])


def _next(spark: SparkSession, root: str, current: dict, version: str, tables: dict, stamp: dict) -> bool:
    """Try to make ``tables`` (over those of ``current``) the next manifest."""
    seq = current["seq"] + 1
    made = {"seq": seq, "version": version, "tables": current["tables"] | tables, "stamps": current.get("stamps", {}) | stamp}
    return create_if_absent(spark, f"{root}/_manifests/{seq:012d}.json", json.dumps(made, sort_keys=True))


def _write(df: DataFrame, root: str, folder: str, part: Column | None) -> dict[str, str]:
    """The rows in a new folder, by partition; folder by partition value."""
    with no_shuffles_left(df.sparkSession):
        if part is None:
            df.write.mode("errorifexists").parquet(f"{root}/{folder}")
            return {"": folder}
        # rebalanced, so that a large partition takes several tasks and files
        (df.withColumn("__part", part).hint("rebalance", "__part")
         .write.mode("errorifexists").partitionBy("__part").parquet(f"{root}/{folder}"))
    path, fs = _file(df.sparkSession, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    if not any(n.startswith("__part=") for n in names):  # no rows; the schema is kept
        df.limit(0).write.mode("errorifexists").parquet(f"{root}/{folder}/none")
        return {"": f"{folder}/none"}
    return {df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(n[7:]): f"{folder}/{n}"
            for n in names if n.startswith("__part=")}


def _counts(df: DataFrame, part: Column) -> dict:
    """Numbers of rows by partition."""
    return {r["p"]: r["count"] for r in df.select(part.alias("p")).groupBy("p").count().collect()}  # one row per partition


def _slices(rows: dict, size: Callable[[object], int] = lambda p: 0) -> list[list]:
    """The partitions of ``rows`` (numbers of rows by partition) in slices of
    SLICE_ROWS rows and SLICE_BYTES of ``size`` at most, or of one partition."""
    slices, held, weight = [[]], 0, 0
    for p in sorted(rows, key=str):
        n, b = rows[p], size(p)
        if slices[-1] and (held + n > SLICE_ROWS or weight + b > SLICE_BYTES):
            slices.append([])
            held = weight = 0
        slices[-1].append(p)
        held, weight = held + n, weight + b
    return slices


def _within(df: DataFrame, part: Column, some: list) -> DataFrame:
    """The rows of some partitions."""
    hit = part.isin([p for p in some if p is not None])
    return df.where(hit | part.isNull() if None in some else hit)


def publish(spark: SparkSession, tables: dict[str, DataFrame | tuple[DataFrame, Callable[[DataFrame], DataFrame]]], root: str,
            parts: dict | None = None) -> str:
    """SNK-3: write every table under a fresh folder, then the next manifest.
    A table may be given as rows and what makes it of the rows of any whole
    partitions; it is then made and written in slices.

    A failure before the manifest leaves the old version live; tables that
    aren't given stay as they are. A writer that loses a number to another
    takes the next one. Returns the version id.
    """
    parts = PARTS if parts is None else parts
    version = uuid.uuid4().hex[:12]
    placed = {}
    for name, df in tables.items():
        rows, make = df if isinstance(df, tuple) else (df, None)
        part = parts[name]() if name in parts else None
        slices = _slices(_counts(rows, part)) if make and part is not None else [[]]
        placed[name] = {}
        for k, some in enumerate(slices):
            one = _within(rows, part, some) if len(slices) > 1 else rows
            placed[name] |= _write(make(one) if make else one, root, f"v={version}/{name}" + f"-{k}" * bool(k), part)
    while not _next(spark, root, manifest(spark, root), version, placed, {}):
        pass
    return version


def upsert_published(spark: SparkSession, root: str, incoming: dict[str, DataFrame], order: list[str] | None = None,
                     collation: str | None = None, keys: dict | None = None, parts: dict | None = None,
                     stamp: dict | None = None) -> str | None:
    """SNK-1 on published tables, all or none: only the partitions that
    incoming rows fall in are read and written again; the folders of the
    others, and their files, pass into the next version untouched. A table's
    key must decide the partition. If another writer was first, a table's
    rows are merged again only where that one changed a partition in
    question. Many rows are merged in slices of the partitions. With a
    ``stamp`` (name and number) that the manifest has already reached,
    nothing is done. Returns the version."""
    keys = keys or {n: C.TABLES[n]["key"] for n in incoming}
    parts = parts or {n: PARTS[n]() for n in incoming}
    hit = {n: _counts(df, parts[n]) for n, df in incoming.items()}
    base, placed, version = {}, {}, uuid.uuid4().hex[:12]
    while True:
        current = manifest(spark, root)
        if any(current.get("stamps", {}).get(k, -1) >= v for k, v in (stamp or {}).items()):
            return None
        tables = {}
        for name, df in incoming.items():
            folders = current["tables"].get(name, {})
            touched = {p: folders.get(p) for p in hit[name]}
            if base.get(name) != touched:
                base[name] = touched
                columns = [c for c in df.columns if c not in (order or [])]
                slices = _slices(hit[name], lambda p, t=touched: _bytes(spark, f"{root}/{t[p]}") if t[p] else 0)
                placed[name] = {}
                for some in slices:
                    old = [f"{root}/{touched[p]}" for p in some if touched[p]]
                    new = _within(df, parts[name], some) if len(slices) > 1 else df
                    existing = spark.read.parquet(*old) if old else df.select(*columns).limit(0)
                    rows = upsert(existing, new, keys[name], order, collation)
                    placed[name] |= _write(rows, root, f"v={version}/{name}-{uuid.uuid4().hex[:6]}", parts[name])
            kept = {p: f for p, f in folders.items() if p not in touched and p != ""}
            tables[name] = kept | {p: f for p, f in placed[name].items() if p != "" or not kept}
        if _next(spark, root, current, version, tables, stamp or {}):
            return version


def expire(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Delete the folders that none of the last ``keep`` manifests names, and
    the older manifests; returns how many folders went. What a writer hasn't
    published yet is named by no manifest and stays."""
    numbers = _manifests(spark, root)
    names = lambda seq: {f for t in manifest(spark, root, seq)["tables"].values() for f in t.values()}
    live = set().union(*map(names, numbers[-keep:])) if numbers else set()
    gone = 0
    for seq in numbers[:-keep]:
        for folder in names(seq) - live:
            path, fs = _file(spark, f"{root}/{folder}")
            gone += bool(fs.delete(path, True))
            above = path.getParent()  # of a load, then of a version: gone once no partition is left in it
            while above.getName() != _file(spark, root)[0].getName() and fs.exists(above) and not any(
                    s.isDirectory() for s in fs.listStatus(above)):
                fs.delete(above, True)
                above = above.getParent()
        path, fs = _file(spark, f"{root}/_manifests/{seq:012d}.json")
        fs.delete(path, False)
    return gone


def latest_version(spark: SparkSession, root: str) -> str | None:
    return manifest(spark, root)["version"]


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The live version of a table."""
    folders = manifest(spark, root)["tables"].get(name)
    if folders is None:
        raise FileNotFoundError(f"nothing published as {name} under {root}")
    return spark.read.parquet(*[f"{root}/{f}" for f in folders.values()])


def _without_text(checked: DataFrame) -> DataFrame:
    """Checked rows without the text of their cells."""
    return checked.drop(*[c for c in checked.columns if c.startswith("raw_")])


def ingest(spark: SparkSession, data_dir: str, root: str, collation: str | None = None) -> DataFrame:
    """ING-1: the newest snapshots in ``data_dir``, of each table of the
    contracts that has one, checked and put into the tables published under
    ``root`` as one version; the load reports, one row a table."""
    reports, rows = None, {}
    for name, spec in C.TABLES.items():
        newest = newest_snapshot(spark, data_dir, spec["pattern"], required=False)
        if newest is None:
            continue
        # parsed once, read for report, partitions and merge
        read = cut_through(spark, lambda: _without_text(read_contract(spark, newest, name)))  # noqa: B023
        rows[name] = accepted(read)
        known = name in manifest(spark, root)["tables"]
        before = read_published(spark, root, name) if known else rows[name].drop("__order").limit(0)
        report = load_report(name, newest.rstrip("/").rsplit("/", 1)[-1], read, before, spec["key"], collation)
        reports = report if reports is None else reports.unionByName(report)
    if reports is None:
        raise FileNotFoundError(f"no snapshot of any table in {data_dir}")
    upsert_published(spark, root, rows, ["__order"], collation)
    return reports
