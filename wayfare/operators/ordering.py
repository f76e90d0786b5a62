"""Ordered numbering without a single-task window (SMP-1, WIN-1, JON-1 ranks).

``row_number()`` over an unpartitioned window moves every row into one task,
and over a hot key moves the whole key into one task. Here positions come
from a range-partitioned sort instead: each partition counts its rows, the
counts (one row per partition, a bound set by the partition count) become
offsets, and a row's position is its partition offset plus its place inside
the partition. Hot keys are split across partitions by the range boundaries
because the sort key includes the tie-breaking columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import cut_lineage

_PID = "__pid"
_MID = "__mid"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(df: DataFrame, order_cols: list, num_partitions: int | None = None) -> DataFrame:
    """The rows range-sorted by ``order_cols`` and written once, with their
    partition and their place (``monotonically_increasing_id``).

    Range boundaries come from a sample of the input, whose order is not
    fixed, so two evaluations may split differently: the rows are written
    to the shared folder so that all counts and places come from one split,
    also after a lost executor.
    """
    n = num_partitions or _partitions(df)
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    return cut_lineage(ranged.withColumn(_PID, F.spark_partition_id())
                       .withColumn(_MID, F.monotonically_increasing_id()))


def global_index(df: DataFrame, order_cols: list, out_col: str = "pos",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col``: 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must be a total order (ties only between identical rows).
    """
    ids = _placed(df, order_cols, num_partitions)
    # monotonically_increasing_id = (partition id << 33) + place in partition.
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    counts = ids.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum("__n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    # offsets has one row per partition: bounded, so broadcast.
    return (ids.join(F.broadcast(offsets), _PID)
            .withColumn(out_col, F.col("__off") + local)
            .drop(_PID, _MID, "__off"))


def rank_in_group(df: DataFrame, group_cols: list, order_cols: list, out_col: str = "rank") -> DataFrame:
    """1-based rank inside each group, without putting a group in one task.

    Rows are range-sorted by group and order, so a hot group lies in several
    partitions: the rank is the place among the group's rows of the same
    partition, plus what earlier partitions hold of that group. Only a
    partition's first group can have begun before it, so these sums are one
    row per partition.
    """
    ids = _placed(df, [*group_cols, *order_cols])
    group = F.struct(*[F.col(c) for c in group_cols])
    per = ids.groupBy(_PID, group.alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    edges = per.groupBy(_PID).agg(F.min("__g").alias("__first"), F.max("__g").alias("__last"),
                                  F.max_by("__n", "__g").alias("__tail"))
    before = edges.select(F.col(_PID).alias("__p"), F.col("__last").alias("__l"), F.col("__tail").alias("__t"))
    begun = (edges.join(before, (F.col("__l") == F.col("__first")) & (F.col("__p") < F.col(_PID)))
             .groupBy(_PID, "__first").agg(F.sum("__t").alias("__begun")))
    place = F.row_number().over(Window.partitionBy(_PID, *group_cols).orderBy(_MID))
    # begun has at most one row per partition: bounded, so broadcast.
    return (ids.withColumn("__place", place).join(F.broadcast(begun), _PID, "left")
            .withColumn(out_col, F.col("__place") + F.when(group == F.col("__first"), F.col("__begun"))
                        .otherwise(F.lit(0)))
            .drop(_PID, _MID, "__place", "__first", "__begun"))


class RankSelector:
    """Rows by their rank inside groups, without sorting the table.

    Cut points from a sample of bounded size split the
    rows into ranges; counting the ranges (map-side, no row moves) tells
    which of them hold a wanted rank, and only their rows are looked at
    again: split further while a range has more than ``most`` rows, then
    sorted. A range of equal rows needs neither. The driver sees counts of
    ranges only. ``df`` is read a few times, so callers stage what is dear
    to compute. Groups are few by nature (a table's categories).
    """

    SAMPLE, CUTS, ROUNDS = 8192, 1024, 8

    def __init__(self, df: DataFrame, order_cols: list[str], group_cols: list[str] = (), most: int = 1 << 20):
        self.columns, self.groups, self.most = df.columns, list(group_cols), most
        rest = [c for c in df.columns if c not in (*order_cols, *group_cols)]
        self.row = F.struct(*[F.col(f"`{c}`") for c in (*order_cols, *rest)])
        self.df = df
        levels = [F.col(f"`{c}`").alias(f"__l{k}") for k, c in enumerate(self.groups)]
        self.rows = df.select(*levels, self.row.alias("__row"))
        self.levels = [f"__l{k}" for k in range(len(levels))]
        counted = self.rows.groupBy(*self.levels).agg(F.count(F.lit(1)).alias("n")).collect()
        self.counts = {tuple(r[:-1]): r["n"] for r in counted}

    def _cut(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the number of their range as ``name``."""
        # equal rows have hashes of their own, so that a hot one doesn't fill the sample
        chance = F.xxhash64(F.monotonically_increasing_id(), "__row")
        some = cut_lineage(rows.select("__row").withColumn("__chance", chance).orderBy("__chance").limit(self.SAMPLE))
        place = F.row_number().over(Window.orderBy("__row"))  # of a sample of bounded size
        step = max(1, self.SAMPLE // self.CUTS)
        cuts = some.withColumn("__n", place).where(F.col("__n") % step == 0).agg(
            F.sort_array(F.collect_list("__row")).alias("__cuts"))
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(self.CUTS.bit_length()))])
        below = F.aggregate(halves, F.lit(0), lambda at, half: F.when(
            F.try_element_at(F.col("__cuts"), at + half) <= F.col("__row"), at + half).otherwise(at))
        return rows.join(F.broadcast(cuts)).withColumn(name, below).drop("__cuts")  # one row, at most CUTS of them in it

    def rows_at(self, wanted: list[tuple]) -> DataFrame:
        """The rows at ``wanted`` (group values, 0-based rank, number), with
        the number as ``__wanted``."""
        spark, rows, levels = self.df.sparkSession, self.rows, list(self.levels)
        sizes, same = dict(self.counts), {}
        places = {number: (tuple(group), rank) for group, rank, number in wanted}  # range and rank inside it
        for _ in range(self.ROUNDS):
            if all(sizes[at] <= self.most or at in same for at, _ in places.values()):
                break
            rows = self._cut(self._in(rows, levels, {at for at, _ in places.values()}), f"__l{len(levels)}")
            finer = [*levels, f"__l{len(levels)}"]
            counted = rows.groupBy(*finer).agg(F.count(F.lit(1)).alias("n"), F.min("__row").eqNullSafe(F.max("__row")).alias("same")).collect()
            inside: dict[tuple, list] = {}
            for r in sorted(counted, key=lambda r: r[len(levels)]):
                inside.setdefault(tuple(r[:len(levels)]), []).append((r[len(levels)], r["n"], r["same"]))
            known, sizes, same = same, {}, {}
            for number, (at, rank) in places.items():
                for cut, n, equal in inside[at]:
                    if rank < n:
                        break
                    rank -= n
                places[number] = ((*at, cut), rank)
                sizes[*at, cut] = n
                if equal or at in known:
                    same[*at, cut] = True
            levels = finer
        types = [rows.schema[c].dataType.simpleString() for c in levels]
        table = spark.createDataFrame([(*at, 0 if at in same else rank, bool(same.get(at)), number) for number, (at, rank) in places.items()],
                                      ", ".join([*(f"{c} {t}" for c, t in zip(levels, types)), "__rank long", "__same boolean", "__wanted long"]))
        near = self._in(rows, levels, set(sizes) & {at for at, _ in places.values()})
        sort = self._in(near, levels, {at for at, _ in places.values() if at not in same})
        ranked = sort.withColumn("__rank", F.row_number().over(Window.partitionBy(*(levels or [F.lit(0)])).orderBy("__row")).cast("long") - 1)
        if same:  # any row of these ranges is the one
            one = self._in(near, levels, set(same)).groupBy(*levels).agg(F.min("__row").alias("__row"))
            ranked = ranked.unionByName(one.withColumn("__rank", F.lit(0).cast("long")))
        return self._match(ranked, table, [*levels, "__rank"]).select(
            *[F.col(f"__l{self.groups.index(c)}").alias(c) if c in self.groups else F.col(f"__row.`{c}`").alias(c) for c in self.columns],
            "__wanted")

    @staticmethod
    def _match(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """``table`` has a row per wanted rank: a caller's bound, broadcast."""
        right = table.withColumnsRenamed({c: c + "r" for c in on})
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(c + "r"))
        out = rows.join(F.broadcast(right), cond, how)
        return out if how == "left_semi" else out.drop(*[c + "r" for c in on])

    def _in(self, rows: DataFrame, levels: list[str], ranges: set) -> DataFrame:
        if not levels:
            return rows
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in levels)
        return self._match(rows, rows.sparkSession.createDataFrame(sorted(ranges, key=str), kinds), levels, "left_semi")


class EvenSampler:
    """SMP-1 ``_pick_evenly`` over one ordered table, counted once.

    Several samples of the same table (different counts) share the count.
    Rows sit at ``round(i * (n-1)/(count-1))``, half-even on the binary
    value as Python's ``round``. Too few rows raise, ``count == 1`` gives the
    first row. ``pick`` is 1-based (the reference's enumerate index). The
    table is neither sorted nor written (see ``RankSelector``).
    """

    def __init__(self, df: DataFrame, order_cols: list, most: int = 1 << 20):
        self.ranks = RankSelector(df, order_cols, most=most)
        self.n = self.ranks.counts.get((), 0)

    def pick(self, count: int, pick_col: str = "pick") -> DataFrame:
        if self.n < count:
            raise ValueError(f"Not enough rows for an even sample of {count}")
        step = (self.n - 1) / (count - 1) if count > 1 else 0.0
        rows = self.ranks.rows_at([((), round(i * step), i + 1) for i in range(count)])
        return rows.withColumnRenamed("__wanted", pick_col)


def even_sample(df: DataFrame, order_cols: list, count: int, pick_col: str = "pick") -> DataFrame:
    """One even sample (see ``EvenSampler``)."""
    return EvenSampler(df, order_cols).pick(count, pick_col)


def numbered(df: DataFrame, order_cols: list, out_col: str = "n") -> DataFrame:
    """WIN-1: 1-based numbering in a total order."""
    return global_index(df, order_cols, "__p").withColumn(out_col, F.col("__p") + 1).drop("__p")
