"""Global positions without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task, and a
``partitionBy(group)`` window puts a hot group into one task.  Both are avoided here with
the classic two-level scheme:

1. range-partition the rows on (group..., order...), sort within partitions, record each
   row's partition id and position, and checkpoint that (reliable, ``spark.checkpoint.dir``):
   range bounds come from a per-exchange sample, so the partitioning is fixed once in files
   and every later pass reads the same rows in the same partitions;
2. count rows per (partition, group) - a table of about #groups + #partitions rows;
3. turn the counts into per-(partition, group) offsets (a window over that small table);
4. add the offset to the row's position inside its partition.

Everything after step 1 is a deterministic function of the checkpoint files, so the
result can be recomputed any number of times (lost executors included) with the same
numbering, and nothing else is cached or written.

A hot group is spread over many range partitions, so no task ever holds more than one
range partition.  The offsets table is joined back on (partition id, group): with few
groups Spark broadcasts it after measuring it; with many it is a balanced shuffle join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark import StorageLevel

from churnspark import schema as S
from churnspark.session import checkpoint_dir, cut_lineage


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{c}`") if isinstance(c, str) else c for c in cs]


def _range(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """Range exchange on ``keys``.  Without an explicit count the exchange takes
    ``spark.sql.shuffle.partitions`` and AQE may coalesce small partitions to the advisory
    size; the offsets table stays bounded by the shuffle-partition setting either way."""
    return df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)


_PERSISTED: list = []


def _keep(df: DataFrame) -> DataFrame:
    _PERSISTED.append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release_caches() -> int:
    """Unpersist the small size-checked tables cached by ``broadcast_if_small`` (offsets,
    fences, weights: deterministic aggregates, recomputed the same way when needed again)."""
    n = len(_PERSISTED)
    while _PERSISTED:
        _PERSISTED.pop().unpersist(blocking=False)
    return n


def _one_partitioning(ranged: DataFrame) -> DataFrame:
    """The count pass and the numbering pass must see the SAME range partitioning.  Range
    bounds come from a sample seeded per exchange (and column pruning would give the two
    passes different exchanges), so the partitioned rows, with their partition id and
    position as columns, are written once with a reliable checkpoint and both passes read
    those files."""
    checkpoint_dir(ranged.sparkSession)
    return ranged.checkpoint(eager=True)


# A derived table joins back to the data by broadcast only below this measured size.
MAX_BROADCAST_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows in memory, bounded from above: 16 bytes a value, and the bytes of
    everything that has no fixed width."""
    return df.agg(F.sum(_row_bytes(df))).first()[0] or 0


def _row_bytes(df: DataFrame) -> Column:
    fixed = {"ByteType", "ShortType", "IntegerType", "LongType", "FloatType", "DoubleType", "BooleanType",
             "DateType", "TimestampType", "TimestampNTZType", "DecimalType"}
    size = F.lit(16 * max(1, len(df.columns))).cast("long")
    for f in df.schema.fields:
        if type(f.dataType).__name__ not in fixed:
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    return size


def broadcast_if_small(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Size-checked broadcast of a derived table (offsets, fences, class weights).

    The table is persisted and its bytes are summed (one job over already-aggregated rows);
    up to ``max_bytes`` it is hinted for broadcast, otherwise it is joined by shuffle, where
    AQE splits skewed partitions.  Static estimates are not trusted: they can make Spark
    broadcast the big side of the join instead."""
    small = _keep(small)
    return F.broadcast(small) if measured_bytes(small) <= max_bytes else small


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(right[f"_r_{k}"])
        cond = e if cond is None else cond & e
    return left.join(right, on=cond, how="inner").drop(*[f"_r_{k}" for k in keys])


def positions(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (),
              name: str = "pos", size_name: str | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: the 1-based position of each row within its group (whole frame when
    ``group`` is empty) in ``order``.  Give a total order (add a unique tie-break) for a
    reproducible numbering; counts and offsets are exact either way.
    ``size_name`` also adds the group size."""
    group = list(group)
    keys = _cols(group) + _cols(order)
    ranged = _one_partitioning(
        _range(df, keys, num_partitions).sortWithinPartitions(*keys)
          .withColumn("_pid", F.spark_partition_id())
          .withColumn("_local", F.monotonically_increasing_id()
                      - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = ranged.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"),
                                                F.min("_local").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid") if group else Window.orderBy("_pid")
    offsets = counts.withColumn("_off", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cnt"))
    if size_name:
        wg = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
        offsets = offsets.withColumn(size_name, F.sum("_cnt").over(wg))
    offsets = offsets.drop("_cnt")
    if group:
        right = broadcast_if_small(offsets.select(F.col("_pid").alias("_r__pid"),
                                                  *[F.col(f"`{g}`").alias(f"_r_{g}") for g in group],
                                                  "_first", "_off", *([size_name] if size_name else [])))
        joined = _null_safe_join(ranged, right, ["_pid"] + group)
    else:
        # one row per partition: bounded by the partition count, broadcast is safe
        joined = ranged.join(F.broadcast(offsets), on="_pid", how="inner")
    return (joined.withColumn(name, F.col("_off") + F.col("_local") - F.col("_first") + F.lit(1))
                  .drop("_pid", "_local", "_first", "_off"))


def row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "row_id",
            num_partitions: int | None = None) -> DataFrame:
    """Global 1-based row number in ``order`` (file row, serial id, ``ROW_i``)."""
    return positions(df, order, (), name, num_partitions=num_partitions)


def running_sum(df: DataFrame, order: Sequence[str | Column], value: str, name: str = "running",
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole frame in ``order``.

    Per-partition totals -> broadcast offsets (one row per partition), plus a running sum
    inside each range partition (a window keyed by partition id, so every task holds one
    range partition).  Give a total order: rows tied on ``order`` may swap running values
    between recomputations."""
    keys = _cols(order)
    ranged = _one_partitioning(_range(df, keys, num_partitions).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(F.sum(value).alias("_tot"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).drop("_tot")
    w = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_loc", F.sum(value).over(w))
    return (local.join(F.broadcast(offsets), on="_pid").withColumn(name, F.col("_off") + F.col("_loc"))
                 .drop("_pid", "_loc", "_off"))


# -- exact quantiles -----------------------------------------------------------------
# The values at given ranks are found by narrowing: one pass counts the values of an interval in
# ordered buckets, and the bucket that holds the rank, with its least and greatest value, is the next
# interval.  Counts are summed map-side, so no value is shuffled, sorted or stored.

#: Buckets of one pass.
SELECT_BUCKETS = 1024
#: Intervals of at most this many rows are counted value by value, which ends the search.
SELECT_FINISH = 100_000


def _bucket(y: Column, lo: Column, hi: Column, log_scale: bool) -> Column:
    """Ordered bucket of ``y`` in [lo, hi].  The bounds have buckets of their own, so every pass
    takes something off the interval, whatever the values (infinities and NaN included); the
    others are spread evenly, or evenly in the logarithm of their distance from the lower bound."""
    inner = SELECT_BUCKETS - 2
    share = (y / 2 - lo / 2) / (hi / 2 - lo / 2)                       # halves: no overflow
    if log_scale:
        share = F.log1p(share * 1e15) / F.log1p(F.lit(1e15))
    place = F.when(F.isnan(share), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))))
    return (F.when(y == lo, F.lit(0)).when(y == hi, F.lit(SELECT_BUCKETS - 1))
             .otherwise(F.lit(1) + F.least(F.floor(place * inner).cast("int"), F.lit(inner - 1))))


def select_ranks(df: DataFrame, value: str, ranks: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """One row per (group, rank): the group, ``n`` (its values), ``t`` (which of ``ranks``) and ``y``, the
    value at that 0-based rank of the group's ascending values.  ``ranks`` are expressions of ``n``.
    NULL values are ignored; a group of only NULLs yields no row.

    Each pass reads (group, value) once and keeps a table of one row per group and rank.  Evenly
    and logarithmically spread buckets take turns, so skewed values need few passes too."""
    group = list(group)
    names = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    keys = [F.col(f"`{g}`").alias(nm) for g, nm in zip(group, names)] or [F.lit(0).alias("_g0")]
    base = df.select(*keys, F.col(f"`{value}`").cast("double").alias("y")).filter("y IS NOT NULL")
    wanted = F.array(*[F.struct(F.lit(t).alias("t"), r.cast("long").alias("k")) for t, r in enumerate(ranks)])
    sizes = base.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    # a pass reads the table of the pass before several times: it is checkpointed, which keeps plans short
    state = cut_lineage(sizes.select(*names, "n", F.inline(wanted), "lo", "hi", F.col("n").alias("c")).select(
        *names, "n", "t", "k", "lo", "hi", "c"))
    part = [*names, "lo", "hi"]
    before = Window.partitionBy(*part).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    turn = 0
    while True:
        todo = state.filter("lo < hi")
        most, held = todo.agg(F.max("c"), F.sum(_row_bytes(state))).first()
        if most is None:
            break
        spans = todo.select(*[F.col(c).alias(f"_r_{c}") for c in names], "lo", "hi").distinct()
        if held <= MAX_BROADCAST_BYTES:
            spans = F.broadcast(spans)
        cond = F.col("y").between(F.col("lo"), F.col("hi"))
        for c in names:
            cond = cond & base[c].eqNullSafe(spans[f"_r_{c}"])
        rows = base.join(spans, cond)
        digit = F.col("y") if most <= SELECT_FINISH else _bucket(F.col("y"), F.col("lo"), F.col("hi"), turn % 2 == 1)
        counts = rows.groupBy(*part, digit.alias("digit")).agg(F.count(F.lit(1)).alias("cnt"), F.min("y").alias("least"), F.max("y").alias("most"))
        counts = counts.withColumn("skipped", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
        counts = counts.select(*[F.col(c).alias(f"_r_{c}") for c in part], "cnt", "least", "most", "skipped")
        cond = (F.col("k") >= F.col("skipped")) & (F.col("k") < F.col("skipped") + F.col("cnt"))
        for c in part:
            cond = cond & todo[c].eqNullSafe(counts[f"_r_{c}"])
        found = todo.join(counts, cond).select(*names, "n", "t", (F.col("k") - F.col("skipped")).alias("k"),
                                               F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("cnt").alias("c"))
        state = cut_lineage(state.filter("lo >= hi").unionByName(found))
        turn += 1
    return state.select(*[F.col(nm).alias(g) for g, nm in zip(group, names)], "n", "t", F.col("lo").alias("y"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (the ``quantile_cont`` / pandas rule) and ``n`` per group:
    the values at the ranks around each quantile are selected in a few counting passes, and no
    group and no tied value is ever collected into one task.  NULL values are ignored; a group of
    only NULLs yields no row."""
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    picked = select_ranks(df, value, [f(h) for h in at for f in (F.floor, F.ceil)], group)
    gcols = [F.col(f"`{g}`") for g in group]
    sides = [F.max(F.when(F.col("t") == t, F.col("y"))).alias(f"_y{t}") for t in range(2 * len(names))]
    out = picked.groupBy(*gcols, "n").agg(*sides)
    return out.select(*gcols, "n", *[
        (F.col(f"_y{2 * i}") + (F.col(f"_y{2 * i + 1}") - F.col(f"_y{2 * i}")) * (h - F.floor(h))).alias(nm)
        for i, (h, nm) in enumerate(zip(at, names))])


# -- W3 / M3: stratified exact split -------------------------------------------------

def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = S.TEST_FRACTION,
                     seed: int = S.SPLIT_SEED, name: str = "part") -> DataFrame:
    """Add ``name`` in {"train", "test"}.  The test set has ceil(f * n) rows, shared among
    classes in proportion (floor, then the largest remainders), and holds in each class
    the rows with the smallest ``(md5("id:seed"), id)``: reproducible whatever the
    partitioning.  One class only -> plain (unstratified) split by the same hash.
    Ranks are computed over (label, id, hash) only, to find each class's boundary row; the
    full frame then meets a one-row-per-class boundary table by broadcast.  ``id`` must be
    unique."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = Window.partitionBy(F.lit(1))  # over the k-row class table only
    alloc = (counts.withColumn("_n", F.sum("_nc").over(tot))
                   .withColumn("_nt", F.ceil(F.col("_n") * F.lit(float(test_fraction))))
                   .withColumn("_exact", F.col("_nt") * F.col("_nc") / F.col("_n"))
                   .withColumn("_base", F.floor("_exact"))
                   .withColumn("_rem", F.col("_nt") - F.sum("_base").over(tot))
                   .withColumn("_rr", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(
                       F.desc(F.col("_exact") - F.col("_base")), F.col(label))))
                   .withColumn("_take", (F.col("_base") + F.when(F.col("_rr") <= F.col("_rem"), 1).otherwise(0)).cast("long"))
                   .select(label, "_take"))
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    # ranks over three narrow columns only; the wide frame is never shuffled or checkpointed
    ranked = positions(df.select(F.col(label), F.col(id_col), h.alias("_h")), ["_h", id_col], [label], name="_k")
    # per class, the last test row in (hash, id) order: one row per class
    bounds = (ranked.join(broadcast_if_small(alloc), on=label, how="inner")
                    .filter(F.col("_k") == F.col("_take"))
                    .select(label, F.col("_h").alias("_bh"), F.col(id_col).alias("_bid")))
    out = df.withColumn("_h", h).join(broadcast_if_small(bounds), on=label, how="left")
    is_test = (F.col("_h") < F.col("_bh")) | ((F.col("_h") == F.col("_bh")) & (F.col(id_col) <= F.col("_bid")))
    return (out.withColumn(name, F.when(F.coalesce(is_test, F.lit(False)), F.lit("test")).otherwise(F.lit("train")))
               .drop("_h", "_bh", "_bid"))
