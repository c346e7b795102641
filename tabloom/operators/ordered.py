"""Order-based operators that never move a whole table, or a whole hot group, into one task.

A row's global position comes from a range partitioning on the order keys: the position inside the
range partition plus the row count of the partitions before it.  Positions are cut into blocks of
equal size.  Lags and rolling windows run per block with the last rows of the block before copied in;
running totals run per block and add the totals of the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, join_on
from tabloom.session import cut_lineage

POS = "_pos"
BLOCK_ROWS = 500_000


def positioned(df: DataFrame, order_by, partition_by=()) -> DataFrame:
    """Add ``_pos``: 0-based global position in (partition_by, order_by) order.

    The ordered rows are checkpointed, so both reads of them see the same partitions.
    """
    keys = [*as_list(partition_by), *as_list(order_by)]
    ranged = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = ranged.withColumn("_part", F.shiftright("_mid", 33))
    per_part = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so this window and the broadcast are bounded by the partition count
    offsets = per_part.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(POS, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_mid", "_off")
    )


def _block(block_rows: int) -> Column:
    return F.floor(F.col(POS) / F.lit(block_rows)).cast("bigint")


def _with_halo(pos_df: DataFrame, depth: int, block_rows: int) -> DataFrame:
    """Copy the last ``depth`` rows of each block into the next one, marked ``_halo``."""
    block_rows = max(block_rows, depth)
    blk = _block(block_rows)
    near_end = F.col(POS) % block_rows >= block_rows - depth
    return pos_df.withColumn(
        "_blk", F.explode(F.when(near_end, F.array(blk, blk + 1)).otherwise(F.array(blk)))
    ).withColumn("_halo", F.col("_blk") != blk)


def _over_neighbours(pos_df, partition_by, depth, build, block_rows) -> DataFrame:
    """``build(window)`` gives the new columns; they may look back ``depth`` rows."""
    halo = _with_halo(pos_df, depth, block_rows)
    window = Window.partitionBy("_blk", *as_list(partition_by)).orderBy(POS)
    cols = build(window)
    kept = halo.select("*", *[c.alias(n) for n, c in cols.items()])
    return kept.where(~F.col("_halo")).drop("_halo", "_blk")


def running_positions(pos_df: DataFrame, totals: dict, partition_by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running totals on a positioned frame; ``totals`` maps new name -> (column, 'sum'|'max'|'min')."""
    partition_by = as_list(partition_by)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    blocked = pos_df.withColumn("_blk", _block(block_rows))
    per_block = blocked.groupBy("_blk", *partition_by).agg(
        *[fns[how](c).alias(f"_t_{n}") for n, (c, how) in totals.items()]
    )
    earlier = Window.partitionBy(*partition_by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_block.select(
        "_blk", *partition_by, *[fns[how](f"_t_{n}").over(earlier).alias(f"_p_{n}") for n, (_, how) in totals.items()]
    )
    inside = Window.partitionBy("_blk", *partition_by).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[fns[how](c).over(inside).alias(f"_l_{n}") for n, (c, how) in totals.items()])
    merged = join_on(local, prefix, ["_blk", *partition_by], "left")
    out = {}
    for n, (_, how) in totals.items():
        here, prior = F.col(f"_l_{n}"), F.col(f"_p_{n}")
        if how == "sum":
            out[n] = F.coalesce(prior + here, prior, here)
        else:
            out[n] = F.greatest(prior, here) if how == "max" else F.least(prior, here)
    drop = [f"_{k}_{n}" for n in totals for k in "lp"]
    return merged.withColumns(out).drop("_blk", *drop)


def running_total(df: DataFrame, order_by, totals: dict, partition_by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    pos = positioned(df, order_by, partition_by)
    return running_positions(pos, totals, partition_by, block_rows).drop(POS)


def row_index(df: DataFrame, order_by, partition_by=(), name: str = "row_index") -> DataFrame:
    """0-based row number in the given total order, per group if ``partition_by`` is set."""
    pos = positioned(df, order_by, partition_by)
    return index_positions(pos, partition_by, name).drop(POS)


def index_positions(pos_df: DataFrame, partition_by, name: str) -> DataFrame:
    partition_by = as_list(partition_by)
    if not partition_by:
        return pos_df.withColumn(name, F.col(POS))
    starts = pos_df.groupBy(*partition_by).agg(F.min(POS).alias("_start"))
    return join_on(pos_df, starts, partition_by, "inner").withColumn(name, F.col(POS) - F.col("_start")).drop("_start")


def _rolling_cols(c: str, n: int, window) -> dict:
    span = window.rowsBetween(-(n - 1), 0)
    return {
        f"{c}_rolling_mean_{n}": F.avg(c).over(span),
        f"{c}_rolling_std_{n}": F.stddev_samp(c).over(span),
    }


def _lag_cols(c: str, steps, window) -> dict:
    return {f"{c}_lag_{k}": F.lag(c, k).over(window) for k in steps}


def rolling_stats(df, cols, order_by, n: int = 3, partition_by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean and sample deviation of the current and the n-1 rows before."""
    pos = positioned(df, order_by, partition_by)

    def build(w):
        return {k: v for c in as_list(cols) for k, v in _rolling_cols(c, n, w).items()}

    return _over_neighbours(pos, partition_by, n - 1, build, block_rows).drop(POS)


def lags(df, cols, order_by, steps=(1, 2), partition_by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    pos = positioned(df, order_by, partition_by)

    def build(w):
        return {k: v for c in as_list(cols) for k, v in _lag_cols(c, steps, w).items()}

    return _over_neighbours(pos, partition_by, max(steps), build, block_rows).drop(POS)


def _cumulative_totals(cols) -> dict:
    return {f"{c}_cum{how}": (c, how) for c in as_list(cols) for how in ("sum", "max", "min")}


def _mask_null_inputs(df: DataFrame, totals: dict) -> DataFrame:
    return df.withColumns({n: F.when(F.col(c).isNotNull(), F.col(n)) for n, (c, _) in totals.items()})


def cumulative(df, cols, order_by, partition_by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sum, max and min; null where the input is null."""
    totals = _cumulative_totals(cols)
    return _mask_null_inputs(running_total(df, order_by, totals, partition_by, block_rows), totals)


def step_diff(df, ts: str, order_by, partition_by=(), name="step_seconds", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Seconds since the previous row's timestamp."""
    pos = positioned(df, order_by, partition_by)
    return step_positions(pos, ts, partition_by, name, block_rows).drop(POS)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps (with or without time zone)."""
    return F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))


def step_positions(pos_df, ts: str, partition_by=(), name="step_seconds", block_rows: int = BLOCK_ROWS) -> DataFrame:
    def build(w):
        return {name: seconds_between(F.col(ts), F.lag(ts, 1).over(w))}

    return _over_neighbours(pos_df, partition_by, 1, build, block_rows)


def zscore(df: DataFrame, cols) -> DataFrame:
    """(x - mean) / sample deviation; the column is always made, null when the deviation is 0."""
    cols = as_list(cols)
    stats = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    out = {}
    for i, c in enumerate(cols):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        out[f"{c}_zscore"] = (F.col(c) - F.lit(mean)) / F.lit(dev) if dev else F.lit(None).cast("double")
    return df.withColumns(out)


def percentile_rank(df: DataFrame, cols, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Average rank divided by the number of non-null values.

    Ranks are found on the distinct values with their counts and joined back by value.
    """
    out = df
    for c in as_list(cols):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        run = running_total(counts, "_v", {"_cum": ("_n", "sum")}, block_rows=block_rows)
        n = df.agg(F.count(c)).first()[0]
        ranks = run.select("_v", ((F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2) / F.lit(n)).alias(f"{c}_percentile_rank"))
        out = out.join(ranks, out[c] == ranks["_v"], "left").drop("_v")
    return out


def statistical_features(df: DataFrame, cols, order_by, partition_by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling, lag, cumulative, z-score and percentile-rank columns from one ordering of the table."""
    cols = as_list(cols)
    pos = positioned(df, order_by, partition_by)

    def build(w):
        made = {}
        for c in cols:
            made.update(_rolling_cols(c, 3, w))
            made.update(_lag_cols(c, (1, 2), w))
        return made

    near = _over_neighbours(pos, partition_by, 2, build, block_rows)
    totals = _cumulative_totals(cols)
    full = _mask_null_inputs(running_positions(near, totals, partition_by, block_rows), totals).drop(POS)
    return percentile_rank(zscore(full, cols), cols, block_rows)


def _literal_key(row, schema) -> Column:
    """The key columns of a collected row as one struct literal, for ordered comparison."""
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields])


def split_by_order(df: DataFrame, order_by, ratio: float = 0.7, name: str = "drift_period") -> DataFrame:
    """First int(n * ratio) rows in order are 'Reference', the others 'Current'.

    Only the key columns are ordered; the key at the cut (one row) then labels the rows in place, so
    the table itself is neither shuffled nor copied.  Keys that are null or repeat across the cut take
    the slower way of numbering whole rows.
    """
    keys = as_list(order_by)
    cutoff = int(df.count() * ratio)
    pos = positioned(df.select(*keys), keys)
    cut = pos.where(F.col(POS) == cutoff).first()
    if cut is None:
        return df.withColumn(name, F.lit("Reference" if cutoff else "Current"))
    here, at = F.struct(*keys), _literal_key(cut, pos.drop(POS).schema)
    straddles = pos.where((F.col(POS) < cutoff) & (here == at)).limit(1).count() > 0
    if straddles or any(cut[k] is None for k in keys):
        pos = positioned(df, keys)
        return pos.withColumn(name, F.when(F.col(POS) < cutoff, "Reference").otherwise("Current")).drop(POS)
    return df.withColumn(name, F.when(here < at, "Reference").otherwise("Current"))


def split_random(df: DataFrame, keys, frac: float = 0.2, seed: int = 42, stratify=(), name: str = "split") -> DataFrame:
    """Repeatable split: the first ceil(n * frac) rows of each stratum in hash order are 'test'.

    Only strata, hashes and keys are ordered.  The last test key of each stratum is joined back (one row
    per stratum) and compared in place.
    """
    keys, stratify = as_list(keys), as_list(stratify)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    ids = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    narrow = df.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(stratify)], digest.alias("_h"), *ids)
    strata = [f"_s{i}" for i in range(len(stratify))]
    order = ["_h", *[f"_k{i}" for i in range(len(keys))]]
    pos = positioned(narrow, order, strata)
    spans = pos.groupBy(*strata).agg(F.min(POS).alias("_start"), F.count(F.lit(1)).alias("_n"))
    take = F.ceil(F.col("_n") * F.lit(frac))
    if strata:
        ends = join_on(pos, spans, strata, "inner").where(F.col(POS) == F.col("_start") + take - 1)
        ends = ends.select(*[F.col(s).alias(c) for s, c in zip(strata, stratify)], F.struct(*order).alias("_last"))
        marked = join_on(df, ends, stratify, "left")
    else:
        span = spans.select("_n", take.alias("take")).first()
        last = pos.where(F.col(POS) == span["take"] - 1).first()
        if last is None:
            return df.withColumn(name, F.lit("train"))
        marked = df.withColumn("_last", _literal_key(last, pos.select(*order).schema))
    here = F.struct(digest.alias("_h"), *ids)
    return marked.withColumn(name, F.when(here <= F.col("_last"), "test").otherwise("train")).drop("_last")


def dedupe_first(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Drop repeats.  With ``subset`` the row smallest in ``order_by`` stays.

    ``min_by`` keeps one row per key in the map-side aggregate, so a hot key never gathers its rows.
    """
    if subset is None:
        return df.distinct()
    order = F.struct(*as_list(order_by))
    row = F.struct(*df.columns)
    kept = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(as_list(subset))]).agg(F.min_by(row, order).alias("_r"))
    return kept.select("_r.*")
