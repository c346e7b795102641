"""Exact quantiles (linear interpolation) whose state stays bounded at any table size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.columns import as_list, join_on
from tabloom.operators.ordered import running_total

STATE_LIMIT = 200_000
_ACCURACY = 10_000
_MARGIN = 2.0 / _ACCURACY
_ROUNDS = 4


def exact_quantiles(df: DataFrame, cols, probs, limit: int = STATE_LIMIT) -> dict[str, list]:
    """{column: [quantile for each prob]}; a handful of numbers per column reach the driver.

    Up to ``limit`` values per column the built-in exact aggregate is used.  Above it, approximate
    quantiles give a bracket around each wanted rank, exact counts prove that the rank is inside, and
    the bracket shrinks until it holds at most ``limit`` values, which are then ordered exactly.
    """
    cols, probs = as_list(cols), list(probs)
    if not cols:
        return {}
    around = [x for p in probs for x in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN + 1.0 / limit))]
    first = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(F.col(c).cast("double"), around, _ACCURACY).alias(f"b{i}") for i, c in enumerate(cols)],
    ).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    out = {c: [None] * len(probs) for c in cols if counts[c] == 0}
    small = [c for c in cols if 0 < counts[c] <= limit]
    if small:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{i}") for i, c in enumerate(small)]).first()
        out.update({c: list(row[f"q{i}"]) for i, c in enumerate(small)})
    big = [c for c in cols if counts[c] > limit]
    if big:
        targets = [_Target(c, p, counts[c]) for c in big for p in probs]
        sketches = {c: first[f"b{i}"] for i, c in enumerate(cols)}
        found = {t: tuple(sketches[t.col][2 * (i % len(probs)) :][:2]) for i, t in enumerate(targets)}
        out.update(_narrow(df, targets, found, counts, limit))
    return out


class _Target:
    """One wanted quantile of one column and the bracket known to hold it."""

    def __init__(self, col, prob, n):
        pos = (n - 1) * prob
        self.col, self.frac = col, pos - int(pos)
        self.first, self.last = int(pos), min(n - 1, int(pos) + (1 if pos > int(pos) else 0))
        self.low = self.high = None
        self.below, self.within = 0, n

    def fractions(self):
        """Where to look, as shares of the values inside the bracket."""
        return max(0.0, (self.first - self.below) / self.within - _MARGIN), min(1.0, (self.last - self.below + 1) / self.within + _MARGIN)

    def settled(self):
        return self.low is not None and self.low == self.high

    def value(self):
        return F.col(self.col).cast("double")

    def inside(self, low, high):
        v = self.value()
        return v.isNotNull() if low is None else (v >= F.lit(low)) & (v <= F.lit(high))


def _sketch(df, targets) -> dict:
    """Approximate brackets; targets that share a column and a bracket share one sketch."""
    shared: dict = {}
    for t in targets:
        shared.setdefault((t.col, t.low, t.high), []).append(t)
    groups = list(shared.values())
    asks = [
        F.percentile_approx(F.when(g[0].inside(g[0].low, g[0].high), g[0].value()), [x for t in g for x in t.fractions()], _ACCURACY).alias(f"b{i}")
        for i, g in enumerate(groups)
    ]
    row = df.agg(*asks).first()
    return {t: tuple(row[f"b{i}"][2 * j : 2 * j + 2]) for i, g in enumerate(groups) for j, t in enumerate(g)}


def _prove(df, found) -> None:
    """Count what lies below and inside each bracket; keep the bracket only if it holds the wanted ranks."""
    counts = []
    for i, (t, (low, high)) in enumerate(found.items()):
        counts += [F.count_if(t.value() < F.lit(low)).alias(f"l{i}"), F.count_if(t.inside(low, high)).alias(f"w{i}")]
    row = df.agg(*counts).first()
    for i, (t, bracket) in enumerate(found.items()):
        below, within = row[f"l{i}"], row[f"w{i}"]
        if below <= t.first and t.last < below + within:
            (t.low, t.high), t.below, t.within = bracket, below, within


def _narrow(df, targets, found, counts, limit) -> dict:
    for _ in range(_ROUNDS):
        _prove(df, found)
        todo = [t for t in targets if t.within > limit and (t.low is None or t.low < t.high)]
        if not todo:
            break
        found = _sketch(df, todo)
    values = _ordered_picks(df, [t for t in targets if t.within <= limit and not t.settled()])
    out: dict = {}
    for t in targets:
        if t.settled():
            pair = (t.low, t.low)
        elif t in values:
            pair = values[t]
        else:
            n = counts[t.col]
            row = quantiles_by(df, [], t.col, [t.first / (n - 1), t.last / (n - 1)]).first()
            pair = (row["q0"], row["q1"])
        out.setdefault(t.col, []).append(pair[0] + (pair[1] - pair[0]) * t.frac)
    return out


def _ordered_picks(df, targets):
    if not targets:
        return {}
    held = F.array(*[F.struct(F.lit(i).alias("t"), F.when(t.inside(t.low, t.high), t.value()).alias("v")) for i, t in enumerate(targets)])
    per_value = (
        df.select(F.explode(F.filter(held, lambda s: s["v"].isNotNull())).alias("s"))
        .groupBy(F.col("s.t").alias("t"), F.col("s.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.create_map(*[x for i, t in enumerate(targets) for x in (F.lit(i), F.array(F.lit(t.first - t.below), F.lit(t.last - t.below)))])
    cum = per_value.withColumn("c", F.sum("n").over(upto)).withColumn("r", wanted[F.col("t")])

    def holds(rank):
        return (F.col("c") > rank) & (F.col("c") - F.col("n") <= rank)

    first, last = F.col("r")[0], F.col("r")[1]
    rows = cum.groupBy("t").agg(F.min(F.when(holds(first), F.col("v"))).alias("a"), F.min(F.when(holds(last), F.col("v"))).alias("b")).collect()
    return {targets[r["t"]]: (r["a"], r["b"]) for r in rows}


def quantiles_by(df: DataFrame, by, col: str, probs, names=None) -> DataFrame:
    """Exact quantiles per group, from value counts and their running totals.

    No group is gathered anywhere: the running totals are computed block-wise over a range partitioning.
    """
    by = as_list(by)
    names = names or [f"q{i}" for i in range(len(probs))]
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = running_total(counts, "_v", {"_cum": ("_n", "sum")}, partition_by=by)
    sizes = run.groupBy(*by).agg(F.max("_cum").alias("_tot"))
    if by:
        run = join_on(run, sizes, by, "inner")
    else:
        run = run.withColumn("_tot", F.lit(sizes.first()["_tot"]))
    picks, outs = [], {}
    for i, p in enumerate(probs):
        pos = (F.col("_tot") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_v"))).alias(f"_a{i}"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_v"))).alias(f"_b{i}"),
            F.max(pos - F.floor(pos)).alias(f"_f{i}"),
        ]
        outs[names[i]] = F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")
    picked = run.groupBy(*by).agg(*picks) if by else run.agg(*picks)
    return picked.select(*by, *[c.alias(n) for n, c in outs.items()])
