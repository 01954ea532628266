"""Run-log windows and leaderboards.  ``log``: run, generation, kmpp, spread; one run is one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_N, GIVE_UP = 5000, 0.0005


#: Frames up to this long are gone through row by row.
SHORT = 128


def last_n(log: DataFrame, column: str, n: int = LAST_N) -> DataFrame:
    """Minimum, maximum and count of the last n rows of each run.

    A long frame is never gone through: rows stand in blocks of n, and a frame is the end of one block and the beginning of the next,
    so that each row costs the same however long the frame is.
    """
    shown = ["run", "generation", column, "low", "high", "n"]
    order = Window.partitionBy("run").orderBy("generation")
    if n <= SHORT:
        w = order.rowsBetween(-(n - 1), 0)
        return log.select("run", "generation", column, F.min(column).over(w).alias("low"), F.max(column).over(w).alias("high"), F.count(column).over(w).alias("n"))
    rows = log.select("run", "generation", column).withColumn("i", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("i") / n))
    block = Window.partitionBy("run", "block").orderBy("i")
    begun, rest = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    found = lambda w: F.struct(F.min(column).over(w).alias("low"), F.max(column).over(w).alias("high"), F.count(column).over(w).alias("n"))
    rows = rows.withColumns({"begun": found(begun), "rest": found(rest)})
    rows = rows.withColumn("before", F.when(F.col("i") % n != n - 1, F.lag("rest", n - 1).over(Window.partitionBy("run").orderBy("i"))))
    both = {"low": F.least("begun.low", "before.low"), "high": F.greatest("begun.high", "before.high"), "n": F.col("begun.n") + F.coalesce("before.n", F.lit(0))}
    return rows.withColumns(both).select(*shown)


def quotient(a: Column, b: Column) -> Column:
    """a / b by IEEE 754: over zero it is infinite, or NaN for zero over zero."""
    nan, sign = F.lit(float("nan")), F.when(b.cast("double").cast("string").startswith("-"), -1.0).otherwise(1.0)
    over_zero = F.when((a == 0) | F.isnan(a.cast("double")), nan).when(a > 0, sign * float("inf")).when(a < 0, -sign * float("inf"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def variability(log: DataFrame, column: str = "kmpp", n: int = LAST_N, over: Column | None = None) -> DataFrame:
    """(max - min) of the last n rows over the latest value, or over ``over``."""
    w = last_n(log, column, n)
    base = F.col(column) if over is None else over
    return w.select("run", "generation", quotient(F.col("high") - F.col("low"), base).alias("variability"), "n")


def stopped(log: DataFrame, target_pop: float, n: int = LAST_N, least: float = GIVE_UP) -> DataFrame:
    """First generation of each run at which both variabilities over n full rows fall below ``least``."""
    a, b = variability(log, "kmpp", n), variability(log, "spread", n, F.lit(target_pop)).select("run", "generation", F.col("variability").alias("spread_var"))
    low = a.join(b, ["run", "generation"]).where((F.col("n") >= n) & (F.col("variability") < least) & (F.col("spread_var") < least))
    return low.groupBy("run").agg(F.min("generation").alias("stop"))


def range_variability(log: DataFrame, column: str, back: int = 1000) -> DataFrame:
    """(max - min) / latest over the previous ``back`` generations, both ends included."""
    w = Window.partitionBy("run").orderBy("generation").rangeBetween(-back, 0)
    return log.select("run", "generation", quotient(F.max(column).over(w) - F.min(column).over(w), F.col(column)).alias("variability"))


def carry_generation(lines: DataFrame) -> DataFrame:
    """The last generation seen carried onto following lines.  lines: run, line_no, generation."""
    w = Window.partitionBy("run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("generation", F.last("generation", ignorenulls=True).over(w))


def after_last_gap(log: DataFrame, open_col: str) -> DataFrame:
    """Rows of each run behind the last one that still had unassigned people."""
    last = F.max(F.when(F.col(open_col) > 0, F.col("generation"))).over(Window.partitionBy("run"))
    return log.withColumn("__last", last).where(F.col("__last").isNull() | (F.col("generation") > F.col("__last"))).drop("__last")


def running_best(log: DataFrame, column: str) -> DataFrame:
    """Rows that beat all before them in their run; ties don't."""
    before = F.min(column).over(Window.partitionBy("run").orderBy("generation").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(column) < F.col("__before"))).drop("__before")


def rank_by_population(pops: DataFrame) -> DataFrame:
    """Order in which districts take their turn: fewest people first."""
    return pops.select("district", "pop", F.row_number().over(Window.orderBy("pop", "district")).alias("turn"))  # a row a district


def top_left_rank(blocks: DataFrame) -> DataFrame:
    """Districts numbered by their topmost, then leftmost point."""
    corner = blocks.where("district IS NOT NULL").groupBy("district").agg(F.max(F.struct("lat", (-F.col("lon")).alias("west"))).alias("c"))
    w = Window.orderBy(F.col("c.lat").desc(), F.col("c.west").desc(), "district")
    return corner.select("district", (-F.col("c.west")).alias("x"), F.col("c.lat").alias("y"), (F.row_number().over(w) - 1).alias("number"))


def best_per(rows: DataFrame, key: str, metric: str, first: str) -> DataFrame:
    """The row with the least metric of each key; the earliest by ``first`` among equals."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(metric).isNotNull())
    return kept.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(metric, first)).alias("r")).select(key, "r.*")


def nth_best(rows: DataFrame, key: str, metric: str, n: int = 10) -> DataFrame:
    """The n-th least positive metric of each key that has n of them.

    Keeps only n values a key and task: each task sorts its own, so a key with many rows is no
    bottleneck.
    """
    positive = rows.where(F.col(metric) > 0)
    smallest = F.slice(F.array_sort(F.collect_list(metric)), 1, n)
    part = positive.withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(256)))
    few = part.groupBy(key, "__part").agg(smallest.alias("v")).groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("v"))), 1, n).alias("v"))
    return few.where(F.size("v") >= n).select(key, F.get("v", F.lit(n - 1)).alias("threshold"))


def latest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("__r") <= n).drop("__r")


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each run, and its '#' lines wherever they stand."""
    r = F.row_number().over(Window.partitionBy("run").orderBy(F.col("line_no").desc()))
    return lines.withColumn("__r", r).where((F.col("__r") <= n) | F.col("line").startswith("#")).drop("__r")


def split_runs(runs: DataFrame, metric: str, keep: int) -> DataFrame:
    """Runs of each config by metric; ``bad`` marks all behind the best ``keep``."""
    r = F.row_number().over(Window.partitionBy("config").orderBy(metric, "run"))
    return runs.withColumn("rank", r).withColumn("bad", r > keep)


def failing(finishes: DataFrame, n: int, most: int) -> DataFrame:
    """Finishes at which at least ``most`` of the last n failed.  finishes: config, seq, ok."""
    w = Window.partitionBy("config").orderBy("seq").rowsBetween(-(n - 1), 0)
    bad = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)
    return finishes.select("config", "seq", bad.cast("long").alias("failed"), (bad >= most).alias("stop"))


def run_weights(counts: DataFrame) -> DataFrame:
    """10 for the config with fewest results down to 1; 10 for all if equal."""
    w = Window.partitionBy()
    share = F.try_divide((F.col("n") - F.min("n").over(w)).cast("double"), F.max("n").over(w) - F.min("n").over(w))
    return counts.select("config", "n", F.coalesce(10 - 9 * share, F.lit(10.0)).alias("weight"))


def weighted_pick(configs: DataFrame, u: float) -> DataFrame:
    """The config whose slice of the summed weights holds u in [0, 1); disabled ones have none."""
    own = configs.where(~F.coalesce("disabled", F.lit(False)))
    upto = F.sum("weight").over(Window.orderBy("name"))  # a row a config
    whole = F.sum("weight").over(Window.partitionBy())
    return own.withColumn("upto", upto).withColumn("whole", whole).where(F.col("upto") > u * F.col("whole")).orderBy("name").limit(1).select("name", "weight")


def send_decision(results: DataFrame) -> DataFrame:
    """Whether a result is worth sending: any, or within the config's limits where it has them."""
    within = lambda v, limit: F.coalesce(F.col(v) <= F.col(limit), F.lit(True))
    anything = F.coalesce("send_anything", F.lit(False))
    return results.withColumn("send", anything | (F.col("kmpp").isNotNull() & within("kmpp", "max_kmpp") & within("spread", "max_spread")))


def name_filter(configs: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Configs whose name matches an include pattern (any, if there are none) and no exclude pattern."""
    out = configs.where(~F.coalesce("disabled", F.lit(False)))
    if include:
        out = out.where(reduce(Column.__or__, (F.col("name").rlike(p) for p in include)))
    for p in exclude:
        out = out.where(~F.col("name").rlike(p))
    return out


def new_submissions(found: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    return found.join(known.select(key), key, "left_anti").dropDuplicates([key])


def election_totals(races: DataFrame) -> DataFrame:
    """Votes by state with a grand total (state null).  races: state, district, d, r, g, l, other."""
    parties = ["d", "r", "g", "l", "other"]
    return races.rollup("state").agg(*(F.sum(p).cast("long").alias(p) for p in parties))


def winners(races: DataFrame) -> DataFrame:
    """Votes of each race's winner and of all others."""
    parties = ["d", "r", "g", "l", "other"]
    top = F.greatest(*parties)
    return races.select("state", "district", top.alias("winner_votes"), (sum((F.col(p) for p in parties[1:]), F.col(parties[0])) - top).alias("other_votes"))


def label_winner(counts: DataFrame) -> DataFrame:
    """The most frequent label of each district; the larger label among equals.  counts: district, label, n."""
    return counts.groupBy("district").agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def overdue(runs: DataFrame, now: Column, limit_seconds: int = 6 * 3600) -> DataFrame:
    """Runs that have not ended within the time limit and are to be stopped.  runs: run, started, ended (null: running)."""
    until = F.coalesce("ended", now)
    seconds = (F.unix_micros(until) - F.unix_micros("started")) / 1_000_000
    return runs.withColumn("seconds", seconds).withColumn("stop", F.col("ended").isNull() & (F.col("seconds") > limit_seconds))


def late_sample(log: DataFrame, run: str = "run", at: str = "generation", n: int = 10, seed: int = 0) -> DataFrame:
    """``n`` rows of each run, drawn at random from the second half of its generations.

    Rows are put in the order of a hash of seed, run and generation, so reruns and other partitions draw the same; each task
    keeps its first ``n`` of a run before the shuffle.
    """
    middle = log.groupBy(F.col(run).alias("__run")).agg(((F.min(at) + F.max(at)) / 2).alias("__middle"))
    late = log.join(middle, F.col(run).eqNullSafe(F.col("__run"))).where(F.col(at) >= F.col("__middle")).select(*log.columns)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(run).cast("string"), F.col(at).cast("string")).cast("binary"))
    order = Window.partitionBy(run).orderBy(draw, at)
    return late.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")
