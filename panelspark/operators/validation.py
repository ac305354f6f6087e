"""Purged and combinatorial cross-validation, out-of-sample paths, overfitting probability, verdicts.

Returns are long: config_id, date, ret, and where keys are given (a symbol, say) those too: each is judged by itself. Rows x splits is never formed for the selection: a split's statistics are sums
over groups, so each configuration is reduced to a few sums a group once, and the split table, whose size is fixed by
the numbers of groups, is joined to those.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.positions import as_of
from panelspark.functions.windows import series
from panelspark.operators.metrics import YEAR, deflated_sharpe, distribution, performance
from panelspark.operators.rolling import drawdowns

TINY = 1e-12
LEAST_TRAIN = 50


def aligned(returns: DataFrame) -> DataFrame:
    """The dates on which every configuration has a return."""
    n = returns.agg(F.countDistinct("config_id").alias("n_configs"))
    full = returns.filter("ret is not null").groupBy("date").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_configs"), "left_semi")
    return returns.join(full.select("date"), "date", "left_semi")


def contiguous(rows: DataFrame, groups: int, name: str) -> DataFrame:
    """rows with the number (from 1) of their near-equal contiguous group, worked out from row (0-based) and the number of
    rows: the first groups are a row longer. No task sees all rows in order."""
    n = rows.agg(F.count("*").alias("_t"))
    size, longer = F.floor(F.col("_t") / groups), F.col("_t") % groups
    head = longer * (size + 1)
    group = F.when(F.col("row") < head, F.floor(F.col("row") / (size + 1))).otherwise(longer + F.floor((F.col("row") - head) / F.greatest(size, F.lit(1)))) + 1
    return rows.crossJoin(F.broadcast(n)).withColumn(name, group.cast("int")).drop("_t")


def purged_kfold(rows: DataFrame, folds: int, embargo: int, strict: bool = True) -> DataFrame:
    """fold, row, role of every row in every fold. Test: the fold's contiguous rows. Train: rows whose label ends before
    the fold's first date (at it, if not strict), and those from `embargo` rows after the position of the fold's last
    label end on.

    rows: row (0-based), date, label_end.
    """
    marked = contiguous(rows, folds, "_fold")
    bounds = marked.groupBy("_fold").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("date").alias("t0"), F.max("label_end").alias("t1"))
    after = as_of(rows, "date", "row", bounds, "t1", "last")
    before = F.col("label_end") < F.col("t0") if strict else F.col("label_end") <= F.col("t0")
    role = F.when(F.col("row").between(F.col("a"), F.col("b")), "test").when(before | (F.col("row") > F.col("last") + embargo), "train").otherwise("purged")
    return rows.crossJoin(F.broadcast(after)).select(F.col("_fold").alias("fold"), "row", role.alias("role"))


def split_table(spark, groups: int, k: int) -> DataFrame:
    """split_id (in order of combination), grp (from 1), role test or train, and how many groups before it the last test group
    lies (NULL: none does): fixed by the two numbers."""
    since = lambda g, c: g - max([t for t in c if t < g], default=g) or None
    rows = [(s, g + 1, "test" if g in c else "train", since(g, c)) for s, c in enumerate(combinations(range(groups), k)) for g in range(groups)]
    return spark.createDataFrame(rows, "split_id int, grp int, role string, since int")


def n_paths(groups: int, k: int) -> int:
    return comb(groups, k) * k // groups


def combinatorial_splits(rows: DataFrame, groups: int, k: int, embargo: int) -> DataFrame:
    """split_id, row, role: test, train, or embargoed (the rows directly after a test group). rows: row (0-based)."""
    marked = contiguous(rows, groups, "grp")
    ends = marked.groupBy("grp").agg(F.max("row").alias("end"))
    splits = split_table(rows.sparkSession, groups, k)
    tests = splits.filter("role = 'test'").join(ends, "grp").groupBy("split_id").agg(F.collect_list("end").alias("ends"))
    dealt = marked.join(F.broadcast(splits), "grp").join(F.broadcast(tests), "split_id", "left")
    late = F.coalesce(F.exists("ends", lambda e: (F.col("row") > e) & (F.col("row") <= e + embargo)), F.lit(False))
    return dealt.select("split_id", "row", F.when(F.col("role") == "test", "test").when(late, "embargoed").otherwise("train").alias("role"))


def group_sums(returns: DataFrame, groups: int, embargo: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, config_id, grp, reach: n, s, q (rows, sum, sum of squares) of the group's rows with this reach, the number of
    groups by which the row that lies an embargo (a share of all rows) before a row is in an earlier group. A row is
    embargoed after a test group if that is at most its reach before its own; so any embargo, longer than a group or
    not, is a choice of sums."""
    by = Window.partitionBy(*keys, "config_id")
    rows = returns.withColumn("_p", F.row_number().over(series(*keys, "config_id"))).withColumn("_t", F.count("*").over(by))
    size, longer = F.floor(F.col("_t") / groups), F.col("_t") % groups
    head = longer * (size + 1)
    # the first groups are a row longer
    group = lambda p: F.when(p <= head, F.ceil(p / (size + 1))).otherwise(longer + F.ceil((p - head) / F.greatest(size, F.lit(1)))).cast("int")
    rows = rows.withColumn("grp", group(F.col("_p"))).withColumn("_lo", group(F.greatest(F.col("_p") - F.floor(F.col("_t") * embargo), F.lit(1))))
    r = F.col("ret")
    return rows.groupBy(*keys, "config_id", "grp", (F.col("grp") - F.col("_lo")).alias("reach")).agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))


def sharpe_of_sums(n, s, q):
    mean = s / n
    return mean / (F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0))) + TINY)


def selections(returns: DataFrame, groups: int = 10, k: int = 2, embargo: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, split_id and the configuration with the best in-sample ratio (the first of equal ones); splits with fewer than 50
    train rows are left out. Rows within an embargo after a test group, however long it is, are not trained on."""
    train = split_table(returns.sparkSession, groups, k).filter("role = 'train'").drop("role")
    sums = group_sums(returns, groups, embargo, keys).join(F.broadcast(train), "grp").filter(F.col("since").isNull() | (F.col("reach") < F.col("since")))
    each = sums.groupBy(*keys, "split_id", "config_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    each = each.filter(F.col("n") >= LEAST_TRAIN).withColumn("score", sharpe_of_sums(F.col("n"), F.col("s"), F.col("q")))
    first = F.row_number().over(Window.partitionBy(*keys, "split_id").orderBy(F.desc("score"), "config_id"))
    return each.withColumn("_rn", first).filter("_rn = 1").select(*keys, "split_id", F.col("config_id").alias("selected"), "score")


def path_segments(selected: DataFrame, spark, groups: int = 10, k: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, path, grp, selected: path p takes, in each group, the p-th split that tested it; paths lacking a group go."""
    tested = split_table(spark, groups, k).filter("role = 'test'").join(selected, "split_id")
    w = Window.partitionBy(*keys, "grp").orderBy("split_id")
    paths = tested.withColumn("path", F.row_number().over(w)).filter(F.col("path") <= n_paths(groups, k))
    whole = F.count("*").over(Window.partitionBy(*keys, "path"))
    return paths.withColumn("_n", whole).filter(F.col("_n") == groups).select(*keys, "path", "grp", "selected")


def path_returns(returns: DataFrame, groups: int = 10, k: int = 2, embargo: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, path, date, selected, ret of the out-of-sample paths."""
    segments = path_segments(selections(returns, groups, k, embargo, keys), returns.sparkSession, groups, k, keys).withColumnRenamed("selected", "config_id")
    rows = returns.withColumn("grp", F.ntile(groups).over(series(*keys, "config_id")))
    return rows.join(segments, [*keys, "grp", "config_id"]).select(*keys, "path", "date", F.col("config_id").alias("selected"), "ret")


def path_sharpes(returns: DataFrame, groups: int = 10, k: int = 2, embargo: float = 0.01) -> DataFrame:
    paths = path_returns(returns, groups, k, embargo)
    return paths.groupBy("path").agg(F.count("*").alias("n"), (F.avg("ret") / (F.stddev_pop("ret") + TINY) * YEAR**0.5).alias("sharpe"))


def _ratios(rows: DataFrame, ret: str, tag: str, by: tuple[str, ...]) -> DataFrame:
    out = drawdowns(rows, ret, by).groupBy(*by).agg(F.count("*").alias("_n"), F.coalesce(F.try_divide(F.avg(ret), F.stddev_pop(ret)) * YEAR**0.5, F.lit(0.0)).alias(f"sharpe_{tag}"), F.max("dd").alias(f"maxdd_{tag}"), F.product(1 + F.col(ret)).alias("_g"))
    growth = F.pow("_g", F.lit(float(YEAR)) / F.col("_n")) - 1
    return out.withColumn(f"calmar_{tag}", F.when(F.col(f"maxdd_{tag}") > 1e-9, growth / F.col(f"maxdd_{tag}"))).drop("_n", "_g")


def paired_paths(returns: DataFrame, benchmark: DataFrame, groups: int = 10, k: int = 2, embargo: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per path: Sharpe, largest drawdown and Calmar of strategy (s) and benchmark (b), and the drawdown saved. A date
    that the benchmark (keys, date, bench) lacks counts as 0."""
    by = (*keys, "path")
    rows = path_returns(returns, groups, k, embargo, keys).join(benchmark, [*keys, "date"], "left").withColumn("bench", F.coalesce("bench", F.lit(0.0)))
    return _ratios(rows, "ret", "s", by).join(_ratios(rows, "bench", "b", by), list(by)).withColumn("d_maxdd", F.col("maxdd_b") - F.col("maxdd_s"))


def overfitting(returns: DataFrame, groups: int = 10) -> DataFrame:
    """split_id, selected, rank (the in-sample best's out-of-sample relative rank), logit: all half-splits of the groups."""
    sums = group_sums(returns, groups)
    each = sums.join(F.broadcast(split_table(returns.sparkSession, groups, groups // 2)), "grp").groupBy("split_id", "config_id", "role").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    score = sharpe_of_sums(F.col("n"), F.col("s"), F.col("q"))
    # in this table the chosen half is called test; it is the one to select on
    sides = each.groupBy("split_id", "config_id").agg(F.max(F.when(F.col("role") == "test", score)).alias("inside"), F.max(F.when(F.col("role") == "train", score)).alias("outside"))
    w = Window.partitionBy("split_id")
    sides = sides.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("inside"), "config_id"))).withColumn("_best", F.max(F.when(F.col("_rn") == 1, F.col("outside"))).over(w))
    m = F.count("*").cast("double")
    out = sides.groupBy("split_id").agg(F.max(F.when(F.col("_rn") == 1, F.col("config_id"))).alias("selected"), F.least(F.greatest(F.count_if(F.col("outside") <= F.col("_best")) / m, 1 / (m + 1)), m / (m + 1)).alias("rank"))
    return out.withColumn("logit", F.ln(F.col("rank") / (1 - F.col("rank"))))


def overfitting_probability(returns: DataFrame, groups: int = 10) -> DataFrame:
    return overfitting(returns, groups).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def study_verdict(returns: DataFrame, trials: int = 20, dsr_gate: float = 0.95, pbo_gate: float = 0.05) -> DataFrame:
    """One row: the configuration selected most often, the out-of-sample Sharpe range, its deflated Sharpe, the
    overfitting probability, worst day, drawdown, and PASS or REJECT."""
    returns = aligned(returns)
    picked = selections(returns)
    top = picked.groupBy("selected").agg(F.count("*").alias("times"), F.min("split_id").alias("_first")).orderBy(F.desc("times"), "_first").limit(1).select(F.col("selected").alias("config_id"), "times")
    chosen = returns.join(F.broadcast(top.select("config_id")), "config_id", "left_semi")
    out = top.join(deflated_sharpe(chosen, trials).select("config_id", "sr", "sr0", "dsr"), "config_id").join(performance(chosen).select("config_id", "worst_day", "maxdd"), "config_id")
    range_ = distribution(path_sharpes(returns), "sharpe").select(F.col("n").alias("paths"), F.col("low").alias("sharpe_low"), F.col("median").alias("sharpe_median"), F.col("high").alias("sharpe_high"))
    out = out.crossJoin(range_).crossJoin(overfitting_probability(returns).select("pbo"))
    return out.withColumn("status", F.when((F.col("dsr") > dsr_gate) & (F.col("pbo") < pbo_gate), "PASS").otherwise("REJECT"))


def overlay_verdict(returns: DataFrame, benchmark: DataFrame, trials: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row a key: the full-sample best configuration, its deflated Sharpe, the distribution of the drawdown saved, and
    whether its 5th percentile is above 0. A key with no whole path has paths 0 and FAIL."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("sharpe", F.lit(float("-inf")))), "config_id"))
    best = performance(returns, (*keys, "config_id")).withColumn("_rn", first).filter("_rn = 1").select(*keys, "config_id")
    dsr = deflated_sharpe(returns.join(best, [*keys, "config_id"], "left_semi"), trials, (*keys, "config_id"))
    saved = distribution(paired_paths(returns, benchmark, keys=keys), "d_maxdd", keys).select(*keys, F.col("n").alias("paths"), F.col("median").alias("saved_median"), F.col("p5").alias("saved_p5"), F.col("positive").alias("saved_share"))
    out = dsr.select(*keys, "config_id", "sr", "sr0", "dsr").join(saved, list(keys), "left").withColumn("paths", F.coalesce("paths", F.lit(0)))
    return out.withColumn("mandate", F.when(F.col("saved_p5") > 0, "PASS").otherwise("FAIL"))
