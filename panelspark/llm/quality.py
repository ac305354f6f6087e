"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each text is counted over once. Texts that pass the base rules become vectors of transformed statistics in whole units,
equal vectors of a language and source are counted together, and for each of these groups the minimum covariance
determinant is sought: from three deterministic starts (medians with quartile ranges, spatial signs about the medians,
plain moments) the vectors nearest by Mahalanobis distance, `SHARE` of all, give the next mean and covariance, as long as
the determinant falls; the start with the smallest determinant wins and is reweighted once. A text is rejected when its
distance from its group's estimate is beyond the cutoff.

Sums are whole numbers, so results do not depend on the order of rows. A step reads the counted vectors once: distances
fall into buckets whose moments are summed by group, and the buckets up to the share are added up. What a task holds of a
group is its buckets, however many rows it has; groups are joined as a small table, or by Spark's own choice beyond that.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, written
from panelspark.llm.exact_dedup import once

LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
#: Transformed statistics are whole multiples of 1/UNIT.
UNIT = 1000
#: The statistics of a vector and the smallest standard deviation that each is taken to have: a group whose texts are all
#: alike in one (no symbols at all, say) has no variance there, and no determinant without it.
FLOORS = {"length": 0.02, "symbols": 0.04, "lines": 0.2, "repeats": 0.2}
#: Share of a group's vectors that the estimate is made from.
SHARE = 0.75
#: A group with fewer vectors is judged by the estimate of all texts together.
LEAST_ROWS = 50
#: Vectors within this quantile of the raw estimate make the reweighted one; texts beyond CUTOFF of that are rejected.
REWEIGHT, CUTOFF = 0.975, 1 - 1e-8
MOST_STEPS = 30
#: Buckets of distance: so many to a unit of ln(1 + squared distance).
BUCKETS = 64
#: A table of so many groups at most (some megabytes) is sent to all tasks, so that a hot group's rows stay where they are;
#: beyond it Spark joins as it sees fit, and splits the rows of a hot group.
SENT_GROUPS = 10_000
POOLED = "*"
D = len(FLOORS)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def chi2_cdf(x: float, even: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def chi2_quantile(p: float, even: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, even) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal vectors is to be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


def repeated_words(words: Column) -> Column:
    """Number of an array's words that lie in a window of three words that occurs twice or more in it: windows are sorted
    with their places, and those equal to a neighbour cover three places each."""
    n = F.size(words)
    windows = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("at")), 1, F.greatest(n - 2, F.lit(0)))

    def places(s: Column) -> Column:
        same = lambda x, y: (x["b"] == y["b"]) & (x["c"] == y["c"]) & (x["a"] == y["a"])
        near = lambda x, j: F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))
        return F.transform(F.filter(s, near), lambda x: x["at"])

    def covered(p: Column) -> Column:
        later = lambda k: F.transform(p, lambda i: i + k)
        return F.size(F.array_distinct(F.concat(*[later(k) for k in range(WINDOW)])))

    return F.when(n < WINDOW, F.lit(0)).otherwise(once(once(F.sort_array(windows), places), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text: n_words, word_chars, n_symbols, n_lines (those with a word),
    n_dup_lines, n_repeat_words, all long, and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        once(F.array_remove(F.split(text, f"{SPACE}+"), ""), of_words).alias("w"),
        once(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), of_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    names = ["w.n_words", "w.word_chars", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines"]
    rows = rows.select("doc_id", "lang", "source", *[F.col(n).cast("long").alias(n[2:]) for n in names], "n_symbols")
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def vectors_of(stats: DataFrame) -> DataFrame:
    """stats with grp (of language and source, null being one of its own) and v0 to v3: the logarithm of the mean word
    length and the square roots of the shares of symbols, repeated lines and repeated words, in units of 1/UNIT."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [F.ln(F.greatest(F.col("word_chars") / F.greatest("n_words", F.lit(1)), F.lit(1.0))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.withColumn("grp", F.to_json(F.struct("lang", "source"))).select("*", *[F.round(UNIT * v).cast("long").alias(f"v{i}") for i, v in enumerate(values)])


def _moments(count: Column, names: str = "v") -> list[Column]:
    x = [F.col(f"{names}{i}") for i in range(D)]
    return [F.sum(count).alias("n"), *[F.sum(count * x[i]).alias(f"s{i}") for i in range(D)], *[F.sum(count * x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]]


def _estimate(moments: DataFrame, factor: float, *keys: str) -> DataFrame:
    """keys, n, means m and covariances c (times factor, floors added) from sums."""
    n = F.col("n")
    mean = [F.col(f"s{i}") / n for i in range(D)]
    floors = [(UNIT * f) ** 2 for f in FLOORS.values()]
    cov = lambda i, j: factor * (F.col(f"q{i}{j}") / n - mean[i] * mean[j]) + (F.lit(floors[i]) if i == j else F.lit(0.0))
    return moments.select(*keys, "n", *[mean[i].alias(f"m{i}") for i in range(D)], *[cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS])


def _factored(estimate: DataFrame, *keys: str) -> DataFrame:
    """keys, n, m, the inverse w of the covariance's Cholesky factor, and the logarithm of its determinant."""
    out = estimate
    for i, j in PAIRS:
        less = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        rest = F.col(f"c{i}{j}") - less
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(D):
        for j in range(i, -1, -1):
            less = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)], F.lit(0.0))
            out = out.withColumn(f"w{i}{j}", (F.lit(1.0) if i == j else -less) / F.col(f"l{i}{i}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.ln(f"l{i}{i}") for i in range(D)])
    return out.select(*keys, "n", *[f"m{i}" for i in range(D)], *[f"w{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def _distance(p: str = "") -> Column:
    """Squared Mahalanobis distance of v from the estimate beside it."""
    x = [F.col(f"v{i}") - F.col(f"{p}m{i}") for i in range(D)]
    parts = [reduce(lambda a, b: a + b, [F.col(f"{p}w{i}{j}") * x[j] for j in range(i + 1)]) for i in range(D)]
    return reduce(lambda a, b: a + b, [y * y for y in parts])


def _small(groups: DataFrame) -> DataFrame:
    """A written table of groups, marked for broadcast if it is counted to have SENT_GROUPS rows at most."""
    return F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups


def _starts(counted: DataFrame) -> DataFrame:
    """grp, start and a first estimate, three of each group."""
    w = Window.partitionBy("grp", "dim").orderBy("value")
    values = counted.select("grp", "cnt", F.posexplode(F.array(*[f"v{i}" for i in range(D)])).alias("dim", "value")).groupBy("grp", "dim", "value").agg(F.sum("cnt").alias("k"))
    ranked = values.withColumn("upto", F.sum("k").over(w)).withColumn("all", F.sum("k").over(Window.partitionBy("grp", "dim")))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("value")))
    quartiles = ranked.groupBy("grp", "dim").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    floors = F.array(*[F.lit((UNIT * f) ** 2) for f in FLOORS.values()])
    spread = F.sqrt(F.pow((F.col("high") - F.col("low")) / (2 * 0.6745), 2) + F.get(floors, F.col("dim")))
    of_dims = lambda c, n: [F.max(F.when(F.col("dim") == i, F.col(c).cast("double"))).alias(f"{n}{i}") for i in range(D)]
    middle = quartiles.withColumn("spread", spread).groupBy("grp").agg(*of_dims("mid", "m"), *of_dims("spread", "d"))
    middle = written(middle, "quartiles")
    n = F.lit(None).cast("long").alias("n")
    means = [F.col(f"m{i}") for i in range(D)]
    plain = middle.select("grp", F.lit("quartiles").alias("start"), n, *means, *[(F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    from_middle = [(F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(D)]
    away = F.sqrt(reduce(lambda a, b: a + b, [z * z for z in from_middle]))
    signs = counted.join(_small(middle), "grp").select("grp", "cnt", *[F.round(UNIT * F.coalesce(F.try_divide(z, away), F.lit(0.0))).cast("long").alias(f"u{i}") for i, z in enumerate(from_middle)]).groupBy("grp").agg(*_moments(F.col("cnt"), "u"))
    unit = lambda i, j: F.col(f"d{i}") * F.col(f"d{j}") * (D * F.col(f"q{i}{j}") / F.col("n") / UNIT**2 + (F.lit(0.01) if i == j else F.lit(0.0)))
    signs = signs.join(middle, "grp").select("grp", F.lit("signs").alias("start"), n, *means, *[unit(i, j).alias(f"c{i}{j}") for i, j in PAIRS])
    moments = _estimate(counted.groupBy("grp").agg(*_moments(F.col("cnt"))), 1.0, "grp").withColumn("start", F.lit("moments"))
    return plain.unionByName(signs).unionByName(moments)


def _step(counted: DataFrame, now: DataFrame) -> DataFrame:
    """The estimate, of each group and start, from the nearest SHARE of the vectors (whole buckets of distance)."""
    bucket = F.floor(BUCKETS * F.ln(1 + _distance())).alias("bucket")
    sums = counted.join(_small(now.drop("n")), "grp").groupBy("grp", "start", bucket).agg(*_moments(F.col("cnt")))
    w = Window.partitionBy("grp", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("_before", before).withColumn("_all", F.sum("n").over(w)).filter(F.col("_before") < SHARE * F.col("_all"))
    total = near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(D)], *[f"q{i}{j}" for i, j in PAIRS])])
    return _factored(_estimate(total, consistency(SHARE), "grp", "start"), "grp", "start")


def estimates(stats: DataFrame) -> DataFrame:
    """grp, n (vectors of the group), m and w of the reweighted minimum covariance determinant estimate of each group with
    LEAST_ROWS vectors or more, and of all texts together as group POOLED. stats: vectors_of() the texts."""
    names = [f"v{i}" for i in range(D)]
    fit = stats.filter("not base_failed")
    each = written(fit.groupBy("grp", *names).agg(F.count("*").alias("cnt")), "vectors")
    enough = each.groupBy("grp").agg(F.sum("cnt").alias("n")).filter(F.col("n") >= LEAST_ROWS).select("grp")
    pooled = each.groupBy(*names).agg(F.sum("cnt").alias("cnt")).withColumn("grp", F.lit(POOLED))
    counted = written(each.join(_small(written(enough, "enough")), "grp", "left_semi").unionByName(pooled), "counted")
    # a first step makes the three starts comparable: each then is the estimate of a share of the vectors
    starts = written(_factored(_starts(counted), "grp", "start"), "starts")
    now = written(_step(counted, starts), "estimate")
    for _ in range(MOST_STEPS):
        new = _step(counted, now)
        old = now.select("grp", "start", *[F.col(c).alias(f"_{c}") for c in now.columns if c not in ("grp", "start")])
        better = F.col("logdet") < F.col("_logdet") - 1e-9
        joined = new.join(old, ["grp", "start"]).select("grp", "start", *[F.when(better, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in now.columns if c not in ("grp", "start")], better.alias("better"))
        joined = written(joined, "estimate")
        now = joined.drop("better")
        if joined.filter("better").isEmpty():
            break
    first = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))
    best = written(now.withColumn("_rn", first).filter("_rn = 1").drop("_rn", "n"), "best")
    inside = counted.join(_small(best), "grp").filter(_distance() <= chi2_quantile(REWEIGHT, D)).groupBy("grp").agg(*_moments(F.col("cnt")))
    return written(_factored(_estimate(inside, consistency(REWEIGHT), "grp"), "grp"), "mcd")


def assess(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    distance (squared, from the estimate of its language and source).

    Null and empty texts have no words and fail the base rules, as do texts under LEAST_WORDS words; the distance of a
    text that failed them is null. Documents of a group (a missing language or source makes groups of its own) with
    fewer than LEAST_ROWS texts that passed are judged by the estimate of all documents. Rows that repeat a doc_id, or
    lack one, are documents of their own. Extra columns are ignored; no rows in, none out.
    """
    stats = written(vectors_of(statistics(docs)), "statistics")
    found = estimates(stats)
    own = _small(found.filter(F.col("grp") != POOLED).select(F.col("grp").alias("_own")))
    judged = stats.join(own, F.col("grp") == F.col("_own"), "left").withColumn("_fit", F.coalesce("_own", F.lit(POOLED))).drop("_own")
    out = judged.join(_small(found.drop("n", "logdet").withColumnRenamed("grp", "_of")), F.col("_fit") == F.col("_of"), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(distance <= chi2_quantile(CUTOFF, D), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))
