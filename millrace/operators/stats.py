"""Statistics of evaluations: classification, calibration, intervals, gates, resampling. Rows in, rows out."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6
Z95 = 1.959963984540054


def rounded(c: Column, name: str, places: int = PLACES) -> Column:
    return F.round(c, places).alias(name)


def safe(x: Column, y: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(empty))


def kept(rows: DataFrame) -> DataFrame:
    """rows as a table in the folder for checkpoints, read back, so that several readers don't compute them again; as they
    are where the session has no such folder."""
    spark = rows.sparkSession
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        return rows
    path = f"{path.rstrip('/')}/millrace/kept-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def running(rows: DataFrame, by: list, sums: dict[str, str]) -> DataFrame:
    """rows with sums of columns over all rows up to each one, in an order whose last part makes it unique.

    Rows are range partitioned; each partition adds up by itself, and then what the partitions before it hold. So no
    task sees more than its range, and what is broadcast is a row for each partition. Where the session has a folder for
    checkpoints, the partitioned rows are written there: a partition that is computed again has to be the same."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_part", F.spark_partition_id())
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        spark.sparkContext.setCheckpointDir(path)
        dealt = dealt.checkpoint()
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    here = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "_part")
    for c, name in sums.items():
        out = out.withColumn(name, F.sum(c).over(here) + F.col(f"_{c}"))
    return out.drop("_part", *[f"_{c}" for c in sums])


def binary_scores(rows: DataFrame, gold: str, said: str, empty: float = 0.0) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of boolean columns."""
    g, p = F.col(gold), F.col(said)
    n = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    pr, re = safe(F.col("tp"), F.col("tp") + F.col("fp"), empty), safe(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return n.select("*", rounded(pr, "precision"), rounded(re, "recall"), rounded(safe(2 * pr * re, pr + re), "f1"), rounded(safe(F.col("tp") + F.col("tn"), total), "accuracy"))


def auc(rows: DataFrame, gold: str, score: str, empty: float = 0.5) -> DataFrame:
    """Area under the ROC curve by counts of each distinct score: ties count a half; an empty side gives `empty`."""
    by = rows.groupBy(score).agg(F.sum(F.col(gold).cast("long")).alias("pos"), F.sum((~F.col(gold)).cast("long")).alias("neg"))
    cum = running(by, [score], {"neg": "upto"}).withColumn("below", F.col("upto") - F.col("neg"))
    s = cum.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(rounded(safe(F.col("u"), F.col("p") * F.col("n"), empty), "auc"))


def thresholds(rows: DataFrame, gold: str, score: str) -> DataFrame:
    """At each distinct score as threshold (score >= threshold is positive): tpr, fpr, precision, Youden's J."""
    by = rows.groupBy(score).agg(F.sum(F.col(gold).cast("long")).alias("pos"), F.sum((~F.col(gold)).cast("long")).alias("neg"))
    total = rows.agg(F.sum(F.col(gold).cast("long")).alias("p"), F.sum((~F.col(gold)).cast("long")).alias("n"))
    cum = running(by, [F.desc(score)], {"pos": "tp", "neg": "fp"}).select(F.col(score).alias("threshold"), "tp", "fp").join(F.broadcast(total))
    tpr, fpr = safe(F.col("tp"), F.col("p")), safe(F.col("fp"), F.col("n"))
    return cum.select("threshold", "tp", "fp", rounded(tpr, "tpr"), rounded(fpr, "fpr"), rounded(safe(F.col("tp"), F.col("tp") + F.col("fp")), "precision"), rounded(tpr - fpr, "youden"))


def youden_best(sweep: DataFrame) -> DataFrame:
    """The threshold of greatest J, the lowest of several."""
    return sweep.orderBy(F.desc("youden"), "threshold").limit(1)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two raters; 0 where chance alone agrees always."""
    cells = rows.groupBy(a, b).count()
    n = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("count")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col(a).alias("c")).agg(F.sum("count").alias("x"))
    right = cells.groupBy(F.col(b).alias("c")).agg(F.sum("count").alias("y"))
    chance = left.join(right, "c").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return n.join(chance).select("n", rounded(po, "agreement"), rounded(F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe)), "kappa"))


def reliability(rows: DataFrame, right: str, confidence: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence, 1 in the last, empty ones left out: count, accuracy, mean confidence, gap."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins)).cast("int")
    out = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return out.select("bin", "n", rounded(F.col("acc"), "accuracy"), rounded(F.col("conf"), "confidence"), rounded(F.abs(F.col("acc") - F.col("conf")), "gap"))


def calibration(rows: DataFrame, right: str, confidence: str, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error, Brier score of confidence."""
    t = reliability(rows, right, confidence, bins)
    e = t.agg(rounded(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), "ece", 5), rounded(F.max("gap"), "mce", 5))
    d = F.col(confidence) - F.col(right).cast("double")
    return e.join(rows.agg(rounded(F.avg(d * d), "brier", 5)))


def risk_coverage(rows: DataFrame, key: str, right: str, trust: str) -> DataFrame:
    """(place, key, coverage, risk): error rate of the first rows by falling trust, ties by key."""
    n = rows.agg(F.count("*").alias("n"))
    rows = rows.select(key, trust, F.lit(1).cast("long").alias("one"), (~F.col(right)).cast("long").alias("bad"))
    out = running(rows, [F.desc(trust), F.asc(key)], {"one": "at", "bad": "wrong"}).withColumn("place", F.col("at").cast("int")).join(F.broadcast(n))
    return out.select("place", key, rounded(F.col("place") / F.col("n"), "coverage"), rounded(F.col("wrong") / F.col("place"), "risk"))


def aurc(curve: DataFrame) -> DataFrame:
    return curve.agg(rounded(F.avg("risk"), "aurc", 5), rounded(F.max(F.when(F.col("risk") <= 0.25, F.col("coverage"))), "coverage_at_risk"))


def wilson(rows: DataFrame, by: str, hit: str, z: float = Z95) -> DataFrame:
    """Share of hits of each group with its Wilson score interval."""
    t = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("k"))
    n, p = F.col("n"), F.col("k") / F.col("n")
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return t.select(by, "n", "k", rounded(p, "share"), rounded(F.greatest(F.lit(0.0), (mid - half) / den), "low"), rounded(F.least(F.lit(1.0), (mid + half) / den), "high"))


def benjamini_hochberg(rows: DataFrame, key: str, p: str, q: float = 0.05) -> DataFrame:
    """(key, p, place, rejected): step-up; all up to the last p <= q * place / m are rejected."""
    m = rows.agg(F.count("*").alias("m"))
    r = rows.select(key, F.col(p).alias("p"), F.lit(1).cast("long").alias("one"))
    r = running(r, ["p", key], {"one": "at"}).withColumn("place", F.col("at").cast("int")).join(F.broadcast(m))
    last = r.agg(F.max(F.when(F.col("p") <= q * F.col("place") / F.col("m"), F.col("place"))).alias("last"))
    return r.join(F.broadcast(last)).select(key, "p", "place", (F.col("place") <= F.coalesce("last", F.lit(0))).alias("rejected"))


def quantiles(rows: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.25, 0.5, 0.95)) -> DataFrame:
    """Quantiles by linear interpolation."""
    return rows.groupBy(by).agg(*[rounded(F.percentile(value, q), f"q{round(q * 100)}") for q in at])


def draws(items: DataFrame, rounds: int) -> DataFrame:
    """items (i from 0, ..., n) drawn with replacement in each round: (round, j, i). The draw is the first eight
    hexadecimal digits of MD5 of round and place, modulo n, so that it can be made again anywhere."""
    n = items.agg(F.count("*").alias("n"))
    cells = items.select(F.col("i").alias("j")).join(F.broadcast(n)).select("j", "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", "round", "j").cast("binary")), 1, 8), 16, 10).cast("long")
    return cells.select("round", "j", (h % F.col("n")).alias("i"))


def bootstrap(items: DataFrame, value: str, rounds: int = 500, level: float = 0.95) -> DataFrame:
    """Mean, its percentile interval, and the shares of resampled means <= 0 and >= 0. items: (i, value)."""
    means = draws(items, rounds).join(items.select("i", value), "i").groupBy("round").agg(F.round(F.avg(value), 9).alias("m"))
    tail = (1 - level) / 2
    ci = means.agg(
        rounded(F.percentile("m", tail), "low"), rounded(F.percentile("m", 1 - tail), "high"),
        rounded(F.avg((F.col("m") <= 0).cast("double")), "p_le_zero"), rounded(F.avg((F.col("m") >= 0).cast("double")), "p_ge_zero"),
    )
    return items.agg(rounded(F.avg(value), "mean")).join(ci)


def growth(rows: DataFrame, size: str, value: str) -> DataFrame:
    """Exponent of growth: the least-squares slope of ln value on ln size."""
    return rows.select(F.log(size).alias("x"), F.log(value).alias("y")).agg(rounded(F.regr_slope("y", "x"), "exponent"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def signals(probs: Column) -> list[Column]:
    """Confidence, margin of the top two, negative entropy of a probability row."""
    s = F.sort_array(probs, asc=False)
    h = F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return [rounded(s[0], "confidence"), rounded(s[0] - F.get(s, F.lit(1)), "margin"), rounded(h, "neg_entropy")]


def gates(outcomes: DataFrame, by: str, old: str, new: str, most: float = 0.02, q: float = 0.025) -> DataFrame:
    """Regression gates over paired 0/1 outcomes, by slice: the drop, whether the naive gate fails, a one-sided
    sign-test p (normal approximation) and the Bonferroni and step-up decisions over the slices."""
    d = F.col(new).cast("int") - F.col(old).cast("int")
    t = outcomes.groupBy(by).agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.count_if(d < 0).alias("lost"), F.count_if(d > 0).alias("won"))
    z = (F.col("lost") - F.col("won") - 1) / F.sqrt(F.greatest(F.lit(1), F.col("lost") + F.col("won")))
    p = F.round(1 / (1 + F.exp(1.702 * z)), PLACES)  # logistic approximation of the normal tail
    t = t.withColumn("p", p)
    m = t.agg(F.count("*").alias("m"))
    bh = benjamini_hochberg(t, by, "p", q).select(by, F.col("rejected").alias("bh"))
    return t.join(F.broadcast(m)).join(bh, by).select(by, "n", rounded(F.col("delta"), "delta"), "lost", "won", "p", (F.col("delta") < -most).alias("naive"), (F.col("p") <= q / F.col("m")).alias("bonferroni"), "bh")


def normal_quantile(level: float) -> float:
    """z of a two-sided level, by bisection of the error function."""
    lo, hi = 0.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < level else (lo, mid)
    return lo
