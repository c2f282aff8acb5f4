"""Measures of classifiers and rankings beyond stats.py: likelihoods, selection, class tables, order statistics, studies.

Rows in, rows out; every measure is an aggregate with partial sums. Where an order over all rows is needed, rows are
first counted by distinct score, and running sums over those are taken by `stats.running`, in range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stats import rounded, running, safe


def fold(values: Column, f, start: float = 0.0) -> Column:
    return F.aggregate(values, F.lit(start), f)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Shifted by the greatest logit, so nothing overflows."""
    z = F.transform(logits, lambda x: x.cast("double") / temperature)
    top = F.array_max(z)
    total = F.log(fold(F.transform(z, lambda x: F.exp(x - top)), lambda a, x: a + x))
    return F.transform(z, lambda x: x - top - total)


def argmax(values: Column) -> Column:
    """Place of the greatest value from 0, the first of several."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def likelihood(rows: DataFrame, logits: str, label: str, temperature: float = 1.0) -> DataFrame:
    """(nll, accuracy, brier): mean -log p of the label, share of right predictions, mean squared distance of the
    probabilities to the one-hot label."""
    lp = rows.select(log_softmax(F.col(logits), temperature).alias("lp"), F.col(label).alias("y"))
    p = F.transform("lp", F.exp)
    right = F.element_at("lp", F.col("y") + 1)
    square = fold(p, lambda a, x: a + x * x) - 2 * F.exp(right) + 1
    return lp.agg(
        rounded(F.avg(-right), "nll", 5), rounded(F.avg((argmax(F.col("lp")) == F.col("y")).cast("double")), "accuracy"), rounded(F.avg(square), "brier", 5)
    )


def logit_margin(logits: Column) -> Column:
    s = F.sort_array(F.transform(logits, lambda x: x.cast("double")), asc=False)
    return s[0] - F.get(s, F.lit(1))


def selective(rows: DataFrame, right: str, confidence: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, coverage, accuracy) of the rows of at least that confidence; accuracy 1 where there is none."""
    total = rows.agg(F.count("*").alias("total"))
    t = rows.select(F.explode(F.array(*[F.when(F.col(confidence) >= x, F.lit(float(x))) for x in thresholds])).alias("threshold"), F.col(right).cast("int").alias("r"))
    got = t.where("threshold is not null").groupBy("threshold").agg(F.count("*").alias("n"), F.sum("r").alias("k"))
    every = rows.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    out = every.join(got, "threshold", "left").join(F.broadcast(total))
    return out.select("threshold", F.coalesce("n", F.lit(0)).alias("n"), rounded(safe(F.coalesce("n", F.lit(0)), F.col("total")), "coverage"), rounded(safe(F.col("k"), F.col("n"), 1.0), "accuracy"))


def aurc_bounds(rows: DataFrame, right: str) -> DataFrame:
    """(oracle_aurc, random_aurc): the mean risk when all errors come last, sum of max(0, i - right) / i over places i
    divided by n, and the error rate. The sum over the errors' places is that of harmonic terms."""
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("k"))
    places = n.select("n", "k", F.explode(F.when(F.col("n") > F.col("k"), F.sequence(F.col("k") + 1, F.col("n"))).otherwise(F.array())).alias("i"))
    s = places.agg(F.sum((F.col("i") - F.col("k")) / F.col("i")).alias("s"))
    return n.join(s).select(rounded(safe(F.coalesce("s", F.lit(0.0)), F.col("n")), "oracle_aurc", 5), rounded(1 - F.col("k") / F.col("n"), "random_aurc", 5))


def risk_at(curve: DataFrame, coverages: list[float]) -> DataFrame:
    """(coverage, risk): of a risk-coverage curve (place, risk) the risk at place ceil(coverage * n)."""
    n = curve.agg(F.max("place").alias("n"))
    wanted = curve.sparkSession.createDataFrame([(float(c),) for c in coverages], "at double").join(n).select("at", F.ceil(F.round(F.col("at") * F.col("n"), 9)).cast("int").alias("place"))
    return curve.join(F.broadcast(wanted), "place").select(F.col("at").alias("coverage"), "risk")


def class_stats(rows: DataFrame, by: str, value: str, classes: list[str]) -> DataFrame:
    """(class, n, mean, least, most) of each named class, zeros for those without rows."""
    got = rows.groupBy(F.col(by).alias("class")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    every = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return every.join(got, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), rounded(z("m"), "mean"), rounded(z("lo"), "least"), rounded(z("hi"), "most"))


def operating_table(rows: DataFrame, by: str, value: str, thresholds: list[float]) -> DataFrame:
    """(class, threshold, share): the share of a class's rows at or above each threshold."""
    t = rows.groupBy(F.col(by).alias("class")).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) >= x).alias(f"t{k}") for k, x in enumerate(thresholds)])
    cells = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), rounded(F.col(f"t{k}") / F.col("n"), "share")) for k, x in enumerate(thresholds)])
    return t.select("class", F.explode(cells).alias("c")).select("class", "c.threshold", "c.share")


def inversion_rate(rows: DataFrame, good: str, value: str) -> DataFrame:
    """(pairs, inverted, rate): of all pairs of a good and a bad row, those in which the bad one is higher."""
    by = rows.groupBy(F.col(value).alias("v")).agg(F.sum(F.col(good).cast("long")).alias("g"), F.sum((~F.col(good)).cast("long")).alias("b"))
    cum = running(by, ["v"], {"g": "upto"})
    s = cum.agg(F.sum(F.col("b") * (F.col("upto") - F.col("g"))).alias("inverted"), F.sum("g").alias("g"), F.sum("b").alias("b"))
    pairs = F.col("g") * F.col("b")
    return s.select(pairs.alias("pairs"), "inverted", rounded(safe(F.col("inverted"), pairs), "rate"))


def increases(rows: DataFrame, at: str, value: str) -> DataFrame:
    """(violations): how often a value rises from one place to the next; rows: a table of thresholds."""
    before = F.lag(value).over(Window.orderBy(at))
    return rows.select(F.col(value).alias("v"), before.alias("b")).agg(F.count_if(F.col("v") > F.col("b")).alias("violations"))


def decided(rows: DataFrame, gold: str, verdict: str, abstain: str = "abstain") -> DataFrame:
    """(n, coverage, decided_accuracy, effective_accuracy): accuracy of what was decided, and with half a point for each
    abstention; without decisions decided_accuracy is 0."""
    d = F.col(verdict) != abstain
    t = rows.agg(F.count("*").alias("n"), F.count_if(d).alias("d"), F.count_if(d & (F.col(verdict) == F.col(gold))).alias("k"))
    n, k = F.col("n"), F.col("k")
    return t.select("n", rounded(safe(F.col("d"), n), "coverage"), rounded(safe(k, F.col("d")), "decided_accuracy"), rounded(safe(k + (n - F.col("d")) / 2, n), "effective_accuracy"))


def critical(rows: DataFrame, value: str, alpha: float) -> DataFrame:
    """(critical): the ceil((1 - alpha) n)-th of the absolute values in ascending order, found by counts of distinct values."""
    by = rows.groupBy(F.abs(value).alias("v")).agg(F.count("*").alias("c"))
    n = rows.agg(F.greatest(F.lit(1), F.ceil(F.round((1 - alpha) * F.count("*"), 9))).alias("place"))
    return running(by, ["v"], {"c": "upto"}).join(F.broadcast(n)).where(F.col("upto") >= F.col("place")).agg(F.min("v").alias("critical"))


def detectable(rows: DataFrame, bonus: str, power: str, target: float = 0.8) -> DataFrame:
    """(bonus): the least one that reaches the target power; null if none does."""
    return rows.agg(F.min(F.when(F.col(power) >= target, F.col(bonus))).alias("bonus"))


def flag_rates(rows: DataFrame, by: str, score: str, threshold: float) -> DataFrame:
    """(by, flagged, total): rows below the threshold, by category."""
    return rows.groupBy(by).agg(F.count_if(F.col(score) < threshold).alias("flagged"), F.count("*").alias("total"))


def means_by(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(supported, unsupported): mean score by label; 0 for a label without rows."""
    mean = lambda c: rounded(F.coalesce(F.avg(F.when(c, F.col(score))), F.lit(0.0)), "m")
    return rows.agg(mean(F.col(label)).alias("supported"), mean(~F.col(label)).alias("unsupported"))


def finalized(counts: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and F1; precision and recall of nothing are 1, F1 of two zeros is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = safe(tp, tp + fp, 1.0), safe(tp, tp + fn, 1.0)
    return counts.select("*", rounded(p, "precision"), rounded(r, "recall"), rounded(safe(2 * p * r, p + r), "f1"))


def added(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of all numeric columns but the keys: counts, usages or tallies of several parts merged."""
    keys = keys or []
    numeric = [f.name for f in parts.schema.fields if f.name not in keys and f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric])


def absolute_errors(rows: DataFrame, estimate: str, exact: str) -> DataFrame:
    """(mean_error, max_error) of pairs of an estimate and a value."""
    e = F.abs(F.col(estimate) - F.col(exact))
    return rows.agg(rounded(F.avg(e), "mean_error"), rounded(F.max(e), "max_error"))


def projected(rows: DataFrame, size: str, value: str, at: float) -> DataFrame:
    """(exponent, projected): the value of the greatest size times (at / size) ^ exponent of the fit on logarithms."""
    t = rows.agg(F.regr_slope(F.log(value), F.log(size)).alias("e"), F.max(size).alias("s"), F.max_by(value, size).alias("v"))
    return t.select(rounded(F.col("e"), "exponent"), rounded(F.col("v") * F.pow(F.lit(float(at)) / F.col("s"), F.col("e")), "projected", 3))


def best_of(rows: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """The keys whose value is the greatest, within a tolerance."""
    top = rows.agg(F.max(value).alias("_top"))
    return rows.join(F.broadcast(top)).where(F.col(value) >= F.col("_top") - tolerance).select(key, value)


def attribution(first: DataFrame, fused: str, singles: tuple[str, ...]) -> DataFrame:
    """(missed, recovered, sole_first, kept): how fusion changes which queries are right at rank 1.

    first: (query_id, system, rr). missed: the fused system isn't first though a single one is; recovered: it is first
    and no single is; sole_first: exactly one single is first; kept: sole firsts that the fused system keeps."""
    hit = lambda s: F.max(F.when((F.col("system") == s) & (F.col("rr") == 1), 1).otherwise(0))
    t = first.groupBy("query_id").agg(hit(fused).alias("f"), *[hit(s).alias(f"s{k}") for k, s in enumerate(singles)])
    t = t.withColumn("n", sum(F.col(f"s{k}") for k in range(len(singles))))
    return t.agg(
        F.count_if(F.expr("f = 0 and n > 0")).alias("missed"), F.count_if(F.expr("f = 1 and n = 0")).alias("recovered"),
        F.count_if(F.expr("n = 1")).alias("sole_first"), F.count_if(F.expr("n = 1 and f = 1")).alias("kept"),
    )


def identical(a: DataFrame, b: DataFrame, places: int = 6) -> DataFrame:
    """(n, identical): queries of two rankings (query_id, doc_id, score, rank), and those whose lists are the same."""
    both = a.select("query_id", "rank", F.col("doc_id").alias("x"), F.round("score", places).alias("s")).join(
        b.select("query_id", "rank", F.col("doc_id").alias("y"), F.round("score", places).alias("t")), ["query_id", "rank"], "full"
    )
    same = both.groupBy("query_id").agg(F.min(F.coalesce((F.col("x") == F.col("y")) & (F.col("s") == F.col("t")), F.lit(False)).cast("int")).alias("same"))
    return same.agg(F.count("*").alias("n"), F.sum("same").alias("identical"))


def fractions(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(outcome, n, mean, least, most) by outcome and, as `pooled`, over all: a rollup."""
    t = rows.rollup(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.grouping(by).alias("g"))
    return t.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col(by)).alias("outcome"), "n", rounded(F.col("m"), "mean"), rounded(F.col("lo"), "least"), rounded(F.col("hi"), "most"))


def simultaneous(rows: DataFrame, by: str, at: str) -> DataFrame:
    """(by, most): the most rows of a key at one instant."""
    return rows.groupBy(by, at).count().groupBy(by).agg(F.max("count").alias("most"))


def in_range(rows: DataFrame, by: str, at: str, start, end) -> DataFrame:
    """(by, n): rows of a key with start <= at < end."""
    return rows.groupBy(by).agg(F.count_if((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end))).alias("n"))


def first_below(rows: DataFrame, rate: str, value: str, line: float) -> DataFrame:
    """(rate): the least rate at which a measure falls under a line; null if it never does."""
    return rows.agg(F.min(F.when(F.col(value) < line, F.col(rate))).alias("rate"))
