"""Judges with known faults over pairs of answers: grades, verdicts in both orders, flips, leans, abstention, cost.

pairs: (id, quality_a, quality_b, tokens_a, tokens_b, gold). A judge's latent score of an answer is its quality plus a
weight for length, a bonus for an answer of its own kind, and noise that is a hash of pair, side and order, so a verdict
can be made again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.stats import rounded, safe
from millrace.sources.generators import normal, uniform

TYPICAL = 120  #: fixed value: tokens at which length counts nothing


@dataclass(frozen=True)
class Judge:
    length: float = 0.0  #: of the logarithm of tokens / TYPICAL
    first: float = 0.0  #: bonus of the answer that is shown first
    own: float = 0.0  #: bonus of answers of its own kind
    noise: float = 0.0
    seed: int = 0

    def score(self, side: str, order: int) -> Column:
        """The latent score of side a or b when a is shown first (order 0) or second (order 1)."""
        is_first = (side == "a") == (order == 0)
        s = F.col(f"quality_{side}") + self.length * F.log(F.col(f"tokens_{side}") / TYPICAL) + (self.first if is_first else 0.0)
        if self.own:
            s = s + F.when(F.col(f"own_{side}"), self.own).otherwise(0.0)
        return s + (self.noise * normal(self.seed, "id", F.lit(side), F.lit(order)) if self.noise else F.lit(0.0))

    def verdict(self, order: int) -> Column:
        """The winner; equal scores go to the answer shown first."""
        a, b = self.score("a", order), self.score("b", order)
        return F.when(a > b, "a").when(b > a, "b").otherwise("a" if order == 0 else "b")


def graded(pairs: DataFrame, judge: Judge, cutoff: float) -> DataFrame:
    """(id, grade): whether side a passes by itself."""
    return pairs.select("id", (judge.score("a", 0) >= cutoff).alias("grade"))


def directions(pairs: DataFrame, judge: Judge) -> DataFrame:
    """(id, gold, ab, ba, flip): verdicts of both orders; flip is none, toward-first or toward-second."""
    rows = pairs.select("id", "gold", judge.verdict(0).alias("ab"), judge.verdict(1).alias("ba"))
    flip = F.when(F.col("ab") == F.col("ba"), "none").when(F.col("ab") == "a", "toward-first").otherwise("toward-second")
    return rows.withColumn("flip", flip)


def direction_stats(rows: DataFrame) -> DataFrame:
    """(n, flip_rate, to_first, to_second, first_rate, lean): first_rate is the share of wins of the first place over both
    orders; lean is that less a half."""
    won = ((F.col("ab") == "a").cast("int") + (F.col("ba") == "b").cast("int")) / 2
    t = rows.agg(F.count("*").alias("n"), F.avg((F.col("flip") != "none").cast("double")).alias("f"), F.count_if(F.col("flip") == "toward-first").alias("to_first"), F.count_if(F.col("flip") == "toward-second").alias("to_second"), F.avg(won).alias("w"))
    return t.select("n", rounded(F.col("f"), "flip_rate"), "to_first", "to_second", rounded(F.col("w"), "first_rate"), rounded(F.col("w") - 0.5, "lean"))


def first_slot(seed: int) -> Column:
    """The order of a pair: 0 or 1 by a hash of its id."""
    return (uniform(seed, "id", F.lit("slot")) >= 0.5).cast("int")


def protocols(pairs: DataFrame, judge: Judge, seed: int = 0, price: float = 1.0) -> DataFrame:
    """(protocol, calls, cost, coverage, accuracy, effective) of showing pairs as they are stored, in an order drawn for each
    pair, and in both orders with abstention where they disagree."""
    rows = directions(pairs, judge).withColumn("order", first_slot(seed))
    drawn = F.when(F.col("order") == 0, F.col("ab")).otherwise(F.col("ba"))
    both = F.when(F.col("ab") == F.col("ba"), F.col("ab")).otherwise("abstain")
    cells = F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(n).alias("calls"), v.alias("verdict")) for p, n, v in (("stored", 1, F.col("ab")), ("drawn", 1, drawn), ("both", 2, both))])
    t = rows.select("gold", F.explode(cells).alias("c")).groupBy("c.protocol").agg(
        F.count("*").alias("n"), F.sum("c.calls").alias("calls"), F.count_if(F.col("c.verdict") != "abstain").alias("d"), F.count_if(F.col("c.verdict") == F.col("gold")).alias("k")
    )
    return t.select("protocol", "calls", rounded(F.col("calls") * price, "cost"), rounded(F.col("d") / F.col("n"), "coverage"), rounded(safe(F.col("k"), F.col("d")), "accuracy"), rounded((F.col("k") + (F.col("n") - F.col("d")) / 2) / F.col("n"), "effective"))


def single_call_lean(pairs: DataFrame, judge: Judge, seed: int = 0) -> DataFrame:
    """(lean): share of wins of the first place, less a half, with one drawn order for each pair."""
    rows = directions(pairs, judge).withColumn("order", first_slot(seed))
    won = F.when(F.col("order") == 0, F.col("ab") == "a").otherwise(F.col("ba") == "b")
    return rows.agg(rounded(F.avg(won.cast("double")) - 0.5, "lean"))


def balanced(pairs: DataFrame) -> DataFrame:
    """(a_wins, b_wins, longer_wins, shorter_wins) of a set of pairs, to see that no side or length gives gold away."""
    longer = F.when(F.col("tokens_a") >= F.col("tokens_b"), "a").otherwise("b")
    return pairs.agg(
        F.count_if(F.col("gold") == "a").alias("a_wins"), F.count_if(F.col("gold") == "b").alias("b_wins"),
        F.count_if(F.col("gold") == longer).alias("longer_wins"), F.count_if(F.col("gold") != longer).alias("shorter_wins"),
    )
