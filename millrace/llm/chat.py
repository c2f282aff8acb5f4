"""Operator 3: multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as `assistant` and
each other speaker as a named user:

    <|im_start|>assistant\\n…<|im_end|>\\n        the participant's own turns
    <|im_start|>user name=ROLE\\n…<|im_end|>\\n   everyone else's

The loss mask covers the participant's texts with the end mark that follows them, as code point spans
`start:end` (end exclusive) within the piece. A rendering comes in pieces of at most PART turns, each with its offset in
the whole rendering, so no conversation, however long and however its turns are numbered, has to fit into one row: turn
numbers are cut into parts of PART, and the turns of a part, which may be many where numbers are null or repeated, into
pieces by their place. DataFrame functions only.

Every role that occurs takes part, `system` included. In headings, control characters and < | > of a role's name are
written as _, so that no name can look like a turn.

Edge cases: a null role takes part as `unknown` but is no perspective of its own; null texts are empty; a
null turn counts as turn 0 and comes first; rows that share a turn come by role and text; repeated rows are all
rendered; a conversation whose id is null is a conversation; an empty table gives no rows; other columns, of whatever
names, are not read; a very long text is rendered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = 256
NAME = r"[\x00-\x1F<|>]"  #: what a role's name can't have in a heading


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, piece, start, n_turns, n_own, rendered, mask, n_masked."""
    rows = turns.select("conv_id", "turn", "role", F.coalesce("role", F.lit("unknown")).alias("who"), F.coalesce("text", F.lit("")).alias("body"))
    who = rows.where("role is not null").select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    joined = rows.join(who, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    name = F.regexp_replace("who", NAME, "_")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), name, F.lit("\n")))
    lines = joined.select(
        "conv_id", "perspective", F.floor(F.coalesce("turn", F.lit(0)) / part).cast("long").alias("part"), "turn", "who", own.alias("own"),
        head.alias("head"), F.concat("body", F.lit("<|im_end|>")).alias("tail"),
    )
    line = Window.partitionBy("conv_id", "perspective", "part").orderBy(F.col("turn").asc_nulls_first(), "who", "tail")
    size = F.length("head") + F.length("tail") + 1
    placed = lines.withColumn("n", F.row_number().over(line)).withColumn("end", F.sum(size.cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    cell = F.struct("n", F.concat("head", "tail", F.lit("\n")).alias("line"), F.when(F.col("own"), F.col("end") - 1 - F.length("tail")).alias("a"), F.when(F.col("own"), F.col("end") - 1).alias("b"))
    pieces = placed.groupBy("conv_id", "perspective", "part", F.floor((F.col("n") - 1) / part).cast("long").alias("piece")).agg(
        F.array_sort(F.collect_list(cell)).alias("lines"),
        F.min(F.col("end") - size).alias("begin"),
        F.max("end").alias("end"),
        F.count("*").alias("n_turns"),
        F.sum(F.col("own").cast("long")).alias("n_own"),
        F.sum(F.when(F.col("own"), F.length("tail")).otherwise(0)).cast("long").alias("n_masked"),
    )
    whole = Window.partitionBy("conv_id", "perspective").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end") - F.col("begin")
    own_lines = F.filter("lines", lambda x: x["a"].isNotNull())
    return pieces.select(
        "conv_id", "perspective", "part", "piece", (F.sum(length).over(whole) - length).alias("start"), "n_turns", "n_own",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"),
        F.array_join(F.transform(own_lines, lambda x: F.concat_ws(":", x["a"] - F.col("begin"), x["b"] - F.col("begin"))), ",").alias("mask"),
        "n_masked",
    )


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(role, 'unknown') AS who, coalesce(text, '') || '<|im_end|>' AS tail FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL
), l AS (
  SELECT t.conv_id, perspective, CAST(floor(coalesce(turn, 0) / {PART}.0) AS BIGINT) AS part, turn, who, tail,
    coalesce(role = perspective, false) AS own,
    CASE WHEN coalesce(role = perspective, false) THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || regexp_replace(who, '{NAME}', '_', 'g') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), w AS (
  SELECT *, (row_number() OVER x - 1) // {PART} AS piece, row_number() OVER x AS n,
    sum(length(head) + length(tail) + 1) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM l WINDOW x AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, who, tail)
), v AS (
  SELECT *, min(stop - length(head) - length(tail) - 1) OVER (PARTITION BY conv_id, perspective, part, piece) AS begin FROM w
), g AS (
  SELECT conv_id, perspective, part, piece, max(stop) - min(begin) AS size, count(*) AS n_turns, sum(CAST(own AS BIGINT)) AS n_own,
    string_agg(head || tail || chr(10), '' ORDER BY n) AS rendered,
    coalesce(string_agg(CASE WHEN own THEN CAST(stop - 1 - length(tail) - begin AS VARCHAR) || ':' || CAST(stop - 1 - begin AS VARCHAR) END, ',' ORDER BY n), '') AS mask,
    sum(CASE WHEN own THEN length(tail) ELSE 0 END) AS n_masked
  FROM v GROUP BY conv_id, perspective, part, piece
)
SELECT conv_id, perspective, part, piece, CAST(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY part, piece) - size AS BIGINT) AS start,
  n_turns, CAST(n_own AS BIGINT) AS n_own, rendered, mask, CAST(n_masked AS BIGINT) AS n_masked
FROM g
"""
