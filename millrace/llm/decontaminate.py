"""Operator 9: benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Index: one pass over the documents stores a posting (row, position) for each occurrence of a benchmark term,
and one posting of the empty term for each row, which carries its number of words.
Search: of each window the terms are ranked by their number of postings. The rarest term's postings,
adjusted by its offset, are the candidate starts; they are intersected with the second rarest term's, and
what is left with all others'. A start that all of a window's terms confirm is an exact phrase match; with
a slack, terms may stand that many places off, which gives proximity matches.

Sizes: the index has a posting for each occurrence and is dealt by row, so no term's postings meet in one
task. Benchmark terms, windows' numbers and candidate rows are broadcast only if they were counted and are few;
beyond that, joins shuffle by term or window, and it is adaptive execution that splits the partition of a frequent term.
Windows with a term that occurs nowhere are dropped before any join.

Edge cases: null or empty texts have no words and no hits; items without words have no windows; items of
fewer words than a window are one window; equal windows of several items count for each of them; rows are
told apart by a row number, so null and repeated doc_ids are kept as they are; empty tables give no rows, or rows
without hits; other columns, of whatever names, are not read (clean() keeps them); a very long text is indexed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, ITEMS = 8, 2
FEW = 200_000  #: rows (of a term, a window's part or a number each) up to which a table is broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pieces(text: Column) -> Column:
    """Words of a text, with an empty string first or last where the text begins or ends otherwise."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows; df should be stored."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, offset, term) of each distinct window, and (window, item_id). Windows are known by numbers."""
    words = items.select("item_id", F.filter(pieces(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("at"))
    found = stored(starts.select("item_id", F.array_join(F.slice("w", F.col("at"), size), " ").alias("words")).distinct(), "windows")
    numbered = stored(found.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "window-numbers")
    terms = numbered.select("window", F.posexplode(F.split("words", " ")).alias("off", "term"))
    return stored(terms, "window-terms"), stored(found.join(numbered, "words").select("window", "item_id"), "window-items")


def index_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: row, doc_id, n_words, pos, term. Positions count from 1; pos 0 is the row's own posting."""
    vocabulary = stored(terms.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string")), "terms")
    w = F.col("w")
    n = F.size(w) - (F.element_at(w, 1) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
    rows = docs.select("doc_id", pieces(F.col("text")).alias("w")).select(F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_words"), "w")
    tokens = rows.select("row", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit("")), w)).alias("pos", "term"))
    return stored(tokens.where((F.col("term") != "") | (F.col("pos") == 0)).join(few(vocabulary), "term"), "postings")


def matches(index: DataFrame, terms: DataFrame, slack: int = 0) -> DataFrame:
    """(row, window, start, size): where all terms of a window occur at their offsets, or up to `slack` places off; size is
    the window's number of words."""
    counts = stored(index.where("pos > 0").groupBy("term").agg(F.count("*").alias("df")), "counts")
    known = terms.join(few(counts), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = known.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("by")).where("by[0].df > 0")
    ranked = stored(ranked, "ranked")
    postings = index.where("pos > 0").select("row", "pos", "term")
    first = few(ranked.select("window", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["off"].alias("off")))
    starts = stored(postings.join(first, "term").select("row", "window", (F.col("pos") - F.col("off")).alias("start")).where("start > 0"), "starts")
    inside = few(stored(starts.select("row").distinct(), "rows"))
    near = postings.join(inside, "row", "left_semi")

    def intersect(starts: DataFrame, needed: DataFrame, n: Column) -> DataFrame:
        """Starts for which n of a window's needed (window, off, term) are in place."""
        wanted = starts.join(needed, "window").select("row", "window", "start", "off", "term", "n_needed", (F.col("start") + F.col("off")).alias("at"))
        if slack:
            wanted = wanted.select("*", F.explode(F.sequence(F.col("at") - slack, F.col("at") + slack)).alias("pos"))
        else:
            wanted = wanted.withColumn("pos", F.col("at"))
        found = wanted.join(near, ["row", "pos", "term"]).select("row", "window", "start", "off", "n_needed")
        found = found.distinct() if slack else found
        return found.groupBy("row", "window", "start", "n_needed").count().where(F.col("count") == F.col("n_needed")).select("row", "window", "start")

    distinct_starts = starts.distinct()
    second = few(stored(ranked.where(F.size("by") > 1).select("window", F.col("by")[1]["term"].alias("term"), F.col("by")[1]["off"].alias("off"), F.lit(1).alias("n_needed")), "second"))
    pairs = stored(intersect(distinct_starts, second, F.lit(1)), "pairs")
    others = ranked.where(F.size("by") > 2).select("window", (F.size("by") - 2).alias("n_needed"), F.explode(F.slice("by", 3, 1 << 20)).alias("t"))
    others = few(stored(others.select("window", "n_needed", F.col("t.term").alias("term"), F.col("t.off").alias("off")), "others"))
    length = ranked.select("window", F.size("by").alias("size"))
    alone = distinct_starts.join(length.where("size = 1").select("window"), "window", "left_semi").select("row", "window", "start")
    two = pairs.join(length.where("size = 2").select("window"), "window", "left_semi").select("row", "window", "start")
    every = stored(alone.unionByName(two).unionByName(intersect(pairs, others, F.col("n_needed"))), "matches")
    return every.join(few(stored(length, "lengths")), "window").select("row", "window", "start", "size")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, least: int = ITEMS) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    terms, of = windows_of(items, size)
    index = index_of(docs, terms)
    found = matches(index, terms)
    rows = index.where("pos = 0").select("row", "doc_id", "n_words")
    hit = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    which = found.select("row", "window").distinct().join(few(of), "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    which = which.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    return (
        rows.join(hits, "row", "left")
        .join(which, "row", "left")
        .select(
            "row",
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_items", F.lit(0)) >= least).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, least: int = ITEMS) -> DataFrame:
    """docs without the contaminated documents; columns as they are."""
    bad = stored(contamination(docs, items, size, least).where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(few(bad), "doc_id", "left_anti").select(*docs.columns)


SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x != '') AS w,
    row_number() OVER () AS r FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x != '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (win, n)
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {ITEMS} AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
