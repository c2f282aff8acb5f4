"""Seeded test data as DataFrames: texts, queries, vectors, conversations, traffic, work items, byte chunks.

Every draw is a hash of seed, row and purpose (MD5, so that any engine can make it again), never a generator's state:
a row comes out the same in whatever task, order or retry it is made, and n rows cost n independent rows of
`spark.range`, with no driver in between.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import parsing

WORDS = ("ar", "be", "cor", "den", "el", "fa", "gor", "hi", "in", "jo", "kal", "lum", "mi", "nor", "ol", "pra", "qui", "ran", "sel", "tor", "u", "vin", "wes", "xe", "yl", "zan")


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from a hash: 32 bits."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal number from two uniform ones."""
    u, v = uniform(seed, *parts, F.lit("u")), uniform(seed, *parts, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def pick(seed: int, values: tuple, *parts: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(uniform(seed, *parts) * len(values)).cast("int") + 1)


def zipf(u: Column, vocabulary: int, s: float = 1.1) -> Column:
    """A rank from 1 on with weight about rank^-s, from a uniform number: the inverse of the continuous distribution."""
    top = float(vocabulary + 1) ** (1 - s) - 1
    return F.least(F.lit(vocabulary), F.floor(F.pow(u * top + 1, F.lit(1 / (1 - s)))).cast("int"))


def word(rank: Column) -> Column:
    """A word for each rank: its digits in base 26, as syllables."""
    digits = F.transform(F.split(rank.cast("string"), ""), lambda c: c.cast("int"))
    return F.array_join(F.transform(digits, lambda c: F.element_at(F.array(*map(F.lit, WORDS)), c + 1)), "")


def corpus(spark: SparkSession, n: int, seed: int = 0, words: int = 80, vocabulary: int = 20_000, s: float = 1.1) -> DataFrame:
    """(doc_id, text): texts of words/2 to 3*words/2 words of a Zipf vocabulary."""
    size = F.floor(words / 2 + uniform(seed, "id", F.lit("size")) * words).cast("int")
    places = F.sequence(F.lit(1), size)
    drawn = F.transform(places, lambda k: word(zipf(uniform(seed, F.col("id"), k), vocabulary, s)))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(drawn, " ").alias("text"))


def queries(spark: SparkSession, n: int, seed: int = 0, stratum: str = "typical", vocabulary: int = 20_000, s: float = 1.1) -> DataFrame:
    """(query_id, text): two to five words; `typical` draws like texts, `common` from the first hundred ranks, `rare` from
    the last half."""
    size = F.floor(2 + uniform(seed, "id", F.lit("size")) * 4).cast("int")
    u = lambda k: uniform(seed, F.col("id"), k, F.lit("q"))
    rank = {
        "typical": lambda k: zipf(u(k), vocabulary, s),
        "common": lambda k: F.floor(1 + u(k) * 100).cast("int"),
        "rare": lambda k: F.floor(vocabulary / 2 + u(k) * vocabulary / 2).cast("int"),
    }[stratum]
    return spark.range(n).select(F.col("id").alias("query_id"), F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: word(rank(k))), " ").alias("text"))


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, seed: int = 0, deviation: float = 0.15) -> DataFrame:
    """(vec_id, embedding, label): normal noise around centres drawn uniformly from the cube."""
    label = F.floor(uniform(seed, "id", F.lit("cluster")) * clusters).cast("int")
    x = lambda k: uniform(seed, F.col("label"), k, F.lit("centre")) * 2 - 1 + normal(seed, F.col("id"), k) * deviation
    rows = spark.range(n).select("id", label.alias("label"))
    return rows.select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), x).alias("embedding"), "label")


def uniform_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(vec_id, embedding) uniform in [0, 1)."""
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: uniform(seed, F.col("id"), k)).alias("embedding"))


def tickets(spark: SparkSession, n: int, seed: int = 0, classes: tuple[str, ...] = ("billing", "login", "delivery", "other"), phrases: int = 6, ambiguity: float = 0.25) -> DataFrame:
    """(id, text, label): phrases that name the class, or by chance another one."""
    own = F.floor(uniform(seed, "id", F.lit("label")) * len(classes)).cast("int")
    other = lambda k: F.floor(uniform(seed, F.col("id"), k, F.lit("other")) * len(classes)).cast("int")
    name = lambda i: F.element_at(F.array(*map(F.lit, classes)), i + 1)
    part = lambda k: F.concat(name(F.when(uniform(seed, F.col("id"), k, F.lit("mix")) < ambiguity, other(k)).otherwise(F.col("label"))), F.lit(" "), pick(seed, WORDS, F.col("id"), k))
    return spark.range(n).select("id", own.alias("label")).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(phrases)), part), ", ").alias("text"), "label")


def golden(spark: SparkSession, per_category: int, seed: int = 0, categories: tuple[str, ...] = ("dates", "names", "sums")) -> DataFrame:
    """(item_id, category, input_text, expected, distractor, difficulty): as many of each category; distractors differ."""
    rows = spark.range(per_category * len(categories)).select("id", F.element_at(F.array(*map(F.lit, categories)), (F.col("id") % len(categories)).cast("int") + 1).alias("category"))
    a = F.floor(uniform(seed, "id", F.lit("a")) * 900 + 100).cast("int")
    return rows.select(
        F.format_string("%s-%04d", "category", F.floor(F.col("id") / len(categories)).cast("int")).alias("item_id"), "category",
        F.concat(F.lit("what is the value in "), "category", F.lit(" "), a.cast("string")).alias("input_text"),
        a.cast("string").alias("expected"), (a + 1).cast("string").alias("distractor"), F.round(uniform(seed, "id", F.lit("d")), 6).alias("difficulty"),
    )


def typed_wrong(text: Column, key: Column, seed: int = 0, rate: float = 0.02) -> Column:
    """The text with a character swapped with the next, dropped or doubled at about a share of its places."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    u = lambda i: uniform(seed, key, i, F.lit("typo"))
    kind = lambda i: F.floor(uniform(seed, key, i, F.lit("kind")) * 3)
    hit = lambda i, k: (u(i) < rate) & (kind(i) == k)
    at = lambda i: F.coalesce(F.get(chars, i), F.lit(""))
    piece = lambda c, i: (
        F.when(hit(i, 0) & (i + 1 < F.size(chars)), at(i + 1)).when((i > 0) & hit(i - 1, 0), at(i - 1)).when(hit(i, 1), "").when(hit(i, 2), F.concat(c, c)).otherwise(c)
    )
    return F.array_join(F.transform(chars, piece), "")


def swapped_letters(text: Column, key: Column, seed: int = 0) -> Column:
    """The text with two adjacent letters swapped in one word of four letters or more; as it is if there is none."""
    words = F.split(text, " ")
    long = F.filter(F.transform(words, lambda w, i: F.when(F.length(w) >= 4, i)), lambda i: i.isNotNull())
    chosen = F.get(long, F.floor(uniform(seed, key, F.lit("word")) * F.size(long)).cast("int"))
    cut = lambda w: F.floor(1 + uniform(seed, key, F.lit("place")) * (F.length(w) - 2)).cast("int")
    swap = lambda w: F.concat(F.substring(w, 1, cut(w) - 1), F.substring(w, cut(w) + 1, 1), F.substring(w, cut(w), 1), F.substring(w, cut(w) + 2, 1 << 20))
    return F.when(F.size(long) == 0, text).otherwise(F.array_join(F.transform(words, lambda w, i: F.when(i == chosen, swap(w)).otherwise(w)), " "))


def noisy(text: Column, key: Column, seed: int = 0, rate: float = 0.1) -> Column:
    """The text with some letters' case changed and some blanks doubled."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    hit = lambda i: uniform(seed, key, i, F.lit("noise")) < rate
    other = lambda c: F.when(c == " ", "  ").when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))
    return F.array_join(F.transform(chars, lambda c, i: F.when(hit(i), other(c)).otherwise(c)), "")


def reordered(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs (doc_id, text) with their sentences in another order: by hash, turned by one place if that is the old order."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [t[i:j] for i, j in parsing.sentences(t)] if t else []
                by = sorted(range(len(parts)), key=lambda k: hashlib.md5(f"{seed}-{d}-{k}".encode()).digest())
                if by == list(range(len(parts))):
                    by = by[1:] + by[:1]
                out.append(" ".join([parts[k] for k in by]) if t is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def traffic(spark: SparkSession, n: int, intents: int = 50, seed: int = 0, greeting: float = 0.2, typo: float = 0.1) -> DataFrame:
    """(id, intent, text, greeted, typoed): requests for intents in Zipf shares, with a greeting or a typo by chance."""
    rows = spark.range(n).select("id", zipf(uniform(seed, "id", F.lit("intent")), intents).alias("intent"), (uniform(seed, "id", F.lit("hello")) < greeting).alias("greeted"), (uniform(seed, "id", F.lit("typo")) < typo).alias("typoed"))
    plain = F.concat_ws(" ", F.lit("please explain topic"), word(F.col("intent")), F.lit("and number"), F.col("intent").cast("string"))
    plain = F.when(F.col("greeted"), F.concat(F.lit("hello there, "), plain)).otherwise(plain)
    return rows.select("id", "intent", F.when(F.col("typoed"), swapped_letters(plain, F.col("id"), seed)).otherwise(plain).alias("text"), "greeted", "typoed")


def arrivals(spark: SparkSession, n: int, mean_gap_ms: float, seed: int = 0, start_ms: float = 0.0) -> DataFrame:
    """(id, gap_ms, at_ms): exponential gaps; at_ms is their running sum, taken in range partitions."""
    from millrace.operators.stats import running

    gaps = spark.range(n).select("id", (-F.log(1 - uniform(seed, "id", F.lit("gap"))) * mean_gap_ms).alias("gap_ms"))
    return running(gaps, ["id"], {"gap_ms": "at_ms"}).select("id", "gap_ms", (F.col("at_ms") + start_ms).alias("at_ms"))


def heavy_tailed(seed: int, key: Column, least: float = 16.0, alpha: float = 1.2, most: float = 65536.0) -> Column:
    """A Pareto size, cut off at `most`."""
    return F.least(F.lit(most), F.floor(least / F.pow(1 - uniform(seed, key, F.lit("size")), F.lit(1 / alpha)))).cast("long")


def work_items(spark: SparkSession, n: int, poisoned: tuple[int, ...] = ()) -> DataFrame:
    return spark.range(n).select("id", F.concat(F.lit("item "), F.col("id").cast("string")).alias("payload"), F.col("id").isin(*poisoned).alias("poisoned") if poisoned else F.lit(False).alias("poisoned"))


def chunk_offsets(total: int, seed: int, most: int) -> list[int]:
    """Offsets at which a stream of bytes is cut into chunks of 1 to `most` bytes; the last one is its end."""
    import hashlib

    out, at = [], 0
    while at < total:
        at = min(total, at + 1 + int.from_bytes(hashlib.md5(f"{seed}-{len(out)}".encode()).digest()[:4], "big") % most)
        out.append(at)
    return out


def chunks_of(data: bytes, seed: int, most: int) -> list[bytes]:
    cuts = chunk_offsets(len(data), seed, most)
    return [data[i:j] for i, j in zip([0, *cuts], cuts)]


def scripted_events(texts: list[str], fragments: list[str]) -> bytes:
    """A server-sent event stream: text deltas, JSON fragments and an end, as the parsers of streaming/sse.py read it."""
    from millrace.streaming.sse import serialized

    lines = [serialized("delta", parsing.canonical({"type": "text", "text": t})) for t in texts]
    lines += [serialized("delta", parsing.canonical({"type": "json", "fragment": f})) for f in fragments]
    return "".join([*lines, serialized("done", "{}")]).encode()


def conversations(spark: SparkSession, n: int, turns: int, facts: int = 3, seed: int = 0) -> DataFrame:
    """(conv_id, turn, role, text, fact): user and assistant in turn; `facts` user turns state a fact, and later turns, one
    for each, ask for it."""
    rows = spark.range(n * turns).select(F.floor(F.col("id") / turns).alias("conv_id"), (F.col("id") % turns).alias("turn"))
    place = lambda k: F.floor(uniform(seed, F.col("conv_id"), F.lit(k), F.lit("fact")) * (turns // 4)) * 2
    fact = F.coalesce(*[F.when(F.col("turn") == place(k), F.lit(k)) for k in range(facts)]) if facts else F.lit(None).cast("int")
    probe = F.coalesce(*[F.when(F.col("turn") == turns - 2 - 2 * k, F.lit(k)) for k in range(facts)]) if facts else F.lit(None).cast("int")
    value = lambda k: word(F.floor(uniform(seed, F.col("conv_id"), k, F.lit("value")) * 20_000).cast("int"))
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("understood, "), value(F.col("turn")))).when(F.col("fact").isNotNull(), F.concat(F.lit("my key "), F.col("fact").cast("string"), F.lit(" is "), value(F.col("fact"))))
    said = said.when(F.col("probe").isNotNull(), F.concat(F.lit("what is my key "), F.col("probe").cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("tell me about "), value(F.col("turn"))))
    rows = rows.select("conv_id", "turn", fact.alias("fact"), probe.alias("probe"))
    return rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), said.alias("text"), "fact", "probe")


def graded_pairs(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, quality_a, quality_b, tokens_a, tokens_b, gold): answers in pairs, as many won by a as by b."""
    q = lambda side: F.round(uniform(seed, "id", F.lit(side)), 6)
    rows = spark.range(n).select("id", F.greatest(q("x"), q("y")).alias("hi"), F.least(q("x"), q("y")).alias("lo"), (F.col("id") % 2 == 0).alias("a_wins"))
    t = lambda side: F.floor(20 + uniform(seed, "id", F.lit(side), F.lit("t")) * 300).cast("int")
    return rows.select(
        "id", F.when(F.col("a_wins"), F.col("hi")).otherwise(F.col("lo")).alias("quality_a"), F.when(F.col("a_wins"), F.col("lo")).otherwise(F.col("hi")).alias("quality_b"),
        t("a").alias("tokens_a"), t("b").alias("tokens_b"), F.when(F.col("a_wins"), "a").otherwise("b").alias("gold"),
    )


def requests_of(turns: DataFrame) -> DataFrame:
    """(conv_id, request, blocks): the requests of a conversation (conv_id, turn, role, text): before each assistant turn
    the request that asks for it, as the number of blocks of its append-only prefix."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("blocks", F.row_number().over(w) - 1).where("role = 'assistant'")
    return rows.select("conv_id", F.row_number().over(w).alias("request"), "blocks", F.col("turn"))
