"""Named sources: files in a fixed schema, with the rules that their rows and references have to keep.

A `Contract` names columns and their kinds, which of them are the key, rules on rows, and references to other sources.
`load` reads a file by it and gives rows whose reading fails on the first row that breaks something, with the file's line
and the rule in the message; `faults` gives all such rows instead. Keys and references are checked by joins and
aggregates, never by gathering ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.tables import json_array, json_map


@dataclass(frozen=True)
class Contract:
    schema: str
    key: str | None = None
    rules: dict[str, str] = field(default_factory=dict)  #: name: SQL condition
    strict: bool = False  #: unknown fields are an error
    array: bool = False  #: the file is one JSON array, not lines
    refers: dict[str, str] = field(default_factory=dict)  #: column: source whose key it has to name


FILLED = "{0} is not null and trim({0}) != ''"


def filled(*columns: str) -> dict[str, str]:
    return {f"{c} is filled": FILLED.format(c) for c in columns}


CORPUS = Contract("id string, title string, text string", "id", filled("id", "title", "text"))
SOURCES: dict[str, Contract] = {
    "tickets": Contract("id string, email string, expected struct<category:string,priority:string,sentiment:string,summary:string,product_areas:array<string>>, plan array<string>", "id", filled("id", "email")),
    "corpus": CORPUS,
    "queries": Contract("query string, relevant array<string>", "query", filled("query") | {"relevant isn't empty": "size(relevant) > 0"}, refers={"relevant": "corpus"}),
    "base_docs": Contract("doc_id string, topic string, text string", "doc_id", filled("doc_id", "text")),
    "chunk_queries": Contract("id string, query string, doc_id string, answer string, category string", "id", filled("id", "query", "answer") | {"category is known": "category in ('keyword', 'paraphrase')"}, refers={"doc_id": "base_docs"}),
    "contexts": Contract(
        "id string, context string, claims array<struct<id:string,text:string,supported:boolean,category:string>>", "id",
        filled("id", "context") | {"claims have ids of their own": "size(array_distinct(transform(claims, c -> c.id))) = size(claims)", "category tells support": "forall(claims, c -> (c.category = 'supported' or c.category = 'paraphrase') = c.supported or c.category not in ('supported', 'paraphrase', 'unsupported'))"},
    ),
    "golden": Contract(
        "item_id string, category string, input_text string, expected string, distractor string, difficulty double", "item_id",
        filled("item_id", "category", "input_text", "expected") | {"difficulty is in 0..1": "difficulty between 0 and 1", "distractor differs": "lower(trim(distractor)) != lower(trim(expected))"}, strict=True,
    ),
    "hop_corpus": CORPUS,
    "hop_queries": Contract("id string, kind string, question string, answer_id string, hop1_id string, bridge array<string>", "id", filled("id", "question", "answer_id") | {"kind is known": "kind in ('single', 'two_hop')", "two hops have a bridge": "kind != 'two_hop' or (hop1_id is not null and size(bridge) > 0)"}, refers={"answer_id": "hop_corpus", "hop1_id": "hop_corpus"}),
    "rewriting_queries": Contract("id string, query string, relevant array<string>, category string", "id", filled("id", "query") | {"category is filled": FILLED.format("category")}, array=True),
    "hybrid_queries": Contract("id string, query string, relevant array<string>, category string", "id", filled("id", "query") | {"category is known": "category in ('keyword', 'paraphrase')"}, array=True, refers={"relevant": "hybrid_corpus"}),
    "hybrid_corpus": Contract("id string, title string, text string", "id", filled("id", "title", "text"), array=True),
    "pii_corpus": Contract("id string, note string, marked string", "id", filled("id", "marked")),
    "prompts": Contract("id string, kind string, category string, marked string, model struct<complies:boolean,leak:string>", "id", filled("id", "marked") | {"kind is known": "kind in ('attack', 'benign')", "benign prompts don't leak": "kind != 'benign' or model.leak is null"}),
    "docs": CORPUS,
    "golden_queries": Contract("id string, question string, answer string, doc_id string, category string", "id", filled("id", "question", "answer"), refers={"doc_id": "docs"}),
    "tasks": Contract("id string, prompt string, intents array<struct<call:struct<name:string,args:map<string,string>>,flawKind:string,correctsAfter:int>>, finalTemplate string, expectedAnswer string", "id", filled("id", "prompt") | {"there are intents": "size(intents) > 0", "corrections come later": "forall(intents, i -> coalesce(i.correctsAfter, 0) >= 0)"}, array=True),
    "result_tasks": Contract("id string, prompt string, tool string, results array<string>, expectedAnswer string", "id", filled("id", "tool"), array=True),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of text files that aren't blank; lines count from 1 within their file.

    A file is read as one row, as its lines can't be counted otherwise: these are files that people write."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return whole.select("file", (F.col("n") + 1).alias("line"), "value").where(F.trim("value") != "")


def parsed(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The columns of a contract, with `line` (null for arrays) and `fault` (null, or what is wrong with the row)."""
    names = [f.name for f in T._parse_datatype_string(contract.schema).fields]
    if contract.array:
        rows = json_array(spark, path, contract.schema).withColumn("line", F.lit(None).cast("int")).withColumn("fault", F.lit(None).cast("string"))
    else:
        rows = lines(spark, path).withColumn("r", F.from_json("value", contract.schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        known = F.array(*map(F.lit, names))
        unknown = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), known)
        fault = F.when(F.json_object_keys("value").isNull() | F.col("r._bad").isNotNull(), "not an object of the schema")
        fault = fault.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))) if contract.strict else fault
        rows = rows.select(*[F.col(f"r.{n}").alias(n) for n in names], "line", fault.alias("fault"))
    for name, rule in contract.rules.items():
        rows = rows.withColumn("fault", F.coalesce("fault", F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name))))
    return rows


def faults(spark: SparkSession, path: str, contract: Contract, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(line, key, fault) of all that breaks the contract: rows, repeated keys, references to nothing."""
    rows = parsed(spark, path, contract)
    key = F.col(contract.key) if contract.key else F.lit(None).cast("string")
    out = rows.where("fault is not null").select("line", key.alias("key"), "fault")
    if contract.key:
        again = rows.groupBy(contract.key).agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
        out = out.unionByName(again.select("line", key.alias("key"), F.lit("the key is repeated").alias("fault")))
    for column, source in contract.refers.items():
        parent = (parents or {}).get(source)
        if parent is None:
            continue
        named = F.explode(column) if isinstance(rows.schema[column].dataType, T.ArrayType) else F.col(column)
        used = rows.select("line", key.alias("key"), named.alias("named")).where("named is not null")
        lost = used.join(parent.select(F.col(SOURCES[source].key).alias("named")).distinct(), "named", "left_anti")
        out = out.unionByName(lost.select("line", "key", F.concat(F.lit(f"{column} names nothing in {source}: "), "named").alias("fault")))
    return out


def load(spark: SparkSession, path: str, contract: Contract | str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a file that keeps its contract; a file that doesn't is an error that names the first fault's line."""
    contract = SOURCES[contract] if isinstance(contract, str) else contract
    first = faults(spark, path, contract, parents).orderBy(F.col("line").asc_nulls_last(), "fault").first()
    if first:
        raise ValueError(f"{path}, line {first['line']}, {first['key']}: {first['fault']}")
    return parsed(spark, path, contract).drop("line", "fault")


def titled(corpus: DataFrame) -> DataFrame:
    """(id, text): title and text of a corpus as one text."""
    return corpus.select("id", F.concat_ws("\n", "title", "text").alias("text"))


def unique_answers(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, in_own, in_others) of queries (id, doc_id, answer) whose answer isn't once in its document and in no other.

    Answers are looked for in all documents: answers are few, and broadcast only if they were counted."""
    few = queries.limit(10_001).count() <= 10_000
    asked = queries.select("id", F.col("doc_id").alias("own"), "answer")
    pairs = docs.select("doc_id", "text").join(F.broadcast(asked) if few else asked, F.expr("contains(text, answer)"))
    times = F.size(F.split("text", F.concat(F.lit("\\Q"), "answer", F.lit("\\E")), -1)) - 1
    found = pairs.groupBy("id").agg(F.sum(F.when(F.col("doc_id") == F.col("own"), times).otherwise(0)).alias("in_own"), F.count_if(F.col("doc_id") != F.col("own")).alias("in_others"))
    rows = queries.select("id").join(found, "id", "left").fillna(0, ["in_own", "in_others"])
    return rows.where("in_own != 1 or in_others != 0")


def bridged(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, token, fault) of bridge tokens that a hop's document lacks, or that the question has."""
    rows = queries.where("kind = 'two_hop'").select("id", "question", "answer_id", "hop1_id", F.explode("bridge").alias("token"))
    text = docs.select("id", F.lower(F.concat_ws("\n", "title", "text")).alias("t"))
    rows = rows.join(text.select(F.col("id").alias("answer_id"), F.col("t").alias("a")), "answer_id", "left").join(text.select(F.col("id").alias("hop1_id"), F.col("t").alias("h")), "hop1_id", "left")
    has = lambda c: F.coalesce(F.expr(f"contains({c}, lower(token))"), F.lit(False))
    fault = F.when(~has("a"), "not in the answer's document").when(~has("h"), "not in the first hop's document").when(has("lower(question)"), "in the question")
    return rows.select("id", "token", fault.alias("fault")).where("fault is not null")


def hypotheticals(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path).select(F.col("key").alias("query_id"), F.col("value").alias("answer"))


def save_run(outcomes: DataFrame, path: str, name: str, fingerprint: str) -> None:
    """A run's record: its outcomes (item, slice, ok) as JSON lines, and a header row with counts that load_run checks."""
    t = outcomes.agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("right"))
    t.select(F.lit(name).alias("name"), F.lit(fingerprint).alias("fingerprint"), "n", "right").write.mode("errorifexists").json(f"{path}/header")
    outcomes.select("item", "slice", "ok").write.mode("errorifexists").json(f"{path}/outcomes")


def load_run(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Header and outcomes of a run's record; counts that don't agree with the outcomes are an error."""
    head = spark.read.schema("name string, fingerprint string, n long, right long").json(f"{path}/header").first().asDict()
    outcomes = spark.read.schema("item long, slice string, ok boolean").json(f"{path}/outcomes")
    n, right = outcomes.agg(F.count("*"), F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0))).first()
    if (n, right) != (head["n"], head["right"]):
        raise ValueError(f"{path}: the header says {head['right']} of {head['n']}, the outcomes {right} of {n}")
    return head, outcomes

