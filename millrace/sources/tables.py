"""Reading tables and checked line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON lines file in a fixed schema. Blank lines are skipped; a line that doesn't parse is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that is one JSON object of strings."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return rows.select(F.explode("m").alias("key", "value"))


def checked(df: DataFrame, **rules: Column) -> DataFrame:
    """df; reading a row that breaks a rule is an error that names the rule."""
    for name, rule in rules.items():
        df = df.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"rule {name} is broken")).cast("boolean")))
    return df


def broken(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows that break a rule, with the rules' names."""
    names = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", names).where(F.size("broken") > 0)


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).count().where("count > 1")


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks."""
    return df.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def fingerprint(df: DataFrame, *order: str) -> DataFrame:
    """SHA-256 over the rows' own digests in their order: one digest a row is gathered, not the rows."""
    rows = df.select(F.struct(*order).alias("at"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda r: r["digest"]), "\n"), 256).alias("fingerprint"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)
