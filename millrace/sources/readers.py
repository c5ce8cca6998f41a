"""Readers, writers and a registry of external stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: format -> function(spark, options). A store whose connector isn't on the class path is stood in for by Parquet.
SOURCES: dict[str, Callable[[SparkSession, dict[str, str]], DataFrame]] = {}


def source(name: str):
    def add(f):
        SOURCES[name] = f
        return f

    return add


@source("parquet")
def _parquet(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.parquet(options["path"])


@source("record_store")
def _record_store(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """keyspace and table; through the store's own connector where `format` names one, else Parquet under `path`."""
    if "format" in options:
        return spark.read.format(options["format"]).options(keyspace=options["keyspace"], table=options["table"]).load()
    return spark.read.parquet(f"{options['path']}/{options['keyspace']}/{options['table']}.parquet")


def load_table(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    if fmt in SOURCES:
        return SOURCES[fmt](spark, options)
    return spark.read.format(fmt).options(**options).load()


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """Delimited text with `#` comment lines, typed by the schema; fields that don't parse become null."""
    return spark.read.csv(path, sep=separator, comment="#", schema=schema, mode="PERMISSIVE")


def column_value(field: Column, type: str) -> Column:
    """A field as column files store it: dashes removed, -1 for an empty one."""
    return F.coalesce(F.nullif(F.translate(field, "-", ""), F.lit("")), F.lit("-1")).try_cast(type)


def read_lines(spark: SparkSession, path: str, names: list[tuple[str, str]], separator: str = ",") -> DataFrame:
    """Text lines cut at a separator, trimmed and cast; what doesn't parse is null."""
    field = lambda i, t: F.trim(F.get(F.split("value", separator), F.lit(i))).try_cast(t)
    return spark.read.text(path).select(*[field(i, t).alias(n) for i, (n, t) in enumerate(names)])


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(label, file, text): whole files, labelled by the folder they lie in."""
    name = F.input_file_name()
    parts = F.split(name, "/")
    return spark.read.text(f"{path}/*/*", wholetext=True).select(F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("file"), F.col("value").alias("text"))


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON string column; malformed texts give nulls."""
    return df.withColumn("_j", F.from_json(column, schema)).select("*", "_j.*").drop("_j")


def write_sorted(df: DataFrame, path: str, order: list[str], by_range: bool = True) -> None:
    """A copy sorted on `order`, so that Parquet statistics prune range and point reads."""
    (df.repartitionByRange(*order) if by_range else df).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table bucketed and sorted on a key: joins and aggregates of such tables on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
