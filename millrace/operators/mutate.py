"""Record mutations as new tables: insert, replace, patch, delete, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def insert_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base and those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_existing(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base with the records of known keys replaced; rows with unknown keys are ignored."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows.join(base.select(key), key, "left_semi"), allowMissingColumns=True)


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whole records replaced or added: columns that `rows` lacks become null."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def _patched(old: str, new: str, a, b, given: set[str]):
    """b's fields over a's, nested records field by field."""
    fields = []
    patch = {f.name: f.dataType for f in b.fields} if isinstance(b, StructType) else {}
    for f in a.fields:
        if f.name in patch and isinstance(f.dataType, StructType):
            merged = _patched(f"{old}.{f.name}", f"{new}.{f.name}", f.dataType, patch[f.name], set())
            value = F.when(F.col(f"{new}.{f.name}").isNull(), F.col(f"{old}.{f.name}")).otherwise(merged)
        elif f.name in patch:
            value = F.coalesce(F.col(f"{new}.{f.name}"), F.col(f"{old}.{f.name}"))
        else:
            value = F.col(f"{old}.{f.name}")
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def merge_patch(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Records with the patch's non-null fields over their own, recursively; unknown keys are added."""
    a = base.select(F.col(key).alias("_ka"), F.struct(*base.columns).alias("a"))
    b = patch.select(F.col(key).alias("_kb"), F.struct(*patch.columns).alias("b"))
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full")
    merged = _patched("a", "b", a.schema["a"].dataType, b.schema["b"].dataType, set())
    return both.select(merged.alias("r")).select("r.*")


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def update_where(base: DataFrame, condition: str, column: str, value: str) -> DataFrame:
    """SQL's UPDATE: column set to an expression where the condition holds."""
    return base.withColumn(column, F.when(F.expr(condition), F.expr(value)).otherwise(F.col(column)))


def apply_feed(base: DataFrame, feed: DataFrame, key: str, order: str) -> DataFrame:
    """base after the last change per key. feed: the columns of base, `op` (ADD, ALTERATION or DELETE) and an order column."""
    last = F.max_by(F.struct("op", *base.columns), order).alias("c")
    changes = feed.groupBy(F.col(key).alias("_key")).agg(last).select("c.*")
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.filter("op <> 'DELETE'").select(*base.columns))


def put_all(row: Column, other: Column) -> Column:
    """A dynamic row, a map of names to values, with the values of another over its own."""
    return F.map_zip_with(row, other, lambda k, mine, new: F.when(F.map_contains_key(other, k), new).otherwise(mine))


def remove(row: Column, *names: str) -> Column:
    """A dynamic row without these names."""
    return F.map_filter(row, lambda k, _: ~k.isin(*names))


def clear(row: Column) -> Column:
    """A dynamic row without any name; null stays null."""
    return F.map_filter(row, lambda k, v: F.lit(False))


def same_row(a: Column, b: Column) -> Column:
    """Whether two dynamic rows have the same names and values, in whatever order; a null value equals a null value."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return entries(a).eqNullSafe(entries(b))
