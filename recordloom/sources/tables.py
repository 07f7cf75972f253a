"""Catalog tables: replace, append with widening, upsert, delete, update, listing, SQL.

The frame functions (``appended``, ``upserted``, …) are lazy and can be used on their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError, require_columns
from recordloom.functions import text
from recordloom.operators.publish import Files
from recordloom.operators.relate import one_per_key
from recordloom.operators.schema import col

MODES = ("replace", "append", "upsert")
_NESTED = (T.StructType, T.MapType, T.ArrayType, T.VariantType)


def storable(df: DataFrame) -> DataFrame:
    """Nested values as JSON text."""
    nested = {f.name: text.json_encode(col(f.name)) for f in df.schema.fields if isinstance(f.dataType, _NESTED)}
    return df.withColumns(nested) if nested else df


def appended(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch below the target; new columns widen it, missing ones are null."""
    return target.unionByName(batch, allowMissingColumns=True)


def upserted(target: DataFrame, batch: DataFrame, key: str | Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The target with rows of the batch in place of those with the same key.

    The whole row is replaced: columns the batch lacks become null. Within the batch the last
    row per key in ``order_by`` wins. A null key is never the same as another.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(target.columns, keys, "target")
    require_columns(batch.columns, keys, "batch")
    named = F.lit(True)
    for k in keys:
        named = named & col(k).isNotNull()
    latest = one_per_key(batch.filter(named), keys, order_by)
    kept = target.join(latest.select(*[col(k) for k in keys]), keys, "left_anti")
    out = appended(kept.select(*[col(c) for c in target.columns]), latest)
    return out.unionByName(batch.filter(~named), allowMissingColumns=True)


def deleted(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold; unknown counts as not holding."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def updated(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows for which the condition holds get the new values, computed from the old row."""
    require_columns(target.columns, values)
    hit = F.coalesce(condition, F.lit(False))
    return target.withColumns({n: F.when(hit, v).otherwise(col(n)) for n, v in values.items()})


def table_write(
    df: DataFrame, table: str, mode: str = "replace", key: str | Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Write records to a catalog table and return it; an empty batch writes nothing."""
    spark = df.sparkSession
    if mode not in MODES:
        raise RecordError(f"mode={mode!r} is not one of {', '.join(MODES)}")
    if mode == "upsert" and not key:
        raise RecordError("an upsert without a key cannot tell old rows from new")
    if df.isEmpty():
        return spark.table(table) if spark.catalog.tableExists(table) else df
    batch = storable(df)
    if mode == "upsert":
        batch_rows = batch
        if spark.catalog.tableExists(table):
            merged = upserted(spark.table(table), batch_rows, key, order_by)
        else:
            merged = upserted(batch_rows.limit(0), batch_rows, key, order_by)
        return _overwrite(merged, table)
    if mode == "append" and spark.catalog.tableExists(table):
        _widen(spark, table, batch)
        target = spark.table(table)
        row = [(col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields]
        batch.select(*row).write.mode("append").insertInto(table)
        return spark.table(table)
    return _overwrite(batch, table)


def _widen(spark: SparkSession, table: str, batch: DataFrame) -> None:
    have = {n.lower() for n in spark.table(table).columns}
    new = [f for f in batch.schema.fields if f.name.lower() not in have]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")


def _overwrite(df: DataFrame, table: str) -> DataFrame:
    """Replace a table by a frame that may read it.

    The new rows are written whole beside the old ones; then the catalog's entry is pointed to them in one step, so
    readers meet the old table or the new one and there always is one. New columns widen the table first. Where
    columns go or change their type, the new table is written under a name of its own and the names change; a crash
    in between leaves both under names that tell what they are.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    if spark.catalog.tableExists(table):
        have = [(f.name, f.dataType) for f in spark.table(table).schema.fields]
        home = _location(spark, table)
        if home and [(f.name, f.dataType) for f in df.schema.fields[: len(have)]] == have:
            path = f"{home.split('__at_')[0]}__at_{mark}"
            df.write.mode("errorifexists").parquet(path)
            _widen(spark, table, df)
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
            Files(spark).remove(home)
            return spark.table(table)
    fresh, old = f"{table}__new_{mark}", f"{table}__old_{mark}"
    df.write.saveAsTable(fresh)
    replaced = spark.catalog.tableExists(table)
    if replaced:
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    if replaced:
        spark.sql(f"DROP TABLE {old}")
    return spark.table(table)


def _location(spark: SparkSession, table: str) -> str | None:
    """Where an unpartitioned Parquet table that the catalog manages lies; None for any other."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    plain = (told.get("Provider", "").lower(), told.get("Type")) == ("parquet", "MANAGED") and "# Partition Information" not in told
    return told.get("Location", "").rstrip("/") or None if plain else None


def _rewritten(df: DataFrame, changed: DataFrame, condition: Column, table: str) -> int:
    """Write ``changed`` over the table; how many of its rows met the condition, counted on the way."""
    if df.filter(condition).isEmpty():
        return 0
    seen = Observation()
    hit = F.count_if(F.coalesce(F.col("__hit"), F.lit(False))).alias("n")
    _overwrite(changed.observe(seen, hit).filter(F.col("__keep")).drop("__hit", "__keep"), table)
    return seen.get["n"]


def table_delete_where(spark: SparkSession, table: str, condition: Column) -> int:
    """Delete rows; returns how many."""
    target = spark.table(table)
    marked = target.withColumns({"__hit": condition, "__keep": ~F.coalesce(condition, F.lit(False))})
    return _rewritten(target, marked, condition, table)


def table_update_where(spark: SparkSession, table: str, condition: Column, values: dict[str, Column]) -> int:
    """Update rows; returns how many."""
    target = spark.table(table)
    marked = updated(target.withColumns({"__hit": condition, "__keep": F.lit(True)}), F.col("__hit"), values)
    return _rewritten(target, marked, condition, table)


def table_schema(spark: SparkSession, table: str | None = None) -> DataFrame:
    """``table, column, type`` of one table, or of every table of the current database."""
    if table is not None and not spark.catalog.tableExists(table):
        raise RecordError(f"the catalog has no table {table!r}")
    names = [table] if table else sorted(t.name for t in spark.catalog.listTables())
    rows = [(n, c.name, c.dataType) for n in names for c in spark.catalog.listColumns(n)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def sql(spark: SparkSession, query: str, *params: object, **frames: DataFrame) -> DataFrame:
    """SQL over named frames and catalog tables; ``?`` parameters are bound, never pasted in.

    The names hold for this query only; the caller's own views of those names come back.
    """
    own = {name: spark.table(name) for name in frames if _is_view(spark, name)}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(query, args=list(params)) if params else spark.sql(query)
    finally:
        for name in frames:
            if name in own:
                own[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary
