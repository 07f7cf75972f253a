"""Session settings and the shared staging area."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods beyond 8000 bytes of code; Spark's generated code for
    # many long expressions is split into small methods once a stage passes this limit.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings the operators count on for hot keys."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is missing, a folder in the warehouse is taken, which is shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


_STAGED: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``drop_staged`` removes with what is written there."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows depends on committed files, so a lost executor costs a
    re-read and never a different answer. Untyped nulls are stored as text. The files stay
    until ``drop_staged``, because frames that read them are lazy.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    untyped = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    if untyped:
        df = df.withColumns({name: F.col(f"`{name}`").cast("string") for name in untyped})
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Remove what this process staged, once no frame that reads it is needed; how many."""
    from recordloom.operators.publish import Files

    files, dropped = Files(spark), 0
    while _STAGED:
        files.remove(_STAGED.pop())
        dropped += 1
    return dropped
