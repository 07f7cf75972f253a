"""Files by extension, with the record rules applied on the way in and out."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import text
from recordloom.operators import reshape
from recordloom.operators.publish import Files
from recordloom.operators.schema import col
from recordloom.sources import csv_records, json_elements
from recordloom.sources.pieces import lines_of

# Formats by extension, and cell texts read as missing.
BY_EXTENSION = {
    ".csv": "csv", ".tsv": "csv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson",
    ".parquet": "parquet", ".pq": "parquet",
}
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_LEADING_ZERO = r"^0\d+$"
_WHOLE = r"^[+-]?\d+$"
_REAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|infinity|Infinity)$"


def format_of(path: str, format: str | None = None) -> str:
    """The format that is asked for, or else the one that the extension stands for."""
    asked = None if format == "auto" else format
    told = asked or BY_EXTENSION.get(PurePosixPath(path.rstrip("/")).suffix.lower())
    if told in BY_EXTENSION.values():
        return told
    raise RecordError(f"neither {asked or 'an extension'} tells how to read {path}; formats: {', '.join(sorted({*BY_EXTENSION.values()}))}")


def read(spark: SparkSession, path: str | Sequence[str], format: str | None = None, **options) -> DataFrame:
    """Read by extension; a list of paths is read as one frame."""
    first = path if isinstance(path, str) else path[0]
    reader = {"csv": read_csv, "json": read_json, "ndjson": read_ndjson, "parquet": read_parquet}
    return reader[format_of(first, format)](spark, path, **options)


def _delimiter(path: str) -> str:
    return "\t" if PurePosixPath(path.rstrip("/")).suffix.lower() == ".tsv" else ","


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None, schema: T.StructType | None = None, part: str | None = None
) -> DataFrame:
    """CSV with a header; types inferred, but a column with any ``00123`` stays text.

    Cells in quotes may hold line ends; lines end in LF or CR LF. Files are split over tasks all the same, and
    files whose headers differ are matched by name. Building the frame takes one pass over the lines and,
    without ``schema``, one to infer the types. ``part`` names a column for the file of each row.
    """
    paths = _paths(path)
    sep = sep or _delimiter(paths[0])
    lines = lines_of(spark, paths)
    layout = csv_records.Layout(lines, sep)
    if not layout.kinds:
        raise RecordError(f"{paths[0]} is empty: a table needs at least its header")
    in_pieces = layout.across or len(layout.kinds) > 1
    # Doubled quotes inside a quoted cell are the common escape.
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    named = lambda df: df.withColumn(part, F.input_file_name()) if part else df
    if schema is not None:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return csv_records.parsed(lines, layout, sep, ddl, part) if layout.across else named(reader.schema(schema).csv(paths))
    raw = csv_records.parsed(lines, layout, sep, part=part) if in_pieces else named(reader.option("inferSchema", False).csv(paths))
    of = [col(part)] if part else []
    cells = [n for n in raw.columns if n != part]
    present = raw.select(*[F.when(~col(n).isin(*MISSING), col(n)).alias(n) for n in cells], *of)
    return present.select(*[_typed(n, kind) for n, kind in _csv_types(present.select(*[col(n) for n in cells])).items()], *of)


def _csv_types(df: DataFrame) -> dict[str, str]:
    tests = []
    for i, n in enumerate(df.columns):
        c = col(n)
        whole, real = F.rlike(c, F.lit(_WHOLE)), F.rlike(c, F.lit(_REAL))
        tests += [
            F.count(c).alias(f"n{i}"),
            F.count_if(F.rlike(c, F.lit(_LEADING_ZERO))).alias(f"z{i}"),
            F.count_if(whole & c.try_cast("long").isNotNull()).alias(f"w{i}"),
            F.count_if(real & c.try_cast("double").isNotNull()).alias(f"r{i}"),
            F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    found = df.agg(*tests).first()
    kinds = {}
    for i, n in enumerate(df.columns):
        size = found[f"n{i}"]
        if size == 0 or found[f"z{i}"]:
            kinds[n] = "string"
        elif found[f"w{i}"] == size:
            kinds[n] = "long"
        elif found[f"r{i}"] == size:
            kinds[n] = "double"
        elif found[f"b{i}"] == size:
            kinds[n] = "boolean"
        else:
            kinds[n] = "string"
    return kinds


def _typed(name: str, kind: str):
    return col(name) if kind == "string" else col(name).cast(kind).alias(name)


def read_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, split: bool | None = None
) -> DataFrame:
    """Whole JSON documents, shape kept: one row per document, or per element of a top list.

    Lists are read by many tasks if ``split``, by default where a file is larger than
    ``spark.sql.files.maxPartitionBytes``. That takes one pass more; an element that is no object is then a
    corrupt record by itself.
    """
    paths = _paths(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if split is None:
        split = _largest(spark, paths) > _bytes(spark, "spark.sql.files.maxPartitionBytes")
    if split:
        lines = lines_of(spark, paths, json_elements.END)
        states = json_elements.piece_states(lines)
        if states.filter("start = 0 and not opens <=> '['").isEmpty():
            return _json_texts(reader, json_elements.elements(lines, states))
    return reader.option("multiLine", True).json(paths)


def _largest(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the largest file; contents stay unread."""
    return spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0] or 0


def _bytes(spark: SparkSession, setting: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))


def _json_texts(reader: DataFrameReader, texts: DataFrame) -> DataFrame:
    """A column of JSON texts, read as files of them would be."""
    spark = texts.sparkSession
    return DataFrame(reader._jreader.json(getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())), spark)


def read_json_table(spark: SparkSession, path: str | Sequence[str], sep: str = "_") -> DataFrame:
    """The records inside JSON documents, flattened."""
    return reshape.flatten(reshape.records(read_json(spark, path), search=True), sep=sep)


def to_table(spark: SparkSession, path: str | Sequence[str], format: str | None = None, sep: str = "_") -> DataFrame:
    """The records inside documents of any format, flattened."""
    return reshape.flatten(reshape.records(read(spark, path, format), search=True), sep=sep)


def read_ndjson(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """One object per non-blank line."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(_paths(path))


def read_parquet(spark: SparkSession, path: str | Sequence[str], merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(*_paths(path))


def glob_read(spark: SparkSession, pattern: str, concat: bool = True) -> DataFrame:
    """All files of a pattern, stacked by column name; no match is an error.

    ``concat=False`` adds ``part``, the file each row came from, so the parts stay apart.
    """
    files = Files(spark)
    matches = files.list(pattern)
    if not matches:
        raise RecordError(f"nothing lies at {pattern!r}")
    by_format: dict[str, list[str]] = {}
    for path in matches:
        by_format.setdefault(format_of(path), []).append(path)
    frames = []
    for format, paths in sorted(by_format.items()):
        if format == "parquet":
            frames.append(read_parquet(spark, paths, merge=True))
        else:
            own = {"part": "__part"} if format == "csv" and not concat else {}
            frames.append(read(spark, paths, format, **own))
    if not concat:
        frames = [f.withColumn("part", col("__part") if "__part" in f.columns else F.input_file_name()).drop("__part") for f in frames]
    return reshape.align(frames, "union")


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``path, name, suffix, bytes, modified`` of the files below a folder, contents unread."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(folder)
    )
    name = F.substring_index("path", "/", -1)
    return listed.select(
        "path",
        name.alias("name"),
        F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("suffix"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


# -- writing ----------------------------------------------------------------------


def save(df: DataFrame, path: str, format: str | None = None, **options) -> str:
    writer = {"csv": save_csv, "json": save_json, "ndjson": save_ndjson, "parquet": save_parquet}
    return writer[format_of(path, format)](df, path, **options)


def save_csv(
    df: DataFrame, path: str, sep: str = "_", explode: str | Sequence[str] | None = None,
    columns: str | Sequence[str] = "union", mode: str = "overwrite",
) -> str:
    """The rows given, flattened, with a header. ``sep`` joins nested names; cells are cut by commas, or tabs in ``.tsv``."""
    if columns != "union" and isinstance(columns, str):
        raise RecordError(f"columns={columns!r}: a frame has one set of columns; name them in a list, or align frames before saving")
    flat = reshape.flatten(df, sep=sep, explode=explode)
    if not isinstance(columns, str):
        flat = reshape.select(flat, list(columns))
    nested = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
    cells = [
        (text.json_encode(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name))
        for f in flat.schema.fields
    ]
    flat.select(*cells).write.mode(mode).option("header", True).option("sep", _delimiter(path)).option("escape", '"').options(
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def save_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Records with their nesting and their nulls, one object per line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


save_ndjson = save_json


def save_parquet(df: DataFrame, path: str, flatten: bool = True, mode: str = "overwrite") -> str:
    (reshape.flatten(df) if flatten else df).write.mode(mode).parquet(path)
    return path


def convert(spark: SparkSession, source: str, target: str) -> str:
    """From one format to another; JSON documents give the records inside them."""
    documents = format_of(source) == "json"
    return save(read_json_table(spark, source) if documents else read(spark, source), target)
