"""All-or-nothing publication by generations, content digests and reuse of stored results."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import GateFailed, RecordError
from recordloom.operators.schema import col

_HEX = 15


# -- content digest ---------------------------------------------------------------


def _canonical(c: Column, dtype: T.DataType) -> Column:
    """Maps as sorted entries, so that the order of keys does not matter."""
    if isinstance(dtype, T.MapType):
        inner = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), _canonical(e["value"], dtype.valueType).alias("v")))
        return F.sort_array(F.transform(inner, lambda e: F.struct(e["k"], F.to_json(F.struct(e["v"]), {"ignoreNullFields": "false"}).alias("v"))))
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, dtype.elementType))
    return c


def _cells(df: DataFrame) -> tuple[str, Column]:
    """The names and types of a frame, and one text per row: cells in name order, null apart from empty."""
    nested = (T.MapType, T.StructType, T.ArrayType, T.VariantType)
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    cells = []
    for f in fields:
        if isinstance(f.dataType, nested):
            held = F.to_json(F.struct(_canonical(col(f.name), f.dataType).alias("v")), {"ignoreNullFields": "false"})
            cells.append(F.when(col(f.name).isNull(), "n").otherwise(F.concat(F.lit("v"), held)))
        else:
            cells.append(F.coalesce(F.concat(F.lit("v"), col(f.name).cast("string")), F.lit("n")))
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields), F.concat_ws("\x1f", *cells)


def _sums(df: DataFrame) -> tuple[str, list[Column]]:
    """Count and two exact sums over halves of each row's MD5: they need no order and merge freely."""
    tags, text = _cells(df)
    hashed = F.md5(text)
    halves = [F.conv(F.substring(hashed, at, _HEX), 16, 10).cast("decimal(38,0)") for at in (1, 1 + _HEX)]
    sums = [F.coalesce(F.sum(half), F.lit(0)).cast("string").alias(f"sum{i}") for i, half in enumerate(halves)]
    return tags, [F.count(F.lit(1)).alias("rows"), *sums]


def _digest(tags: str, found: dict) -> str:
    return hashlib.md5(f"{tags}|{found['rows']}|{found['sum0']}|{found['sum1']}".encode()).hexdigest()


def table_digest(df: DataFrame) -> DataFrame:
    """``rows, digest``: the same for the same rows in any order, any partitioning, any column order.

    Each row is hashed as text; the hashes are summed exactly and sealed with names and types.
    """
    tags, parts = _sums(df)
    sealed = F.md5(F.concat_ws("|", F.lit(tags), F.col("rows").cast("string"), "sum0", "sum1"))
    return df.agg(*parts).select("rows", sealed.alias("digest"))


def digest_of(df: DataFrame) -> str:
    return table_digest(df).first()["digest"]


def observed_or(seen: Observation, nothing: dict) -> dict:
    """What was observed; ``nothing`` if the frame was known to be empty, for then no task observes."""
    try:
        return seen.get
    except Py4JJavaError:
        return nothing


def write_digested(df: DataFrame, path: str) -> dict:
    """Write a frame as Parquet; its ``path, rows, digest``, observed while it was written."""
    tags, parts = _sums(df)
    seen = Observation()
    df.observe(seen, *parts).write.mode("errorifexists").parquet(path)
    found = observed_or(seen, {"rows": 0, "sum0": "0", "sum1": "0"})
    return {"path": path, "rows": found["rows"], "digest": _digest(tags, found)}


# -- files ------------------------------------------------------------------------


class Files:
    """The few Hadoop file-system calls that publication needs, on any store Spark can reach."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def write_text(self, path: str, text: str) -> None:
        """Write aside, then take the place of ``path`` in one step: a reader meets the old text or the new."""
        scratch = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        fs, p = self._at(scratch)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        fs_class = self._jvm.org.apache.hadoop.fs
        over = fs_class.Options.Rename.OVERWRITE
        ways = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        ways[0] = over
        context = fs_class.FileContext.getFileContext(p.toUri(), self._conf)
        context.rename(fs.makeQualified(p), fs.makeQualified(fs_class.Path(path)), ways)

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def list(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        found = fs.globStatus(p)
        return sorted(s.getPath().toString() for s in found) if found else []


# -- publication ------------------------------------------------------------------

Gate = Callable[[DataFrame], DataFrame]
POINTER, SEAL = "current.txt", "sealed.json"


@dataclass(frozen=True)
class Generation:
    """A published set of outputs: where each lies, its rows and its digest."""

    name: str
    outputs: dict[str, dict]


@dataclass(frozen=True)
class Standing:
    """What a publication folder holds.

    ``current`` is what the pointer names and ``sound`` whether that is sealed and, if asked,
    unchanged; ``ready`` are sealed generations the pointer never reached or has left, ``torn``
    those whose writing was cut off.
    """

    current: str | None
    sound: bool
    ready: tuple[str, ...]
    torn: tuple[str, ...]


def _home(folder: str, generation: str) -> str:
    return f"{folder.rstrip('/')}/generations/{generation}"


def _sealed(files: Files, folder: str, generation: str) -> Generation | None:
    note = f"{_home(folder, generation)}/{SEAL}"
    return Generation(generation, json.loads(files.read_text(note))) if files.exists(note) else None


def _pointed(files: Files, folder: str) -> str | None:
    pointer = f"{folder.rstrip('/')}/{POINTER}"
    return files.read_text(pointer).strip() if files.exists(pointer) else None


def prepare(outputs: dict[str, DataFrame], gates: dict[str, Gate], folder: str, run_id: str) -> Generation:
    """Write a generation into its own folder, check what was written, and seal it.

    A gate gives ``check, ok, found`` rows, such as ``quality.gate``. If one fails, the folder
    goes and ``GateFailed`` tells which. Nobody reads a generation before the pointer names it.
    """
    spark = next(iter(outputs.values())).sparkSession
    files, name = Files(spark), f"{run_id}-{uuid.uuid4().hex[:8]}"
    home = _home(folder, name)
    written = {o: write_digested(frame, f"{home}/{o}") for o, frame in outputs.items()}
    broken = [
        f"{o}.{r['check']} (found {r['found']})"
        for o in sorted(gates) if o in written
        for r in gates[o](spark.read.parquet(written[o]["path"])).collect() if not r["ok"]
    ]
    if broken:
        files.remove(home)
        raise GateFailed("nothing was published: " + "; ".join(broken))
    files.write_text(f"{home}/{SEAL}", json.dumps(written, indent=2, sort_keys=True))
    return Generation(name, written)


def switch(spark: SparkSession, folder: str, generation: str) -> Generation:
    """Let the pointer name a sealed generation: one small file is replaced, no data moves."""
    files = Files(spark)
    sealed = _sealed(files, folder, generation)
    if sealed is None:
        raise RecordError(f"{generation!r} is no sealed generation of {folder}")
    files.write_text(f"{folder.rstrip('/')}/{POINTER}", generation)
    return sealed


def publish_validated(outputs: dict[str, DataFrame], gates: dict[str, Gate], folder: str, run_id: str) -> Generation:
    """Publish every output, or nothing when any gate fails on the data as written."""
    spark = next(iter(outputs.values())).sparkSession
    return switch(spark, folder, prepare(outputs, gates, folder, run_id).name)


def published(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """An output of the generation the pointer names. A frame once read stays with its generation."""
    files = Files(spark)
    name = _pointed(files, folder)
    sealed = _sealed(files, folder, name) if name else None
    if sealed is None or output not in sealed.outputs:
        raise RecordError(f"{folder} publishes no output {output!r}")
    return spark.read.parquet(sealed.outputs[output]["path"])


def standing(spark: SparkSession, folder: str, verify: bool = False) -> Standing:
    """What is published, what is ready and what was cut off; ``verify`` reads the current data once."""
    files = Files(spark)
    current = _pointed(files, folder)
    names = [path.rsplit("/", 1)[-1] for path in files.list(f"{folder.rstrip('/')}/generations/*")]
    sealed = {n: _sealed(files, folder, n) for n in names}
    held = sealed.get(current)
    sound = held is not None and all(files.exists(o["path"]) for o in held.outputs.values())
    if sound and verify:
        sound = all(digest_of(spark.read.parquet(o["path"])) == o["digest"] for o in held.outputs.values())
    return Standing(
        current, sound, tuple(n for n in names if sealed[n] and n != current), tuple(n for n in names if not sealed[n])
    )


def recover_publication(spark: SparkSession, folder: str, verify: bool = False) -> Standing:
    """Remove what was cut off before it was sealed; what the pointer names is not touched.

    A crash before the pointer moved leaves the old generation published and the new one torn or
    ready; ``switch`` publishes a ready one, here nothing is published that was not before.
    """
    found = standing(spark, folder, verify)
    for name in found.torn:
        Files(spark).remove(_home(folder, name))
    return found


# -- stored results ---------------------------------------------------------------


def materialize_or_reuse(
    spark: SparkSession, folder: str, name: str, version: int, inputs: dict[str, str], build: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """The stored result for (name, version, input digests), or a new one; with whether it was reused.

    A stored result counts only if its files are those that were written: their names are unique to
    a write, so the listing tells without reading the data.
    """
    files = Files(spark)
    identity = json.dumps({"name": name, "version": version, "inputs": inputs}, sort_keys=True)
    key = hashlib.sha256(identity.encode()).hexdigest()[:16]
    base = f"{folder.rstrip('/')}/{name}-{key}"
    note = f"{base}.json"
    if files.exists(note):
        kept = json.loads(files.read_text(note))
        if files.exists(kept["path"]) and _listing(files, kept["path"]) == kept["files"]:
            return spark.read.parquet(kept["path"]), True
    path = f"{base}-{uuid.uuid4().hex[:8]}"
    record = write_digested(build(), path)
    files.write_text(note, json.dumps({**record, "files": _listing(files, path), "identity": identity}))
    return spark.read.parquet(path), False


def _listing(files: Files, path: str) -> str:
    names = [f.rsplit("/", 1)[-1] for f in files.list(f"{path}/*")]
    return hashlib.md5("\n".join(names).encode()).hexdigest()
