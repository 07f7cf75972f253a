"""Compare a registered query with its SQL twin in another engine."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def difference(spark, db, folder: str, build, sql: str) -> str | None:
    """None when names, types and rows agree, else a short account of what does not."""
    frame = build(spark, folder)
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    wanted = _rows(names, found.fetchall())
    types = dict(frame.dtypes)
    wrong = {n: (types[n], kinds[n]) for n in names if types[n] != kinds[n]}
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(got) != len(wanted):
        return f"{len(got)} rows against {len(wanted)}"
    off = [(a, b) for a, b in zip(got, wanted) if a != b]
    if off:
        return f"{len(off)} of {len(got)} rows differ, first {off[0][0]} against {off[0][1]}"
    return f"types {wrong}" if wrong else None
