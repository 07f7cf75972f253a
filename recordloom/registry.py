"""User functions: named, versioned, optionally chosen by the type of their first column."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordloom.errors import RecordError, suggest


@dataclass(frozen=True)
class Operator:
    name: str
    version: int
    call: Callable
    summary: str
    parameters: tuple[str, ...]


_OPERATORS: dict[str, Operator] = {}
_OVERLOADS: dict[tuple[str, type], Callable] = {}


def operator(name: str | None = None, version: int = 1) -> Callable[[Callable], Callable]:
    """Register a function of frames or columns. The version is part of a stored result's key.

    A name may carry a namespace, as in ``sales.margin``. Two functions cannot share a name.
    """

    def register(call: Callable) -> Callable:
        key = name or call.__name__
        known = _OPERATORS.get(key)
        if known is not None and known.call is not call:
            raise RecordError(f"the name {key!r} is taken by another function")
        doc = (inspect.getdoc(call) or "").split("\n")[0]
        _OPERATORS[key] = Operator(key, version, call, doc, tuple(inspect.signature(call).parameters))
        return call

    return register


def overload(name: str, first: type[T.DataType]) -> Callable[[Callable], Callable]:
    """Register one form of ``name`` for a first column of a Spark type or its subtypes."""

    def register(call: Callable) -> Callable:
        if (name, first) in _OVERLOADS:
            raise RecordError(f"{name} already has a form for {first.__name__}")
        _OVERLOADS[name, first] = call
        return call

    return register


def resolve(name: str, dtype: T.DataType | None = None) -> Callable:
    """The form for a type, else the general function of that name."""
    for kind in type(dtype).__mro__ if dtype is not None else ():
        if (name, kind) in _OVERLOADS:
            return _OVERLOADS[name, kind]
    if name in _OPERATORS:
        return _OPERATORS[name].call
    raise RecordError(f"no operator named {name!r}; {suggest(name, names())}")


def names() -> list[str]:
    return sorted({*_OPERATORS, *(n for n, _ in _OVERLOADS)})


def describe(name: str) -> Operator:
    if name not in _OPERATORS:
        raise RecordError(f"no operator named {name!r}; {suggest(name, names())}")
    return _OPERATORS[name]


def apply(name: str, df: DataFrame, *args, **kwargs) -> DataFrame:
    """Run a frame operator by name; an unknown keyword is an error."""
    found = describe(name)
    unknown = [k for k in kwargs if k not in found.parameters]
    if unknown:
        raise RecordError(f"{name} has no parameter {unknown[0]!r}; {suggest(unknown[0], found.parameters)}")
    return found.call(df, *args, **kwargs)


def run_script(df: DataFrame, script: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """A user's Python function over batches of rows, inside the tasks, with Arrow transfer.

    The function sees one batch at a time and must not depend on where batches are cut.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield script(frame)

    return df.mapInPandas(batches, schema)
