"""Errors raised by the operators."""

from __future__ import annotations

import difflib
from collections.abc import Iterable


class RecordError(ValueError):
    """A request that cannot be planned: unknown column, bad option, wrong type."""


class GateFailed(AssertionError):
    """A data-quality gate did not hold.

    ``code`` differs from an ordinary failure so that a job can tell wrong data from a
    broken run.
    """

    code = 4


def suggest(name: str, available: Iterable[str]) -> str:
    names = list(available)
    close = difflib.get_close_matches(name, names, n=1)
    hint = f"did you mean {close[0]!r}? " if close else ""
    return f"{hint}columns: {', '.join(names[:8])}"


def require_columns(available: Iterable[str], wanted: Iterable[str], side: str = "") -> None:
    names = list(available)
    for column in wanted:
        if column not in names:
            where = f" on the {side} side" if side else ""
            raise RecordError(f"column {column!r} does not exist{where}; {suggest(column, names)}")
