"""Reading what a person typed: a scope, a date, a year."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_of(typed: str, scopes: DataFrame) -> int:
    """Digits are an id; else the one scope whose label ends with the text, whatever the case."""
    if typed.isdigit():
        if scopes.filter(F.col("scope_id") == int(typed)).isEmpty():
            raise ValueError(f"there is no scope {typed}")
        return int(typed)
    found = scopes.filter(F.endswith(F.lower("label"), F.lit(typed.lower()))).select("scope_id", "label").orderBy("scope_id").limit(20).collect()
    if len(found) != 1:
        raise ValueError(f"{typed!r} may be " + ", ".join(f"{r.scope_id} ({r.label})" for r in found) + "; give the id" if found else f"no scope's name ends with {typed!r}")
    return found[0].scope_id


def day_of(typed: str) -> date:
    try:
        return date.fromisoformat(typed)
    except ValueError as e:
        raise ValueError(f"{typed!r} is not a date like 2013-09-30") from e


def year_of(typed: int | str) -> int:
    """A year, or the year of a date."""
    text = str(typed)
    return int(text) if text.isdigit() else day_of(text[:10]).year
