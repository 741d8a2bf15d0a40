"""The contract of a source, and its checks.

A source gives whole datasets as lazy DataFrames: events (scope_id, contributor_id, event_type, timestamp) and scopes
(scope_id, label, language, created_at).
"""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.config import EVENT_TYPES, Settings
from agestrata.schemas import SCHEMAS


class Source(ABC):
    def __init__(self, settings: Settings):
        self.settings = settings

    @abstractmethod
    def events(self) -> DataFrame: ...

    @abstractmethod
    def scopes(self) -> DataFrame: ...

    def provenance(self) -> dict:
        return {"source": type(self).__name__}

    def scope_label(self, scope_id: int) -> str:
        """Label of a scope; its id as text if it is unknown."""
        found = self.scopes().filter(F.col("scope_id") == scope_id).select("label").first()
        return found.label if found else str(scope_id)


_KNOWN: dict[str, str] = {"star": "agestrata.sources.star:StarSource", "relational": "agestrata.sources.relational:RelationalSource"}


def register(name: str, place: str) -> None:
    """Makes `module:Class` available as a source."""
    _KNOWN[name] = place


def load(name: str) -> Callable[..., Source]:
    if name not in _KNOWN:
        raise ValueError(f"unknown source {name!r}; available: {', '.join(sorted(_KNOWN))}")
    module, _, cls = _KNOWN[name].partition(":")
    found = getattr(importlib.import_module(module), cls)
    if not (isinstance(found, type) and issubclass(found, Source)):
        raise TypeError(f"{_KNOWN[name]} is not a Source")
    return found


def clean(raw: DataFrame) -> DataFrame:
    """Canonical events from raw columns scope_id, contributor_id (any number), event_type, timestamp (text or time):
    rows without a contributor or with a date that can't be read are dropped."""
    kind = dict(raw.dtypes)["timestamp"]
    ts = F.try_to_timestamp("timestamp") if kind == "string" else F.col("timestamp").cast("timestamp")
    return raw.select(
        F.col("scope_id").cast("long"), F.col("contributor_id").cast("long"), F.col("event_type").cast("string"), ts.alias("timestamp")
    ).filter("contributor_id is not null and timestamp is not null")


def rules(now: Column | None = None) -> dict[str, Column]:
    """What no event may be, by name of the rule."""
    return {
        "null_contributor": F.col("contributor_id").isNull(),
        "null_timestamp": F.col("timestamp").isNull(),
        "unknown_type": ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)),
        "future_timestamp": F.coalesce(F.col("timestamp") > (F.current_timestamp() if now is None else now), F.lit(False)),
    }


def violations(events: DataFrame, now: Column | None = None) -> DataFrame:
    """rule, rows: how many rows break each rule of the contract, in one pass. Raises if columns or types are not the contract's."""
    want = [(f.name, f.dataType.simpleString()) for f in SCHEMAS["events"]]
    if events.dtypes != want:
        raise TypeError(f"events must have {want}, not {events.dtypes}")
    one = events.agg(*[F.count_if(c).alias(name) for name, c in rules(now).items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules()])).alias("v")).select("v.rule", "v.rows")


def check_scopes(scopes: DataFrame, expected: int | None = None) -> None:
    """Raises unless scopes has the contract's columns (more may follow) of the contract's types, every scope has a label,
    none stands twice, and their number is as expected."""
    want, have = {f.name: f.dataType.simpleString() for f in SCHEMAS["scopes"]}, dict(scopes.dtypes)
    if wrong := [f"{c} {t}" for c, t in want.items() if have.get(c) != t]:
        raise TypeError(f"scopes must have {', '.join(wrong)}")
    per = scopes.groupBy("scope_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("label"), F.lit("")) == "").alias("bare"))
    got = per.agg(F.count("*").alias("n"), F.coalesce(F.sum("bare"), F.lit(0)).alias("bare"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("scope_id").isNull()).alias("nameless")).first()
    if got.bare or got.twice or got.nameless:
        raise ValueError(f"{got.bare} scopes have no label, {got.twice} stand more than once, {got.nameless} have no id")
    if expected is not None and got.n != expected:
        raise ValueError(f"{got.n} scopes, {expected} expected")
