"""The stages from events to projections, each a stored table that later ones and all reads start from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, Settings
from agestrata.functions.lineage import discard, written
from agestrata.functions.temporal import anchors_of, midnight, quarter_ends
from agestrata.operators import attract, balance, projection, spans, state
from agestrata.plans.store import Failed, Store, log
from agestrata.schemas import SCHEMAS
from agestrata.sources.base import Source, check_scopes, rules, violations

#: Stages in order, the tables of each and the stages it reads.
STAGES = {
    "extract": (("events", "scopes"), ()), "classify": (("spans",), ("extract",)), "snapshots": (("state",), ("classify",)), "metrics": (("metrics",), ("snapshots",)),
    "attractiveness": (("dev_years", "annual"), ("extract",)), "projection": (("projection",), ("snapshots", "metrics")),
}


#: Stages of the whole dataset: denominators, medians and samples are over all scopes, so they can't be run for some.
GLOBAL = ("attractiveness", "projection")


def _extract(store: Store, source: Source, settings: Settings, dates: list[date], todo: DataFrame | None) -> dict[str, DataFrame]:
    return {"events": _some(source.events(), todo), "scopes": _some(source.scopes(), todo)}


def _some(table: DataFrame, todo: DataFrame | None) -> DataFrame:
    return table if todo is None else table.join(todo.select("scope_id"), "scope_id", "left_semi")


def _classify(store, source, settings, dates, todo):
    return {"spans": spans.activity_spans(_some(store.read("events"), todo), settings)}


def _snapshots(store, source, settings, dates, todo):
    return {"state": state.state_at(_some(store.read("spans"), todo), dates, settings)}


def _metrics(store, source, settings, dates, todo):
    return {"metrics": balance.metrics(_some(store.read("state"), todo))}


def _attractiveness(store, source, settings, dates, todo):
    pairs = attract.dev_years(store.read("events"), settings.types.coding)
    return {"dev_years": pairs, "annual": attract.annual(pairs, settings)}


def _projection(store, source, settings, dates, todo):
    three = anchors_of(settings, dates)
    at = store.read("state").filter(F.col("snapshot").isin(*[midnight(d) for d in three]))
    types = store.read("metrics").filter(F.col("snapshot") == midnight(three[2]))
    return {"projection": projection.errors(projection.cohort_projection(projection.band_vectors(at, three, settings)), types)}


_RUN: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "extract": _extract, "classify": _classify, "snapshots": _snapshots, "metrics": _metrics, "attractiveness": _attractiveness, "projection": _projection,
}


def _units(store: Store, source: Source, name: str) -> DataFrame:
    """scope_id, of: the scopes that a stage is made of, with the digest of what their rows are made from."""
    if name == "extract":
        return source.scopes().select("scope_id", F.lit("").alias("of"))
    up = STAGES[STAGES[name][1][0]][0][0]
    return store.scope_entries(up).filter("status = 'ok'").select("scope_id", F.coalesce("digest", F.lit("0")).alias("of"))


def _by_scope(store: Store, source: Source, settings: Settings, dates: list[date], name: str, key: str, scopes: list[int] | None, force: bool, fail_fast: bool) -> bool | None:
    """Makes what is missing of a stage that goes by scope: scopes without an entry of this key, that failed, or whose
    input is newer. True if something was made, None if some scopes failed."""
    tables, main = STAGES[name][0], STAGES[name][0][0]
    whole = all(store.whole(t) for t in tables)
    have = store.scope_entries(main).select("scope_id", (F.col("status") == "ok").alias("was"), (F.col("key") == key).alias("same"), F.col("of").alias("made_of"))
    both = _units(store, source, name).withColumn("unit", F.lit(True)).join(have, "scope_id", "full")
    missing = F.lit(True) if force or not whole else ~F.coalesce(F.col("was") & F.col("same") & (F.col("made_of") == F.col("of")), F.lit(False))
    asked = F.lit(True) if scopes is None else F.col("scope_id").isin(*scopes)
    if not whole and scopes is not None:
        asked = asked | F.coalesce("was", F.lit(False))  # a table that isn't whole is made again for all that it had
    both = written(both.withColumns({"todo": F.coalesce("unit", F.lit(False)) & missing & asked, "gone": F.col("unit").isNull() & F.col("was")}), "units")
    n = both.agg(F.count("unit").alias("units"), F.count_if("todo").alias("todo"), F.count_if("gone").alias("gone")).first()
    gone = n.gone and scopes is None  # scopes that are no more
    if not n.todo and not gone:
        discard(both)
        log.info("as it was", extra={"stage": name})
        return False
    part = whole and not gone and n.todo < n.units
    made_of = both.filter("todo" if part or scopes is not None else "unit").select("scope_id", "of")
    every = scopes is None and not part
    out = _RUN[name](store, source, settings, dates, None if every else made_of)
    for table, df in out.items():
        checked = rules() if table == "events" else None
        # state of all scopes comes from the buckets of spans, and is in their order
        in_order = len(dates) if table == "state" and every else 0
        store.write(table, df, key, made_of if part else None, made_of if table == main else None, checked, fail_fast, in_order)
    discard(both)
    return None if name == "extract" and not failures(store, "extract").isEmpty() else True


def run(
    store: Store, source: Source, settings: Settings = DEFAULT, dates: list[date] | None = None, first: str | None = None, only: str | None = None,
    scopes: list[int] | None = None, force: bool = False, fail_fast: bool = False,
) -> list[str]:
    """Runs the stages and returns those that ran. What a stage made with the same settings, dates and source, from the
    same input, is left as it is, scope by scope; so are stages before `first`.

    scopes: only these are made, the rows of others stay. The stages of the whole dataset refuse to be run for some
    scopes, and are left out of a run of all stages for some. A scope whose events break the contract is listed in the
    manifest and has no rows; the others are written, and the run ends after that stage with Failed. fail_fast: nothing
    is written then.
    """
    dates = quarter_ends(settings.start, settings.end, settings.freq_months) if dates is None else dates
    for name in (first, only):
        if name is not None and name not in STAGES:
            raise ValueError(f"no stage {name!r}; there are {', '.join(STAGES)}")
    if only in GLOBAL and scopes is not None:
        raise ValueError(f"{only} can't be run for some scopes: its ratios, medians and samples are over the whole dataset")
    order, ran = list(STAGES), []
    if first:
        order = order[order.index(first) :]
    if scopes is not None:
        order = [name for name in order if name not in GLOBAL]
    base = repr((sorted(asdict(settings).items(), key=str), dates, sorted(source.provenance().items())))
    for name in order if only is None else [only]:
        tables, reads = STAGES[name]
        key = hashlib.sha256(f"{name}|{base}".encode()).hexdigest()[:16]
        if name not in GLOBAL:
            if name == "extract":
                check_scopes(source.scopes(), settings.expected_scopes)
            made = _by_scope(store, source, settings, dates, name, key, scopes, force, fail_fast)
            if made is not False:
                ran.append(name)
            if made is None:
                raise Failed(f"{name}: {failures(store, name).count()} scopes failed, see the manifest; the others are written")
            continue
        known = {r.stage: r for r in store.manifest().collect()}
        inputs = [known[t].digest if t in known else "" for r in reads for t in STAGES[r][0]]
        key = hashlib.sha256("|".join([key, *inputs]).encode()).hexdigest()[:16]
        if not force and all(t in known and known[t].key == key and store.whole(t) for t in tables):
            log.info("as it was", extra={"stage": name})
            continue
        for table, df in _RUN[name](store, source, settings, dates, None).items():
            store.write(table, df, key)
        ran.append(name)
    return ran


def add_late(store: Store, late: DataFrame, settings: Settings = DEFAULT) -> list[int]:
    """Takes late events into the stored events and spans, and returns their scopes. Only units of these scopes are
    written, and only spans of contributors with late events are made anew; what later stages then find changed, they
    make again by scope. Events that are stored already are left out, so a batch that is taken in again changes nothing.
    """
    columns = SCHEMAS["events"].names
    events, spans_ = store.read("events"), store.read("spans")
    keyed = late.select(*columns).distinct()
    known = events.join(keyed.select("scope_id").distinct(), "scope_id", "left_semi")
    fresh = written(keyed.join(known, columns, "left_anti"), "late")
    entries = {name: store.scope_entries(name).filter("status = 'ok'") for name in ("events", "spans")}
    if not (unknown := fresh.join(entries["events"], "scope_id", "left_anti")).isEmpty():
        raise ValueError(f"the store has no scope {unknown.first().scope_id}")
    touched = sorted(r.scope_id for r in fresh.select("scope_id").distinct().collect())
    if touched:
        keys = store.keys()
        scopes = fresh.select("scope_id").distinct()
        made = spans.with_late(spans_, fresh, settings)
        rest = spans_.join(scopes, "scope_id", "left_semi").join(fresh.select(*spans.KEY).distinct(), list(spans.KEY), "left_anti")
        made = written(rest.unionByName(made), "late-spans")
        of = entries["events"].join(scopes, "scope_id", "left_semi").select("scope_id", "of")
        store.write("events", events.join(scopes, "scope_id", "left_semi").unionByName(fresh), keys["events"], scopes, of, rules())
        of = store.scope_entries("events").join(scopes, "scope_id", "left_semi").select("scope_id", F.col("digest").alias("of"))
        store.write("spans", made, keys["spans"], scopes, of)
        discard(made)
    discard(fresh)
    return touched


def failures(store: Store, stage: str = "extract") -> DataFrame:
    """scope_id, reason: the scopes that failed when a stage was last run for them."""
    return store.scope_entries(STAGES[stage][0][0]).filter("status = 'failed'").select("scope_id", "reason")


def broken(store: Store) -> DataFrame:
    """rule, rows: what the stored events break of the contract."""
    return violations(store.read("events"))


def labels(store: Store, source: Source | None = None) -> DataFrame:
    """scope_id, label, language, created_at from the stored table, or from the source where there is none yet."""
    return store.read("scopes") if store.has("scopes") or source is None else source.scopes()


def last_metrics(metrics: DataFrame) -> DataFrame:
    """The last row of each scope."""
    rest = [c for c in metrics.columns if c != "scope_id"]
    return metrics.groupBy("scope_id").agg(F.max_by(F.struct(*rest), "snapshot").alias("last")).select("scope_id", "last.*")


def summary(store: Store) -> DataFrame:
    """Per scope: events, contributors and spans, and its last metrics."""
    events, own = spans.scope_summary(store.read("events")), spans.span_summary(store.read("spans")).select("scope_id", "spans", "later_spans")
    return events.join(own, "scope_id", "left").join(last_metrics(store.read("metrics")), "scope_id", "left")
