"""Commands over a store of stage tables: python -m agestrata --store FOLDER --path TABLES COMMAND ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, Settings
from agestrata.functions.temporal import anchors_of, quarter_ends
from agestrata.operators import attract, balance, checks, figures
from agestrata.plans import stages
from agestrata.plans.names import day_of, scope_of, year_of
from agestrata.plans.store import JsonLines, Store, ordered
from agestrata.sources.base import load


def _options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="agestrata")
    p.add_argument("--store", required=True, help="folder of the stage tables")
    p.add_argument("--source", default="star")
    p.add_argument("--path", default="", help="folder of the source's tables")
    p.add_argument("--start"), p.add_argument("--end"), p.add_argument("--log", default="WARNING")

    def own_folder(s: argparse.ArgumentParser) -> None:
        s.add_argument("--run", action="store_true", help="put reports in a folder of this run's own"), s.add_argument("--label", default="", help="ends the folder's name")

    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run-all", *stages.STAGES):
        s = sub.add_parser(name)
        s.add_argument("--scope", action="append"), s.add_argument("--force", action="store_true")
        s.add_argument("--fail-fast", action="store_true", help="write nothing where a scope fails")
        if name == "run-all":
            s.add_argument("--from-stage"), own_folder(s)
    sub.add_parser("types").add_argument("--snapshot")
    sub.add_parser("magnetism").add_argument("--year")
    s = sub.add_parser("plot")
    s.add_argument("--list", action="store_true", help="the figures there are"), s.add_argument("--highlight", action="append", help="a scope whose point is marked")
    s.add_argument("--figure", default="all"), s.add_argument("--scope", action="append"), s.add_argument("--snapshot"), s.add_argument("--year"), s.add_argument("--label", default="")
    s = sub.add_parser("validate")
    s.add_argument("--expected", required=True), s.add_argument("--declared"), s.add_argument("--group"), s.add_argument("--report", default="validation.md")
    s.add_argument("--verbose", action="store_true", help="print every check"), own_folder(s)
    return p


def settings_of(start: str | None, end: str | None, base: Settings = DEFAULT) -> Settings:
    """Another window moves the anchors to its last three dates."""
    if not (start or end):
        return base
    return base.but(start=day_of(start) if start else base.start, end=day_of(end) if end else base.end, anchors=None)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    o = _options().parse_args(args)
    spark = spark or SparkSession.builder.appName("agestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logging.getLogger("agestrata").handlers[:] = [handler]
    logging.getLogger("agestrata").setLevel(o.log)
    settings, store = settings_of(o.start, o.end), Store(spark, o.store)
    dates = quarter_ends(settings.start, settings.end, settings.freq_months)
    last = anchors_of(settings, dates)[2]
    if o.command == "run-all" or o.command in stages.STAGES:
        source = load(o.source)(settings, spark=spark, path=o.path)
        wanted = [scope_of(s, source.scopes()) for s in o.scope] if o.scope else None
        try:
            ran = stages.run(store, source, settings, dates, getattr(o, "from_stage", None), None if o.command == "run-all" else o.command, wanted, o.force, o.fail_fast)
        except stages.Failed as e:
            print(e)
            print(figures.markdown(stages.failures(store).orderBy("scope_id")))
            return 1
        print("ran:", ", ".join(ran) or "nothing, all is as it was")
        if o.command == "run-all" and o.run:
            print(store.run(o.label).csv("summary", stages.summary(store)))
    elif o.command == "types":
        day = day_of(o.snapshot) if o.snapshot else last
        table = ordered(balance.type_table(store.read("metrics"), store.read("scopes"), day), "types")
        print(figures.markdown(table))
        print(figures.markdown(balance.type_counts(store.read("metrics"), store.read("scopes"), day)))
    elif o.command == "magnetism":
        year = year_of(o.year or last.year)
        print(figures.markdown(ordered(attract.year_table(store.read("annual"), store.read("scopes"), year), "magnetism")))
    elif o.command == "plot" and o.list:
        print("\n".join(name + (" (of chosen scopes)" if name in figures.OF_SCOPES else "") for name in figures.FIGURES))
    elif o.command == "plot":
        day = day_of(o.snapshot) if o.snapshot else last
        wanted = [scope_of(s, store.read("scopes")) for s in o.scope or ()]
        marked = [scope_of(s, store.read("scopes")) for s in o.highlight or ()]
        if marked and o.figure not in ("all", *figures.POINTS):
            raise ValueError(f"{o.figure} has no points of scopes to highlight")
        out = store.run(o.label)
        for name, df in figures.data(store.read, None if o.figure == "all" else o.figure, wanted, day, year_of(o.year or day.year)).items():
            print(name, out.csv(name, figures.highlighted(df, marked) if marked and name in figures.POINTS else df))
    else:
        report = checks.validate(store, spark.read.schema(checks.EXPECTED).json(o.expected), spark.read.schema(checks.DECLARED).json(o.declared) if o.declared else None, last, o.group)
        print((store.run(o.label) if o.run else store).put(o.report, checks.markdown(report)))
        if o.verbose:
            print(checks.markdown(report))
        print(figures.markdown(report.groupBy("status").count()))
        return int(not checks.fatal(report).isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
