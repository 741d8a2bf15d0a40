"""The schema of every stage table."""

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_OF = {
    "events": "scope_id long, contributor_id long, event_type string, timestamp timestamp",
    "scopes": "scope_id long, label string, language string, created_at timestamp",
    "spans": "scope_id long, contributor_id long, span_start timestamp, span_end timestamp, span_idx int, init_c timestamp, init_d timestamp",
    "state": "scope_id long, snapshot timestamp, contributor_id long, category string, age_days double, age_months double, band int, idle_days double, active boolean",
    "metrics": "scope_id long, snapshot timestamp, coding long, non_coding long, new long, experienced long, total long, ccr double, ncr double, type string",
    "dev_years": "scope_id long, contributor_id long, year int",
    "annual": "scope_id long, year int, devs long, newcomers_here long, newcomers_total long, retained long, magnetism double, stickiness double, eligible boolean, "
    "median_magnetism double, median_stickiness double, quadrant string, left_censored boolean, right_censored boolean",
    "projection": "scope_id long, type string, category string, band int, actual double, cohort_pred double, baseline_pred double, abre_cohort double, abre_baseline double",
}
#: The order that each table is shown in; - is descending, nulls are last.
ORDERS = {
    "events": ("scope_id", "contributor_id", "timestamp", "event_type"), "spans": ("scope_id", "contributor_id", "span_idx"), "state": ("scope_id", "snapshot", "contributor_id"),
    "metrics": ("scope_id", "snapshot"), "types": ("type", "label"), "dev_years": ("scope_id", "contributor_id", "year"), "annual": ("year", "scope_id"),
    "quadrants": ("year", "quadrant", "label"), "magnetism": ("-magnetism", "label"), "projection": ("scope_id", "category", "band"), "pyramid": ("scope_id", "snapshot", "band"),
    "scopes": ("scope_id",),
}
_TYPES = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}
SCHEMAS = {name: StructType([StructField(c, _TYPES[t]) for c, t in (f.split() for f in ddl.split(", "))]) for name, ddl in _OF.items()}


def conform(df, name: str):
    """df with exactly the columns and types of a stage table."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
