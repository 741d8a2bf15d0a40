"""Merging identities: users who share an e-mail key (or a name key) are one, known by the least id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.functions.components import components
from agestrata.functions.lineage import written

# Names that identify nobody.
EMPTY_NAMES = (
    "unknown", "none", "n/a", "na", "null", "admin", "administrator", "system administrator", "root", "nobody", "your name", "user", "test", "guest", "-", "--", "?",
)


#: White space of any kind, as code points.
_SPACE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def email_key(c: Column) -> Column:
    c = F.lower(_trimmed(c))
    return F.when(c.contains("@") & ~c.startswith("@"), c)


def name_key(c: Column) -> Column:
    """Lower case, single spaces; names of one word or on the list of empty ones have no key."""
    c = F.trim(F.regexp_replace(F.lower(c), f"{_SPACE}+", " "))
    return F.when((F.size(F.split(c, " ")) >= 2) & ~c.isin(*EMPTY_NAMES), c)


def _keyed(users: DataFrame, mode: str) -> DataFrame:
    """id, key: a row for each key of a user."""
    if mode not in ("email", "email_name"):
        raise ValueError(f"identity merge must be email or email_name, not {mode!r}")
    keys = [F.concat(F.lit("e:"), email_key(F.col("email")))] + ([F.concat(F.lit("n:"), name_key(F.col("name")))] if mode == "email_name" else [])
    return users.select("id", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def alias_map(users: DataFrame, mode: str) -> DataFrame:
    """id, canonical for every user who is known by another id. mode: email or email_name.

    Each user of a key is linked to its least user; components of these links are people. Minima are aggregated before
    the shuffle, so a key that very many users share is no hot group.
    """
    keyed = written(_keyed(users, mode), "identity-keys")
    least = written(keyed.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b < last").select("key", "b"), "identity-least")
    links = keyed.join(least, "key").select(F.col("id").alias("a"), "b")
    return components(links).filter("v <> root").select(F.col("v").alias("id"), F.col("root").alias("canonical"))


def alias_map_by_scope(people: DataFrame, users: DataFrame, mode: str) -> DataFrame:
    """scope_id, id, canonical: as alias_map, but among the contributors of each scope alone (people: scope_id,
    contributor_id), so that nobody is merged through a person whom the scope doesn't know."""
    own = people.select("scope_id", F.col("contributor_id").alias("id")).distinct()
    keyed = written(own.join(_keyed(users, mode), "id"), "identity-keys")
    least = keyed.groupBy("scope_id", "key").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last")
    least = written(least.select("scope_id", "key", "least"), "identity-least")
    links = keyed.join(least, ["scope_id", "key"]).select(F.struct("scope_id", "id").alias("a"), F.struct("scope_id", F.col("least").alias("id")).alias("b"))
    found = components(links).filter("v <> root")
    return found.select("v.scope_id", "v.id", F.col("root.id").alias("canonical"))


def merge_identities(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events under canonical ids; aliases of alias_map, or of alias_map_by_scope."""
    known = aliases.withColumnRenamed("id", "contributor_id")
    keys = [c for c in ("scope_id", "contributor_id") if c in known.columns]
    return events.join(known, keys, "left").select("scope_id", F.coalesce("canonical", "contributor_id").alias("contributor_id"), "event_type", "timestamp")
