"""Canonical events from tables of a code-hosting service, read by JDBC or from files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agestrata.config import DEFAULT, Settings
from agestrata.operators.identity import alias_map_by_scope, merge_identities
from agestrata.sources.base import Source, clean

COMMIT_SCOPES = ("root", "family_project_commits", "family_project_id")


class Unreachable(Exception):
    """A table of a database can't be read."""


def jdbc(spark: SparkSession, url: str, keys: dict[str, str], partitions: int = 32, **options) -> Callable[[str], DataFrame]:
    """A reader of a database's tables. keys: a numeric or time column by table; such a table is read in so many ranges of
    it at once, between the ends that the database itself gives. Filters and columns go to the database, by Spark. What
    the database refuses is an error that names the table and the place, without user or password."""
    place = re.sub(r"//[^/@]*@", "//", url).split(";")[0].split("?")[0]
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier

    def load(name: str, **more) -> DataFrame:
        try:
            return spark.read.format("jdbc").options(url=url, **(options | more)).load()
        except Exception as e:
            raise Unreachable(f"{name} at {place} can't be read: {str(e).strip().splitlines()[0]}") from e

    def read(name: str) -> DataFrame:
        if name not in keys:
            return load(name, dbtable=name)
        column = quoted(keys[name])
        try:
            low, high = load(name, query=f"select min({column}) as low, max({column}) as high from {name}").first()
        except Unreachable:
            raise
        except Exception as e:
            raise Unreachable(f"{name} at {place} can't be read: {str(e).strip().splitlines()[0]}") from e
        if low is None:
            return load(name, dbtable=name)
        return load(name, dbtable=name, partitionColumn=keys[name], lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))

    return read


def commits_by_scope(table: Callable[[str], DataFrame], mode: str) -> DataFrame:
    """scope_id, author_id, created_at of commits. root: by the commit's project; family_project_id: projects count for
    the one they were forked from; family_project_commits: so do links of commits to projects, each commit once a family."""
    if mode not in COMMIT_SCOPES:
        raise ValueError(f"commit scope must be one of {', '.join(COMMIT_SCOPES)}, not {mode!r}")
    commits = table("commits")
    if mode == "root":
        return commits.select(F.col("project_id").alias("scope_id"), "author_id", "created_at")
    family = table("projects").select(F.col("id").alias("project_id"), F.coalesce("forked_from", "id").alias("scope_id"))
    if mode == "family_project_id":
        return commits.join(family, "project_id").select("scope_id", "author_id", "created_at")
    links = table("project_commits").join(family, "project_id").select("scope_id", "commit_id").distinct()
    return links.join(commits, F.col("commit_id") == F.col("id")).select("scope_id", "author_id", "created_at")


class RelationalSource(Source):
    """table: gives a table by name. Tables: projects, users, commits, project_commits, pull_requests,
    pull_request_history, commit_comments, issues, issue_comments, pull_request_comments, issue_events."""

    def __init__(
        self, settings: Settings = DEFAULT, *, table: Callable[[str], DataFrame] | None = None, spark: SparkSession | None = None, path: str = "", commit_scope: str = "root",
        identity_merge: str = "none", exclude: tuple[int, ...] = (),
    ):
        """Without table, the tables are Parquet files of their names in path."""
        super().__init__(settings)
        table = table or (lambda name: spark.read.parquet(f"{path}/{name}.parquet"))
        self.table, self.commit_scope, self.identity_merge, self.exclude = table, commit_scope, identity_merge, exclude

    def scopes(self) -> DataFrame:
        own = self.table("projects").filter("forked_from is null")
        own = own.filter(~F.col("id").isin(*self.exclude)) if self.exclude else own
        users = self.table("users").select(F.col("id").alias("_owner"), "login")
        return own.join(users, F.col("owner_id") == F.col("_owner")).select(
            F.col("id").alias("scope_id"), F.concat_ws("/", "login", "name").alias("label"), F.nullif(F.col("language"), F.lit("")).alias("language"), F.col("created_at").cast("timestamp").alias("created_at")
        )

    def arms(self) -> dict[str, DataFrame]:
        """scope_id, contributor_id, timestamp by event type."""
        t = self.table

        def under(child: str, parent: str, key: str, scope: str, who: str) -> DataFrame:
            up = t(parent).select(F.col("id").alias("_parent"), F.col(scope).alias("_scope"))
            return t(child).join(up, F.col(key) == F.col("_parent")).select(F.col("_scope").alias("scope_id"), F.col(who).alias("contributor_id"), F.col("created_at").alias("timestamp"))

        opened = t("pull_request_history").filter("action = 'opened'").select("pull_request_id", F.col("created_at").alias("timestamp"))
        requests = t("pull_requests").select("id", F.col("base_repo_id").alias("scope_id"), F.col("user_id").alias("contributor_id"))
        return {
            "commits": commits_by_scope(t, self.commit_scope).toDF("scope_id", "contributor_id", "timestamp"),
            "pull_requests": requests.join(opened, F.col("id") == F.col("pull_request_id")).select("scope_id", "contributor_id", "timestamp"),
            "commit_comments": under("commit_comments", "commits", "commit_id", "project_id", "user_id"),
            "issues": t("issues").select(F.col("repo_id").alias("scope_id"), F.col("reporter_id").alias("contributor_id"), F.col("created_at").alias("timestamp")),
            "issue_comments": under("issue_comments", "issues", "issue_id", "repo_id", "user_id"),
            "pull_request_comments": under("pull_request_comments", "pull_requests", "pull_request_id", "base_repo_id", "user_id"),
            "issue_events": under("issue_events", "issues", "issue_id", "repo_id", "actor_id"),
        }

    def events(self) -> DataFrame:
        every = None
        for kind, arm in self.arms().items():
            if kind in self.settings.types.active:
                arm = clean(arm.withColumn("event_type", F.lit(kind)))
                every = arm if every is None else every.unionByName(arm)
        kept = every.join(self.scopes().select("scope_id"), "scope_id", "left_semi")
        if self.identity_merge == "none":
            return kept
        return merge_identities(kept, alias_map_by_scope(kept.select("scope_id", "contributor_id"), self.table("users"), self.identity_merge))

    def identities(self, ids: list[int]) -> DataFrame:
        """The users of some contributors as they are stored, to look into."""
        return self.table("users").filter(F.col("id").isin(*ids))

    def projects(self, ids: list[int]) -> DataFrame:
        """Owner, name and origin of some projects, forks too."""
        own = self.table("projects").filter(F.col("id").isin(*ids)).select("id", "owner_id", "name", "language", "created_at", "forked_from")
        users = self.table("users").select(F.col("id").alias("owner_id"), F.col("login").alias("owner"))
        return own.join(users, "owner_id").select("id", "owner", "name", "language", "created_at", "forked_from")
