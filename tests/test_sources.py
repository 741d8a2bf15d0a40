"""Tables of a database, read by ranges, with what goes to it and what it refuses."""

import pytest
from oracle import by_spark, by_sql
from pyspark.sql import functions as F

from agestrata import queries as star
from agestrata.config import DEFAULT
from agestrata.sources.relational import RelationalSource, Unreachable, jdbc

URL, DRIVER = "jdbc:derby:memory:agestrata-tests", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def loaded(spark):
    rows = spark.range(10, 1010).select("id", F.when(F.col("id") % 2 == 0, "opened").otherwise("closed").alias("action"), F.lit("2000-01-02 03:04:05").cast("timestamp").alias("created_at"))
    rows.write.jdbc(f"{URL};create=true", "history", "overwrite", {"driver": DRIVER, "createTableColumnTypes": "action varchar(10)"})
    rows.limit(0).write.jdbc(URL, "bare", "overwrite", {"driver": DRIVER})
    return jdbc(spark, URL, {"history": "id", "bare": "id"}, 5, driver=DRIVER)


def test_events_of_a_database_agree_with_sql(spark, sf_dir):
    assert by_spark(star.QUERIES["jdbc_events"](spark, sf_dir)) == by_sql(star.ORACLE_SQL["jdbc_events"], sf_dir)


def test_tables_are_read_by_ranges_of_the_source(loaded):
    df = loaded("history")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.rdd.getNumPartitions() == 5 and len(sizes) == 5 and max(sizes) <= 210 and sum(sizes) == 1000
    assert loaded("bare").count() == 0


def test_filters_and_columns_go_to_the_database(loaded):
    plan = loaded("history").filter("action = 'opened'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(action,opened)" in plan and "ReadSchema: struct<id:" in plan


def test_only_types_of_the_taxonomy_are_read(spark, sf_dir):
    """Arms of types that a taxonomy leaves out, and what only they need, are no part of the plan."""
    table = star._hosting(spark, sf_dir)
    for taxonomy, issues in (("prose", False), ("table1", True)):
        source = RelationalSource(DEFAULT.but(taxonomy=taxonomy), table=table)
        kinds = {r.event_type for r in source.events().select("event_type").distinct().collect()}
        assert ("issues" in kinds) == issues and kinds <= set(DEFAULT.but(taxonomy=taxonomy).types.active)


def test_what_can_t_be_read_is_named_without_secrets(spark, loaded):
    with pytest.raises(Unreachable, match="nothing at jdbc:derby:memory:agestrata-tests can't be read"):
        loaded("nothing")
    with pytest.raises(Unreachable) as e:
        jdbc(spark, "jdbc:derby:memory:none;user=me;password=secret", {"x": "id"}, driver=DRIVER)("x")
    assert "secret" not in str(e.value).split("can't be read")[0]
