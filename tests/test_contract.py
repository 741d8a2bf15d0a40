"""The driver contract: what is registered, that SQL agrees, and that the rest stands without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import by_spark, by_sql

import __spark_entry__ as entry
from agestrata import queries as star

ROOT = Path(__file__).resolve().parent.parent
#: One query of each kind; the driver compares all.
SOME = (
    "events_canonical scope_summary contract_violations side_counts_union identity_email_name commit_scope_family_project_commits firsts activity_spans_region late_spans "
    "snapshot_dates state_at_snapshot state_accumulated_age pyramid_active12m balance_metrics_supplier type_table type_counts pyramid_transition balance_by_region "
    "retention_dataset attractiveness_annual quadrant_grid tie_high newcomer_variant_C projection_eligible_cumulative projection_errors abre_table wilcoxon_stat wilcoxon_p wilcoxon_exact_p term_split_p check_cells band_l1 session_spans"
).split()


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert by_spark(star.QUERIES[name](spark, sf_dir)) == by_sql(star.ORACLE_SQL[name], sf_dir)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(star.ORACLE_SQL) <= set(star.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "agestrata", tmp_path / "agestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and 'pipeline' not in q and not [k for k in q if k[:2] == 'op' and k[2].isdigit()]"
    subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path, check=True, timeout=120)
