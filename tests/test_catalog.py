"""Every registered query against its SQL, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from argloom.catalog.oracle import ORACLE  # noqa: E402
from argloom.catalog.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.tables(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_of_the_catalog_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    outcome = check.compare(spark, con, name, FOLDER)
    assert outcome.startswith("ok"), outcome
    assert "types" not in outcome, outcome


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_reports_are_summed_up_by_folder(spark):
    from argloom.catalog.queries import _by_folder

    rows = [("a", 3, 3, "done"), ("a", 4, 4, "done"), ("b", 2, 2, "done"), ("b", 5, 1, "failed"), ("c", None, 0, "failed")]
    files = [(f"file:/x/lang={f}/part-{n}", None, e, r, s) for n, (f, e, r, s) in enumerate(rows)]
    report = spark.createDataFrame(files, "source_file STRING, path STRING, expected BIGINT, read BIGINT, status STRING")
    found = {tuple(r) for r in _by_folder(report, "file:/x").collect()}
    assert found == {("lang=a", 7, 7, "done"), ("lang=b", 7, 3, "failed"), ("lang=c", None, 0, "failed")}
