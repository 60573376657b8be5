"""Every registered query against its SQL. ORACLE_SF_DIR chooses another scale."""

import os

import pytest

from paritas.queries import QUERIES

from . import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    query = QUERIES[name]
    assert query.sql, f"{name} has no SQL"
    assert oracle.differences(spark, con, query.run, query.sql, SF_DIR) == []


def test_known_numbers(spark):
    folder = "/root/testdata/sf0.01"
    stats = QUERIES["match_stats"].run(spark, folder).first()
    assert (stats.total_match, stats.missing_source, stats.missing_target) == (12255, 1617, 2488)
    fails = {r.rule: (r.fail_count, r.pass_pct)
             for r in QUERIES["execute_validation"].run(spark, folder).collect()}
    assert fails == {
        "Null values": (1429, "85.71%"),
        "Unique values": (9850, "1.50%"),
        "Values outside allowed list": (6012, "39.88%"),
        "Values not matching regex": (6002, "39.98%"),
        "Values out of range": (2547, "74.53%"),
    }
    fingerprint = QUERIES["dataset_fingerprint"].run(spark, folder).first()
    assert len(fingerprint.digest_sum.split(",")) == 4 and len(fingerprint.checksum) == 64


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
