import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def test_base_queries_agree_with_their_sql(spark):
    from weft.plans import contract, queries as base, rules

    assert contract.plan_violations is base.QUERIES["plan_violations"]
    of_rules = [n for n, q in base.QUERIES.items() if q.__module__ == rules.__name__]
    assert set(base.QUERIES) == set(base.ORACLES) and len(of_rules) > 30
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    for name in ("group_report", "plan_metrics", "hard_components", "line_delta", "nearest_owner", "repaired_groups", "plan_violations", "implementation_tests", "tree_after", "field_changes", "group_titles", "group_markdown", "verification_status", "plan_confidence", "terminal_report", "markdown_reports", "import_targets", "place_edges", "incident_edges", *of_rules):
        assert _rows(base.QUERIES[name](spark, SF).toPandas()) == _rows(c.sql(base.ORACLES[name]).df()), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
