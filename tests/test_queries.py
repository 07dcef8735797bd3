"""Every registered query of the library against its SQL twin."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import same_rows

from screenloom.plans import native_queries, page_queries  # noqa: F401
from screenloom.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE[name])


PAGE_QUERIES = "s5_read_html_pages p6_hidden_html p10_html_role p14_html_name p21_html_states html_rules flagship_page_scores s3_read_web_trees s7_read_targets".split()


@pytest.mark.parametrize("name", PAGE_QUERIES)
def test_pages_same_as_sql_on_more_rows(spark, sf, name):
    """The small tables hold few of the texts that tell a reader and its twin apart."""
    import duckdb

    larger = Path(sf).parent / "sf0.01"
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in larger.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    same_rows(QUERIES[name](spark, str(larger)), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_with_references_that_are_cut_off(spark, tmp_path):
    """A title cut within a reference: old names and numbers are read without their semicolon, ``apos`` and others are not."""
    import duckdb

    rows = [(1, "<h1>lords &amp</h1>"), (2, "<h1>a &lt b &#39 c &#39&#39; &apos d &am</h1><p>x &amp;lt &quot</p>"), (3, "<h1>&amp;amp &ampx</h1>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(QUERIES["p14_html_name"](spark, str(tmp_path)), con, ORACLE["p14_html_name"])
