"""Every registered query of the vector-search engine against its SQL in DuckDB."""

import duckdb
import pytest

from shoal.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"ann_global_pull", "ann_collaborative", "khop_growth"}  # at the larger scale these are checked by the driver


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    out = [tuple(round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in plain.values.tolist()]
    return columns, sorted(out, key=str)


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SLOW])
def test_matches_sql(spark, name):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = rows(db.execute(catalog.oracle_sql()[name]).df())
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == want


def test_every_query_has_rows_where_it_has_no_sql(spark):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_leaves_llm_alone():
    from pathlib import Path

    root = Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
