import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_entry(compiled):
    df = entry.entry(compiled)
    assert df.columns[:6] == ["bookid", "unitno", "sectionno", "sectionkind", "heading", "text"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["title_keys", "book_scores", "word_offsets", "page_sections", "nearest_units", "record_marks", "metadata_lookup", "stored_units", "text_lines", "unit_rules", "known_families"])
def test_sql_agrees(compiled, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    df = entry.queries()[name](compiled, DATA)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    want = sorted(repr([plain(v) for v in r]) for r in cursor.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect()) == want
