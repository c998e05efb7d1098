"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from callweave.plans import registry

SF = "/root/testdata/sf0.001"


def values(rows):
    def plain(x):
        if isinstance(x, float):
            return "" if math.isnan(x) else f"{x:.9g}"
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None).isoformat()
        return str(x)

    return sorted(tuple(plain(float(x) if isinstance(x, int) and not isinstance(x, bool) else x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert values(got.select(*columns).collect()) == values(want)


def test_runs_of_number_words_are_returned(spark, tmp_path):
    texts = ["one two three for", "pay one two  three for one. x", "a two two two b", "one two three for one two b two one for three", "mail a.b@c.org One two THREE for", "for-one two three for two one", "", None, "one two three xfor", "y"]
    df = spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["pii_mask"](spark, str(tmp_path)).select("doc_id", "masked", "reasons").collect()
    run = "spoken_number_sequence"
    assert {r[0]: (r[1], r[2]) for r in got} == {
        0: ("[NUMBER_SEQ]", run), 1: ("pay [NUMBER_SEQ] one. x", run), 2: ("a two two two b", ""), 3: ("[NUMBER_SEQ] b [NUMBER_SEQ]", run), 4: ("mail [EMAIL] [NUMBER_SEQ]", f"email|{run}"),
        5: ("for-one [NUMBER_SEQ]", run), 6: ("", ""), 7: ("", ""), 8: ("one two three xfor", ""), 9: ("y", ""),
    }
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert values(got) == values(c.execute(f"SELECT doc_id, masked, reasons FROM ({registry.oracle_sql()['pii_mask']})").fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
