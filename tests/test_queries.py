"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from refsift import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fuzzy_on_tables(spark):
    """Leaders and suspects against all pairs of titles in plain Python."""
    from refsift.functions.similarity import indel_ratio

    rows = []
    for r in queries.refs(spark, SF).select("_seq", "id", "title", "year", "journal").orderBy("_seq").collect():
        title = (r["title"] or "").strip()
        if title:
            rows.append((r["_seq"], r["id"], title.lower(), r["year"], (r["journal"] or "").lower()))
    leader, want, suspects = [], {}, []
    for one in rows:
        best = None
        for head in leader:  # in order; the first that is alike to 90 takes the row, others are suspects from 80 on
            apart = abs(one[3] - head[3])
            if apart > 1:
                continue
            score = indel_ratio(head[2], one[2])
            score = 0.0 if score < 80 else score - (2 if apart else 0)
            if score >= 90:
                best = head
                break
            if score >= 80:
                suspects.append((head[1], one[1], round(score, 6)))
        if best is None:
            leader.append(one)
        else:
            want[one[1]] = best[1]
    assert want and {r["id"]: r["canonical_id"] for r in queries.queries()["fuzzy_leaders"](spark, SF).collect()} == want
    got = sorted((r["ref_a"], r["ref_b"], round(r["score"], 6)) for r in queries.queries()["suspects_band"](spark, SF).collect())
    assert got == sorted(suspects)
