import os

import duckdb
import pytest

from granary.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["rec_no", "field_name", "noise"], "p2_found": ["rec_no", "field_name", "markup"], "p3_found": ["rec_no", "field_name"], "p4_found": ["rec_no", "lang"],
    "p5_found": ["rec_no", "content_class"], "p6_found": ["rec_no", "field_name", "band"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_its_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows, name
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    result = con.sql(queries.ORACLES[name])
    assert sorted(result.columns) == sorted(df.columns)
    at = [result.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in rows), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_documents_found_by_their_share_need_no_thresholds(spark, monkeypatch):
    text = "the farm feeds the soil of the whole village in dry years "
    docs = spark.createDataFrame([(1, text * 9, "en", "a"), (2, text, "en", "a"), (3, None, None, None), (4, text * 9, "fr", "b")], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(queries, "_docs", lambda *_: docs)
    assert sorted(r.doc_id for r in queries.p10_repetition(spark, SF).collect()) == [1, 4]
    monkeypatch.setattr(queries.repetition, "group_thresholds", lambda *_: pytest.fail("thresholds are learnt that decide nothing"))
    assert sorted(r.doc_id for r in queries.p10_found(spark, SF).collect()) == [1, 4]
