import base64
import hashlib

from playlens.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string, copy int, revisit boolean")


def test_revisits(spark):
    rows = [(5, "u", "same"), (3, "v\r\nX: 1", "same"), (9, None, "WARC/1.1\r\n\r\nquoted"), (4, "w", None), (2, "x", ""), (7, "y", "same"), (7, "y", "same"), (None, "z", "none"), (None, "z", "none"), (11, "long", "é" * 50000)]
    got = warc.rewritten(pages(spark, [(*r, None, None, None) for r in rows]).repartition(3)).collect()
    assert len(got) == len(rows)
    one = {r.page_id: r for r in got}
    assert (one[3].record_type, one[3].refers_to) == ("response", None)
    assert (one[5].record_type, one[5].refers_to) == ("revisit", 3)
    assert [r.refers_to for r in got if r.page_id == 7] == [3, 3]
    assert (one[2].record_type, one[4].record_type, one[4].refers_to) == ("response", "revisit", 2)
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    for page, _, html in rows:
        if page is not None:
            raw = (html or "").encode()
            assert one[page].payload_bytes == len(raw)
            assert one[page].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert warc.rewritten(pages(spark, [])).count() == 0
    small = {r.page_id: r.record_type for r in warc.rewritten(pages(spark, [(*r, None, None, None) for r in rows]), least_bytes=5).collect()}
    assert small[5] == "response" and small[11] == "response"


def test_sql_says_the_same(spark):
    import duckdb

    from playlens.llm import queries
    from tests.llm.conftest import SF

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(queries.SQL["op7_warc_revisits"]).df().sort_values("page_id").reset_index(drop=True)
    got = queries.QUERIES["op7_warc_revisits"](spark, SF).toPandas().sort_values("page_id").reset_index(drop=True)
    for c in want:
        assert got[c].astype(object).where(got[c].notna(), None).tolist() == want[c].astype(object).where(want[c].notna(), None).tolist(), c
