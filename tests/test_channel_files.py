"""Which of a channel's files is taken."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def test_first_address_of_all_endings(spark, tmp_path):
    urls = ["http://a.x/en/7.html", "http://b.x/en/7", "https://a.x/en/7", "https://c.x/en/8.html", "https://d.x/en/8", "https://d.x/en/.h"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT i AS page_id, u AS url, '' AS html FROM (SELECT unnest(range(6)) AS i, unnest(?) AS u)", [urls])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    got = sorted((r["path"], r["experiment"], r["channel"]) for r in queries()["s16_channel_files"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(oracle_sql()["s16_channel_files"]).fetchall())
    assert [g[0] for g in got] == ["http://a.x/en/7.html", "https://c.x/en/8.html"]
