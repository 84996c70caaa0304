import gzip
import hashlib
import random
from collections import Counter


from pyspark.sql import functions as F

from maskframe.llm import warc

SF = "/root/testdata/sf0.001"


def test_every_page_is_found_by_its_url(spark, monkeypatch):
    """Whole table, hot and odd urls, repeated rows, null ids: a lookup by url and id gives the records that reading
    every block in order gives, and one by url alone all captures of it."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    rng = random.Random(1)
    rows = [tuple(r) for r in table]
    rows += [(10_000 + k, "http://hot.example.org/same", f"text {k % 9}") for k in range(300)] + [rows[0], rows[0][:2] + ("other",)]
    rows += [(None, "http://hot.example.org/same", "x"), (None, None, None), (20_000, None, ""), (20_001, "odd\nurl", "é"), (20_002, "http://Hot.example.org/same#part", "text 1")]
    rng.shuffle(rows)
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, cdx string")
    directory = warc.write_archives(spark, pages)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    read = Counter(tuple(r[c] for c in columns) for r in warc.read_archives(directory).collect())
    got = Counter(tuple(r[c] for c in columns) for r in warc.lookup(spark, directory, pages, id_col="page_id").collect())
    assert got == read and sum(got.values()) == len(rows)
    asked = spark.createDataFrame([("http://hot.example.org/same",), ("http://hot.example.org/same",), ("http://nowhere.org/",), (table[5][1],)], "url string")
    by_url = warc.lookup(spark, directory, asked, payloads=True).collect()
    hot = [r for r in by_url if r.url == "http://hot.example.org/same"]
    assert len(hot) == 2 * 302 and {r.page_id for r in hot} >= {None, 10_000, 20_002} and not [r for r in by_url if r.url == "http://nowhere.org/"]
    assert all(r.payload is None or hashlib.sha1(bytes(r.payload)).digest() for r in by_url) and {r.record_type for r in hot} == {"response", "revisit"}
    empty = warc.write_archives(spark, pages.limit(0))
    assert warc.lookup(spark, empty, pages, id_col="page_id").count() == warc.lookup(spark, directory, asked.limit(0)).count() == 0


def test_records_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(None, "a", "x"), (None, "a", "x"), (1, "a", "x"), (1, "a", "x")], "page_id long, url string, html string")
    ids = []
    for block in warc.write_archives(spark, pages).collect():
        fs, path, folder = warc._located(block.cdx)
        for line in warc.block_lines(fs, path, block.offset, block.length):
            with fs.open_input_file(f"{folder}/{line[2]}") as f:
                head = gzip.decompress(f.read_at(line[4], line[3])).split(b"\r\n\r\n")[0].decode()
            ids.append(next(x for x in head.split("\r\n") if x.startswith("WARC-Record-ID")))
    assert len(ids) == len(set(ids)) == 4


def test_query_equals_its_sql(spark):
    import duckdb

    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rows = base.sql(warc.ORACLE_SQL)
    names = sorted(rows.columns)
    got = warc.op2_warc(spark, SF).select(*map(F.col, names)).collect()
    assert sorted(map(repr, rows.select(*names).fetchall())) == sorted(repr(tuple(r)) for r in got)
