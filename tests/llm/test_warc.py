from collections import Counter

import zstandard
from pyspark.sql import functions as F

from corpuslens.llm import queries, warc

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"
LONG = "<p>" + "é" * 200
ROWS = [
    (5, "http://a/ b\r\nX: y", LONG),
    (3, "http://a", LONG),
    (9, None, LONG),
    (None, "http://n", LONG),
    (3, "http://a", LONG),
    (1, "u", "short"),
    (2, "u", "short"),
    (4, "u", None),
    (6, "u", ""),
    (7, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 30_000),
    (8, "u", "x" * 100),
    (10, "u", "x" * 100),
    (11, "u", "y" * 99),
    (12, "u", "y" * 99),
]


def test_matches_sql(spark, db):
    got = queries.op6_archive_pages(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(db.execute(queries.WARC_SQL).fetchall())


def test_odd_rows(spark, make, db):
    path = make(ROWS, PAGE, "pages")
    got = queries.op6_archive_pages(spark, path).collect()
    want = db.execute(queries.WARC_SQL.replace("from pages", f"from '{path}/pages.parquet/*.parquet'")).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)
    assert queries.op6_archive_pages(spark, make([], PAGE, "pages")).count() == 0


def test_bundles_are_seekable(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}" * 50) for i in range(500)] + ROWS, PAGE).withColumn("size", F.lit("clash"))
    index = warc.write_bundles(pages, f"file:{tmp_path}/w", frame_bytes=4096, bundle_bytes=60_000)
    rows = index.collect()
    assert len({r.path for r in rows}) > 1 and max(r.frame for r in rows) > 3
    by_id = {}
    for path in {r.path for r in rows}:
        reader = warc.Reader(path)
        listed = reader.record_map()
        assert [x[1:] for x in listed] == [[r.frame, r.offset, r.length] for r in rows if r.path == path]
        for name, frame, offset, length in listed:
            data = reader.frame(frame)
            assert data[offset : offset + 8] == b"WARC/1.1" and data[offset : offset + length].endswith(b"\r\n\r\n")
            headers, body, end = warc.parse_record(data, offset)
            assert end == offset + length and headers["WARC-Record-ID"] == name
            by_id.setdefault(warc.page_of(name), []).append(warc.row_of(headers, body))
        whole = b"".join(reader.frame(i) for i, f in enumerate(reader.frames) if f[2])
        plain = warc.filesystem(path)[1]
        with open(plain, "rb") as file:  # any zstd tool reads the bundle as one stream
            assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == whole
    assert len(by_id[7]) == 2 and {x[-1] for x in by_id[7]} == {ROWS[9][2].encode(), b"<p>7" * 50}
    wanted = spark.createDataFrame([(17,), (400,), (77777,)], "page_id long")
    got = {r.page_id: r for r in warc.fetch(index, wanted).collect()}
    assert set(got) == {17, 400} and bytes(got[400].payload) == b"<p>400" * 50
    assert "\n" not in next(r.target_uri for r in warc.read_bundles(index).collect() if r.page_id == 5 and r.record_type == "revisit")
