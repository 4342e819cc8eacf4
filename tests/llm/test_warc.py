import base64
import gzip
import hashlib

from kalangu.llm import warc
from kalangu.session import fresh_path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = set()
    for i, h in rows:
        size = len((h or "").encode())
        again = i is not None and size >= least and first[h or ""] < i
        out.add((i, size, digest(h), "revisit" if again else "response", first[h or ""] if again else None, "ok"))
    return sorted(out, key=str)


def around(spark, df, **options):
    path = fresh_path(spark, "test")
    warc.write(df, path, **options)
    rows = warc.read(spark, path).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.status) for r in rows), key=str), path


ROWS = [(1, "u", "<p>é 中 😀</p>" * 60), (2, "u", "<p>é 中 😀</p>" * 60), (3, "http://x/ y\r\nz", ""), (4, None, None), (5, "u", "short"),
        (9, "u", "short"), (7, "u", "short"), (None, "u", "short"), (5, "u", "short"), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n"),
        (10, "u", "x" * 200_000), (11, "u", "x" * 200_000)]
DDL = "page_id long, url string, html string"


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, DDL)
    want = brute([(i, h) for i, _, h in ROWS])
    assert around(spark, df)[0] == want
    # segments that end inside payload, framing and header, a few records to a file
    assert around(spark, df, segment=50, chunk=37, per_file=7)[0] == want
    assert around(spark, df.repartition(5), least_bytes=100)[0] == brute([(i, h) for i, _, h in ROWS], 100)


def test_query_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert around(spark, pages, segment=700)[0] == brute([(r.page_id, r.html) for r in pages.collect()])


def test_files_are_archives(spark):
    import glob

    _, path = around(spark, spark.createDataFrame(ROWS, DDL).coalesce(1), segment=1000)
    files = glob.glob(f"{path}/*.gz")
    records = [r for f in files for r in warc.parsed(open(f, "rb").read())]
    assert files and all(b"WARC/1.1\r\n" == gzip.open(f).read(10) for f in files)
    kinds = [f["warc-type"] for f, _ in records]
    assert set(kinds) == {"response", "revisit", "continuation"}
    assert all(len(b) == int(f["content-length"]) for f, b in records)


def test_faults_are_named():
    part = lambda n, t, b: {"number": n, "total": t, "block": b}
    assert warc.assembled([part(2, 6, b"def"), part(1, None, b"abc")]) == (b"abcdef", "ok")
    assert warc.assembled([part(2, 6, b"def"), part(1, None, b"abc"), part(1, None, b"abc")]) == (b"abcdef", "ok")
    assert warc.assembled([part(1, None, b"abc")])[1] == "missing segment"
    assert warc.assembled([part(1, None, b"abc"), part(3, 6, b"def")])[1] == "missing segment"
    assert warc.assembled([part(1, None, b"abc"), part(2, 7, b"def")])[1] == "wrong length"
    assert warc.unframed(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.unframed(b"4\r\nabc\r\n0\r\n\r\n") is None and warc.unframed(b"zz\r\n") is None and warc.unframed(b"3\r\nabc\r\n") is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody") == b"body" and warc.payload_of(b"nothing") is None


def test_revisit_without_response_and_wrong_digest(spark):
    import os

    path = fresh_path(spark, "broken").replace("file:", "")
    os.makedirs(path)
    lone = warc.records(5, "u", "gone", 1)[0] + b"\r\n"
    bad = warc.records(6, "u", "here", None)[0].replace(digest("here").encode(), digest("there").encode()) + b"\r\n"
    open(f"{path}/a.warc", "wb").write(lone + bad)
    rows = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert rows[5].status == "no response" and rows[5].payload_bytes is None
    assert rows[6].status == "wrong digest"


def test_empty(spark):
    assert around(spark, spark.createDataFrame([], DDL))[0] == []


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "u", "a", "x", 1)], "page_id long, url string, html string, digest string, first int")
    assert around(spark, df)[0] == brute([(1, "a")])


def test_a_damaged_archive_costs_no_other(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>" * 50) for k in range(40)], "page_id bigint, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "good"))
    whole = next((tmp_path / "good").glob("*.gz")).read_bytes()
    (tmp_path / "all").mkdir()
    (tmp_path / "all/a.warc.gz").write_bytes(whole)
    data = gzip.decompress(whole)
    for name, body in (("cut", whole[:len(whole) // 2]), ("plain", data[:len(data) // 2 + 7]), ("noise", b"\x1f\x8bnothing"), ("text", b"no archive"), ("empty", b"")):
        (tmp_path / f"all/{name}.warc").write_bytes(body)
    rows = warc.read(spark, str(tmp_path / "all")).collect()
    good = [r for r in rows if r.record_type != "damaged"]
    assert sorted(r.page_id for r in good) == list(range(40)) and {r.status for r in good} == {"ok"}
    damaged = [r for r in rows if r.record_type == "damaged"]
    assert len(damaged) == 4 and {r.status for r in damaged} == {"truncated"}, [(len(list(warc.parsed(p.read_bytes()))), p.name) for p in (tmp_path / "all").iterdir()]
