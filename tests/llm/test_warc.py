import os
import random

import duckdb
import pyarrow as pa

from cardloom.llm import warc


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({warc.ORACLE_OP6})").fetchall(), key=str)
    assert sorted((tuple(r) for r in warc.op6_warc_splittable(spark, sf).select(*names).collect()), key=str) == want


def test_revisits_of_odd_rows(spark, tmp_path):
    rows = [(1, "http://a b", ""), (2, None, None), (3, "u", "x"), (None, "u", "x"), (5, "u", "é" * 9), (5, "u", "é" * 9), (6, "u", "only"), (None, "v", "alone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, value string")
    warc.write_archive(warc.revisits(df), out := str(tmp_path / "a"))
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_length, r.digest) for r in warc.read_archive(spark, out).collect()), key=str)
    d = warc.digest_of
    want = [("1", "revisit", "2", 0, d(b"")), ("2", "response", None, 0, d(b"")), ("3", "response", None, 1, d(b"x")), (None, "revisit", "3", 1, d(b"x")), *[("5", "response", None, 18, d("é".encode() * 9))] * 2, ("6", "response", None, 4, d(b"only")), (None, "response", None, 5, d(b"alone"))]
    assert got == sorted(want, key=str)
    assert {r.refers_to for r in warc.revisits(df, least_bytes=2).collect()} == {None}
    warc.write_archive(warc.revisits(df.limit(0)), out := str(tmp_path / "b"))
    assert warc.read_archive(spark, out).count() == 0


def test_magic_inside_members_and_range_borders(spark, tmp_path):
    """Stored (level 0) members full of magic bytes, in ranges much smaller than a member."""
    rnd = random.Random(1)
    bodies = [b"".join(rnd.choice([warc.MAGIC, b"\0", b"plain", rnd.randbytes(rnd.randint(0, 900))]) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    bodies.append(bytes(17 << 20))
    os.makedirs(tmp_path / "w")
    with open(tmp_path / "w/part-0.txt", "wb") as f:
        for k, body in enumerate(bodies):
            data = warc.member(warc.record(str(k), "u", body, warc.digest_of(body), None, "2024-01-01T00:00:00Z"), 0 if k % 3 else 6)
            assert data[-1] == 0
            f.write(data)
    for limit in ("1000", "30000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit if limit != "1000" else "200000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = {r.record_id: bytes(r.payload) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == {str(k): b for k, b in enumerate(bodies)}


def scan(parts, ranges):
    """Payloads and lost bytes of pieces, dealt to ranges by their numbers, joined without Spark."""
    batch = pa.record_batch({"value": pa.array(parts, pa.binary()), "file": pa.array(["f"] * len(parts)), "at": pa.array([100 + k for k in ranges], pa.int64())})
    batches = list(warc._scanned(iter([batch])))
    rows = pa.Table.from_batches(batches).to_pylist() if batches else []
    owner, groups = None, {}
    for r in sorted((r for r in rows if r["part"] in (1, 2, 4)), key=lambda r: (r["at"], r["part"] == 2, r["seq"])):
        owner = r["at"] if r["part"] == 2 or (r["part"] == 4 and owner is None) else owner
        groups.setdefault(owner, []).append(r)
    lost = sum(len(r["data"]) for r in groups.pop(None, []))
    for own in groups.values():
        rows += warc._joined(pa.Table.from_pylist(own)).to_pylist()
    return [r["payload"] for r in rows if r["part"] == 0], lost + sum(r["lost"] for r in rows if r["part"] == 3)


def test_pieces_that_ranges_leave_are_joined():
    body = warc.MAGIC + b"abc" + warc.MAGIC + b"def" * 50
    parts = warc.member(warc.record("1", "u", body, "d", None, "x"), 0).split(warc.MAGIC)[1:]
    assert scan(parts, range(len(parts))) == ([body], 0)


def timed(m):
    return m[:4] + warc.MAGIC + b"\0" + m[8:]


def test_magic_in_a_members_first_bytes(spark, tmp_path):
    """Magic in the time or name of a gzip header, before any text can be inflated, wherever ranges end."""
    body = lambda k: b"body %d" % k * 9
    plain = [warc.member(warc.record(str(k), "u", body(k), "d", None, "x")) for k in range(8)]
    named = lambda m: m[:3] + b"\x08" + m[4:10] + b"n" + warc.MAGIC + b"\x01" + warc.MAGIC + b"\0" + m[10:]
    data = [timed(plain[0]), plain[1], timed(plain[2]), named(plain[3]), plain[4], plain[5] + b"\0\0", named(plain[6]), timed(plain[7])]
    parts = b"".join(data).split(warc.MAGIC)[1:]
    for size in (1, 2, 3, 5, 100):  # pieces in a range
        got, lost = scan(parts, [k // size for k in range(len(parts))])
        assert sorted(got) == [body(k) for k in range(8)] and lost == 0
    os.makedirs(tmp_path / "w")
    (tmp_path / "w/part-0.txt").write_bytes(b"".join(data))
    assert {r.record_id: bytes(r.payload) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()} == {str(k): body(k) for k in range(8)}


def test_damaged_members_leave_their_neighbours():
    m = [warc.member(warc.record(str(k), "u", b"%d" % k * 99, "d", None, "x")) for k in range(4)]
    for bad in (m[1][:-30], m[1][:60] + b"\xff\xff" + m[1][62:], m[1][:-8] + b"\1\1\1\1" + m[1][-4:]):
        parts = (m[0] + bad + timed(m[2]) + m[3]).split(warc.MAGIC)[1:]
        for size in (1, 2, 100):
            got, lost = scan(parts, [k // size for k in range(len(parts))])
            assert sorted(got) == [b"%d" % k * 99 for k in (0, 2, 3)]
            assert len(bad.rstrip(b"\0")) <= lost <= len(bad)


def small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def test_foreign_archives_with_gz_names(spark, tmp_path):
    """Other writers' gzip headers and names, several records in a member, garbage between and after members, in many ranges."""
    import gzip
    import io

    def foreign(k):
        text = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Length: %d\r\n\r\n" % (k, 40 + k) + random.Random(k).randbytes(40 + k) + b"\r\n\r\n"
        out = io.BytesIO()
        with gzip.GzipFile(f"name{k}.warc", "wb", fileobj=out, mtime=k) as f:
            f.write(text)
        return out.getvalue()

    os.makedirs(tmp_path / "w/sub")
    whole = [foreign(k) for k in range(300)]
    two = gzip.compress(b"".join(gzip.decompress(foreign(k)) for k in (300, 301)))
    (tmp_path / "w/a.warc.gz").write_bytes(b"".join(whole[:150]) + two)
    (tmp_path / "w/sub/b.WARC.GZ").write_bytes(b"junk" + b"".join(whole[150:200]) + b"more junk" + b"".join(whole[200:]) + whole[0][:30])
    (tmp_path / "w/c.gz").write_bytes(gzip.compress(random.Random(0).randbytes(9000)) + warc.MAGIC * 3)
    (tmp_path / "w/d.txt").write_bytes(b"no member at all " * 1000)
    try:
        for size in ("700", "20000", "128m"):
            small_ranges(spark, size)
            rows = warc.read_archive(spark, str(tmp_path / "w")).collect()
            assert sorted(r.record_id for r in rows) == sorted(f"<urn:uuid:{k}>" for k in range(302))
            assert all(r.payload_length == 40 + int(r.record_id[10:-1]) for r in rows)
            lost = {os.path.basename(r.file): r.lost for r in warc.damage(spark, str(tmp_path / "w")).collect()}
            assert lost["b.WARC.GZ"] == 4 + 9 + 30 and lost["c.gz"] > 9000 and lost["d.txt"] == 17_000 and "a.warc.gz" not in lost
        small_ranges(spark, "700")
        assert warc._read(spark, str(tmp_path / "w")).select("file", "at").where("file LIKE '%a.warc.gz'").distinct().count() > 20  # it was split
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
