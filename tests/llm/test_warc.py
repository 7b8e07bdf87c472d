"""WARC archives: what is written is read, by seeks where records are not wanted, and pages against a brute-force version."""

import base64
import glob
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringStartsWith

from tidemark.llm import common, warc


@pytest.fixture(autouse=True)
def known(spark):
    warc.register(spark)


def archive(tmp_path, rows, name="a.warc", join=b""):
    path = tmp_path / name
    data = [warc.record_bytes(r, "2024-01-01T00:00:00Z") for r in rows]
    if name.endswith(".gz"):
        data = [gzip.compress(join.join(data))] if join is not None else [warc.member(d) for d in data]
    path.write_bytes(b"".join(data))
    return str(path)


ROWS = [
    {"record_type": "warcinfo", "record_id": "urn:i", "payload": b"software: x\r\n"},
    {"record_type": "response", "record_id": "urn:1", "target_uri": "https://a/\r\nX: y", "http_status": 200, "http_headers": [("Content-Type", "text/html"), ("X", "1")], "payload": b"<p>\r\n\r\nWARC/1.0\r\n\x00\xff" * 9000},
    {"record_type": "metadata", "record_id": "urn:2", "content_type": "text/plain", "payload": b"", "headers": [("WARC-IP-Address", "::1")]},
    {"record_type": "response", "record_id": "urn:3", "target_uri": "http://é/", "http_status": 404, "http_headers": [], "payload": b""},
    {"record_type": "revisit", "record_id": "urn:4", "refers_to": "urn:1", "payload_digest": "ABC", "http_status": 200, "http_headers": [("Content-Length", "9")]},
]


@pytest.mark.parametrize("name, join", [("a.warc", b""), ("m.warc.gz", None), ("one.warc.gz", b"")])
def test_what_is_written_is_read(spark, tmp_path, name, join):
    path = archive(tmp_path, ROWS, name, join)
    got = spark.read.format("warc").load(path).orderBy("offset", "record_id").collect()
    by = {r.record_id: r for r in got}
    assert len(by) == 5 and by["urn:1"].payload == ROWS[1]["payload"] and by["urn:1"].http_headers == {"Content-Type": "text/html", "X": "1"}
    assert by["urn:1"].target_uri == "https://a/%0D%0AX: y" and by["urn:3"].target_uri == "http://é/" and by["urn:3"].payload == b"" and by["urn:3"].http_status == 404
    assert by["urn:2"].headers["WARC-IP-Address"] == "::1" and by["urn:2"].payload == b"" and by["urn:2"].http_status is None
    assert by["urn:4"].payload is None and by["urn:4"].refers_to == "urn:1" and by["urn:4"].payload_digest == "ABC" and "WARC-Profile" in by["urn:4"].headers
    assert by["urn:1"].payload_digest == base64.b32encode(hashlib.sha1(ROWS[1]["payload"]).digest()).decode()
    only = spark.read.format("warc").load(path).where("record_type = 'response' and target_uri like 'https:%' or record_id = 'urn:2'").select("record_id").collect()
    assert sorted(r.record_id for r in only) == ["urn:1", "urn:2"]


class Counting(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.count = 0

    def read(self, n=-1):
        out = super().read(n)
        self.count += len(out)
        return out

    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zipped", [False, True])
def test_unwanted_payloads_are_not_read(zipped):
    big = [{"record_type": "response", "record_id": f"urn:{i}", "payload": os.urandom(1_000_000)} for i in range(20)] + [{"record_type": "metadata", "record_id": "urn:m", "payload": b"m"}]
    data = b"".join(warc.member(r) if zipped else r for r in (warc.record_bytes(r, "d") for r in big))
    raw = Counting(data)
    got = list(warc.records(raw, zipped, lambda v: v["record_type"] == "metadata", True, "f"))
    assert [(r.values["record_id"], r.values["payload"]) for r in got] == [("urn:m", b"m")]
    assert raw.count < len(data) / 10
    raw = Counting(data)
    assert len(list(warc.records(raw, zipped, lambda v: True, False, "f"))) == 21 and raw.count < len(data) / 10
    # gzip members are those of any other reader too
    if zipped:
        assert gzip.decompress(data) == b"".join(warc.record_bytes(r, "d") for r in big)


def test_predicates_as_sql_has_them():
    v = {"record_type": "response", "target_uri": None, "content_length": 5}
    cases = [(EqualTo(("record_type",), "response"), True), (EqualTo(("target_uri",), "x"), None), (Not(EqualTo(("target_uri",), "x")), None), (Not(EqualTo(("record_type",), "x")), True), (EqualNullSafe(("target_uri",), None), True)]
    cases += [(In(("record_type",), ("a", None)), None), (In(("record_type",), ("response", None)), True), (IsNull(("target_uri",)), True), (IsNotNull(("target_uri",)), False), (GreaterThan(("content_length",), 4), True), (StringStartsWith(("record_type",), "res"), True)]
    for f, want in cases:
        assert warc.decided(f) and warc.holds(f, v) is want, f
    reader = warc.Reader("p", None, {})
    rest = [EqualTo(("payload",), b"x"), EqualTo(("headers", "a"), "x"), Not(IsNull(("http_status",)))]
    assert list(reader.pushFilters([cases[0][0], *rest])) == rest and reader.filters == [cases[0][0]]


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_cut_and_odd_files_are_errors_with_their_place(tmp_path, name):
    whole = open(archive(tmp_path, ROWS, name, None), "rb").read()
    for data in (whole[: len(whole) // 3], whole[:40] if name == "a.warc" else b"no gzip at all, but long enough", b"HTTP/1.1 200\r\n\r\n" if name == "a.warc" else gzip.compress(b"x\r\n\r\n"), whole.replace(b"Content-Length: ", b"Content-Length: -") if name == "a.warc" else gzip.compress(b"WARC/1.0\r\n\r\n")):
        with pytest.raises(ValueError, match="f at "):
            list(warc.records(Counting(data), name.endswith("gz"), lambda v: True, True, "f"))
    assert list(warc.records(Counting(b""), name.endswith("gz"), lambda v: True, True, "f")) == []


def test_files_are_packed_rolled_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(300).selectExpr("'resource' as record_type", "concat('urn:', id) as record_id", "'text/plain' as content_type", "cast(repeat(sha2(cast(id as string), 256), 20) as binary) as payload").repartition(3)
    df.write.format("warc").mode("append").option("file_bytes", 8_000).save(folder)
    files = glob.glob(f"{folder}/*.warc.gz")
    assert len(files) > 3 and os.listdir(folder) and not glob.glob(f"{folder}/_*")
    os.makedirs(f"{folder}/_writing-x")
    open(f"{folder}/_writing-x/part-0.warc.gz", "wb").write(b"what a lost task has left")
    back = spark.read.format("warc").option("partition_bytes", 20_000).load(folder).where("record_type = 'resource'")
    assert 2 < back.rdd.getNumPartitions() < len(files)
    assert back.select("record_id", "payload").exceptAll(df.select("record_id", "payload")).count() == 0 and back.count() == 300
    # what is read can be written
    back.limit(5).write.format("warc").mode("append").option("compression", "none").save(str(tmp_path / "again"))
    assert spark.read.format("warc").load(str(tmp_path / "again")).where("record_type <> 'warcinfo'").count() == 5
    df.limit(7).write.format("warc").mode("overwrite").save(folder)
    assert spark.read.format("warc").load(folder).where("record_type = 'resource'").count() == 7


def brute(pages, least=0):
    out, first = [], {}
    for i, html in pages:
        if i is not None:
            h = (html or "").encode()
            first[h] = min(i, first.get(h, i))
    for i, html in pages:
        h = (html or "").encode()
        again = len(h) >= least and h in first and first[h] != i
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [500_000, 0])
def test_pages_as_by_brute_force(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    pages = [(i, f"<p>{i % 17}é</p>" if i % 3 else "hot") for i in range(200)] + [(900, None), (901, ""), (902, "x" * 300_000), (903, "\r\n\r\nWARC/1.1\r\n"), (5, f"<p>{5}é</p>"), (None, "hot"), (None, "only here"), (3, "hot"), (904, "\x00\x1f")]
    df = spark.createDataFrame([(i, None if i == 7 else f"http://x/{i}\n", h) for i, h in pages], "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as first", "2 as payload").repartition(5)
    path = str(tmp_path / "t")
    df.write.parquet(f"{path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.query(spark, path).collect()), key=repr)
    assert got == brute(pages)
    run = common.Scratch(spark, "t")
    assert warc.captures(df, run, least_bytes=4).where("record_type = 'revisit'").count() == sum(r[3] == "revisit" for r in brute(pages, 4))
    run.close()
    none = str(tmp_path / "none")
    df.limit(0).write.parquet(f"{none}/pages.parquet")
    assert warc.query(spark, none).collect() == []


def test_a_payload_without_its_digest_is_an_error(spark, tmp_path):
    archive(tmp_path, [{"record_type": "response", "record_id": "urn:page:1", "payload_digest": "WRONG", "payload": b"x"}])
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_back(spark, str(tmp_path)).collect()
