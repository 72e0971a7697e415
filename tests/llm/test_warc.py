import gzip
import hashlib
import random

import pytest

from codeloom.llm import warc
from codeloom.plans.oracle import compare, duck

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def brute(rows, least=1000):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        ids = [j for j, _, h in rows if j is not None and (h or "").encode() == p]
        lead = max(ids) if ids else None
        revisit = len(p) >= least and lead is not None and lead != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    from codeloom.llm.queries import ORACLE, QUERIES

    ok, msg = compare(QUERIES["op7_warc"](spark, SF), ORACLE["op7_warc"], duck(SF))
    assert ok, msg


def made():
    rng = random.Random(13)
    big = "é\r\n\r\n<p>" * 3000
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://a/ b\r\nX: y", "x" * 999), (4, "u", "x" * 999), (5, "u", "y" * 1000), (6, "u", "y" * 1000),
            (None, "u", "y" * 1000), (None, "u", "only here" * 200), (7, "u", big), (8, "u", big), (9, "u", "WARC/1.0\r\nContent-Length: 5\r\n\r\n0\r\n\r\n")]
    rows += [(20 + k, f"u{k}", "".join(rng.choice("äb\n漢 ") for _ in range(rng.randrange(0, 9000)))) for k in range(40)]
    return rows + [(90, "u", "z" * 5000), (90, "u", "z" * 5000), (91, "u", "a"), (91, "v", "b")]


@pytest.mark.parametrize("segment,chunk,files", [(32 << 10, 4096, 5000), (700, 13, 3), (101, 50, 1000)])
def test_round_trip(spark, tmp_dir, segment, chunk, files):
    df = spark.createDataFrame([(*r, "t", 1) for r in made()], PAGES + ", type string, payload int")
    warc.write_archive(df, tmp_dir + "/w", segment_bytes=segment, chunk_bytes=chunk, records_per_file=files)
    records = warc.read_archive(spark, tmp_dir + "/w")
    assert got(warc.page_records(records)) == brute(made())
    payloads = sorted(bytes(r.payload) for r in records.where("record_type = 'response'").collect())
    types = brute(made())
    assert len(payloads) == sum(t[3] == "response" for t in types) and sum(map(len, payloads)) == sum(t[1] for t in types if t[3] == "response")


def test_empty_table(spark, tmp_dir):
    warc.write_archive(spark.createDataFrame([], PAGES), tmp_dir + "/w")
    assert warc.page_records(warc.read_archive(spark, tmp_dir + "/w")).collect() == []


def write(tmp_path, records, name="a.warc.gz"):
    (tmp_path / "w").mkdir(exist_ok=True)
    (tmp_path / "w" / name).write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in records)))


def test_broken_records(spark, tmp_path):
    payload = bytes(range(256)) * 20
    digest = hashlib.sha1(payload).hexdigest()
    parts = list(warc._records(0, 5, "u", payload, digest, None, 1000, 300))
    assert len(parts) > 4
    write(tmp_path, [*reversed(parts)])
    row, = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert row.valid and bytes(row.payload) == payload and row.page_id == 5
    for name, some in (("missing", parts[:2] + parts[3:]), ("twice", parts + parts[1:2]), ("headless", parts[1:]), ("tailless", parts[:-1])):
        (tmp_path / name).mkdir()
        write(tmp_path / name, some)
        row, = warc.read_archive(spark, str(tmp_path / name / "w")).collect()
        assert not row.valid and row.payload is None
    with pytest.raises(ValueError):
        warc.page_records(warc.read_archive(spark, str(tmp_path / "twice" / "w")), strict=True).collect()
    for body in (b"5\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(body)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


def foreign(fields, block, length=None):
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha1 = hashlib.sha1(b"hello").hexdigest()
    kind = ("Content-Type", "application/http; msgtype=response")
    uuid = lambda k: ("WARC-Record-ID", f"<urn:uuid:00000000-0000-0000-0000-{k:012d}>")
    response = ("WARC-Type", "response")
    records = [
        foreign([("WARC-Type", "warcinfo"), uuid(0)], b"software: x"),
        foreign([response, uuid(1), kind, ("WARC-Payload-Digest", "sha1:" + sha1)], http + b"hello"),
        foreign([response, uuid(2), kind, ("WARC-Payload-Digest", "sha256:abc")], http + b"hello"),
        foreign([response, uuid(3), kind, ("WARC-Payload-Digest", "sha1:!!")], http + b"hello", length="many"),
        foreign([response, uuid(4), ("Content-Type", "text/dns")], b"a 1.2.3.4"),
        foreign([response, uuid(5), kind, ("WARC-Segment-Number", "one")], http + b"hello"),
        foreign([response, uuid(6), kind, ("WARC-Segment-Number", "99999999999")], http + b"hello"),
        foreign([response, uuid(7), kind], b"no header at all"),
        foreign([("WARC-Type", "revisit"), uuid(8), ("WARC-Refers-To", "<urn:uuid:x>")], b""),
        foreign([response, ("WARC-Record-ID", "page"), kind, ("WARC-Payload-Digest", "sha1:" + "0" * 40)], http + b"hello"),
        foreign([response, uuid(9), kind], http + b"cut off", length=10**6),
    ]
    write(tmp_path, records)
    (tmp_path / "w" / "plain.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records[:3]))
    (tmp_path / "w" / "members.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[:3]) + b"\x1f\x8bnot gzip")
    rows = warc.read_archive(spark, str(tmp_path / "w"))
    found = [(r.record_id[-2:-1], r.valid, r.payload and bytes(r.payload)) for r in rows.collect()]
    hello = (True, b"hello")
    assert sorted(found, key=str) == sorted(
        [("1", *hello)] * 3 + [("2", *hello)] * 3 + [("g", *hello), ("3", False, None), ("4", True, b"a 1.2.3.4"), ("5", False, None), ("6", False, None),
         ("7", False, None), ("8", True, None), ("9", False, None)], key=str)
    pages = warc.page_records(rows).collect()
    assert len(pages) == 14 and {r.page_id for r in pages} == {None}
    assert sum(not r.valid for r in pages) == 6  # also the one whose digest differs
    assert [r.payload_digest for r in pages if r.valid and r.payload_bytes == 5] == [sha1] * 6


def test_a_record_is_a_gzip_member(spark, tmp_dir):
    import glob
    import zlib

    warc.write_archive(spark.createDataFrame([(k, "u", f"page {k}") for k in range(7)], PAGES).coalesce(1), tmp_dir + "/w")
    content = open(glob.glob(tmp_dir + "/w/part-*")[0], "rb").read()
    members = []
    while content:
        z = zlib.decompressobj(31)
        members.append(z.decompress(content))
        content = z.unused_data
    assert all(m.startswith(b"WARC/1.0\r\n") and m.endswith(b"\r\n\r\n") for m in members if m)
    assert sum(map(bool, members)) == 7 and gzip.decompress(open(glob.glob(tmp_dir + "/w/part-*")[0], "rb").read()) == b"".join(members)
