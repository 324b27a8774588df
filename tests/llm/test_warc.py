import base64
import glob
import hashlib

import pytest

from barloom.llm import warc
from barloom.llm.warc import MAGIC, read, round_trip, write
from barloom.session import fresh_path

FAKE = f"before {MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\nafter"
HTML = [
    "<p>één</p>", "", None, "<p>één</p>", FAKE, f"{MAGIC}{MAGIC}x", MAGIC, FAKE + FAKE, "x" * 5000, "\r\n\r\n", "line\nline\r\n\r\n\r\n", f"{MAGIC}Content-Length: 99999999\r\n\r\n",
    "<p>één</p>", MAGIC[:4] + MAGIC, f"{MAGIC}Content-Length: 4\r\n\r\nabcd\r\n\r\n{MAGIC}Content-Length: 4\r\n\r\nabcd\r\n\r\n",
]


def brute(rows, least):
    out = []
    for i, html in rows:
        data = (html or "").encode()
        same = [j for j, h in rows if j is not None and (h or "").encode() == data]
        again = i is not None and len(data) >= least and max(same) != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, None if i == 3 else f"http://x/{i} y\n", h, "c") for i, h in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("least", [0, 8])
@pytest.mark.parametrize("split", ["128m", "700", "61"])
def test_round_trip(spark, least, split):
    rows = [(i, h) for i, h in enumerate(HTML)] + [(None, "no id"), (None, HTML[0])]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = fresh_path(spark, "warc")
        got = sorted(map(tuple, round_trip(table(spark, rows).coalesce(2), least, path).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == brute(rows, least)


def test_archives_are_warc(spark, tmp_path):
    rows = list(enumerate(HTML))
    path = f"{tmp_path}/archives"
    write(table(spark, rows), path)
    seen = []
    for file in glob.glob(f"{path}/part-*"):
        data, at = open(file, "rb").read(), 0
        while at < len(data):
            assert data[at:].startswith(MAGIC.encode())
            head = data[at : data.index(b"\r\n\r\n", at)].decode()
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            body = at + len(head) + 4
            at = body + int(fields["Content-Length"]) + 4
            assert data[at - 4 : at] == b"\r\n\r\n"
            assert " " not in fields["WARC-Target-URI"]
            if fields["WARC-Type"] == "response":
                i = int(fields["WARC-Record-ID"][10:-1])
                assert data[body : at - 4].split(b"\r\n\r\n", 1)[1] == (HTML[i] or "").encode()
                seen.append(i)
    assert len(seen) == len({h or "" for h in HTML})


def test_truncated(spark, tmp_path):
    path = f"{tmp_path}/archives"
    write(table(spark, [(1, "first"), (2, "second")]).coalesce(1), path)
    (file,) = glob.glob(f"{path}/part-*")
    data = open(file, "rb").read()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/part-0").write_bytes(data[:-10])
    assert [r.id for r in read(spark, f"{tmp_path}/cut").collect()] == [1]


def test_payload_bytes_of_a_foreign_archive_need_no_utf8(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 3
    (tmp_path / "part-0").write_bytes(f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    (row,) = read(spark, str(tmp_path)).collect()
    assert row.payload_bytes == 768 and row.digest == base64.b32encode(hashlib.sha1(bytes(range(256)) * 3).digest()).decode()


def test_empty_and_repeated(spark):
    assert round_trip(table(spark, []).coalesce(1)).count() == 0
    got = round_trip(table(spark, [(4, "a"), (4, "a"), (4, "b"), (2, "a")])).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(2, "revisit", 4), (4, "response", 0), (4, "response", 0), (4, "response", 0)]


def test_base32():
    assert warc.STEP == len(MAGIC)
