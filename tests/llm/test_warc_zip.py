"""WARC packages: round trips, directories and the reader's refusals."""

import io
import zipfile

import pytest

from ledgerflow.llm.common import Stages
from ledgerflow.llm.warc_zip import Package, archive_round_trip, digest, parse, read_packages, record, write_packages, write_zip

from oracle import equal

COLS = "page_id long, url string, html string, payload string, sha string"
ROWS = [(1, "http://a/", "<p>x</p>", "c", "d"), (2, None, "<p>x</p>", "c", "d"), (3, "http://b/\r\nX: y", "", "c", "d"),
        (4, "http://c/é", None, "c", "d"), (5, "u", "é\x00" * 3000, "c", "d"), (6, "u", "y" * 200_000, "c", "d"),
        (6, "u", "y" * 200_000, "c", "d"), (None, "u", "<p>x</p>", "c", "d"), (None, "u", "only", "c", "d"),
        (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "c", "d")]


def brute(rows, least=0):
    last = {}
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    out = []
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        top = None if last[p] < 0 else last[p]
        first = len(p) < least or i == top
        out.append((i, len(p), digest(p), "response" if first else "revisit", None if first else top, b"" if not first else p))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, COLS)
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in archive_round_trip(df, least).collect()]
    assert sorted(got, key=str) == brute(ROWS, least)


@pytest.mark.parametrize("zip64", [False, True])
def test_many_small_packages(spark, zip64):
    df = spark.createDataFrame([(i, "u", f"text {i}" * i, "c", "d") for i in range(200)], COLS).repartition(3)
    packages = write_packages(df, Stages(spark, "t"), package_bytes=2000, zip64=zip64)
    assert packages.count() > 5 and packages.agg({"records": "sum"}).first()[0] == 200
    for r in packages.collect():
        assert zipfile.ZipFile(r.path.removeprefix("file:")).testzip() is None
    got = {r.id: bytes(r.payload) for r in read_packages(packages).collect()}
    assert got == {i: (f"text {i}" * i).encode() for i in range(200)}


def saved(tmp_path, members, zip64=False, tail=b""):
    out = io.BytesIO()
    write_zip(out, members, zip64)
    data = out.getvalue()
    if tail:
        data = data[:-2] + len(tail).to_bytes(2, "little") + tail
    (tmp_path / "p.zip").write_bytes(data)
    return str(tmp_path / "p.zip")


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("tail", [b"", b"a comment with PK\x05\x06 in it, longer than twenty-two bytes"])
def test_archive_without_index(tmp_path, zip64, tail):
    raw = [record(i, "u", b"payload %d" % i * 9000, None, False, "2026-01-01T00:00:00Z") for i in range(5)]
    p = Package(saved(tmp_path, [("archive/a.warc.gz", b"".join(raw)), ("note.txt", b"")], zip64, tail))
    assert [parse(p.read(at, n))["Row-Id"] for at, n in p.ranges()] == ["0", "1", "2", "3", "4"]


def test_package_of_another_writer(tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        with z.open(zipfile.ZipInfo("archive/b.warc.gz"), "w", force_zip64=True) as f:
            f.write(record(9, "u", b"x", None, False, "2026-01-01T00:00:00Z"))
    p = Package(str(tmp_path / "q.zip"))
    assert [parse(p.read(at, n))["payload"] for at, n in p.ranges()] == [b"x"]


def test_refusals(tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/b.warc.gz", b"y" * 100)
    for name, data in (("r.zip", None), ("s.zip", b"no zip"), ("t.zip", b"")):
        if data is not None:
            (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            Package(str(tmp_path / name))


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], COLS)).count() == 0


def test_query(spark):
    ok, why = equal(spark, "op8_warc_zip", "/root/testdata/sf0.001")
    assert ok, why
