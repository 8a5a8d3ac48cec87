import gzip
import io

import pytest

from quern.llm import warc
from quern.session import new_path


def test_ranges_own_what_starts_inside():
    members = [gzip.compress(b"WARC/1.1\r\nX: %d\r\n\r\n" % i + b"x" * (37 * i)) for i in range(60)]
    data = b"".join(members)
    for split in (1, 7, 64, 1000, len(data) + 5):
        got = [c for a in range(0, len(data), split) for c in warc.records_in(io.BytesIO(data), a, a + split)]
        assert got == [gzip.decompress(m) for m in members]


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_members_across_blocks(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    members = [gzip.compress(b"WARC/1.1\r\nX: %d\r\n\r\n" % i + bytes(range(256)) * i) for i in range(12)]
    noise = [warc.MAGIC, gzip.compress(b""), gzip.compress(b"WARD" * 9), b"\xff\x1f\x8b", gzip.compress(b"WARC/1.1 cut off")[:-4]]
    data = b"".join(m + noise[i % len(noise)] for i, m in enumerate(members))
    for split in (3, 100, len(data)):
        got = [c for a in range(0, len(data), split) for c in warc.records_in(io.BytesIO(data), a, a + split)]
        assert got == [gzip.decompress(m) for m in members]


def test_a_long_record_is_read_once_into_one_buffer():
    class Counted(warc._Window):
        copied = 0

        def more(self):
            before = len(self.data)
            found = super().more()
            Counted.copied += len(self.data) - before
            return found

    data = gzip.compress(b"WARC/1.1\r\n\r\n" + bytes(24 << 20), 0)
    window = Counted(io.BytesIO(data), 0)
    content, end = warc._member(window, 0)
    assert len(content) == (24 << 20) + 12 and end == len(data) and Counted.copied == len(data)
    held = window.data
    window.drop(end)
    assert window.data is held and not held


def test_large_member(monkeypatch):
    data = warc._record(1, "u", b"y" * (17 << 20), "00" * 20, "response", None) + b"\0"
    assert len(list(warc.records_in(io.BytesIO(data + data), 0, 2 * len(data)))) == 2


@pytest.mark.parametrize("split", [50, 1 << 20])
def test_round_trip(spark, split):
    big = "é<p>" * 400
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "http://c", None), (4, "http://d", ""), (5, "x", "small"), (6, "x", "small"), (None, "x", big), (2, None, big), (9, "u", "z" * 999)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = new_path(spark, "warc")
    warc.write(df, path)
    got = sorted(map(tuple, warc.resolve(warc.read(spark, path, split)).collect()), key=str)
    import hashlib

    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and k != 2
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
