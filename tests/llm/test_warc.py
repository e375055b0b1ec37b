import base64
import glob
import gzip
import hashlib
import random

import pytest

from strataspark.llm import warc as W

LONG = "<html>" + "lorem ipsum " * 200_000


def brute(rows, least=0):
    """{id: (bytes, digest, type, refers)} of rows (id, url, html) with distinct ids."""
    by = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least:
            by[p] = max(by.get(p, i), i)
    found = {}
    for i, _, h in rows:
        p = (h or "").encode()
        k = by.get(p, i)
        found[i] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == i else "revisit", None if k == i else k)
    return found


ROWS = [(1, "http://a/ b\r\nX: y", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "", ""), (5, "http://v/", "WARC/1.1\r\n\r\n\x1f"), (9, "http://a/ü", "<p>é"), (10, "long", LONG), (11, "long", LONG)]


def pages(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' AS id", "'y' AS h", "1 AS size", "'z' AS n")


def ids(text):
    return int(text.removeprefix(W.URN)) if text else None


def read(spark, folder):
    return W.records(W.read_warc(spark, str(folder))).where("record_type <> 'warcinfo'")


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = W.op13_warc(spark, sf).collect()
    assert len(got) == len(rows) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_equal_payloads(spark, tmp_path, least):
    rows = ROWS + [(100 + i, "http://hot/", "same on many pages") for i in range(1500)]
    W.write_warc(pages(spark, rows), str(tmp_path / "w"), min_bytes=least)
    found = W.resolved(read(spark, tmp_path / "w")).collect()
    assert len(found) == len(rows) and {ids(r.record_id): (r.payload_bytes, r.payload_digest, r.record_type, ids(r.refers_to)) for r in found} == brute(rows, least)


def test_archives_are_gzip_members_with_whole_payloads(spark, tmp_path):
    rows = [*ROWS, (20, "http://big/", "z" * (17 << 20))]
    W.write_warc(pages(spark, rows), str(tmp_path / "w"))
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        content = gzip.open(name).read()  # Spark also writes a file for an empty task
        assert not content or content.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    got = {ids(r.record_id): (r.payload, r.target) for r in read(spark, tmp_path / "w").where("record_type = 'response'").collect()}
    assert {i: bytes(p).decode() for i, (p, _) in got.items()} == {9: "<p>é", 4: "", 5: ROWS[4][2], 11: LONG, 20: rows[-1][2]}
    assert got[9][1] == "http://a/%C3%BC"
    header = next(r for r in read(spark, tmp_path / "w").where("record_type = 'revisit'").collect() if ids(r.record_id) == 1)
    assert header.target == "http://a/%20b%0D%0AX:%20y" and ids(header.refers_to) == 9


def test_rows_that_repeat_or_lack_an_id(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "a"), (1, "t", "a"), (None, "u", "a"), (None, None, None), (7, "x", "alone")]
    W.write_warc(pages(spark, rows), str(tmp_path / "w"))
    got = sorted((r.record_id.removeprefix(W.URN), r.record_type, r.refers_to or "", r.target or "") for r in read(spark, tmp_path / "w").collect())
    assert got == [("", "response", "", ""), ("", "response", "", "u"), ("1", "response", "", "u"), ("1", "revisit", W.URN + "1", "t"), *[("1", "revisit", W.URN + "1", "u")] * 2, ("7", "response", "", "x")]


def test_empty_table(spark, tmp_path):
    W.write_warc(pages(spark).where("false"), str(tmp_path / "w"))
    assert read(spark, tmp_path / "w").count() == 0


def archive(n=30, packed=True):
    """(bytes, places of the records) of an archive."""
    rng, out, places = random.Random(1), b"", []
    for i in range(n):
        text = "".join(rng.choice("abc \n") for _ in range(rng.randrange(2000))).encode()
        places.append(len(out))
        raw = W._page(i, f"http://x/{i}", text, W.digest(text), len(text), None, None)
        out += W.member(raw) if packed else raw
    return out, [*places, len(out)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_no_record_but_its_own(packed):
    """Every kind of damage to one record: all others are recovered, and the gap holds the damaged bytes."""
    data, at = archive(packed=packed)
    assert [x.start for x in W.salvage(data)] == at[:-1]
    k = 11
    inside = at[k] + (at[k + 1] - at[k]) * 3 // 4
    flipped = bytes([data[inside] ^ 0x55])
    cases = {
        "flip": (data[:inside] + flipped + data[inside + 1 :], 0),
        "cut": (data[:inside] + data[at[k + 1] :], at[k + 1] - inside),
        "head": (data[: at[k]] + b"??" + data[at[k] + 2 :], 0),
        "noise": (data[: at[k]] + b"\x1f\x8b\x08 noise WARC/1.0\r\n" * 9 + data[at[k + 1] :], at[k + 1] - at[k] - 20 * 9),
    }
    for name, (bad, lost) in cases.items():
        found = list(W.salvage(bad))
        gaps = [x for x in found if isinstance(x, W.Gap)]
        kept = [x.headers["warc-record-id"] for x in found if isinstance(x, W.Record)]
        assert kept == [f"<{W.URN}{i}>" for i in range(30) if i != k], name
        assert [(g.start, g.end) for g in gaps] == [(at[k], at[k + 1] - lost)], name
        assert gaps[0].reason


def test_damage_at_both_ends_and_between():
    data, at = archive(5)
    found = list(W.salvage(b"garbage" + data + b"\x00" * 9 + data[: at[1] - 5]))
    assert [(x.start, x.end) for x in found if isinstance(x, W.Gap)] == [(0, 7), (7 + len(data) + 9, 7 + len(data) + 9 + at[1] - 5)]
    assert sum(isinstance(x, W.Record) for x in found) == 5
    assert list(W.salvage(b"")) == [] and [type(x) for x in W.salvage(b"no archive")] == [W.Gap]


def test_wrong_lengths_and_digests():
    good = W._page(1, "u", b"payload", W.digest(b"payload"), 7, None, None)
    after = W._page(2, "u", b"more", W.digest(b"more"), 4, None, None)
    for bad in (good.replace(b"payload", b"paYload"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"Content-Length: ", b"Content-Length: 9"), good.replace(b"Content-Length", b"Content-Size"), good.replace(b"WARC-Type: ", b"WARC-Type "), good.replace(b"sha1:" + W.digest(b"payload").encode(), b"sha1:" + W.digest(b"x").encode())):
        found = list(W.salvage(bad + after))
        assert [type(x) for x in found] == [W.Gap, W.Record] and found[1].headers["warc-record-id"] == f"<{W.URN}2>"
        assert found[0].end == len(bad)


def test_gaps_are_logged_by_file(spark, tmp_path):
    data, at = archive()
    (tmp_path / "a.warc.gz").write_bytes(data[: at[3] + 9] + data[at[4] :])
    (tmp_path / "b.warc").write_bytes(archive(packed=False)[0] + data)
    (tmp_path / "c.warc").write_bytes(b"")
    found = W.read_warc(spark, f"{tmp_path}/*.warc*")
    assert [(r.path.split("/")[-1], r.start, r.end) for r in W.quarantined(found).collect()] == [("a.warc.gz", at[3], at[3] + 9)]
    assert W.records(found).count() == 29 + 30 + 30


def test_a_revisit_whose_response_is_lost(spark, tmp_path):
    lost = W._page(1, "u", None, W.digest(b"gone"), 4, 2, "v")
    (tmp_path / "a.warc").write_bytes(lost)
    r = W.resolved(W.records(W.read_warc(spark, str(tmp_path)))).collect()
    assert [(x.record_type, x.payload_bytes, x.payload_digest, ids(x.refers_to)) for x in r] == [("revisit", None, W.digest(b"gone"), 2)]
