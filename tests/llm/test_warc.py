import glob
import gzip
import hashlib
import random

import pytest

from weftline.llm import warc


def pages():
    rng = random.Random(2)
    big = "".join(rng.choices("abcé<>\r\n𝄞", k=90_000))
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/é ?x=\r\ny", "short"), (4, "u", "short"), (5, "u", None), (6, "", ""), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (8, "u", "x" * 1000)]
    rows += [(None, "n", "x" * 1000), (9, "WARC/1.1", "WARC/1.1\r\n\r\n" * 200), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n")]
    return rows + [(100 + i, f"http://h/{i}", "".join(rng.choices("αβγ 012\n", k=rng.randint(0, 30_000)))) for i in range(30)]


def want(rows):
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "") == (h or "")]
        last = max(same, default=None) if len(payload) >= 1000 else None
        revisit = i is not None and last is not None and i < last
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None, True))
    return sorted(out, key=repr)


def test_round_trip(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr("*", "'a' AS type", "1 AS digest")
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=repr) == want(pages())


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_warc(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(2), str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    at, kinds = 0, []
    while at < len(data):
        assert data[at:].startswith(b"WARC/1.1\r\n")
        head = data[at : data.index(b"\r\n\r\n", at)]
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        at += len(head) + 4 + length
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        kinds.append(head.split(b"WARC-Type: ")[1].split(b"\r\n")[0])
    assert kinds.count(b"continuation") > 4 and kinds.count(b"response") + kinds.count(b"revisit") == len(pages())


def test_damage_is_reported(spark, tmp_path):
    payload = b"z" * 100_000
    records = list(warc._records("urn:page:1", 1, "u", payload, hashlib.sha1(payload).hexdigest(), None))
    cases = {"whole": records, "shuffled": records[::-1], "lost": records[:2] + records[3:], "cut": records[:-1], "changed": [r.replace(b"zzzz", b"zzzy", 1) for r in records]}
    for name, parts in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in parts))
        got = warc.read_payloads(spark, str(tmp_path / name)).collect()
        assert [r.valid for r in got] == [name in ("whole", "shuffled")], name


def test_chunked_framing():
    assert warc.dechunked(b"4;x=y\r\nWiki\r\n0\r\nTrailer: 1\r\n\r\n") == b"Wiki"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_repeated_page_ids(spark, tmp_path):
    """Rows of one page_id, or of none, whose blocks are cut into segments."""
    big, other = "b" * 80_000, "o" * 90_000
    rows = [(1, "u", big), (1, "u", big), (1, "v", other), (2, "u", other), (2, "u", other + "x"), (None, "u", big), (None, "u", big), (None, None, other), (0, "u", big), (-5, "u", other)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=repr) == want(rows)
    warc.write_archives(frame, str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    ids = [line for line in data.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert len(set(ids)) == len(ids)
    referred = {line.split(b": ")[1] for line in data.split(b"\r\n") if line.startswith(b"WARC-Refers-To: ") and b":2:" in line}
    assert referred and referred <= {i.split(b": ")[1] for i in ids}


def test_only_large_payloads_are_dealt_out(spark):
    """No shuffle stands above the pages that are too small to be looked for."""
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    plan = warc.planned(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")


def test_many_digests_are_joined_and_not_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    plan = lambda: warc.planned(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    assert "strategy=broadcast" not in plan()
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=repr) == want(pages())
