import base64
import hashlib
import re

from tests.llm.conftest import rows_of
from veleta.llm import topk, warc

PAGES = [
    (5, "http://a/x", "<p>same</p>"), (3, "http://a/y", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://b\r\nX: y", "é" * 700), (7, "http://b", None),
    (8, "http://c", ""), (None, "http://d", "é" * 700), (11, "http://e", "x" * 1000 + "\r\n\r\n" + "y" * 999), (12, "http://f", "\r\n\r\n"), (13, "http://g", "only"), (13, "http://g", "only"),
]


def expected(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= least and (html or "") in first and first[html or ""] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=repr)


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip_in_small_chunks(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id LONG, url STRING, html STRING, payload STRING").repartition(3)
    for chunk in (7, 64, 100_000):
        assert rows_of(warc.round_trip(pages, str(tmp_path / f"w{chunk}"), chunk), *NAMES) == expected(PAGES)
    assert rows_of(warc.round_trip(pages, str(tmp_path / "least"), 64, revisit_from=12), *NAMES) == expected(PAGES, 12)


def test_exported_bytes_are_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id LONG, url STRING, html STRING")
    warc.write_archives(pages, str(tmp_path / "w"), 64)
    data, records = b"".join(warc.export_archive(spark, str(tmp_path / "w"))), []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert rest[length : length + 4] == b"\r\n\r\n"
        payload = rest[:length].split(b"\r\n\r\n", 1)[1]
        if b"WARC-Type: response" in head:
            assert base64.b32encode(hashlib.sha1(payload).digest()) == re.search(rb"Payload-Digest: sha1:(\w+)", head)[1]
        else:
            assert payload == b"" and b"WARC-Refers-To: <urn:uuid:" in head
        records.append(head)
        data = rest[length + 4 :]
    assert len(records) == len(PAGES)


def test_chunk_rows_carry_running_digests(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id LONG, url STRING, html STRING")
    warc.write_archives(pages, str(tmp_path / "w"), 4)
    rows = spark.read.parquet(str(tmp_path / "w")).orderBy("chunk_no").collect()
    assert [r.running_digest for r in rows] == [warc.base32(hashlib.sha1(b"abcdefghij"[:n]).digest()) for n in (4, 8, 10)]


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id LONG, url STRING, html STRING"), str(tmp_path / "w")).count() == 0


def brute(rows, every, k):
    import math

    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in ok if i % every == 0}:
        q = min(v for j, v in ok if j == i)
        best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def test_top_k_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(400, [0.0] * 6), (500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [0.1] * 6), (550, [1.0, 2.0])]
    rows += [(7, rows[7][1]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id LONG, embedding ARRAY<FLOAT>, label INT, q INT").repartition(4)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    for shard, block in ((16, 3), (8192, 512)):
        assert rows_of(topk.top_k(df, 50, 5, shard, block), "query_id", "rank", "vec_id", "score") == brute(exact, 50, 5)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id LONG, embedding ARRAY<FLOAT>")
    assert rows_of(topk.top_k(df), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 131072)]
    assert topk.top_k(df.filter("vec_id < 0")).count() == 0
