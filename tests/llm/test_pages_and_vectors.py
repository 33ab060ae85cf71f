"""WARC round trips and top-k search against brute force."""

import hashlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opsight.llm import queries, topk, warc

SF_DIR = "/root/testdata/sf0.001"


def _pages(spark):
    big = "<p>" + "text é " * 60_000 + "</p>"
    rows = [(5, "http://a/x y\r\n", "h" * 200), (3, None, "h" * 200), (9, "u", "h" * 200), (9, "u", "h" * 200), (7, "u", None), (8, "u", ""), (2, "u", "short"), (1, "u", "short"), (11, "u", big), (12, "u", big), (None, "u", "h" * 200)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))


def test_warc_round_trip(spark):
    pages = _pages(spark)
    found = warc.roundtrip(spark, pages).collect()
    assert len(found) == pages.count() and all(r.error is None for r in found)
    for row in pages.collect():
        payload = (row.html or "").encode()
        own = [r for r in found if r.page_id == row.page_id]
        assert all((r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest()) for r in own)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in found}
    assert kinds == {(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (7, "response", None), (8, "response", None), (2, "response", None), (1, "response", None), (11, "response", None), (12, "revisit", 11), (None, "response", None)}
    assert warc.roundtrip(spark, pages.limit(0)).count() == 0


def _archive(*htmls):
    return [warc.gzip_member(warc.record_bytes(i, "u", h, hashlib.sha256(h.encode()).hexdigest(), None, "2024-01-01T00:00:00Z")) for i, h in enumerate(htmls)]


def test_damage_is_reported():
    members = _archive("one" * 50_000, "two", "three")
    rows = list(warc.read_stream(io.BytesIO(b"".join(members)), True))
    assert [r["payload"].decode() for r in rows] == ["one" * 50_000, "two", "three"]
    assert [r["offset"] for r in rows] == [0, len(members[0]), len(members[0]) + len(members[1])]
    cut = list(warc.read_stream(io.BytesIO(b"".join(members)[:-5])))
    assert [r["error"] is None for r in cut] == [True, True, False] and cut[-1]["error"].startswith("gzip")
    plain = warc.record_bytes(1, "u", "abc", hashlib.sha256(b"abc").hexdigest(), None, "d")
    wrong = [plain.replace(b"abc", b"abd"), plain.replace(b"Content-Length: ", b"Content-Length: 1"), b"nothing\r\n\r\n"]
    found = list(warc.read_stream(io.BytesIO(b"".join(map(warc.gzip_member, [*wrong, plain])))))
    assert ["digest" in (r["error"] or "") for r in found] == [True, False, False, False]
    assert ["framing" in (r["error"] or "") for r in found] == [False, True, True, False]


@pytest.mark.parametrize("name", ["op7_topk", "op9_warc", "op10_linededup"])
def test_query_equals_its_sql(spark, name):
    query, sql = queries.REGISTRY[name]
    database = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        database.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = query(spark, SF_DIR)
    result = database.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, result.fetchall()))


def _expected(rows, k, query_ids):
    out = set()
    for q in query_ids:
        own = next(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("bucket", [4, 1024])
def test_top_k(spark, bucket, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "SHARD_BUCKETS", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    numbers = np.random.default_rng(1)
    vectors = [[float(x) for x in v] for v in numbers.normal(size=(120, 6)) * numbers.choice([0.1, 1, 5], (120, 1))]
    vectors += [vectors[3]] * 30 + [[0.0] * 6, [1.0, 2.0]]
    rows = list(enumerate(vectors))
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (920, None)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("length", F.lit("x")).repartition(3)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=5).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == _expected(whole, 5, [i for i, _ in rows if i % 20 == 0])


def test_top_k_of_few_and_huge(spark):
    few = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    found = topk.top_k(few, F.col("vec_id") == 0, k=20).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, 2**63 - 1), (2, 2, 2**63 - 1)]
    assert topk.top_k(few.limit(0), F.lit(True)).count() == 0


def test_pages_with_very_long_urls_keep_their_row(spark):
    rows = [(1, "http://a/" + "x" * 2_000_000, "h" * 200), (2, "http://b/", "h" * 200), (None, "u", "h" * 200), (None, "u", "h" * 200)]
    found = warc.roundtrip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.error) for r in found) == [(0, "response", None, None)] * 2 + [(1, "response", None, None), (2, "revisit", 1, None)]
    assert max(len(r.target_uri) for r in found) == 2_000_009


def test_a_header_without_end_is_an_error():
    rows = list(warc.read_stream(io.BytesIO(warc.gzip_member(b"WARC/1.1\r\n" + b"x: y\r\n" * 300_000))))
    assert len(rows) == 1 and "no end" in rows[0]["error"]


def test_of_a_repeated_query_the_least_vector_asks(spark):
    rows = [(0, [3.0, 0.0]), (0, [0.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    for parts in (1, 3):
        for order in (rows, rows[::-1]):
            frame = spark.createDataFrame(order, "vec_id bigint, embedding array<double>").repartition(parts)
            found = topk.top_k(frame, F.col("vec_id") == 0, k=2, scale=1.0).collect()
            assert {(r["rank"], r.vec_id, r.score) for r in found} == {(1, 2, 5), (2, 1, 0)}
