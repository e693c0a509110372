import random

import pytest
from pyspark.sql import functions as F

from claimlens.llm.revisits import canonical_url, resolve

SCHEMA = "record_id long, url string, captured_at long, kind string, status int, sha256 string, headers array<struct<name: string, value: string>>"


def full(i, url, at, *headers, status=200):
    return (i, url, at, "response", status, f"s{i}", list(headers))


def again(i, url, at, *headers):
    return (i, url, at, "revisit", 304, None, list(headers))


def run(spark, rows):
    return {r.record_id: r for r in resolve(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("url,key", [
    ("HTTP://user@www.A.example:80/b/?z=1&utm_source=x&a=2#top", "a.example/b?a=2&z=1"), ("https://a.example", "a.example/"),
    ("https://www2.a.example.:8080/B/", "a.example:8080/B"), ("http://a.example:443/?gclid=1", "a.example:443/"), ("no url", "no url"), ("", ""), (None, None),
])
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(canonical_url("url").alias("k")).first().k == key


def test_outcomes_and_headers(spark):
    e, d = ("ETag", '"1"'), ("Last-Modified", "mon")
    got = run(spark, [
        full(1, "http://a.x/", 10, e, d, ("Content-Length", "5"), ("Date", "10")), again(2, "https://www.a.x", 20, ("etag", 'W/"1"'), ("date", "20"), ("content-length", "0")),
        again(3, "http://a.x/", 10, e), again(4, "http://a.x/", 5, e), again(5, "http://a.x/#t", 21, ("etag", '"2"'), d), again(6, "http://a.x/", 22, d), again(7, "http://a.x/", 23),
        full(8, "http://a.x/", 30, status=404), again(9, "http://a.x/", 31, e), again(10, None, 40, e), again(11, "http://a.x/", None, e),
        full(12, "http://t.x/", 1), full(13, "http://t.x/", 1), again(14, "http://t.x/", 2), full(15, "http://n.x/", None), again(16, "http://n.x/", 3), full(17, None, 1),
    ])
    assert {k: r.outcome for k, r in got.items() if r.kind == "revisit"} == {
        2: "resolved", 3: "no response", 4: "no response", 5: "changed", 6: "resolved", 7: "unchecked", 9: "resolved", 10: "no response",
        11: "no response", 14: "resolved", 16: "no response"}
    assert [tuple(h) for h in got[2].merged_headers] == [d, ("Content-Length", "5"), ("etag", 'W/"1"'), ("date", "20")]
    assert got[2].response_id == 1 and got[2].response_sha256 == "s1" and got[9].response_id == 1 and got[14].response_id == 13
    assert got[5].response_id is got[5].merged_headers is got[1].response_id is None and got[1].outcome == got[8].outcome == "response"


def test_hot_url_over_many_ranges(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        url = "http://hot.x/" if rng.random() < 0.8 else f"http://{rng.randrange(40)}.x/"
        rows.append((full if rng.random() < 0.003 else again)(i, url, rng.randrange(2000)))
    rows += [rows[7], rows[8]]
    want = []
    for r in rows:
        earlier = [(f[2], f[0]) for f in rows if f[3] == "response" and f[1] == r[1] and f[2] < r[2]]
        want.append((r[0], max(earlier)[1] if r[3] == "revisit" and earlier else None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = [(r.record_id, r.response_id) for r in resolve(df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([full(1, "u://a", 1), (*again(2, "u://a", 2)[:6], None)], SCHEMA)
    names = ("part", "to_part", "carried", "met", "found", "own", "row", "last", "mine", "revisit", "renewed", "is_full", "outcome", "url_key")
    got = resolve(df.select("*", *[F.lit("x").alias(c) for c in names])).orderBy("record_id").collect()
    assert [r.outcome for r in got] == ["response", "resolved"] and got[1].response_id == 1
    assert all(r[c] == "x" for r in got for c in names if c not in ("outcome", "url_key"))
    assert resolve(df.limit(0)).count() == 0
