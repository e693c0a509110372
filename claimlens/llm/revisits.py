"""Not-modified revisits of a web archive, resolved to the full response they stand for.

Full responses and revisits are one table, sorted by canonical URL and time and cut into ranges. Inside a range a window
carries the last full response along its URL; the last one of each range is carried into the ranges after it. So a URL
with any number of captures is spread over as many ranges as its rows fill. Bodies do not move: a capture names its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import pack_row, stage

RESPONSE, REVISIT = "response", "revisit"
# Fields that a not-modified answer may renew (RFC 9110, 15.4.5, and what tells the age of a copy).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[A-Za-z_]*|fbclid|gclid)(=|$)"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_SORT = ["url_key", "captured_at", "is_full", "record_id"]
ADDED = ("url_key", "outcome", "response_id", "response_sha256", "merged_headers")


def canonical_url(url: str) -> Column:
    """Host, port and path with sorted parameters: no scheme, user, www, default port, tracking, fragment or last slash.

    What has no scheme and host stays as it is; null stays null.
    """
    u = F.trim(F.col(url))
    scheme, host, port, path, query = (F.regexp_extract(u, _URL, k) for k in range(1, 6))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.$", ""), r"^www[0-9]*\.", "")
    usual = (port == "") | ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443"))
    path = F.regexp_replace(path, "/+$", "")
    given = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    whole = F.concat(
        host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path),
        F.when(F.size(given) > 0, F.concat(F.lit("?"), F.array_join(given, "&"))).otherwise(""))
    return F.when(host == "", u).otherwise(whole)


def _field(headers: str, name: str) -> str:
    return f"get(filter({headers}, h -> lower(h.name) = '{name}'), 0).value"


def _opaque(tag: str) -> str:
    """An entity tag without its mark of weakness: a revisit compares weakly."""
    return f"regexp_replace({tag}, '^W/', '')"


def resolve(captures: DataFrame) -> DataFrame:
    """Adds url_key, outcome, response_id, response_sha256 and merged_headers to captures.

    Captures have record_id, url, captured_at, kind (``response`` or ``revisit``), status, sha256 of the body and headers
    as array<struct<name, value>>. A revisit belongs to the latest full response (status 200) of its canonical URL that
    is strictly earlier; of two at one time the greater record_id counts. Their validators are compared: entity tags if
    both have one, else the dates of change if both have one. outcome is

    ``response`` for a capture that is no revisit, ``resolved``, ``no response`` if none is earlier (or URL or time are
    unknown), ``changed`` if the validators differ, ``unchecked`` if one side has a validator that the other lacks.

    Only ``resolved`` rows have response_id, response_sha256 and merged_headers: the response's fields, in their order,
    without those that the revisit renews, then the permitted ones of the revisit. Rows are never dropped; repeated rows
    stay rows of their own; other columns keep their values, but for those with the names of added ones.
    """
    captures = captures.drop(*ADDED)
    headers = "coalesce(headers, cast(array() as array<struct<name: string, value: string>>))"
    is_full = (F.col("kind") == RESPONSE) & (F.col("status") == 200)
    packed = pack_row(
        captures.withColumn("url_key", canonical_url("url")), "url_key", "captured_at", "record_id", "kind", F.coalesce(is_full, F.lit(False)).alias("is_full"),
        F.struct("record_id", "sha256", F.expr(headers).alias("headers")).alias("own"))
    parts = packed.repartitionByRange(*_SORT).sortWithinPartitions(*_SORT).withColumn("part", F.spark_partition_id())
    parts = stage(parts, "revisits-sorted")

    # a revisit sorts before a response of the same time, so what was met before it is strictly earlier
    full = F.when(F.col("is_full") & F.col("captured_at").isNotNull() & F.col("url_key").isNotNull(), F.struct("url_key", "own"))
    along = Window.partitionBy("part", "url_key").orderBy(*_SORT[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # keys are never null here, and a struct of them is greatest where the order is last
    last = F.max(F.when(full.isNotNull(), F.struct("url_key", "captured_at", "record_id", "own")))
    lasts = parts.groupBy("part").agg(last.alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("part").alias("to_part"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    met = parts.withColumn("met", F.last(full, ignorenulls=True).over(along)["own"])
    met = met.join(F.broadcast(carried), F.col("part") == F.col("to_part"))
    revisit = F.coalesce(F.col("kind") == REVISIT, F.lit(False))
    placed = revisit & F.col("captured_at").isNotNull() & F.col("url_key").isNotNull()
    found = F.coalesce("met", F.when(F.col("carried.url_key") == F.col("url_key"), F.col("carried.own")))
    met = met.select("row", revisit.alias("revisit"), F.when(placed, found).alias("found"), F.col("own.headers").alias("mine"))
    etag, date = (tuple(f"{_field(h, name)}" for h in ("mine", "found.headers")) for name in ("etag", "last-modified"))
    outcome = F.expr(f"""CASE WHEN NOT revisit THEN 'response' WHEN found IS NULL THEN 'no response'
        WHEN {etag[0]} IS NOT NULL AND {etag[1]} IS NOT NULL THEN if({_opaque(etag[0])} = {_opaque(etag[1])}, 'resolved', 'changed')
        WHEN {date[0]} IS NOT NULL AND {date[1]} IS NOT NULL THEN if({date[0]} = {date[1]}, 'resolved', 'changed')
        WHEN coalesce({etag[0]}, {etag[1]}, {date[0]}, {date[1]}) IS NULL THEN 'resolved' ELSE 'unchecked' END""")
    permitted = ", ".join(f"'{name}'" for name in PERMITTED)
    met = met.withColumn("outcome", outcome).withColumn("renewed", F.expr(f"filter(mine, h -> lower(h.name) in ({permitted}))"))
    merged = F.expr("concat(filter(found.headers, h -> not coalesce(array_contains(transform(renewed, r -> lower(r.name)), lower(h.name)), false)), renewed)")
    done = F.col("outcome") == "resolved"
    return met.select(
        *[F.col(f"row.`{c}`").alias(c) for c in captures.columns], F.col("row.url_key").alias("url_key"), "outcome",
        F.when(done, F.col("found.record_id")).alias("response_id"), F.when(done, F.col("found.sha256")).alias("response_sha256"),
        F.when(done, merged).alias("merged_headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures as an archive of the pages would hold them: of each page a response and three revisits.

    Times are seconds that follow from page_id. Every eleventh page was answered by 404 first, so its revisits stand for
    another page's response of the same canonical URL or for none; every fifth has a new entity tag at the second
    revisit; the third revisit has no entity tag, and for every seventh page no date of change either.
    """
    day = "(1700000000L + (page_id * 7919L) % 86400L + k * 86400L)"
    header = "named_struct('name', '{}', 'value', {})".format
    tag = "concat('\"', left(sha256, 16), if(k = 2 AND page_id % 5 = 0, 'x', ''), '\"')"
    response = ", ".join([
        header("Content-Type", "'text/html'"), header("Content-Length", "cast(n_bytes as string)"), header("Date", f"cast({day} as string)"),
        header("ETag", tag), header("Last-Modified", "cast(page_id as string)"), header("Server", "'a'")])
    revisit = ", ".join([header("date", f"cast({day} as string)"), header("cache-control", "'max-age=60'"), header("content-length", "'0'"), header("server", "'b'")])
    marks = f"CASE WHEN k < 3 THEN array({header('etag', f'concat(\'W/\', {tag})')}) WHEN page_id % 7 = 0 THEN array() ELSE array({header('last-modified', 'cast(page_id as string)')}) END"
    rows = pages.select("page_id", "url", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("n_bytes"))
    each = rows.withColumn("k", F.explode(F.expr("sequence(0, 3)")))
    return each.select(
        F.expr("page_id * 4L + k").alias("record_id"), "url", F.expr(day).alias("captured_at"), F.expr("if(k = 0, 'response', 'revisit')").alias("kind"),
        F.expr("CASE WHEN k > 0 THEN 304 WHEN page_id % 11 = 0 THEN 404 ELSE 200 END").alias("status"), F.when(F.col("k") == 0, F.col("sha256")).alias("sha256"),
        F.expr(f"if(k = 0, array({response}), concat(array({revisit}), {marks}))").alias("headers"))
