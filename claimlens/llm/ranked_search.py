"""Ranked lexical search over a length-stratified index.

Documents with an equal normaliser ``m`` form a stratum, cut into slices of bounded size. A slice lists its postings by
term and, within a term, by ``tf``; a document's impact depends on ``tf`` and ``m`` only, so it is computed once per ``tf``.
Beside the postings a slice keeps each term's largest ``tf``, which bounds the score of any of its documents.

A search goes by these bounds: it first visits, per item, the slices of highest bound, until they hold enough documents.
The k-th best score found there is a floor, and of the other slices only those are visited whose bound reaches it. A slice
is scored for all items that visit it in one matrix product, whose terms are whole numbers below 2^53 and so exact.

    w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 50 + (50 n N) div L
    score = sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 20 m))

with N documents that have a term, L terms in them, n terms in a document, df documents that have the term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes, stage, utf8

# In bytes of UTF-8, lower-cased: digits, a to z and everything beyond ASCII; that is [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
# Documents in a slice, items in a block, terms in a product: they set memory and the size of a step, not results.
SLICE = 1024
ITEMS = 256
_COLUMNS = 2048
# Documents that the first visit looks at, per item and k: it sets the floor's quality, not results.
FIRST = 40
# Asked terms are sent to all tasks, to be picked while texts are read, up to so many bytes; beyond that they are joined.
SENT_BYTES = 16 << 20


def terms_of(text: bytes) -> list[bytes]:
    return _TERMS.findall(text.lower())


def _count(only: dict[bytes, int] | None):
    """(row_id, doc_id, n, terms, tfs) of each document: all its terms, or the numbers of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data, at = utf8(batch.column("text"))
            whole, ns, terms, tfs, ends = data.tobytes(), [], [], [], [0]
            for i in range(batch.num_rows):
                found = terms_of(whole[at[i] : at[i + 1]])
                ns.append(len(found))
                counted = Counter(found)
                if only is None:
                    terms.extend(counted)
                    tfs.extend(counted.values())
                else:
                    for term in counted.keys() & only.keys():
                        terms.append(only[term])
                        tfs.append(counted[term])
                ends.append(len(tfs))
            ends = pa.array(ends, pa.int32())
            named = pa.array(terms, pa.int32()) if only is not None else pa.array([t.decode() for t in terms], pa.string())
            yield pa.RecordBatch.from_arrays([
                batch.column("row_id"), batch.column("doc_id"), pa.array(ns, pa.int64()),
                pa.ListArray.from_arrays(ends, named), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
            ], names=["row_id", "doc_id", "n", "terms", "tfs"])

    return run


def asked_terms(items: DataFrame) -> DataFrame:
    """(row_id, item_id, term) of the items: each distinct term once."""
    rows = items.select("row_id", F.col("item_id").alias("doc_id"), "text")
    schema = T.StructType([*rows.select("row_id", "doc_id").schema, T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(_count(None), schema).select("row_id", F.col("doc_id").alias("item_id"), F.explode("terms").alias("term"))


def count_terms(docs: DataFrame, vocabulary: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(row_id, doc_id, n, terms, tfs) of documents (row_id, doc_id, text): term numbers of the vocabulary (term, id) only."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    head = [*docs.select("row_id", "doc_id").schema, T.StructField("n", T.LongType())]
    if size <= sent_bytes:
        only = {r["term"].encode(): r["id"] for r in vocabulary.collect()}
        schema = T.StructType([*head, T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
        return docs.select("row_id", "doc_id", "text").mapInArrow(_count(only), schema)
    schema = T.StructType([*head, T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    counted = stage(docs.select("row_id", "doc_id", "text").mapInArrow(_count(None), schema), "search-counts")
    each = counted.select("row_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).join(vocabulary, "term")
    lists = each.groupBy("row_id").agg(F.collect_list("id").alias("terms"), F.collect_list("tf").alias("tfs"))
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return counted.select("row_id", "doc_id", "n").join(lists, "row_id", "left").select(
        "row_id", "doc_id", "n", F.coalesce("terms", none[0]).alias("terms"), F.coalesce("tfs", none[1]).alias("tfs"))


# --- the index -----------------------------------------------------------------------------------------

_SLICES = T.StructType([
    T.StructField("slice", T.LongType()), T.StructField("m", T.LongType()), T.StructField("n_docs", T.IntegerType()),
    T.StructField("terms", T.BinaryType()), T.StructField("most", T.BinaryType()),  # distinct terms, in order, and the largest tf of each
    T.StructField("doc_ids", T.BinaryType()),  # in order; nulls last
    T.StructField("n_nulls", T.IntegerType()), T.StructField("run_terms", T.BinaryType()), T.StructField("run_tfs", T.BinaryType()),
    T.StructField("run_ends", T.BinaryType()), T.StructField("places", T.BinaryType()),  # postings: runs of equal term and tf
])


def _slices(size: int):
    """Slices from documents sorted by ``m``."""

    def packed(m: int, rows: pa.RecordBatch, number: int) -> list:
        ids = rows.column("doc_id")
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
        rows = rows.take(pa.array(order))
        ids = rows.column("doc_id")
        terms, tfs = rows.column("terms"), rows.column("tfs")
        places = np.repeat(np.arange(rows.num_rows), np.diff(terms.offsets.to_numpy()))
        t, f = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().to_numpy(zero_copy_only=False)
        by = np.lexsort((places, f, t))
        t, f, places = t[by], f[by], places[by]
        new = np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1])] if len(t) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        run_terms, run_tfs = t[begins], f[begins]
        last = np.flatnonzero(np.r_[run_terms[1:] != run_terms[:-1], True]) if len(begins) else begins
        blobs = [run_terms[last], run_tfs[last], ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)]
        runs = [run_terms, run_tfs, np.r_[begins[1:], len(t)] if len(begins) else begins, places]
        return [number, m, rows.num_rows, *[b.astype(np.int64).tobytes() for b in blobs], ids.null_count, *[b.astype(np.int32).tobytes() for b in (runs[0], runs[1], runs[2], runs[3])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                values = packed(whole.column("m")[0].as_py(), whole, number)
                number += 1
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(values, _ARROW)], names=_SLICES.names)

        for batch in batches:
            ms = batch.column("m").to_numpy(zero_copy_only=False)
            begin = 0
            while begin < batch.num_rows:
                had = sum(b.num_rows for b in held)
                if had and (held[0].column("m")[0].as_py() != ms[begin] or had >= size):
                    yield from flush()
                    had = 0
                end = min(int(np.searchsorted(ms, ms[begin], "right")), begin + size - had)
                held.append(batch.slice(begin, end - begin))
                begin = end
        yield from flush()

    return run


_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def build_index(counted: DataFrame, n_docs: int, n_terms: int, size: int = SLICE) -> DataFrame:
    """Slices of the strata of a written table of counted documents; documents without an asked term are left out.

    Documents are sorted by ``m`` and a hash in ranges, so a stratum of any size is cut into as many ranges as it needs.
    """
    m = F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = counted.where(F.size("terms") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), m.alias("m"), "terms", "tfs", F.xxhash64("row_id").alias("h"))
    ranged = rows.repartitionByRange("m", "h").sortWithinPartitions("m", "h").drop("h")
    return ranged.mapInArrow(_slices(size), _SLICES)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


# --- searching -----------------------------------------------------------------------------------------


def _weights(rows: list, terms: np.ndarray) -> np.ndarray:
    """Weights of ``terms`` (in order) for each item: items x terms, doubles that hold whole numbers."""
    out = np.zeros((len(rows), len(terms)))
    for i, item in enumerate(rows):
        own = item["terms"]
        at = np.searchsorted(terms, own)
        there = at < len(terms)
        there[there] = terms[at[there]] == own[there]
        out[i, at[there]] = item["weights"][there]
    return out


_BOUNDS = T.StructType([T.StructField("slice", T.LongType()), T.StructField("block", T.LongType()), T.StructField("item", T.IntegerType()),
                        T.StructField("n_docs", T.IntegerType()), T.StructField("bound", T.DoubleType())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts; the items of a block, which come beside many slices, are read once as long as the block stays."""
    block, items = None, []
    for batch in batches:
        names = [n for n in batch.schema.names if n != "items"]
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in names}
            if row["block"] != block:
                block, items = row["block"], batch.column("items")[i].as_py()
                for item in items:
                    item["terms"], item["weights"] = np.array(item["terms"], np.int64), np.array(item["weights"], np.float64)
            yield row | {"items": items}


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most that any document of a slice can score for each item; items that share no term are left out."""
    for row in _rows(batches):
        terms, most = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["most"], np.int64)
        bounds = np.zeros(len(row["items"]))
        for at in range(0, len(terms), _COLUMNS):
            part = slice(at, at + _COLUMNS)
            bounds += _weights(row["items"], terms[part]) @ impacts(most[part], row["m"]).astype(np.float64)
        some = np.flatnonzero(bounds > 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(some), row["slice"]), pa.int64()), pa.array(np.full(len(some), row["block"]), pa.int64()), pa.array(some, pa.int32()),
            pa.array(np.full(len(some), row["n_docs"]), pa.int32()), pa.array(bounds[some], pa.float64())], names=_BOUNDS.names)


_HITS = T.StructType([T.StructField("block", T.LongType()), T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def _score(k: int):
    """Of each slice and visiting item the k best documents that reach the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            visits = row["visits"]
            items = [row["items"][v["item"]] for v in visits]
            run_terms, run_tfs, ends, places = (np.frombuffer(row[c], np.int32) for c in ("run_terms", "run_tfs", "run_ends", "places"))
            terms = np.frombuffer(row["terms"], np.int64)
            gains = impacts(run_tfs, row["m"]).astype(np.float64)
            begins = np.r_[0, ends[:-1]].astype(np.int64)
            scores = np.zeros((len(items), row["n_docs"]))
            for at in range(0, len(terms), _COLUMNS):
                part = terms[at : at + _COLUMNS]
                weights = _weights(items, part)
                first, last = np.searchsorted(run_terms, part[0], "left"), np.searchsorted(run_terms, part[-1], "right")
                lengths = (ends[first:last] - begins[first:last]).astype(np.int64)
                column = np.repeat(np.searchsorted(part, run_terms[first:last]), lengths)
                matrix = np.zeros((len(part), row["n_docs"]))
                matrix[column, places[begins[first] : ends[last - 1]]] = np.repeat(gains[first:last], lengths)
                scores += weights @ matrix
            ids = np.frombuffer(row["doc_ids"], np.int64)
            nulls = row["n_docs"] - row["n_nulls"]
            out = []
            for i, v in enumerate(visits):
                own = np.flatnonzero(scores[i] >= max(1.0, v["floor"]))
                # documents stand in the order of their ids, which settles ties
                best = own[np.lexsort((own, -scores[i][own]))[:k]]
                out.append((v["item"], best, scores[i][best]))
            where = np.concatenate([b for _, b, _ in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(where), row["block"]), pa.int64()), pa.array(np.repeat([i for i, *_ in out], [len(b) for _, b, _ in out]), pa.int32()),
                pa.array(ids[where], pa.int64(), mask=where >= nulls), pa.array(np.concatenate([s for *_, s in out]), pa.float64()).cast(pa.int64()),
            ], names=_HITS.names)

    return run


def _rank(hits: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", best).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, size: int = SLICE, block: int = ITEMS, first: int = FIRST, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of highest score above 0, equal scores by doc_id.

    ``docs`` has ``doc_id`` (a whole number) and ``text``, ``items`` has ``item_id`` and ``text``; other columns are not read.
    A null or empty text has no terms: as a document it counts nowhere, as an item it finds nothing. Every row is a
    document or an item of its own, also where ids or texts repeat; a null doc_id comes after all others. Fewer than k rows
    come out where fewer documents score. Empty tables give no rows. Terms of more than 2^53 / (10^6 w) per item would
    leave the exact range and are an error.
    """
    items = stage(items.select("item_id", "text").withColumn("row_id", F.monotonically_increasing_id()), "search-items")
    asked = stage(asked_terms(items), "search-asked")
    distinct = stage(asked.select("term").distinct(), "search-terms")
    vocabulary = stage(_numbered(distinct), "search-vocabulary")
    numbered = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    counted = stage(count_terms(numbered, vocabulary, sent_bytes), "search-documents")
    n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    index = stage(build_index(counted, n_docs, n_terms, size), "search-index")

    df = counted.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2.0)) / (F.col("df") * 2.0 + 1.0)))
    weighted = asked.join(vocabulary, "term").join(df, "id").select("row_id", "id", weight.alias("w"))
    lists = weighted.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("x"))
    lists = lists.select("row_id", F.col("x.id").alias("terms"), F.col("x.w").alias("weights"))
    lists = stage(lists.repartitionByRange("row_id").withColumn("part", F.spark_partition_id()), "search-lists")
    if (lists.agg(F.max(F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w))).first()[0] or 0) >= 2**53 // 10**6:
        raise ArithmeticError("an item's scores leave the exact range of doubles")
    # items are dealt into blocks of bounded number inside each range of their rows
    place = F.row_number().over(Window.partitionBy("part").orderBy("row_id")) - 1
    blocks = lists.withColumn("place", place).withColumn("block", F.col("part").cast("long") * 2**32 + F.floor(F.col("place") / block))
    blocks = stage(blocks.withColumn("item", (F.col("place") % block).cast("int")).drop("part", "place"), "search-blocks")
    packed = stage(blocks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", "terms", "weights"))).alias("items")), "search-packed")

    # a stated query set against all rows, in blocks; only bounds are read here
    bounds = stage(index.select("slice", "m", "n_docs", "terms", "most").crossJoin(packed).mapInArrow(_bound, _BOUNDS), "search-bounds")
    order = Window.partitionBy("block", "item").orderBy(F.desc("bound"), "slice").rowsBetween(Window.unboundedPreceding, -1)
    bounds = stage(bounds.withColumn("leading", F.coalesce(F.sum("n_docs").over(order), F.lit(0)) < first * k), "search-order")

    def visit(some: DataFrame) -> DataFrame:
        grouped = some.groupBy("slice", "block").agg(F.collect_list(F.struct("item", "floor")).alias("visits"))
        met = index.join(grouped, "slice").join(packed, "block")
        return met.mapInArrow(_score(k), _HITS)

    lead = stage(visit(bounds.where("leading").select("slice", "block", "item", F.lit(0.0).alias("floor"))), "search-first")
    floors = _rank(lead, k).where(F.col("rank") == k).select("block", "item", F.col("score").cast("double").alias("floor"))
    rest = bounds.where("not leading").join(floors, ["block", "item"], "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).where("bound >= floor")
    hits = lead.union(visit(rest.select("slice", "block", "item", "floor")))
    return _rank(hits, k).join(blocks.select("block", "item", "row_id"), ["block", "item"]).join(items.select("row_id", "item_id"), "row_id").select(
        "item_id", "rank", "doc_id", "score")


def _numbered(distinct: DataFrame) -> DataFrame:
    """(term, id): numbers from 0 without gaps. Ranges are counted first, so no task sees all terms."""
    ranged = stage(distinct.repartitionByRange("term").withColumn("part", F.spark_partition_id()), "search-ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    # one row per partition
    base = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return ranged.withColumn("place", place).join(base, "part").select("term", (F.col("place") + F.col("base")).cast("int").alias("id"))
