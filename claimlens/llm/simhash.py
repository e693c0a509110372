"""SimHash near-duplicates of documents, linked over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes, stage, utf8
from claimlens.llm.components import components
from claimlens.llm.gray_index import Forest, GrayIndex, rotate

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
# Visiting codes compared with a stretch of the index at once; bounds memory, not results.
VISITORS = 1 << 16


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text: a bit is set if over half of its shingles' hashes have it; without words it is zero."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        found = text.lower().split()  # bytes: A-Z and ASCII white space only
        if not found:
            counts.append(0)
            continue
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.r_[0, ends[:-1]]
        n = max(1, len(found) - words + 1)
        begin, end = starts[:n].tolist(), (ends[len(ends) - n :] - 1).tolist()
        hashes.append(np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end)], np.uint64))
        counts.append(n)
    out = np.zeros(len(texts), np.uint64)
    for k, (h, n) in enumerate(zip(_spread(hashes, counts), counts)):
        if n:
            bits = np.zeros(64, np.int64)
            for at in range(0, n, 1 << 16):
                bits += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(bits * 2 > n).view(">u8")[0]
    return out


def _spread(hashes: list[np.ndarray], counts: list[int]) -> Iterator[np.ndarray]:
    own = iter(hashes)
    return (next(own) if n else np.zeros(0, np.uint64) for n in counts)


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Replaces ``text`` by ``fp``, the fingerprint as a signed long; other columns stay, but for one named ``fp``."""
    docs = docs.drop("fp")
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data, at = utf8(batch.column("text"))
            data = data.tobytes()
            fp = fingerprints([data[a:b] for a, b in zip(at[:-1], at[1:])], words)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(fp.view(np.int64))], names=[*[f.name for f in kept], "fp"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def _rotated(code: Column, bits: int) -> Column:
    return F.shiftleft(code, bits).bitwiseOR(F.shiftrightunsigned(code, 64 - bits)) if bits else code


def _rank(code: Column) -> Column:
    """Gray rank as a long whose signed order is the rank's unsigned order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


_LINKS = T.StructType([T.StructField(n, T.LongType()) for n in ("turn", "a", "b", "part")])


def _emit(turn: int, forest: Forest, codes: np.ndarray) -> pa.RecordBatch:
    root = forest.roots()
    other = np.flatnonzero(root != np.arange(len(root)))
    a, b = (rotate(codes[x], 64 - turn).view(np.int64) for x in (other, root[other]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), turn)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=_LINKS.names)


def _within(most: int, leads: dict[int, int]):
    """Links between the codes of one range, and the codes of its first and last lead block, which may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("turn").to_numpy(), b.column("code").to_numpy(), b.column("part").to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        turns, codes, parts = (np.concatenate(x) for x in zip(*rows))
        for turn in np.unique(turns).tolist():
            own = codes[turns == turn].view(np.uint64)
            index, forest = GrayIndex(own), Forest(len(own))
            for a, b in index.search(own, most, leads[turn], np.arange(len(own))):
                forest.join(a, b)
            yield _emit(turn, forest, own)
            block = own >> np.uint64(64 - leads[turn])
            edge = own[(block == block[0]) | (block == block[-1])].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(edge), turn)), pa.array(edge), pa.nulls(len(edge), pa.int64()), pa.array(np.full(len(edge), parts[0], np.int64))], names=_LINKS.names)

    return run


def _across(most: int, leads: dict[int, int]):
    """Links between the codes of a block in one range and those of the same block in earlier ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, index = None, [], None
        for batch in batches:
            turn, block, part, kind, code = (batch.column(c).to_numpy() for c in ("turn", "block", "part", "visitor", "code"))
            cuts = np.flatnonzero(np.r_[True, (turn[1:] != turn[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (turn[a], block[a], part[a]) != key:
                    key, own, index = (turn[a], block[a], part[a]), [], None
                codes = code[a:b].view(np.uint64)
                if not kind[a]:
                    own.append(codes)
                    continue
                if index is None:
                    index = GrayIndex(np.concatenate(own))
                for at in range(0, len(codes), VISITORS):
                    visitors = codes[at : at + VISITORS]
                    n, forest = len(index.codes), Forest(len(index.codes) + len(visitors))
                    for q, c in index.search(visitors, most, leads[int(turn[a])]):
                        forest.join(q + n, c)
                    yield _emit(int(turn[a]), forest, np.concatenate([index.codes, visitors]))

    return run


def fingerprint_links(codes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) that connect all codes of ``fp`` (distinct longs) within ``most_bits`` of each other, and no others.

    Not every pair is returned, but enough to reach each from the other: a forest per range of the index.

    Of ``most_bits`` + 1 blocks of bits, two codes within ``most_bits`` share at least one. So the codes are put in
    order once per block, turned so that the block leads, by Gray rank, and dealt out by ranges of it. A range
    searches itself; only the blocks at its two ends can go on in another range, and their codes visit the later
    ranges of the block. Codes are distinct, so ranges have like sizes whatever the number of copies.
    """
    cuts = [round(64 * k / (most_bits + 1)) for k in range(most_bits + 2)]
    leads = {a: b - a for a, b in zip(cuts[:-1], cuts[1:])}
    turned = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), _rotated(F.col("fp"), t).alias("code")) for t in leads]))
    order = [F.col("turn"), _rank(F.col("code"))]
    ranged = codes.select(turned.alias("x")).select("x.*").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(ranged.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_within(most_bits, leads), _LINKS), "gray-links")
    lead = F.element_at(F.create_map(*[F.lit(x).cast("long") if k % 2 == 0 else F.lit(x) for t, n in leads.items() for k, x in enumerate((t, 64 - n))]), F.col("turn"))
    ends = found.where("part is not null").select("turn", F.expr("a").alias("code"), "part").withColumn("shift", lead)
    ends = ends.withColumn("block", F.expr("shiftrightunsigned(code, shift)")).drop("shift")
    spread = ends.groupBy("turn", "block").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    ends = ends.join(spread, ["turn", "block"])
    members = ends.where("part > first").select("turn", "block", "part", F.lit(0).alias("visitor"), "code")
    visitors = ends.where("part < last").select("turn", "block", F.explode(F.sequence(F.col("part") + 1, F.col("last"))).alias("part"), F.lit(1).alias("visitor"), "code")
    met = members.union(visitors).repartition("turn", "block", "part").sortWithinPartitions("turn", "block", "part", "visitor", _rank(F.col("code")))
    links = found.where("part is null").union(met.mapInArrow(_across(most_bits, leads), _LINKS))
    return links.select("a", "b")


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """Component of every row of (doc_id, text): doc_id, fp, component_id; other columns are ignored.

    Texts are lower-cased (A-Z) and cut into words; fingerprints of ``words``-word shingles link at ``most_bits`` or
    fewer differing bits; component_id is the smallest doc_id reached. A null text is an empty one; texts without words
    have fingerprint zero and are linked like any other; rows with the same doc_id stay separate rows; a null doc_id is
    larger than any other. An empty table stays empty. Equal fingerprints are joined as one code before the search.
    """
    return _components(stage(with_fingerprints(docs.select("doc_id", "text"), words), "simhash"), most_bits).drop("root")


def _components(marked: DataFrame, most_bits: int) -> DataFrame:
    codes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "simhash-codes")
    roots = components(fingerprint_links(codes, most_bits))
    placed = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return marked.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents without near-duplicates: of every component the row with the smallest doc_id, one if several have it.

    Columns are those of ``docs``. A component without any doc_id keeps one row too.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = stage(with_fingerprints(docs.select("doc_id", text_key.alias("text_key"), "text"), words), "simhash-rows")
    found = _components(marked, most_bits)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("text_key"))).alias("best")
    key = ["own_missing", "own_id", "own_key"]

    def keyed(doc_id: Column, text_hash: Column) -> list[Column]:
        return [x.alias(name) for x, name in zip((doc_id.isNull(), F.xxhash64(doc_id), text_hash), key)]

    kept = found.groupBy("root").agg(best).select(*keyed(F.col("best.doc_id"), F.col("best.text_key"))).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*keyed(F.col("doc_id"), text_key), row).join(kept, key, "left_semi")
    # rows of one doc_id and text are alike but for other columns: one of them stays
    again = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row")))
    return rows.withColumn("again", again).where("again = 1").select("row.*")
