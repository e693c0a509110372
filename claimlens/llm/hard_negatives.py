"""Hard negatives of anchor vectors: rows of another label whose score lies just below a positive's.

Vectors are integers and a score is their inner product, so every result is exact. Scores are first bounded from one-bit
codes. A vector o is turned by a rotation (random signs and Hadamard transforms, so lengths and products stay); the signs
of the turned vector are its code x, a vector of length one, and its alignment a = <x, o> is stored beside it. What the code
leaves, r = o - a x, is coded in the same way, LEVELS times in all, and its length is stored. For an anchor q

    <q, o> = sum of a <q, x> over the levels + <q, r>,  |<q, r>| <= |r| sqrt(|q|^2 - <q, x>^2)

by Cauchy and Schwarz, for r is at right angles to the last x. <q, x> is estimated by popcounts of the code with the bit
planes of q rounded to PLANES bits; the rounding e adds at most |e| |o - r|. So each level gives an interval that surely
holds the score. Rows whose interval cannot reach the result are left out level by level, the rest is scored in integers.

Rows are packed into blocks; each block of anchors, a stated set of queries, meets each block of rows. A task carries the
best scores that it has seen for its anchors from block to block and hands on only these, a few per anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import stage

LEVELS = 4
PLANES = 6
# Rows in a block. They set memory and the size of a step, not results.
ROW_BLOCK = 4096
ANCHOR_BLOCK = 1024
# Widens every interval by this share of the lengths: far above what sums of doubles round off.
_SLACK = 1e-9
# Products and sums below this are exact in doubles; other vectors are scored in Python's integers.
_EXACT = 2.0**53


def _signs(width: int, seed: int) -> np.ndarray:
    """Rounds of random signs for vectors of a width that is a power of two; the same in every task."""
    return np.where(np.random.default_rng(seed + width).random((3, width)) < 0.5, -1.0, 1.0)


def rotate(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """Vectors padded to a power of two (64 at least) and turned: products of two of them stay what they were."""
    n, dim = vectors.shape
    width = max(64, 1 << (max(dim, 1) - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :dim] = vectors
    for signs in _signs(width, seed):
        out *= signs
        step = 1
        while step < width:
            pairs = out.reshape(n, -1, 2, step)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
            step *= 2
        out /= np.sqrt(width)
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (levels, n, words), alignments and lengths of what is left (levels, n), and lengths of the vectors (n)."""
    rest = rotate(vectors)
    root = np.sqrt(rest.shape[1])
    length = np.sqrt((rest * rest).sum(1))
    codes, aligned, left = [], [], []
    for _ in range(levels):
        up = rest > 0
        a = np.abs(rest).sum(1) / root
        rest = rest - np.where(up, 1.0, -1.0) * (a / root)[:, None]
        codes.append(_bits(up))
        aligned.append(a)
        left.append(np.sqrt((rest * rest).sum(1)))
    return np.array(codes), np.array(aligned), np.array(left), length


class Asked:
    """An anchor's turned vector as bit planes."""

    def __init__(self, turned: np.ndarray) -> None:
        self.width = len(turned)
        self.low, span = turned.min(), turned.max() - turned.min()
        self.step = span / (2**PLANES - 1) if span > 0 else 1.0
        rounded = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = [_bits(((rounded >> b) & 1).astype(bool)[None])[0] for b in range(PLANES)]
        self.total = int(rounded.sum())
        near = rounded * self.step + self.low
        self.off = float(np.sqrt(((turned - near) ** 2).sum()))
        self.length = float(np.sqrt((turned * turned).sum()))

    def along(self, codes: np.ndarray) -> np.ndarray:
        """Products of the rounded anchor with the code vectors: signs by popcounts."""
        up = np.zeros(len(codes), np.int64)
        for b, plane in enumerate(self.planes):
            up += np.bitwise_count(codes & plane).sum(1, dtype=np.int64) << b
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        return ((2 * up - self.total) * self.step + (2 * ones - self.width) * self.low) / np.sqrt(self.width)


Cut = Callable[[np.ndarray, np.ndarray], np.ndarray]


def candidates(asked: Asked, rows: np.ndarray, codes: np.ndarray, aligned: np.ndarray, left: np.ndarray, length: np.ndarray, cut: Cut) -> np.ndarray:
    """The places among ``rows`` that ``cut(low, high)`` keeps for the intervals of the last level; each level is cut first."""
    sums = np.zeros(len(rows))
    for level in range(len(codes)):
        x = asked.along(codes[level][rows])
        sums = sums + aligned[level][rows] * x
        beside = np.sqrt(np.maximum(0.0, asked.length**2 - np.maximum(0.0, np.abs(x) - asked.off) ** 2))
        wide = left[level][rows] * beside + asked.off * (length[rows] + left[level][rows])
        wide += _SLACK * (asked.length * length[rows] + 1.0)
        kept = cut(sums - wide, sums + wide)
        rows, sums = rows[kept], sums[kept]
        if not len(rows):
            break
    return rows


def integer_scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products; by doubles where no sum can leave their exact range, else by Python's integers."""
    if np.abs(vectors).max(initial=0) * np.abs(anchor).max(initial=0) * max(1, len(anchor)) < _EXACT:
        return (vectors @ anchor).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, anchor)) for row in vectors.tolist()], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


# --- packing -------------------------------------------------------------------------------------------

_ROWS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "n")] + [
    T.StructField(n, T.BinaryType()) for n in ("ids", "labels", "vectors", "codes", "aligned", "remains", "lengths")])


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat elements and widths of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())


def _pack_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, widths = _matrix(batch.column("vector"))
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            starts = np.cumsum(widths) - widths
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                own = own[np.argsort(labels[own], kind="stable")]
                for at in range(0, len(own), size):
                    part = own[at : at + size]
                    vectors = flat[starts[part][:, None] + np.arange(width)] if width else np.zeros((len(part), 0))
                    codes, aligned, left, length = encode(vectors)
                    blobs = [x.tobytes() for x in (ids[part].astype(np.int64), labels[part].astype(np.int64), vectors, codes, aligned, left, length)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(width)], pa.int32()), pa.array([len(part)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=_ROWS.names)

    return run


class _Rows:
    def __init__(self, row: dict) -> None:
        n, self.width = row["n"], row["width"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"]).reshape(n, self.width)
        self.aligned, self.remains = (np.frombuffer(row[c]).reshape(-1, n) for c in ("aligned", "remains"))
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(len(self.aligned), n, -1)
        self.lengths = np.frombuffer(row["lengths"])

    def search(self, asked: Asked, anchor: np.ndarray, rows: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        near = candidates(asked, rows, self.codes, self.aligned, self.remains, self.lengths, cut)
        return near, integer_scores(self.vectors[near], anchor)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


# --- positives -----------------------------------------------------------------------------------------

_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "slot", "other", "score")])


def _find_positives(k: int):
    """Of each meeting the k best rows of the anchor's label and another id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in (r for r in batch.to_pylist() if r["width"] == r["a_width"]):
                rows = _Rows(row)
                vectors = np.frombuffer(row["a_vectors"]).reshape(len(row["anchors"]), row["width"])
                turned = rotate(vectors)
                for i, key in enumerate(row["anchors"]):
                    own = np.arange(np.searchsorted(rows.labels, row["a_labels"][i], "left"), np.searchsorted(rows.labels, row["a_labels"][i], "right"))
                    own = own[rows.ids[own] != row["a_ids"][i]]
                    if not len(own):
                        continue
                    scores, ids = known.get(key, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    floor = _kth(scores, k)

                    def cut(low: np.ndarray, high: np.ndarray, floor: float = floor) -> np.ndarray:
                        return high >= max(floor, _kth(low, k))

                    near, exact = rows.search(Asked(turned[i]), vectors[i], own, cut)
                    scores, ids = np.r_[scores, exact], np.r_[ids, rows.ids[near]]
                    best = _best(scores, ids, k)
                    known[key] = scores[best], ids[best]
        yield from _emit([(key, 0, *found) for key, found in known.items()])

    return run


def _emit(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        sizes = [len(s) for _, _, s, _ in part]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([a for a, *_ in part], sizes), pa.int64()), pa.array(np.repeat([j for _, j, *_ in part], sizes), pa.int64()),
            pa.array(np.concatenate([i for *_, i in part]), pa.int64()), pa.array(np.concatenate([s for _, _, s, _ in part]), pa.int64()),
        ], names=_FOUND.names)


# --- negatives -----------------------------------------------------------------------------------------


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """Smallest and largest score s with ``least * positive <= 100 * s <= most * positive``."""
    return -((-least * positive) // 100), (most * positive) // 100


def _find_negatives(k: int, least: int, most: int):
    """Of each meeting the k best rows of other labels inside the window of each positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in (r for r in batch.to_pylist() if r["width"] == r["a_width"]):
                rows = _Rows(row)
                vectors = np.frombuffer(row["a_vectors"]).reshape(len(row["anchors"]), row["width"])
                turned = rotate(vectors)
                for i, key in enumerate(row["anchors"]):
                    spans = [(slot, *window(score, least, most)) for slot, score in enumerate(row["a_scores"][i])]
                    spans = [(slot, low, high) for slot, low, high in spans if low <= high]
                    others = np.flatnonzero((rows.labels != row["a_labels"][i]) & (rows.ids != row["a_ids"][i]))
                    if not spans or not len(others):
                        continue
                    floors = [max(low, _kth(known[key, slot][0], k)) if (key, slot) in known else low for slot, low, _ in spans]

                    def cut(low: np.ndarray, high: np.ndarray, spans=spans, floors=floors) -> np.ndarray:
                        kept = np.zeros(len(low), bool)
                        for (_, first, last), floor in zip(spans, floors):
                            inside = low[(low >= first) & (high <= last)]
                            kept |= (high >= max(floor, _kth(inside, k))) & (low <= last)
                        return kept

                    near, exact = rows.search(Asked(turned[i]), vectors[i], others, cut)
                    for slot, first, last in spans:
                        fits = np.flatnonzero((exact >= first) & (exact <= last))
                        if len(fits):
                            scores, ids = known.get((key, slot), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                            scores, ids = np.r_[scores, exact[fits]], np.r_[ids, rows.ids[near[fits]]]
                            best = _best(scores, ids, k)
                            known[key, slot] = scores[best], ids[best]
        yield from _emit([(*key, *found) for key, found in known.items()])

    return run


# --- the operator --------------------------------------------------------------------------------------


def _pack_anchors(anchors: DataFrame, size: int) -> DataFrame:
    """Blocks of anchors of one width; ``scores`` travels along as a list per anchor."""
    schema = T.StructType([
        T.StructField("a_width", T.IntegerType()), T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("a_ids", T.ArrayType(T.LongType())),
        T.StructField("a_labels", T.ArrayType(T.LongType())), T.StructField("a_vectors", T.BinaryType()), T.StructField("a_scores", T.ArrayType(T.ArrayType(T.LongType()))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, widths = _matrix(batch.column("vector"))
            starts = np.cumsum(widths) - widths
            plain = {c: batch.column(c).to_pylist() for c in ("anchor", "id", "label", "scores")}
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), size):
                    part = own[at : at + size]
                    vectors = flat[starts[part][:, None] + np.arange(width)] if width else np.zeros((len(part), 0))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(width)], pa.int32()), *[pa.array([[plain[c][j] for j in part]], pa.list_(pa.int64())) for c in ("anchor", "id", "label")],
                        pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary()), pa.array([[plain["scores"][j] for j in part]], pa.list_(pa.list_(pa.int64()))),
                    ], names=schema.names)

    return anchors.select("anchor", "id", "label", "vector", "scores").mapInArrow(run, schema)


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> Column:
    """Components as floor(scale * x), in doubles; null unless every component is there and finite."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return F.when(fine, F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``rows`` has ``id`` and ``label`` (numbers) and ``vector`` (whole numbers as doubles); ``is_anchor`` is a condition on
    these. An anchor's positives are its first ``positives`` rows of another id and the same label; each gets the first
    ``negatives`` rows of other labels with ``least * positive_score <= 100 * score <= most * positive_score``. Higher scores
    come first, equal ones by smaller id. A positive without such rows gives none.

    Rows with a null in any of the three columns take no part. Rows that repeat an id each count, and tie; none is "other"
    to an anchor of that id, and equal anchors are asked once. Vectors of different lengths do not meet; empty ones score 0.
    An empty table, or one without anchors, gives no rows. A score must fit into 64 bits. Other columns are not read.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    whole = stage(whole.where("id is not null and label is not null and vector is not null"), "negatives-rows")
    anchors = whole.where(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = stage(anchors.withColumn("scores", F.array().cast("array<bigint>")), "negatives-anchors")
    # blocks of the index are large and few: they are dealt out evenly, so that no task holds many
    blocks = stage(whole.select("id", "label", "vector").mapInArrow(_pack_rows(ROW_BLOCK), _ROWS).repartition(parts), "negatives-blocks")

    def meet(asked: DataFrame, run) -> DataFrame:
        packed = stage(_pack_anchors(asked, ANCHOR_BLOCK), "negatives-asked")
        # a stated set of queries against all rows, in blocks
        return blocks.crossJoin(packed).mapInArrow(run, _FOUND)

    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "other"))
    best = meet(anchors, _find_positives(positives)).withColumn("place", place).where(F.col("place") <= positives)
    best = stage(best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score"))).alias("found")), "negatives-positives")
    asked = anchors.drop("scores").join(best, "anchor").withColumn("scores", F.col("found.score"))
    asked = stage(asked, "negatives-windows")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other"))
    hard = meet(asked, _find_negatives(negatives, least, most)).withColumn("rank", rank).where(F.col("rank") <= negatives)
    positive = F.get("found", F.col("slot").cast("int"))
    return hard.join(asked.select("anchor", "id", "found"), "anchor").select(
        F.col("id").alias("anchor_id"), positive["other"].alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
