"""Removal of byte strings that an earlier document has already, by prefix-free parsing.

The texts are parsed into phrases (see ``phrases``). The dictionary of phrases is put in order by ranges of the triggers'
hashes: there phrases with the same trigger lie together, sorted by content and place in the corpus, as the suffix
arrays of dictionary and parse would have them, but by hashed instead of literal order, since only equality counts.
That settles most of the text. Where different phrases share a trigger, single windows may still agree; these windows,
the suffixes inside such phrases, are put in order the same way.

Text is written once, in blocks of documents in order of doc_id, bucketed by block; what the ranges find comes back as
one byte per phrase or window of a block, so text is never shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes, total_bytes, utf8
from claimlens.llm.phrases import SPAN, Phrases, parse
from claimlens.session import scratch_path, scratch_table, stage

BLOCK_BYTES = 2 << 20
RANGE_BYTES = 32 << 20  # text whose phrases meet in one range
BUCKET_BYTES = 128 << 20  # text in a bucket of blocks
MOST_BUCKETS = 100_000  # as many as Spark's tables have by default; beyond, buckets hold more text
# Different phrases of a block under one trigger, up to which they are compared as phrases; beyond, as windows at once.
PHRASES_PER_TRIGGER = 16
REPEATED, OPEN = 1, 2

_KEYS = T.StructType([T.StructField("blk", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("one", T.BinaryType()), T.StructField("two", T.BinaryType())])
_STATES = T.StructType([T.StructField("blk", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("states", T.BinaryType())])


def _blocks(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """Blocks (blk, ids, sizes, data) of documents in order, bucketed by blk; their number of buckets, and all bytes.

    The number of buckets follows from the bytes of text, so that a task that reads one reads as much at every size.
    """
    spark, size = rows.sparkSession, total_bytes(rows, "text")
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("blk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("n_bytes", T.LongType()), T.StructField("data", T.BinaryType()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number, part = [], [], 0, 0, 0

        def row():
            columns = [[(part << 32) | number], [ids], [[len(t) for t in texts]], [size], [b"".join(texts)]]
            fields = [pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, fields)], names=schema.names)

        for batch in by_bytes(batches, "text"):
            id_type, part = batch.column("doc_id").type, batch.column("part")[0].as_py()
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if size >= block_bytes and doc != ids[-1]:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc)
                texts.append(raw[a:b])
                size += b - a
        if ids:
            yield row()

    order = F.col("doc_id").asc_nulls_last()
    ranged = rows.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order)
    packed = ranged.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(pack, schema)
    name = scratch_table(f"phrase_blocks_{uuid.uuid4().hex}")
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    writer = packed.write.bucketBy(buckets, "blk").option("path", scratch_path(spark, "phrase-blocks")).option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name), buckets, size


def _pack(values: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(raw: list[bytes], size: int) -> np.ndarray:
    joined = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size)
    out = np.zeros((len(joined), 8), np.uint8)
    out[:, :size] = joined
    return out.view("<u8").ravel()


def _keys(blk: int, one: np.ndarray, two: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Keys in ascending order of ``one``, dealt out by its highest bits."""
    target = ((one >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(target) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    two = two >> np.uint64(8)  # the lowest bit of a phrase's content is always set
    return pa.RecordBatch.from_arrays([
        pa.array([blk] * len(spans), pa.int64()), pa.array([int(target[a]) for a, _ in spans], pa.int32()),
        pa.array([_pack(one[a:b], 6) for a, b in spans], pa.binary()), pa.array([_pack(two[a:b], 7) for a, b in spans], pa.binary()),
    ], names=_KEYS.names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State of each key of a range: REPEATED if an earlier block has it, OPEN if only ``one`` occurs with another ``two``."""

    def settle(number: int, blks: list[int], ones: list[bytes], twos: list[bytes]) -> pa.RecordBatch:
        sizes = [len(x) // 6 for x in ones]
        one, two = _unpack(ones, 6), _unpack(twos, 7)
        order = np.lexsort((two, one))  # stable: blocks stay in order
        one, two = one[order], two[order]
        new_one = np.r_[True, one[1:] != one[:-1]]
        new = new_one | np.r_[True, two[1:] != two[:-1]]
        starts = np.flatnonzero(new_one)
        several = np.repeat(np.add.reduceat(new.astype(np.int64), starts) > 1, np.diff(np.r_[starts, len(one)]))
        states = np.zeros(len(order), np.uint8)
        states[order] = np.where(~new, REPEATED, np.where(several, OPEN, 0))
        cuts = np.r_[0, np.cumsum(sizes)].tolist()
        found = [states[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(blks, pa.int64()), pa.array([number] * len(blks), pa.int32()), pa.array(found, pa.binary())], names=_STATES.names)

    number, held = None, ([], [], [])
    for batch in batches:
        for key, *row in zip(batch.column("range").to_pylist(), batch.column("blk").to_pylist(), batch.column("one").to_pylist(), batch.column("two").to_pylist()):
            if key != number and held[0]:
                yield settle(number, *held)
                held = ([], [], [])
            number = key
            for into, value in zip(held, row):
                into.append(value)
    if held[0]:
        yield settle(number, *held)


def _states(keys: DataFrame, ranges: int, name: str) -> DataFrame:
    """One row per block: what the ranges found, in the order of the block's keys."""
    met = keys.repartition(ranges, "range").sortWithinPartitions("range", "blk").mapInArrow(_meet, _STATES)
    found = met.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("range", "states"))).alias("found"))
    return stage(found.select("blk", F.col("found.states").alias(name)), name)


class _Block:
    """Phrases of a block, which of them repeat inside it, and the keys that stand for them."""

    def __init__(self, ids: list, sizes: list[int], raw: bytes):
        self.data, self.at = np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        self.phrases: Phrases = parse(self.data, self.at)
        number = {doc: k for k, doc in enumerate(sorted(set(ids) - {None}))}
        number[None] = len(number)  # the largest; rows with the same doc_id do not count as earlier ones
        self.rank = np.array([number[doc] for doc in ids], np.int64)[self.phrases.doc]
        p = self.phrases
        self.order = np.lexsort((p.content, p.trigger))  # stable: phrases stay in order of the text, which is that of doc_id
        trigger, content, rank = p.trigger[self.order], p.content[self.order], self.rank[self.order]
        new_trigger = np.r_[True, trigger[1:] != trigger[:-1]][: len(trigger)]
        new = new_trigger | np.r_[True, content[1:] != content[:-1]][: len(trigger)]
        heads = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.repeated = rank > rank[heads][self.run] if len(heads) else np.zeros(0, bool)
        of = np.cumsum(new_trigger[heads]) - 1
        self.crowded = (np.bincount(of) > PHRASES_PER_TRIGGER)[of] if len(heads) else np.zeros(0, bool)
        sent = ~self.crowded | new_trigger[heads]
        self.key = np.cumsum(sent) - 1
        self.one = trigger[heads][sent]
        self.two = np.where(self.crowded, np.uint64(0), content[heads])[sent]

    def open_windows(self, states: np.ndarray):
        """Places of windows that phrases leave open, with the keys that stand for them.

        Returns places, the key of each, whether an earlier document of the block has it, and the keys' two hashes.
        """
        state = np.where(self.crowded, OPEN, states[self.key]) if len(self.key) else states
        self.settled = self.order[self.repeated | (state == REPEATED)[self.run]]
        left = np.sort(self.order[~self.repeated & (state == OPEN)[self.run]])
        place, phrase, one, two = self.phrases.windows(left, self.data)
        rank = self.rank[phrase]
        order = np.argsort(one, kind="stable")  # windows stay in order of the text
        place, one, two, rank = place[order], one[order], two[order], rank[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
        heads = np.flatnonzero(new)
        key = np.cumsum(new) - 1
        earlier = rank > rank[heads][key] if len(heads) else np.zeros(0, bool)
        return place, key, earlier, one[heads], two[heads]

    def removed(self, states: np.ndarray, window_states: np.ndarray) -> np.ndarray:
        """Per byte whether it goes."""
        place, key, earlier, _, _ = self.open_windows(states)
        gone = place[earlier | (window_states[key] == REPEATED)] if len(key) else place
        n = len(self.data) + 1
        begin = np.bincount(np.r_[self.phrases.first[self.settled], gone], minlength=n)
        end = np.bincount(np.r_[self.phrases.last[self.settled], gone] + SPAN, minlength=n)
        return np.cumsum(begin - end)[:-1] > 0


def _each_block(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            found = {name: np.frombuffer(b"".join(row[name].as_py() or []), np.uint8) for name in ("phrases", "windows") if name in row}
            ids = row["ids"].as_py()
            yield row["blk"].as_py(), ids, _Block(ids, row["sizes"].as_py(), row["data"].as_buffer().to_pybytes()), found


def dedup_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_bytes, spans and kept.

    A byte is removed if it lies in a string of 50 bytes that also starts in a document with a smaller doc_id; strings are
    those of the input, as UTF-8, and never cross documents. ``spans`` are the maximal removed runs as (begin, end) in
    bytes, ``kept`` the other bytes. A null text is empty; a null doc_id is larger than any other. Rows with the same
    doc_id remove nothing from each other; they are handled in one task. An empty table gives no rows; other columns
    are ignored. Strings count as equal if two hashes are: 56 bits of one, and of another 48 bits and the
    range that its highest bits fall into.
    """
    blocks, buckets, size = _blocks(docs, block_bytes)
    ranges = max(buckets, -(-size // RANGE_BYTES))

    def phrase_keys(batches):
        for blk, _, block, _ in _each_block(batches):
            yield _keys(blk, block.one, block.two, ranges)

    def window_keys(batches):
        for blk, _, block, found in _each_block(batches):
            *_, one, two = block.open_windows(found["phrases"])
            yield _keys(blk, one, two, ranges)

    kind = docs.schema["doc_id"].dataType
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for _, ids, block, found in _each_block(batches):
            gone, at = block.removed(found["phrases"], found["windows"]), block.at
            inner = np.zeros(len(gone) + 1, bool)
            inner[at[:-1][at[:-1] < len(gone)]] = True
            begin = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | inner[1:-1]][: len(gone)])
            end = np.flatnonzero(gone & np.r_[~gone[1:] | inner[1:-1], True][: len(gone)]) + 1
            first, last = np.searchsorted(begin, at[:-1], "left"), np.searchsorted(begin, at[1:], "left")
            kept, upto = block.data[~gone].tobytes(), np.r_[0, np.cumsum(~gone)][at].tolist()
            for a in range(0, len(ids), 2000):
                part = range(a, min(len(ids), a + 2000))
                runs = [[{"begin": int(x - at[k]), "end": int(y - at[k])} for x, y in zip(begin[first[k] : last[k]], end[first[k] : last[k]])] for k in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k in part], pa_kind), pa.array([int(at[k + 1] - at[k]) for k in part], pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([kept[upto[k] : upto[k + 1]] for k in part], pa.binary()),
                ], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)
    of_phrases = _states(blocks.drop("n_bytes").mapInArrow(phrase_keys, _KEYS), ranges, "phrases")
    with_phrases = blocks.drop("n_bytes").join(of_phrases, "blk", "left")
    of_windows = _states(with_phrases.mapInArrow(window_keys, _KEYS), ranges, "windows")
    return with_phrases.join(of_windows, "blk", "left").mapInArrow(cut, schema)
