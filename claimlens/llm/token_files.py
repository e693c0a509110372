"""Token ids as Parquet files: one list of ids per document, in order of doc_id, with row groups and page indexes.

A folder holds ``part-*.parquet`` files with the columns

    part int, doc_id, before long, n_tokens long, ids list<int>

in ascending order of doc_id over all parts and inside each file. ``before`` counts the ids of the earlier documents of
the same part; the ids of all earlier parts come from one aggregate over ``part`` and ``n_tokens`` alone. The ids are
dictionary-encoded (a vocabulary's ids are few), the three counters delta-encoded; every file has Parquet's column and
offset indexes, so a reader that wants a range of doc_ids, or only counters, skips all other pages.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes, utf8
from claimlens.llm.phrases import Rolling

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
# Units a Python worker remembers the ids of, twice over. It changes time and memory, not results.
REMEMBERED = 500_000
# Text encoded at once.
BATCH_BYTES = 4 << 20
# Marks that a tokenizer of words cuts off behind letters, whatever they are.
MARKS = b".,;:!?*$%&#|"

_SPACE, _MARK, _LETTER = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\x0b\x0c\r", MARKS, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_encoders: dict[str, "WordEncoder"] = {}


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)


def same_bytes(one: np.ndarray, begin: np.ndarray, length: np.ndarray, two: np.ndarray, begin_two: np.ndarray, length_two: np.ndarray) -> np.ndarray:
    """Whether each string of the first array equals its partner in the second, byte by byte."""
    same = length == length_two
    k = np.flatnonzero(same & (length > 0))
    for at in range(0, len(k), 1 << 16):
        part = k[at : at + (1 << 16)]
        differs = one[_spread(begin[part], length[part])] != two[_spread(begin_two[part], length[part])]
        starts = np.cumsum(length[part]) - length[part]
        same[part] = ~np.logical_or.reduceat(differs, starts)
    return same


class _Known:
    """Ids of units: their hashes in ascending order with places, and the ids and bytes of all places one after the other."""

    def __init__(self):
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.bytes, self.begins = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place of each unit; -1: its hash is new; -2: its hash is another unit's."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, self.places[at], -1)
        met = np.flatnonzero(out >= 0)
        own = out[met]
        same = same_bytes(data, begin[met], length[met], self.bytes, self.begins[own], self.begins[own + 1] - self.begins[own])
        out[met[~same]] = -2
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """New units: their hashes, the ids of all of them, how many each has, and their bytes."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.places = np.insert(self.places, at, len(self.hashes) + order)
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(lengths, dtype=np.int64)]
        self.ids = np.r_[self.ids, ids]
        self.begins = np.r_[self.begins, len(self.bytes) + np.cumsum(length, dtype=np.int64)]
        self.bytes = np.r_[self.bytes, data[_spread(begin, length)]]

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the places one after the other, and how many each has."""
        first, n = self.starts[places], self.starts[places + 1] - self.starts[places]
        return self.ids[_spread(first, n)], n


def units_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the units of all texts, and whether a unit is known to be letters only.

    A unit is a word (a run without ASCII white space), or the letters of a word, or the marks behind them.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    inside = ~_SPACE[data]
    begin = np.flatnonzero(inside & (np.r_[False, ~inside[:-1]] | edge[:-1]))
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    letter = _LETTER[data]
    two = np.flatnonzero(data[:-1] == 0xC3)  # Latin letters of two bytes, all but the signs of times and division
    two = two[~np.isin(data[two + 1], (0x97, 0xB7))]
    letter[two], letter[two + 1] = True, True
    place = np.where(_MARK[data], np.int64(-1), np.arange(n))
    core = np.maximum(np.maximum.accumulate(place)[end - 1] + 1, begin) if n else end
    odd = np.r_[0, np.cumsum(~letter)]
    pure = (odd[core] == odd[begin]) & (core > begin)
    cut = pure & (core < end)
    into = np.arange(len(begin)) + np.cumsum(cut) - cut
    begins, ends, letters = (np.zeros(len(begin) + int(cut.sum()), kind) for kind in (np.int64, np.int64, bool))
    begins[into], ends[into], letters[into] = begin, np.where(cut, core, end), pure
    begins[into[cut] + 1], ends[into[cut] + 1] = core[cut], end[cut]
    return begins, ends, letters


class WordEncoder:
    """Ids of whole texts, encoding each distinct unit once.

    Only for tokenizers whose ids of a text are those of its words one after the other: their pre-tokenizer drops white
    space and cuts letters from other signs, the last token of a run of letters is one that ends words, and no added
    token contains white space, strips or needs neighbours. Units are told apart by hashes of 64 bits. Those last used
    long ago are forgotten, a whole generation at a time.
    """

    def __init__(self, text: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_str(text), json.loads(text)
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]])
        self.lowers = {"type": "Lowercase"} in steps
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.remembered = remembered
        self.young, self.old = _Known(), _Known()

    def _singly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, many in one call: their ids are told apart by the tokens that end words."""
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            own = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends_word[own]) + 1
            n = np.diff(ends, prepend=0)
            if len(ends) != len(part):
                own, n = self._singly(part)
            ids.append(own)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _joined(self, raw: bytes, begins: np.ndarray, ends: np.ndarray, alone: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, some of which are encoded by themselves."""
        own, own_n = self._singly([raw[a:b] for a, b in zip(begins[alone].tolist(), ends[alone].tolist())])
        known, known_n = self.young.gather(places[~alone])
        n = np.zeros(len(places), np.int64)
        n[alone], n[~alone] = own_n, known_n
        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int32)
        out[_spread(begin[alone], own_n)], out[_spread(begin[~alone], known_n)] = own, known
        return out, n

    def _lowered(self, raw: bytes, at: np.ndarray) -> bytes:
        """A-Z lower-cased, as the tokenizer does it, but not where that would make an added token."""
        low = raw.lower()
        if any(a in low for a in self.added):
            texts = [(low[a:b], raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            return b"".join(own if any(a in text for a in self.added) else text for text, own in texts)
        return low

    def encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie in ``data`` between the n + 1 offsets ``at``, each with ``end`` appended, and the
        n + 1 offsets of the texts in the ids."""
        raw = data.tobytes()
        raw = self._lowered(raw, at) if self.lowers else raw
        data = np.frombuffer(raw, np.uint8)
        begins, ends, letters = units_of(data, at)
        sizes = ends - begins
        hashes, first, of = np.unique(Rolling(data)(0, begins, ends), return_index=True, return_inverse=True)
        # a hash only proposes: whoever has other bytes than the first unit or the known one of its hash is encoded by itself
        alone = ~same_bytes(data, begins, sizes, data, begins[first[of]], sizes[first[of]])
        if len(self.young.hashes) > self.remembered:
            self.old, self.young = self.young, _Known()
        where = data, begins[first], sizes[first]
        places = self.young.find(hashes, *where)
        missing = np.flatnonzero(places == -1)
        before = self.old.find(hashes[missing], data, begins[first[missing]], sizes[first[missing]])
        again = before >= 0
        new = missing[~again]
        pure = letters[first[new]]
        groups = [(missing[again], *self.old.gather(before[again]))]
        for which, encode in ((new[pure], self._runs), (new[~pure], self._singly)):
            k = first[which]
            groups.append((which, *encode([raw[a:b] for a, b in zip(begins[k].tolist(), ends[k].tolist())])))
        if len(missing):
            who = np.concatenate([g[0] for g in groups])
            self.young.add(hashes[who], np.concatenate([g[1] for g in groups]), np.concatenate([g[2] for g in groups]), data, begins[first[who]], sizes[first[who]])
            places = self.young.find(hashes, *where)
        alone |= places[of] < 0
        ids, n = self._joined(raw, begins, ends, alone, places[of]) if alone.any() else self.young.gather(places[of])
        starts = np.r_[0, np.cumsum(n)][np.searchsorted(begins, at, "left")] + np.arange(len(at))
        out = np.full(int(starts[-1]), end, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1), np.diff(starts) - 1)] = ids
        return out, starts


def _encoder(text: str) -> WordEncoder:
    key = md5(text.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(text)
    return _encoders[key]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the token files of (doc_id, text) under ``path``; ``tokenizer`` is the JSON text of its file.

    Texts are encoded whole; a null text is empty and gives the end id alone. A null doc_id comes last, rows with the
    same doc_id follow each other in any order. An empty table writes a folder without ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(shared.value), 0
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            ids, starts = encoder.encode(*utf8(batch.column("text")), end_id)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            columns = [batch.column("part"), batch.column("doc_id"), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "before", "n_tokens", "ids"])
            before += int(starts[-1])

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ranged = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    writer = ranged.mapInArrow(encode, schema).write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
    for name in ("part", "doc_id", "before", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids) of the files; without ``ids`` selected, its pages are not read."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    joined = files.join(F.broadcast(bases), "part")  # one row per written file
    return joined.select("part", "doc_id", (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids")


def with_crc32(spans: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ids_crc32: the unsigned CRC-32 of a document's ids as little-endian 32-bit integers."""
    fields = [f for f in spans.schema.fields if f.name != "ids"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(crc, pa.int64())], names=[*[f.name for f in fields], "ids_crc32"])

    return spans.mapInArrow(sums, T.StructType([*fields, T.StructField("ids_crc32", T.LongType())]))
