"""Benchmark decontamination with DataFrame operations: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted shingle similarity.

A window of a document can be similar to an item only if both hold a common shingle. So windows as long as an item are
laid where a document has one of the item's shingles, with the shingle at its place in the item. Windows and items get
a SimHash of their shingles. Ten blocks of bits are looked up with up to one bit flipped each: two fingerprints within
19 bits agree in at least one block up to one bit, so no pair within the radius is missed. Candidates are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import WORD, stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 10


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingles(words: str, k: str) -> Column:
    """All shingles of an array of words, as strings; the whole sequence if it is shorter than ``k``."""
    return F.expr(
        f"transform(sequence(0, greatest(0, size({words}) - {k})), i -> array_join(slice({words}, i + 1, {k}), ' '))"
    )


def _simhash(shingles: str) -> Column:
    """Bit set if over half of the shingles' hashes have it."""
    return F.expr(f"""
        aggregate(sequence(0, 63), 0L, (code, bit) -> code | if(
            2 * aggregate(transform({shingles}, s -> shiftrightunsigned(xxhash64(s), bit) & 1L), 0L, (n, x) -> n + x) > size({shingles}),
            shiftleft(1L, bit), 0L))""")


def _blocks(radius: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [round(64 * b / blocks) for b in range(blocks + 1)]
    if radius // blocks > 1:
        raise ValueError("a block may differ in one bit at most: take more blocks or a smaller radius")
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _keys(code: str, radius: int, blocks: int, flipped: bool) -> Column:
    """Array of (block, value): the blocks of a fingerprint, and with ``flipped`` their neighbours at one bit."""
    keys = []
    for number, (low, width) in enumerate(_blocks(radius, blocks)):
        value = f"(shiftrightunsigned({code}, {low}) & {(1 << width) - 1}L)"
        flips = [0, *[1 << b for b in range(width)]] if flipped and radius >= blocks else [0]
        keys += [f"named_struct('block', {number}, 'value', {value} ^ {f}L)" for f in flips]
    return F.expr(f"array({', '.join(keys)})")


def _items(benchmark: DataFrame, words: int) -> DataFrame:
    """(item_id, n, k, shingles, code) of the items that have words; k is the shingle length, at most the item's."""
    items = benchmark.select("item_id", words_of("text").alias("words")).where("size(words) > 0").distinct()
    items = items.select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(words)).alias("k"))
    items = items.select("item_id", "n", "k", _shingles("words", "k").alias("shingles"))
    return items.withColumn("code", _simhash("shingles"))


def _places(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, n, start): where a shingle of ``k`` words puts a window of an item's ``n`` words."""
    wanted = items.where(F.col("k") == k).select("n", F.posexplode("shingles").alias("at", "shingle"))
    wanted = wanted.withColumn("w", F.split("shingle", " "))
    wanted = wanted.select(F.xxhash64(*[F.col("w")[j] for j in range(k)]).alias("h"), "n", "at").distinct()
    each = docs.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "word"))
    each = each.where(F.col("pos") + k <= F.size("words"))
    h = F.xxhash64("word", *[F.get("words", F.col("pos") + j) for j in range(1, k)])
    met = each.select("doc_id", "text_key", F.size("words").alias("size"), "pos", h.alias("h")).join(wanted, "h")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("size") - F.col("n")))
    return met.select("doc_id", "text_key", "n", start.alias("start")).distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    radius: int = RADIUS, blocks: int = BLOCKS,
) -> DataFrame:
    """(doc_id, text_key, item_id, n_words, start, hamming, similarity): documents that hold a benchmark item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Texts are lower-cased and
    cut into words; a shingle has ``words`` words, or all words of a shorter item. The similarity of a window and an
    item weighs each shingle by how often it occurs: sum of the lesser counts over sum of the greater. One row per
    document text and item, the most similar window, the first if several are. A window at a document's end is moved
    inwards; a shorter document is one window. ``text_key`` tells texts under the same doc_id apart.

    Null and empty texts hold nothing and items without words are not looked for. Null doc_ids are kept as they are.
    Empty tables give no rows. Windows with the same words are looked up and verified once, whatever their number. A text
    of any length is searched whole; its words are one row, as are each window's and item's.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of("text").alias("words"))
    items = stage(_items(benchmark, words), "benchmark")
    lengths = [r[0] for r in items.select("k").distinct().collect()]  # at most ``words`` values
    places = [_places(texts, items, k) for k in lengths] or [texts.selectExpr("doc_id", "text_key", "0 n", "0 start").limit(0)]
    found = places[0]
    for more in places[1:]:
        found = found.union(more)
    found = stage(found.distinct(), "windows")
    per_text = found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_list(F.struct("n", "start")).alias("at"))
    held = texts.join(per_text, texts["doc_id"].eqNullSafe(per_text["id"]) & (texts["text_key"] == per_text["key"]))
    windows = held.select("doc_id", "text_key", "words", F.explode("at").alias("x")).select(
        "doc_id", "text_key", F.col("x.n").alias("n"), F.col("x.start").alias("start"),
        F.array_join(F.slice("words", F.col("x.start") + 1, F.col("x.n")), " ").alias("passage"),
    )
    windows = stage(windows.distinct(), "passages")
    passages = windows.select("passage", "n").distinct().withColumn("w", F.split("passage", " ")).withColumn("k", F.least("n", F.lit(words)))
    passages = stage(passages.select("passage", "n", _shingles("w", "k").alias("own")).withColumn("fp", _simhash("own")), "fingerprints")
    keyed = passages.select("passage", "n", F.explode(_keys("fp", radius, blocks, False)).alias("key"))
    probes = items.select("item_id", "n", F.explode(_keys("code", radius, blocks, True)).alias("key"))
    pairs = keyed.join(probes, ["n", "key"]).select("passage", "n", "item_id").distinct()
    near = pairs.join(passages, ["passage", "n"]).join(items.select("item_id", "n", "shingles", "code"), ["item_id", "n"])
    near = near.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("code")))).where(F.col("hamming") <= radius)
    common = F.expr("""aggregate(transform(array_distinct(own), s -> least(
        size(filter(own, x -> x = s)), size(filter(shingles, x -> x = s)))), 0, (n, x) -> n + x)""")
    near = near.withColumn("common", common)
    score = F.col("common") / (F.size("own") + F.size("shingles") - F.col("common"))
    verified = stage(near.withColumn("similarity", score).where(F.col("similarity") >= similarity).select("passage", "n", "item_id", "hamming", "similarity"), "verified")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming", "n")).alias("best")
    return windows.join(verified, ["passage", "n"]).groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", F.col("best.n").alias("n_words"), (-F.col("best.back")).alias("start"),
        F.col("best.hamming").alias("hamming"), F.col("best.similarity").alias("similarity"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of ``docs``."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    bad = stage(bad, "contaminated")
    key = F.xxhash64(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (key == bad["key"]), "left_anti")
