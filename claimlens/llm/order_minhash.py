"""Order MinHash fingerprints of documents and of edited texts, with DataFrame operations only.

A text is cut into tokens at white space; a token of more than 64 bytes is cut into pieces of 16 signs, so that text
without blanks has several. Its k-mers are K tokens in a row, each numbered by how often it occurred before. A hash of k-mer and number decides
which are the least, and deals numbered k-mers into ranges. Each component has an order of its own of all ranges, takes
the least numbered k-mer of each of the first two ranges that hold one, keeps the two in the order of the text, and
hashes the pair. So it changes with what the text holds, and with the order in which it stands, however short it is.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import stage, total_bytes

BLANKS = "[\\x20\\x09-\\x0D]+"
LONG_TOKEN, PIECE = 64, 16
K = 3
COMPONENTS = 64
RANGES = 2 * COMPONENTS
SHARE = 4  # one task sorts the k-mers of so small a part of the text that a scan's task may read
MOST_PARTS = 100_000  # beyond, tasks hold more text and sort it in spills
_KEY = ["id", "hash"]
_ORDER = ["missing", "id", "hash"]
_PLACES = (1 << 30) - 1  # a text of 2 GB has fewer tokens


def _orders() -> list[list[int]]:
    """Per component its order of the ranges: two of its own, then all others in a drawn but fixed order."""
    rng = random.Random(64)
    rest = [[r for r in range(RANGES) if r // 2 != c] for c in range(COMPONENTS)]
    return [[2 * c, 2 * c + 1, *rng.sample(others, len(others))] for c, others in enumerate(rest)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, hash) name a document by doc_id and text, without nulls; ``missing`` tells that there is no doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    zero = F.lit("" if kind == "string" else 0).cast(kind)
    text, missing = F.coalesce("text", F.lit("")), F.col("doc_id").isNull()
    return docs.select(
        missing.alias("missing"), F.coalesce("doc_id", zero).alias("id"), F.xxhash64(text, F.when(missing, F.lit(1))).alias("hash"), text.alias("text"),
    )


def _following(keyed: DataFrame) -> DataFrame:
    """Per document its key, n_chars, rows and the key of the next document as struct ``next``; the last is followed by the first.

    Documents are put in order by ranges; a window looks ahead inside a range, and the few first rows of the ranges,
    one per range, say what follows its last row.
    """
    light = keyed.groupBy(*_ORDER, F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("rows"))
    ranged = light.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "document-order")
    key = F.struct(*_ORDER)
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    start = firsts.agg(F.min("first")).select(F.col("min(first)").alias("start"))
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after")).join(F.broadcast(start))
    ahead = ranged.withColumn("ahead", F.lead(key).over(Window.partitionBy("part").orderBy(*_ORDER)))
    joined = ahead.join(F.broadcast(after), "part")
    return stage(joined.select(*_ORDER, "n_chars", "rows", F.coalesce("ahead", "after", "start").alias("next")), "document-next")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _hashes(tokens: str) -> Column:
    """Hash of each token, or of the pieces of a long one."""
    pieces = F.flatten(F.transform(tokens, lambda x: F.when(
        F.octet_length(x) > LONG_TOKEN, F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array(x))))
    cut = F.when(F.exists(tokens, lambda x: F.octet_length(x) > LONG_TOKEN), pieces).otherwise(F.col(tokens))
    return F.transform(cut, lambda x: F.xxhash64(x))


def _kmers(texts: DataFrame) -> DataFrame:
    """Rows (id, hash, kmer, packed) of the k-mers of a text and its edited text.

    ``packed`` holds the number of the k-mer, its place in its text, and two bits: in the text, in the edited text. Both
    texts begin alike; the k-mers of what they share are rows of both. Then come those of the text alone, then those
    of the edited text alone, so a running number tells how often a k-mer occurred before in either.
    """
    start = F.split(F.expr("left(text, keep)"), BLANKS)  # its last token may go on
    cut = texts.select(*_KEY, "text", "keep", "head", start.alias("start")).select(
        *_KEY, F.array_remove(F.slice("start", F.lit(1), F.size("start") - 1), "").alias("both"),
        _tokens(F.concat(F.element_at("start", -1), F.expr("substring(text, keep + 1)"))).alias("own"),
        _tokens(F.concat(F.element_at("start", -1), "head")).alias("other"),
    )
    cut = cut.select(*_KEY, *[_hashes(c).alias(c) for c in ("both", "own", "other")])

    def padded(c: str) -> Column:
        """A text of fewer than K tokens is one k-mer."""
        n = F.size("both") + F.size(c)
        return F.when((n > 0) & (n < K), F.concat(c, F.array_repeat(F.lit(0).cast("long"), F.lit(K) - n))).otherwise(F.col(c))

    whole = cut.select(*_KEY, "both", padded("own").alias("own"), padded("other").alias("other"))
    shared = F.greatest(F.lit(0), F.size("both") - (K - 1))
    again = F.slice("both", shared + 1, F.lit(K - 1))  # the edited text's own k-mers begin with these tokens
    whole = whole.select(*_KEY, shared.alias("shared"), (F.size("both") + F.size("own")).alias("n"), F.concat("both", "own", again, "other").alias("all"))
    hashed = ", ".join(f"all[i + {j}]" for j in range(K))
    kmers = F.expr(f"if(size(all) < {K}, array(), transform(sequence(0, size(all) - {K}), i -> xxhash64({hashed})))")
    each = whole.select(*_KEY, "shared", "n", F.posexplode(kmers).alias("p", "kmer")).where(f"p + {K} <= n or p >= n")
    mine = F.col("p") < F.col("n")
    place = F.when(mine, F.col("p")).otherwise(F.col("p") - F.col("n") + F.col("shared"))
    flags = F.when(~mine, 1).when(F.col("p") < F.col("shared"), 3).otherwise(2)
    packed = F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.shiftleft(F.least(place, F.lit(_PLACES)).cast("long"), 2)).bitwiseOR(flags.cast("long"))
    return each.select(*_KEY, "kmer", packed.alias("packed"))


def _signatures(texts: DataFrame) -> DataFrame:
    """(id, hash, fingerprint, edited_fingerprint) of texts (id, hash, text, keep, head), one row per key with tokens."""
    in_order = Window.partitionBy("kmer", *_KEY).orderBy("packed")
    only_own = (F.col("packed").bitwiseAND(F.lit(3)) == 2).cast("int")
    each = _kmers(texts).select(
        *_KEY, "kmer", "packed", F.row_number().over(in_order).alias("number"),
        F.sum(only_own).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("skipped"))
    flags = F.col("packed").bitwiseAND(F.lit(3))
    # what both texts share comes first, so its k-mers have one number in both
    number = F.when(flags == 1, F.col("number") - F.col("skipped")).otherwise(F.col("number")).cast("long")
    each = each.select(
        *_KEY, (flags >= 2).alias("in_own"), (flags != 2).alias("in_other"),
        F.shiftright("packed", 2).bitwiseAND(F.lit(_PLACES)).alias("place"), F.xxhash64("kmer", number).alias("drawn"))
    drawn = F.col("drawn").bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.col("place"))
    cells = each.groupBy(*_KEY, F.pmod("drawn", F.lit(RANGES)).cast("int").alias("range")).agg(
        F.min(F.when(F.col("in_own"), drawn)).alias("own"), F.min(F.when(F.col("in_other"), drawn)).alias("other"))
    cells = cells.groupBy(*_KEY).agg(F.collect_list(F.struct("range", "own", "other")).alias("cells"))
    flat = "cast(split('" + ",".join(str(r) for order in _orders() for r in order) + "', ',') as array<int>)"

    def words(name: str) -> Column:
        """Per component a hash of its pair in the order of the text, as 16 bits that are not all zero; zero without k-mers."""
        held = f"map_from_entries(transform(cells, x -> struct(x.range, x.{name})))"
        least = f"transform(array({held}), m -> transform(sequence(0, {RANGES - 1}), r -> m[r]))"
        taken = f"""if(v[2 * c] IS NOT NULL AND v[2 * c + 1] IS NOT NULL, array(v[2 * c], v[2 * c + 1]),
            slice(filter(transform(slice(orders, {RANGES} * c + 1, {RANGES}), r -> v[r]), x -> x IS NOT NULL), 1, 2))"""
        ordered = f"(t[0] & {_PLACES}L) <= (t[1] & {_PLACES}L)"
        code = f"""CASE size(t) WHEN 0 THEN 0L WHEN 1 THEN pmod(xxhash64(shiftright(t[0], 30)), 65535L) + 1L
            ELSE pmod(if({ordered}, xxhash64(shiftright(t[0], 30), shiftright(t[1], 30)), xxhash64(shiftright(t[1], 30), shiftright(t[0], 30))), 65535L) + 1L END"""
        codes = f"transform({least}, v -> transform(transform(sequence(0, {COMPONENTS - 1}), c -> {taken}), t -> {code}))"
        packed = " | ".join(f"shiftleft(k[4 * w + {n}], {16 * n})" for n in range(4))
        return F.expr(f"transform({codes}, k -> transform(sequence(0, {COMPONENTS // 4 - 1}), w -> {packed}))[0]").alias(name)

    return cells.withColumn("orders", F.expr(flat)).select(*_KEY, words("own"), words("other"))


def text_of(words: str) -> Column:
    """A fingerprint as text: four hexadecimal digits for each component, ``0000`` for one without k-mers."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(words)[w]), 16, "0")) for w in range(COMPONENTS // 4)])


def _filled(word: str) -> str:
    """The lowest bit of each 16 bits of a word: whether any of the 16 is set."""
    for shift in (8, 4, 2, 1):
        word = f"transform(array({word}), w -> w | shiftrightunsigned(w, {shift}))[0]"
    return f"({word} & {0x0001000100010001}L)"


def likeness(a: str, b: str) -> Column:
    """Share of equal components among those that either fingerprint has; 1 if neither has any."""
    total = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count({2})), 0, (n, w) -> n + w)"
    same = total.format(a, b, f"{_filled('x')} & ~{_filled('(x ^ y)')}")
    some = total.format(a, b, _filled("(x | y)"))
    return F.expr(f"if({some} = 0, 1D, cast({same} as double) / {some})")


def _parts(docs: DataFrame, task_bytes: int | None) -> int:
    """Partitions by bytes of text: ``spark.sql.files.maxPartitionBytes`` over SHARE in each, unless given."""
    each = task_bytes or docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() // SHARE
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_PARTS, -(-total_bytes(docs, "text") // each)))


def fingerprints(docs: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Fingerprints of every row of (doc_id, text), of its edited text, and how alike they are.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next
    document in ascending doc_id, or all it has; the first document follows the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty; texts without tokens have a fingerprint without components, like only to another such one. A
    text of fewer than three tokens is one k-mer. Null doc_ids come last; documents with the same doc_id follow each
    other by hash of their text, and rows that are equal are one document in the order and as many rows in the result.
    One document is its own next. An empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs)
    n_parts = _parts(docs, task_bytes)
    order = _following(keyed)
    texts = keyed.repartition(n_parts, *_KEY).groupBy(*_KEY).agg(F.first("text").alias("text"))
    given = order.select(*[F.col(f"next.{c}").alias(c) for c in _KEY], *[F.col(c).alias(f"to_{c}") for c in _KEY], F.expr("n_chars div 2").cast("int").alias("half"))
    heads = texts.join(given, _KEY).select(*[F.col(f"to_{c}").alias(c) for c in _KEY], F.expr("left(text, half)").alias("head"))
    pairs = texts.join(heads, _KEY)
    pairs = pairs.select(*_KEY, "text", F.expr("cast(length(text) - length(text) div 2 as int)").alias("keep"), "head")
    edited = pairs.select(*_KEY, F.sha2(F.expr("concat(left(text, keep), head)"), 256).alias("edited_sha256"))
    none = F.array_repeat(F.lit(0).cast("long"), F.lit(COMPONENTS // 4))
    found = order.join(edited, _KEY).join(_signatures(pairs), _KEY, "left").select(
        *_ORDER, "n_chars", "rows", "next", "edited_sha256", F.coalesce("own", none).alias("own"), F.coalesce("other", none).alias("other"),
    )
    found = stage(found, "order-minhash")
    after = found.select(*[F.col(c).alias(f"next_{c}") for c in _KEY], F.col("own").alias("following"))
    for c in _KEY:
        found = found.withColumn(f"next_{c}", F.col(f"next.{c}"))
    joined = found.join(after, [f"next_{c}" for c in _KEY]).select(
        F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", text_of("own").alias("fingerprint"),
        text_of("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"), "rows",
    )
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "copy")
