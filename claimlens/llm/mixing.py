"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import WORD, pack_row, stage
from claimlens.llm.prefix import prefix_sums

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per source of (source, size): rank, source_size, weight, target.

    Sources are ranked by code point, null last, and weigh ``weights``, repeating. All weights together share the
    total size. A target stops at ``most_epochs`` times its source's size; the excess goes to the others by weight.
    That is a common level: target = min(cap, weight * level). The level is found from a few sums over the table of
    sources, which stays distributed; each round caps at least one more source or is the last.
    """
    sources = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = prefix_sums(
        sources.withColumns({"all": F.lit(0), "one": F.lit(1)}), "all", [F.col("source").asc_nulls_last()], "one", "mix-ranks"
    ).withColumnRenamed("before", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "rank", "source_size", weight.alias("weight")), "mix-weights")
    cap = F.col("source_size").cast("double") * most_epochs
    level, capped = 0.0, -1
    while True:
        above = cap < F.col("weight") * level if capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, cap).otherwise(0.0)).alias("caps"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(above).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        level, capped = ((row["total"] or 0) - row["caps"]) / row["free"], row["capped"]
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "", keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document of (doc_id, text, source) the mixture takes.

    Every row gets a hash-random key; rows are sorted by it within their source, and their sizes in words are summed
    up from the start of the source. The budget of a source is its target, rounded down. The mixture takes whole
    epochs of the source as often as they fit, then documents in the order of their keys; the document at the cut is
    taken up to its last word that fits, so a source's words add up to its budget exactly.

    Returns doc_id, source, size, source_size, weight, target, taken, and the columns named by ``keep``. Null texts and texts without words have size 0 and are never taken; a null source is a source of
    its own; null or repeated doc_ids are rows like any other (equal rows may swap places); an empty table gives an
    empty result. The key is an MD5 of ``seed`` and doc_id, so reruns agree. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", n_words().alias("size"), *keep)
    targets = source_targets(sized.select("source", "size"), weights, most_epochs)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sized.withColumns({"key": key, "tie": F.monotonically_increasing_id()})
    renamed = targets.withColumnRenamed("source", "name")
    placed = keyed.join(renamed, keyed["source"].eqNullSafe(renamed["name"])).drop("name")
    order = [F.col("key").asc(), F.col("doc_id").asc(), F.col("size").asc(), F.col("tie").asc()]
    summed = prefix_sums(placed, "rank", order, "size", "mix-rows")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return summed.select(
        "doc_id", "source", "size", "source_size", "weight", "target", (epochs * F.col("size") + last).alias("taken"),
        *keep,
    )


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "") -> DataFrame:
    """The documents of the mixture with the columns of ``docs``: a document taken in n epochs appears n times.

    The document at a source's cut appears once more with the words that still fit, joined by blanks (``n_chars``, if
    there is such a column, follows). Documents that the mixture takes no word of are left out; a very
    long text is cut at its source's budget like any other, inside one row.
    """
    rows = stage(pack_row(docs, "doc_id", "source", "text").withColumn("row_id", F.monotonically_increasing_id()), "mix-documents")
    decided = mix_sources(rows, weights, most_epochs, seed, keep=["row_id"]).where("taken > 0").select("row_id", "size", "taken")
    mixed = rows.select("row_id", "row").join(decided, "row_id")
    copies = F.array_repeat("row", F.expr("cast(taken div size as int)"))
    whole = mixed.where("taken >= size").select(F.explode(copies).alias("row"))
    part = mixed.where("taken % size > 0").withColumn("words", F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)))
    text = F.array_join(F.slice("words", F.lit(1), F.expr("cast(taken % size as int)")), " ")
    cut = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withField("n_chars", F.length(text).cast(kind))
    return whole.unionByName(part.select(cut.alias("row"))).select("row.*")
