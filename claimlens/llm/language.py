"""Language identification by Bayesian fusion: text, declared language, and what a document's host usually writes.

The text gives a likelihood per language: naive Bayes over hashed trigrams of letters, fitted on a bounded sample of
labelled rows. All documents whose text alone is clear are then counted by grouped aggregation: by declared language,
which gives the chance of a declaration under each language, and by host, which gives priors. A host's prior is
smoothed towards its domain's, that towards the address suffix's, and that towards the whole corpus.

One more hypothesis stands beside the languages: *another* one, or none. Under it each trigram has the chance 2 ** BACKGROUND.
Texts of the fitted languages lie well above that, texts of unknown languages and random letters below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes, stage

BUCKETS = 1 << 16
# Bounds of the labelled sample that the text model is fitted on: rows in equal parts for all labels, rows that any label
# may have even so, and characters of each row.
SAMPLE_ROWS, LABEL_ROWS, SAMPLE_CHARS = 4000, 50, 20_000
# Trigrams overlap; each letter counts in three of them.
OVERLAP = 3.0
CLEAR = 0.99  # posterior of the text alone from which a document is counted
STRENGTH = 20.0  # documents that the level above counts for
LEAST_POSTERIOR = 0.5
BACKGROUND = -15  # log2 of a trigram's chance in a text of no known language
# Labels that are modelled: those with the most different texts. Texts of rarer ones are texts of another language.
MOST_LABELS = 256
OTHER = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # log chance of a bucket, by language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point itself if it is a letter or mark of one, else a blank."""
    import unicodedata

    codes = np.arange(0x110000, dtype=np.uint32)
    keep = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    return np.where(keep, codes, np.uint32(32))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams around a letter, and the number of the text each belongs to, from 1."""
    joined = "\n" + "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    plain, text = _letters()[codes].astype(np.uint64), np.cumsum(codes == 10)
    h = plain[:-2] * np.uint64(0x9E3779B97F4A7C15) + plain[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + plain[2:] * np.uint64(0x165667B19E3779F9)
    inside = plain[1:-1] != 32
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48))[inside].astype(np.int64), text[1:-1][inside]


def code_of(column: Column) -> Column:
    """A language code without region, in lower case."""
    return F.lower(F.element_at(F.split(column, "[-_]"), 1))


def fit(labelled: DataFrame, text: str, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fits on different texts of every label, at most ``rows`` over the number of labels or LABEL_ROWS of each, if that is more.

    Of each label those with the least hashes are taken, and ``chars`` characters of each. Different texts are counted
    per label over all rows; the hash below which a label's texts are taken follows, with five per cent to spare, so
    tasks send the driver nothing but the sample. Labels are read as declarations are: ``EN`` and ``en-US`` are ``en``. Up to
    MOST_LABELS labels no label is too rare to be known; beyond, those with the most texts are (of equals the first by
    code), and the others are unknown languages. Rows without text or label are left out. Without any labelled row there
    is one language, ``und``, and no other hypothesis.
    """
    known = labelled.select(code_of(F.col(label)).alias("label"), F.col(text).alias("text")).where("label <> '' and text is not null")
    known = known.withColumn("hash", F.xxhash64("text"))
    counted = known.select("label", "hash").distinct().groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in counted.orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()}
    each = max(LABEL_ROWS, rows // max(1, len(sizes)))
    cuts = {k: 2**63 - 1 if n <= each else int(0.95 * each / n * 2**64) - 2**63 - 1 for k, n in sizes.items()}
    found: dict[str, list[str]] = {}
    if cuts:
        below = F.create_map(*[x for k, cut in cuts.items() for x in (F.lit(k), F.lit(cut).cast("long"))])
        taken = known.where(F.col("hash") <= F.element_at(below, F.col("label"))).select("label", "hash", F.left("text", F.lit(chars)).alias("text"))
        for r in sorted(taken.distinct().collect(), key=lambda r: (r["label"], r["hash"], r["text"])):
            found.setdefault(r["label"], []).append(r["text"])
    languages = tuple(sorted(found)) or ("und",)
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for k, language in enumerate(languages):
        texts = found.get(language, [])[:each]
        for at in range(0, len(texts), 100):
            counts[:, k] += np.bincount(_grams(texts[at : at + 100])[0], minlength=BUCKETS)
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def hypotheses(model: LanguageModel) -> tuple[str, ...]:
    """The languages, and ``und`` for any other."""
    return model.languages if model.languages == (OTHER,) else (*model.languages, OTHER)


def _text_evidence(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Replaces text by likelihood array<double> (log, shifted so that the best is 0), letters long, clear int (place or null)."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    fields = [T.StructField("likelihood", T.ArrayType(T.DoubleType())), T.StructField("letters", T.LongType()), T.StructField("clear", T.IntegerType())]
    shared, other = rows.sparkSession.sparkContext.broadcast(model.table), len(hypotheses(model)) - len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        width = table.shape[1] + other
        for batch in by_bytes(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            buckets, owner = _grams(texts)
            score = np.zeros((len(texts), width))
            letters = np.bincount(owner - 1, minlength=len(texts))[: len(texts)]
            for k in range(table.shape[1]):
                score[:, k] = np.bincount(owner - 1, weights=table[:, k][buckets], minlength=len(texts))[: len(texts)] / OVERLAP
            if other:
                score[:, -1] = letters * (BACKGROUND * np.log(2)) / OVERLAP
            score -= score.max(axis=1, keepdims=True)
            chance = np.exp(score)
            sure = (chance.max(axis=1) / chance.sum(axis=1) >= CLEAR) & (letters > 0)
            clear = pa.array(score.argmax(axis=1).astype(np.int32), mask=~sure)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, score.size + 1, width), pa.int32()), pa.array(score.ravel()))
            columns = [*[batch.column(f.name) for f in kept], lists, pa.array(letters), clear]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (*kept, *fields)])

    return rows.mapInArrow(run, T.StructType([*kept, *fields]))


def _counts(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """Per key: clear documents and their numbers by language as array<double> ``n``."""
    each = [F.coalesce(F.sum(F.when(F.col("clear") == k, F.col("docs"))), F.lit(0)).cast("double") for k in range(width)]
    return rows.groupBy(*by).agg(F.array(*each).alias("n"))


def _smoothed(n: str, above: Column | str) -> Column:
    return F.expr(f"zip_with({n}, {above}, (c, p) -> (c + {STRENGTH}D * p) / (aggregate({n}, 0D, (s, x) -> s + x) + {STRENGTH}D))")


def identify(rows: DataFrame, model: LanguageModel, least: float = LEAST_POSTERIOR) -> DataFrame:
    """Replaces text by language, posterior, text_language and accepted in rows of (text, declared, host) and further columns.

    ``declared`` is a language code of the markup or catalogue, ``host`` a host name or the name of a source; both may
    be null, which is no evidence. Its last label is the address suffix, its last two the domain. A text is accepted if
    it has a letter and its best hypothesis is a language with a posterior of ``least`` or more. Without any letter, as for
    a null or empty text, and where another language is the best hypothesis, the language is ``und`` and the row not
    accepted. Likelihoods that are equal go to the language first in order of code. Rows are never dropped; repeated rows
    are rows of their own; an empty table stays empty. Further columns keep their values whatever their names, but for
    those with the names of the four added ones.
    """
    names_of, user = hypotheses(model), [c for c in rows.columns if c not in ("text", "language", "posterior", "text_language", "accepted")]
    width = len(names_of)
    rows = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in user]).alias("row"), "text", "host", code_of(F.col("declared")).alias("said"),
        F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"),
    )
    rows = stage(_text_evidence(rows, model), "language")
    clear = rows.where("clear is not null")
    hosts = stage(clear.groupBy("suffix", "domain", "host", "clear").agg(F.count("*").alias("docs")), "language-hosts")
    total = _counts(hosts, [], width).first()["n"]
    corpus = [(c + 1) / (sum(total) + width) for c in total]
    prior = F.array(*[F.lit(p) for p in corpus])
    chain = _counts(hosts.where("host is not null"), ["suffix"], width).select("suffix", F.col("n").alias("ns"))
    chain = chain.withColumn("ps", _smoothed("ns", f"array({', '.join(f'{p!r}D' for p in corpus)})")).select("suffix", "ps")
    domains = _counts(hosts.where("host is not null"), ["suffix", "domain"], width).join(chain, "suffix")
    domains = domains.select("suffix", "domain", _smoothed("n", "ps").alias("pd"))
    own = _counts(hosts.where("host is not null"), ["suffix", "domain", "host"], width).join(domains, ["suffix", "domain"])
    own = stage(own.select("host", _smoothed("n", "pd").alias("prior")), "language-priors")
    said = _counts(clear.where("said is not null").groupBy("said", "clear").agg(F.count("*").alias("docs")), ["said"], width)
    said = stage(said, "language-declared")
    kinds = said.count()
    sums = said.agg(F.array(*[F.coalesce(F.sum(F.col("n")[k]), F.lit(0.0)) for k in range(width)]).alias("t")).first()["t"]
    chance = F.expr(f"zip_with(n, array({', '.join(f'{t!r}D' for t in sums)}), (c, t) -> (c + 1D) / (t + {kinds + 1}D))")
    said = said.select("said", chance.alias("declaration"))
    joined = rows.join(own, "host", "left").join(said, "said", "left")
    logs = F.expr("zip_with(likelihood, prior, (l, p) -> l + ln(p))")
    joined = joined.withColumn("prior", F.coalesce("prior", prior)).withColumn("logs", logs)
    joined = joined.withColumn("logs", F.when(F.col("declaration").isNull(), F.col("logs")).otherwise(F.expr("zip_with(logs, declaration, (l, p) -> l + ln(p))")))
    top = F.array_max("logs")
    joined = joined.withColumn("posterior", 1 / F.expr("aggregate(transform(logs, l -> exp(l - array_max(logs))), 0D, (s, x) -> s + x)"))
    names = F.array(*[F.lit(x) for x in names_of])
    best = F.element_at(names, F.array_position("logs", top).cast("int"))
    some = F.col("letters") > 0
    text = F.element_at(names, F.array_position("likelihood", F.array_max("likelihood")).cast("int"))
    known = F.lit(True) if names_of == (OTHER,) else best != OTHER
    return joined.select(
        "row.*", F.when(some, best).otherwise(OTHER).alias("language"), F.when(some, F.col("posterior")).otherwise(0.0).alias("posterior"),
        F.when(some, text).otherwise(OTHER).alias("text_language"), (some & known & (F.col("posterior") >= least)).alias("accepted"),
    )
