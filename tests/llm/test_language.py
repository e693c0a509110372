import math
import random

import pytest
from pyspark.sql import functions as F

from claimlens.llm import language
from claimlens.llm.common import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    docs = read_table(spark, SF, "documents")
    return language.fit(docs.where("doc_id % 4 <> 0"), "text", "lang")


def test_held_out_accuracy_of_text_alone(spark, model):
    docs = read_table(spark, SF, "documents").where("doc_id % 4 = 0")
    rows = docs.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    got = language.identify(rows, model).collect()
    assert len(got) == docs.count()
    assert sum(r.language == r.lang for r in got) / len(got) > 0.96


def test_fusion_by_hand(spark, model):
    text = {k: next(r.text for r in read_table(spark, SF, "documents").where(F.col("lang") == k).limit(1).collect()) for k in model.languages}
    rows = [(i, text["de"], "de-AT", "a.x.example.at") for i in range(30)] + [(100 + i, text["en"], "de", "b.x.example.at") for i in range(3)]
    rows += [(200, "es", None, "a.x.example.at"), (201, "es", "DE", "a.x.example.at"), (202, None, "de", "a.x.example.at"), (203, " 1 2 ", None, None), (204, "", None, ""), (205, text["fr"], None, None), (206, "es", None, "new.host.at"), (207, text["fr"], "xx", "z"), (207, text["fr"], "xx", "z")]
    df = spark.createDataFrame([(*r, "own", "own", "mine") for r in rows], "id long, text string, declared string, host string, row string, prior string, domain string")
    got = {r.id: r for r in language.identify(df, model).collect()}
    assert len(got) == len(rows) - 1 and got[0].row == "own" and got[0].prior == "own" and got[0].domain == "mine"
    assert got[202].language == got[203].language == got[204].language == "und" and not got[202].accepted
    assert got[205].language == "fr" and got[205].accepted and got[100].language == "en"
    # counts of clear texts by hand: 30 de and 3 en on .at, 3 fr elsewhere; "es" alone is not clear
    names = language.hypotheses(model)
    width = len(names)
    n = {"de": 30, "en": 3, "fr": 3}
    corpus = [(n.get(x, 0) + 1) / (36 + width) for x in names]
    smooth = lambda c, above: [(c.get(x, 0) + 20 * p) / (sum(c.values()) + 20) for x, p in zip(names, above)]
    suffix = smooth({"de": 30, "en": 3}, corpus)
    domain = smooth({"de": 30, "en": 3}, suffix)
    prior = smooth({"de": 30}, domain)
    scores = language._grams(["es"])[0]
    like = [sum(float(model.table[b, k]) for b in scores) / 3 for k in range(width - 1)] + [len(scores) * language.BACKGROUND * math.log(2) / 3]
    logs = [x + math.log(p) for x, p in zip(like, prior)]
    best = max(range(width), key=lambda k: logs[k])
    assert got[200].language == names[best]
    assert abs(got[200].posterior - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-4
    said = {"de": 30 + 0, "en": 3}
    totals = {"de": 30, "en": 3, "fr": 2}
    logs = [x + math.log((said.get(k, 0) + 1) / (totals.get(k, 0) + 3)) for x, k in zip(logs, names)]
    best = max(range(width), key=lambda k: logs[k])
    assert got[201].language == names[best]
    assert abs(got[201].posterior - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-4


def test_empty_and_long(spark, model):
    none = spark.createDataFrame([], "text string, declared string, host string")
    assert language.identify(none, model).count() == 0
    assert language.fit(none, "text", "declared").languages == ("und",)
    long = spark.createDataFrame([("the and of that " * 300_000, None, None)], "text string, declared string, host string")
    assert language.identify(long, model).first().language == "en"


def test_every_label_is_modelled(spark):
    rows = [(f"the {i} and {'abcdefghij'[i % 10]} of that", "en") for i in range(3000)] + [("и в не на что", "ru")] + [(f"że się {i % 3}", "pl") for i in range(900)]
    df = spark.createDataFrame(rows + [(None, "xx"), ("x", None)], "text string, lang string")
    model = language.fit(df, "text", "lang", rows=120)
    assert model.languages == ("en", "pl", "ru") and model.table.shape[1] == 3
    got = language.identify(df.selectExpr("text", "lang declared", "'h' host").where("declared = 'ru'"), model).first()
    assert got.language == "ru"


FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
}


def test_unknown_languages_are_rejected_and_known_ones_stay(spark, model):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (15, 40, 400)]
    rows = [(i, t, d, "h.x") for i, t in enumerate([*FOREIGN.values(), *noise]) for d in (None, "fi", "de")]
    got = language.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), model).collect()
    assert {(r.language, r.accepted) for r in got} == {("und", False)}
    docs = read_table(spark, SF, "documents").where("doc_id % 4 = 0").select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    lost = [r.text for r in language.identify(docs, model).where("not accepted").join(docs.select("doc_id", "text"), "doc_id").collect()]
    assert all(not any(c.isalpha() for c in t or "") for t in lost)


def test_labels_are_read_like_declarations_and_bounded(spark, monkeypatch):
    rows = [(f"the {i} and of that", lang) for i, lang in enumerate(("en", "EN", "en-US", "en_GB") * 30)] + [(f"der {i} und die das", "de") for i in range(50)]
    df = spark.createDataFrame(rows + [(f"junk text {i}", f"x{i}") for i in range(300)] + [("a", "")], "text string, lang string")
    monkeypatch.setattr(language, "MOST_LABELS", 2)
    assert language.fit(df, "text", "lang").languages == ("de", "en")
    monkeypatch.setattr(language, "MOST_LABELS", 4)
    assert language.fit(df, "text", "lang").languages == ("de", "en", "x0", "x1"), "equal counts go by code"


def test_ties_go_to_the_first_code(spark):
    df = spark.createDataFrame([("same words here", "b"), ("same words here", "a")] * 5, "text string, lang string")
    got = language.identify(df.selectExpr("text", "cast(null as string) declared", "cast(null as string) host"), language.fit(df, "text", "lang")).first()
    assert got.language == got.text_language == "a" and 0.4 < got.posterior < 0.5
