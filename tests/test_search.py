"""Inverted index and cell index against the dense, exact search."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from claimlens.errors import ClaimLensError
from claimlens.operators import cells, embed, inverted, knn, retrieval
from claimlens.session import stage

SF = "/root/testdata/sf0.001"
POINTS = "vec_id long, embedding array<double>"


def written(spark, index, path, leading=inverted.LEADING):
    return inverted.read_postings(spark, inverted.write_postings(inverted.build_postings(index), str(path), leading))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


def dense(index, asked, k):
    """The dense result, with distances equal to eleven digits as ties."""
    found, out = {}, []
    for r in knn.knn_l2(index, asked, 10**6).collect():
        found.setdefault(r["query_id"], []).append((round(r["distance"], 11), r["id"], r["distance"]))
    for q, near in found.items():
        out += [(q, n, i, round(d, 9)) for n, (_, i, d) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(1, 40))) for _ in range(400)]
    texts[50:150] = [texts[50]] * 100  # a quarter of the rows are copies: ties by id
    texts += ["", "?!"]
    chunks = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    index, model = embed.build_index(chunks)
    return stage(index, "test-index"), model


@pytest.mark.parametrize("leading", [1, 5, 10_000])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_inverted_equals_dense(spark, corpus, tmp_path, leading, k):
    index, model = corpus
    asked = [("q1", "word0 word1 word2"), ("q2", "word250 word0"), ("q3", index.first()["text"]), ("q4", "word7 " * 30 + "word299"), ("q5", "?")]
    queries = embed.embed(spark.createDataFrame(asked, "query_id string, query string"), model, "query")
    assert rows(inverted.search(written(spark, index, tmp_path, leading), queries, k, chunks=index)) == dense(index, queries, k)


def test_chunks_without_a_query_word_are_only_fillers(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "red"), ("b", "red red blue"), ("c", "green"), ("d", "yellow green"), ("e", "")], "chunk_id string, text string")
    index, model = embed.build_index(chunks)
    queries = embed.embed(spark.createDataFrame([("q", "blue"), ("r", "purple")], "query_id string, query string"), model, "query")
    postings = written(spark, index, tmp_path)
    assert {r["id"] for r in inverted.search(postings, queries, 3).collect()} == {"b"}
    assert rows(inverted.search(postings, queries, 3, chunks=index)) == dense(index, queries, 3)


def test_candidates_are_few(spark, corpus, tmp_path):
    """A rare word makes the frequent ones optional: chunks that have only these are not scored."""
    index, model = corpus
    queries = embed.embed(spark.createDataFrame([("q", "word280 word280 word280 word0")], "query_id string, query string"), model, "query")
    leading, whole = written(spark, index, tmp_path)
    plan = inverted.search((leading, whole), queries, 1)._jdf.queryExecution().toString()
    assert "embedding" not in plan, "no dense vector is read"
    assert rows(inverted.search((leading, whole), queries, 1)) == dense(index, queries, 1)


def test_negative_weights_are_refused(spark):
    with pytest.raises(Exception, match="at least zero"):
        inverted.build_postings(spark.createDataFrame([("a", [0.5, -0.5])], "chunk_id string, embedding array<float>")).collect()


def test_missing_postings(spark, tmp_path):
    with pytest.raises(ClaimLensError) as info:
        inverted.read_postings(spark, str(tmp_path / "none"))
    assert info.value.error_code == "RAG-5002"


def test_all_flags_like_the_dense_search(spark):
    index, model, postings = queries._lexical_index(spark, SF)
    asked = stage(embed.embed(retrieval.expand_flag_query(queries._all_flags(spark, SF)), model, "query").withColumnRenamed("flag", "query_id"), "asked")
    assert rows(inverted.search(postings, asked, 3, chunks=index)) == dense(index, asked, 3)
    assert queries._lexical_index(spark, SF)[0].inputFiles() == index.inputFiles(), "the index is made once"


def test_hashing_in_one_pass_gives_the_same_vectors(spark):
    texts = spark.createDataFrame([("a", "One two, TWO three"), ("b", None), ("c", "Äpfel 12 naïve_x"), ("d", "one")], "chunk_id string, text string")
    model = embed.fit_embedder(texts)
    hashed = embed.with_buckets(texts)
    assert embed.fit_embedder(hashed) == model
    assert embed.embed(hashed, model).columns == ["chunk_id", "text", "embedding"]
    assert sorted(map(str, embed.embed(hashed, model).collect())) == sorted(map(str, embed.embed(texts, model).collect()))


# --- cells ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 16)) * 2
    x = middle[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))
    x[1000:2000] = x[1000]  # a third of the rows are copies: one cell is hot
    return stage(spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], POINTS).repartition(6), "points")


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    cells.write_cells(points, path, 30, "vec_id")
    return cells.read_cells(spark, path)


def asked_of(points):
    return points.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def test_every_vector_is_indexed_in_its_nearest_cell(points, index):
    held = {i: r["cell"] for r in index.blocks.collect() for i in r["ids"]}
    assert sorted(held) == list(range(3000)) and len(index.centers) <= 30 and index.centers.shape[1] == 16
    for r in points.where("vec_id % 97 = 0").collect():
        far = ((index.centers - np.array(r["embedding"])) ** 2).sum(1)
        assert far[held[r["vec_id"]]] <= far.min() + 1e-9


def test_all_cells_are_the_exact_search(points, index):
    asked = asked_of(points)
    exact = knn.knn_l2(points, asked, 5, "vec_id")
    assert sorted(map(tuple, cells.search(index, asked, 5, 30).collect())) == sorted(map(tuple, exact.collect()))


def test_recall_is_measured_and_reached(points, index):
    asked = asked_of(points)
    exact = stage(knn.knn_l2(points, asked, 10, "vec_id"), "exact")
    probes = cells.choose_probes(index, points, asked, 10, 0.9, "vec_id")
    assert 1 <= probes < 15
    got = cells.recall(cells.search(index, asked, 10, probes), exact).first()
    assert got["neighbours"] == 1500 and got["recall"] >= 0.9
    assert probes == 1 or cells.recall(cells.search(index, asked, 10, probes - 1), exact).first()["recall"] < 0.9


def test_recall_on_the_given_vectors(spark):
    got = queries.REGISTRY["knn_cells_recall"](spark, SF).first()
    assert (got["neighbours"], got["reached"]) == (250, True)


def test_fit_does_not_depend_on_the_cut(points):
    assert np.array_equal(cells.fit_centers(points, 5, "vec_id"), cells.fit_centers(points.repartition(3), 5, "vec_id"))


def test_vectors_without_a_distance(spark, tmp_path):
    bad = [(2, [float("nan"), 0.0]), (3, [None, 1.0]), (4, None), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (6, [0.0, 3.0]), *bad], POINTS)
    index = cells.read_cells(spark, cells.write_cells(df, str(tmp_path), 2, "vec_id"))
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    assert {(r["query_id"], r["id"]) for r in cells.search(index, asked, 1, 2).collect()} == {("1", 1), ("6", 6)}
    with pytest.raises(Exception, match="length"):
        cells.search(index, spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>"), 1, 2).collect()
    with pytest.raises(ClaimLensError):
        cells.fit_centers(df.where("vec_id = 4"), 2, "vec_id")


def test_postings_measure_a_vector_once_and_not_once_per_element(spark):
    rows = [("a", [0.0, 3.0, None, 4.0]), ("b", [0.0, 0.0, 0.0, 0.0]), ("c", None), ("d", [1.0, 0.0, 2.0, 0.0])]
    built = inverted.build_postings(spark.createDataFrame(rows, "chunk_id string, embedding array<float>"))
    above = built._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    assert "aggregate(" not in above and "embedding" not in above
    assert sorted(map(tuple, built.collect()), key=str) == [(0, 1.0, "d", 5.0), (1, 3.0, "a", None), (2, 2.0, "d", 5.0), (3, 4.0, "a", None)]


def test_postings_are_not_shuffled_and_keep_the_vectors_type(spark, tmp_path, monkeypatch):
    """A shuffle of all postings took more disk than the postings; as doubles, weights took twice their place."""
    rows = [(f"c{i:02d}", [float(i % 3), 0.0, 0.1, float(i)]) for i in range(40)]
    index = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    built = inverted.build_postings(index)
    assert dict(built.dtypes) == {"bucket": "int", "weight": "float", "id": "string", "square": "double"}
    monkeypatch.setattr(type(built), "repartitionByRange", None)
    leading, whole = inverted.read_postings(spark, inverted.write_postings(built, str(tmp_path), 5))
    assert leading.groupBy("bucket").count().where("count > 5").isEmpty()
    want = sorted((b, i, float(np.float32(x)), round(sum(e * e for e in v), 5)) for i, v in rows for b, x in enumerate(v) if x)
    assert sorted((r["bucket"], r["id"], r["weight"], round(r["square"], 5)) for r in whole.collect()) == want
    assert all(f.endswith(".zstd.parquet") for f in whole.inputFiles())
    doubles = inverted.build_postings(spark.createDataFrame([("a", [0.1])], "chunk_id string, embedding array<double>"))
    assert doubles.first()["weight"] == 0.1


def test_hashed_chunks_go_when_the_index_is_written(spark, monkeypatch):
    monkeypatch.setattr(queries, "_INDEXES", {})
    dropped, drop = [], queries.drop_table
    monkeypatch.setattr(queries, "drop_table", lambda table: (dropped.append(table), drop(table)))
    index, _, postings = queries._lexical_index(spark, SF)
    assert len(dropped) == 1 and index.count() > 0 and postings[1].count() > 0
    assert not os.path.exists(dropped[0].inputFiles()[0].removeprefix("file://"))
