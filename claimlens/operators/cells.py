"""Approximate nearest neighbours: vectors are dealt into cells, and a query visits the few cells nearest to it.

Centers are fitted to a bounded sample, PER_CELL vectors for each of at most MOST_CELLS cells, chosen by a hash of the id.
Every vector is indexed, in the cell of its nearest center. Distances in the visited cells are exact; what is lost are
neighbours in cells that are not visited. ``choose_probes`` measures that against the exact search and gives the number of
cells that reaches a wanted recall; visiting all cells is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..session import stage
from ..sources.tables import read_layer
from .knn import INDEX_BLOCK, QUERY_BLOCK, knn_l2, nearest_of, packed

MOST_CELLS = 4096
PER_CELL = 64
# Queries that ``choose_probes`` measures, chosen by a hash of their id.
MEASURED = 1000


@dataclass(frozen=True)
class CellIndex:
    centers: np.ndarray  # cells x elements
    blocks: DataFrame  # (cell, ids, width, vectors)


def _usable(df: DataFrame) -> DataFrame:
    """Rows whose vector has a distance: not null, and all elements finite numbers."""
    return df.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double"))))


def fit_centers(vectors: DataFrame, cells: int | None = None, id_col: str = "chunk_id", seed: int = 42) -> np.ndarray:
    """Centers by k-means over a sample of at most PER_CELL vectors a cell; by default the square root of the rows as cells."""
    usable = _usable(vectors)
    cells = min(MOST_CELLS, cells or ceil(sqrt(max(1, usable.count()))))
    sample = usable.select(F.xxhash64(F.col(id_col)).alias("h"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("h", "embedding").limit(cells * PER_CELL)
    # in one partition the fit does not depend on how the table was cut; the sample is bounded
    sample = stage(sample.select("embedding").coalesce(1), "cell-sample").select(array_to_vector("embedding").alias("features"))
    if sample.isEmpty():
        raise errors.ClaimLensError(errors.NO_DOCUMENTS, "no vectors to index")
    centers = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(sample).clusterCenters()
    return np.array(centers)


def _near(vectors: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first; ties go to the smaller number."""
    far = (centers * centers).sum(1)[None, :] - 2.0 * (vectors @ centers.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def nearest_cells(df: DataFrame, centers: np.ndarray, n: int, id_col: str) -> DataFrame:
    """(id, embedding, cells) of the rows whose vector has a distance: the n nearest cells, nearest first."""
    rows = _usable(df.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")))
    shared = df.sparkSession.sparkContext.broadcast(centers)  # at most MOST_CELLS rows
    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lengths = batch.column("embedding").value_lengths().to_numpy()
                if (lengths != shared.value.shape[1]).any():
                    raise ValueError(f"vectors of different lengths: {sorted({shared.value.shape[1], *lengths.tolist()})[:3]}")
                near = _near(batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1), shared.value, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), lists], names=["id", "embedding", "cells"])

    return rows.mapInArrow(run, schema)


def _blocks(dealt: DataFrame, size: int) -> DataFrame:
    """Blocks by cell. A cell that holds much of the table is cut into as many ranges as it needs."""
    order = ("cell", F.xxhash64("id"))
    return packed(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "embedding", "cell"), size, cells=True)


def write_cells(vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "chunk_id", seed: int = 42) -> str:
    """Fit centers, deal every vector into its cell and write both; returns the path."""
    centers = fit_centers(vectors, cells, id_col, seed)
    own = nearest_cells(vectors, centers, 1, id_col).select("id", "embedding", F.col("cells")[0].alias("cell"))
    _blocks(own, INDEX_BLOCK).write.mode("overwrite").parquet(f"{path}/blocks")
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    return path


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    rows = read_layer(spark, f"{path}/centers", code=errors.INDEX_NOT_FOUND).orderBy("cell").collect()
    return CellIndex(np.array([r["center"] for r in rows]), read_layer(spark, f"{path}/blocks", code=errors.INDEX_NOT_FOUND))


def search(index: CellIndex, queries: DataFrame, k: int = 3, probes: int = 8, query_id: str = "query_id") -> DataFrame:
    """Rows ``(query_id, id, distance, rank)`` like those of the exact search, from the ``probes`` cells nearest to each query.

    Queries travel to the blocks of their cells by a join on the cell, which Spark splits where one cell has many
    blocks. Vectors without a distance are never neighbours and find none.
    """
    asked = nearest_cells(queries.withColumn("_q", F.col(query_id).cast("string")), index.centers, max(1, probes), "_q")
    asked = _blocks(asked.select("id", "embedding", F.explode("cells").alias("cell")), QUERY_BLOCK)
    asked = asked.select("cell", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("vectors").alias("q_vectors"))
    met = index.blocks.join(asked, "cell").select("ids", "width", "vectors", "q_ids", "q_width", "q_vectors")
    return nearest_of(met, k, index.blocks.schema["ids"].dataType.elementType)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(neighbours, found, recall): how many rows of the exact search another one has."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    counted = hits.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    return counted.withColumn("recall", F.col("found") / F.nullif("neighbours", F.lit(0)))


def choose_probes(index: CellIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = 0.9, id_col: str = "chunk_id", query_id: str = "query_id") -> int:
    """The smallest number of cells that reaches ``target`` for a bounded sample of the queries.

    One pass: each exact neighbour lies in one cell, at some place among the cells of its query in order of nearness;
    visiting p cells finds the neighbours at the first p places.
    """
    sample = queries.withColumn("_q", F.col(query_id).cast("string")).orderBy(F.xxhash64("_q"), "_q").limit(MEASURED)
    sample = stage(sample.select("_q", "embedding"), "measured-queries")
    exact = knn_l2(vectors, sample, k, id_col, "_q").select("query_id", "id")
    homes = index.blocks.select("cell", F.explode("ids").alias("id")).withColumn("id", F.col("id").cast("string"))
    order = nearest_cells(sample, index.centers, len(index.centers), "_q").select(F.col("id").alias("query_id"), "cells")
    places = exact.withColumn("id", F.col("id").cast("string")).join(homes, "id").join(order, "query_id").groupBy(F.array_position("cells", F.col("cell")).alias("place")).count()
    counted = sorted((r["place"], r["count"]) for r in places.collect())  # one row per cell at most
    total, seen = sum(n for _, n in counted), 0
    for place, n in counted:
        seen += n
        if seen >= target * total:
            return int(place)
    return 1
