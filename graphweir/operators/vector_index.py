"""A stored index for cosine search: vectors written once, in lists around centroids.

``build`` fits k-means by angle on a bounded sample, puts every row into the list of its nearest centroid, and
writes the rows partitioned by list.  A search measures the query against the centroids, reads the partitions of the
nearest lists only (partition pruning), and ranks their rows by exact cosine.  Probing all lists is the exact search.

    path/model      the fitted centroids
    path/vectors    the rows, partitioned by ``gw_list``; rows that no query can meet (null or zero vectors, those of
                    other lengths) are kept in list -1

A table of centroids has at most ``MOST_LISTS`` rows, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweir.operators.vector import cosine, dot, search

LIST = "gw_list"
#: Rows that centroids are fitted on, about; the most lists; rows of a file.
FIT_ROWS, MOST_LISTS, FILE_ROWS = 100_000, 4096, 1_000_000


def _usable(vector: str, size: int) -> Column:
    v = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c)) & (dot(v, v) > 0) & (dot(v, v) < float("inf")), F.lit(False))


def _listed(rows: DataFrame, vector: str, size: int, model: KMeansModel) -> DataFrame:
    """``rows`` with the number of their list."""
    (features,) = [f"gw_features{'_' * k}" for k in range(len(rows.columns) + 1) if f"gw_features{'_' * k}" not in rows.columns][:1]
    fit = rows.filter(_usable(vector, size)).withColumn(features, array_to_vector(F.col(vector).cast("array<double>")))
    found = model.setFeaturesCol(features).setPredictionCol(LIST).transform(fit).drop(features)
    return found.unionByName(rows.filter(~_usable(vector, size)).withColumn(LIST, F.lit(-1)))


def _write(listed: DataFrame, path: str, mode: str) -> None:
    # a rebalanced list that is larger than others is split over several tasks
    listed.hint("rebalance", LIST).write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy(LIST).parquet(f"{path}/vectors")


def build(rows: DataFrame, vector: str, path: str, id_col: str = "vec_id", lists: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 1) -> None:
    """Write the index of all ``rows``, with the vectors' most frequent length; some square root of their number as lists, if not given.

    The sample is drawn by a hash of the id.  An empty table has an index without lists.
    """
    sizes = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    size, n = (most["size"], most["n"]) if most else (0, 0)
    usable = rows.filter(_usable(vector, size))
    share = min(1.0, fit_rows / max(n, 1))
    sample = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if sample.isEmpty():
        rows.write.mode("overwrite").parquet(f"{path}/vectors/{LIST}=-1")  # written below its folder, an empty table still tells its columns
        return
    wanted = min(MOST_LISTS, lists or max(1, round(math.sqrt(n))))
    model = KMeans(k=max(2, wanted), distanceMeasure="cosine", maxIter=10, seed=seed, initSteps=2).fit(sample)
    model.write().overwrite().save(f"{path}/model")
    _write(_listed(rows, vector, size, model), path, "overwrite")


def add(rows: DataFrame, vector: str, path: str) -> None:
    """Append ``rows`` to an index; its centroids stay as they are."""
    model = KMeansModel.load(f"{path}/model")
    _write(_listed(rows, vector, len(model.clusterCenters()[0]), model), path, "append")


def centroids(path: str) -> np.ndarray:
    """The centroids, of length 1, a row for each list; none, if no vector is in a list."""
    if SparkSession.active().read.parquet(f"{path}/vectors").filter(F.col(LIST) >= 0).isEmpty():
        return np.zeros((0, 0))
    c = np.array(KMeansModel.load(f"{path}/model").clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def nearest_lists(centres: np.ndarray, query: list[float], probes: int | None) -> list[int]:
    """The numbers of the ``probes`` lists whose centroids are nearest by angle; all, if None."""
    near = np.argsort(-(centres @ np.asarray(query, float)), kind="stable")
    return [int(x) for x in near[:probes]]


def probe(spark: SparkSession, path: str, query: list[float], vector: str, probes: int | None = 8, cutoff: float = 0.7, limit: int = 5, tie: str = "vec_id") -> DataFrame:
    """The rows of the ``probes`` nearest lists that are nearest to ``query``, at least ``cutoff``, best first; ties by ``tie``.

    A query of another length than the index's meets nothing.
    """
    rows, centres = spark.read.parquet(f"{path}/vectors"), centroids(path)
    near = nearest_lists(centres, query, probes) if len(query) == centres.shape[1] else []
    return search(rows.filter(F.col(LIST).isin(near)), vector, query, cutoff, limit, tie).drop(LIST)


def probe_each(path: str, queries: DataFrame, query_id: str, query_vector: str, vector: str, probes: int | None = 8, cutoff: float = 0.7, limit: int = 5, tie: str = "vec_id") -> DataFrame:
    """For each of a table of queries what ``probe`` finds: query_id, rank from 1, ``tie``, similarity_score.

    Queries go to the lists that they probe and meet rows there by an equi-join.
    """
    centres = centroids(path)

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["lists"] = [nearest_lists(centres, v, probes) for v in frame["v"]]
            yield frame

    asked = queries.filter(_usable(query_vector, centres.shape[1])).select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    kind = asked.schema["q"].dataType.simpleString()
    asked = asked.mapInPandas(lists, f"q {kind}, v array<double>, lists array<int>").select("q", F.col("v").alias("query_vector_"), F.explode("lists").alias(LIST))
    rows = queries.sparkSession.read.parquet(f"{path}/vectors").select(LIST, F.col(tie).alias("found"), F.col(vector).alias("row_vector_"))
    scored = asked.join(rows, LIST).select("q", "found", cosine(F.col("row_vector_"), F.col("query_vector_")).alias("similarity_score")).filter(F.col("similarity_score") >= cutoff)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity_score"), "found"))).filter(F.col("rank") <= limit)
    return best.select(F.col("q").alias(query_id), "rank", F.col("found").alias(tie if tie != query_id else f"found_{tie}"), "similarity_score")
