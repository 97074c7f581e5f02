"""Clusters of vectors: k-means chosen by silhouette, and profiles of clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.lexical import top


def kmeans_by_silhouette(rows: DataFrame, vector: str, most: int = 5, seed: int = 42) -> DataFrame:
    """rows with `cluster` of the k in 2..most whose silhouette is best, and that `silhouette`; one cluster of -1 for fewer than 3 rows."""
    ready = rows.withColumn("_features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    n = ready.count()
    best = None
    for k in range(2, min(most, n - 1) + 1):
        found = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(ready).transform(ready)
        if found.select("cluster").distinct().count() > 1:
            score = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster").evaluate(found)
            if best is None or score > best[0]:
                best = (score, found)
    if best is None:
        return rows.withColumns({"cluster": F.lit(-1), "silhouette": F.lit(-1.0)})
    return best[1].drop("_features").withColumn("silhouette", F.lit(float(best[0])))


def profile(rows: DataFrame, cluster: str, value: str, k: int = 10) -> DataFrame:
    """cluster, value, n, share, rank of each cluster's k commonest values."""
    counts = rows.groupBy(cluster, value).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(cluster).agg(F.sum("n").alias("_all"))
    best = top(counts, cluster, k, F.col("n").desc(), value)
    return best.join(sizes, cluster).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


def split_category(rows: DataFrame, id_: str, vector: str, category: str, text: str, name: str, most: int = 5, least: float = 0.0, generic: list[str] | None = None) -> DataFrame:
    """rows with `new_category` and `original_category`: the rows of one category in clusters, named by their key terms; all others as they were.

    The number of clusters is the one of 2 to `most` with the best silhouette; a category of fewer than 3 rows with vectors, or
    whose silhouette is below `least`, stays whole. A cluster's name is the category, its number and up to two words that its
    texts hold most often (five words are counted, then generic ones go), so names are unique. Categories are compared in
    lower case; rows of the category without a vector keep it. Only counts of words come to the driver, none of the rows.
    """
    mine = F.coalesce(F.lower(F.col(category)) == name.lower(), F.lit(False)) & F.col(vector).isNotNull()
    found = kmeans_by_silhouette(rows.filter(mine).select(id_, vector, text), vector, most).filter(F.col("silhouette") >= least)
    words = found.filter("cluster >= 0").select("cluster", F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    best = top(words.groupBy("cluster", "word").agg(F.count("*").alias("n")), "cluster", 5, F.col("n").desc(), "word")
    terms = best.filter(~F.col("word").isin(generic or [])).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).getField("word").alias("w"))
    names = found.select(id_, "cluster").join(terms, "cluster", "left")
    label = F.array_join(F.concat(F.array(F.lit(name), (F.col("cluster") + 1).cast("string")), F.slice(F.coalesce("w", F.array().cast("array<string>")), 1, 2)), "_")
    routed = names.filter("cluster >= 0").select(F.col(id_).alias("_id"), label.alias("_new"))
    out = rows.join(routed, rows[id_] == routed["_id"], "left")
    return out.withColumns({"new_category": F.coalesce("_new", F.col(category)), "original_category": F.when(F.col("_new").isNotNull(), F.col(category))}).drop("_id", "_new")
