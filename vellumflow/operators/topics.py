"""Topics of grouped documents: count vectors, class-based weights, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of historical French that say nothing of a topic.
STOPWORDS = "a au aus aux auec avec ce cel cele celle ces cest cil comme con dame de del des dit dont du e el elle en encore est estoit et eust fait fu il ilz iour je la le les leur li lor lui ma mais me mes mon mout ne nostre nous on ou par pas plus por pour quant que quel qui sa sans se ses si son sont sus ta te tout tu un une uous vos vous y".split()


def terms(docs: DataFrame, id_col: str, text_col: str, stopwords: list[str] | None = None) -> DataFrame:
    """id, term, tf: lower-cased words of letters, without stop words."""
    stop = STOPWORDS if stopwords is None else stopwords
    words = docs.select(F.col(id_col), F.explode(F.split(F.lower(text_col), r"[^\p{L}\p{M}]+")).alias("term"))
    return words.filter((F.col("term") != "") & ~F.col("term").isin(stop)).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def class_tfidf(counts: DataFrame, class_col: str, *, digits: int = 6) -> DataFrame:
    """class, term, tf, weight = tf share in its class x log(1 + mean words of a class / term's count)."""
    in_class = counts.groupBy(class_col).agg(F.sum("tf").alias("class_words"))
    overall = counts.groupBy("term").agg(F.sum("tf").alias("term_count"))
    mean = in_class.agg(F.avg("class_words").alias("mean_words"))
    joined = counts.join(overall, "term").join(in_class, class_col).join(F.broadcast(mean))
    weight = F.col("tf") / F.col("class_words") * F.log(1 + F.col("mean_words") / F.col("term_count"))
    return joined.select(class_col, "term", "tf", F.round(weight, digits).alias("weight"))


def top_terms(weights: DataFrame, class_col: str, k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(class_col).orderBy(F.desc("weight"), "term"))
    return weights.withColumn("place", place).filter(F.col("place") <= k)


def kmeans_topics(vectors: DataFrame, id_col: str, vector_col: str, *, k: int = 5, seed: int = 42, reduce_to: int | None = 5) -> DataFrame:
    """id, topic: KMeans over vectors, reduced by principal components (the documented reduction isn't at hand)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    if reduce_to:
        data = PCA(k=reduce_to, inputCol="features", outputCol="reduced").fit(data).transform(data).select(id_col, F.col("reduced").alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(id_col, F.col("prediction").alias("topic"))
