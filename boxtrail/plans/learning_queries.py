"""Registered queries: learning and scoring on feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions import scores as s
from boxtrail.operators import learning as ml, selection as sel, windows as wn
from boxtrail.plans import fixtures as fx
from boxtrail.plans.matching_queries import r6
from boxtrail.plans.registry import query

FEATURES = [f"f{i}" for i in range(64)]
SHAPE = ["pixel_area", "circularity", "solidity", "extent", "blackhat_mean", "blackhat_max", "blackhat_threshold", "bbox_width", "bbox_height", "radial_distance_norm"]


def vectors(spark, sf):
    """All values of each embedding as columns; a few values are missing."""
    e = fx.table(spark, sf, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(len(FEATURES))]
    cols[0] = F.when(F.col("vec_id") % 50 != 0, F.col("embedding")[0].cast("double")).alias("f0")
    return e.select("vec_id", "label", *cols)


@query("ml1_preprocess")
def ml1(spark, sf):
    """Each scaled feature: its middle is zero and its 10-90 range is one, up to the quantile sketch's error."""
    from pyspark.ml.functions import vector_to_array

    out = ml.preprocess(vectors(spark, sf), FEATURES)
    return out.select("vec_id", *[F.round(vector_to_array("features")[i], 4).alias(c) for i, c in enumerate(FEATURES)])


@query("ml2_pca2")
def ml2(spark, sf):
    out, _ = ml.pca2(ml.preprocess(vectors(spark, sf), FEATURES))
    return out.select("vec_id", F.round(F.abs("pca_1"), 4).alias("pca_1"), F.round(F.abs("pca_2"), 4).alias("pca_2"))


@query("ml3_kmeans")
def ml3(spark, sf):
    out = ml.cluster(ml.preprocess(vectors(spark, sf), FEATURES), 5)
    return r6(out.select("vec_id", "cluster_id", "cluster_distance"), "cluster_distance")


@query("ml4_anomaly")
def ml4(spark, sf):
    out = ml.anomaly(ml.preprocess(vectors(spark, sf), FEATURES), "vec_id", trees=250)
    return r6(out, "anomaly_score")


@query("pr25_review_priority")
def priority(spark, sf):
    """Clusters, anomaly ranks and distance ranks feed the review priority and the queue."""
    prepared = ml.cluster(ml.preprocess(vectors(spark, sf), FEATURES), 5).select("vec_id", "label", "cluster_id", "cluster_distance", "features")
    scored = prepared.join(ml.anomaly(prepared, "vec_id", trees=250), "vec_id").drop("features")
    ranked = wn.pct_rank_avg(wn.pct_rank_avg(scored, [], "anomaly_score", "ar"), [], "cluster_distance", "dr")
    hits = F.col("label").cast("double")
    value = s.review_priority(F.col("label") / 10.0, hits, (hits + 1) / 10.0, F.col("ar"), F.col("dr"))
    rows = ranked.withColumns({"review_priority": F.round(value, 6), "hits": F.col("label")})
    return sel.review_queue(rows, "cluster_id", "vec_id", "review_priority", "hits", 20)


def learning_rows(spark, sf):
    k = F.col("vec_id") % 10
    split = F.when(k < 6, "train").when(k < 8, "valid").otherwise("test")
    return vectors(spark, sf).withColumns({"target": (F.col("label") < 4).cast("int"), "split": split})


SEARCHES: dict = {}


def search(spark, sf):
    """One search over the full grid, shared by the queries of a session that ask for it while the table's files stay the same."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t"))
    stamp = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)"))).first()
    at = (spark.sparkContext.applicationId, sf, tuple(stamp))
    if at not in SEARCHES:
        SEARCHES.clear()
        rows = learning_rows(spark, sf)
        parts = [rows.filter(F.col("split") == p) for p in ("train", "valid", "test")]
        SEARCHES[at] = ml.model_search(*parts, FEATURES, "target")
    return SEARCHES[at]


@query("ml5_model_search")
def ml5(spark, sf):
    rows, _ = search(spark, sf)
    return rows.withColumns({c: F.round(c, 4) for c in ("validation_score", "validation_f1", "validation_recall", "test_f1", "test_recall")})


@query("ml6_best_model")
def ml6(spark, sf):
    rows, _ = search(spark, sf)
    return ml.best_model(rows).select("family", "setting")


@query("ml7_surrogate_tree")
def ml7(spark, sf):
    c = fx.candidates(spark, sf).withColumn("gate", s.bright_round_gate()["gate_pass"].cast("int"))
    return r6(ml.surrogate_tree(c, SHAPE, "gate", "sequence_id"), "precision", "recall", "f1", "accuracy")


@query("ml8_importance")
def ml8(spark, sf):
    from pyspark.ml import Pipeline

    rows = ml.clean(learning_rows(spark, sf), FEATURES).withColumn("label", F.col("target").cast("double"))
    weighted = ml.balanced_weights(rows, "label")
    tree = ml.model_grid(1.0)["decision_tree"][2]
    model = Pipeline(stages=[*ml.preprocessing(FEATURES, False), tree]).fit(weighted)
    return r6(ml.importance(model, FEATURES), "importance")


@query("ml9_score")
def ml9(spark, sf):
    rows = learning_rows(spark, sf)
    _, model = search(spark, sf)
    out = ml.score(rows.drop("label"), model)
    return r6(out.select("vec_id", "probability_1"), "probability_1")
