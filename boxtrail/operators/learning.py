"""Scaling, projection, clustering, anomaly ranking and model search on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from boxtrail.operators.features import finite
from boxtrail.operators.grid import with_row
from boxtrail.operators.metrics import binary_counts, prf
from boxtrail.operators.ordered import top_k
from boxtrail.session import materialize, settle, ship_package

ERROR = 0.0001


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in features})


def preprocessing(features: list[str], scale: bool = True) -> list:
    """Median impute, assemble and (for linear models) scale between the 10 % and 90 % quantiles."""
    filled = [f"_f_{c}" for c in features]
    steps = [
        Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=ERROR),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "features"),
    ]
    if scale:
        steps.append(
            RobustScaler(
                lower=0.1, upper=0.9, withCentering=True, inputCol="_raw", outputCol="features", relativeError=ERROR
            )
        )
    return steps


def preprocess(df: DataFrame, features: list[str]) -> DataFrame:
    data = clean(df, features)
    model = Pipeline(stages=preprocessing(features)).fit(data)
    return model.transform(data).drop("_raw", *[f"_f_{c}" for c in features])


def pca2(df: DataFrame, column: str = "features") -> tuple[DataFrame, list[float]]:
    """Two centered principal axes (sign is free) and their explained variance."""
    model = PCA(k=2, inputCol=column, outputCol="_pca").fit(df)
    out = model.transform(df).withColumn("_p", vector_to_array("_pca"))
    mid = out.agg(F.avg(F.col("_p")[0]).alias("_m1"), F.avg(F.col("_p")[1]).alias("_m2"))
    out = with_row(out, mid).withColumns(
        {"pca_1": F.col("_p")[0] - F.col("_m1"), "pca_2": F.col("_p")[1] - F.col("_m2")}
    )
    return out.drop("_pca", "_p", "_m1", "_m2"), [float(v) for v in model.explainedVariance]


def _first_centers(points: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """(start, center, place): for every start the ``k`` different points that come first by a hash of its own."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))
    rows = points.select("v").distinct().withColumn("start", numbers).withColumn("h", F.xxhash64(F.lit(seed), "start", "v"))
    picked = top_k(rows, ["start"], ["h", "v"], k).orderBy("start", "h", "v").collect()
    if not picked:
        return np.zeros((starts, 0, 0))
    return np.array([r.v for r in picked], dtype=float).reshape(starts, -1, len(picked[0].v))


def _advance(points: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centers, cost of the old ones) of all starts, from one aggregation over the points."""
    starts, k, places = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, cost = np.zeros(centers.shape), np.zeros((starts, k), np.int64), np.zeros((starts, k))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, places)
            for s in range(starts):
                far = ((x[:, None] - centers[s][None]) ** 2).sum(2)
                at = far.argmin(1)
                np.add.at(sums[s], at, x)
                n[s] += np.bincount(at, minlength=k)
                cost[s] += np.bincount(at, weights=far.min(1), minlength=k)
        start, center = np.divmod(np.arange(starts * k), k)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(starts * k + 1, dtype=np.int32) * places), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(center), pa.array(n.ravel()), pa.array(cost.ravel()), lists], names=["start", "center", "n", "cost", "sums"])

    rows = points.select("v").mapInArrow(run, "start long, center long, n long, cost double, sums array<double>")
    cells = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(places)]
    moved, total = centers.copy(), np.zeros(starts)
    for r in rows.groupBy("start", "center").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *cells).collect():
        total[r.start] += r.cost
        if r.n:
            moved[r.start, r.center] = [r[f"s{j}"] / r.n for j in range(places)]
    return moved, total


def best_centers(df: DataFrame, k: int, seed: int = 42, column: str = "features", starts: int = 20, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centers, cost of every start): the centers with the least sum of squared distances among all starts.

    All starts take a step in the same aggregation; an empty cluster keeps its center. Fewer different points than ``k`` give
    as many centers as there are.
    """
    ship_package(df.sparkSession)
    points = materialize(df.select(vector_to_array(column).alias("v")))
    centers = _first_centers(points, k, starts, seed)
    for _ in range(steps if centers.size else 0):
        moved, _ = _advance(points, centers)
        if np.allclose(moved, centers, rtol=0, atol=1e-9):
            break
        centers = moved
    cost = _advance(points, centers)[1] if centers.size else np.zeros(starts)
    return centers[int(cost.argmin())], cost


def cluster(df: DataFrame, k: int, seed: int = 42, column: str = "features", starts: int = 20) -> DataFrame:
    """Adds cluster_id and the distance to the nearest center of the best of ``starts`` searches."""
    found, _ = best_centers(df, k, seed, column, starts)
    # k centers are model-sized; they enter the plan as literals.
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in found])
    out = df.withColumn("_v", vector_to_array(column))
    if not len(found):
        return out.withColumn("cluster_id", F.lit(None).cast("int")).withColumn("cluster_distance", F.lit(None).cast("double")).drop("_v")

    def distance(center):
        off = F.zip_with("_v", center, lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(off, F.lit(0.0), lambda acc, v: acc + v))

    out = out.withColumn("_d", F.transform(centers, distance))
    nearest = F.array_min("_d")
    return out.withColumn("cluster_id", (F.array_position("_d", nearest) - 1).cast("int")).withColumn("cluster_distance", nearest).drop("_v", "_d")


TREE = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"


def _expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "depth")}

    def leaf_or_split(rows, level):
        me = len(nodes["feature"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1)):
            nodes[k].append(v)
        nodes["depth"].append(level + _expected_depth(len(rows)))
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if level < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            low = rows[:, f] <= cut
            nodes["feature"][me], nodes["threshold"][me] = f, cut
            nodes["left"][me] = leaf_or_split(rows[low], level + 1)
            nodes["right"][me] = leaf_or_split(rows[~low], level + 1)
        return me

    leaf_or_split(values, 0)
    return nodes


def anomaly(
    df: DataFrame, ident: str, trees: int = 100, sample: int = 256, contamination: float = 0.12, seed: int = 42, column="features"
) -> DataFrame:
    """Isolation scores in 0..1 and the flag of the top ``contamination`` share.

    Every tree draws its own sample (the method's own step) by hash order; trees grow in parallel, one small group
    each, and the finished forest is broadcast to score the whole table in Arrow batches.
    """
    from boxtrail.operators.ordered import quantiles

    spark = df.sparkSession
    ship_package(spark)
    slim = df.select(ident, vector_to_array(column).alias("v"))
    n = max(slim.count(), 2)
    size = min(sample, n)
    # Each row enters a tree with a probability that gives about twice the sample, then the tree cuts to its size.
    share = min(1.0, 2.0 * size / n)
    # Row x tree marks are made only for the rows a tree draws: binary choice per (row, tree) by hash.
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    mark = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(ident)), F.lit(1_000_003)) / 1_000_003.0
    drawn = slim.select(ident, "v", F.explode(F.filter(numbers, lambda t: mark(t) < share)).alias("tree"))
    limit = int(np.ceil(np.log2(size)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h").head(size)
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(np.stack(pdf["v"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([{"tree": tree, **nodes}])

    keyed = drawn.withColumn("h", F.xxhash64(F.lit(seed + 1), "tree", ident))
    # trees x (2 x size) nodes: a model of fixed size, whatever the table holds.
    forest = keyed.groupBy("tree").applyInPandas(grow, TREE).collect()
    shared = spark.sparkContext.broadcast(
        [{k: np.asarray(r[k]) for k in ("feature", "threshold", "left", "right", "depth")} for r in forest]
    )
    norm = _expected_depth(size) or 1.0

    @pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        total = np.zeros(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = t["feature"][at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go_left = x[inner, f[inner]] <= t["threshold"][at[inner]]
                at[inner] = np.where(go_left, t["left"][at[inner]], t["right"][at[inner]])
            total += t["depth"][at]
        return pd.Series(np.power(2.0, -total / max(len(shared.value), 1) / norm))

    scored = slim.withColumn("anomaly_score", score("v")).drop("v")
    cut = quantiles(scored, [], F.col("anomaly_score"), {"_cut": 1.0 - contamination})
    flagged = with_row(scored, cut)
    return flagged.withColumn("is_anomaly", (F.col("anomaly_score") > F.col("_cut")).cast("int")).drop("_cut")


def balanced_weights(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """Adds ``_w``: the row weight times n / (2 x class size)."""
    base = F.col(weight) if weight else F.lit(1.0)
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = n.agg(F.sum("_c").alias("_t"))
    joined = with_row(df.join(F.broadcast(n), label), total)
    return joined.withColumn("_w", base * F.col("_t") / (2.0 * F.col("_c"))).drop("_c", "_t")


# Inverse regularization strengths of the linear model.
INVERSE_STRENGTHS = (0.1, 0.5, 1.0, 2.0, 10.0)


def model_grid(weight: float, seed: int = 42, trees: int = 240) -> dict[str, list]:
    """Families and settings tried by ``model_search``; ``weight`` is the sum of the training rows' weights.

    The linear model's loss is an average, so strength C of a summed loss is a penalty of 1 / (C x weight).
    """
    base = {"featuresCol": "features", "labelCol": "label", "weightCol": "_w"}
    return {
        "logistic_regression": [
            LogisticRegression(regParam=1.0 / (c * weight), standardization=False, maxIter=200, **base) for c in INVERSE_STRENGTHS
        ],
        # Depths, leaf sizes and numbers of trees.
        "decision_tree": [
            DecisionTreeClassifier(maxDepth=d, minInstancesPerNode=n, seed=seed, **base)
            for d, n in product((3, 4, 5, 6, 8), (5, 12))
        ],
        "random_forest": [
            RandomForestClassifier(numTrees=trees, maxDepth=d, minInstancesPerNode=n, seed=seed, **base)
            for d, n in product((6, 9, 12), (3, 8))
        ],
    }


def score(df: DataFrame, model: PipelineModel, name: str = "probability_1") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction", "_raw", "features", *[c for c in out.columns if c.startswith("_f_")])


def evaluate(df: DataFrame, label: str = "label", probability: str = "probability_1", threshold: float = 0.5) -> dict:
    row = binary_counts(df, label, probability, threshold)
    row = row.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).first()
    return row.asDict()


def model_search(
    train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], label: str, weight: str | None = None, grid=None, parallel: int = 4
) -> tuple[DataFrame, PipelineModel]:
    """(one row per family with its best setting, the overall best model). Test is scored once per family.

    Preparation is fitted once per kind of input, not once per setting, and ``parallel`` settings of a family are fitted at a
    time; the choice is validation F1 + 0.08 recall, the earlier setting in a tie.
    """
    spark = train.sparkSession
    data = [clean(d, features).withColumn("label", F.col(label).cast("double")) for d in (train, valid, test)]
    weighted = balanced_weights(data[0], "label", weight)
    grid = grid or model_grid(weighted.agg(F.sum("_w")).first()[0] or 1.0)
    rows, best = [], None
    filled = Pipeline(stages=preprocessing(features, False)[:1]).fit(weighted)
    for scale in (True, False):
        families = {k: v for k, v in grid.items() if (k == "logistic_regression") == scale}
        if not families:
            continue
        prep = Pipeline(stages=[filled, *preprocessing(features, scale)[1:]]).fit(weighted)
        prep = PipelineModel(stages=[*filled.stages, *prep.stages[1:]])
        # Of the prepared tables, only what a model reads is held.
        ready = [prep.transform(d).select(*used).persist() for d, used in zip((weighted, *data[1:]), (["features", "label", "_w"], *[["features", "label"]] * 2))]
        for family, settings in families.items():

            def attempt(i: int, estimator, ready=ready) -> tuple:
                model = estimator.fit(ready[0])
                v = evaluate(score_ready(ready[1], model))
                return v["f1"] + 0.08 * v["recall"], -i, v, model

            with ThreadPoolExecutor(parallel) as pool:
                top = max(pool.map(attempt, range(len(settings)), settings), key=lambda t: t[:2])
            t = evaluate(score_ready(ready[2], top[3]))
            rows.append(
                (family, -top[1], float(top[0]), float(top[2]["f1"]), float(top[2]["recall"]), float(t["f1"]), float(t["recall"]))
            )
            full = PipelineModel(stages=[*prep.stages, top[3]])
            if best is None or top[0] > best[0]:
                best = (top[0], full)
        for d in ready:
            d.unpersist()
    schema = "family string, setting int, validation_score double, validation_f1 double, validation_recall double, test_f1 double, test_recall double"
    return spark.createDataFrame(rows, schema), best[1]


def score_ready(df: DataFrame, model) -> DataFrame:
    return model.transform(df).select("label", vector_to_array("probability")[1].alias("probability_1"))


def best_model(rows: DataFrame, families: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """First row by (F1, recall), or by (F1, small size) among some families."""
    pool = rows.filter(F.col("family").isin(families)) if families else rows
    order = order or ["-validation_f1", "-validation_recall", "family"]
    return pool.orderBy(*[F.col(o[1:]).desc() if o.startswith("-") else F.col(o) for o in order]).limit(1)


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree importances, or absolute coefficients of a linear model."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, float(abs(v))) for f, v in zip(features, values.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def surrogate_tree(cand: DataFrame, features: list[str], target: str, group: str, seed: int = 42, depth: int = 4) -> DataFrame:
    """A shallow tree that imitates a gate: grouped 60/20/20 split, one row of agreement per split."""
    from boxtrail.operators.splits import group_totals, grouped_split

    # Totals and split rows are read by a dozen jobs; only the columns in use are written, once each. A checkpoint keeps the rows'
    # partitions, which the tree's sample for its cuts depends on.
    totals = settle(
        group_totals(cand, group, {"total": F.count(F.lit(1)), "hit": F.count_if(F.col(target) == 1)}), "totals"
    )
    split = grouped_split(totals, group, ["total", "hit"], 20, seed, (0.60, 0.20, 0.20), required={"hit": "both"}, kind="rate")
    data = clean(cand.join(split, group), features).withColumn("label", F.col(target).cast("double"))
    data = materialize(data.select("split", "label", *features))
    train = balanced_weights(data.filter("split = 'train'"), "label")
    tree = DecisionTreeClassifier(maxDepth=depth, featuresCol="features", labelCol="label", weightCol="_w", seed=seed)
    model = Pipeline(stages=[*preprocessing(features, scale=False), tree]).fit(train)
    out = score(data, model)
    rows = binary_counts(out, "label", "probability_1", 0.5, ["split"])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return rows.withColumns({**prf(tp, fp, fn), "accuracy": (tp + tn) / (tp + fp + tn + fn)})


