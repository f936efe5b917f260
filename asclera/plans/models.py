"""Model training, evaluation, registry, scoring and anomaly detection."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, IndexToString, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..operators import joins, ranges
from ..session import kept

FOREST_SAMPLE = 256


def stuck_label(rate: str, weight: str, hookload: str, torque: str, limits: Sequence[float] = (5, 5, 1, 150, 10)) -> Column:
    """1 where sensor readings show a stuck pipe; the first rule that holds decides.

    Rule one: no progress with weight and torque. Rule two: little progress with
    high hookload and torque.
    """
    w, t1, r, h, t2 = limits
    still = (F.col(rate) == 0) & (F.col(weight) > w) & (F.col(torque) > t1)
    slow = (F.col(rate) < r) & (F.col(hookload) > h) & (F.col(torque) > t2)
    return F.when(still, 1).when(slow, 1).otherwise(0)


def task_type(df: DataFrame, target: str) -> DataFrame:
    """classification when the target has at most 20 values in under a tenth of the rows."""
    one = df.agg(F.count_distinct(target).alias("distinct_values"), F.count("*").alias("rows"))
    few = (F.col("distinct_values") <= 20) & (F.col("distinct_values") < F.col("rows") * 0.1)
    return one.withColumn("task", F.when(few, "classification").otherwise("regression"))


def split(df: DataFrame, key: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by key hash, independent of partitioning."""
    return joins.split_by_key(df, key, round(100 * (1 - test_share)))


#: Rows that a task of a training holds at a time, on average.
TASK_ROWS = 500_000
#: Working columns of a model, so that a table may have columns of any other name.
_WORK = "_model_"


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _training_rows(df: DataFrame, features: Sequence[str], label: Column, name: str, at_most: int | None = None) -> DataFrame:
    """Features and label of the rows that have one, computed once for all passes of the training.

    A pass of the tree training holds a whole partition as objects, so no partition has
    many more than TASK_ROWS rows, however large the splits of the table are. Rows are
    counted unless the caller knows that there are ``at_most`` so many.
    """
    rows = df.select(*[F.col(_quoted(f)) for f in dict.fromkeys(features)], label.alias(name)).filter(F.col(name).isNotNull())
    parts = -(-(rows.count() if at_most is None else at_most) // TASK_ROWS)
    return kept(rows.repartition(parts) if parts > 1 else rows)


def _pipeline(rows: DataFrame, features: Sequence[str], model, after: Sequence = ()) -> PipelineModel:
    """Features of any numeric or boolean type as doubles; missing ones become the mean of the training rows.

    So no row is lost in training or scoring. All columns made on the way have private names.
    """
    read = [f"{_WORK}in_{i}" for i in range(len(features))]
    filled = [f"{_WORK}filled_{i}" for i in range(len(features))]
    cast = ", ".join(f"CAST({_quoted(f)} AS DOUBLE) AS {name}" for f, name in zip(features, read))
    model.setFeaturesCol(f"{_WORK}features").setLabelCol(f"{_WORK}label")
    for name in ("rawPrediction", "probability"):
        if model.hasParam(f"{name}Col"):
            model.set(model.getParam(f"{name}Col"), f"{_WORK}{name}")
    stages = [
        SQLTransformer(statement=f"SELECT *, {cast} FROM __THIS__"),
        Imputer(inputCols=read, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol=f"{_WORK}raw"),
        StandardScaler(inputCol=f"{_WORK}raw", outputCol=f"{_WORK}features", withMean=True, withStd=True),
        model,
    ]
    return Pipeline(stages=[*stages, *after]).fit(rows)


def _classified(df: DataFrame, target: str, features: Sequence[str], choose, at_most: int | None = None) -> PipelineModel:
    """Learn classes of any type; the prediction is the class itself (a number where the target is one)."""
    known = _training_rows(df, features, F.col(_quoted(target)).cast("string"), f"{_WORK}target", at_most)
    index = StringIndexer(inputCol=f"{_WORK}target", outputCol=f"{_WORK}label", stringOrderType="alphabetAsc").fit(known)
    kind = df.schema[target].dataType
    named = f"{_WORK}named"
    made = f"CAST(CAST({named} AS BOOLEAN) AS DOUBLE)" if isinstance(kind, T.BooleanType) else f"CAST({named} AS DOUBLE)"
    after = [
        IndexToString(inputCol=f"{_WORK}class", outputCol=named, labels=index.labels),
        SQLTransformer(statement=f"SELECT *, {made if isinstance(kind, (T.NumericType, T.BooleanType)) else named} AS {_WORK}prediction FROM __THIS__"),
    ]
    return _pipeline(index.transform(known), features, choose(len(index.labels)).setPredictionCol(f"{_WORK}class"), after)


def train(
    df: DataFrame, target: str, features: Sequence[str], task: str, trees: int = 20, depth: int = 5, seed: int = 42, at_most: int | None = None
) -> PipelineModel:
    """Scaling and boosted trees; more than two classes use a random forest.

    Classes may be numbers or texts. Rows whose target is null are not learned from.
    ``at_most`` is a known bound of the number of rows, which need not be counted then.
    """
    if task == "regression":
        known = _training_rows(df, features, F.col(_quoted(target)).cast("double"), f"{_WORK}label", at_most)
        return _pipeline(known, features, GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, predictionCol=f"{_WORK}prediction"))

    def choose(classes: int):
        if classes <= 2:
            return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)

    return _classified(df, target, features, choose, at_most)


def train_forest(df: DataFrame, target: str, features: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    return _classified(df, target, features, lambda _: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """All rows with their ``prediction``, which replaces a column of that name; working columns are dropped."""
    made = model.transform(df).withColumn("prediction", F.col(f"{_WORK}prediction"))
    return made.drop(*[c for c in made.columns if c.startswith(_WORK)])


def classification_metrics(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Accuracy and weighted precision, recall and F1, from the confusion counts."""
    kind = "string" if isinstance(predictions.schema[label].dataType, T.StringType) else "double"
    cells = predictions.groupBy(F.col(label).cast(kind).alias("y"), F.col(prediction).cast(kind).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("actual"), F.sum(hit).alias("hits"))
    predicted = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = actual.join(predicted, "c", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    weighted = lambda c: F.sum(c * F.col("actual")) / F.sum("actual")
    return per.agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def regression_metrics(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """mse, mae, r2 and rmse in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    one = predictions.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("_v"))
    return one.select("mse", "mae", (1 - F.try_divide("mse", "_v")).alias("r2"), F.sqrt("mse").alias("rmse"))


def confusion(predictions: DataFrame, label: str, classes: Sequence, prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(label).pivot(prediction, list(classes)).count().na.fill(0)


def register(model: PipelineModel, folder: str, name: str, version: str, metrics: DataFrame) -> str:
    """Store the model and its metrics under folder/name/version; metrics as name and value rows."""
    place = f"{folder}/{name}/{version}"
    model.write().overwrite().save(f"{place}/model")
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
    metrics.select(F.lit(name).alias("model"), F.lit(version).alias("version"), F.inline(rows)).write.mode("overwrite").parquet(f"{place}/metrics")
    return place


def load(place: str) -> PipelineModel:
    return PipelineModel.load(f"{place}/model")


def importances(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Tree importance per feature next to the rows it was learnt on."""
    weights = next(s for s in model.stages if hasattr(s, "featureImportances")).featureImportances.toArray()
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(w)).alias("importance")) for f, w in zip(features, weights)])
    return df.agg(F.count("*").alias("rows")).select("rows", F.inline(rows))


def _nodes(node) -> dict:
    """A fitted tree as nested dicts; ``cover`` is the number of training rows of a node."""
    found = {"cover": float(node.impurityStats().count()), "value": float(node.prediction()), "stats": [float(x) for x in node.impurityStats().stats()]}
    if node.subtreeDepth():
        split = node.split()
        found |= {"feature": split.featureIndex(), "at": float(split.threshold()), "left": _nodes(node.leftChild()), "right": _nodes(node.rightChild())}
    return found


def _leaves(node: dict, value, steps: tuple = ()) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, feature -> (lower bound, upper bound, share of training rows)) of every leaf of a tree."""
    if "feature" not in node:
        bounds: dict[int, tuple[float, float, float]] = {}
        for feature, low, high, share in steps:
            a, b, s = bounds.get(feature, (-np.inf, np.inf, 1.0))
            bounds[feature] = (max(a, low), min(b, high), s * share)
        yield value(node), bounds
        return
    for side, low, high in (("left", -np.inf, node["at"]), ("right", node["at"], np.inf)):
        share = node[side]["cover"] / node["cover"]
        yield from _leaves(node[side], value, (*steps, (node["feature"], low, high, share)))


def shapley_values(leaves: Sequence[tuple[float, dict]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values of every row of ``x`` and the value without any feature, for the sum of leaves.

    A leaf is a product over its features: 1 or 0 for a known feature that leads there
    or not, the share of training rows for an unknown one. The products over all sets
    of known features of one size are the coefficients of a polynomial, so a leaf
    costs the square of its number of features, not a power of two.
    """
    out, base = np.zeros(x.shape), 0.0
    for value, bounds in leaves:
        features = list(bounds)
        share = np.array([bounds[f][2] for f in features])
        base += value * float(np.prod(share))
        leads = np.array([(x[:, f] > bounds[f][0]) & (x[:, f] <= bounds[f][1]) for f in features], float)
        many = len(features)
        weights = [math.factorial(k) * math.factorial(many - k - 1) / math.factorial(many) for k in range(many)]
        for i, f in enumerate(features):
            known = [np.ones(len(x))]  # by the number of other features that are known
            for j in range(many):
                if j != i:
                    known = [
                        (known[k] * share[j] if k < len(known) else 0.0) + (known[k - 1] * leads[j] if k else 0.0) for k in range(len(known) + 1)
                    ]
            out[:, f] += value * (leads[i] - share[i]) * sum(w * c for w, c in zip(weights, known))
    return out, base


def _forest_leaves(model, class_index: int) -> list[tuple[float, dict]]:
    """The leaves of all trees, whose values add up to the raw score: of boosted trees the margin or value, of a forest the share of votes."""
    found = []
    boosted = isinstance(model, (GBTClassificationModel, GBTRegressionModel))
    for tree, weight in zip(model.trees, model.treeWeights if boosted else [1 / len(model.trees)] * len(model.trees)):
        value = (lambda n, w=weight: w * n["value"]) if boosted else (lambda n, w=weight: w * n["stats"][class_index] / sum(n["stats"]))
        found += _leaves(_nodes(tree._call_java("rootNode")), value)
    return found


def attributions(model: PipelineModel, df: DataFrame, features: Sequence[str], class_index: int = 1) -> DataFrame:
    """All rows with ``attributions``, a struct of a number per feature, and ``base``; together they are the row's raw score.

    The raw score is the margin of boosted classification trees, the value of boosted
    regression trees, and the probability of class ``class_index`` of a forest. Values
    are path-dependent Shapley values over the fitted trees, computed in Arrow batches;
    the trees are as large as training made them, not as the table. Missing features
    are those that the model filled in.
    """
    at = next(i for i, s in enumerate(model.stages) if hasattr(s, "trees"))
    leaves = _forest_leaves(model.stages[at], class_index)
    ready = PipelineModel(model.stages[:at]).transform(df.drop(*[c for c in df.columns if c.startswith(_WORK)]))
    p = len(features)

    @F.pandas_udf("array<double>")
    def explain(column: pd.Series) -> pd.Series:
        x = np.stack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, p))
        return pd.Series(list(shapley_values(leaves, x)[0]))

    base = shapley_values(leaves, np.zeros((0, p)))[1]
    values = ready.withColumn(f"{_WORK}values", explain(vector_to_array(f"{_WORK}features")))
    struct = F.struct(*[F.col(f"{_WORK}values")[i].alias(f) for i, f in enumerate(features)])
    made = values.withColumns({"attributions": struct, "base": F.lit(float(base))})
    return made.drop(*[c for c in made.columns if c.startswith(_WORK)])


def attribution_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], class_index: int = 1) -> DataFrame:
    """Mean absolute attribution per feature over all rows."""
    rows = attributions(model, df, features, class_index)
    at = lambda f: F.col("attributions").getField(f)
    one = rows.agg(F.count("*").alias("rows"), *[F.avg(F.abs(at(f))).alias(f"_{i}") for i, f in enumerate(features)])
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f"_{i}").alias("importance")) for i, f in enumerate(features)]
    return one.select("rows", F.inline(F.array(*pairs)))


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """Rise of the squared error when one feature is shuffled, per feature.

    A feature is shuffled by pairing rows in key order with rows in hash order, both
    numbered without a one-task window.
    """
    # only what the model reads is numbered and kept
    read = model.stages[0].getStatement()
    used = [c for c in df.columns if c == label or _quoted(c) in read]
    base = ranges.row_numbers(df, [key], "_n", keep=used)
    base_error = regression_metrics(score(model, df), label).select("mse").scalar()
    out = None
    for i, f in enumerate(features):
        mixed = df.select(F.col(f).alias("_other"), F.xxhash64(F.col(key), F.lit(i)).alias("_h"), F.col(key).alias("_k"))
        pairs = ranges.row_numbers(mixed, ["_h", "_k"], "_n", keep=["_other"])
        shuffled = base.join(pairs, "_n").withColumn(f, F.col("_other")).drop("_other", "_n")
        one = regression_metrics(score(model, shuffled), label).select(F.lit(f).alias("feature"), (F.col("mse") - base_error).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out


def build(df: DataFrame, target: str, key: str, exclude: Sequence[str] = (), **options) -> DataFrame:
    """Choose the task and features, train, score the holdout and return its metrics."""
    found = task_type(df, target).first()
    task = found["task"]
    features = naming.numeric_columns(df, target, [key, *exclude])
    train_rows, test_rows = split(df, key)
    model = train(train_rows, target, features, task, **{"at_most": found["rows"], **options})
    scored = score(model, test_rows)
    metrics = classification_metrics(scored, target) if task == "classification" else regression_metrics(scored, target)
    return metrics.select(F.lit(task).alias("task"), F.lit(len(features)).alias("features"), "*")


# ---- anomaly detection -------------------------------------------------------------


def _path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow(points: np.ndarray, depth: int, rng: np.random.Generator) -> list:
    """Random cuts; a missing value lies on the right of every cut."""
    known = [points[:, i][~np.isnan(points[:, i])] for i in range(points.shape[1])]
    usable = [i for i, v in enumerate(known) if len(v) and v.max() > v.min()]
    if depth == 0 or len(points) <= 1 or not usable:
        return [float(len(points))]
    f = int(rng.choice(usable))
    at = float(rng.uniform(known[f].min(), known[f].max()))
    left = points[:, f] < at
    return [f, at, _grow(points[left], depth - 1, rng), _grow(points[~left], depth - 1, rng)]


def _depths(tree: list, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _path_norm(tree[0]))
    out = np.empty(len(x))
    left = x[:, tree[0]] < tree[1]
    out[left] = _depths(tree[2], x[left], depth + 1)
    out[~left] = _depths(tree[3], x[~left], depth + 1)
    return out


def isolation_scores(df: DataFrame, key: str, features: Sequence[str], trees: int = 100, seed: int = 42, sample: int = FOREST_SAMPLE) -> DataFrame:
    """Anomaly score per row from an isolation forest.

    Each tree learns from its own ``sample`` rows (all, if there are fewer), drawn
    by hashes of key and tree over all rows and grown in a task of its own. Trees hold
    at most two nodes per row, so the forest is small enough to travel with the
    scoring function. Every row is scored; a missing feature lies right of every cut.
    """
    names = list(features)
    values = F.array(*[F.col(f).cast("double") for f in names])
    # a third more than needed is drawn by hash, and cut to the smallest hashes per tree
    share = min(1.0, 4 / 3 * sample / max(1, df.count()))
    drawn = df.select(values.alias("x"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = drawn.withColumn("h", F.pmod(F.xxhash64("k", "tree", F.lit(seed)), F.lit(1 << 40))).filter(F.col("h") <= share * (1 << 40)).drop("k")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        chosen = rows.sort_values("h").head(sample)["x"]
        points = np.array([[np.nan if v is None else v for v in x] for x in chosen], dtype="float64")
        grown = _grow(points, math.ceil(math.log2(max(len(points), 2))), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "size": [len(points)], "grown": [json.dumps(grown)]})

    rows = drawn.groupBy("tree").applyInPandas(grow, "tree int, size int, grown string").orderBy("tree").collect()  # one row per tree
    forest = [(json.loads(r["grown"]), _path_norm(r["size"])) for r in rows]

    @F.pandas_udf("double")
    def anomaly(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            x = np.column_stack([c.to_numpy(dtype="float64") for c in columns]) if len(columns[0]) else np.empty((0, len(columns)))
            # a tree of one row tells nothing apart and counts as average
            parts_of = [_depths(t, x) / norm if norm else np.ones(len(x)) for t, norm in forest]
            yield pd.Series(np.power(2.0, -np.mean(parts_of, axis=0) if parts_of else np.ones(len(x))))

    return df.withColumn("anomaly_score", anomaly(*[F.col(f).cast("double") for f in names]))


def anomalies(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Flag the share of rows with the highest scores; the cut is an exact quantile."""
    cut = ranges.exact_quantile(scored, "anomaly_score", 1 - contamination)
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut))


def prediction_log(predictions: DataFrame, model: str, version: str, as_of) -> DataFrame:
    """Prediction rows with model, version and time for an append-only log."""
    return predictions.withColumns(
        {"model": F.lit(model), "version": F.lit(version), "scored_at": F.lit(str(as_of)).cast("timestamp_ntz")}
    )




# ---- latent spaces ----------------------------------------------------------------


def as_vectors(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vector)))


def silhouettes(df: DataFrame, vector: str, groups: dict[str, Column]) -> DataFrame:
    """Silhouette of each grouping by squared distance, and label minus batch as integration score.

    The closed form over cluster sums is used, so no pair of points is compared.
    """
    rows = as_vectors(df, vector)
    found = {}
    for name, group in groups.items():
        scored = rows.withColumn("prediction", group.cast("int"))
        found[name] = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(scored)
    names = list(found)
    out = df.agg(F.count("*").alias("points")).select("points", *[F.lit(found[n]).alias(f"silhouette_{n}") for n in names])
    if {"label", "batch"} <= set(names):
        out = out.withColumn("integration_score", F.col("silhouette_label") - F.col("silhouette_batch"))
    return out


def clusters(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Cluster number of each point."""
    rows = as_vectors(df, vector)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("features")
