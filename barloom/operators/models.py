"""Classifiers on feature tables: Spark ML pipelines, folds, attributions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.stats import confusion, rank_auc
from barloom.operators.boosting import Boosted, fit_boosted
from barloom.session import cut

FAMILIES = ("linear_baseline", "gbm")
#: Fits submitted at the same time.
PARALLEL_FITS = 4
# fixed values: columns that are never features
NOT_FEATURES = {
    "candidate_id", "session_date", "label", "outcome", "entry_time", "exit_time", "entry_price", "stop_price", "target_price",
    "exit_price", "bars_held", "mfe", "mae", "pnl_r", "prediction", "probability", "decision_sod", "trade_no", "session_no", "fold",
}


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Class weight n / (2 n_c); the class counts are two rows."""
    n = train.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")
    )
    w = F.when(F.col(label) == 1, F.col("n") / (2 * F.col("pos"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("pos"))))
    return train.crossJoin(F.broadcast(n)).withColumn("weight", w).drop("n", "pos")


def fit_classifier(train: DataFrame, cols: list[str], family: str = "linear_baseline", label: str = "label", rows: int | None = None, rounds: int = 200) -> PipelineModel | Boosted:
    """Median impute, standardize, balanced logistic; or median impute, boosted trees (``boosting.py``).

    The logistic penalty 1/n with class weights that sum to n is the usual
    unit-strength ridge objective divided by n.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown model family: {family}")
    if family == "gbm":
        return fit_boosted(train, cols, label=label, rounds=rounds)
    data = train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("double").alias(label))
    filled = [f"{c}__f" for c in cols]
    imputer = Imputer(strategy="median", inputCols=cols, outputCols=filled, relativeError=0.001)
    vector = VectorAssembler(inputCols=filled, outputCol="raw")
    data = balanced_weights(data, label)
    n = rows or data.count()
    tail = [
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=1000, regParam=1.0 / max(n, 1), standardization=False),
    ]
    return Pipeline(stages=[imputer, vector, *tail]).fit(data)


def score(model: PipelineModel | Boosted, rows: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """Rows with ``probability`` and ``prediction`` (existing ones replaced)."""
    keep = [c for c in rows.columns if c not in ("probability", "prediction")]
    data = rows.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in keep])
    if isinstance(model, Boosted):
        out = model.score(data)
    else:
        out = model.transform(data).select(*keep, vector_to_array(F.col("probability"))[1].alias("probability"))
    return out.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))


def split_metrics(scored: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, Brier and exact AUC."""
    by = by or []
    m = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("positive_rate"),
                                *[v.alias(k) for k, v in confusion("probability", label).items()])
    a = rank_auc(scored, "probability", label, by).drop("positives", "negatives")
    return m.join(a, by, "left") if by else m.crossJoin(F.broadcast(a))


def _diverse(df: DataFrame, label: str) -> bool:
    r = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    return r["lo"] is not None and r["lo"] != r["hi"]


def walk_forward_predictions(tagged: DataFrame, cols: list[str], *, family: str = "linear_baseline", label: str = "label", group: str = "fold") -> DataFrame:
    """Fit per fold on its training rows, score its test rows, stitch.

    The tagged table is materialised once; fits run from a small thread pool.
    ``group`` is ``fold`` or ``path_id``.
    """
    base = cut(tagged.filter(F.col("role").isin("train", "test")))
    groups = [r[0] for r in base.select(group).distinct().orderBy(group).collect()]  # one row per fold

    def one(g):
        mine = base.filter(F.col(group) == g)
        train, test = mine.filter(F.col("role") == "train"), mine.filter(F.col("role") == "test")
        if not (_diverse(train, label) and _diverse(test, label)):
            return None
        return score(fit_classifier(train, cols, family, label), test, cols)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = [p for p in pool.map(one, groups) if p is not None]
    if not parts:
        return base.limit(0).withColumns({"probability": F.lit(None).cast("double"), "prediction": F.lit(None).cast("int")})
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walk_forward_scores(spans: DataFrame, cols: list[str], *, label: str = "label") -> DataFrame:
    """Out-of-sample predictions of all folds of ``splits.fold_spans``, the linear models fitted in one job.

    Folds without both labels in training or in test have none.
    """
    from barloom.operators.many_fits import fit_many, predict_many

    folds = spans.agg(F.max("spans.train.hi")).first()[0] or 0
    zero = lambda n: F.array(F.struct((F.col(f"spans.{n}.lo") - 1).alias("lo"), (F.col(f"spans.{n}.hi") - 1).alias("hi")))
    base = cut(spans.select(*[c for c in spans.columns if c not in ("spans", "probability", "prediction")], zero("train").alias("train"), zero("test").alias("test")))
    fits = fit_many(base, cols, [str(i + 1) for i in range(folds)], label=label)
    preds = predict_many(base.drop("train"), fits, name="fold").withColumn("fold", F.col("fold").cast("int"))
    both = preds.groupBy("fold").agg(F.countDistinct(label).alias("n")).filter("n > 1").select("fold")
    return preds.join(both, "fold", "left_semi")


def walk_forward_check(scored: DataFrame, minimum: float = 0.55) -> DataFrame:
    """Mean fold AUC and its status; pending below two folds."""
    folds = split_metrics(scored, by=["fold"])
    return folds.agg(F.count("roc_auc").alias("fold_count"), F.avg("roc_auc").alias("mean_roc_auc")).withColumn(
        "status", F.when(F.col("fold_count") < 2, "pending").when(F.col("mean_roc_auc") >= minimum, "pass").otherwise("fail")
    )


def linear_attribution(model: PipelineModel, rows: DataFrame, cols: list[str], key: str = "candidate_id") -> DataFrame:
    """Additive attributions of the logistic model: coefficient times scaled feature.

    For a linear model these are the exact attributions around the mean.
    """
    coef = [float(x) for x in model.stages[-1].coefficients]
    data = rows.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    v = vector_to_array(F.col("features"))
    parts = model.transform(data).select(key, *[(v[i] * F.lit(w)).alias(c) for i, (c, w) in enumerate(zip(cols, coef))])
    return parts.unpivot([key], cols, "feature", "attribution")


def top_attributions(attr: DataFrame, k: int = 10) -> DataFrame:
    return attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution")).orderBy(
        F.col("mean_abs_attribution").desc(), "feature"
    ).limit(k)


def worst_trade_explanations(attr: DataFrame, trades: DataFrame, k: int = 5, top: int = 3, key: str = "candidate_id") -> DataFrame:
    """Strongest contributors of the ``k`` worst trades."""
    worst = trades.orderBy("pnl_r", key).limit(k).select(key, "session_date", "pnl_r")
    from barloom.functions.stats import top_k

    j = attr.join(F.broadcast(worst), key)
    return top_k(j, [key], [F.abs(F.col("attribution")).desc(), F.col("feature")], top)


def validity_prior(features: DataFrame, matched: DataFrame, cols: list[str], *, minimum: int = 20, key: str = "candidate_id") -> DataFrame:
    """Manual-validity probabilities on all features, defaults where unfit.

    ``matched``: candidate_id, manual_validity_label, manual_high_quality_label.
    """
    train = cut(features.join(matched, key))
    base = features.join(matched.select(key, F.lit(1.0).alias("__m")), key, "left").withColumn(
        "manual_example_matched", F.coalesce("__m", F.lit(0.0))
    ).drop("__m")
    targets = {"manual_validity_probability": ("manual_validity_label", 0.5), "manual_high_quality_probability": ("manual_high_quality_label", 0.0)}
    enough = train.count() >= minimum and all(_diverse(train, y) for y, _ in targets.values())
    out = base
    for name, (y, default) in targets.items():
        if enough:
            s = score(fit_classifier(train, cols, label=y), features, cols).select(key, F.col("probability").alias(name))
            out = out.join(s, key, "left").withColumn(name, F.coalesce(name, F.lit(default)))
        else:
            out = out.withColumn(name, F.lit(default))
    return out
