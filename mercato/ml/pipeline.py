"""Late-delivery classifier on Spark MLlib.

Distributed end to end: the feature frame comes from the delay-driver view,
the split is a per-row hash (no global sort), trees are grown by MLlib from
split statistics aggregated across executors, and every evaluation table
(report, confusion matrix, PR/ROC points, drift) is an aggregate or a
range-partitioned running total.  Only
fixed-size things reach the driver: class counts (2 numbers) and the model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.functions.hashing import BITS, id_bits
from mercato.operators.prefix import running_totals
from mercato.params import Params

# fixed values: the numeric features
NUMERIC = [
    "order_day_of_week", "order_hour", "order_month_num", "item_count", "seller_count", "order_value",
    "freight_value", "freight_ratio_pct", "avg_product_weight_g", "avg_product_volume_cm3",
    "seller_hist_late_rate", "seller_avg_days_to_deliver", "seller_total_orders", "approval_lag_hours",
]
CATEGORICAL = ["customer_state", "primary_category"]
# fixed values: the model's feature order (must match at scoring time)
FEATURES = NUMERIC + ["customer_state_enc", "primary_category_enc"]


# ------------------------------------------------------------ M1, M4, M5, M8 preparation
def model_frame(dd: DataFrame, p: Params) -> DataFrame:
    """M1: rows with a known approval lag; NULL category -> 'unknown'; label."""
    x = dd.filter(F.col("approval_lag_hours").isNotNull())
    return x.select(
        "order_id",
        F.col("is_late").cast("int").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        "customer_state",
        F.coalesce("primary_category", F.lit(p.ml_unknown_category)).alias("primary_category"),
    )


SPLIT_BUCKETS = 16  # bits of the hash that the split counts


def split_bucket(p: Params, key: str = "order_id") -> Column:
    """Leading bits of the id's salted hash: the place of a row in the split."""
    return F.shiftright(id_bits(key, f"split{p.seed}"), BITS - SPLIT_BUCKETS)


def split_cuts(df: DataFrame, p: Params) -> DataFrame:
    """Per class, the last bucket of the test side: as many whole buckets as
    hold at most the test fraction of that class.  At most 2^16 counts per
    class are ordered, whatever the number of rows."""
    counts = df.groupBy("label", split_bucket(p).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy("label"))
    return counts.select("label", "bucket", upto.alias("upto"), total.alias("total")).groupBy("label").agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.round(F.col("total") * p.test_fraction), F.col("bucket"))),
                   F.lit(-1)).alias("cut"))


def with_split(df: DataFrame, p: Params) -> DataFrame:
    """M4: ``df`` with is_test, drawn within each class by the id's hash."""
    cuts = F.broadcast(split_cuts(df, p))  # one row per class
    return df.join(cuts, "label").withColumn("is_test", split_bucket(p) <= F.col("cut")).drop("cut")


def stratified_split(df: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """M4: (train, test), the test fraction of each class."""
    x = with_split(df, p)
    return x.filter(~F.col("is_test")).drop("is_test"), x.filter("is_test").drop("is_test")


def temporal_split(df: DataFrame, ts: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """M5: train on orders purchased before `cutoff`, test on the rest."""
    x = df.join(ts.select("order_id", "order_purchase_timestamp"), "order_id")
    before = F.col("order_purchase_timestamp") < F.lit(cutoff)
    return x.filter(before).drop("order_purchase_timestamp"), x.filter(~before).drop("order_purchase_timestamp")


def with_balanced_weights(train: DataFrame) -> DataFrame:
    """M8: weight = N / (2 * N_class), from the training rows only."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(Window.partitionBy())  # two rows
    w = counts.select("label", (total / (F.lit(2.0) * F.col("n_class"))).alias("weight"))
    return train.join(F.broadcast(w), "label")  # two rows: bounded by the number of classes


# ------------------------------------------------------------ M2, M3, M6, M7, M9 pipelines
def _encoders() -> list:
    idx = StringIndexer(
        inputCols=CATEGORICAL, outputCols=[f"{c}_idx" for c in CATEGORICAL],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    # Codes are used as numbers, like the reference's label encoding: the cast
    # drops the nominal metadata so the trees split them as ordered values.
    numeric_codes = SQLTransformer(statement=(
        "SELECT *, CAST(customer_state_idx AS DOUBLE) AS customer_state_enc, "
        "CAST(primary_category_idx AS DOUBLE) AS primary_category_enc FROM __THIS__"))
    return [idx, numeric_codes, VectorAssembler(inputCols=FEATURES, outputCol="features")]


def tree_counts(num_trees: int, at_once: int) -> list[int]:
    """Trees of each fit: as few fits as hold ``at_once`` trees at most, of even size."""
    fits = max(1, -(-num_trees // at_once))
    return [num_trees // fits + (i < num_trees % fits) for i in range(fits)]


#: Between the seeds of two fits: each fit also uses the seeds after its own, one a partition.
SEED_STEP = 1_000_003


def forest_pipeline(p: Params, num_trees: int = 300) -> Pipeline:
    """The trees are grown by several fits, each with a seed and output columns of its own: every task of a fit
    gets a copy of the trees that are being split, with the statistics of all their nodes.  `probabilities` takes
    the mean over all trees."""
    forests = [
        RandomForestClassifier(
            labelCol="label", featuresCol="features", weightCol="weight", numTrees=n, maxDepth=12,
            minInstancesPerNode=20, featureSubsetStrategy="sqrt", impurity="gini", seed=p.seed + i * SEED_STEP,
            maxBins=p.forest_max_bins,
            # a pass splits as many nodes as this memory holds, in every task; a row's nodes are found
            # by walking the trees, since cached they take four bytes a tree and row and are made anew by each pass
            maxMemoryInMB=p.forest_node_memory_mb, cacheNodeIds=False,
            **({f"{c}Col": f"{c}_{i}" for c in ("prediction", "rawPrediction", "probability")} if i else {}),
        )
        for i, n in enumerate(tree_counts(num_trees, p.forest_trees_at_once))
    ]
    return Pipeline(stages=[*_encoders(), *forests])


def forests(model: PipelineModel) -> list[RandomForestClassificationModel]:
    return [x for x in model.stages if isinstance(x, RandomForestClassificationModel)]


def logistic_pipeline(p: Params, weight_sum: float) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    # sklearn's default L2 with C = 1 on a weighted sum of losses corresponds to
    # regParam = 1 / sum(weights) in MLlib's averaged objective.
    lr = LogisticRegression(
        labelCol="label", featuresCol="scaled", weightCol="weight", maxIter=1000, regParam=1.0 / weight_sum,
        elasticNetParam=0.0, standardization=False,
    )
    return Pipeline(stages=[*_encoders(), scaler, lr])


@dataclass
class Fitted:
    forest: PipelineModel
    logistic: PipelineModel | None
    train: DataFrame
    test: DataFrame
    seconds: dict | None = None


def _without_summary(model: PipelineModel) -> PipelineModel:
    """The model without its training summaries, which hold the session: a session that has observed a write
    cannot be sent to the tasks."""
    for stage in [*forests(model), model.stages[-1]]:
        fitted = stage._java_obj
        if fitted.hasSummary():
            fitted.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


#: Training rows that one task goes over, if there are more than the tasks that run at a time hold.
TASK_ROWS = 1_000_000


def dealt_for_fits(train: DataFrame) -> DataFrame:
    """``train`` in as many parts as tasks run at a time, or a multiple of that if they held over ``TASK_ROWS`` rows.
    Each task of a fit's pass makes and shuffles the split statistics of all nodes of the pass, so more and smaller
    tasks than that only repeat them.  Nothing is shuffled, and few parts stay as they are."""
    at_once = train.sparkSession.sparkContext.defaultParallelism
    return train.coalesce(at_once * max(1, -(-train.count() // (at_once * TASK_ROWS))))


def fit(df: DataFrame, p: Params, logistic: bool = True, num_trees: int = 300, split=None) -> Fitted:
    """The rows are encoded once, and every fit reads these: what a fit leaves behind, as its training summary, which
    holds the session, is in no plan of the next."""
    import time

    train, test = split or stratified_split(df, p)
    train_w = dealt_for_fits(with_balanced_weights(train)).cache()
    wsum = train_w.agg(F.sum("weight")).first()[0]  # also materialises the cached training rows
    t = time.perf_counter()
    encoders = Pipeline(stages=_encoders()).fit(train_w)
    encoded = encoders.transform(train_w).select("label", "weight", "features").cache()
    encoded.count()
    train_w.unpersist()
    seconds = {"encoding": time.perf_counter() - t}
    t = time.perf_counter()
    grown = [x.fit(encoded) for x in forest_pipeline(p, num_trees).getStages()[len(encoders.stages):]]
    forest = _without_summary(PipelineModel([*encoders.stages, *grown]))
    seconds["forest_fit"] = time.perf_counter() - t
    lr_model = None
    if logistic:
        t = time.perf_counter()
        scaled = Pipeline(stages=logistic_pipeline(p, wsum).getStages()[len(encoders.stages):]).fit(encoded)
        lr_model = _without_summary(PipelineModel([*encoders.stages, *scaled.stages]))
        seconds["logistic_fit"] = time.perf_counter() - t
    encoded.unpersist()
    return Fitted(forest, lr_model, train, test, seconds=seconds)


# ------------------------------------------------------------ M10-M17 evaluation and scoring
def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with p_late, the probability of the late class."""
    out = model.transform(df)
    late = {x: vector_to_array(x.getProbabilityCol())[1] for x in forests(model)}
    if len(late) > 1:  # the mean over all trees
        trees = sum(x.getNumTrees for x in late)
        p_late = sum((p * F.lit(float(x.getNumTrees)) for x, p in late.items()), F.lit(0.0)) / F.lit(float(trees))
    else:
        p_late = vector_to_array("probability")[1]
    return out.select(*df.columns, p_late.alias("p_late"))


def flagged(scored: DataFrame, threshold: float) -> DataFrame:
    """The 0/1 flag of each score at ``threshold``."""
    return scored.withColumn("flag", (F.col("p_late") >= threshold).cast("int"))


def score(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    """Probabilities and the 0/1 flag at `threshold`."""
    return flagged(probabilities(model, df), threshold)


def auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve, one row, from the curve's counts:
    each negative counts the positives above it, and half of those beside it."""
    c = curve_counts(scored)
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return c.agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum(neg)).alias("auc"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """M12."""
    return scored.groupBy("label", F.col("flag").alias("prediction")).agg(
        F.count(F.lit(1)).cast("long").alias("count"))


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, from
    four conditional counts."""
    c = scored.agg(
        F.count(F.when((F.col("label") == 1) & (F.col("flag") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("label") == 0) & (F.col("flag") == 1), 1)).alias("fp"),
        F.count(F.when((F.col("label") == 1) & (F.col("flag") == 0), 1)).alias("fn"),
        F.count(F.when((F.col("label") == 0) & (F.col("flag") == 0), 1)).alias("tn"),
    )

    def prf(tp, fp, fn, name, support):
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        return c.select(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1"), support.cast("long").alias("support"),
                        F.try_divide(F.col("tp") + F.col("tn"),
                                     F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return prf(tn, fn, fp, "On Time", tn + fp).unionByName(prf(tp, fp, fn, "Late", tp + fn))


def curve_counts(scored: DataFrame) -> DataFrame:
    """One row per distinct score: its rows (n, pos) and the positives and rows
    at or above it (tp, flagged)."""
    by_score = scored.groupBy(F.col("p_late").alias("threshold")).agg(
        F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    return running_totals(by_score, [F.col("threshold").desc()], {"tp": "pos", "flagged": "n"})


def curve_table(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1, TPR and FPR with every distinct score as
    the threshold, exactly as scoring applies it (p_late >= threshold)."""
    c = curve_counts(scored)
    totals = scored.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("all"))
    x = c.select("*", totals.select("p").scalar().alias("p"), totals.select("all").scalar().alias("all"))
    prec = F.col("tp") / F.col("flagged")
    rec = F.when(F.col("p") > 0, F.col("tp") / F.col("p"))
    negatives = F.col("all") - F.col("p")
    return x.select(
        "threshold", prec.alias("precision"), rec.alias("recall"),
        (2 * prec * rec / (prec + rec + F.lit(1e-9))).alias("f1"),
        rec.alias("tpr"), F.when(negatives > 0, (F.col("flagged") - F.col("tp")) / negatives).alias("fpr"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """Threshold of maximum F1 (ties: the higher threshold)."""
    return curve.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                              F.struct("f1", "threshold")).alias("b")).select("b.*")


def feature_importance(model: PipelineModel) -> DataFrame:
    """Impurity importances zipped with the feature names, sorted: the mean over all trees."""
    from pyspark.sql import SparkSession

    parts = forests(model)
    total = sum(x.featureImportances.toArray() * x.getNumTrees for x in parts) / sum(x.getNumTrees for x in parts)
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(FEATURES, total)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


def gate_status(auc_value: float | None, baseline_auc: float | None = None) -> str:
    """Quality gates as a status value (no exception)."""
    if auc_value is None or auc_value < 0.60:
        return "STOP"
    if baseline_auc is not None and auc_value <= baseline_auc:
        return "NOT_BETTER_THAN_BASELINE"
    if auc_value < 0.70:
        return "WEAK"
    return "OK"


def daily_top_risk(scored: DataFrame, ts: DataFrame, k: int, buckets: int = 64) -> DataFrame:
    """The k riskiest orders of each purchase day.

    Exact two-phase top-k: rank inside (day, hash bucket of the order) and keep
    k per bucket, then rank the at most buckets * k survivors of each day.  A
    busy day is split over `buckets` window partitions instead of one."""
    x = scored.join(ts.select("order_id", F.to_date("order_purchase_timestamp").alias("day")), "order_id")
    order = [F.col("p_late").desc(), F.col("order_id")]
    x = x.withColumn("_b", F.pmod(F.xxhash64("order_id"), F.lit(buckets)))
    local = x.withColumn("_r", F.row_number().over(Window.partitionBy("day", "_b").orderBy(*order)))
    cand = local.filter(F.col("_r") <= k)
    w = Window.partitionBy("day").orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "day", "rank", "order_id", "p_late", "flag")


def psi(values: DataFrame, col: str, period_col: str, edges: list[float], eps: float = 1e-6) -> DataFrame:
    """Population stability index of `col` between period 0 (expected) and
    period 1 (actual) over fixed bins."""
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(col) >= e).cast("int")
    h = values.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.when(F.col(period_col) == 0, 1)).alias("e"), F.count(F.when(F.col(period_col) == 1, 1)).alias("a"))
    tot = Window.partitionBy()  # one row per bin
    pe = F.greatest(F.col("e") / F.sum("e").over(tot), F.lit(eps))
    pa = F.greatest(F.col("a") / F.sum("a").over(tot), F.lit(eps))
    return h.select("bin", ((pa - pe) * F.log(pa / pe)).alias("term")).agg(F.sum("term").alias("psi"))


def cold_start(scored: DataFrame, p: Params) -> DataFrame:
    """Flag orders whose seller has fewer than `cold_start_orders` orders."""
    return scored.withColumn("cold_start_seller", F.col("seller_total_orders") < p.cold_start_orders)


# ------------------------------------------------------------ S9 / S10 artefacts
def save_model(model: PipelineModel, path: str) -> None:
    """One directory holds encoders, assembler (with the ordered feature list)
    and the forest; overwrite keeps the save idempotent."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
