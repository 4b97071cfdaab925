"""Named queries over the test tables, one or more per operator.

Each takes (spark, folder) and returns a DataFrame over whole tables. The tables have no
gaps in the columns used, so queries about gaps blank out values by a fixed rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranking, scalar
from .functions.hashing import arithmetic_unit
from .operators import calibrate, confusion, crossval, explain, features, folds, labelarrays, labels, metrics
from .operators import models, multilabel, quantiles, rankmetrics, scores, scoring, select, sparse, tune, validate, weights
from .operators.boosting import BoostOptions, JointBooster
from .operators.features import FeatureModel, FeatureOptions
from .plans import predict, train
from .plans.config import make_config
from .session import new_path, written
from .sources import artifacts, csv, generated, publish

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals by a rule every engine computes alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- frames shared by several queries --------------------------------------------------


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem measurements with values blanked out by key."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")).alias("discount"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_returnflag")).alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


KEYS = ["l_orderkey", "l_linenumber"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with the document columns used as features; the text itself is not read."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id")


def judged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order status against a fixed rule."""
    rule = (
        F.when(F.col("o_totalprice") > 300000.0, "F")
        .when(F.col("o_orderkey") % 3 == 0, "O")
        .otherwise("P")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("y"), rule.alias("pred")
    )


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A binary truth with a score full of ties."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 3.0 + F.col("l_quantity") / 100.0).alias("score"),
    )


def shares(*scores: Column) -> Column:
    total = sum(scores[1:], scores[0])
    return F.array(*[s / total for s in scores])


def class_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes A, N, R as 0, 1, 2 with a probability array."""
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"),
        shares(
            F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0 + 0.1, F.col("l_tax") * 12.0 + 0.1
        ).alias("proba"),
    )


STATUS_NAMES = ["Filled_Late", "On_Time", "Partly_Sent"]


def class_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A probability array of three classes per order."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        shares(
            F.col("o_totalprice") / 500000.0,
            (F.col("o_custkey") % 97 + 1) / 97.0,
            (F.col("o_orderkey") % 101 + 1) / 101.0,
        ).alias("proba"),
    )


def multilabel_rows(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select(
        "doc_id",
        "quality",
        "toxic",
        (F.col("n_chars") > 1000).cast("int").alias("pred_quality"),
        (F.col("n_chars") % 5 == 0).cast("int").alias("pred_toxic"),
        (F.col("n_chars") / 20000.0).alias("score_quality"),
        (F.col("n_chars") % 100 / 100.0).alias("score_toxic"),
    )


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem columns stretched to the ranges of the rule thresholds."""
    return table(spark, sf, "lineitem").select(
        *KEYS,
        (F.col("l_quantity") * 3.0 - 10.0).alias("age"),
        (F.col("l_discount") * 300.0 + 15.0).alias("bmi"),
        (F.col("l_tax") * 500.0 + 60.0).alias("heart_rate"),
        (F.col("l_extendedprice") / 1000.0 + 80.0).alias("blood_pressure"),
        (F.col("l_partkey") % 250 + 100.0).alias("cholesterol"),
    )


ATTRIBUTION_NAMES = ["quantity", "discount", "price"]
ATTRIBUTION_COEFFICIENTS = [0.8, -25.0, 0.0001]


def attributed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Linear attribution with fixed coefficients around the table means.

    A line has no key of its own, so the lines of an order are taken together.
    """
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.max("l_extendedprice").alias("price")
    )
    columns = [F.col(c) for c in ATTRIBUTION_NAMES]
    means = list(li.agg(*[F.avg(c) for c in columns]).first())
    return explain.linear_attribution(li, columns, ATTRIBUTION_COEFFICIENTS, means, "attribution").select("row_id", "attribution")


def attributed_long(spark: SparkSession, sf: str) -> DataFrame:
    return explain.to_long(attributed_lines(spark, sf), "row_id", "attribution", ATTRIBUTION_NAMES)


# --- validation ---------------------------------------------------------------------------


@query
def null_profile(spark, sf):
    return validate.null_profile(gappy(spark, sf))


@query
def missing_count(spark, sf):
    df = gappy(spark, sf)
    options = FeatureOptions(missing_count=True)
    state = features.fit_features(df, options, KEYS)[0]
    gaps = dict(features.feature_columns(state, df.schema))["missing_count"]
    return df.groupBy(gaps.alias("missing_count")).agg(F.count("*").alias("n_rows"))


LINE_CHECKS = {"l_quantity": (5, 45), "l_discount": (0.01, 0.09), "l_tax": (0, 0.07)}


@query
def range_violations(spark, sf):
    return validate.range_violations(table(spark, sf, "lineitem"), LINE_CHECKS)


@query
def violating_rows(spark, sf):
    rows = validate.violating_rows(table(spark, sf, "lineitem"), LINE_CHECKS)
    return rows.select(*KEYS, "l_quantity", "l_discount", "l_tax")


@query
def contract_failures(spark, sf):
    """A contract learned from the orders, tightened, and applied to them."""
    orders = table(spark, sf, "orders")
    contract = validate.build_contract(
        orders, "o_orderstatus", ["o_orderkey"], numerical_overrides=["o_custkey"],
        checks={"o_totalprice": (1000, 400000)},
    )
    contract.kinds["o_clerk"] = "string"
    contract.nullable["o_clerk"] = True
    return contract.failures(orders)


@query
def leakage_drop(spark, sf):
    return select.drop_leakage(table(spark, sf, "orders"), ["*PRIORITY*", "*date"])


# --- feature fitting and transformation -----------------------------------------------------


@query
def impute_median(spark, sf):
    df = gappy(spark, sf).select(*KEYS, "quantity", "discount", "price")
    state = features.fit_features(df, FeatureOptions(), KEYS)[0]
    return rounded(features.imputed(df, state), "quantity", "discount", "price")


@query
def impute_mode(spark, sf):
    df = gappy(spark, sf).select(*KEYS, "returnflag", "linestatus")
    state = features.fit_features(df, FeatureOptions(), KEYS)[0]
    return features.imputed(df, state)


@query
def fitted_parameters(spark, sf):
    """Median, mean, deviation per number and mode, list size per text column."""
    df = gappy(spark, sf)
    state = features.fit_features(df, FeatureOptions(), KEYS)[0]
    rows = [
        (c, float(state["medians"][c]), float(state["means"][c]), float(state["stds"][c]), None, None)
        for c in state["numeric"]
    ] + [(c, None, None, None, state["modes"][c], features.width(state, c)) for c in state["categorical"]]
    out = spark.createDataFrame(
        rows, "column string, median double, mean double, std double, mode string, n_values int"
    )
    return rounded(out, "median", "mean", "std")


def named_features(df: DataFrame, options: FeatureOptions, masks=None) -> DataFrame:
    state = features.fit_features(df, options, KEYS, masks)[0]
    named = features.feature_columns(state, df.schema)
    return df.select(*KEYS, *[r6(c).alias(n) for n, c in named])


@query
def scale_standard(spark, sf):
    return named_features(gappy(spark, sf).select(*KEYS, "quantity", "discount", "price"), FeatureOptions())


@query
def scale_off(spark, sf):
    df = gappy(spark, sf).select(*KEYS, "quantity", "price")
    return named_features(df, FeatureOptions(scaler="none"))


@query
def bin_edges(spark, sf):
    df = measurements(spark, sf).select(scalar.bin_index("age").alias("bin"), "age")
    return df.groupBy("bin").agg(
        F.count("*").alias("n_rows"), F.min("age").alias("low"), F.max("age").alias("high")
    )


@query
def one_hot(spark, sf):
    """Rows per flag and the one-hot sums; fitted without the returned rows, R is unknown."""
    df = gappy(spark, sf).select(*KEYS, "returnflag")
    seen = F.coalesce(F.col("returnflag") != "R", F.lit(True))
    state = features.fit_features(df, FeatureOptions(), KEYS, [seen])[0]
    named = features.feature_columns(state, df.schema)
    return df.groupBy(F.coalesce("returnflag", F.lit("gap")).alias("flag")).agg(
        F.count("*").alias("n_rows"), *[F.sum(c).alias(n) for n, c in named]
    )


@query
def one_hot_entries(spark, sf):
    """The long form for columns of any cardinality, counted per entry."""
    df = gappy(spark, sf)
    known = df.where(F.coalesce(F.col("returnflag") != "R", F.lit(True)))
    categories = features.category_table(known, ["returnflag", "linestatus"])
    entries = features.one_hot_long(df, "l_orderkey", ["returnflag", "linestatus"], categories)
    return entries.groupBy("column", "value").agg(F.count("*").alias("n_rows"))


@query
def interaction(spark, sf):
    df = gappy(spark, sf).select(*KEYS, "quantity", "discount")
    options = FeatureOptions(interaction_pairs=[["quantity", "discount"], ["quantity", "absent"]])
    return named_features(df, options).select(*KEYS, "quantity_x_discount")


MATRIX_OPTIONS = FeatureOptions(
    drop_patterns=["*PRICE*"],
    missing_count=True,
    bin_column="quantity",
    interaction_pairs=[["quantity", "discount"]],
)


@query
def feature_matrix(spark, sf):
    return named_features(gappy(spark, sf), MATRIX_OPTIONS)


@query
def feature_vector(spark, sf):
    """The assembled vector, summed per position."""
    df = gappy(spark, sf)
    model = features.FeatureBuilder(options=MATRIX_OPTIONS, exclude=KEYS).fit(df)
    entries = model.transform(df).select(F.posexplode(vector_to_array("features")).alias("pos", "x"))
    sums = entries.groupBy("pos").agg(r6(F.avg("x")).alias("mean"), r6(F.max("x")).alias("high"))
    return sums.withColumn("feature", ranking.decode("pos", model.feature_names)).select(
        "feature", "mean", "high"
    )


@query
def fold_parameters(spark, sf):
    """Medians and means without each of three folds, learned in shared passes."""
    df = gappy(spark, sf)
    masks = [F.col("l_orderkey") % 3 != i for i in range(3)]
    states = features.fit_features(df, FeatureOptions(), KEYS, masks)
    rows = [
        (i, c, float(s["medians"][c]), float(s["means"][c]), float(s["stds"][c]))
        for i, s in enumerate(states)
        for c in s["numeric"]
    ]
    out = spark.createDataFrame(rows, "fold int, column string, median double, mean double, std double")
    return rounded(out, "median", "mean", "std")


# --- labels and weights ------------------------------------------------------------------------


@query
def label_encode(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    _, encoded = labels.fit_transform(customers, "c_mktsegment")
    return encoded


@query
def label_decode(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    index, encoded = labels.fit_transform(customers, "c_mktsegment")
    return index.inverse(encoded, "label_idx", "segment").select("c_custkey", "label_idx", "segment")


@query
def task_type(spark, sf):
    lab, emb = table(spark, sf, "labels"), table(spark, sf, "embeddings")
    rows = [
        ("quality", labels.task_type(lab, "quality")),
        ("toxic", labels.task_type(lab, "toxic")),
        ("label", labels.task_type(emb, "label")),
        ("absent", labels.task_type(lab, "absent")),
        ("both", labels.task_type(lab, "quality", multilabel=True)),
    ]
    return spark.createDataFrame(rows, "target string, task string")


@query
def class_weights(spark, sf):
    return rounded(weights.with_class_weight(table(spark, sf, "lineitem").select(*KEYS, "l_returnflag"), "l_returnflag"), "weight")


@query
def class_weight_table(spark, sf):
    out = weights.class_weight_table(table(spark, sf, "labels"), "quality", "balanced")
    return rounded(out, "weight")


@query
def pos_weight(spark, sf):
    return rounded(weights.positive_ratio(table(spark, sf, "labels"), "quality"), "pos_weight")


@query
def multilabel_weights(spark, sf):
    return rounded(weights.with_multilabel_weight(table(spark, sf, "labels"), ["quality", "toxic"]), "weight")


# --- count metrics ----------------------------------------------------------------------------------


def order_stats(spark, sf):
    return confusion.class_stats(confusion.confusion_counts(judged_orders(spark, sf), "y", "pred"))


@query
def confusion_counts(spark, sf):
    return confusion.confusion_counts(judged_orders(spark, sf), "y", "pred")


@query
def confusion_matrix(spark, sf):
    counts = confusion.confusion_counts(judged_orders(spark, sf), "y", "pred")
    return confusion.confusion_matrix(counts, ["F", "O", "P"])


@query
def accuracy(spark, sf):
    return confusion.summary(order_stats(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query
def macro_scores(spark, sf):
    out = confusion.summary(order_stats(spark, sf))
    return rounded(out, "macro_precision", "macro_recall", "macro_f1").select(
        "macro_precision", "macro_recall", "macro_f1"
    )


@query
def weighted_f1(spark, sf):
    return confusion.summary(order_stats(spark, sf)).select(r6("weighted_f1").alias("weighted_f1"))


@query
def per_class_scores(spark, sf):
    """Values for a class list with a class that never occurs."""
    names = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    df = judged_orders(spark, sf).select(
        (F.array_position(names, F.col("y")) - 1).alias("y"), (F.array_position(names, F.col("pred")) - 1).alias("pred")
    )
    stats = confusion.class_stats(confusion.confusion_counts(df, "y", "pred"))
    out = confusion.per_class(stats, ["F", "O", "P", "never"])
    return rounded(out, "precision", "recall", "f1")


@query
def class_report(spark, sf):
    return rounded(confusion.classification_report(order_stats(spark, sf)), "precision", "recall", "f1")


@query
def multilabel_scores(spark, sf):
    out = multilabel.multilabel_metrics(
        multilabel_rows(spark, sf), ["quality", "toxic"], ["pred_quality", "pred_toxic"]
    )
    return rounded(out, "macro_f1", "micro_f1", "samples_f1", "accuracy")


@query
def label_array_scores(spark, sf):
    """The same four scores, and the areas and weights, of labels in arrays: as wide a plan for any number of labels."""
    rows = multilabel_rows(spark, sf).select(
        "doc_id", labelarrays.label_array(["quality", "toxic"]).alias("truth"), labelarrays.label_array(["pred_quality", "pred_toxic"]).alias("pred"),
        F.array("score_quality", "score_toxic").alias("score"),
    )
    line = labelarrays.multilabel_metrics(rows, "truth", "pred")
    areas = rankmetrics.auc_by_class(labelarrays.array_scores(rows, "truth", "score"))
    weight = labelarrays.with_label_weight(rows, "truth").agg(F.max("weight").alias("value"))
    out = line.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in line.columns])))
    out = out.unionByName(areas.select(F.concat(F.lit("auc_"), F.col("cls").cast("string")).alias("metric"), F.col("auc").alias("value")))
    return rounded(out.unionByName(weight.select(F.lit("largest_weight").alias("metric"), "value")), "value")


@query
def label_decades(spark, sf):
    """Thirty labels of a row from its number of characters, judged against those of another number."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    bits = lambda c: F.transform(F.sequence(F.lit(2), F.lit(31)), lambda i: (F.pmod(F.col(c), i) == 0).cast("int"))
    rows = docs.select(bits("n_chars").alias("truth"), bits("doc_id").alias("pred"))
    return rounded(labelarrays.multilabel_metrics(rows, "truth", "pred"), "macro_f1", "micro_f1", "samples_f1", "accuracy")


@query
def multilabel_decision(spark, sf):
    """Element-wise threshold over a probability array."""
    df = multilabel_rows(spark, sf).withColumn("proba", F.array("score_quality", "score_toxic"))
    decided = df.withColumn("d", multilabel.apply_threshold("proba", 0.3))
    return decided.select("doc_id", F.col("d")[0].alias("quality"), F.col("d")[1].alias("toxic"))


# --- ranking metrics ---------------------------------------------------------------------------------


@query
def roc_auc(spark, sf):
    return rounded(rankmetrics.roc_auc(scored_lines(spark, sf), "y", "score"), "roc_auc")


@query
def roc_auc_ovr(spark, sf):
    return rounded(rankmetrics.roc_auc_ovr(class_lines(spark, sf), "y", "proba", 3), "roc_auc_ovr")


@query
def roc_auc_ovo(spark, sf):
    return rounded(rankmetrics.roc_auc_ovo(class_lines(spark, sf), "y", "proba", 3), "roc_auc_ovo")


@query
def roc_auc_per_label(spark, sf):
    long = rankmetrics.label_scores(
        multilabel_rows(spark, sf), ["quality", "toxic"], ["score_quality", "score_toxic"]
    )
    return rounded(rankmetrics.auc_by_class(long), "auc")


@query
def roc_auc_multilabel(spark, sf):
    out = rankmetrics.roc_auc_multilabel(
        multilabel_rows(spark, sf), ["quality", "toxic"], ["score_quality", "score_toxic"]
    )
    return rounded(out, "roc_auc_macro")


@query
def average_precision(spark, sf):
    return rounded(rankmetrics.average_precision(scored_lines(spark, sf), "y", "score"), "pr_auc")


@query
def average_precision_macro(spark, sf):
    out = rankmetrics.average_precision_macro(class_lines(spark, sf), "y", "proba", 3)
    return rounded(out, "pr_auc")


@query
def best_f1_threshold(spark, sf):
    threshold, best = rankmetrics.best_f1_threshold(scored_lines(spark, sf), "y", "score")
    return rounded(spark.createDataFrame([(threshold, best)], "threshold double, f1 double"), "threshold", "f1")


@query
def metric_bundle(spark, sf):
    """Areas, precision, threshold and count metrics of scored lines, all from one written table of their scores."""
    df = scored_lines(spark, sf).withColumn("pred", (F.col("score") >= 0.3).cast("int"))
    scored = scores.binary_table(df, "y", "score")
    bundle = metrics.binary_metrics(df, "y", "pred", "score", scored)
    bundle["threshold"], bundle["best_f1"] = scored.best_threshold()
    out = spark.createDataFrame([(k, float(v)) for k, v in bundle.items()], "metric string, value double")
    return rounded(out, "value")


@query
def class_bundle(spark, sf):
    """Areas and precision of every class from one table."""
    scored = scores.class_table(class_lines(spark, sf), "y", "proba", 3)
    return rounded(scored.areas().join(scored.precisions(), "cls"), "auc", "ap")


@query
def score_quantiles(spark, sf):
    levels = [0.01, 0.25, 0.5, 0.77, 0.99]
    values = quantiles.linear_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", levels)
    return rounded(spark.createDataFrame(list(zip(levels, values)), "level double, value double"), "value")


# --- scoring tables --------------------------------------------------------------------------------------


@query
def topk_classes(spark, sf):
    out = scoring.topk_output(class_orders(spark, sf), "proba", STATUS_NAMES, 5, ["o_orderkey"])
    return rounded(out, *[f"top{i}_probability" for i in (1, 2, 3)])


@query
def ranked_text(spark, sf):
    return scoring.ranked_text_output(class_orders(spark, sf), "proba", STATUS_NAMES, 2, ["o_orderkey"])


@query
def multiclass_table(spark, sf):
    out = scoring.multiclass_output(class_orders(spark, sf), "proba", 3, ["o_orderkey"])
    return rounded(out, *[f"class_{i}_proba" for i in range(3)])


@query
def probability_table(spark, sf):
    out = scoring.probability_table(class_orders(spark, sf), "proba", STATUS_NAMES, ["o_orderkey"])
    return rounded(out, *STATUS_NAMES)


@query
def argmax_class(spark, sf):
    out = scoring.predicted_name(class_orders(spark, sf), "proba", STATUS_NAMES)
    return out.select("o_orderkey", "prediction")


@query
def record_table(spark, sf):
    return scoring.record_output(class_orders(spark, sf), "proba", STATUS_NAMES, "o_orderkey")


@query
def ranked_records(spark, sf):
    out = scoring.ranked_records(class_orders(spark, sf), "proba", STATUS_NAMES, ["o_orderkey"])
    return rounded(out, "probability")


@query
def named_probability_map(spark, sf):
    """Probabilities looked up by class name in a map."""
    df = class_orders(spark, sf).withColumn("m", ranking.named_probabilities("proba", STATUS_NAMES))
    return df.select("o_orderkey", r6(F.col("m")["On_Time"]).alias("on_time"))


@query
def class_captions(spark, sf):
    return rounded(scoring.caption_output(class_orders(spark, sf), "proba", 3, ["o_orderkey"]), "confidence")


def binary_orders(spark, sf):
    p = F.col("o_totalprice") / 500001.0
    return table(spark, sf, "orders").select("o_orderkey", F.array(1.0 - p, p).alias("proba"))


@query
def binary_captions(spark, sf):
    return rounded(scoring.caption_output(binary_orders(spark, sf), "proba", 2, ["o_orderkey"]), "confidence")


@query
def binary_table(spark, sf):
    threshold = scoring.resolve_threshold(None, 0.35)
    out = scoring.binary_output(binary_orders(spark, sf), "proba", threshold, ["o_orderkey"], bands=True)
    return rounded(out, "probability")


@query
def pred_summary(spark, sf):
    out = scoring.binary_output(binary_orders(spark, sf), "proba", 0.35)
    return scoring.positive_summary(out)


@query
def value_share(spark, sf):
    return rounded(scoring.value_share(judged_orders(spark, sf), "pred"), "share")


@query
def percent_text(spark, sf):
    return binary_orders(spark, sf).select("o_orderkey", scalar.percent(F.col("proba")[1]).alias("text"))


@query
def display_names(spark, sf):
    name = F.concat_ws("_", "p_name", "p_type")
    return table(spark, sf, "part").select("p_partkey", scalar.display_name(F.translate(name, " ", "_")).alias("name"))


# --- rules and generated rows ------------------------------------------------------------------------------


@query
def rule_scores(spark, sf):
    score = scalar.rule_score(scalar.RISK_THRESHOLDS)
    df = measurements(spark, sf).select(score.alias("score"))
    return df.groupBy("score", scalar.rule_tier("score").alias("tier")).agg(F.count("*").alias("n_rows"))


@query
def clipped_values(spark, sf):
    df = measurements(spark, sf)
    return df.select(*KEYS, r6(scalar.clip("age", 0, 100)).alias("age"), r6(scalar.clip("bmi", 18, 40)).alias("bmi"))


@query
def logistic_outcome(spark, sf):
    df = measurements(spark, sf)
    p = scalar.logistic(generated.weighted_score(generated.OUTCOME_WEIGHTS, F.lit(0.0)))
    return df.select(*KEYS, r6(p).alias("p"), (p > 0.5).cast("int").alias("outcome"))


@query
def latent_class(spark, sf):
    """Largest noise-free score, counted per class."""
    scores = {c: generated.weighted_score(w, F.lit(0.0)) for c, w in generated.LATENT_WEIGHTS.items()}
    df = measurements(spark, sf).select(scalar.first_maximum(scores).alias("prognosis"))
    return generated.label_distribution(df)


@query
def sex_codes(spark, sf):
    """Status letters read as a sex spelling, and a numeric code passed through."""
    text = F.when(F.col("o_orderstatus") == "F", "Female").when(F.col("o_orderstatus") == "O", "MALE").otherwise("m")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        scalar.sex_code(text).alias("from_text"),
        scalar.sex_code(F.col("o_custkey") % 2, is_string=False).alias("from_number"),
    )


@query
def numeric_coercion(spark, sf):
    """Prices and priorities as text, turned to numbers, with the rejects counted."""
    df = table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority")
    )
    return csv.reject_counts(df, ["price", "priority"])


def customer_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey")


@query
def generated_binary(spark, sf):
    df = generated.binary_rows(customer_keys(spark, sf), "c_custkey")
    return rounded(df, "bmi", "heart_rate", "bill_amount")


@query
def generated_multiclass(spark, sf):
    df = generated.multiclass_rows(customer_keys(spark, sf), "c_custkey")
    return rounded(df, "bmi", "heart_rate", "blood_pressure", "cholesterol")


@query
def generated_tiers(spark, sf):
    df = generated.tiered_rows(customer_keys(spark, sf), "c_custkey")
    return rounded(df, "age", "bmi", "heart_rate", "blood_pressure", "cholesterol")


@query
def generated_labels(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    return generated.label_distribution(generated.multiclass_rows(keys, "o_orderkey"))


# --- attribution over a linear rule --------------------------------------------------------------------------


@query
def linear_attribution(spark, sf):
    return rounded(attributed_long(spark, sf), "value", "abs_value")


@query
def topk_features(spark, sf):
    out = explain.top_features_wide(attributed_lines(spark, sf), "row_id", "attribution", ATTRIBUTION_NAMES, 2)
    return rounded(out, "value", "abs_value")


@query
def topk_features_long(spark, sf):
    return rounded(explain.top_features(attributed_long(spark, sf), "row_id", 1), "value", "abs_value")


@query
def global_importance(spark, sf):
    return rounded(explain.global_importance(attributed_long(spark, sf)), "mean_abs_shap")


@query
def attribution_wide(spark, sf):
    long = attributed_long(spark, sf)
    return rounded(explain.wide_attribution(long, "row_id", ATTRIBUTION_NAMES), *ATTRIBUTION_NAMES)


@query
def attribution_projection(spark, sf):
    wide = explain.wide_projection(attributed_lines(spark, sf), "row_id", "attribution", ATTRIBUTION_NAMES)
    return rounded(wide, *ATTRIBUTION_NAMES)


@query
def row_explanation(spark, sf):
    """The leading features of the row with the smallest key."""
    first = table(spark, sf, "lineitem").agg(F.min("l_orderkey")).first()[0]
    one = select.row_lookup(attributed_lines(spark, sf), "row_id", first)
    long = explain.to_long(one, "row_id", "attribution", ATTRIBUTION_NAMES)
    return rounded(explain.explain_row(long, "row_id", first, 20), "shap_value")


# --- sampling, numbering, folds ---------------------------------------------------------------------------------


@query
def sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return select.sample_rows(docs, 100, "doc_id", unit=arithmetic_unit("doc_id", 42))


@query
def preview(spark, sf):
    return select.preview(table(spark, sf, "orders"), 10, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query
def row_lookup(spark, sf):
    return select.row_lookup(table(spark, sf, "orders"), "o_orderkey", 17).select("o_orderkey", "o_totalprice")


@query
def row_numbers(spark, sf):
    """Numbers given at the scan are dense and unique."""
    numbered = select.with_row_id(table(spark, sf, "lineitem").select("l_orderkey"))
    return numbered.agg(
        F.min("row_id").alias("low"), F.max("row_id").alias("high"),
        F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_distinct"),
    )


@query
def stratified_folds(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return folds.stratified_folds(customers, "c_mktsegment", "c_custkey", 5, unit=arithmetic_unit("c_custkey", 42))


@query
def stratified_folds_cut(spark, sf):
    """The same rule over ranges of one hundred rows, as used for very large classes."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return folds.stratified_folds(
        customers, "c_mktsegment", "c_custkey", 5, unit=arithmetic_unit("c_custkey", 42), rows_per_bucket=100
    )


def gappy_customers(spark, sf):
    """Customers, some without a segment and some without a key."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        key.alias("id"), F.when(key % 7 != 0, segment).alias("segment"), F.when(key % 11 != 0, key).alias("c_custkey")
    )


@query
def folds_with_gaps(spark, sf):
    """Rows per segment and fold, cut into ranges; rows without a segment or a key stay."""
    folded = folds.stratified_folds(
        gappy_customers(spark, sf), "segment", "c_custkey", 5, unit=arithmetic_unit("c_custkey", 42), rows_per_bucket=50
    )
    return folded.groupBy("segment").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


@query
def fold_balance(spark, sf):
    """Largest less smallest fold, in total and in any class of very uneven classes."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.pmod(F.col("o_custkey"), F.lit(97)).alias("cls"))
    sizes = folds.stratified_folds(orders, "cls", "o_orderkey", 7).groupBy("cls", "fold").agg(F.count("*").alias("n"))
    per_class = sizes.groupBy("cls").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("f"))
    worst = per_class.agg(F.max(F.col("hi") - F.when(F.col("f") < 7, 0).otherwise(F.col("lo"))).alias("spread"))
    total = sizes.groupBy("fold").agg(F.sum("n").alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("n_rows"))
    both = total.crossJoin(F.broadcast(worst))  # one row and one row
    return both.select("n_rows", (F.col("hi") - F.col("lo") <= 1).alias("even_total"), (F.col("spread") <= 1).alias("even_classes"))


@query
def one_hot_wide(spark, sf):
    """Entries of a column of thousands of values, counted through the sparse vector."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    model = FeatureModel(features.fit_features(parts, FeatureOptions(), ["p_partkey"])[0])
    hot = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    sums = model.transform(parts).select(hot.alias("ones")).groupBy("ones").agg(F.count("*").alias("n_rows"))
    return sums.withColumn("n_features", F.lit(model.n_features).cast("long"))


@query
def dictionary_codes(spark, sf):
    """Places of the values of a column with as many values as rows, and of one with few and gaps."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    known = rows.where("c_custkey % 3 <> 0")
    model = FeatureModel(features.fit_features(known, FeatureOptions(), ["c_custkey"])[0])
    placed, (name, segment) = model.placed(rows)
    return placed.select("c_custkey", F.col(name).alias("name_code"), F.col(segment).alias("segment_code"))


@query
def sparse_importance(spark, sf):
    """Mean absolute contribution of thousands of features, from the entries that rows have."""
    return sparse_segments(spark, sf).global_importance().select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))


@query
def sparse_top_features(spark, sf):
    top = sparse_segments(spark, sf).top_features(3)
    return top.select("p_partkey", "feature", r6("value").alias("value"), r6("abs_value").alias("abs_value"), "rank")


class _Linear:
    """A linear model with given coefficients."""

    def __init__(self, row: list[float]):
        self.row = row

    @property
    def coefficientMatrix(self):
        return DenseMatrix(1, len(self.row), self.row)


def sparse_segments(spark, sf):
    """Parts by name, brand and size under coefficients by position; every third part's name is unknown."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("double").alias("size"))
    model = FeatureModel(features.fit_features(parts.where("p_partkey % 3 <> 0"), FeatureOptions(scaler="none"), ["p_partkey"])[0])
    row = [((i * 37) % 101 - 50) / 29.7 for i in range(model.n_features)]
    return sparse.linear_sparse(PipelineModel([model, _Linear(row)]), parts, "p_partkey")


def holed_orders(spark, sf):
    """Probability arrays with NULL and NaN entries, and arrays that are NULL."""
    k, p = F.col("o_orderkey"), F.col("proba")
    holed = F.array(
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(p[0]), F.when(k % 3 != 0, p[1]), F.when(k % 4 != 0, p[2])
    )
    return class_orders(spark, sf).select("o_orderkey", F.when(k % 13 != 0, holed).alias("proba"))


@query
def gap_decisions(spark, sf):
    """Decision, decoded name, band and caption over gaps: a gap decides nothing."""
    first = F.get("proba", F.lit(0))
    df = holed_orders(spark, sf).withColumns({"pred": ranking.argmax_index("proba"), "p": F.when(~F.isnan(first), first)})
    return df.select(
        "o_orderkey", "pred", ranking.decode("pred", STATUS_NAMES).alias("name"),
        scalar.risk_band(scalar.above("p", 0.5), "p").alias("band"), scalar.binary_caption("p").alias("caption"),
    )


@query
def gap_top(spark, sf):
    """The first of the ranked list agrees with the decision, also where there is none."""
    top = scoring.topk_output(holed_orders(spark, sf), "proba", STATUS_NAMES, 3, ["o_orderkey"])
    return top.select("o_orderkey", "prediction", "top2_disease")


@query
def gap_ranges(spark, sf):
    """NULL and NaN are gaps, not violations."""
    q, k = F.col("l_quantity"), F.col("l_orderkey")
    li = table(spark, sf, "lineitem").select(
        F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 != 0, q.cast("double")).alias("l_quantity")
    )
    return validate.range_violations(li, {"l_quantity": (5, 45)})


@query
def holdout_sizes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    train, test = folds.stratified_holdout(
        orders, "o_orderstatus", "o_orderkey", unit=arithmetic_unit("o_orderkey", 42)
    )
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "o_orderstatus").agg(F.count("*").alias("n_rows"))


@query
def group_folds(spark, sf):
    """Rows per fold when all orders of a customer share one; no customer lies in two folds."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    folded = folds.group_folds(orders, "o_custkey", 5)
    per_customer = folded.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("f"))
    return per_customer.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("f") > 1).alias("n_split")
    )


# --- files ---------------------------------------------------------------------------------------------------------


@query
def group_class_folds(spark, sf):
    """Orders in folds by customer and status: no customer in two folds, every status in about even shares, with one
    customer that holds a third of all orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("owner"), "o_orderstatus")
    folded = written(folds.group_class_folds(orders, "o_orderstatus", "owner", 3), "folded")
    split = folded.groupBy("owner").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_split"), F.count("*").alias("n_groups"))
    shares = folded.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))
    whole = folded.groupBy("o_orderstatus").agg(F.count("*").alias("t"), F.count_if(F.col("owner").isNull()).alias("largest"))
    off = shares.join(whole, "o_orderstatus").select((F.abs(F.col("n") / F.col("t") - 1 / 3) <= F.col("largest") / F.col("t")).alias("ok"))
    facts = off.agg(F.count("*").alias("n_cells"), F.count_if(~F.col("ok")).alias("n_uneven"))
    return split.join(F.broadcast(facts))  # one row and one row


@query
def csv_round_trip(spark, sf):
    """Written as CSV, read back with inferred types, summed per column."""
    path = new_path(spark, "csv")
    csv.write_csv(gappy(spark, sf), path)
    back = csv.read_csv(spark, path)
    return back.agg(
        F.count("*").alias("n_rows"),
        F.sum("l_orderkey").alias("keys"),
        F.count("quantity").alias("n_quantity"),
        r6(F.sum("quantity")).alias("quantity"),
        F.count("discount").alias("n_discount"),
        F.count("returnflag").alias("n_returnflag"),
        F.min("linestatus").alias("first_status"),
    )


@query
def report_round_trip(spark, sf):
    """A confusion matrix and label list written as JSON and read back."""
    df = judged_orders(spark, sf)
    counts = confusion.confusion_counts(df, "y", "pred")
    names = confusion.label_union(counts)
    path = new_path(spark, "report")
    artifacts.save_json(spark, artifacts.confusion_dict(counts, names), path)
    artifacts.save_labels(spark, labels.LabelIndex(names), f"{path}-labels")
    matrix = artifacts.load_json(spark, path)["matrix"]
    classes = artifacts.load_labels(spark, f"{path}-labels").classes
    rows = [(y, p, matrix[i][j]) for i, y in enumerate(classes) for j, p in enumerate(classes)]
    return spark.createDataFrame(rows, "y string, pred string, n long")


# --- models: results have no SQL twin; invariants of them do ---------------------------------------------------------

LOGISTIC = {"model": {"name": "logreg"}, "imbalance": {"enable": True, "scheme": "inverse_freq"}}
BOOSTED = {
    "model": {"name": "xgb", "xgboost": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2}},
    "imbalance": {"enable": True, "scheme": "inverse_freq"},
}
FOREST = {"model": {"name": "rf", "forest": {"n_estimators": 20, "max_depth": 6}}}
DOC_OPTIONS = FeatureOptions()


def all_documents(spark, sf):
    """What a model scores: every document, with or without a label."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def fitted(spark, sf, config, label="quality"):
    df = written(labelled(spark, sf), "fit-rows")  # read by every pass of the fit
    other = "toxic" if label == "quality" else "quality"
    model = FeatureModel(features.fit_features(df, DOC_OPTIONS, ["doc_id", label, other])[0])
    counts = select.class_counts(df, label)
    return df, models.fit_classifier(df, model, config, label, counts, 2, models.uses_weights(config, False))


def segment_rows(spark, sf):
    """Five market segments from what their customers hold and order."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price")
    )
    return customers.join(orders, "c_custkey", "left")


def fitted_segments(spark, sf, config):
    df = segment_rows(spark, sf)
    index, data = labels.fit_transform(df, "c_mktsegment")
    data = written(data.drop("c_mktsegment"), "fit-rows")  # read by every pass of the fit
    model = FeatureModel(features.fit_features(data, DOC_OPTIONS, ["c_custkey", "label_idx"])[0])
    counts = select.class_counts(data, "label_idx")
    return data, index, models.fit_classifier(data, model, config, "label_idx", counts, index.n_classes, False)


@query
def score_and_report(spark, sf):
    """Fit on the labelled documents, then score them: key, decision, band, probability."""
    _, model = fitted(spark, sf, LOGISTIC)
    scored = models.probabilities(model, all_documents(spark, sf))
    return scoring.binary_output(scored, "proba", 0.5, ["doc_id"], bands=True)


@query
def saturated_logistic(spark, sf):
    """A logistic model of the language alone, without penalty: its probabilities are the shares of each language's rows."""
    df = written(labelled(spark, sf).select("doc_id", "lang", "quality"), "fit-rows")
    model = FeatureModel(features.fit_features(df, DOC_OPTIONS, ["doc_id", "quality"])[0])
    config = {"model": {"name": "logreg", "logistic": {"penalty": "none"}}, "imbalance": {"enable": False}}
    fit = models.fit_classifier(df, model, config, "quality", select.class_counts(df, "quality"), 2, False)
    p = F.col("proba")[1]
    scored = models.probabilities(fit, df).groupBy("lang").agg(F.count("*").alias("n_rows"), F.floor(F.max(p) * 1000 + 0.5).alias("high"), F.floor(F.min(p) * 1000 + 0.5).alias("low"))
    return scored


@query
def train_and_score(spark, sf):
    """Whole jobs: train on the labelled documents as published files, score all documents without a key, and join back."""
    path = new_path(spark, "job")
    csv.write_csv(labelled(spark, sf).drop("toxic"), f"{path}/train.csv")
    csv.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").repartition(3, "doc_id").sortWithinPartitions("doc_id"), f"{path}/new.csv")
    config = make_config({"target.name": "quality", "model.name": "logreg", "key": "doc_id", "cv.folds": 2, "explain.sample": 50})
    meta = train.train_binary(spark, csv.read_csv(spark, f"{path}/train.csv"), config, f"{path}/artifacts")
    scored = predict.predict_binary(spark, f"{path}/new.csv", f"{path}/artifacts", f"{path}/scored", threshold=0.5)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    p = F.col("probability")
    wrong = ~F.col("prediction").eqNullSafe((p >= 0.5).cast("int")) | ~p.between(0, 1)
    found = scored.join(docs, "doc_id").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"), F.sum("n_chars").alias("n_chars"), F.count_if(wrong).alias("n_wrong"))
    return found.withColumns({"n_features": F.lit(len(meta["features"])).cast("long"), "n_versions": F.lit(len(publish.versions(spark, f"{path}/artifacts"))).cast("long")})


@query
def fit_logistic_classes(spark, sf):
    data, index, model = fitted_segments(spark, sf, LOGISTIC)
    return scoring.topk_output(models.probabilities(model, data), "proba", index.classes, 3, ["c_custkey"])


@query
def fit_forest(spark, sf):
    data, index, model = fitted_segments(spark, sf, FOREST)
    return scoring.multiclass_output(models.probabilities(model, data), "proba", index.n_classes, ["c_custkey"])


@query
def fit_boosted(spark, sf):
    _, model = fitted(spark, sf, BOOSTED)
    return scoring.binary_output(models.probabilities(model, all_documents(spark, sf)), "proba", 0.5, ["doc_id"])


@query
def fit_boosted_classes(spark, sf):
    data, index, model = fitted_segments(
        spark, sf, {"model": {"name": "xgb", "xgboost": {"n_estimators": 3, "max_depth": 3}}}
    )
    return scoring.probability_table(models.probabilities(model, data), "proba", index.classes, ["c_custkey"])


@query
def boosted_leaf_values(spark, sf):
    """Leaf values of three joint rounds of stumps over one flag: what each side of it adds to each language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("double").alias("x"))
    index, data = labels.fit_transform(docs, "lang")
    data = data.withColumn("features", array_to_vector(F.array("x")))
    options = BoostOptions(n_estimators=3, learning_rate=0.3, max_depth=1, reg_alpha=0.5, reg_lambda=2.0, min_child_weight=0.0)
    nodes = JointBooster(options, index.n_classes, "label_idx", keyCol="doc_id").fit(data).node_rows()
    root = nodes.where("node = 0").select("round", "class", "left", "right", "cut", F.col("value").alias("_v"), F.col("rows").alias("_n"))
    sides = root.select("*", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x"))
    sides = sides.withColumn("node", F.when(F.col("left") < 0, 0).when(F.col("x") <= F.col("cut"), F.col("left")).otherwise(F.col("right")))
    leaves = sides.join(nodes.select("round", "class", "node", "value", "rows"), ["round", "class", "node"])
    return leaves.select(ranking.decode("class", index.classes).alias("lang"), "round", "x", F.col("rows").alias("n_rows"), r6("value").alias("value"))


@query
def fit_multi_output(spark, sf):
    df = labelled(spark, sf)
    model = FeatureModel(features.fit_features(df, DOC_OPTIONS, ["doc_id", "quality", "toxic"])[0])
    each = models.fit_multi_output(df, model, LOGISTIC, ["quality", "toxic"])
    return scoring.probability_table(
        models.multi_output_probabilities(each, all_documents(spark, sf)), "proba", ["p_quality", "p_toxic"], ["doc_id"]
    )


@query
def weighted_multilabel_fit(spark, sf):
    """Rows scored by models whose rows weigh by their positive classes."""
    df = labelled(spark, sf)
    config = {**LOGISTIC, "imbalance": {"enable": True, "scheme": "inverse_freq", "multilabel": True, "pos_weight": True}}
    model = FeatureModel(features.fit_features(df, DOC_OPTIONS, ["doc_id", "quality", "toxic"])[0])
    each = models.fit_multi_output(df, model, config, ["quality", "toxic"])
    p = models.multi_output_probabilities(each, all_documents(spark, sf))
    off = ~(F.col("proba")[0].between(0, 1) & F.col("proba")[1].between(0, 1))
    return p.agg(F.count("*").alias("n_rows"), F.count_if(off).alias("n_off"))


@query
def scoring_contract(spark, sf):
    """Rows that break a stored contract: learned on the orders of known status, applied to all of one status."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    stored = validate.build_contract(orders, None, checks={"o_totalprice": (1000.0, 200000.0), "o_orderkey": (1, 5000)}).to_json()
    contract = validate.Contract.from_json(stored).only(["o_totalprice"])
    return contract.failures(orders.where("o_orderstatus = 'F'"))


@query
def native_importance(spark, sf):
    return models.native_importance(fitted(spark, sf, BOOSTED)[1])


@query
def saved_model(spark, sf):
    """A saved and loaded model scores every row as before."""
    df, model = fitted(spark, sf, LOGISTIC)
    path = new_path(spark, "model")
    models.save_model(model, path)
    before = models.probabilities(model, df).select("doc_id", F.col("proba")[1].alias("p"))
    after = models.probabilities(models.load_model(path), df).select("doc_id", F.col("proba")[1].alias("q"))
    return before.join(after, "doc_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("p") != F.col("q")).alias("n_changed")
    )


def document_folds(spark, sf, k=3):
    return crossval.prepare_folds(labelled(spark, sf), DOC_OPTIONS, "quality", "doc_id", 2, k, exclude=["toxic"])


@query
def out_of_fold(spark, sf):
    data = document_folds(spark, sf)
    scored = crossval.out_of_fold(data, crossval.fit_folds(data, LOGISTIC))
    return scoring.binary_output(scored, "proba", 0.5, ["doc_id", "fold"])


@query
def out_of_fold_coverage(spark, sf):
    """Every row is scored exactly once and probabilities sum to one."""
    data = document_folds(spark, sf)
    scored = crossval.out_of_fold(data, crossval.fit_folds(data, LOGISTIC))
    off = F.abs(F.col("proba")[0] + F.col("proba")[1] - 1.0) > 1e-9
    return scored.agg(
        F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"), F.count_if(off).alias("n_off")
    )


@query
def out_of_fold_metrics(spark, sf):
    """The metric bundle of out-of-fold predictions, as (metric, value)."""
    data = document_folds(spark, sf)
    scored = crossval.out_of_fold(data, crossval.fit_folds(data, LOGISTIC)).select("quality", "proba")
    scored = scored.withColumn("pred", ranking.argmax_index("proba")).persist()
    bundle = metrics.generic_metrics(scored, "quality", "pred", "proba", 2)
    scored.unpersist()
    return spark.createDataFrame([(k, v) for k, v in bundle.items()], "metric string, value double")


@query
def calibrated_sigmoid(spark, sf):
    data = document_folds(spark, sf)
    model = calibrate.fit_calibrated(data, crossval.fit_folds(data, LOGISTIC), "sigmoid")
    return scoring.binary_output(model.probabilities(all_documents(spark, sf)), "proba", 0.5, ["doc_id"])


@query
def calibrated_isotonic(spark, sf):
    data = document_folds(spark, sf)
    model = calibrate.fit_calibrated(data, crossval.fit_folds(data, LOGISTIC), "isotonic")
    return scoring.binary_output(model.probabilities(all_documents(spark, sf)), "proba", 0.5, ["doc_id"])


@query
def calibration_choice(spark, sf):
    data = document_folds(spark, sf)
    fits = crossval.fit_folds(data, LOGISTIC)
    _, scores = calibrate.select_calibration(data, fits, ["sigmoid", "isotonic"], metrics.scorer("roc_auc"))
    rows = [(m, float(v), m == scores["selected"]) for m, v in scores.items() if m != "selected"]
    return spark.createDataFrame(rows, "method string, score double, selected boolean")


@query
def parameter_search(spark, sf):
    data = document_folds(spark, sf)
    return tune.random_search(data, LOGISTIC, "roc_auc", n_trials=3)[1]


def attribution_entries(model, rows):
    """(doc_id, feature, value) of the exact attribution of all rows."""
    wide = explain.attributions(model, rows, "doc_id")
    return explain.to_long(wide, "doc_id", "attribution", model.stages[0].feature_names)


@query
def linear_model_attribution(spark, sf):
    _, model = fitted(spark, sf, LOGISTIC)
    return explain.global_importance(attribution_entries(model, all_documents(spark, sf)))


@query
def tree_attribution(spark, sf):
    _, model = fitted(spark, sf, BOOSTED)
    return explain.global_importance(attribution_entries(model, all_documents(spark, sf)))


@query
def tree_attribution_sums(spark, sf):
    """Attributions of a row add up to its margin less one constant."""
    df, model = fitted(spark, sf, BOOSTED)
    total = F.aggregate("attribution", F.lit(0.0), lambda a, b: a + b)
    parts = explain.tree_attribution(model, df, "doc_id").select("doc_id", total.alias("total"))
    margin = model.transform(df).select("doc_id", vector_to_array("rawPrediction")[1].alias("margin"))
    rest = parts.join(margin, "doc_id").select((F.col("margin") - F.col("total")).alias("rest"))
    return rest.agg(
        F.count("*").alias("n_rows"), (F.max("rest") - F.min("rest") < 1e-9).alias("constant")
    )


@query
def tree_attribution_values(spark, sf):
    """Attributions of one joint round of stumps over a flag: what its side adds to each language, less the mean over the sides."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("double").alias("x"))
    index, data = labels.fit_transform(docs, "lang")
    data = written(data.drop("lang"), "fit-rows")
    model = FeatureModel(features.fit_features(data, FeatureOptions(scaler="none"), ["doc_id", "label_idx"])[0])
    options = BoostOptions(n_estimators=1, learning_rate=0.3, max_depth=1, reg_alpha=0.5, reg_lambda=2.0, min_child_weight=0.0)
    fitted_model = PipelineModel([model, JointBooster(options, index.n_classes, "label_idx", keyCol="doc_id").fit(model.transform(data))])
    out = None
    for c, name in enumerate(index.classes):
        own = explain.tree_attribution(fitted_model, data, "doc_id", c).join(data.select("doc_id", "x"), "doc_id")
        own = own.groupBy("x").agg(F.count("*").alias("n_rows"), r6(F.min(F.col("attribution")[0])).alias("low"), r6(F.max(F.col("attribution")[0])).alias("high"))
        own = own.select(F.lit(name).alias("lang"), "x", "n_rows", "low", "high")
        out = own if out is None else out.unionByName(own)
    return out


@query
def sampled_attribution(spark, sf):
    df, model = fitted(spark, sf, FOREST)
    rows = select.sample_rows(df, 50, "doc_id")
    wide = explain.sampled_attribution(model, rows, "doc_id", permutations=3, background=df)
    return explain.global_importance(explain.to_long(wide, "doc_id", "attribution", model.stages[0].feature_names))


# --- facts of the model queries that SQL can state ----------------------------------------------------------------------


def fact(name: str):
    """Registers ``facts_<name>``: a check over the result of query ``name``."""

    def keep(fn):
        def run(spark, sf):
            return fn(spark, sf, QUERIES[name](spark, sf))

        QUERIES[f"facts_{name}"] = run
        return fn

    return keep


def sums_to_one(*columns: str) -> Column:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return F.abs(total - 1.0) < 1e-9


def decisions(spark, sf, df):
    """Rows, keys, decisions off the threshold, values that are no probability."""
    p = F.col("probability")
    wrong = ~F.col("prediction").eqNullSafe((p >= 0.5).cast("int"))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"), F.count_if(wrong).alias("n_wrong"),
        F.count_if(~F.coalesce(p.between(0, 1), F.lit(False))).alias("n_off"),
    )


for _name in ("fit_boosted", "calibrated_sigmoid", "calibrated_isotonic", "out_of_fold"):
    fact(_name)(decisions)


@fact("score_and_report")
def _bands(spark, sf, df):
    """Rows of each decision whose band is not the one of its probability."""
    p, band = F.col("probability"), F.col("risk_level")
    want = F.when(p < 0.5, 3).when(p >= 0.8, 0).when(p >= 0.6, 1).otherwise(2)
    names = F.array(*[F.lit(n) for n in scalar.RISK_BANDS])
    return decisions(spark, sf, df.withColumn("probability", F.when(F.element_at(names, want + 1) == band, p)))


@fact("fit_logistic_classes")
def _ranked_classes(spark, sf, df):
    falls = (F.col("top1_probability") >= F.col("top2_probability")) & (F.col("top2_probability") >= F.col("top3_probability"))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("c_custkey").alias("n_keys"),
        F.count_if(~falls | (F.col("prediction") != F.col("top1_disease"))).alias("n_wrong"),
    )


def shares_of_classes(spark, sf, df):
    names = [c for c in df.columns if c not in ("c_custkey", "prediction")]
    wrong = ~sums_to_one(*names)
    if "prediction" in df.columns:
        wrong = wrong | (F.col("prediction") != ranking.argmax_index(F.array(*names)))
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(names)).cast("long").alias("n_classes"), F.count_if(wrong).alias("n_wrong"))


for _name in ("fit_forest", "fit_boosted_classes"):
    fact(_name)(shares_of_classes)


@fact("fit_multi_output")
def _labels_apart(spark, sf, df):
    off = ~(F.col("p_quality").between(0, 1) & F.col("p_toxic").between(0, 1))
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"), F.count_if(off).alias("n_off"))


@fact("native_importance")
def _importance(spark, sf, df):
    return df.agg(
        F.count("*").alias("n_features"), (F.abs(F.sum("importance") - 1.0) < 1e-9).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("no_negative"),
    )


@fact("out_of_fold_metrics")
def _metrics(spark, sf, df):
    """The bundle is complete and every metric is between 0 and 1."""
    return df.agg(
        F.count("*").alias("n_metrics"), F.count_if(~F.col("value").between(0, 1)).alias("n_off"),
        F.count_if(F.col("metric") == "roc_auc").alias("n_areas"),
    )


@fact("calibration_choice")
def _choice(spark, sf, df):
    return df.agg(
        F.count("*").alias("n_methods"), F.count_if("selected").alias("n_selected"),
        (F.max("score") == F.max(F.when(F.col("selected"), F.col("score")))).alias("best"),
    )


@fact("parameter_search")
def _trials(spark, sf, df):
    return df.agg(F.count("*").alias("n_trials"), F.count_distinct("number").alias("n_numbers"), F.count_if(~F.col("value").between(0, 1)).alias("n_off"))


def explained(spark, sf, df):
    return df.agg(F.count("*").alias("n_features"), F.count_if(~(F.col("mean_abs_shap") >= 0)).alias("n_off"))


for _name in ("linear_model_attribution", "tree_attribution", "sampled_attribution"):
    fact(_name)(explained)


@query
def logistic_gradient(spark, sf):
    """At the fitted coefficients the gradient of the penalised loss is zero."""
    df, model = fitted(spark, sf, {"model": {"name": "logreg", "logistic": {"penalty": "none"}}, "imbalance": {"enable": False}})
    rows = models.probabilities(model, model.stages[0].transform(df).drop("features"), "proba")
    x = model.stages[0].transform(rows).select("quality", F.col("proba")[1].alias("p"), vector_to_array("features").alias("x"))
    each = x.select(F.posexplode("x").alias("j", "v"), (F.col("p") - F.col("quality")).alias("r"))
    gradient = each.groupBy("j").agg(F.avg(F.col("v") * F.col("r")).alias("g"))
    return gradient.agg(F.count("*").alias("n_features"), (F.max(F.abs("g")) < 1e-3).alias("zero"))
