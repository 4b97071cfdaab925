"""Training jobs: two classes, many classes, several labels."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import argmax_index
from ..functions.scalar import above
from ..operators import confusion as cm
from ..operators import metrics as mt
from ..operators.calibrate import select_calibration
from ..operators.crossval import FoldedData, fit_folds, out_of_fold, prepare_folds
from ..operators.explain import attributions, global_importance, to_long, top_features_wide, wide_projection
from ..operators.features import NAMED, FeatureModel, FeatureOptions, fit_features
from ..operators.folds import plain_folds
from ..operators.labels import LabelIndex, task_type
from ..operators.models import (
    fit_classifier,
    fit_multi_output,
    multi_output_probabilities,
    native_importance,
    save_model,
    uses_weights,
)
from ..operators.multilabel import apply_threshold
from ..operators.scores import binary_table
from ..operators.select import class_counts, sample_rows, with_row_id
from ..operators.validate import Contract, learned, require_target, target_name
from ..session import recorded, remove, written
from ..sources.artifacts import confusion_dict, named_report, report_dict, save_json, save_labels
from ..sources.csv import read_csv, write_csv
from ..sources.publish import publishing

LABEL, ROW_ID = "label_idx", "row_id"
Job = Callable[[SparkSession, DataFrame, dict, str], dict]


def intake(df: DataFrame, config: dict, targets: list[str]) -> tuple[DataFrame, str, Contract]:
    """The rows, written from one scan, their key and the contract that they teach.

    The key is the configured column, or the number of a row among those scanned. The contract
    reads the columns that it is about from the written rows. (To count them in the writing
    pass, by ``observe``, would leave the session unfit for logistic models: their training
    summary holds on to the session, and one that has observed cannot be sent to tasks.)
    """
    for target in targets:
        require_target(df, target)
    if config.get("key"):
        rows, key = written(df, "rows"), config["key"]
    else:
        rows, key = with_row_id(df, ROW_ID), ROW_ID
    return rows, key, learned(rows.select(*df.columns), config, targets)


def prepare_table(df: DataFrame, config: dict) -> tuple[DataFrame, str, LabelIndex, str, Contract]:
    target = target_name(config)
    require_target(df, target)
    df, key, contract = intake(df, config, [target])
    index = LabelIndex.fit(df, target)
    return index.transform(df, target, LABEL).drop(target), key, index, target, contract


def fold_table(data: DataFrame, key: str, index: LabelIndex, config: dict, n_folds: int | None = None) -> FoldedData:
    cv = config["cv"]
    return prepare_folds(
        data,
        FeatureOptions.from_config(config),
        LABEL,
        key,
        index.n_classes,
        n_folds or cv["folds"],
        config["model"]["random_state"],
        cv.get("group_col"),
        cv.get("stratify", True),
    )


def _final_fit(folded: FoldedData, key: str, config: dict, final_multiclass: bool):
    data = folded.df.drop("fold")
    state = fit_features(data, FeatureOptions.from_config(config), [key, LABEL])[0]
    return data, fit_classifier(
        data,
        FeatureModel(state),
        config,
        LABEL,
        {int(c): n for c, n in class_counts(data, LABEL).items()},
        folded.n_classes,
        uses_weights(config, final_multiclass),
        key,
    )


def _explanations(model, data: DataFrame, key: str, config: dict, output: str, n_classes: int) -> None:
    """Attribution tables of the positive class, or of the chosen (default: all) classes."""
    options, seed = config["explain"], config["model"]["random_state"]
    rows = written(sample_rows(data, options["sample"], key, seed), "sample")
    names = model.stages[0].feature_names
    for c in [1] if n_classes == 2 else (options.get("classes") or range(n_classes)):
        tail = "" if n_classes == 2 else f"/class={c}"
        wide = attributions(model, rows, key, c, seed=seed).persist()
        long = to_long(wide, key, "attribution", names)
        write_csv(global_importance(long), f"{output}/attribution_importance{tail}", single_file=True)
        write_csv(
            top_features_wide(wide, key, "attribution", names, options["top_features"]), f"{output}/attribution_top{tail}"
        )
        write_csv(wide_projection(wide, key, "attribution", names), f"{output}/attributions{tail}")
        wide.unpersist()


def named_features(features: FeatureModel) -> list[str] | None:
    """Names for the metadata, up to a bound; those of wider vectors lie in the model's dictionary."""
    return features.feature_names if features.n_features <= NAMED else None


def _save_importance(model, output: str) -> None:
    write_csv(native_importance(model), f"{output}/feature_importance", single_file=True)


def published(job: Job) -> Job:
    """The job, whose artifacts become one version below ``output``; its intermediate tables go at its end."""

    @functools.wraps(job)
    def run(spark: SparkSession, df: DataFrame, config: dict, output: str) -> dict:
        with recorded() as paths:
            try:
                with publishing(spark, output) as draft:
                    return job(spark, df, config, draft)
            finally:
                for path in paths:
                    remove(spark, path)

    return run


@published
def train_multiclass(spark: SparkSession, df: DataFrame, config: dict, output: str) -> dict:
    """Validation, out-of-fold report, weighted final fit, importances, attributions, metadata.

    Returns the metadata; every artifact lies in the version that is published below ``output``.
    """
    data, key, index, target, contract = prepare_table(df, config)
    save_labels(spark, index, f"{output}/labels")
    folded = fold_table(data, key, index, config)
    models = fit_folds(folded, config, parallelism=config["cv"].get("parallelism", 2))
    scored = out_of_fold(folded, models).select(LABEL, "proba").withColumn("pred", argmax_index("proba"))
    scored = scored.persist()
    report = mt.multiclass_metrics(scored, LABEL, "pred", "proba", index.classes)
    counts = cm.confusion_counts(scored, LABEL, "pred")
    save_json(spark, report, f"{output}/cv_report")
    stats = cm.class_stats(counts)
    save_json(
        spark, report_dict(named_report(cm.classification_report(stats), index.classes)), f"{output}/classification_report"
    )
    names = F.array(*[F.lit(c) for c in index.classes])
    named = counts.select(
        F.element_at(names, F.col("y") + 1).alias("y"), F.element_at(names, F.col("pred") + 1).alias("pred"), "n"
    )
    write_csv(cm.confusion_matrix(named, index.classes), f"{output}/confusion_matrix", single_file=True)
    scored.unpersist()

    data, model = _final_fit(folded, key, config, True)
    save_model(model, f"{output}/model")
    _save_importance(model, output)
    _explanations(model, data, key, config, output, index.n_classes)
    meta = {
        "task": "multiclass",
        "target_column": target,
        "n_classes": index.n_classes,
        "classes": index.classes,
        "model_type": config["model"]["name"],
        "top_k": config["model"]["top_k"],
        "features": named_features(model.stages[0]),
        "schema_columns": model.stages[0].required_columns(),
        "schema": data.schema.json(),
        "key": config.get("key"),
        "contract": contract.to_json(),
        "cv_accuracy": report["accuracy"],
        "cv_macro_f1": report["macro_f1"],
    }
    save_json(spark, meta, f"{output}/meta")
    return meta


@published
def train_binary(spark: SparkSession, df: DataFrame, config: dict, output: str) -> dict:
    """Validation, out-of-fold report, best-F1 threshold, full fit, optional calibration."""
    data, key, index, target, contract = prepare_table(df, config)
    save_labels(spark, index, f"{output}/labels")
    folded = fold_table(data, key, index, config)
    models = fit_folds(folded, config, parallelism=config["cv"].get("parallelism", 2))
    scored = out_of_fold(folded, models).select(LABEL, "proba").withColumn("pred", argmax_index("proba"))
    scored = scored.persist()
    table = None
    if index.n_classes == 2:  # areas and threshold are read from one table of the scores
        table = binary_table(scored.select(LABEL, F.col("proba")[1].alias("score")), LABEL, "score")
    report = mt.generic_metrics(scored, LABEL, "pred", "proba", index.n_classes, table)
    pred, threshold = "pred", None
    if table is not None:
        threshold, best = table.best_threshold()
        report["threshold"], report["best_f1"] = threshold, best
        scored_at = scored.withColumn("cut", above(F.col("proba")[1], threshold))
        counts = cm.confusion_counts(scored_at, LABEL, "cut")
    else:
        counts = cm.confusion_counts(scored, LABEL, pred)
    save_json(spark, report, f"{output}/cv_report")
    save_json(spark, confusion_dict(counts, list(range(index.n_classes))), f"{output}/confusion_matrix")
    scored.unpersist()

    data, model = _final_fit(folded, key, config, False)
    save_model(model, f"{output}/model")
    calibration: dict = {}
    if config["calibration"]["apply"] and index.n_classes == 2:
        parts = config["calibration"].get("cv")
        if parts and parts != folded.k:  # folds and fold models of its own
            folded = fold_table(folded.df.drop("fold"), key, index, config, parts)
            models = fit_folds(folded, config, parallelism=config["cv"].get("parallelism", 2))
        calibrated, calibration = select_calibration(
            folded,
            models,
            config["calibration"]["methods"],
            mt.scorer(config["evaluation"]["metric"]),
            config["calibration"].get("in_sample", False),
        )
        calibrated.save(f"{output}/calibrated")
    _save_importance(model, output)
    _explanations(model, data, key, config, output, index.n_classes)
    meta = {
        "task": "binary" if index.n_classes == 2 else "multiclass",
        "target": target,
        "target_column": target,
        "n_classes": index.n_classes,
        "classes": index.classes,
        "model": config["model"]["name"],
        "features": named_features(model.stages[0]),
        "threshold": threshold,
        "calibration": calibration,
        "schema_columns": model.stages[0].required_columns(),
        "schema": data.schema.json(),
        "key": config.get("key"),
        "contract": contract.to_json(),
    }
    save_json(spark, meta, f"{output}/meta")
    return meta


@published
def train_multilabel(spark: SparkSession, df: DataFrame, config: dict, output: str) -> dict:
    """Independent models for several 0/1 columns, judged on held-out folds by hash."""
    labels = list(config["target"]["multilabel_columns"])
    df, key, contract = intake(df, config, labels)
    options = FeatureOptions.from_config(config)
    k, seed = config["cv"]["folds"], config["model"]["random_state"]
    folded = written(plain_folds(df, key, k, seed), "folds", partition_by="fold")
    states = fit_features(folded, options, [key, "fold", *labels], [F.col("fold") != i for i in range(k)])
    scored = None
    for i, state in enumerate(states):
        models = fit_multi_output(folded.where(F.col("fold") != i), FeatureModel(state), config, labels)
        part = multi_output_probabilities(models, folded.where(F.col("fold") == i)).select(*labels, "proba")
        scored = part if scored is None else scored.unionByName(part)
    decided = apply_threshold("proba", config["inference"]["multilabel_threshold"])
    scored = scored.withColumn("_d", decided).select(
        *labels,
        *[F.col("_d")[j].alias(f"pred_{c}") for j, c in enumerate(labels)],
        *[F.col("proba")[j].alias(f"score_{c}") for j, c in enumerate(labels)],
    ).persist()
    report = mt.multilabel_bundle(
        scored, labels, [f"pred_{c}" for c in labels], [f"score_{c}" for c in labels], labels
    )
    scored.unpersist()
    save_json(spark, report, f"{output}/cv_report")
    data = folded.drop("fold")
    state = fit_features(data, options, [key, *labels])[0]
    models = fit_multi_output(data, FeatureModel(state), config, labels)
    for c, model in zip(labels, models):
        save_model(model, f"{output}/model/{c}")
    meta = {
        "task": "multilabel",
        "threshold": config["inference"]["multilabel_threshold"],
        "target_columns": labels,
        "model_type": config["model"]["name"],
        "features": named_features(models[0].stages[0]),
        "schema_columns": models[0].stages[0].required_columns(),
        "schema": data.schema.json(),
        "key": config.get("key"),
        "contract": contract.to_json(),
    }
    save_json(spark, meta, f"{output}/meta")
    return meta


def train_csv(spark: SparkSession, path: str, config: dict, output: str) -> dict:
    """Read a CSV and run the job its target calls for."""
    df = read_csv(spark, path)
    task = task_type(df, target_name(config), config["target"].get("multilabel", False))
    job = {"binary": train_binary, "multilabel": train_multilabel}.get(task, train_multiclass)
    return job(spark, df, config, output)
