"""Scoring jobs: one scan of the file, one projection, a key in every sink."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import above
from ..operators.calibrate import CalibratedModel
from ..operators.labels import LabelIndex
from ..operators.models import load_model, multi_output_probabilities, probabilities
from ..operators.scoring import (
    binary_output,
    multiclass_output,
    probability_table,
    resolve_threshold,
    topk_output,
    value_share,
)
from ..operators.select import drop_target, with_row_id
from ..operators.validate import Contract, require_columns
from ..session import recorded, remove, written
from ..sources.artifacts import exists, load_json, load_labels, require_artifact
from ..sources.csv import read_csv, write_csv
from ..sources.publish import latest
from .train import ROW_ID


def load_artifacts(spark: SparkSession, output: str) -> tuple[PipelineModel | CalibratedModel, dict, LabelIndex]:
    """The calibrated model if there is one, else the base model, with metadata and labels, of the last version."""
    output = latest(spark, output)
    require_artifact(spark, f"{output}/model", "Model")
    require_artifact(spark, f"{output}/meta", "Meta")
    if exists(spark, f"{output}/calibrated"):
        model = CalibratedModel.load(f"{output}/calibrated")
    else:
        model = load_model(f"{output}/model")
    return model, load_json(spark, f"{output}/meta"), load_labels(spark, f"{output}/labels")


def score(model: PipelineModel | CalibratedModel, df: DataFrame, out: str = "proba") -> DataFrame:
    if isinstance(model, CalibratedModel):
        return model.probabilities(df, out)
    return probabilities(model, df, out)


def scoring_frame(spark: SparkSession, path: str, meta: dict) -> tuple[DataFrame, str]:
    """The CSV under the training schema, without the targets, with every needed column, and its key.

    The key is the column that training was told of, or the number of a row in the file. The
    file is scanned once, by the pass that writes the rows; the contract of training is held
    against the columns of the written rows, and fails the job before it has scored any.
    """
    schema = StructType.fromJson(json.loads(meta["schema"]))
    df = read_csv(spark, path, schema)
    for target in [meta.get("target_column"), *meta.get("target_columns", ())]:
        df = drop_target(df, target)
    require_columns(df, meta["schema_columns"])
    if meta.get("key") in df.columns:
        rows, key = written(df, "rows"), meta["key"]
    else:
        rows, key = with_row_id(df, ROW_ID), ROW_ID
    if meta.get("contract"):
        contract = Contract.from_json(meta["contract"])
        contract.only([c for c in contract.columns if c in meta["schema_columns"]]).validate(rows)
    return rows, key


def tidied(job: Callable) -> Callable:
    """The job, whose intermediate tables go at its end; its results are read from its sinks."""

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **named):
        with recorded() as paths:
            try:
                return job(spark, *args, **named)
            finally:
                for path in paths:
                    remove(spark, path)

    return run


def sunk(result: DataFrame, path: str) -> DataFrame:
    """``result`` written as CSV and read from there."""
    write_csv(result, path)
    return read_csv(result.sparkSession, path, result.schema)


@tidied
def predict_binary(
    spark: SparkSession,
    path: str,
    artifacts: str,
    output: str,
    threshold: float | None = None,
    bands: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """prediction, [risk_level,] probability; or prediction and class columns beyond two classes.

    ``keep`` names columns of the input to stand first in the output, by default its key.
    """
    model, meta, index = load_artifacts(spark, artifacts)
    df, key = scoring_frame(spark, path, meta)
    keep = [key] if keep is None else list(keep)
    scored = score(model, df)
    if index.n_classes == 2:
        result = binary_output(scored, "proba", resolve_threshold(threshold, meta.get("threshold")), keep, bands)
    else:
        result = multiclass_output(scored, "proba", index.n_classes, keep)
    return sunk(result, output)


@tidied
def predict_multiclass(
    spark: SparkSession,
    path: str,
    artifacts: str,
    output: str,
    proba_output: str,
    top_k: int = 3,
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(top-k predictions, share of each predicted class); probabilities go to their own sink.

    ``keep`` names columns of the input to stand first in both sinks, by default its key.
    """
    model, meta, index = load_artifacts(spark, artifacts)
    df, key = scoring_frame(spark, path, meta)
    keep = [key] if keep is None else list(keep)
    scored = written(score(model, df).select(*keep, "proba"), "scored")
    result = sunk(topk_output(scored, "proba", index.classes, top_k, keep), output)
    write_csv(probability_table(scored, "proba", index.classes, keep), proba_output)
    return result, value_share(result, "prediction", 10)


@tidied
def predict_multilabel(
    spark: SparkSession,
    path: str,
    artifacts: str,
    output: str,
    thresholds: dict[str, float] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """pred_<label>, score_<label> for every label of a multilabel model.

    ``thresholds`` overrides the stored threshold by label.
    """
    artifacts = latest(spark, artifacts)
    require_artifact(spark, f"{artifacts}/meta", "Meta")
    meta = load_json(spark, f"{artifacts}/meta")
    labels = meta["target_columns"]
    for c in labels:
        require_artifact(spark, f"{artifacts}/model/{c}", "Model")
    df, key = scoring_frame(spark, path, meta)
    scored = multi_output_probabilities([load_model(f"{artifacts}/model/{c}") for c in labels], df)
    cuts = {c: meta["threshold"] for c in labels} | (thresholds or {})
    result = scored.select(
        *([key] if keep is None else keep),
        *[above(F.col("proba")[i], cuts[c]).alias(f"pred_{c}") for i, c in enumerate(labels)],
        *[F.col("proba")[i].alias(f"score_{c}") for i, c in enumerate(labels)],
    )
    return sunk(result, output)
