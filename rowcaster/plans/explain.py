"""Standalone explanation of a saved model on a CSV."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.explain import attributions, global_importance, to_long, wide_projection
from ..operators.models import load_model
from ..operators.select import sample_rows
from ..session import written
from ..sources.artifacts import load_json, require_artifact
from ..sources.csv import write_csv
from ..sources.publish import latest
from .predict import scoring_frame, tidied


@tidied
def explain_csv(
    spark: SparkSession,
    path: str,
    artifacts: str,
    output: str,
    sample_size: int = 200,
    max_display: int = 20,
    class_index: int = 1,
    seed: int = 42,
) -> None:
    """Attributions of sampled rows, and the mean absolute value of the leading features.

    A calibrated model is explained by the model that it calibrates, a multilabel one label by
    label, each in a folder of its own.
    """
    artifacts = latest(spark, artifacts)
    require_artifact(spark, f"{artifacts}/meta", "Meta")
    meta = load_json(spark, f"{artifacts}/meta")
    parts = {f"/label={c}": f"{artifacts}/model/{c}" for c in meta.get("target_columns", ())} or {"": f"{artifacts}/model"}
    rows, key = scoring_frame(spark, path, meta)
    sample = written(sample_rows(rows, sample_size, key, seed), "sample")
    for tail, folder in parts.items():
        model = load_model(folder)
        names = model.stages[0].feature_names
        wide = attributions(model, sample, key, class_index, seed=seed).persist()
        long = to_long(wide, key, "attribution", names)
        write_csv(wide_projection(wide, key, "attribution", names), f"{output}/attributions{tail}")
        write_csv(global_importance(long), f"{output}/attribution_importance{tail}", single_file=True)
        write_csv(global_importance(long).limit(max_display), f"{output}/attribution_leading{tail}", single_file=True)
        wide.unpersist()
