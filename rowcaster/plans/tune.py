"""Parameter search on a CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tune import random_search
from ..sources.artifacts import save_json
from ..sources.csv import write_csv
from .train import fold_table, prepare_table


def tune(spark: SparkSession, df: DataFrame, config: dict, output: str) -> tuple[dict, DataFrame]:
    """(best parameters, trials), both saved below ``output``."""
    data, key, index, *_ = prepare_table(df, config)
    folded = fold_table(data, key, index, config)
    options = config["tuning"]
    minutes = options.get("timeout_minutes")
    best, trials = random_search(
        folded,
        config,
        config["evaluation"]["metric"],
        options["n_trials"],
        None if minutes is None else 60.0 * minutes,
        config["model"]["random_state"],
        options.get("ranges"),
    )
    save_json(spark, best, f"{output}/best_params")
    write_csv(trials, f"{output}/trials", single_file=True)
    return best, trials
