"""Job options as a nested dict with defaults and dotted overrides."""

from __future__ import annotations

import copy
from typing import Any

# Shipped option defaults.
DEFAULTS: dict[str, Any] = {
    "target": {"name": "prognosis", "multilabel": False, "multilabel_columns": []},
    "dataset": {
        "drop_patterns": ["*discharge*", "*bill*", "*final*"],
        "categorical_overrides": [],
        "numerical_overrides": [],
        "required_columns": [],
    },
    "cv": {"folds": 5, "stratify": True, "group_col": None, "parallelism": 2},
    "features": {
        "enable_missing_count": True,
        "enable_age_binning": True,
        "enable_interactions": False,
        "interaction_pairs": [],
        "scaler": "standard",
    },
    "model": {
        "name": "xgb",
        "random_state": 42,
        "top_k": 3,
        "logistic": {"C": 1.0, "penalty": "l2"},
        "xgboost": {
            "n_estimators": 200,
            "learning_rate": 0.1,
            "max_depth": 5,
            "subsample": 0.8,
            "colsample_bytree": 0.8,
            "gamma": 0.0,
            "min_child_weight": 1.0,
        },
    },
    "imbalance": {"enable": True, "scheme": "inverse_freq"},
    "calibration": {"apply": False, "methods": ["sigmoid", "isotonic"], "in_sample": False, "cv": None},  # cv: folds, by default those of cv
    "evaluation": {"metric": "roc_auc"},
    "tuning": {"n_trials": 30, "timeout_minutes": 15},
    "explain": {"sample": 2000, "top_features": 10, "classes": None},
    "inference": {"top_k": 3, "multilabel_threshold": 0.5, "threshold": None},
    "key": None,
}


def make_config(overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with overrides such as ``{"model.name": "logreg"}``."""
    config = copy.deepcopy(DEFAULTS)
    for path, value in (overrides or {}).items():
        *parents, last = path.split(".")
        at = config
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return config
