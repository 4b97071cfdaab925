"""rowcaster: tabular classification and scoring as Spark jobs.

``functions``  column expressions (no job, no shuffle)
``operators``  validation, feature fitting, weights, metrics, models, explanation
``sources``    CSV scans and sinks, saved artifacts, rule-based row generators
``plans``      the training, scoring, tuning and explanation jobs built from them
"""
