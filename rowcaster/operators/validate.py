"""Checks of a table before training or scoring. All data checks share one aggregate."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    NumericType,
    ShortType,
    StructType,
)

from .features import present, quoted

# Inclusive bounds checked by column name.
RANGE_CHECKS: dict[str, tuple[float, float]] = {
    "age": (0, 120),
    "bmi": (0, 100),
    "heart_rate": (20, 220),
}
UPLOAD_COLUMNS = ["age", "gender", "bmi", "heart_rate", "blood_pressure", "cholesterol"]
VIOLATION_SCHEMA = "column string, check string, n_failed long"


class ValidationError(ValueError):
    """Raised with the list of failed (column, check, rows)."""

    def __init__(self, failures: list[tuple[str, str, int]]):
        self.failures = failures
        super().__init__("; ".join(f"{c}: {k} ({n} rows)" for c, k, n in failures))


def kind_of(data_type: DataType) -> str:
    """bool, int, float or string, tested in that order."""
    if isinstance(data_type, BooleanType):
        return "bool"
    if isinstance(data_type, (ByteType, ShortType, IntegerType, LongType)):
        return "int"
    if isinstance(data_type, (FloatType, DoubleType)):
        return "float"
    return "string"


def infer_types(schema: StructType) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in schema.fields}


def absent(df: DataFrame, names: Iterable[str]) -> list[str]:
    return sorted({c for c in names if c not in df.columns})


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    gone = absent(df, required)
    if gone:
        raise ValueError(f"the table lacks {', '.join(gone)}")


def require_target(df: DataFrame, target: str) -> None:
    if absent(df, [target]):
        raise ValueError(f"no column {target} to learn; the table has {', '.join(df.columns)}")


def target_name(config: dict) -> str | None:
    """The first of the two places that name the target."""
    places = (("dataset", "target"), ("target", "name"))
    named = [(config.get(part) or {}).get(option) for part, option in places]
    return next((n for n in named if n is not None), None)


def check_upload(file_name: str, df: DataFrame, required: Sequence[str] = UPLOAD_COLUMNS) -> None:
    if not file_name.endswith(".csv"):
        raise ValueError(f"{file_name} is not named .csv")
    require_columns(df, required)


def _lines(df: DataFrame, aggregates: list[Column], lines: list[Column]) -> DataFrame:
    return df.agg(*aggregates).select(F.inline(F.array(*lines)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, n_rows, nullable): a number is nullable if it has gaps, text always."""
    columns = list(columns or df.columns)
    aggregates = [F.count("*").alias("n_rows")]
    lines = []
    for i, c in enumerate(columns):
        aggregates.append(F.count_if(present(df.schema, c).isNull()).alias(f"g{i}"))
        numeric = isinstance(df.schema[c].dataType, NumericType)
        lines.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"g{i}").alias("n_null"),
                F.col("n_rows"),
                (F.col(f"g{i}") > 0 if numeric else F.lit(True)).alias("nullable"),
            )
        )
    return _lines(df, aggregates, lines)


def outside(schema: StructType, c: str, low: float, high: float) -> Column:
    """False for a gap, NULL or NaN."""
    return F.coalesce(~present(schema, c).between(low, high), F.lit(False))


def range_violations(
    df: DataFrame, checks: dict[str, tuple[float, float] | Column] = RANGE_CHECKS
) -> DataFrame:
    """(column, check, n_failed) per check on a present column; a gap passes.

    A check is an inclusive range or a predicate that must hold.
    """
    aggregates, lines = [], []
    for i, (c, check) in enumerate((c, k) for c, k in checks.items() if c in df.columns):
        bad = outside(df.schema, c, *check) if isinstance(check, tuple) else ~check
        name = f"between {check[0]} and {check[1]}" if isinstance(check, tuple) else "predicate"
        aggregates.append(F.count_if(bad).alias(f"b{i}"))
        lines.append(
            F.struct(F.lit(c).alias("column"), F.lit(name).alias("check"), F.col(f"b{i}").alias("n_failed"))
        )
    if not lines:
        return df.sparkSession.createDataFrame([], VIOLATION_SCHEMA)
    return _lines(df, aggregates, lines)


def violating_rows(df: DataFrame, checks: dict[str, tuple[float, float]] = RANGE_CHECKS) -> DataFrame:
    bad = F.lit(False)
    for c, (low, high) in checks.items():
        if c in df.columns:
            bad = bad | outside(df.schema, c, low, high)
    return df.where(bad)


@dataclass
class Contract:
    """What a table must look like: kind, nullability and bounds per column."""

    kinds: dict[str, str]
    nullable: dict[str, bool]
    checks: dict[str, list[float]]

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    def only(self, columns: Sequence[str]) -> Contract:
        """The part of the contract that is about some columns."""
        parts = [{c: d[c] for c in columns if c in d} for d in (self.kinds, self.nullable, self.checks)]
        return Contract(*parts)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Contract:
        return Contract(**json.loads(text))

    def by_schema(self, df: DataFrame) -> list[tuple[str, str, int]]:
        """What the columns themselves fail."""
        found = [(c, "column present", 1) for c in self.kinds if c not in df.columns]
        return found + [
            (c, f"type {kind}", 1) for c, kind in self.kinds.items() if c in df.columns and kind_of(df.schema[c].dataType) != kind
        ]

    def by_rows(self, df: DataFrame) -> list[tuple[str, str, Column]]:
        """(column, check, failing rows) of the columns that are as they should be."""
        failed = {c for c, _, _ in self.by_schema(df)}
        out = []
        for c in self.kinds:
            if c in failed:
                continue
            if not self.nullable[c]:
                out.append((c, "not null", present(df.schema, c).isNull()))
            if c in self.checks:
                low, high = self.checks[c]
                out.append((c, f"between {low} and {high}", outside(df.schema, c, low, high)))
        return out

    def failures(self, df: DataFrame) -> DataFrame:
        """(column, check, n_failed) with only failed checks; one aggregate for all data checks."""
        tests = self.by_rows(df)
        out = df.sparkSession.createDataFrame(self.by_schema(df), VIOLATION_SCHEMA)
        if tests:
            aggregates = [F.count_if(bad).alias(f"b{i}") for i, (_, _, bad) in enumerate(tests)]
            lines = [
                F.struct(F.lit(c).alias("column"), F.lit(check).alias("check"), F.col(f"b{i}").alias("n_failed"))
                for i, (c, check, _) in enumerate(tests)
            ]
            out = out.unionByName(_lines(df, aggregates, lines).where("n_failed > 0"))
        return out

    def validate(self, df: DataFrame) -> None:
        rows = [tuple(r) for r in self.failures(df).collect()]
        if rows:
            raise ValidationError(sorted(rows))


def build_contract(
    df: DataFrame,
    target: str | None,
    required: Iterable[str] = (),
    categorical_overrides: Iterable[str] = (),
    numerical_overrides: Iterable[str] = (),
    checks: dict[str, tuple[float, float]] = RANGE_CHECKS,
) -> Contract:
    """Contract inferred from the table itself; overrides change the expected kind only."""
    require_columns(df, required)
    columns = [c for c in df.columns if c != target]
    kinds = infer_types(df.select(*[quoted(c) for c in columns]).schema)
    kinds |= {c: "float" for c in numerical_overrides if c in kinds}
    kinds |= {c: "string" for c in categorical_overrides if c in kinds}
    nullable = (
        {r["column"]: r["nullable"] for r in null_profile(df, columns).collect()} if columns else {}
    )
    return Contract(kinds, nullable, {c: list(v) for c, v in checks.items() if c in kinds})


def learned(df: DataFrame, config: dict, targets: Sequence[str]) -> Contract:
    """The contract of ``build_contract`` for the columns besides the targets, checked against the rows, in one aggregate."""
    data = config.get("dataset", {})
    require_columns(df, data.get("required_columns") or ())
    columns = [c for c in df.columns if c not in targets]
    kinds = infer_types(df.select(*[quoted(c) for c in columns]).schema)
    kinds |= {c: "float" for c in data.get("numerical_overrides") or () if c in kinds}
    kinds |= {c: "string" for c in data.get("categorical_overrides") or () if c in kinds}
    contract = Contract(kinds, dict.fromkeys(kinds, True), {c: list(v) for c, v in RANGE_CHECKS.items() if c in kinds})
    failed, tests = contract.by_schema(df), contract.by_rows(df)
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    counts = [F.count_if(bad).alias(f"b{i}") for i, (_, _, bad) in enumerate(tests)]
    counts += [F.count_if(present(df.schema, c).isNull()).alias(f"g{i}") for i, c in enumerate(numbers)]
    if counts:
        row = df.agg(*counts).first()
        failed += [(c, check, row[f"b{i}"]) for i, (c, check, _) in enumerate(tests) if row[f"b{i}"]]
        contract.nullable |= {c: row[f"g{i}"] > 0 for i, c in enumerate(numbers)}
    if failed:
        raise ValidationError(sorted(failed))
    return contract


def validate_training(df: DataFrame, config: dict) -> Contract:
    data = config.get("dataset", {})
    target = target_name(config)
    contract = build_contract(
        df,
        target,
        data.get("required_columns") or (),
        data.get("categorical_overrides") or (),
        data.get("numerical_overrides") or (),
    )
    contract.validate(df.drop(target) if target else df)
    return contract


def validate_scoring(df: DataFrame, contract: Contract) -> None:
    contract.validate(df)
