"""Feature preprocessing learned in a few aggregate passes, applied as column expressions.

The fit reads the table for moments, for the exact medians (one more pass up to 200
thousand rows; a sampling and a counting pass for every narrowing beyond), and for one
grouped count of the text columns, whose values stay a table (``dictionary``). Mean and deviation after imputation follow from the moments
of the present values, so they need no pass of their own. Several row masks (the training
parts of k folds) are fitted in the same passes.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from ..functions.scalar import AGE_EDGES, bin_index, nan_to_null
from ..session import current
from .dictionary import build_dictionary, copy_dictionary, read_dictionary, with_place
from .quantiles import exact_medians
from .select import column_roles, leakage_columns

MISSING = "missing"
EPSILON = 2.0**-52
NAMED = 100_000  # categories up to which results may have a name or a column for each
WIDE = 100_000  # entries above which vectors are put together from places, without library stages

# the vector function is sent to the executors whole; they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class FeatureOptions:
    drop_patterns: list[str] = field(default_factory=list)
    categorical_overrides: list[str] = field(default_factory=list)
    numerical_overrides: list[str] = field(default_factory=list)
    missing_count: bool = False
    bin_column: str | None = None
    bin_edges: list[float] = field(default_factory=lambda: list(AGE_EDGES))
    interaction_pairs: list[list[str]] = field(default_factory=list)
    scaler: str = "standard"

    @staticmethod
    def from_config(config: dict) -> FeatureOptions:
        data, feats = config.get("dataset", {}), config.get("features", {})
        return FeatureOptions(
            drop_patterns=list(data.get("drop_patterns") or []),
            categorical_overrides=list(data.get("categorical_overrides") or []),
            numerical_overrides=list(data.get("numerical_overrides") or []),
            missing_count=bool(feats.get("enable_missing_count", False)),
            bin_column="age" if feats.get("enable_age_binning", False) else None,
            interaction_pairs=[list(p) for p in feats.get("interaction_pairs") or []]
            if feats.get("enable_interactions", False)
            else [],
            scaler=feats.get("scaler", "standard"),
        )


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present(schema: StructType, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = quoted(name)
    return nan_to_null(c) if isinstance(schema[name].dataType, (DoubleType, FloatType)) else c


def as_number(schema: StructType, name: str) -> Column:
    if isinstance(schema[name].dataType, StringType):
        return nan_to_null(quoted(name).try_cast("double"))
    return present(schema, name).cast("double")


def as_text(schema: StructType, name: str) -> Column:
    return present(schema, name).cast("string")


def imputed_moments(n: int, mean: float, var: float, n_null: int, fill: float) -> tuple[float, float]:
    """Mean and population deviation after filling ``n_null`` gaps with ``fill``."""
    total = n + n_null
    shift = fill - mean
    new_mean = mean + shift * n_null / total
    new_var = (n * var + shift * shift * n * n_null / total) / total
    if new_var <= (64 * EPSILON * new_mean) ** 2:
        new_var = 0.0
    return new_mean, math.sqrt(new_var)


def category_counts(df: DataFrame, columns: Sequence[str], masks: Sequence[Column]) -> DataFrame:
    """(column, value, n0, n1..): rows per distinct value and mask, one grouped count for all columns."""
    flags = [F.coalesce(m, F.lit(False)).cast("long").alias(f"_m{i}") for i, m in enumerate(masks)]
    entries = df.select(*flags, F.inline(_text_entries(df, columns))).where(F.col("value").isNotNull())
    return entries.groupBy("column", "value").agg(*[F.sum(f"_m{i}").alias(f"n{i}") for i in range(len(masks))])


def fit_features(
    df: DataFrame,
    options: FeatureOptions,
    exclude: Sequence[str] = (),
    masks: Sequence[Column] | None = None,
) -> list[dict]:
    """One parameter set per row mask (default: one set over all rows)."""
    whole = masks is None
    masks = [F.lit(True)] if whole else list(masks)
    leaks = leakage_columns([c for c in df.columns if c not in exclude], options.drop_patterns)
    schema = df.schema
    roles = column_roles(
        schema, options.categorical_overrides, options.numerical_overrides, [*exclude, *leaks]
    )
    names = [c for c in df.columns if c not in exclude and c not in leaks]

    exprs = {}
    for i, m in enumerate(masks):
        for j, c in enumerate(roles.numeric):
            x = as_number(schema, c)
            exprs[f"{i}:{j}"] = x if whole else F.when(m, x)
    fit = exact_medians(df, exprs, True, {str(i): m for i, m in enumerate(masks)})
    path, facts = None, [{}] * len(masks)
    if roles.categorical:
        path, facts = build_dictionary(category_counts(df, roles.categorical, masks), roles.categorical, len(masks))

    fitted = []
    for i in range(len(masks)):
        params = {
            "options": asdict(options),
            "dropped": leaks,
            "ignored": roles.ignored,
            "all_null": [],
            "counted": names,
            "numeric": [],
            "medians": {},
            "means": {},
            "stds": {},
            "categorical": roles.categorical,
            "modes": {},
            "sizes": {},
            "bytes": {},
            "dictionary": path,
            "mask": i,
        }
        for j, c in enumerate(roles.numeric):
            median = fit.values[f"{i}:{j}"]
            if median is None:
                params["all_null"].append(c)
                continue
            n, mean, var = fit.moments[f"{i}:{j}"]
            mean, std = imputed_moments(n, mean, var, fit.counted[str(i)] - n, median)
            params["numeric"].append(c)
            params["medians"][c], params["means"][c] = median, mean
            params["stds"][c] = std or 1.0
        for c in roles.categorical:
            params["modes"][c] = facts[i][c].mode if facts[i][c].size else MISSING
            params["sizes"][c], params["bytes"][c] = facts[i][c].size, facts[i][c].bytes
        fitted.append(params)
    return fitted


def plain_columns(params: dict, schema: StructType) -> tuple[list, list]:
    """Named expressions that stand before and after the one-hot columns."""
    options = params["options"]
    before: list[tuple[str, Column]] = []
    if options["missing_count"]:
        gaps = F.lit(0)
        for c in params["counted"]:
            gaps = gaps + present(schema, c).isNull().cast("int")
        before.append(("missing_count", gaps.cast("double")))

    filled = {
        c: F.coalesce(as_number(schema, c), F.lit(params["medians"][c])) for c in params["numeric"]
    }
    if options["scaler"] == "standard":
        scaled = {
            c: (x - F.lit(params["means"][c])) / F.lit(params["stds"][c]) for c, x in filled.items()
        }
    else:
        scaled = filled
    before += list(scaled.items())

    binned = options["bin_column"]
    if binned in filled:
        before.append((f"{binned}_bin", bin_index(filled[binned], options["bin_edges"]).cast("double")))
    pairs = [p for p in options["interaction_pairs"] if len(p) == 2 and p[0] in scaled and p[1] in scaled]
    return before, [(f"{a}_x_{b}", scaled[a] * scaled[b]) for a, b in pairs]


def category_value(params: dict, schema: StructType, c: str) -> Column:
    return F.coalesce(as_text(schema, c), F.lit(params["modes"][c]))


def width(params: dict, c: str) -> int:
    """Entries of a text column; one without values has the missing value alone."""
    return max(1, params["sizes"][c])


def dictionary_of(params: dict) -> DataFrame:
    return read_dictionary(current(), params["dictionary"], params["mask"])


def category_lists(params: dict) -> dict[str, list[str]]:
    """The values of each text column in order, for results with a column for each of them."""
    if not params["categorical"]:
        return {}
    total = sum(width(params, c) for c in params["categorical"])
    if total > NAMED:
        raise ValueError(f"{total} categories are too many for a column each; read them from the dictionary")
    out: dict[str, list[str]] = {c: [] for c in params["categorical"]}
    for r in dictionary_of(params).orderBy("column", "place").collect():  # at most NAMED rows
        out[r["column"]].append(r["value"])
    return {c: v or [MISSING] for c, v in out.items()}


def feature_columns(params: dict, schema: StructType) -> list[tuple[str, Column]]:
    """Named expressions in output order: missing count, numbers, bin, one-hots, products.

    One expression per category; ``FeatureModel`` needs none.
    """
    before, after = plain_columns(params, schema)
    hot = [
        (f"{c}_{v}", (category_value(params, schema, c) == F.lit(v)).cast("double"))
        for c, values in category_lists(params).items()
        for v in values
    ]
    return before + hot + after


def imputed(df: DataFrame, params: dict) -> DataFrame:
    """``df`` with gaps of the fitted columns filled."""
    fills = {
        c: F.coalesce(as_number(df.schema, c), F.lit(params["medians"][c])) for c in params["numeric"]
    }
    fills |= {
        c: F.coalesce(as_text(df.schema, c), F.lit(params["modes"][c])) for c in params["categorical"]
    }
    return df.withColumns(fills)


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str], categories: DataFrame) -> DataFrame:
    """One-hot entries (key, column, value) for columns of any cardinality.

    ``categories`` holds the fitted, distinct (column, value) pairs; unknown values yield no
    entry. Adaptive execution chooses the join by the size it finds and splits hot values.
    """
    long = df.select(key, F.inline(_text_entries(df, columns))).where(F.col("value").isNotNull())
    return long.join(categories, ["column", "value"], "left_semi")


def category_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs as a table, for columns of any cardinality."""
    return df.select(F.inline(_text_entries(df, columns))).where(F.col("value").isNotNull()).distinct()


def _text_entries(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.array(
        *[F.struct(F.lit(c).alias("column"), as_text(df.schema, c).alias("value")) for c in columns]
    )


class _StateParams(Params):
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "fitted parameters as JSON", TypeConverters.toString)


class FeatureModel(Model, _StateParams, MLWritable, MLReadable):
    """Adds the feature vector."""

    def __init__(self, state: dict | None = None, outputCol: str = "features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(outputCol=outputCol)
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def params_dict(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def plain_schema(self) -> StructType:
        """Stands for the table where only the names of features are wanted."""
        params = self.params_dict
        schema = StructType()
        for c in [*params["numeric"], *(c for c in params["counted"] if c not in params["numeric"])]:
            schema.add(c, DoubleType() if c in params["numeric"] else StringType())
        return schema

    @property
    def n_features(self) -> int:
        params = self.params_dict
        before, after = plain_columns(params, self.plain_schema)
        return len(before) + sum(width(params, c) for c in params["categorical"]) + len(after)

    @property
    def feature_names(self) -> list[str]:
        """Names in the order of the vector; ``names`` has them as a table, for vectors of any width."""
        return [name for name, _ in feature_columns(self.params_dict, self.plain_schema)]

    def names(self) -> DataFrame:
        """(position, feature)."""
        params = self.params_dict
        before, after = plain_columns(params, self.plain_schema)
        spark, at = current(), len(before)
        known = [(i, n) for i, (n, _) in enumerate(before)]
        parts = []
        for c in params["categorical"]:
            if params["sizes"][c]:
                own = dictionary_of(params).where(F.col("column") == c)
                parts.append(own.select((F.col("place") + at).alias("position"), F.concat(F.lit(f"{c}_"), "value").alias("feature")))
            else:
                known.append((at, f"{c}_{MISSING}"))
            at += width(params, c)
        known += [(at + i, n) for i, (n, _) in enumerate(after)]
        out = spark.createDataFrame(known, "position long, feature string")
        for part in parts:
            out = out.unionByName(part)
        return out

    def required_columns(self) -> list[str]:
        params = self.params_dict
        used = set(params["numeric"]) | set(params["categorical"])
        if params["options"]["missing_count"]:
            used |= set(params["counted"])
        return sorted(used)

    def placed(self, dataset: DataFrame, dictionary: DataFrame | None = None, more: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
        """Adds the place of each text column's value (null: unknown) by joins; returns their names."""
        params, schema = self.params_dict, dataset.schema
        values = {c: category_value(params, schema, c) for c in params["categorical"]}
        out, places = dataset, []
        if dictionary is None and any(params["sizes"][c] for c in values):
            dictionary = dictionary_of(params)
        for i, (c, value) in enumerate(values.items()):
            places.append(f"_i{i}")
            if params["sizes"][c]:
                out = with_place(out, dictionary, c, value, f"_i{i}", params["bytes"][c], params["sizes"][c], more)
            else:
                out = out.withColumn(f"_i{i}", F.when(value == MISSING, F.lit(0).cast("long")))
        return out, places

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Numbers are expressions, places of categories come from the dictionary by a join per text column. Unknown
        values get no entry. The plan is as wide for one category as for many."""
        params = self.params_dict
        before, after = plain_columns(params, dataset.schema)
        names = {f"_f{i}": x for i, (_, x) in enumerate(before + after)}
        out, places = self.placed(dataset.withColumns(names))
        n, vector = len(before), self.getOrDefault(self.outputCol)
        numbers, sizes = list(names), [width(params, c) for c in params["categorical"]]
        if sum(sizes) > WIDE:
            parts = [F.array(*[F.col(c) for c in part]).cast("array<double>") for part in (numbers[:n], places, numbers[n:])]
            return out.withColumn(vector, sparse_vectors(sizes, n, len(after))(*parts)).drop(*names, *places)
        vectors = [f"_h{i}" for i in range(len(places))]
        if places:
            # the slot past the last category is for unknown values; with its size named, the encoder needs no pass
            coded = {
                p: F.coalesce(F.col(p).cast("double"), F.lit(float(k))).alias(p, metadata={"ml_attr": {"type": "nominal", "num_vals": k + 1}})
                for p, k in zip(places, sizes)
            }
            out = out.select(*[coded.get(c, quoted(c)) for c in out.columns])
            out = OneHotEncoder(inputCols=places, outputCols=vectors, dropLast=True).fit(out).transform(out)
        assembler = VectorAssembler(inputCols=[*numbers[:n], *vectors, *numbers[n:]], outputCol=vector)
        # without attributes, as learners would read the 0/1 entries as categories of their own
        plain = F.col(vector).alias(vector, metadata={})
        return assembler.transform(out).drop(*names, *places, *vectors).withColumn(vector, plain)

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureReader()


def sparse_vectors(sizes: list[int], n_before: int, n_after: int):
    """A column function of (numbers, places, numbers) to sparse vectors."""
    offsets = n_before + np.cumsum([0, *sizes])
    total = int(offsets[-1]) + n_after
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    @F.arrow_udf(VectorUDT())
    def vectors(before: pa.Array, places: pa.Array, after: pa.Array) -> pa.Array:
        n = len(places)

        def matrix(part: pa.Array, columns: int) -> np.ndarray:
            return part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, columns)

        at = np.concatenate([np.tile(np.arange(n_before, dtype=float), (n, 1)), matrix(places, len(sizes)) + offsets[:-1], np.tile(offsets[-1] + np.arange(n_after, dtype=float), (n, 1))], axis=1)
        x = np.concatenate([matrix(before, n_before), np.ones((n, len(sizes))), matrix(after, n_after)], axis=1)
        has = ~np.isnan(at) & (x != 0)
        ends = pa.array(np.append(0, np.cumsum(has.sum(axis=1))), pa.int32())
        parts = [pa.ListArray.from_arrays(ends, pa.array(v[has], t)) for v, t in ((np.nan_to_num(at).astype(np.int32), pa.int32()), (x, pa.float64()))]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, total, np.int32)), *parts], fields=list(kind))

    return vectors


class _FeatureWriter(MLWriter):
    def __init__(self, instance: FeatureModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        params = self.instance.params_dict
        if params["dictionary"]:
            copy_dictionary(dictionary_of(params), f"{path}/dictionary")


class _FeatureReader(MLReader):
    def load(self, path: str) -> FeatureModel:
        """The dictionary is read from beside the model, wherever that now lies."""
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = FeatureModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        params = model.params_dict
        if params["dictionary"]:
            model._set(state=json.dumps(params | {"dictionary": f"{path}/dictionary", "mask": 0}))
        return model


class FeatureBuilder(Estimator, _StateParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the parameters of ``FeatureModel``; ``exclude`` names label, key and weight."""

    exclude = Param(Params._dummy(), "exclude", "columns never used", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, options: FeatureOptions | None = None, exclude=(), outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features", exclude=[])
        self._set(
            outputCol=outputCol,
            exclude=list(exclude),
            state=json.dumps(asdict(options or FeatureOptions())),
        )

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        options = FeatureOptions(**json.loads(self.getOrDefault(self.state)))
        state = fit_features(dataset, options, self.getOrDefault(self.exclude))[0]
        return FeatureModel(state, self.getOrDefault(self.outputCol))
