import math

import pytest
from pyspark.sql import functions as F

from rowcaster.functions import scalar
from rowcaster.functions.hashing import arithmetic_unit, normal
from rowcaster.operators import validate
from rowcaster.operators.labels import LabelIndex
from rowcaster.operators.select import with_row_id
from rowcaster.sources import artifacts, csv, generated


def write(path, text):
    path.write_text(text)
    return str(path)


def test_inferred_types_and_null_texts(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "i,gap,f,b,bgap,s,q,e\n1,4,1.5,True,True,x,\"a, \"\"b\"\"\",\n2,NA,2,False,,null,c,\n3,6,1e3,True,False,5,d,\n",
    )
    df = csv.read_csv(spark, path)
    kinds = dict(df.dtypes)
    assert kinds == {
        "i": "bigint", "gap": "double", "f": "double", "b": "boolean", "bgap": "string", "s": "string",
        "q": "string", "e": "double",
    }
    got = df.orderBy("i").collect()
    assert [r["gap"] for r in got] == [4.0, None, 6.0]
    assert [r["s"] for r in got] == ["x", None, "5"] and got[0]["q"] == 'a, "b"'


def test_schema_is_applied_by_name(spark, tmp_path):
    train = csv.read_csv(spark, write(tmp_path / "t.csv", "a,b\n1,x\n2,y\n"))
    score = csv.read_csv(spark, write(tmp_path / "s.csv", "extra,b,a\nq,7,N/A\nr,z,5\n"), train.schema)
    assert dict(score.dtypes) == {"extra": "string", "b": "string", "a": "bigint"}
    assert [r["a"] for r in score.orderBy("extra").collect()] == [None, 5]


def test_rejects(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), (" 2.5 ",)], "c string")
    assert csv.reject_counts(df, ["c"]).first()["n_rejected"] == 1
    assert [r[0] for r in df.select(scalar.to_number("c")).collect()][:3] == [1.0, None, None]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None), (2, "b", 2.5)], "k long, s string, x double")
    csv.write_csv(df, str(tmp_path / "out"), single_file=True)
    assert sorted(csv.read_csv(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_artifacts(spark, tmp_path):
    index = LabelIndex(["a", "b"])
    artifacts.save_labels(spark, index, str(tmp_path / "l"))
    assert artifacts.load_labels(spark, str(tmp_path / "l")) == index
    artifacts.save_json(spark, {"x": [1, None]}, str(tmp_path / "j"))
    assert artifacts.load_json(spark, str(tmp_path / "j")) == {"x": [1, None]}
    artifacts.require_artifact(spark, str(tmp_path / "j"), "Meta")
    with pytest.raises(FileNotFoundError, match="no Model"):
        artifacts.require_artifact(spark, str(tmp_path / "none"), "Model")


def test_row_numbers_over_many_files(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "p"))
    numbered = with_row_id(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(r["row_id"] for r in numbered.collect()) == list(range(1000))
    plain = with_row_id(spark.range(100).withColumn("a b", F.lit(1)))  # no scan of files
    assert plain.columns == ["id", "a b", "row_id"]
    assert sorted(r["row_id"] for r in plain.collect()) == list(range(100)) and plain.where("id <> row_id").count() == 0
    assert with_row_id(spark.range(0)).collect() == []


def test_ranges_are_inclusive_and_skip_gaps(spark):
    df = spark.createDataFrame([(0.0,), (120.0,), (121.0,), (None,)], "age double")
    assert [tuple(r) for r in validate.range_violations(df).collect()] == [("age", "between 0 and 120", 1)]
    assert [r["age"] for r in validate.violating_rows(df).collect()] == [121.0]
    custom = validate.range_violations(df, {"age": F.col("age") < 100})
    assert custom.first()["n_failed"] == 2


def test_contract(spark):
    df = spark.createDataFrame([(1, "a", 30.0, 1), (2, None, None, 0)], "k int, s string, age double, y int")
    config = {"target": {"name": "y"}, "dataset": {"required_columns": ["age"]}}
    contract = validate.validate_training(df, config)
    assert contract.kinds == {"k": "int", "s": "string", "age": "float"}
    assert contract.nullable == {"k": False, "s": True, "age": True}
    assert validate.Contract.from_json(contract.to_json()) == contract
    bad = spark.createDataFrame([(None, "a", 130.0)], "k int, s string, age double")
    with pytest.raises(validate.ValidationError) as error:
        validate.validate_scoring(bad, contract)
    assert sorted(f[0] for f in error.value.failures) == ["age", "k"]
    with pytest.raises(validate.ValidationError, match="type float"):
        validate.validate_training(df, {"target": {"name": "y"}, "dataset": {"numerical_overrides": ["k"]}})
    with pytest.raises(ValueError, match="u, v") as error:
        validate.require_columns(df, ["v", "u", "k"])
    assert "k" not in str(error.value).split()
    with pytest.raises(ValueError, match=r"\bz\b"):
        validate.require_target(df, "z")
    with pytest.raises(ValueError, match=r"a\.txt"):
        validate.check_upload("a.txt", df)
    assert validate.target_name({"dataset": {"target": "d"}, "target": {"name": "t"}}) == "d"


def test_uniform_and_normal_shapes(spark):
    df = spark.range(20000).select(
        arithmetic_unit("id", 3).alias("u"), arithmetic_unit("id", 4).alias("v"), normal("id", 10, 2, 5).alias("z")
    )
    row = df.agg(
        F.avg("u"), F.var_pop("u"), F.corr("u", "v"), F.avg("z"), F.stddev("z"), F.skewness("z"), F.kurtosis("z"),
        F.count_distinct("u"),
    ).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 1 / 12) < 0.002 and abs(row[2]) < 0.03
    assert abs(row[3] - 10) < 0.05 and abs(row[4] - 2) < 0.05 and abs(row[5]) < 0.06 and abs(row[6]) < 0.12
    assert row[7] == 20000


def test_generated_tables(spark):
    keys = generated.range_keys(spark, 5000)
    binary = generated.binary_rows(keys)
    line = binary.agg(F.min("age"), F.max("age"), F.avg("bmi"), F.avg("outcome"), F.count_distinct("gender")).first()
    assert line[0] == 20 and line[1] == 79 and abs(line[2] - 28) < 0.3 and 0.3 < line[3] < 0.8 and line[4] == 2
    multi = generated.multiclass_rows(keys)
    counts = {r["prognosis"]: r["n_rows"] for r in generated.label_distribution(multi).collect()}
    assert sum(counts.values()) == 5000 and {"Diabetes", "Heart_Disease", "Arthritis", "Hypertension", "Asthma"} <= set(counts)
    line = multi.agg(F.min("bmi"), F.max("bmi"), F.min("age"), F.max("age")).first()
    assert line[0] >= 15 and line[1] <= 50 and line[2] == 18 and line[3] == 84
    tiers = generated.tiered_rows(keys).withColumn("tier", scalar.rule_tier(scalar.rule_score(scalar.RISK_THRESHOLDS)))
    for r in tiers.select("tier", "prognosis").distinct().collect():
        assert r["prognosis"] in generated.TIER_CLASSES[r["tier"]]
    assert sorted(multi.collect()) == sorted(generated.multiclass_rows(keys.repartition(6)).collect())


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, "MALE"), (float("nan"), "f"), (-3.0, None), (9.0, "1")], "x double, s string").coalesce(1)
    got = [r[0] for r in df.select(scalar.clip("x", 0, 5)).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [0.0, 5.0]
    assert [r[0] for r in df.select(scalar.sex_code("s")).collect()] == [1.0, 0.0, None, 1.0]
    assert [r[0] for r in df.select(scalar.rule_score([(F.col("x"), 1.0)])).collect()][2:] == [0, 1]
