import pytest

from basketrank.operators import cf, models, selection
from basketrank.plans.config import Config
from basketrank.plans.registry import Registry
from basketrank.sources import interactions


def test_registry_orders_and_rejects():
    r = Registry()
    r.feature("a", ["x"], depends_on=["b"])(lambda h, t, c: t)
    r.feature("b", ["y"])(lambda h, t, c: t)
    assert r.order(["a"]) == ["b", "a"]
    with pytest.raises(ValueError):
        r.feature("a", ["z"])(lambda h, t, c: t)
    with pytest.raises(ValueError):
        r.feature("c", ["y"])(lambda h, t, c: t)
    r.feature("p", ["q"], depends_on=["s"])(lambda h, t, c: t)
    r.feature("s", ["u"], depends_on=["p"])(lambda h, t, c: t)
    for names in (["p"], ["nowhere"]):
        with pytest.raises(ValueError):
            r.order(names)


def test_config(tmp_path):
    one = Config({"data": {"target_days": 3}})
    two = one.set("model.config.depth", 4)
    assert one.get("model.config.depth") is None and two.get("model.config.depth") == 4
    assert two.get("data.holdout_days") == 0 and one.hash() != two.hash()
    two.save(path := str(tmp_path / "c.json"))
    assert Config.load(path).as_dict() == two.as_dict()


def test_selection_keeps_the_most_important_of_a_group():
    corr = {("a", "b"): 0.95, ("a", "c"): float("nan"), ("b", "c"): 0.99}
    assert selection.select(["a", "b", "c"], corr, {"b": 2.0}) == ["b", "c"]


def test_missing_table_and_submission(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        interactions.scan(spark, str(tmp_path / "none.parquet"))
    df = spark.createDataFrame([(1, 7), (2, None)], "index long, request_id long")
    interactions.write_submission(df, path := str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.csv(path, header=True).collect())) == [("1", "7"), ("2", None)]


def test_numbered_has_no_gaps(spark):
    ids = spark.range(1000).selectExpr("cast(id % 300 + 14199855617269087954 as decimal(20,0)) as user_id").repartition(5)
    found = cf.numbered(ids, "user_id", "user").collect()
    assert sorted(r.user for r in found) == list(range(300)) and len({r.user_id for r in found}) == 300


def test_tree_model_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], float(i % 2)) for i in range(40)], "x double, c string, label double")
    model = models.TreeModel(rank=True, iterations=2, depth=2).train(df, ["x"], ["c"])
    model.save(str(tmp_path / "m"))
    again = models.TreeModel.load(str(tmp_path / "m"))
    assert again.predict(df).collect() == model.predict(df).collect()
    with pytest.raises(ValueError):
        again.predict(df.drop("x"))
