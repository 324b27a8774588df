"""A model and its parameters are published together or not at all."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from barloom.sources import store


def model(x):
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {x} AS y FROM __THIS__")])


def test_a_crash_between_the_two_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    params = lambda x: spark.createDataFrame([("a", "close", 0.0, float(x))], "ticker string, feature string, f_min double, f_max double")
    loaded = lambda: [(m.transform(spark.range(1)).first().y, p.first().f_max) for m, p in [store.load_fit(spark, str(tmp_path), "gbt", "1h", 3)]][0]
    with pytest.raises(FileNotFoundError):
        loaded()
    store.save_fit(model(1), params(1), str(tmp_path), "gbt", "1h", 3)
    assert loaded() == (1, 1.0)

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "save_params", dies)
        with pytest.raises(RuntimeError):
            store.save_fit(model(2), params(2), str(tmp_path), "gbt", "1h", 3)
    assert loaded() == (1, 1.0)
    store.save_fit(model(3), params(3), str(tmp_path), "gbt", "1h", 3)
    assert loaded() == (3, 3.0)
