"""Resumable steps and saved models."""

import numpy as np
import pytest

from ledgerlens.plans.runner import Runner, Step, StepFailed
from ledgerlens.sources import models


def test_a_failed_run_is_resumed(spark, tmp_path):
    calls, broken = [], [True]

    def second(tables):
        calls.append("b")
        if broken[0]:
            raise ValueError("no disk")
        return tables["a"].selectExpr("id + 1 as id")

    steps = [Step("a", lambda _: calls.append("a") or spark.range(3)), Step("b", second, ("a",)), Step("c", lambda t: t["b"], ("b",))]
    runner = Runner(spark, f"file://{tmp_path}/out", steps)
    with pytest.raises(StepFailed) as e:
        runner.run()
    assert e.value.step == "b" and e.value.done == ["a"]
    broken[0] = False
    assert runner.run() == [("a", "kept"), ("b", "ran"), ("c", "ran")]
    assert calls == ["a", "b", "b"] and sorted(r.id for r in runner.table("c").collect()) == [1, 2, 3]
    assert [how for _, how in runner.run(("b",))] == ["kept", "ran", "ran"]
    with pytest.raises(StepFailed, match="needs"):
        Runner(spark, f"file://{tmp_path}/other", steps[1:]).run()


def test_models_keep_shapes_and_values(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    given = {"centres": np.arange(6.0).reshape(2, 3), "scale": 0.5, "empty": np.zeros((0, 3)), "odd": np.array([np.inf, -0.0])}
    models.save_model(spark, path, given)
    models.save_model(spark, path, given)
    got = models.load_model(spark, path)
    assert got["scale"] == 0.5 and all(np.array_equal(got[k], given[k]) and np.shape(got[k]) == np.shape(given[k]) for k in ("centres", "empty", "odd"))
