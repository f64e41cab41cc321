"""Named steps with written results: a step whose table is complete is skipped, a failure stops the run and can be resumed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Make = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    make: Make
    needs: tuple[str, ...] = ()


class StepFailed(RuntimeError):
    """A step raised or one of its needs has no table; ``done`` are the steps that stand."""

    def __init__(self, step: str, done: list[str], why: str):
        super().__init__(f"{step}: {why}")
        self.step, self.done = step, done


class Runner:
    """Runs steps in order; each writes ``root/name``, whose success file marks it complete."""

    def __init__(self, spark: SparkSession, root: str, steps: list[Step]):
        self.spark, self.root, self.steps = spark, root.rstrip("/"), steps

    def complete(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def run(self, again: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        """(step, 'ran' or 'kept'). Steps in ``again``, and those that need a step that ran, run whether complete or not."""
        log: list[tuple[str, str]] = []
        for step in self.steps:
            missing = [n for n in step.needs if not self.complete(n)]
            if missing:
                raise StepFailed(step.name, [n for n, _ in log], f"needs {', '.join(missing)}")
            stale = any((n, "ran") in log for n in step.needs)
            if self.complete(step.name) and step.name not in again and not stale:
                log.append((step.name, "kept"))
                continue
            try:
                step.make({n: self.table(n) for n in step.needs}).write.mode("overwrite").parquet(f"{self.root}/{step.name}")
            except Exception as e:
                raise StepFailed(step.name, [n for n, _ in log], str(e)[:200]) from e
            log.append((step.name, "ran"))
        return log
