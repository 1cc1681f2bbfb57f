"""Writing results: CSV and Parquet submissions, training matrices, stage tables with retention, models, logs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.boosting import Model
from weekloom.params import Params


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_matrix(df: DataFrame, features: list[str], path: str, target: str = "qty") -> None:
    """Features and, last, the target."""
    write_csv(df.select(*features, target), path)


def feature_kinds(spark: SparkSession, features: list[str]) -> DataFrame:
    kind = lambda f: "categorical" if f.startswith(("categoria_", "premise_")) or f.endswith("_target_enc") or "_emb_" in f else "numerical"
    return spark.createDataFrame([(f, kind(f)) for f in features], "feature_name string, feature_type string")


def write_submission(predictions: DataFrame, path: str, kind: str = "csv") -> None:
    """semana, pdv, produto, quantidade; CSV is one file with semicolons."""
    out = predictions.select("semana", "pdv", "produto", "quantidade")
    if kind == "csv":
        write_csv(out, path, ";", one_file=True)
    else:
        out.write.mode("overwrite").parquet(path)


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _filesystem(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2).encode()))
    finally:
        out.close()


def _read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("".join(r.value + "\n" for r in spark.read.text(path, wholetext=True).collect()))


def state_of(spark: SparkSession, path: str) -> str:
    """Files of an input with their sizes and times, so that a replaced input is another one."""
    fs, p = _filesystem(spark, path)
    files = sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(p))
    return ",".join(files)


class StageCache:
    """Stage tables by a key of all parameters and inputs; the newest few are kept."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 5) -> None:
        self.spark, self.folder, self.keep = spark, folder, keep

    def path(self, params: Params, *inputs: str) -> str:
        return f"{self.folder}/stage-{params.key(*inputs)}"

    def load(self, params: Params, *inputs: str) -> DataFrame | None:
        path = self.path(params, *inputs)
        fs, p = _filesystem(self.spark, f"{path}/_SUCCESS")
        return self.spark.read.parquet(path) if fs.exists(p) else None

    def save(self, df: DataFrame, params: Params, *inputs: str) -> DataFrame:
        path = self.path(params, *inputs)
        df.write.mode("overwrite").parquet(path)
        self._prune()
        return self.spark.read.parquet(path)

    def _stages(self) -> list:
        fs, p = _filesystem(self.spark, f"{self.folder}/stage-*")
        return sorted(fs.globStatus(p) or [], key=lambda s: s.getModificationTime(), reverse=True)

    def _prune(self) -> None:
        for old in self._stages()[self.keep :]:
            _filesystem(self.spark, self.folder)[0].delete(old.getPath(), True)

    def clear(self) -> int:
        stages = self._stages()
        for s in stages:
            _filesystem(self.spark, self.folder)[0].delete(s.getPath(), True)
        return len(stages)


def write_experiment(spark: SparkSession, path: str, params: Params, wmape: float, predictions: int, seconds: dict[str, float] | None = None) -> dict:
    """A log of one run: time, parameters, score, size, and seconds by stage."""
    log = {"timestamp": datetime.now(timezone.utc).isoformat(), "params": json.loads(json.dumps(params.__dict__, default=str)), "wmape": float(wmape), "total_predictions": int(predictions), "seconds": seconds or {}}
    _write_json(spark, path, log)
    return log


def read_experiments(spark: SparkSession, paths: list[str]) -> list[dict]:
    """The logs that are there, best first."""
    return sorted(filter(None, (_read_json(spark, p) for p in paths)), key=lambda x: x["wmape"])


def write_summary(summary: DataFrame, path: str) -> dict:
    """One aggregated row as JSON with native types."""
    row = json.loads(summary.select(F.to_json(F.struct("*")).alias("j")).first().j)
    _write_json(summary.sparkSession, path, row)
    return row


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """A leaf-wise model as one JSON file."""
    _write_json(spark, path, model.as_dict())


def read_model(spark: SparkSession, path: str) -> Model | None:
    """The model that write_model has written, or None where there is none."""
    found = _read_json(spark, path)
    return Model.from_dict(found) if found else None
