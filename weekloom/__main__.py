"""python -m weekloom TRANSACTIONS OUTPUT [--model absolute|squared|huber|asymmetric_log_cosh] [--leaf-wise] [--quick] [--basic-features] ..."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from weekloom.operators.boosting import OBJECTIVES
from weekloom.params import Params
from weekloom.plans import pipeline
from weekloom.sources.sinks import StageCache


def main(argv: list[str] | None = None) -> dict | int:
    args = argparse.ArgumentParser(prog="weekloom", description="Weekly demand: panel, features, boosted trees, forecast.")
    args.add_argument("transactions")
    args.add_argument("output")
    args.add_argument("--model", choices=tuple(OBJECTIVES), default="absolute")
    args.add_argument("--leaf-wise", action="store_true", help="trees that grow leaf by leaf; huber and asymmetric_log_cosh need them")
    args.add_argument("--quick", action="store_true", help="few trees")
    args.add_argument("--asymmetric", action="store_true", help="errors at zero demand count 1.5 times")
    args.add_argument("--basic-features", action="store_true")
    args.add_argument("--no-interactions", action="store_true")
    args.add_argument("--no-cache", action="store_true")
    args.add_argument("--clear-cache", action="store_true", help="delete the stage tables and stop")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("weekloom").getOrCreate()
    if a.clear_cache:
        return StageCache(spark, f"{a.output}/cache").clear()
    params = replace(Params(), **({"rounds": 5} if a.quick else {}), **({"zero_weight": 1.5} if a.asymmetric else {}))
    return pipeline.run(spark, a.transactions, a.output, a.model, not a.basic_features, not a.no_interactions, not a.no_cache, params, a.leaf_wise)


if __name__ == "__main__":
    print(main())
