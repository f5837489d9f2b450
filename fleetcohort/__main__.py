"""Command line: ``python -m fleetcohort <job> ...`` or through spark-submit.

    quality   RAW                        data-quality table of the raw logs
    features  RAW FEATURES               raw logs to the feature table
    train     FEATURES OUT RUN_ID        segments, churn model, artefacts, run log
    week      OUT WEEK [--drivers N]     one campaign week from the trained models
    log       OUT                        dispatch log, newest first
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fleetcohort.plans.features import driver_features
from fleetcohort.plans.quality import quality_suite
from fleetcohort.plans.training import run_training
from fleetcohort.plans.weekly import run_week
from fleetcohort.settings import COHORT_SIZE, SEARCH_DRAWS, SEARCH_FOLDS
from fleetcohort.sources.artefacts import load_models
from fleetcohort.sources.raw import load_raw_logs, open_required
from fleetcohort.sources.sinks import read_dispatch_log, write_table


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="fleetcohort", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, places in (
        ("quality", ["raw"]),
        ("features", ["raw", "features"]),
        ("train", ["features", "out", "run_id"]),
        ("week", ["out", "week"]),
        ("log", ["out"]),
    ):
        job = jobs.add_parser(name)
        for place in places:
            job.add_argument(place)
        if name in ("quality", "features"):
            job.add_argument("--format", default="csv")
        if name == "train":
            job.add_argument("--draws", type=int, default=SEARCH_DRAWS)
            job.add_argument("--folds", type=int, default=SEARCH_FOLDS)
        if name == "week":
            job.add_argument("--drivers", type=int, default=COHORT_SIZE)
            job.add_argument("--seed", type=int)
    return parser


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.job == "quality":
        quality_suite(load_raw_logs(spark, args.raw, args.format)).show(50, truncate=False)
    elif args.job == "features":
        write_table(driver_features(load_raw_logs(spark, args.raw, args.format)), args.features)
    elif args.job == "train":
        done = run_training(
            spark, args.features, args.out, args.run_id, draws=args.draws, folds=args.folds
        )
        print(done.params, done.metrics)
    elif args.job == "week":
        segments, churn = load_models(spark, f"{args.out}/models")
        history = open_required(spark, f"{args.out}/clustered")
        tables = run_week(
            spark, history, segments, churn, args.out, args.week, args.drivers, args.seed
        )
        for name, table in tables.items():
            print(name)
            table.show(truncate=False)
    else:
        read_dispatch_log(spark, f"{args.out}/dispatch_log").show(truncate=False)


if __name__ == "__main__":
    run(SparkSession.builder.appName("fleetcohort").getOrCreate())
