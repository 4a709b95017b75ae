"""``python -m tramline``: build, train, backtest, evaluate and locate, each a plan and the tables it writes.

The exit status is 0, 1 where a gate stays shut, and 2 where the arguments or the data won't do.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import OPERATORS
from .errors import TramlineError
from .operators import evaluation
from .operators.boosting import GradientBoosting
from .operators.forecast import HierarchicalSeasonal, SeasonalNaive
from .plans import build
from .scratch import written_once
from .session import build_session
from .sources import geometry, ridership

GATED = "gbm"
MODELS = {GATED: GradientBoosting, "hierarchical": HierarchicalSeasonal, evaluation.BASELINE: SeasonalNaive}
RATES = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A CSV folder with a header; in one file where the number of rows has a small bound."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def run_build(spark: SparkSession, args: argparse.Namespace) -> int:
    raw = ridership.read_ridership_csv(spark, args.source) if args.source.endswith(".csv") else spark.read.parquet(args.source)
    panel, registry = build.build_panel(raw, OPERATORS[args.operator].network if args.check_network else None)
    build.write_panel(panel, registry, args.out)
    return 0


def run_train(spark: SparkSession, args: argparse.Namespace) -> int:
    build.train(ridership.load_panel(spark, args.source), MODELS[args.model](), args.out, args.horizon, trained_at=args.trained_at, operator=args.operator)
    return 0


def run_backtest(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scores by fold and by horizon as CSV, a summary on the console, and the gate's verdict."""
    panel = ridership.load_panel(spark, args.source)
    folds = evaluation.fold_frame(panel, args.folds, args.horizon, args.min_train_days)
    names = list(dict.fromkeys([*args.models, evaluation.BASELINE]))
    per_fold, per_horizon, _ = evaluation.backtest(panel, folds, {n: MODELS[n]() for n in names}, args.horizon, "target")
    per_fold, per_horizon = written_once(per_fold, "folds"), written_once(per_horizon, "horizons")
    write_csv(per_fold.orderBy("fold", "model"), f"{args.out}/backtest_folds")
    write_csv(per_horizon.orderBy("fold", "horizon", "model"), f"{args.out}/backtest_horizons")
    evaluation.summarize(per_fold).show(truncate=False)
    evaluation.horizon_report(per_horizon, names).show(args.horizon, truncate=False)
    if args.gate is None:
        return 0
    passed, line = evaluation.check_gate(per_fold, GATED, args.gate)
    print(line)
    return 0 if passed else 1


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Operating curve over all rates, and events and days at the rate in use, as CSV."""
    panel = written_once(ridership.load_panel(spark, args.source), "panel")
    truth = evaluation.ground_truth(panel)
    operating = panel.select("series_id", "line_id", "date", F.col("target").alias("ridership"))
    flags = written_once(evaluation.walk_forward(panel, operating, tuple(args.rates), args.warmup_months, value="ridership"), "flags")
    curve = evaluation.operating_curve(flags, truth, args.min_event_days)
    chosen = build.SERVING_RATE if build.SERVING_RATE in args.rates else args.rates[0]
    at = flags.filter(F.col("rate") == chosen)
    write_csv(curve, f"{args.out}/anomaly_curve")
    write_csv(evaluation.event_onsets(at, truth), f"{args.out}/anomaly_events", one_file=False)
    write_csv(evaluation.score_days(at, truth), f"{args.out}/anomaly_days")
    return 0


def run_locate(spark: SparkSession, args: argparse.Namespace) -> int:
    registry = spark.read.option("header", True).csv(args.registry)
    aliases = geometry.load_aliases(spark, args.aliases, args.alias_source)
    write_csv(geometry.station_coordinates(spark, args.source, registry, aliases), f"{args.out}/station_coordinates")
    return 0


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tramline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, source: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.add_argument("source", help=source)
        sub.add_argument("out", help="folder for what is written")
        sub.add_argument("--operator", default="metro", choices=sorted(OPERATORS))
        sub.set_defaults(run=run)
        return sub

    command("build", run_build, "raw rows, CSV or Parquet").add_argument("--check-network", action="store_true")
    train = command("train", run_train, "the panel")
    train.add_argument("--model", default=GATED, choices=sorted(MODELS))
    train.add_argument("--horizon", type=int, default=14)
    train.add_argument("--trained-at", default="")
    back = command("backtest", run_backtest, "the panel")
    back.add_argument("--folds", type=int, default=12)
    back.add_argument("--horizon", type=int, default=14)
    back.add_argument("--min-train-days", type=int, default=1095)
    back.add_argument("--models", nargs="+", default=sorted(MODELS), choices=sorted(MODELS))
    back.add_argument("--gate", type=float, help="fail unless the boosted model's mean relative error is at most this")
    judge = command("evaluate", run_evaluate, "the panel")
    judge.add_argument("--rates", nargs="+", type=float, default=list(RATES))
    judge.add_argument("--min-event-days", type=int, default=4)
    judge.add_argument("--warmup-months", type=int, default=evaluation.WARMUP_MONTHS)
    locate = command("locate", run_locate, "archives with station placemarks")
    locate.add_argument("--registry", required=True)
    locate.add_argument("--aliases", required=True)
    locate.add_argument("--alias-source", default="geometry")
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        return args.run(spark or build_session(), args)
    except (TramlineError, ValueError) as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
