"""Command line of the batch jobs, for ``spark-submit`` or ``python -m lanewise.jobs``.

Each command covers all cities, zones and routes in one job unless it is told otherwise.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import congestion, filters
from lanewise.plans import backtest, streets
from lanewise.plans import forecast as fc
from lanewise.session import build_session, stored
from lanewise.sources import artifacts, observations, raw

ROUTE = ("City", "Zone", "RouteId")


def _placed(rows: DataFrame, args) -> DataFrame:
    return rows.withColumns({"City": F.lit(args.city), "Zone": F.lit(args.zone)})


def ingest_interstate(spark: SparkSession, args) -> None:
    read = raw.read_interstate_hourly if args.hourly else raw.read_interstate
    rows = _placed(read(spark, args.csv), args)
    observations.write_observations(rows, args.root, mode="append")


def ingest_bridge(spark: SparkSession, args) -> None:
    observations.write_observations(_placed(raw.read_bridge(spark, args.csv), args), args.root, "append")


def _observations(spark: SparkSession, args) -> DataFrame:
    rows = observations.load_all(spark, args.root, args.layout)
    if args.city:
        rows = filters.in_city_zone(rows, args.city, getattr(args, "zone", None))
    return filters.on_routes(rows, [args.route] if getattr(args, "route", None) else None)


def precompute_daily(spark: SparkSession, args) -> None:
    """Daily actuals next to every model, into the cache that rollups and reports read."""
    daily = fc.daily_actual_vs_models(
        _observations(spark, args), args.models, args.days_back, args.min_history, ROUTE
    )
    family = filters.family_for_training("City", "Zone")
    artifacts.write_daily_cache(daily.withColumn("family", family), args.out, args.overwrite)


def run_backtest(spark: SparkSession, args) -> None:
    """Daily metrics as a table, and the summary with the two best models per route."""
    obs = _observations(spark, args)
    models = [m for m in args.models if not (args.no_arima and m == "ar1")]
    daily = stored(
        backtest.daily_metrics(obs, args.days, models, args.min_history, keys=ROUTE), "scores"
    )
    artifacts.write_table(daily, f"{args.out}/daily_metrics")
    artifacts.write_backtest_summaries(
        backtest.summary(obs, daily, days=args.days, keys=ROUTE), f"{args.out}/summary"
    )


def predict(spark: SparkSession, args) -> None:
    """A forecast for every route of every city and zone on every day, as CSV."""
    rows = fc.batch_forecast(_observations(spark, args), model=args.model, keys=ROUTE)
    artifacts.write_predictions(rows, args.out)


def _slots(spark: SparkSession, args) -> DataFrame:
    los = raw.read_level_of_service(spark, args.csv, slot_time=False)
    return stored(congestion.congested_slots(los), "slots")


def train_streets(spark: SparkSession, args) -> None:
    """Fit the eligible streets; store the coefficients or network, and the registry."""
    slots = _slots(spark, args)
    eligible = congestion.eligible_streets(slots).select(streets.KEY)
    chosen = slots.join(stored(eligible, "eligible"), streets.KEY, "left_semi")
    model, registry = streets.train_streets(chosen, args.model, f"{args.out}/models")
    if args.model == "logit":
        artifacts.write_table(model, f"{args.out}/models/logit")
    else:
        model.write().overwrite().save(f"{args.out}/models/{args.model}")
    artifacts.write_table(registry, f"{args.out}/registry/{args.model}")


def evaluate_streets(spark: SparkSession, args) -> None:
    detail, summary = streets.evaluate_streets(_slots(spark, args), args.models)
    artifacts.write_evaluation(detail, summary, args.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lanewise")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, **flags) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flag, options in flags.items():
            sub.add_argument(f"--{flag.replace('_', '-')}", **options)
        return sub

    text = {"required": True}
    table = {
        "root": text,
        "out": text,
        "city": {},
        "layout": {"choices": ["hive", "plain"], "default": "hive"},
    }
    models = {"nargs": "+", "default": list(fc.MODELS), "choices": fc.MODELS}
    history = {"type": int}
    place = {"csv": text, "root": text, "city": text, "zone": text}
    command("ingest-interstate", ingest_interstate, **place, hourly={"action": "store_true"})
    command("ingest-bridge", ingest_bridge, **place)
    command(
        "precompute-daily", precompute_daily, **table, days_back={"type": int, "default": 30},
        overwrite={"action": "store_true"}, models=models, min_history=history,
    )
    command(
        "backtest", run_backtest, **table, zone={}, route={}, days={"type": int, "default": 365},
        no_arima={"action": "store_true"}, models=models, min_history=history,
    )
    one_model = {"choices": fc.MODELS, "default": "seasonal_naive"}
    command("predict", predict, **table, model=one_model)
    kinds = ["logit", "mlp"]
    command(
        "train-streets", train_streets, csv=text, out=text,
        model={"choices": kinds, "default": "logit"},
    )
    command(
        "evaluate-streets", evaluate_streets, csv=text, out=text,
        models={"nargs": "+", "choices": kinds, "default": kinds},
    )
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(spark or build_session(app="lanewise-job"), args)


if __name__ == "__main__":
    main()
