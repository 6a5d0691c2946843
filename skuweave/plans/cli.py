"""Command line: `spark-submit -m`-style entry to the jobs.

    python -m skuweave features  <folder> <out>
    python -m skuweave snapshots <folder> <out> --weeks 48 49 50 51 52
    python -m skuweave continue  <folder of new days> <out>
    python -m skuweave analyse   <folder> [--out <folder>] [--rows 20]
    python -m skuweave yoy-set   <folder> <out>
    python -m skuweave train     <filePath> <modelSavePath> <numRound> [--kind linear]
    python -m skuweave train-sales | train-trailing | train-yoy <filePath> <modelSavePath>
    python -m skuweave forecast  <matrix> <template> <model> <out>
    python -m skuweave forecast-yoy <weeks> <template> <model> <out>

Every job takes --input-gb, the size of what it reads, for the number of shuffle partitions.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from ..functions import ANCHOR
from ..session import build_session
from ..sources import write_table
from . import features, forecasting, training

TRAIN_USAGE = "train takes exactly three arguments: <filePath> <modelSavePath> <numRound>"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skuweave")
    parser.add_argument("--master", help="for local runs; spark-submit sets it otherwise")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *positional: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.add_argument("--input-gb", type=float, help="size of the input, about")
        for arg in positional:
            sub.add_argument(arg)
        return sub

    for name in ("features", "yoy-set", "snapshots", "continue", "analyse"):
        sub = job(name, "folder", *(() if name == "analyse" else ("out",)))
        sub.add_argument("--anchor", type=dt.date.fromisoformat, default=ANCHOR)
        if name == "snapshots":
            sub.add_argument("--weeks", type=int, nargs="+", required=True)
        if name == "yoy-set":
            sub.add_argument("--weeks", type=int, nargs="+", default=[7, 6])
        if name == "analyse":
            sub.add_argument("--template")
            sub.add_argument("--out", help="folder for the full tables")
            sub.add_argument("--rows", type=int, default=20, help="rows shown of each table")

        if name == "continue":
            sub.add_argument("--again", choices=("skip", "error"), default="skip",
                             help="what to do with days that are covered already")

    train = job("train")
    train.add_argument("args", nargs="*")
    train.add_argument("--kind", choices=("gbt", "linear"), default="gbt")
    train.add_argument("--matrix", help="where to store the week matrix")
    train.add_argument("--mask-target", action="store_true")
    train.add_argument("--step", type=float, default=0.01)
    train.add_argument("--depth", type=int, default=7)
    train.add_argument("--min-gain", type=float, default=0.1)
    train.add_argument("--column-share", type=float, default=0.8)
    train.add_argument("--factorised", action="store_true",
                       help="linear fit from one row per SKU, the wide rows are not made")
    train.add_argument("--leaf-reg", type=float, help="L2 term on the leaves of boosted trees")
    train.add_argument("--patience", type=int,
                       help="stop after so many rounds without a better held-out error")

    sales = job("train-sales", "path", "model")
    sales.add_argument("--matrix")
    sales.add_argument("--rounds", type=int, default=20)
    sales.add_argument("--keyed-by", choices=("week", "value"), default="week")
    trailing = job("train-trailing", "path", "model")
    trailing.add_argument("--kind", choices=("gbt", "linear"), default="linear")
    trailing.add_argument("--rounds", type=int, default=10)
    trailing.add_argument("--depth", type=int, default=5)
    yoy = job("train-yoy", "path", "model")
    yoy.add_argument("--rounds", type=int, default=7)

    forecast = job("forecast", "matrix", "template", "model", "out")
    forecast.add_argument("--kind", choices=("gbt", "linear", "boosted"), default="gbt",
                          help="boosted: trained with --leaf-reg or --patience")
    forecast.add_argument("--single-file", action="store_true")
    forecast.add_argument("--sales-only", action="store_true",
                          help="matrix and model of train-sales")
    yearly = job("forecast-yoy", "weeks", "template", "model", "out")
    yearly.add_argument("--single-file", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.job == "train" and len(args.args) != 3:
        print(TRAIN_USAGE, file=sys.stderr)
        return -1
    spark = build_session(f"skuweave {args.job}", args.master,
                          input_bytes=int(args.input_gb * 1e9) if args.input_gb else None)

    if args.job == "features":
        features.create_feature_table(spark, args.folder, args.out, args.anchor)
    elif args.job == "snapshots":
        features.create_week_snapshots(spark, args.folder, args.out, args.weeks, args.anchor)
    elif args.job == "continue":
        print(*features.continue_feature_table(spark, args.folder, args.out, args.anchor,
                                               args.again))
    elif args.job == "yoy-set":
        features.create_year_over_year_set(spark, args.folder, args.out, args.weeks,
                                           anchor=args.anchor)
    elif args.job == "analyse":
        for title, table in features.analyse(spark, args.folder, args.template,
                                             args.anchor).items():
            print(title)
            table.show(args.rows, truncate=False)
            if args.out:
                write_table(table, f"{args.out}/{title.replace(' ', '-')}")
    elif args.job == "train":
        path, model, rounds = args.args
        fit = training.train_all_weeks(spark, path, model, int(rounds),
                                       args.matrix or f"{model}-matrix", args.kind,
                                       args.step, args.depth, args.min_gain, args.column_share,
                                       mask_target=args.mask_target, factorised=args.factorised,
                                       leaf_reg=args.leaf_reg, patience=args.patience)
        print(fit.score)
    elif args.job == "train-sales":
        fit = training.train_sales_weeks(spark, args.path, args.model,
                                         args.matrix or f"{args.model}-matrix", args.rounds,
                                         args.keyed_by)
        print(fit.history, fit.score, sep="\n")
    elif args.job == "train-trailing":
        fit = training.train_trailing_sums(spark, args.path, args.model, kind=args.kind,
                                           rounds=args.rounds, depth=args.depth)
        print(fit.params, fit.score, sep="\n")
    elif args.job == "train-yoy":
        fit = training.train_year_over_year(spark, args.path, args.model, args.rounds)
        print(fit.score, fit.history, sep="\n")
    elif args.job == "forecast":
        extra = {"columns": 1, "degree": 2} if args.sales_only else {}
        forecasting.run_forecast(spark, args.matrix, args.template, args.model, args.out,
                                 args.kind, single_file=args.single_file, **extra)
    elif args.job == "forecast-yoy":
        forecasting.run_year_over_year(spark, args.weeks, args.template, args.model, args.out,
                                       single_file=args.single_file).show()
    return 0
