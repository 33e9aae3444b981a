"""Run a study, or repeat its diagnostics with stored models.

python -m varve study   --input T --target y [--reference c] --out D [--trials n] [--fence-on-train]
python -m varve rescore --input T --target y [--reference c] --models D/models --out E
python -m varve tables  --out D
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from varve.operators.importance import REPEATS
from varve.plans.study import TUNED, rescore, run_study
from varve.sources.tables import numeric_schema, read_table, write_tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="varve", description=__doc__.splitlines()[0])
    parser.add_argument("action", choices=["study", "rescore", "tables"])
    parser.add_argument("--input", help="parquet, ORC or CSV table")
    parser.add_argument("--kind", help="parquet, orc or csv, if the path does not say so")
    parser.add_argument("--numbers", help="numeric columns of a CSV table in order, comma-separated")
    parser.add_argument("--target", help="column to predict")
    parser.add_argument("--reference", help="column dropped after duplicates are gone")
    parser.add_argument("--out", required=True, help="folder for tables and models, shared by all executors")
    parser.add_argument("--models", help="folder of stored models")
    parser.add_argument("--trials", type=int, default=0, help="trials per tuned learner; 0 fits the defaults")
    parser.add_argument("--repeats", type=int, default=REPEATS, help="repeats of the permutation importance")
    parser.add_argument("--no-passthrough", action="store_true", help="stack on the base predictions alone")
    parser.add_argument("--fence-on-train", action="store_true", help="take the outlier fence from training rows")
    parser.add_argument("--exact", action="store_true", help="exact sizes of the test split and the folds")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("varve").getOrCreate()
    if args.action == "tables":
        for name in ("report", "mape_ranking", "calibration", "mape_by_range", "gain_top", "permutation_top"):
            print(name)
            read_table(spark, f"{args.out}/tables/{name}").show(100, truncate=False)
        return
    schema = None
    if args.numbers:
        schema = numeric_schema(args.numbers.split(","), [args.reference] if args.reference else [])
    df = read_table(spark, args.input, schema, args.kind)
    if args.action == "study":
        study = run_study(
            df, args.target, args.reference, trials={n: args.trials for n in TUNED} if args.trials else None,
            passthrough=not args.no_passthrough, fence_on_train=args.fence_on_train, exact=args.exact, repeats=args.repeats,
            out=args.out,
        )
    else:
        study = rescore(
            spark, args.models, df, args.target, args.reference, repeats=args.repeats,
            fence_on_train=args.fence_on_train, exact=args.exact,
        )
        write_tables(study.tables, f"{args.out}/tables")
    study.tables["report"].orderBy("split", "mape").show(100, truncate=False)


if __name__ == "__main__":
    main()
