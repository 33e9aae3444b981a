"""The whole study: clean, split, tune, fit, combine, report and diagnose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.operators import cleaning, diagnostics, importance, search
from varve.operators.ensemble import ALL, EnsembleModel, FoldStack, HoldoutBlend, fold_fits, holdout_fits, study_scalers
from varve.operators.evaluation import long_predictions, report
from varve.operators.learners import BASE_LEARNERS, PARALLEL_FITS, add_predictions, base_learners, fit_all, in_parallel
from varve.operators.splitting import exact_folds, exact_split, fold_index, split_label
from varve.session import materialise
from varve.sources import versions
from varve.sources.model_store import load_models, save_models
from varve.sources.tables import write_tables

KEY = "_row_key"
ENSEMBLES = ("stack", "blend")


@dataclass
class Study:
    """Fitted models, the prepared rows, and the result tables by name."""

    models: dict[str, Model]
    rows: DataFrame
    features: list[str]
    tables: dict[str, DataFrame]


def check_names(df: DataFrame, target: str, key: str | None) -> None:
    """Columns that the study adds must not be there yet."""
    own = {KEY, "split", "fold", "features", *BASE_LEARNERS, *ENSEMBLES}
    taken = sorted(c for c in df.columns if c in own or c.startswith(("_scaled_", "_m")))
    if taken:
        raise ValueError(f"rename the columns {taken}: the study needs these names")
    for c in (target, key):
        if c is not None and c not in df.columns:
            raise ValueError(f"no column {c!r}")


def prepare(
    df: DataFrame, target: str, reference: str | None = None, fence_on_train: bool = False, exact: bool = False,
    key: str | None = None,
) -> DataFrame:
    """Clean rows inside the target's fence, with key, split and fold.

    ``key`` names a column that identifies rows and is no feature. Without one
    the key is a hash of all values of the row, reference included, taken after
    duplicates are gone: rows that differ only in the reference stay apart.
    ``exact`` makes the test split and the folds of the training rows exact in
    size, at the price of four small jobs and a second write.
    """
    check_names(df, target, key)
    rows = cleaning.distinct_rows(cleaning.drop_null_rows(df))
    values = [named(c) for c in df.columns]
    # The hash takes the bits of a double, not its text.
    rows = rows.withColumn(KEY, named(key).cast("string") if key else F.concat(
        F.lower(F.hex(F.xxhash64(*values))), F.lit(":"), F.lower(F.hex(F.xxhash64(F.lit(1), *values)))
    ))
    if key:
        rows = rows.drop(named(key))
    if reference:
        rows = rows.drop(named(reference))
    by = F.col(KEY)
    # Written once: the quartiles, and every fit after them, read the clean table.
    rows = materialise(rows.withColumns({"split": split_label(by), "fold": fold_index(by)}), partition_by="fold")
    fit_on = F.col("split") == "train" if fence_on_train else None
    rows = cleaning.within_fence(rows, target, fit_on=fit_on)
    if not exact:
        return rows
    rows = exact_split(rows.drop("split", "fold"), KEY)
    return materialise(exact_folds(rows, KEY, among=F.col("split") == "train"), partition_by="fold")


def score(models: dict[str, Model], rows: DataFrame) -> DataFrame:
    """One prediction column per model; shared base models run once per row."""
    given, waiting = rows.columns, {}
    for name, model in models.items():
        if not isinstance(model, EnsembleModel):
            waiting[name] = model
            continue
        rows, waiting = add_predictions(waiting, rows), {}
        if all(models.get(b) is m for b, m in model.bases.items()):
            rows = model.combine(rows)
        else:
            own = rows.drop(*[m for m in models if m not in given])
            extra = [c for c in rows.columns if c not in own.columns]
            if extra:
                raise ValueError("an ensemble with its own base models must come before them")
            rows = model.transform(own)
    return add_predictions(waiting, rows)


def predictions_of(models: dict[str, Model], rows: DataFrame, target: str, key: str = KEY) -> DataFrame:
    return long_predictions(score(models, rows), {m: named(m) for m in models}, [key, "split"], target)


def diagnose(
    models: dict[str, Model], test: DataFrame, features: Sequence[str], target: str, key: str = KEY,
    repeats: int = importance.REPEATS, long: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All result tables on the test rows, the same for new and loaded models.

    ``long`` are the predictions of the test rows, if they are written already.
    """
    spark = test.sparkSession
    long = materialise(predictions_of(models, test, target, key)) if long is None else long
    bases = {n: m for n, m in models.items() if not isinstance(m, EnsembleModel)}
    gains = importance.impurity_importance(spark, bases, features)
    calibrated = materialise(diagnostics.calibration(long))  # bins times models
    drops = materialise(importance.permutation_importance(
        test, lambda d: score(models, d), list(models), features, target, key, repeats=repeats,
    ))
    return {
        "parity": diagnostics.parity_table(long),
        "parity_limits": diagnostics.axis_limits(long),
        "calibration": calibrated,
        "calibration_limits": diagnostics.calibration_limits(calibrated),
        "gain_importance": gains,
        "gain_top_per_model": importance.top_per_model(gains),
        "gain_top": importance.top_overall(gains, importance.TOP_BY_GAIN),
        "permutation_importance": drops,
        "permutation_top_per_model": importance.top_per_model(drops),
        "permutation_top": importance.top_overall(drops, importance.TOP_BY_PERMUTATION, normalise=False),
        "mape_ranking": diagnostics.rank_by_error(long),
        "mape_by_range": diagnostics.error_by_range(long),
    }


def check_folder(spark: SparkSession, out: str, mode: str) -> None:
    """Refuse at the start what the last step would refuse."""
    if mode == "errorifexists" and versions.exists(spark, out):
        raise FileExistsError(f"{out} exists; choose another folder or mode='overwrite'")


def tune(
    rows: DataFrame, features: Sequence[str], target: str, trials: dict[str, int] | None = None,
    learners: Sequence[str] = tuple(search.SPACES), parallelism: int = PARALLEL_FITS,
) -> tuple[dict[str, dict], dict[str, DataFrame]]:
    """Best parameters and the trial table of each tuned learner."""
    best, tables = {}, {}
    for name in learners:
        found = search.search(
            name, rows, features, target, trials=(trials or {}).get(name), parallelism=parallelism
        )
        tables[name] = found
        best[name] = search.read_params(search.best_candidate(found).first()["params"])
    return best, tables


def run_study(
    df: DataFrame, target: str, reference: str | None = None, params: dict[str, dict] | None = None,
    trials: dict[str, int] | None = None, passthrough: bool = True, fence_on_train: bool = False, exact: bool = False,
    repeats: int = importance.REPEATS, out: str | None = None, parallelism: int = PARALLEL_FITS, key: str | None = None,
    mode: str = "errorifexists",
) -> Study:
    """Fit the four base learners and both ensembles, and report on them.

    ``params`` fixes the parameters of some learners; ``trials`` asks to tune
    the learners it names. Each base learner is fitted on the training rows
    once; both ensembles, the report and the importances share it. Rows are
    scored once, for the report and all tables. Models and tables below ``out``
    are published together: with ``mode="overwrite"`` readers see the study
    before until all of this one is written.
    """
    if out:
        check_folder(df.sparkSession, out, mode)
    rows = prepare(df, target, reference, fence_on_train, exact, key)
    features = cleaning.feature_columns(rows, target, keys=[KEY, "split", "fold"])
    train = rows.where("split = 'train'")
    params, trial_tables = dict(params or {}), {}
    if trials:
        best, trial_tables = tune(train, features, target, trials, tuple(trials), parallelism)
        params |= best
    bases = base_learners(features, target, params)
    scalers = study_scalers(bases, train, KEY)
    # One pool for all fits: cores that one learner leaves idle go to another, and both meta-learners are fitted at a time.
    outside, fold_sets = fold_fits(bases, train)
    seen, seen_sets = holdout_fits(bases, train, KEY)
    whole = {("all", n): (e, train) for n, e in bases.items()}
    fits = fit_all({**whole, **outside, **seen}, parallelism, scalers, {id(train): ALL, **fold_sets, **seen_sets})
    fitted = {n: fits[("all", n)] for n in bases}
    shared = {"fitted": fitted, "parallelism": parallelism, "scalers": scalers, "parts": fits}
    ensembles = {
        "stack": FoldStack(bases, features, target, passthrough=passthrough, **shared),
        "blend": HoldoutBlend(bases, KEY, target, **shared),
    }
    models = fitted | dict(zip(ensembles, in_parallel(lambda e: e.fit(train), list(ensembles.values()), parallelism)))
    everything = materialise(predictions_of(models, rows, target))
    tables = {
        "report": report(everything),
        **{f"trials_{n}": t for n, t in trial_tables.items()},
        **diagnose(
            models, rows.where("split = 'test'"), features, target, repeats=repeats,
            long=everything.where("split = 'test'"),
        ),
    }
    if out:
        version = versions.begin(out)
        save_models(df.sparkSession, models, f"{version}/models")
        write_tables(tables, f"{version}/tables")
        versions.publish(df.sparkSession, version)
    return Study(models, rows, features, tables)


def rescore(
    spark: SparkSession, folder: str, df: DataFrame, target: str, reference: str | None = None,
    repeats: int = importance.REPEATS, fence_on_train: bool = False, exact: bool = False, key: str | None = None,
) -> Study:
    """Load stored models and repeat the report and diagnostics on the test rows."""
    models = load_models(spark, folder)  # also <out>/models of a study
    rows = prepare(df, target, reference, fence_on_train, exact, key)
    features = cleaning.feature_columns(rows, target, keys=[KEY, "split", "fold"])
    test = rows.where("split = 'test'")
    long = materialise(predictions_of(models, test, target))
    tables = {
        "report": report(long),
        **diagnose(models, test, features, target, repeats=repeats, long=long),
    }
    return Study(models, rows, features, tables)


TUNED = [n for n in BASE_LEARNERS if n in search.SPACES]
