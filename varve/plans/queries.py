"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.hashing import hash32
from varve.operators import cleaning, diagnostics, evaluation, importance, permute, search, splitting
from varve.operators.ensemble import FoldStack, HoldoutBlend, column_stack, out_of_fold
from varve.operators.learners import (
    EXTRA_DEPTH, EXTRA_TREES, HuberLearner, add_predictions, base_learners, fit_all, scaled,
)
from varve.operators.quantiles import exact_quantiles
from varve.operators.scaling import ExactRobustScaler
from varve.plans import fixtures
from varve.plans.fixtures import FEATURES, KEY, TARGET
from varve.plans.study import Study, rescore, run_study, score
from varve.session import new_path
from varve.sources.model_store import load_models, save_models
from varve.sources.tables import numeric_schema, profile, read_table, write_tables

Query = Callable[[SparkSession, str], DataFrame]

# Edges and aggregates are rounded, so that the last bits of a sum that was
# added up in another order decide neither a bin nor a comparison.
EDGE_DECIMALS = 6
LEARNERS = {
    "xgb": {"n_estimators": 20, "max_depth": 5}, "rf": {"n_estimators": 20, "max_depth": 10},
    "lgb": {"n_estimators": 20, "num_leaves": 32, "min_child_samples": 20}, "et": {"n_estimators": 20, "max_depth": 10},
}
# Randomised trees alone are grown at their published size, 100 trees of depth 15.
ALONE = LEARNERS | {"et": {"n_estimators": EXTRA_TREES, "max_depth": EXTRA_DEPTH}}
# Small ones for flows with many fits: these queries check the flow, not how well a learner can do.
SMALL = {
    "xgb": {"n_estimators": 3, "max_depth": 4, "subsample": 0.9},
    "rf": {"n_estimators": 5, "max_depth": 6},
    "lgb": {"n_estimators": 3, "num_leaves": 16, "learning_rate": 0.3, "min_child_samples": 20},
    "et": {"n_estimators": 5, "max_depth": 6},
}
# A prediction that explains this share of the variance counts as learned. The list price, which needs
# no fit, explains 0.9933; LEARNERS must do better. Small ones cannot, and are checked by value elsewhere.
LEARNED, LEARNED_WELL = 0.9, 0.995


def rounded(df: DataFrame, **decimals: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in decimals.items()})


# --- scans and cleaning ---------------------------------------------------


def scan_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(fixtures.table(spark, sf, "lineitem"), FEATURES)


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same profile from a CSV copy of the table, read with a declared schema."""
    folder = new_path(spark, "csv")
    fixtures.table(spark, sf, "lineitem").select(*FEATURES).write.csv(folder, header=True)
    return profile(read_table(spark, folder, numeric_schema(FEATURES), kind="csv"), FEATURES)


def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.drop_null_rows(fixtures.gappy(spark, sf))


def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.distinct_rows(fixtures.duplicated(spark, sf))


def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_table(fixtures.duplicated(spark, sf))


def iqr_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.within_fence(fixtures.table(spark, sf, "events").select("event_id", "value"), "value")


def iqr_filter_train_fit(spark: SparkSession, sf: str) -> DataFrame:
    events = fixtures.table(spark, sf, "events").select("event_id", "value")
    return cleaning.within_fence(
        events, "value", fit_on=splitting.split_label(F.col("event_id")) == "train"
    )


def feature_target(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.net_price(spark, sf)
    features = cleaning.feature_columns(rows, TARGET, keys=[KEY])
    return rounded(rows.select(KEY, *features, TARGET), target=6)


def winsorize(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.gappy(spark, sf).select("event_id", "v")
    train = rows.where(splitting.split_label(F.col("event_id")) == "train")
    clipper = cleaning.FenceClipper(inputCols=["v"], normalise=False)
    return rounded(clipper.fit(train).transform(rows), v=6)


def winsorize_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Without named columns every numeric one is clipped, and text is left alone."""
    rows = fixtures.gappy(spark, sf).drop("event_id")
    return rounded(cleaning.FenceClipper().fit(rows).transform(rows), v=6)


def winsorize_composition(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.composition(spark, sf)
    train = rows.where(splitting.split_label(F.col(KEY)) == "train")
    clipper = cleaning.FenceClipper(inputCols=["a", "b", "c"])
    return rounded(clipper.fit(train).transform(rows), a=6, b=6, c=6)


def normalize_composition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cleaning.normalise_composition(fixtures.composition(spark, sf), ["a", "b", "c"]), a=6, b=6, c=6)


def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("word")
    )
    return cleaning.coerce_numeric(rows, ["k", "word"])


# --- splits ---------------------------------------------------------------


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "orders").select("o_orderkey")


def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).withColumn("split", splitting.split_label(F.col("o_orderkey")))


def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.exact_split(_orders(spark, sf), "o_orderkey")


def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.labelled_net_price(spark, sf).where("split = 'train'").select(KEY, "fold")


def exact_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.exact_folds(_orders(spark, sf), "o_orderkey")


def blend_holdout(spark: SparkSession, sf: str) -> DataFrame:
    train = fixtures.labelled_net_price(spark, sf).where("split = 'train'")
    return train.select(KEY, splitting.is_holdout(F.col(KEY)).alias("held_out"))


# --- quantiles and scaling --------------------------------------------------


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "lineitem")
    found = exact_quantiles(rows, FEATURES, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], by=["l_returnflag"])
    return rounded(found, value=6)


def _with_constant(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.labelled_net_price(spark, sf).withColumn("level", F.lit(7.0))


def _fitted_scaler(rows: DataFrame) -> Model:
    columns = [*FEATURES, "level"]
    scaler = ExactRobustScaler(inputCols=columns, outputCols=[f"scaled_{c}" for c in columns])
    return scaler.fit(rows.where("split = 'train'"))


def robust_scale_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = _fitted_scaler(_with_constant(spark, sf))
    rows = list(zip(model.getInputCols(), model.getOrDefault("centres"), model.getOrDefault("scales")))
    return rounded(spark.createDataFrame(rows, "column string, centre double, scale double"), centre=6, scale=6)


def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_constant(spark, sf)
    scaled_rows = _fitted_scaler(rows).transform(rows)
    names = [f"scaled_{c}" for c in [*FEATURES, "level"]]
    return rounded(scaled_rows.select(KEY, *names), **{n: 6 for n in names})


# --- evaluation -------------------------------------------------------------

# Decimals that survive a change in the order of a sum.
METRIC_DECIMALS = {"r2": 6, "mae": 4, "mse": 2, "medae": 4, "rmse": 4, "mape": 6}


def _metric(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = evaluation.report(fixtures.closed_form_predictions(spark, sf), metrics=[name])
        return rounded(found, **{name: METRIC_DECIMALS[name]})

    return query


def report_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.report(fixtures.gappy_predictions(spark, sf)), **METRIC_DECIMALS)


def model_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.report(fixtures.closed_form_predictions(spark, sf)), **METRIC_DECIMALS)


def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The report written as a table and read back."""
    folder = new_path(spark, "tables")
    write_tables({"report": model_report(spark, sf)}, folder)
    return read_table(spark, f"{folder}/report")


def cv_neg_mae(spark: SparkSession, sf: str) -> DataFrame:
    train = fixtures.closed_form_predictions(spark, sf).where("split = 'train'")
    return rounded(evaluation.cross_validated_score(train), score=4)


# --- diagnostics -------------------------------------------------------------


def _test_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.closed_form_predictions(spark, sf).where("split = 'test'")


def parity_table(spark: SparkSession, sf: str) -> DataFrame:
    found = diagnostics.parity_table(_test_predictions(spark, sf))
    return rounded(found.select(KEY, "model", "y_true", "y_pred", "r2"), y_true=6, y_pred=6, r2=6)


def parity_limits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.axis_limits(_test_predictions(spark, sf)), lower=6, upper=6)


def calibration_limits(spark: SparkSession, sf: str) -> DataFrame:
    table = diagnostics.calibration(_test_predictions(spark, sf), decimals=EDGE_DECIMALS)
    return rounded(diagnostics.calibration_limits(table), lower=4, upper=4)


def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    binned = diagnostics.with_quantile_bins(
        _test_predictions(spark, sf), "y_pred", diagnostics.DECILES, ["model"], EDGE_DECIMALS
    )
    return binned.select(KEY, "model", "bin")


def quantile_bins_unrounded(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as the study uses them, on quantities with many ties."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("quantity")
    )
    binned = diagnostics.with_quantile_bins(rows, "quantity", diagnostics.DECILES, ["l_returnflag"])
    return binned.groupBy("l_returnflag", "quantity", "bin").agg(F.count(F.lit(1)).alias("n"))


def calibration_deciles(spark: SparkSession, sf: str) -> DataFrame:
    found = diagnostics.calibration(_test_predictions(spark, sf), decimals=EDGE_DECIMALS)
    return rounded(found, mean_pred=4, mean_true=4)


def mape_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.rank_by_error(_test_predictions(spark, sf)), mape=6)


def mape_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    found = diagnostics.error_by_range(_test_predictions(spark, sf), decimals=EDGE_DECIMALS)
    return rounded(found, mape=6)


# --- importance ---------------------------------------------------------------


def mean_importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(importance.mean_importance(fixtures.derived_importances(spark, sf)), importance=6)


def topk_per_model(spark: SparkSession, sf: str) -> DataFrame:
    return importance.top_per_model(fixtures.derived_importances(spark, sf))


def topk_global(spark: SparkSession, sf: str) -> DataFrame:
    # Unnormalised means of whole numbers: ties are exact and go by name.
    found = importance.top_overall(
        fixtures.derived_importances(spark, sf), importance.TOP_BY_GAIN, normalise=False
    )
    return rounded(found, mean_importance=6)


def topk_global_permutation(spark: SparkSession, sf: str) -> DataFrame:
    found = importance.top_overall(
        fixtures.derived_importances(spark, sf), importance.TOP_BY_PERMUTATION, normalise=False
    )
    return rounded(found, mean_importance=6)


def topk_global_normalised(spark: SparkSession, sf: str) -> DataFrame:
    found = importance.top_overall(fixtures.derived_importances(spark, sf), importance.TOP_BY_GAIN)
    return rounded(found, mean_importance=6)


def permutation_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Which values two features borrow, each by a permutation of all test rows of its own."""
    test = fixtures.labelled_net_price(spark, sf).where("split = 'test'")
    test = test.select(KEY, F.col(KEY).alias("row"), "l_extendedprice", "l_quantity")
    columns = ["l_extendedprice", "l_quantity"]
    found = permute.rows_with_lent_values(test, KEY, columns, importance.REPEATS, importance.SHUFFLE_SEED)
    # Rows that share a key count as one: the largest value of each repeat. All repeats of a row are shuffled as one row.
    cells = [F.max(F.col("lent")[w][r]).alias(f"_{w}_{r}") for w in range(len(columns)) for r in range(importance.REPEATS)]
    lent = [
        F.struct(F.lit(r + 1).alias("repeat"), F.col(f"_0_{r}").alias("lent_price"), F.col(f"_1_{r}").alias("lent_quantity"))
        for r in range(importance.REPEATS)
    ]
    return found.groupBy(F.col("row").alias(KEY)).agg(*cells).select(KEY, F.inline(F.array(*lent)))


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    forms = fixtures.closed_forms()
    found = importance.permutation_importance(
        fixtures.labelled_net_price(spark, sf).where("split = 'test'"),
        lambda d: d.withColumns(forms), list(forms), FEATURES, TARGET, KEY,
    )
    return found.withColumn("importance", F.round("importance", 6) + 0.0)


# --- learners (property checks) -------------------------------------------------


def _learned(predictions: DataFrame, by=("model", "split"), least: float = LEARNED) -> DataFrame:
    """Rows scored and whether the model explains them."""
    found = evaluation.report(predictions, by=by, metrics=["r2"])
    return found.select(*by, "n", (F.col("r2") > least).alias("learned"))


def _long(df: DataFrame, names: list[str], keep=(KEY, "split")) -> DataFrame:
    return evaluation.long_predictions(df, {n: F.col(n) for n in names}, list(keep), TARGET)


def _learner(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = fixtures.training_table(spark, sf)
        model = base_learners(FEATURES, TARGET, ALONE, [name])[name].fit(rows.where("split = 'train'"))
        return _learned(_long(add_predictions({name: model}, rows), [name]), least=LEARNED_WELL)

    return query


def _learner_exact(name: str, params: dict) -> Query:
    """Trees that are grown until they can split no more, on one feature of few values, predict group means."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = fixtures.training_table(spark, sf).select(KEY, "split", "l_tax", TARGET)
        model = base_learners(["l_tax"], TARGET, {name: params}, [name])[name].fit(rows.where("split = 'train'"))
        scored = add_predictions({name: model}, rows.where("split = 'test'"))
        return rounded(
            scored.groupBy("l_tax").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lowest"), F.max(name).alias("highest")),
            lowest=4, highest=4,
        )

    return query


def oof_fold_means(spark: SparkSession, sf: str) -> DataFrame:
    """A tree without a split predicts the mean of the rows it saw: those outside the fold."""
    train = fixtures.training_table(spark, sf).where("split = 'train'")
    bases = base_learners(FEATURES, TARGET, {"xgb": {"n_estimators": 1, "max_depth": 0}}, ["xgb"])
    rows, _ = out_of_fold(bases, train)
    found = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("xgb").alias("lowest"), F.max("xgb").alias("highest"))
    return rounded(found, lowest=4, highest=4)


def learner_huber(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.training_table(spark, sf)
    huber = scaled(HuberLearner(labelCol=TARGET, predictionCol="huber"), FEATURES)
    return _learned(_long(add_predictions({"huber": huber.fit(rows.where("split = 'train'"))}, rows), ["huber"]))


def _fit_bases(rows: DataFrame) -> dict[str, Model]:
    train = rows.where("split = 'train'")
    return fit_all({n: (e, train) for n, e in base_learners(FEATURES, TARGET, SMALL).items()})


def base_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.training_table(spark, sf)
    models = _fit_bases(rows)
    return _learned(_long(add_predictions(models, rows), list(models)))


def impurity_importance(spark: SparkSession, sf: str) -> DataFrame:
    models = _fit_bases(fixtures.training_table(spark, sf))
    found = importance.impurity_importance(spark, models, FEATURES)
    return found.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.max_by("feature", "importance").alias("leading"),
    )


def split_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Splits and explained variance from the nodes of fully grown trees, per tree; a constant feature has none."""
    train = fixtures.training_table(spark, sf).where("split = 'train'").select(KEY, "l_tax", F.lit(1.0).alias("one"), TARGET)
    params = {"xgb": {"n_estimators": 1, "max_depth": 9}, "et": {"n_estimators": 5, "max_depth": 12}}
    learners = base_learners(["l_tax", "one"], TARGET, params, list(params))
    models = fit_all({n: (e, train) for n, e in learners.items()})
    found = None
    for kind in ("splits", "gain"):
        rows = importance.split_importance(spark, models, ["l_tax", "one"], kind).withColumnRenamed("importance", kind)
        found = rows if found is None else found.join(rows, ["model", "feature"])
    trees = F.when(F.col("model") == "et", 5).otherwise(1)
    total = train.agg((F.var_pop(TARGET) * F.count(TARGET)).alias("total"))
    return found.join(F.broadcast(total)).select(  # one row
        "model", "feature", (F.col("splits") / trees).cast("long").alias("splits"),
        F.round(F.col("gain") / trees / F.col("total"), 8).alias("explained"),
    )


def oof_predictions(spark: SparkSession, sf: str) -> DataFrame:
    train = fixtures.training_table(spark, sf).where("split = 'train'")
    bases = base_learners(FEATURES, TARGET, SMALL)
    rows, _ = out_of_fold(bases, train)
    long = _long(rows, list(bases), keep=(KEY, "fold"))
    counts = long.groupBy("model", "fold").agg(F.countDistinct(KEY).alias("n_keys"))
    return _learned(long, by=("model", "fold")).join(counts, ["model", "fold"])


def meta_features(spark: SparkSession, sf: str) -> DataFrame:
    names = list(fixtures.closed_forms())
    stacked = column_stack(_test_predictions(spark, sf), names, KEY)
    return rounded(stacked, **{n: 6 for n in names})


def stacking(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.training_table(spark, sf)
    model = FoldStack(base_learners(FEATURES, TARGET, LEARNERS), FEATURES, TARGET).fit(rows.where("split = 'train'"))
    return _learned(_long(model.transform(rows), ["stack"]), least=LEARNED_WELL)


def stacking_without_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.training_table(spark, sf)
    bases = base_learners(FEATURES, TARGET, LEARNERS)
    model = FoldStack(bases, FEATURES, TARGET, passthrough=False).fit(rows.where("split = 'train'"))
    return _learned(_long(model.transform(rows), ["stack"]), least=LEARNED_WELL)


def blending(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.training_table(spark, sf)
    model = HoldoutBlend(base_learners(FEATURES, TARGET, LEARNERS), KEY, TARGET).fit(rows.where("split = 'train'"))
    return _learned(_long(model.transform(rows), ["blend"]), least=LEARNED_WELL)


def _six_models(rows: DataFrame) -> dict[str, Model]:
    train = rows.where("split = 'train'")
    bases = base_learners(FEATURES, TARGET, SMALL)
    fitted = _fit_bases(rows)
    return {
        **fitted,
        "stack": FoldStack(bases, FEATURES, TARGET, fitted=fitted).fit(train),
        "blend": HoldoutBlend(bases, KEY, TARGET, fitted=fitted).fit(train),
    }


def loaded_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Six models saved, loaded, and scored on the test rows."""
    rows = fixtures.training_table(spark, sf)
    folder = new_path(spark, "models")
    save_models(spark, _six_models(rows), folder)
    loaded = load_models(spark, folder)
    return _learned(_long(score(loaded, rows.where("split = 'test'")), list(loaded)))


def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A loaded model predicts what the saved one did."""
    rows = fixtures.training_table(spark, sf)
    models = _fit_bases(rows)
    folder = new_path(spark, "models")
    save_models(spark, models, folder)
    again = load_models(spark, folder)
    both = add_predictions(models, rows).withColumnsRenamed({n: f"saved_{n}" for n in models})
    both = add_predictions(again, both)
    gap = F.array(*[
        F.struct(F.lit(n).alias("model"), F.abs(F.col(n) - F.col(f"saved_{n}")).alias("gap")) for n in models
    ])
    return both.select(F.inline(gap)).groupBy("model").agg(
        F.count("gap").alias("n"), (F.max("gap") == 0).alias("same")
    )


def permutation_importance_learners(spark: SparkSession, sf: str) -> DataFrame:
    """Which feature leads for each base learner; the pairing covers all test rows."""
    rows = fixtures.training_table(spark, sf)
    train = rows.where("split = 'train'")
    models = fit_all({n: (e, train) for n, e in base_learners(FEATURES, TARGET, LEARNERS).items()})
    found = importance.permutation_importance(
        rows.where("split = 'test'"), lambda d: add_predictions(models, d), list(models), FEATURES, TARGET, KEY,
    )
    return found.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_features"), F.max_by("feature", "importance").alias("leading")
    )


# --- search --------------------------------------------------------------------


def _candidates(learner: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        trials = _orders(spark, sf).withColumnRenamed("o_orderkey", "trial")
        found = search.candidates(trials, search.SPACES[learner])
        reals = {n: 6 for n, kind in search.SPACES[learner].items() if isinstance(kind, search.Real)}
        return rounded(found, **reals)

    return query


# A search whose learner has a formula: the price less a drawn share of the discount.
FORMULA_TRIALS = 8
FORMULA_SPACE = {"share": search.Real(0.5, 1.5), "steps": search.Whole(1, 3)}


def _formula_trials(rows: DataFrame) -> DataFrame:
    """Score each trial on each fold in one job, then average over folds."""
    spark = rows.sparkSession
    trials = spark.range(FORMULA_TRIALS).withColumnRenamed("id", "trial")
    drawn = search.candidates(trials, FORMULA_SPACE)
    picked = sorted(drawn.collect(), key=lambda r: r["trial"])
    price, discount = F.col("l_extendedprice"), F.col("l_discount")

    def predicted(r) -> Column:
        return price * (1 - F.lit(round(r["share"], 6)) * discount / r["steps"])

    long = evaluation.long_predictions(
        rows, {str(r["trial"]): predicted(r) for r in picked}, ["fold"], TARGET
    )
    scores = evaluation.cross_validated_score(long)
    params = F.create_map(*[
        x for r in picked
        for x in (F.lit(str(r["trial"])), F.create_map(F.lit("steps"), F.lit(str(r["steps"]))))
    ])
    return scores.select(
        F.col("model").cast("long").alias("trial"), F.element_at(params, F.col("model")).alias("params"),
        F.round("score", 4).alias("score"),
    )


def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    train = fixtures.labelled_net_price(spark, sf).where("split = 'train'")
    best = search.best_candidate(_formula_trials(train))
    return best.select("trial", F.col("params")["steps"].alias("steps"), "score")


def best_candidate_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a trial, scored by its priority: many share the best score."""
    trials = fixtures.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("params"),
        (-F.substring("o_orderpriority", 1, 1).cast("double")).alias("score"),
    )
    best = search.best_candidate(trials)
    return best.select("trial", F.col("params")["status"].alias("status"), "score")


def cv_search(spark: SparkSession, sf: str) -> DataFrame:
    """Trials of trees without a split: each predicts the mean outside its fold, so the score has a formula."""
    rows = fixtures.training_table(spark, sf).where("split = 'train'")
    space = {**search.SPACES["xgb"], "n_estimators": search.Whole(1, 1), "max_depth": search.Whole(0, 0), "subsample": search.Real(1.0, 1.0)}
    trials = search.search("xgb", rows, FEATURES, TARGET, trials=3, space=space)
    return trials.select(
        "trial", F.round("score", 4).alias("score"), F.col("params")["max_depth"].alias("max_depth"),
        F.array_join("unused", ",").alias("unused"),
    )


# Two base models with a formula, and the share of either in the target.
META_FORMS = {"disc": "l_extendedprice * (1 - l_discount)", "taxed": "l_quantity * 100 * (1 + l_tax)"}


def _mixture(spark: SparkSession, sf: str, formula: str) -> DataFrame:
    """Line items whose target is a formula, but far off in a fiftieth of the rows, chosen by key."""
    off = F.when(hash32("off", F.col(KEY)) % 50 == 0, F.lit(1e6)).otherwise(F.lit(0.0))
    return fixtures.training_table(spark, sf).withColumn(TARGET, F.expr(formula) + off)


def _by_tax(rows: DataFrame, prediction: str, **found: float) -> DataFrame:
    """Predictions of test rows by tax, and numbers of the model that made them."""
    return rows.where("split = 'test'").groupBy("l_tax").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(prediction), 4).alias("mean"),
        *[F.round(F.lit(float(v)), 6).alias(n) for n, v in found.items()],
    )


def _meta_weights(ensemble: Callable) -> Query:
    """The meta-learner finds the weights of base models with a formula, whatever a fiftieth of the rows says."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = _mixture(spark, sf, f"0.75 * {META_FORMS['disc']} + 0.25 * {META_FORMS['taxed']} + 100")
        bases = {
            n: Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {f} AS {n} FROM __THIS__")]) for n, f in META_FORMS.items()
        }
        model = ensemble(bases).fit(rows.where("split = 'train'"))
        weights = dict(zip(META_FORMS, model.meta.coefficients))
        return _by_tax(model.transform(rows), model.getPredictionCol(), intercept=model.meta.intercept, **weights)

    return query


stack_weights = _meta_weights(lambda bases: FoldStack(bases, [], TARGET, passthrough=False))
blend_weights = _meta_weights(lambda bases: HoldoutBlend(bases, KEY, TARGET))


def learner_huber_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Robust regression on a target that is linear but for a fiftieth of the rows."""
    rows = _mixture(spark, sf, "3 * l_quantity + 0.5 * l_extendedprice - 7")
    learner = HuberLearner(labelCol=TARGET, predictionCol="huber")
    model = scaled(learner, ["l_quantity", "l_extendedprice"]).fit(rows.where("split = 'train'"))
    return _by_tax(model.transform(rows), "huber")


def cv_search_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty settings of randomised trees on five folds, grown in the same scans.

    On one feature of few values, trees without a split predict the mean outside
    the fold, and deep ones the means of the feature's values there.
    """
    rows = fixtures.training_table(spark, sf).where("split = 'train'")
    space = {**search.TREE_SPACE, "max_depth": search.Whole(0, 15, 15), "n_estimators": search.Whole(1, 4)}
    trials = search.search("et", rows, ["l_tax"], TARGET, trials=20, space=space)
    return trials.select("trial", F.round("score", 4).alias("score"), F.col("params")["max_depth"].alias("max_depth"))


def best_candidate_unscored(spark: SparkSession, sf: str) -> DataFrame:
    """Trials without a score (NULL and NaN) are passed over."""
    trials = fixtures.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("params"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 1, F.lit(float("nan")))
        .otherwise(-F.col("o_totalprice")).alias("score"),
    )
    best = search.best_candidate(trials)
    return best.select("trial", F.col("params")["status"].alias("status"), F.round("score", 2).alias("score"))


# --- the study -----------------------------------------------------------------

STUDY_REPEATS = importance.REPEATS
_STUDIES: dict[tuple[str, str], tuple[str, DataFrame, Study]] = {}


def _study(spark: SparkSession, sf: str) -> tuple[str, DataFrame, Study]:
    """One written study per application and folder, which its queries read back."""
    at = spark.sparkContext.applicationId, sf
    if at not in _STUDIES:
        rows, folder = fixtures.study_rows(spark, sf), new_path(spark, "study")
        _STUDIES[at] = folder, rows, run_study(
            rows, TARGET, reference="ref", params=LEARNERS, key=KEY, repeats=STUDY_REPEATS, out=folder
        )
    return _STUDIES[at]


def study_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole study on a table with gaps, duplicates and a reference column; its report is read back."""
    folder, _, _ = _study(spark, sf)
    found = read_table(spark, f"{folder}/tables/report")
    return found.select("model", "split", "n", "n_missing", (F.col("r2") > LEARNED_WELL).alias("learned"))


def study_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table that the study has written."""
    folder, _, study = _study(spark, sf)
    counts = [
        read_table(spark, f"{folder}/tables/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        for name in sorted(study.tables)
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), counts)


def rescore_report(spark: SparkSession, sf: str) -> DataFrame:
    """Models of a study, loaded, report on the test rows what the study did."""
    folder, rows, _ = _study(spark, sf)
    again = rescore(spark, f"{folder}/models", rows, TARGET, reference="ref", key=KEY, repeats=STUDY_REPEATS)
    before = read_table(spark, f"{folder}/tables/report").where("split = 'test'").select("model", F.col("r2").alias("first"))
    return again.tables["report"].join(before, "model").select(
        "model", "split", "n", (F.abs(F.col("r2") - F.col("first")) < 1e-9).alias("same")
    )


def ensemble_score(spark: SparkSession, sf: str) -> DataFrame:
    """The score of an ensemble is the R² of its predictions."""
    rows = fixtures.training_table(spark, sf)
    test = rows.where("split = 'test'")
    model = HoldoutBlend(base_learners(FEATURES, TARGET, SMALL), KEY, TARGET).fit(rows.where("split = 'train'"))
    score_ = model.evaluate(test)
    y, p = F.col(TARGET), F.col("blend")
    return model.transform(test).agg(
        F.count(F.lit(1)).alias("n"),
        (F.abs(1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y)) - F.lit(score_)) < 1e-9).alias("same"),
    )


# --- the flow in one query -----------------------------------------------------


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, fence, split, train a forest, and report on it beside the formulas."""
    rows = cleaning.distinct_rows(cleaning.drop_null_rows(fixtures.labelled_net_price(spark, sf)))
    rows = cleaning.within_fence(rows, TARGET)
    forest = base_learners(FEATURES, TARGET, LEARNERS, ["rf"])["rf"].fit(rows.where("split = 'train'"))
    scored = add_predictions({"rf": forest}, rows)
    forms = {**fixtures.closed_forms(), "rf": F.col("rf")}
    return evaluation.report(evaluation.long_predictions(scored, forms, [KEY, "split"], TARGET))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        scan_profile, csv_scan, drop_null_rows, distinct_rows, clean_table, iqr_filter, iqr_filter_train_fit, feature_target,
        winsorize, winsorize_numeric, winsorize_composition, normalize_composition, coerce_numeric,
        train_test_split, exact_split, kfold_assign, exact_kfold, blend_holdout,
        quantiles, robust_scale_fit, robust_scale,
        model_report, report_with_gaps, report_sink, cv_neg_mae,
        parity_table, parity_limits, calibration_limits, quantile_bins, quantile_bins_unrounded,
        calibration_deciles, mape_ranking,
        mape_by_bin,
        mean_importance, topk_per_model, topk_global, topk_global_permutation,
        topk_global_normalised, permutation_shuffle,
        permutation_importance,
        learner_huber, base_predictions, impurity_importance, split_importance, oof_predictions, meta_features, stacking,
        stacking_without_features, blending, loaded_scoring, model_roundtrip, permutation_importance_learners,
        best_candidate, best_candidate_ties, best_candidate_unscored, cv_search, cv_search_trees, oof_fold_means,
        study_report, study_tables, rescore_report, ensemble_score,
    ]
} | {
    **{f"metric_{m}": _metric(m) for m in evaluation.METRICS},
    "stack_weights": stack_weights,
    "blend_weights": blend_weights,
    "learner_huber_exact": learner_huber_exact,
    "learner_gbt": _learner("xgb"),
    "learner_gbt_bagged": _learner("lgb"),
    "learner_rf": _learner("rf"),
    "learner_extra_trees": _learner("et"),
    "learner_extra_trees_exact": _learner_exact("et", {"n_estimators": 5, "max_depth": 12}),
    "learner_gbt_exact": _learner_exact("xgb", {"n_estimators": 1, "max_depth": 9}),
    "search_candidates": _candidates("xgb"),
    "search_candidates_rf": _candidates("rf"),
    "search_candidates_lgb": _candidates("lgb"),
}
