"""SQL that computes the same rows as the registered queries, for DuckDB.

Queries that train a learner are checked by their properties: the SQL counts
the rows that must be predicted, and states that the model learned.
"""

from __future__ import annotations

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MODELS = ["list", "disc", "tax", "flat", "const", "exact"]
BASES = ["xgb", "rf", "lgb", "et"]
FLOOR = "2.220446049250313e-16"
# floor(0.2 * 2**32)
TEST_BELOW = 858993459


def hash32(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def split(seed: int, key: str) -> str:
    return f"CASE WHEN {hash32(str(seed), key)} < {TEST_BELOW} THEN 'test' ELSE 'train' END"


NET = f"""
keyed AS (
  SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_key,
         l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS target
  FROM lineitem),
net AS (
  SELECT *, {split(16, 'row_key')} AS split,
         CAST({hash32('48', 'row_key')} % 5 AS INTEGER) AS fold
  FROM keyed)"""

LONG = NET + """,
long AS (
  SELECT row_key, split, fold, 'list' AS model, target AS y, l_extendedprice AS p FROM net
  UNION ALL SELECT row_key, split, fold, 'disc', target, l_extendedprice * (1 - l_discount) FROM net
  UNION ALL SELECT row_key, split, fold, 'tax', target, l_extendedprice * (1 + l_tax) FROM net
  UNION ALL SELECT row_key, split, fold, 'flat', target, l_extendedprice * 0.95::DOUBLE * 1.04::DOUBLE FROM net
  UNION ALL SELECT row_key, split, fold, 'const', target, 50000.0::DOUBLE FROM net
  UNION ALL SELECT row_key, split, fold, 'exact', target, target FROM net)"""

GAPPY = """
gappy AS (
  SELECT event_id, event_type,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v
  FROM events)"""

DUPLICATED = """
duplicated AS (
  SELECT event_id % 3 AS ref, event_type,
         CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value / 10) AS DOUBLE) END AS v
  FROM events)"""

PARTS = NET + """,
parts AS (SELECT row_key, split, l_quantity - 1 AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM net)"""

IMPORTANCES = """
imp AS (
  SELECT l_returnflag || l_linestatus AS model, 'f' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS feature,
         round(count(*) / 100.0::DOUBLE, 0) AS importance
  FROM lineitem GROUP BY 1, 2)"""

METRIC = {
    "r2": "round(CASE WHEN count(*) < 2 THEN NULL WHEN min(y) = max(y) THEN CASE WHEN avg((y-p)*(y-p)) = 0"
    " THEN 1.0 ELSE 0.0 END ELSE 1.0 - avg((y-p)*(y-p)) / var_pop(y) END, 6)",
    "mae": "round(avg(abs(y-p)), 4)",
    "mse": "round(avg((y-p)*(y-p)), 2)",
    "medae": "round(quantile_cont(abs(y-p), 0.5), 4)",
    "rmse": "round(sqrt(avg((y-p)*(y-p))), 4)",
    "mape": f"round(avg(abs(y-p) / greatest(abs(y), {FLOOR}::DOUBLE)) * 100.0, 6)",
}


def metrics(names: list[str]) -> str:
    wanted = ", ".join(f"{METRIC[n]} AS {n}" for n in names)
    return f"WITH {LONG} SELECT model, split, count(*) AS n, 0::BIGINT AS n_missing, {wanted} FROM long GROUP BY model, split"


def metrics_with_gaps() -> str:
    wanted = ", ".join(f"{METRIC[n]} AS {n}" for n in METRIC)
    return f"""WITH {LONG}, drawn AS (SELECT *, {hash32('gap', 'row_key')} % 20 AS draw FROM long),
sizes AS (SELECT model, split, count(*) FILTER (draw < 3) AS n_missing FROM drawn GROUP BY model, split),
found AS (SELECT model, split, count(*) AS n, {wanted} FROM drawn WHERE draw >= 3 GROUP BY model, split)
SELECT * FROM found JOIN sizes USING (model, split)"""


def study_net() -> str:
    """Rows of the study: complete, distinct, and inside the fence of the target."""
    return f"""{NET},
clean AS (SELECT * FROM net WHERE {hash32('gap', 'row_key')} % 17 <> 0),
q AS (SELECT quantile_cont(target, 0.25) AS q1, quantile_cont(target, 0.75) AS q3 FROM clean),
inside AS (SELECT clean.* FROM clean, q WHERE target BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


def edges(column: str, bins: int) -> str:
    """Distinct rounded quantile edges per model of the test rows, as a list."""
    at = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""
test AS (SELECT * FROM long WHERE split = 'test'),
edge_lists AS (
  SELECT model, list_sort(list_distinct([round(e, 6) for e in quantile_cont({column}, [{at}])])) AS edges
  FROM test GROUP BY model),
binned AS (
  SELECT t.*, edges, CASE WHEN len(edges) > 1 THEN CAST(len([e for e in edges[2:len(edges) - 1] if {column} > e])
         AS INTEGER) END AS bin
  FROM test t JOIN edge_lists USING (model))"""


def clipped(column: str, source: str, table: str = "fences") -> str:
    value = f"{source}.{column}"
    return (
        f"CASE WHEN {value} IS NOT NULL AND NOT isnan({value}) "
        f"THEN greatest({table}.{column}_lo, least({table}.{column}_hi, {value})) END"
    )


def fences(columns: list[str], source: str, where: str) -> str:
    q = lambda c, p: f"quantile_cont({c}, {p}) FILTER (NOT isnan({c}))"
    cells = ", ".join(
        f"{q(c, 0.25)} - 1.5 * ({q(c, 0.75)} - {q(c, 0.25)}) AS {c}_lo, "
        f"{q(c, 0.75)} + 1.5 * ({q(c, 0.75)} - {q(c, 0.25)}) AS {c}_hi"
        for c in columns
    )
    return f"fences AS (SELECT {cells} FROM {source} WHERE {where})"


def normalised(source: str) -> str:
    whole = "nullif(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 0)"
    cells = ", ".join(f"round({c} / {whole} * 100.0, 6) AS {c}" for c in "abc")
    return f"SELECT row_key, {cells} FROM {source}"


def learned(models: list[str], where: str = "TRUE") -> str:
    names = ", ".join(f"('{m}')" for m in models)
    return f"""WITH {NET} SELECT model, split, count(*) AS n, TRUE AS learned
FROM net, (VALUES {names}) AS m(model) WHERE {where} GROUP BY model, split"""


def profile(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing,
min({c}) + 0.0::DOUBLE AS lowest, max({c}) + 0.0::DOUBLE AS highest FROM lineitem""" for c in columns
    )


def uniform(name: str) -> str:
    return f"({hash32('42:' + name, 'o_orderkey')} / 4294967296.0::DOUBLE)"


def real(name: str, low: float, high: float, log: bool = False) -> str:
    if log:
        low_, high_ = f"ln({float(low)}::DOUBLE)", f"ln({float(high)}::DOUBLE)"
        return f"round(exp({low_} + {uniform(name)} * ({high_} - {low_})), 6) AS {name}"
    return f"round({float(low)}::DOUBLE + {uniform(name)} * ({high}::DOUBLE - {low}::DOUBLE), 6) AS {name}"


def whole(name: str, low: int, high: int, step: int = 1) -> str:
    steps = (high - low) // step + 1
    return f"CAST({low} + floor({uniform(name)} * {steps}) * {step} AS INTEGER) AS {name}"


def choice(name: str, options: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[1 + CAST(floor({uniform(name)} * {len(options)}) AS INTEGER)] AS {name}"


def drawn(cells: list[str]) -> str:
    return f"SELECT o_orderkey AS trial, {', '.join(cells)} FROM orders"


# Rows of the test split in digest order inside their bucket, and the value that each borrows per
# repeat and feature.
# The permutation of all test rows per feature and repeat: positions by digest, and Feistel rounds on two digits of a
# position, repeated while they lead out of the table.
_ROUND = "(({o} + k[{i}]) % 2147483647) * (({o} + k[{j}]) % 2147483647) % 2147483647"
_DIGITS = ", ".join([
    "x // b AS u0, x % b AS v0",
    *(f"({d}{n} + {_ROUND.format(o=o, i=i, j=i + 1)}) % {size} AS {d}{n + 1}" for d, n, o, i, size in (
        ("u", 0, "v0", 1, "a"), ("v", 0, "u1", 3, "b"), ("u", 1, "v1", 5, "a"), ("v", 1, "u2", 7, "b"))),
])
DONORS = NET + f""",
placed AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key)) - 1 AS pos FROM net WHERE split = 'test'),
size AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b
  FROM (SELECT count(*) AS n, least(CAST(ceil(sqrt(count(*))) AS BIGINT), 4096) AS a FROM placed)),
draws AS (
  SELECT feature, CAST(r AS INTEGER) AS repeat, list_transform(range(8), lambda i: ('0x' || substr(
           md5('42:' || feature || ':' || CAST(r AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % 2147483647) AS k
  FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) AS f(feature), range(1, 21) AS repeats(r)),
walk AS (
  WITH RECURSIVE steps AS (
    SELECT feature, repeat, k, pos AS lender, pos AS x, TRUE AS leads_out FROM placed, draws
    UNION ALL
    SELECT feature, repeat, k, lender, x, x >= n
    FROM (SELECT feature, repeat, k, lender, n, u2 * b + v2 AS x
          FROM (SELECT *, {_DIGITS} FROM steps, size WHERE leads_out)))
  SELECT feature, repeat, lender, x AS pos FROM steps WHERE NOT leads_out),
lent AS (
  SELECT feature, repeat, walk.pos, CASE feature WHEN 'l_quantity' THEN l_quantity::DOUBLE WHEN 'l_discount' THEN l_discount
         WHEN 'l_tax' THEN l_tax ELSE l_extendedprice END AS v
  FROM walk JOIN placed ON placed.pos = walk.lender)"""

SWAPPED = DONORS + """,
swapped AS (
  SELECT feature, repeat, target AS y,
         CASE WHEN feature = 'l_extendedprice' THEN v ELSE l_extendedprice END AS e,
         CASE WHEN feature = 'l_discount' THEN v ELSE l_discount END AS d,
         CASE WHEN feature = 'l_tax' THEN v ELSE l_tax END AS t
  FROM placed JOIN lent USING (pos)
  UNION ALL SELECT '', 0, target, l_extendedprice, l_discount, l_tax FROM placed),
predicted AS (
  SELECT 'list' AS model, feature, repeat, y, e AS p FROM swapped
  UNION ALL SELECT 'disc', feature, repeat, y, e * (1 - d) FROM swapped
  UNION ALL SELECT 'tax', feature, repeat, y, e * (1 + t) FROM swapped
  UNION ALL SELECT 'flat', feature, repeat, y, e * 0.95::DOUBLE * 1.04::DOUBLE FROM swapped
  UNION ALL SELECT 'const', feature, repeat, y, 50000.0::DOUBLE FROM swapped
  UNION ALL SELECT 'exact', feature, repeat, y, y FROM swapped),
scores AS (
  SELECT model, feature, repeat, 1.0 - avg((y-p)*(y-p)) / var_pop(y) AS r2
  FROM predicted GROUP BY model, feature, repeat)"""


def leading_features(k: int, value: str = "importance") -> str:
    return f"""WITH {IMPORTANCES},
totals AS (SELECT model, sum(importance) AS total FROM imp GROUP BY model),
means AS (SELECT feature, avg({value}) AS mean_importance FROM imp JOIN totals USING (model) GROUP BY feature),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY mean_importance DESC, feature) AS INTEGER) AS rank FROM means)
SELECT feature, model, importance, round(mean_importance, 6) AS mean_importance, rank
FROM ranked JOIN imp USING (feature) WHERE rank <= {k}"""


def formula_trials() -> str:
    u = lambda name: f"({hash32('42:' + name, 'CAST(trial AS VARCHAR)')} / 4294967296.0::DOUBLE)"
    return f"""WITH {NET},
trials AS (
  SELECT trial, round(0.5::DOUBLE + {u('share')} * 1.0::DOUBLE, 6) AS share,
         CAST(1 + floor({u('steps')} * 3) AS INTEGER) AS steps
  FROM range(8) AS r(trial)),
folds AS (
  SELECT trial, steps, fold, avg(abs(target - l_extendedprice * (1 - share * l_discount / steps))) AS mae
  FROM net CROSS JOIN trials WHERE split = 'train' GROUP BY trial, steps, fold),
scores AS (SELECT trial, steps, round(-avg(mae), 4) AS score FROM folds GROUP BY trial, steps)
SELECT trial, CAST(steps AS VARCHAR) AS steps, score FROM scores ORDER BY score DESC, trial LIMIT 1"""


ORACLES: dict[str, str] = {
    "scan_profile": profile(FEATURES),
    "csv_scan": profile(FEATURES),
    "drop_null_rows": f"WITH {GAPPY} SELECT * FROM gappy WHERE v IS NOT NULL AND NOT isnan(v)",
    "distinct_rows": f"WITH {DUPLICATED} SELECT DISTINCT ref, event_type, v FROM duplicated",
    "clean_table": f"""WITH {DUPLICATED}, kept AS (SELECT DISTINCT ref, event_type, v FROM duplicated WHERE v IS NOT NULL)
SELECT event_type, v FROM kept""",
    "iqr_filter": """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "iqr_filter_train_fit": f"""WITH q AS (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events WHERE {split(16, 'event_id')} = 'train')
SELECT event_id, value FROM events, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "feature_target": f"""WITH {NET}
SELECT row_key, l_quantity, l_extendedprice, l_discount, l_tax, round(target, 6) AS target FROM net""",
    "winsorize": f"""WITH {GAPPY}, {fences(['v'], 'gappy', split(16, 'event_id') + " = 'train'")}
SELECT event_id, round({clipped('v', 'gappy')}, 6) AS v FROM gappy, fences""",
    "winsorize_numeric": f"""WITH {GAPPY}, {fences(['v'], 'gappy', 'TRUE')}
SELECT event_type, round({clipped('v', 'gappy')}, 6) AS v FROM gappy, fences""",
    "winsorize_composition": f"""WITH {PARTS}, {fences(['a', 'b', 'c'], 'parts', "split = 'train'")},
clipped AS (SELECT row_key, {', '.join(f"{clipped(c, 'parts')} AS {c}" for c in 'abc')} FROM parts, fences)
{normalised('clipped')}""",
    "normalize_composition": f"WITH {PARTS} {normalised('parts')}",
    "coerce_numeric": """SELECT event_id, try_cast(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS k,
try_cast(event_type AS DOUBLE) AS word FROM events""",
    "train_test_split": f"SELECT o_orderkey, {split(16, 'o_orderkey')} AS split FROM orders",
    "exact_split": """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('16:' || o_orderkey))
  <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders""",
    "kfold_assign": f"WITH {NET} SELECT row_key, fold FROM net WHERE split = 'train'",
    "exact_kfold": """WITH placed AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('48:' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST((SELECT count(*) FROM range(4) AS r(i)
  WHERE rn > (i + 1) * (n // 5) + least(i + 1, n % 5)) AS INTEGER) AS fold FROM placed""",
    "blend_holdout": f"""WITH {NET} SELECT row_key, {hash32('42', 'row_key')} < {TEST_BELOW} AS held_out
FROM net WHERE split = 'train'""",
    "quantiles": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS value
FROM lineitem GROUP BY l_returnflag""" for c in FEATURES for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    ),
    "robust_scale_fit": f"WITH {NET}, levelled AS (SELECT *, 7.0::DOUBLE AS level FROM net WHERE split = 'train') "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.5), 6) AS centre,
round(CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0
ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END, 6) AS scale FROM levelled"""
        for c in [*FEATURES, "level"]
    ),
    "robust_scale": f"""WITH {NET}, q AS (SELECT {', '.join(
        f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s"
        for c in FEATURES)} FROM net WHERE split = 'train')
SELECT row_key, {', '.join(f"round((net.{c} - {c}_m) / {c}_s, 6) AS scaled_{c}" for c in FEATURES)},
0.0::DOUBLE AS scaled_level FROM net, q""",
    **{f"metric_{m}": metrics([m]) for m in METRIC},
    "model_report": metrics(list(METRIC)),
    "report_with_gaps": metrics_with_gaps(),
    "report_sink": metrics(list(METRIC)),
    "cv_neg_mae": f"""WITH {LONG}, folds AS (
  SELECT model, fold, avg(abs(y - p)) AS mae FROM long WHERE split = 'train' GROUP BY model, fold)
SELECT model, round(-avg(mae), 4) + 0.0::DOUBLE AS score, count(*) AS folds FROM folds GROUP BY model""",
    "parity_table": f"""WITH {LONG}, r AS (
  SELECT model, {METRIC['r2']} AS r2 FROM long WHERE split = 'test' GROUP BY model)
SELECT row_key, model, round(y, 6) AS y_true, round(p, 6) AS y_pred, r2
FROM long JOIN r USING (model) WHERE split = 'test'""",
    "parity_limits": f"""WITH {LONG}, limits AS (
  SELECT model, least(min(y), min(p)) * 0.97 AS lower, greatest(max(y), max(p)) * 1.03 AS upper
  FROM long WHERE split = 'test' GROUP BY model)
SELECT model, round(lower, 6) AS lower, round(upper, 6) AS upper FROM limits
UNION ALL SELECT '(all)', round(min(lower), 6), round(max(upper), 6) FROM limits""",
    "calibration_limits": f"""WITH {LONG}, {edges('p', 10)},
means AS (SELECT model, bin, avg(p) AS p, avg(y) AS y FROM binned WHERE bin IS NOT NULL GROUP BY model, bin),
limits AS (
  SELECT model, least(min(y), min(p)) * 0.97 AS lower, greatest(max(y), max(p)) * 1.03 AS upper
  FROM means GROUP BY model)
SELECT model, round(lower, 4) AS lower, round(upper, 4) AS upper FROM limits
UNION ALL SELECT '(all)', round(min(lower), 4), round(max(upper), 4) FROM limits""",
    "quantile_bins": f"WITH {LONG}, {edges('p', 10)} SELECT row_key, model, bin FROM binned",
    "quantile_bins_unrounded": f"""WITH items AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem),
cuts AS (SELECT l_returnflag, list_sort(list_distinct(quantile_cont(quantity, [{', '.join(str(i / 10) for i in range(11))}]))) AS edges
  FROM items GROUP BY l_returnflag)
SELECT l_returnflag, quantity, bin, count(*) AS n FROM (
  SELECT i.*, CASE WHEN len(edges) > 1 THEN CAST(len([e for e in edges[2:len(edges) - 1] if quantity > e]) AS INTEGER) END AS bin
  FROM items i JOIN cuts USING (l_returnflag)) GROUP BY l_returnflag, quantity, bin""",
    "calibration_deciles": f"""WITH {LONG}, {edges('p', 10)}
SELECT model, bin, round(avg(p), 4) AS mean_pred, round(avg(y), 4) AS mean_true
FROM binned WHERE bin IS NOT NULL GROUP BY model, bin""",
    "mape_ranking": f"""WITH {LONG}, r AS (SELECT model, {METRIC['mape']} AS mape FROM long WHERE split = 'test' GROUP BY model)
SELECT model, mape, CAST(row_number() OVER (ORDER BY mape, model) AS INTEGER) AS rank FROM r""",
    # Labels round ties to even, as pandas does: an edge at 860.8045 reads 860.804.
    "mape_by_bin": f"""WITH {LONG}, {edges('y', 5)}, cells AS (
  SELECT model, bin, {METRIC['mape']} AS mape, any_value(edges) AS edges FROM binned WHERE bin IS NOT NULL GROUP BY model, bin)
SELECT model, bin, mape,
  '(' || CAST(CASE WHEN bin = 0 THEN round_even(edges[1], 3) - 0.001::DOUBLE ELSE round_even(edges[bin + 1], 3) END AS VARCHAR)
  || ', ' || CAST(round_even(edges[bin + 2], 3) AS VARCHAR) || ']' AS label
FROM cells""",
    "mean_importance": f"""WITH {IMPORTANCES}, totals AS (SELECT model, sum(importance) AS total FROM imp GROUP BY model)
SELECT feature, round(avg(importance / total), 6) AS importance FROM imp JOIN totals USING (model) GROUP BY feature""",
    "topk_per_model": f"""WITH {IMPORTANCES}, ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp)
SELECT model, feature, importance, rank FROM ranked WHERE rank <= 15""",
    "topk_global": leading_features(12),
    "topk_global_permutation": leading_features(10),
    "topk_global_normalised": leading_features(12, "importance / total"),
    "permutation_shuffle": f"""WITH {DONORS.replace("('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')", "('l_quantity'), ('l_extendedprice')")}
SELECT row_key, repeat, max(v) FILTER (feature = 'l_extendedprice') AS lent_price,
       max(v) FILTER (feature = 'l_quantity') AS lent_quantity
FROM placed JOIN lent USING (pos) GROUP BY row_key, repeat""",
    "permutation_importance": f"""WITH {SWAPPED}
SELECT s.model, s.feature, round(any_value(b.r2) - avg(s.r2), 6) + 0.0::DOUBLE AS importance
FROM scores s JOIN scores b ON b.model = s.model AND b.feature = '' WHERE s.feature <> '' GROUP BY s.model, s.feature""",
    "meta_features": f"WITH {LONG} SELECT row_key, "
    + ", ".join(f"round(max(p) FILTER (model = '{m}'), 6) AS \"{m}\"" for m in MODELS)
    + " FROM long WHERE split = 'test' GROUP BY row_key",
    "search_candidates": drawn([
        real("eta", 0.01, 0.3), whole("max_depth", 3, 8), real("subsample", 0.7, 1.0),
        real("colsample_bytree", 0.7, 1.0), real("reg_lambda", 0.01, 10, log=True),
        real("reg_alpha", 0.001, 1, log=True), whole("n_estimators", 200, 800, 100),
    ]),
    "search_candidates_rf": drawn([
        whole("n_estimators", 200, 800, 100), whole("max_depth", 5, 25), whole("min_samples_split", 2, 10),
        whole("min_samples_leaf", 1, 5), choice("max_features", ["sqrt", "log2", "0.8"]),
    ]),
    "search_candidates_lgb": drawn([
        whole("num_leaves", 20, 100), real("learning_rate", 0.01, 0.3), real("feature_fraction", 0.7, 1.0),
        real("bagging_fraction", 0.7, 1.0), whole("bagging_freq", 1, 7), whole("min_child_samples", 5, 50),
        real("reg_alpha", 0.001, 1, log=True), real("reg_lambda", 0.001, 1, log=True),
        whole("n_estimators", 200, 800, 100),
    ]),
    "best_candidate": formula_trials(),
    "best_candidate_ties": """SELECT o_orderkey AS trial, o_orderstatus AS status,
-CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS score FROM orders ORDER BY score DESC, trial LIMIT 1""",
    # Property checks.
    "learner_gbt": learned(["xgb"]),
    "learner_gbt_bagged": learned(["lgb"]),
    "learner_rf": learned(["rf"]),
    "learner_extra_trees": learned(["et"]),
    "learner_huber": learned(["huber"]),
    "base_predictions": learned(BASES),
    "oof_predictions": f"""WITH {NET} SELECT model, fold, count(*) AS n, TRUE AS learned, count(DISTINCT row_key) AS n_keys
FROM net, (VALUES {', '.join(f"('{m}')" for m in BASES)}) AS m(model) WHERE split = 'train' GROUP BY model, fold""",
    "stacking": learned(["stack"]),
    "stacking_without_features": learned(["stack"]),
    "blending": learned(["blend"]),
    "loaded_scoring": learned([*BASES, "stack", "blend"], "split = 'test'"),
    "model_roundtrip": f"""SELECT model, count(*) AS n, TRUE AS same
FROM lineitem, (VALUES {', '.join(f"('{m}')" for m in BASES)}) AS m(model) GROUP BY model""",
    "impurity_importance": f"""SELECT model, count(DISTINCT i) AS n_features, 1.0::DOUBLE AS total, 'l_extendedprice' AS leading
FROM (VALUES {', '.join(f"('{m}')" for m in BASES)}) AS m(model), range(4) AS r(i) GROUP BY model""",
    "split_importance": f"""WITH {NET}, train AS (SELECT * FROM net WHERE split = 'train'),
grouped AS (SELECT l_tax, count(*) AS n, avg(target) AS mean FROM train GROUP BY l_tax),
whole AS (SELECT avg(target) AS mean, var_pop(target) * count(*) AS total FROM train),
tax AS (SELECT count(*) - 1 AS splits, round(sum(n * pow(g.mean - w.mean, 2)) / max(total), 8) AS explained FROM grouped g, whole w)
SELECT model, feature, CASE WHEN feature = 'l_tax' THEN splits ELSE 0 END AS splits,
CASE WHEN feature = 'l_tax' THEN explained ELSE 0.0::DOUBLE END AS explained
FROM tax, (VALUES ('xgb'), ('et')) AS m(model), (VALUES ('l_tax'), ('one')) AS f(feature)""",
    "permutation_importance_learners": f"""SELECT model, count(DISTINCT i) AS n_features, 'l_extendedprice' AS leading
FROM (VALUES {', '.join(f"('{m}')" for m in BASES)}) AS m(model), range(4) AS r(i) GROUP BY model""",
    "cv_search": f"""WITH {NET}, train AS (SELECT * FROM net WHERE split = 'train'),
means AS (SELECT f.fold, avg(target) AS mean FROM (SELECT DISTINCT fold FROM train) f JOIN train t ON t.fold <> f.fold GROUP BY f.fold),
maes AS (SELECT fold, avg(abs(target - mean)) AS mae FROM train JOIN means USING (fold) GROUP BY fold)
SELECT trial, round(-avg(mae), 4) AS score, '0' AS max_depth, 'reg_lambda,reg_alpha' AS unused
FROM maes, range(3) AS t(trial) GROUP BY trial""",
    **{name: f"""WITH {NET} SELECT l_tax, count(*) AS n,
round(avg(0.75::DOUBLE * l_extendedprice * (1 - l_discount) + 0.25::DOUBLE * l_quantity * 100 * (1 + l_tax) + 100), 4) AS mean,
100.0::DOUBLE AS intercept, 0.75::DOUBLE AS disc, 0.25::DOUBLE AS taxed
FROM net WHERE split = 'test' GROUP BY l_tax""" for name in ("stack_weights", "blend_weights")},
    "learner_huber_exact": f"""WITH {NET} SELECT l_tax, count(*) AS n,
round(avg(3 * l_quantity + 0.5::DOUBLE * l_extendedprice - 7), 4) AS mean FROM net WHERE split = 'test' GROUP BY l_tax""",
    "cv_search_trees": f"""WITH {NET}, train AS (SELECT * FROM net WHERE split = 'train'),
drawn AS (SELECT t AS trial, CAST(floor({hash32('42:max_depth', 'CAST(t AS VARCHAR)')} / 4294967296.0::DOUBLE * 2) AS INTEGER) * 15 AS depth
          FROM range(20) AS r(t)),
folds AS (SELECT DISTINCT fold FROM train),
flat AS (SELECT f.fold, avg(target) AS mean FROM folds f JOIN train t ON t.fold <> f.fold GROUP BY f.fold),
deep AS (SELECT f.fold, l_tax, avg(target) AS mean FROM folds f JOIN train t ON t.fold <> f.fold GROUP BY f.fold, l_tax),
maes AS (SELECT 0 AS depth, fold, avg(abs(target - mean)) AS mae FROM train JOIN flat USING (fold) GROUP BY fold
         UNION ALL SELECT 15, fold, avg(abs(target - mean)) FROM train JOIN deep USING (fold, l_tax) GROUP BY fold)
SELECT trial, round(-avg(mae), 4) AS score, CAST(depth AS VARCHAR) AS max_depth
FROM drawn JOIN maes USING (depth) GROUP BY trial, depth""",
    "best_candidate_unscored": """SELECT o_orderkey AS trial, o_orderstatus AS status, round(-o_totalprice, 2) AS score
FROM orders WHERE o_orderkey % 3 = 2 ORDER BY o_totalprice, o_orderkey LIMIT 1""",
    "oof_fold_means": f"""WITH {NET}, train AS (SELECT * FROM net WHERE split = 'train'),
means AS (SELECT f.fold, avg(target) AS mean FROM (SELECT DISTINCT fold FROM train) f JOIN train t ON t.fold <> f.fold GROUP BY f.fold)
SELECT fold, count(*) AS n, round(any_value(mean), 4) AS lowest, round(any_value(mean), 4) AS highest
FROM train JOIN means USING (fold) GROUP BY fold""",
    **{f"learner_{m}_exact": f"""WITH {NET},
means AS (SELECT l_tax, avg(target) AS mean FROM net WHERE split = 'train' GROUP BY l_tax)
SELECT l_tax, count(*) AS n, round(any_value(mean), 4) AS lowest, round(any_value(mean), 4) AS highest
FROM net JOIN means USING (l_tax) WHERE split = 'test' GROUP BY l_tax""" for m in ("gbt", "extra_trees")},
    "study_report": f"""WITH {study_net()}
SELECT model, split, count(*) AS n, 0::BIGINT AS n_missing, TRUE AS learned
FROM inside, (VALUES {', '.join(f"('{m}')" for m in [*BASES, 'stack', 'blend'])}) AS m(model) GROUP BY model, split""",
    "study_tables": f"""WITH {study_net()}, t AS (SELECT count(*) AS n FROM inside WHERE split = 'test')
SELECT name, CASE WHEN name = 'parity' THEN 6 * t.n ELSE rows END AS n FROM t,
(VALUES ('report', 12), ('parity', 0), ('parity_limits', 7), ('calibration', 60), ('calibration_limits', 7),
        ('gain_importance', 16), ('gain_top_per_model', 16), ('gain_top', 16), ('permutation_importance', 24),
        ('permutation_top_per_model', 24), ('permutation_top', 24), ('mape_ranking', 6), ('mape_by_range', 30))
  AS v(name, rows)""",
    "rescore_report": f"""WITH {study_net()}
SELECT model, split, count(*) AS n, TRUE AS same
FROM inside, (VALUES {', '.join(f"('{m}')" for m in [*BASES, 'stack', 'blend'])}) AS m(model)
WHERE split = 'test' GROUP BY model, split""",
    "ensemble_score": f"WITH {NET} SELECT count(*) AS n, TRUE AS same FROM net WHERE split = 'test'",
}
