import numpy as np
import pytest
from pyspark.sql import functions as F

import varve.__main__ as cli
from varve.plans.study import prepare, run_study
from varve.sources.tables import numeric_schema, read_table

PARAMS = {
    "xgb": {"n_estimators": 2, "max_depth": 3}, "rf": {"n_estimators": 2, "max_depth": 4},
    "lgb": {"n_estimators": 2, "num_leaves": 8, "min_child_samples": 2}, "et": {"n_estimators": 2, "max_depth": 4},
}


@pytest.fixture(scope="module")
def sheet(spark, tmp_path_factory):
    """A CSV sheet with a reference column, symbols in names, gaps and duplicates."""
    rng = np.random.default_rng(11)
    path = tmp_path_factory.mktemp("sheet") / "sheet.csv"
    lines = ["ref,N2 (mol%),C7+,pressure"]
    for i in range(300):
        a, b = rng.uniform(0, 10, 2)
        lines.append(f"r{i % 7},{a:.4f},{b:.4f},{2000 + 300 * a + 50 * b:.4f}")
    lines += [lines[1], "r9,,1.0,2000", "r9,1.0,1.0,99999"]
    path.write_text("\n".join(lines) + "\n")
    return read_table(spark, str(path), numeric_schema(["N2 (mol%)", "C7+", "pressure"], ["ref"]))


def test_study_and_rescore(spark, sheet, tmp_path, monkeypatch, capsys):
    """The command line runs a study, repeats it from the stored models, and shows it."""
    studies = []

    def small_study(*args, **kwargs):
        studies.append(run_study(*args, **{**kwargs, "params": PARAMS}))
        return studies[-1]

    monkeypatch.setattr(cli, "run_study", small_study)
    sheet.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    common = ["--input", str(tmp_path / "in"), "--target", "pressure", "--reference", "ref", "--repeats", "2"]
    for argv in (
        ["study", *common, "--out", out],
        ["rescore", *common, "--models", f"{out}/models", "--out", f"{out}2"],
        ["tables", "--out", out],
    ):
        monkeypatch.setattr("sys.argv", ["varve", *argv])
        cli.main()
    assert "permutation_top" in capsys.readouterr().out

    study = studies[0]
    assert study.features == ["N2 (mol%)", "C7+"]
    # 300 rows: the copy, the gap and the outlier are gone.
    assert study.rows.count() == 300
    tables = {n: read_table(spark, f"{out}/tables/{n}") for n in study.tables}
    report = {(r["model"], r["split"]): r for r in tables["report"].collect()}
    assert len(report) == 12 and report[("stack", "test")]["r2"] > 0.9
    assert tables["parity"].count() == 6 * report[("rf", "test")]["n"]
    top = tables["permutation_top"].where("rank = 1").collect()
    assert {r["feature"] for r in top} == {"N2 (mol%)"} and len(top) == 6
    assert tables["mape_ranking"].count() == 6

    for r in read_table(spark, f"{out}2/tables/report").collect():
        assert r["r2"] == pytest.approx(report[(r["model"], "test")]["r2"], rel=1e-12)
    assert read_table(spark, f"{out}2/tables/permutation_top").count() == tables["permutation_top"].count()


def test_names_that_the_study_needs_and_other_wrong_inputs(spark, sheet, tmp_path):
    for name in ("split", "fold", "rf", "stack", "_row_key"):
        with pytest.raises(ValueError, match=name):
            prepare(sheet.withColumnRenamed("C7+", name), "pressure", "ref")
    with pytest.raises(ValueError, match="no column"):
        prepare(sheet, "absent")
    with pytest.raises(ValueError, match="no value"):
        prepare(sheet.limit(0), "pressure", "ref")
    (tmp_path / "out").mkdir()
    with pytest.raises(FileExistsError):
        run_study(sheet, "pressure", "ref", params=PARAMS, out=str(tmp_path / "out"))
    keyed = prepare(sheet.withColumn("id", F.monotonically_increasing_id()), "pressure", "ref", key="id")
    assert "id" not in keyed.columns and keyed.select("_row_key").distinct().count() == keyed.count()


def test_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/nowhere.csv")


def test_exact_sizes(spark, sheet):
    rows = prepare(sheet, "pressure", "ref", exact=True)
    sizes = {(r["split"], r["fold"]): r["count"] for r in rows.groupBy("split", "fold").count().collect()}
    assert sum(n for (s, _), n in sizes.items() if s == "test") == 60
    assert [sizes[("train", k)] for k in range(5)] == [48] * 5
    on_train = prepare(sheet, "pressure", "ref", fence_on_train=True)
    assert on_train.where("pressure > 9000").count() == 0
