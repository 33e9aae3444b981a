import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package_when_only_the_driver_has_it(tmp_path):
    """A session that starts elsewhere, with the package on the driver's own path alone, fits and scores."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.ml.linalg import Vectors
        from pyspark.sql import SparkSession
        from varve.operators.extra_trees import ExtraTreesLearner

        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        df = spark.createDataFrame([(Vectors.dense([float(i)]), float(i % 3)) for i in range(30)], ["features", "label"])
        model = ExtraTreesLearner(numTrees=2, maxDepth=12).fit(df)
        print("SCORED", model.transform(df).where("abs(prediction - label) < 1e-9").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SCORED 30" in out.stdout, out.stderr[-2000:]


def test_fits_side_by_side_ship_once(spark, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from varve import session

    added = []
    monkeypatch.setattr(spark.sparkContext, "_varve_shipped", False, raising=False)
    monkeypatch.setattr(spark.sparkContext, "addPyFile", added.append)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: session.ship(spark), range(8)))
    assert len(added) == 1
