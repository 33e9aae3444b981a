import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from varve.sources import versions
from varve.sources.model_store import load_models, save_models
from varve.sources.tables import read_table, write_tables


def write(spark, folder, value, tables=("a", "b")):
    version = versions.begin(folder)
    write_tables({n: spark.range(3).select(F.lit(value).alias("v")) for n in tables}, f"{version}/tables")
    return version


def values(spark, folder):
    return [read_table(spark, f"{folder}/tables/{n}").first()["v"] for n in "ab"]


def test_readers_see_the_last_whole_set(spark, tmp_path):
    folder = str(tmp_path / "set")
    versions.publish(spark, write(spark, folder, 1))
    assert values(spark, folder) == [1, 1]
    # A writer that dies between its tables, and one that has all of them but is not done.
    write(spark, folder, 2, tables="a")
    assert values(spark, folder) == [1, 1]
    late = write(spark, folder, 3)
    assert values(spark, folder) == [1, 1]
    versions.publish(spark, late)
    assert values(spark, folder) == [3, 3]
    with pytest.raises(FileNotFoundError):
        versions.publish(spark, versions.begin(folder))
    assert values(spark, folder) == [3, 3]


def test_a_reader_keeps_its_set_until_old_versions_go(spark, tmp_path):
    folder = str(tmp_path / "set")
    versions.publish(spark, write(spark, folder, 1))
    old = read_table(spark, f"{folder}/tables/a")
    versions.publish(spark, write(spark, folder, 2))
    assert old.first()["v"] == 1 and values(spark, folder) == [2, 2]
    unfinished = write(spark, folder, 3)
    assert versions.drop_versions(spark, folder) == 1 and values(spark, folder) == [2, 2]
    assert versions.exists(spark, unfinished) and versions.drop_versions(spark, folder) == 0


def test_plain_paths_stay(spark, tmp_path):
    plain = str(tmp_path / "plain" / "t")
    spark.range(2).write.parquet(plain)
    assert versions.resolve(spark, plain) == plain and versions.resolve(spark, f"{plain}/none") == f"{plain}/none"
    assert versions.resolve(spark, "relative/none") == "relative/none"
    assert read_table(spark, plain).count() == 2


def test_models_are_replaced_together(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("double").alias("x"))

    def fitted(slope):
        line = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")])
        return line.fit(rows.withColumn("y", slope * F.col("x") + 1))

    class Lost(Exception):
        pass

    class Dies:
        """A model whose writer is lost."""

        def write(self):
            raise Lost

    Dies.__name__ = "PipelineModel"
    folder = str(tmp_path / "models")
    save_models(spark, {"one": fitted(1), "two": fitted(2)}, folder)
    with pytest.raises(Lost):
        save_models(spark, {"one": fitted(5), "two": Dies()}, folder)
    slopes = lambda: {n: round(m.stages[-1].coefficients[0]) for n, m in load_models(spark, folder).items()}
    assert slopes() == {"one": 1, "two": 2}
    save_models(spark, {"two": fitted(7)}, folder)
    assert slopes() == {"two": 7}
