import pytest

from newsloom.session import cut_lineage, scratch_path, shared_folder


def test_the_shared_folder_is_the_one_named(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    if named:
        assert folder == named
    assert spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_a_cluster_has_to_name_a_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_lineage_is_cut(spark):
    df = cut_lineage(spark.range(10).selectExpr("id * 2 AS n").where("n > 3"))
    assert df.count() == 8
    assert "Project" not in df._jdf.queryExecution().optimizedPlan().toString()
