"""Written tables in the shared folder."""

import glob

from newsloom.runtime import drop, materialize, shared_dir


def test_written_tables(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    made = materialize(spark.range(5), "five")
    assert made.count() == 5 and made.dtypes == spark.range(5).dtypes
    path = made._newsloom_path.removeprefix("file://")
    assert glob.glob(f"{path}/*.parquet")
    drop(made, spark.range(1))
    assert not glob.glob(f"{path}/*.parquet")
