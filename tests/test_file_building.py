import glob

from textshield.plans.catalog import QUERIES
from textshield.plans.source_queries import SHELVES, one_file_each, shelved
from textshield.session import shared_dir
from pyspark.sql import functions as F


def test_files_are_dealt_to_many_tasks_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "key long, text string")
    assert shelved(rows, "key").rdd.getNumPartitions() == SHELVES
    folder = one_file_each(rows, "key", F.col("text"), str(tmp_path / "files"))
    files = glob.glob(f"{folder}/shelf=*/key=*/*.txt")
    assert len(files) == 40 and len({f.split("/shelf=")[1].split("/")[0] for f in files}) > 20
    assert not glob.glob(f"{folder}/key=*")


def test_stream_input_has_more_files_when_the_table_has_more_splits(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(70)], "doc_id long, text string")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    known = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/stream-*"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        assert QUERIES["incremental_collection"](spark, str(tmp_path)).count() == 70
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    new = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/stream-*")) - known
    assert len(new) == 1 and len(glob.glob(f"{new.pop()}/in/*.parquet")) == 9
