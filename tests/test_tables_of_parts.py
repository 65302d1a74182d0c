from featlab.queries import QUERIES
from featlab.sources import matrices as M


def test_a_folder_of_part_files_is_one_table(spark, tmp_path):
    spark.range(4).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "region.parquet").write_bytes(b"x")
    (tmp_path / "labels.parquet").mkdir()
    (tmp_path / "labels.parquet" / "0.parquet").write_bytes(b"x")
    want = ["documents", "labels", "pages", "region"]
    assert sorted(r["dataset"] for r in QUERIES["directory_listing"](spark, str(tmp_path)).collect()) == want
    assert sorted(r["dataset"] for r in QUERIES["directory_listing"](spark, f"file://{tmp_path}/").collect()) == want
    assert {r["repository"] for r in M.list_datasets(spark, str(tmp_path), "*.parquet").collect()} == {tmp_path.name}
