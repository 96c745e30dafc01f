"""Files of any size: written as their rows come, read back by split."""

import random

import pytest
from pyspark.sql import functions as F

from cityjobs.jobs.all_queries import QUERIES
from cityjobs.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_texts_in_order_a_file_for_each_name(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"t{i}" if i % 10 else None) for i in range(1000)] + [(None, 1, "x")]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "f string, i int, t string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go on over batches
    try:
        assert writers.write_texts(d, F.col("f"), F.col("t"), str(tmp_path / "out"), [F.col("i")]) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["f0", "f1", "f2"]
    for k in range(3):
        assert (tmp_path / "out" / f"f{k}").read_text() == "\n".join(f"t{i}" for i in range(1000) if i % 3 == k and i % 10)


@pytest.mark.parametrize("name", ["src1_citygml_buildings", "src1_first_files", "fn2_lod1_solids", "src2_terrain_triangles"])
def test_no_row_holds_a_file(spark, monkeypatch, name):
    monkeypatch.setattr(F, "collect_list", lambda *_: pytest.fail("a list of all of a file's rows"))
    assert QUERIES[name](spark, SF).count() > 0


def test_first_files_by_name_not_by_content(spark, tmp_path):
    for name, n in (("2_b_op.gml", 2), ("1_b_op.gml", 0), ("3_b_op.gml", 1), ("0_b_op.gml", 3), ("9_other.gml", 5)):
        (tmp_path / name).write_text("".join(f'<bldg:Building gml:id="x">{i}</bldg:Building>' for i in range(n)))
    got = readers.gml_buildings(spark, str(tmp_path), 2).groupBy("file").count().collect()  # an empty file does not count
    assert sorted(map(tuple, got)) == [("0_b_op.gml", 3), ("2_b_op.gml", 2)]
