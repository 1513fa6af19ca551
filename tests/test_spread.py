"""Rows are dealt anew where the tasks that read them would not share them evenly."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscope.operators.joins import spread


def parts(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("keys", [list(range(4000)), [None, 1] * 2000])
def test_one_row_group_in_many_splits_is_dealt_to_all_cores(spark, tmp_path, keys):
    # some 22 MB in one row group: several splits by bytes, one of which holds every row
    rows = {"id": pa.array(keys, pa.int64()), "text": [f"{i * 7919 % 4001:04d}" * 1400 for i in range(4000)]}
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table(rows), path, compression="none", use_dictionary=False)
    df = spark.read.parquet(path)
    assert df.rdd.getNumPartitions() > 4 and len(parts(df)) == 1
    got = spread(df, "id")
    assert got.exceptAll(df).isEmpty() and got.count() == 4000
    assert got.rdd.getNumPartitions() == 8
    if keys[0] is not None:
        assert max(parts(got)) < 1000


def test_even_and_empty_inputs(spark):
    even = spark.range(0, 8000, 1, 16)
    assert spread(even, "id") is even
    nothing = spark.range(0)
    assert spread(nothing, "id").count() == 0
