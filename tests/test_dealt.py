import pytest

from sparkgate.plans.tabled import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["i11_batch_inputs", "x13_answer_spaces"])
def test_a_table_of_one_block_feeds_all_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
