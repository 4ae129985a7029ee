"""Same answers under 1 and 8 shuffle partitions (guards the positional zip, top-k and first-n)."""
from mentionkit.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _rows(spark, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())


def test_partition_count_invariance(spark):
    names = ["j4_a6_true_vs_false_zip", "t1_top_features", "t3_first_errors_name_gender", "a1_mention_profile"]
    before = {n: _rows(spark, n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        after = {n: _rows(spark, n) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after
