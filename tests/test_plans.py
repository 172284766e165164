"""Plans hold what the queries count on: pruning, push-down, limits before the shuffle."""

from __future__ import annotations

from marlstone.plans.catalog import QUERIES


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(spark, sf_dir, "s1_parquet_scan")
    pushed, read = p.split("PushedFilters")[1].split("ReadSchema")
    assert "GreaterThan(l_quantity," in pushed and "EqualTo(l_returnf" in pushed  # the text is cut
    assert "l_orderkey" in read and "l_shipdate" not in read and "l_tax" not in read


def test_folders_are_pruned(spark, sf_dir):
    assert "event_type" in plan(spark, sf_dir, "s3_partitioned_sink").split("PartitionFilters: [")[1].split("]")[0]


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    for name in ("k2_vector_topk", "u3_vector_lsh"):
        p = plan(spark, sf_dir, name)
        assert p.index("WindowGroupLimit") < p.rindex("WindowGroupLimit") and "Partial" in p[p.rindex("WindowGroupLimit") :]
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, "k1_sort_limit")


def test_asof_join_shuffles_once(spark, sf_dir):
    assert plan(spark, sf_dir, "j7_asof").count("Exchange hashpartitioning") == 1


def test_interval_join_is_an_equi_join(spark, sf_dir):
    p = plan(spark, sf_dir, "j8_interval")
    assert "NestedLoop" not in p and "Cartesian" not in p and "__bucket" in p


def test_texts_are_not_shuffled_for_exact_dedup(spark, sf_dir):
    p = plan(spark, sf_dir, "a13_exact_dedup")
    assert "Exchange hashpartitioning(h" in p and "hashpartitioning(text" not in p


def test_relational_queries_stay_in_the_engine(spark, sf_dir):
    for name in QUERIES:
        if name[0] in "sfjawkocr" and not name.startswith(("s4", "s5")):  # a stream, and sources in Python
            assert "Python" not in plan(spark, sf_dir, name) and "Pandas" not in plan(spark, sf_dir, name), name
