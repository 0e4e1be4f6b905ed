from pyspark.sql import functions as F

from docketry.plans import more_queries, rule_queries, tables


def _write(spark, at):
    spark.createDataFrame([(k % 40, k % 3) for k in range(400)] + [(999, 1), (5, 77)], "l_orderkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(40)], "o_orderkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(k, k) for k in range(3)], "s_suppkey long, s_nationkey long").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(k, f"NATION_{k}") for k in range(3)], "n_nationkey long, n_name string").write.parquet(f"{at}/nation.parquet")


def test_parties_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ITEMS", 50)
    _write(spark, tmp_path)
    items = tables._items(spark, str(tmp_path))
    assert items.rdd.getNumPartitions() == 9 and items.count() == 402  # as many tasks as the items ask for
    found = {r["paper_id"]: r["parties"] for r in tables.parties(spark, str(tmp_path)).collect()}
    want = {}
    for k in range(400):
        want.setdefault(k % 40, set()).add(f"NATION_{k % 3}")
    assert found == {k: sorted(v) for k, v in want.items()} | {999: ["NATION_1"]}
    # As in SQL, a line item without its order counts.
    assert {r["paper_id"]: r["a"] for r in more_queries.label_vector(spark, str(tmp_path)).collect()}[999] == 1
    for f in (rule_queries.names_in_reply, rule_queries.tags_left):
        assert f(spark, str(tmp_path)).where("paper_id = 999").count() == 1


def test_parties_of_wanted_papers(spark, tmp_path):
    _write(spark, tmp_path)
    wanted = spark.createDataFrame([(3,), (3,), (999,), (12345,)], "paper_id long")
    got = tables.parties(spark, str(tmp_path), wanted)
    assert {r["paper_id"]: len(r["parties"]) for r in got.collect()} == {3: 3, 999: 1}


def test_sampled_pairs_are_dealt_evenly(spark, monkeypatch):
    rows = spark.range(400)
    whole = more_queries.sampled_pairs(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), "id", 2, 4, 7)
    before = {tuple(r) for r in whole.collect()}
    monkeypatch.setattr(more_queries, "PAIRS", 500)
    some = more_queries.sampled_pairs(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"), "id", 2, 4, 7)
    assert {tuple(r) for r in some.collect()} == before and some.count() == len(before)
    tasks = some.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < len(before) / 4
