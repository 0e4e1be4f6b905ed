from docketry import session


def test_tables_are_written_once_and_forgotten(spark):
    a, b = (session.materialize(spark.range(3), "t") for _ in range(2))
    assert a.inputFiles() and set(a.inputFiles()).isdisjoint(b.inputFiles()) and a.count() == 3
    assert all(session.shared_dir(spark) in f for f in a.inputFiles())


def test_batches_are_bounded_but_a_sessions_own_bound_stays(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        session.small_batches(spark)
        assert spark.conf.get(name) == str(session.BATCH_ROWS)
        spark.conf.set(name, "77")
        session.small_batches(spark)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)
