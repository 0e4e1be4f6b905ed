import sys

import pytest
from pyspark import cloudpickle

from docketry.operators import calling
from docketry.operators.calling import call, embeddings, failures, fill, pause


# Workers can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Refused(Exception):
    """An error with a status, which pickles by its arguments."""

    @property
    def status_code(self):
        return self.args[0]


def lengths(texts):
    return [[float(len(t))] for t in texts]


def failing(times, error):
    """A caller that fails so many times for each batch and then passes."""
    seen = {}

    def run(texts):
        seen[tuple(texts)] = seen.get(tuple(texts), 0) + 1
        if seen[tuple(texts)] <= times:
            raise error
        return lengths(texts)

    run.seen = seen
    return run


@pytest.fixture
def parts(spark):
    rows = [(f"k{n:02}", "x" * (n + 1)) for n in range(30)]
    return spark.createDataFrame([*rows, rows[3], ("none", None), ("empty", ""), (None, "lost")], "uuid string, segment string")


def state(rows):
    return {r["uuid"]: r["embedding"] for r in rows.collect()}


FULL = {f"k{n:02}": [float(n + 1)] for n in range(30)}


def test_two_failures_of_three_fill_the_store(spark, parts, tmp_path):
    path = str(tmp_path / "store")
    assert state(fill(parts, path, failing(2, Refused(429)), "wp", base=0.001, callers=3, batch=4)) == FULL
    assert failures(spark, path).count() == 0
    assert {(r["attempts"], r["kind"]) for r in calling.stored(spark, path).collect()} == {(3, "wp")}
    # What is there isn't called for again.
    assert state(fill(parts, path, failing(9, RuntimeError("called")), base=0.001)) == FULL and failures(spark, path).count() == 0


def test_three_failures_leave_rows_and_the_next_run_mends_them(spark, parts, tmp_path):
    path = str(tmp_path / "store")
    assert state(fill(parts, path, failing(3, Refused(500)), base=0.001, callers=3, batch=4)) == {}
    assert {(r["attempts"], r["error"]) for r in failures(spark, path).collect()} == {(3, "Refused: 500")} and failures(spark, path).count() == 30
    assert state(fill(parts, path, lengths, callers=2)) == FULL and failures(spark, path).count() == 0


def test_a_refused_text_takes_no_other_with_it(spark, parts, tmp_path):
    def picky(texts):
        if any(len(t) == 5 for t in texts):
            raise Refused(400)
        return lengths(texts)

    path = str(tmp_path / "store")
    got = state(fill(parts, path, picky, base=0.001, callers=2, batch=8))
    assert got == {k: v for k, v in FULL.items() if v != [5.0]}
    assert [(r["uuid"], r["attempts"]) for r in failures(spark, path).collect()] == [("k04", 1)]


def test_a_dead_wave_keeps_the_waves_before(spark, parts, tmp_path):
    path = str(tmp_path / "store")

    class Dead(BaseException):
        pass

    def mortal(texts):
        if any(len(t) == last for t in texts):
            raise Dead
        return lengths(texts)

    # The text that ends the job stands in the last wave.
    waves = {r["uuid"]: r["w"] for r in parts.where("segment <> '' and uuid is not null").selectExpr("uuid", "pmod(xxhash64(uuid), 3) w").collect()}
    last = int(next(k for k, w in sorted(waves.items()) if w == 2)[1:]) + 1
    with pytest.raises(Exception, match="Dead"):
        fill(parts, path, mortal, callers=2, wave_rows=10)
    assert state(embeddings(spark, path)) == {k: v for k, v in FULL.items() if waves[k] < 2}
    assert state(fill(parts, path, lengths, callers=2)) == FULL


def test_empty_input(spark, parts, tmp_path):
    assert fill(parts.where("false"), str(tmp_path / "store"), lengths).collect() == []


def test_errors_and_pauses():
    assert call(failing(1, Refused(404)), ["a"], ["x"], 3, 0) == [(None, 1, "Refused: 404")]
    assert call(lambda texts: [], ["a"], ["x"], 2, 0)[0][1:] == (2, "ValueError: 0 vectors for 1 texts")
    caller = failing(2, ConnectionError("gone"))
    assert call(caller, ["a"], ["xx"], 3, 0) == [([2.0], 3, None)] and sum(caller.seen.values()) == 3
    assert pause("a", 2, 1.0) == pause("a", 2, 1.0) != pause("b", 2, 1.0) and all(2 ** (n - 1) <= pause("a", n, 1.0) < 2 ** (n - 1) + 1 for n in range(1, 8))
