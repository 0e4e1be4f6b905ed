import math

import numpy as np
import pytest

from docketry.operators import classify, sampler
from docketry.operators.sampler import Choice, Span

SPACE = {"rate": Span(1e-3, 1.0, log=True), "depth": Span(1, 10, whole=True), "share": Span(0.5, 1.0), "kind": Choice(("a", "b", "c"))}


def bowl(choice, fold):
    """Best at rate 0.05, depth 6, share 0.8, kind b; folds differ a little."""
    return math.log10(choice["rate"] / 0.05) ** 2 + ((choice["depth"] - 6) / 5) ** 2 + (choice["share"] - 0.8) ** 2 + (choice["kind"] != "b") + 0.01 * fold


def test_it_beats_random_search_of_equal_cost():
    own, even = [], []
    # Not the seeds by which the module's constants were chosen.
    for seed in range(200, 220):
        spent = []
        own.append(sampler.sampled(SPACE, lambda c, f: spent.append(1) or bowl(c, f), 3, 60, seed)[0].loss)
        rng = np.random.default_rng(1000 + seed)
        # An even search needs all folds of each trial.
        draws = [{n: s.drawn(rng, []) for n, s in SPACE.items()} for _ in range(math.ceil(len(spent) / 3))]
        even.append(min(sum(bowl(c, f) for f in range(3)) / 3 for c in draws))
    assert np.mean(own) < np.mean(even) and np.median(own) < 0.5 * np.median(even)


def test_seeded_and_within_bounds():
    one, two, other = (sampler.sampled(SPACE, bowl, 2, 30, seed) for seed in (3, 3, 4))
    assert one == two != other
    for t in one:
        c = t.choice
        assert 1e-3 <= c["rate"] <= 1 and c["depth"] in range(1, 11) and isinstance(c["depth"], int) and 0.5 <= c["share"] <= 1 and c["kind"] in "abc"


def test_folds_halve_and_stopped_trials_never_win():
    found = sampler.sampled(SPACE, lambda c, f: bowl(c, f) if f else bowl(c, f) - 5, 4, 40)
    whole = [t for t in found if t.whole]
    assert found[: len(whole)] == whole and all(len(t.losses) == 4 for t in whole) and 0 < len(whole) < 30
    assert [t.loss for t in whole] == sorted(t.loss for t in whole)


def test_even_draws_of_integers_and_densities():
    rng = np.random.default_rng(1)
    span = Span(3, 5, whole=True)
    assert np.allclose(np.bincount([span.drawn(rng, []) for _ in range(6000)])[3:] / 6000, 1 / 3, atol=0.03)
    wide = Span(0.0, 2.0)
    grid = np.linspace(0, 2, 4001)
    assert abs(np.mean([wide.density(v, [0.1, 0.1, 1.9]) for v in grid]) - 1) < 0.01
    assert sum(Choice((1, 2, 3)).density(v, [1, 1, 3]) for v in (1, 2, 3)) == pytest.approx(1)


def test_odd_cases():
    found = sampler.sampled({"x": Span(0, 1)}, lambda c, f: math.nan if c["x"] > 0.1 else c["x"], 1, 12, 1)
    assert found[0].loss == min(t.loss for t in found)
    assert len({t.choice["x"] for t in sampler.sampled({"x": Span(2, 2)}, lambda c, f: 1.0, 2, 12)}) == 1
    for bad in ((2, 1, False), (0, 1, True)):
        with pytest.raises(ValueError):
            Span(bad[0], bad[1], log=bad[2])
    with pytest.raises(ValueError):
        sampler.sampled({"x": Span(0, 1)}, bowl, 1, 0)


def test_search_of_a_model(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 4))
    rows = spark.createDataFrame([(k, v, int(v[0] > 0)) for k, v in enumerate(x.tolist())], "doc long, v array<double>, y int")
    found = classify.sampled_search(rows, "doc", "v", ["y"], "logistic", {"dims": Choice((1, 4)), "regParam": Span(1e-3, 10.0, log=True)}, 3, folds=2)
    assert len(found) == 3 and found[0].whole and found[0].choice["dims"] == 4
