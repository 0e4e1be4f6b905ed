"""Sequential choice of parameters: densities of good and bad trials propose, folds halve.

The first trials are drawn evenly. Then the trials so far are parted into the best part and the
rest, each parameter's values in both are smoothed to a density (kernels around the values, mixed with the
even draw), and of some draws from the good density the one with the largest ratio of good to bad is tried. A
trial goes from fold to fold only while it is among the better half of those that came as far, so most folds are
spent on what looks good. A trial that was stopped informs the densities, but never wins.

The driver holds one row per trial; what a trial costs (Spark jobs over its folds) is the caller's function.
Everything is drawn from one seed, so the same seed and losses give the same trials.

Defined cases: a loss that isn't a number counts as infinitely large. Ties go to the earlier trial. No trial gives an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Trials that are drawn evenly before densities are used, the part that counts as good, draws from its density a trial, and the narrowest kernel.
FIRST, GOOD, DRAWS, NARROW = 12, 0.15, 24, 0.1


@dataclass(frozen=True)
class Span:
    """Numbers from ``low`` to ``high``, both included; ``log``: even on the logarithm; ``whole``: integers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def __post_init__(self) -> None:
        if self.high < self.low or (self.log and self.low <= 0):
            raise ValueError(f"no such range: {self}")

    def _ends(self) -> tuple[float, float]:
        # An integer stands for the half on either side of it.
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(max(low, self.low / 2)), math.log(high)) if self.log else (low, high)

    def value(self, place: float) -> float | int:
        """The value at a place from 0 to 1."""
        a, b = self._ends()
        v = a + place * (b - a)
        v = math.exp(v) if self.log else v
        v = min(max(v, self.low), self.high)
        return min(max(round(v), math.ceil(self.low)), math.floor(self.high)) if self.whole else v

    def place(self, value: float) -> float:
        a, b = self._ends()
        return 0.5 if a == b else min(1.0, max(0.0, ((math.log(value) if self.log else value) - a) / (b - a)))

    def drawn(self, rng: np.random.Generator, values: list) -> float | int:
        """From the density of ``values``; evenly if there are none."""
        k = int(rng.integers(len(values) + 1))
        if k == len(values):
            return self.value(rng.random())
        while not 0 <= (x := rng.normal(self.place(values[k]), self._width(values))) <= 1:
            pass
        return self.value(x)

    def _width(self, values: list) -> float:
        places = [self.place(v) for v in values]
        return max(NARROW, float(np.std(places)) * len(places) ** -0.2)

    def density(self, value: float, values: list) -> float:
        if not values:
            return 1.0
        x, width = self.place(value), self._width(values)
        within = lambda a: 0.5 * (math.erf((1 - a) / (width * math.sqrt(2))) + math.erf(a / (width * math.sqrt(2))))
        kernel = lambda a: math.exp(-(((x - a) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi) * within(a))
        return (1.0 + sum(kernel(self.place(v)) for v in values)) / (len(values) + 1)


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple

    def drawn(self, rng: np.random.Generator, values: list) -> object:
        k = int(rng.integers(len(values) + 1))
        return self.values[int(rng.integers(len(self.values)))] if k == len(values) else values[k]

    def density(self, value: object, values: list) -> float:
        return (sum(v == value for v in values) + 1 / len(self.values)) / (len(values) + 1)


Space = dict[str, Span | Choice]


@dataclass
class Trial:
    """A choice and its losses, fold by fold; ``whole`` if no fold was left out."""

    choice: dict
    losses: list[float] = field(default_factory=list)
    whole: bool = False

    @property
    def loss(self) -> float:
        return sum(self.losses) / len(self.losses)


def proposed(space: Space, trials: list[Trial], rng: np.random.Generator) -> dict:
    """The next choice."""
    if len(trials) < FIRST:
        return {name: span.drawn(rng, []) for name, span in space.items()}
    order = sorted(trials, key=lambda t: t.loss)
    cut = math.ceil(GOOD * len(order))
    good, bad = order[:cut], order[cut:]
    held = {name: ([t.choice[name] for t in good], [t.choice[name] for t in bad]) for name in space}
    draws = [{name: span.drawn(rng, held[name][0]) for name, span in space.items()} for _ in range(DRAWS)]
    return max(draws, key=lambda c: sum(math.log(span.density(c[name], held[name][0]) / span.density(c[name], held[name][1])) for name, span in space.items()))


def sampled(space: Space, loss: Callable[[dict, int], float], folds: int, trials: int, seed: int = 7) -> list[Trial]:
    """All trials, best first: those of all folds by mean loss, then the stopped ones. ``loss`` gives a choice's loss on a fold."""
    if trials < 1 or folds < 1:
        raise ValueError("at least one trial and one fold")
    rng = np.random.default_rng(seed)
    done: list[Trial] = []
    for _ in range(trials):
        t = Trial(proposed(space, done, rng))
        for fold in range(folds):
            x = float(loss(t.choice, fold))
            t.losses.append(math.inf if math.isnan(x) else x)
            so_far = sorted(sum(o.losses[: fold + 1]) for o in done if len(o.losses) > fold)
            if fold + 1 < folds and so_far and sum(t.losses) > so_far[(len(so_far) - 1) // 2]:
                break
        t.whole = len(t.losses) == folds
        done.append(t)
    return sorted(done, key=lambda t: (not t.whole, -len(t.losses), t.loss))
