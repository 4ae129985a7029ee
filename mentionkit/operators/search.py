"""K3 -- parameter search: waves of concurrent trials, model-based sampling, median pruning.

A trial is a fit that reports its validation loss while it grows. Its parameters come from the trials of
earlier waves: at first at random, then as the best of some draws by the ratio of two densities, of the
good and of the other trials so far (a Parzen estimate of each parameter for itself). A trial ends early
when the best loss it has reported is above the median of what earlier waves had reported by the same
round. Trials of a wave run side by side as Spark jobs and do not see each other, so that a search gives
the same trials whatever their speed. The driver holds parameters and losses only.

Defined results: ties go to the earlier trial; a search without trials is an error; a trial whose fit
fails fails the search; a loss that is no number counts as infinite and is pruned first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median

import numpy as np

#: Random trials before the densities count, share and most of the good ones, draws a parameter.
STARTUP, GOOD_SHARE, MOST_GOOD, DRAWS = 10, 0.1, 25, 24
#: Earlier trials that must have reported by a round before one is pruned there.
LEAST_REPORTS = 5


@dataclass(frozen=True)
class Range:
    """A parameter between two ends (both included): ``log`` (uniform in the logarithm), or ``step`` apart."""

    low: float
    high: float
    step: float | None = None
    log: bool = False

    @property
    def cells(self) -> int | None:
        return None if self.step is None else round((self.high - self.low) / self.step) + 1

    def value(self, place: float) -> float | int:
        """The parameter at a place in [0, 1]."""
        if self.cells is not None:
            v = self.low + self.step * min(self.cells - 1, int(place * self.cells))
            return int(v) if isinstance(self.low, int) and isinstance(self.step, int) else round(v, 9)
        if self.log:
            return math.exp(math.log(self.low) + place * (math.log(self.high) - math.log(self.low)))
        return self.low + place * (self.high - self.low)

    def settled(self, place: float) -> float:
        """The same parameter's one place: the middle of its cell."""
        return place if self.cells is None else (min(self.cells - 1, int(place * self.cells)) + 0.5) / self.cells


@dataclass
class Trial:
    number: int
    places: dict[str, float]
    params: dict[str, float | int]
    losses: dict[int, float] = field(default_factory=dict)     # by rounds grown when reported
    pruned: bool = False

    @property
    def rounds(self) -> int:
        return max(self.losses, default=0)

    @property
    def loss(self) -> float:
        """The last loss reported: that of the model the trial ended with."""
        return self.losses[self.rounds] if self.losses else math.inf

    def best_by(self, rounds: int) -> float:
        return min((v for r, v in self.losses.items() if r <= rounds), default=math.inf)


class Density:
    """A Parzen estimate on [0, 1]: a normal bell cut at the ends for each place, and a wide one in the middle.

    A bell is as wide as the larger gap beside its place, and no narrower than one part in as many as there are bells.
    """

    def __init__(self, places: list[float]):
        order = np.sort(np.array([*places, 0.5]))
        gaps = np.diff(np.r_[0.0, order, 1.0])
        self.middle = order
        self.width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / (1 + len(order)), 1.0)
        self.width[np.searchsorted(order, 0.5)] = 1.0
        self.inside = np.array([_below((1 - m) / w) - _below(-m / w) for m, w in zip(self.middle, self.width)])

    def at(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.middle) / self.width
        return (np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.width * self.inside)).mean(axis=1)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        k = rng.integers(len(self.middle), size=n)
        x = rng.normal(self.middle[k], self.width[k])
        while (outside := (x < 0) | (x > 1)).any():     # again from the same bell, as each has the same share
            x[outside] = rng.normal(self.middle[k[outside]], self.width[k[outside]])
        return x


def _below(z: float) -> float:
    return (1 + math.erf(z / math.sqrt(2))) / 2


def suggest(space: dict[str, Range], earlier: list[Trial], rng: np.random.Generator, startup: int = STARTUP) -> dict[str, float]:
    """Places of the next trial's parameters, from the trials of earlier waves."""
    if len(earlier) < max(startup, 2):
        return {name: r.settled(rng.random()) for name, r in space.items()}
    # pruned ones rank behind those that ended, by the rounds they reached
    ranked = sorted(earlier, key=lambda t: (t.pruned, -t.rounds if t.pruned else 0, t.loss, t.number))
    good = min(MOST_GOOD, math.ceil(GOOD_SHARE * len(ranked)))
    out = {}
    for name, r in space.items():
        like, unlike = (Density([t.places[name] for t in part]) for part in (ranked[:good], ranked[good:]))
        x = like.draw(rng, DRAWS)
        out[name] = r.settled(float(x[np.argmax(np.log(like.at(x)) - np.log(unlike.at(x)))]))
    return out


def to_prune(trial: Trial, earlier: list[Trial], least: int = LEAST_REPORTS) -> bool:
    """Whether the trial's best loss is above the median of earlier trials' best by the same round."""
    others = [t.best_by(trial.rounds) for t in earlier if t.rounds >= trial.rounds]
    return len(others) >= least and trial.best_by(trial.rounds) > median(others)


def search(space: dict[str, Range], run: Callable[[dict, Callable[[int, float], bool]], None], trials: int = 100,
           parallel: int = 4, seed: int = 0, startup: int = STARTUP, least: int = LEAST_REPORTS) -> tuple[Trial, list[Trial]]:
    """The best trial and all of them, in order.

    ``run(params, report)`` grows a model and calls ``report(rounds, loss)`` as it does; where that returns
    true the trial is pruned and ``run`` is to stop. A trial that was pruned is never the best.
    """
    if trials < 1:
        raise ValueError("a search needs at least one trial")
    done: list[Trial] = []

    def one(trial: Trial) -> None:
        def report(rounds: int, loss: float) -> bool:
            trial.losses[rounds] = math.inf if math.isnan(loss) else float(loss)
            trial.pruned = to_prune(trial, done, least)
            return trial.pruned
        run(trial.params, report)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        while len(done) < trials:
            wave = []
            for number in range(len(done), min(len(done) + parallel, trials)):
                places = suggest(space, done, np.random.default_rng([seed, number]), startup)
                wave.append(Trial(number, places, {n: r.value(places[n]) for n, r in space.items()}))
            list(pool.map(one, wave))
            done += wave
    return min((t for t in done if not t.pruned), key=lambda t: (t.loss, t.number)), done
