"""Parameter search: a study of trials that survives a restart.

Each trial is one line of JSON in the study's file, appended when it ends, so a
study that is opened again goes on where it stopped.  The first trial is the
baseline, where one is given; then come random ones; then a tree-structured
Parzen estimator draws from the better trials' densities.  Trials are judged by
the driver; an objective trains and scores with Spark.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np


@dataclass(frozen=True)
class Real:
    """Numbers of a range, by their logarithms if ``log``, whole if ``whole``."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def bounds(self) -> tuple[float, float]:
        return (float(np.log(self.low)), float(np.log(self.high))) if self.log else (self.low, self.high)

    def inner(self, value: float) -> float:
        return float(np.log(value)) if self.log else float(value)

    def outer(self, z: float) -> float | int:
        value = min(self.high, max(self.low, float(np.exp(z)) if self.log else z))
        return int(round(value)) if self.whole else float(value)


@dataclass(frozen=True)
class Choice:
    options: tuple


@dataclass
class Trial:
    number: int
    params: dict
    state: str = "running"
    value: float | None = None
    steps: dict[int, float] = field(default_factory=dict)
    seconds: float = 0.0
    error: str = ""


class Pruned(Exception):
    """Raised inside an objective whose steps fall behind."""


def gap_objective(scores: dict[str, float], kind: str = "mean", gap: float = 0.0, penalty: float = 0.0, floor: float = 0.0) -> float:
    """Score of a trial from its cross-validations: the mean, the least, or one
    of them by name, less ``penalty`` times what ``gap`` exceeds ``floor`` by."""
    value = float(np.mean(list(scores.values()))) if kind == "mean" else min(scores.values()) if kind == "min" else scores[kind]
    return value - penalty * max(0.0, gap - floor)


class Study:
    def __init__(self, space: dict[str, Real | Choice], path: str | Path | None = None, seed: int = 42, startup: int = 10, share: float = 0.25, drawn: int = 24, prune_after: int | None = 5):
        self.space, self.path, self.seed, self.startup, self.share, self.drawn, self.prune_after = space, Path(path) if path else None, seed, startup, share, drawn, prune_after
        self.trials: list[Trial] = []
        if self.path and self.path.exists():
            for line in self.path.read_text().splitlines():
                try:
                    row = json.loads(line)
                except ValueError:
                    continue  # a line cut off by a crash: its trial is run again
                row["steps"] = {int(k): v for k, v in row["steps"].items()}
                self.trials.append(Trial(**row))

    @property
    def complete(self) -> list[Trial]:
        return [t for t in self.trials if t.state == "complete"]

    def top(self, k: int = 1) -> list[Trial]:
        return sorted(self.complete, key=lambda t: (-t.value, t.number))[:k]

    def _random(self, rng: np.random.Generator) -> dict:
        return {name: s.options[rng.integers(len(s.options))] if isinstance(s, Choice) else s.outer(rng.uniform(*s.bounds())) for name, s in self.space.items()}

    def suggest(self, number: int) -> dict:
        """Parameters of the trial; the same number and history, the same."""
        rng = np.random.default_rng((self.seed, number))
        done = self.top(len(self.trials))
        if len(done) < max(2, self.startup):
            return self._random(rng)
        cut = max(1, int(np.ceil(self.share * len(done))))
        good, rest = done[:cut], done[cut:]
        return {name: self._parzen(rng, s, [t.params[name] for t in good], [t.params[name] for t in rest]) for name, s in self.space.items()}

    def _parzen(self, rng: np.random.Generator, s: Real | Choice, good: list, rest: list):
        if isinstance(s, Choice):
            share = lambda seen: np.array([1 + sum(o == v for v in seen) for o in s.options]) / (len(s.options) + len(seen))
            better = share(good)
            tried = rng.choice(len(s.options), self.drawn, p=better)
            return s.options[tried[np.argmax((better / share(rest))[tried])]]
        low, high = s.bounds()
        span = max(high - low, 1e-12)
        # the whole range is one more, wide kernel of either density
        kernels = lambda seen: (np.array([(low + high) / 2] + [s.inner(v) for v in seen]), np.array([span] + [span / np.sqrt(1 + len(seen))] * len(seen)))

        def density(z: np.ndarray, seen: list) -> np.ndarray:
            centre, width = kernels(seen)
            return np.mean(np.exp(-0.5 * ((z[:, None] - centre) / width) ** 2) / width, axis=1)

        centre, width = kernels(good)
        k = rng.integers(len(centre), size=self.drawn)
        z = np.clip(rng.normal(centre[k], width[k]), low, high)
        return s.outer(float(z[np.argmax(density(z, good) / density(z, rest))]))

    def _reporter(self, trial: Trial) -> Callable[[int, float], None]:
        def report(step: int, value: float) -> None:
            trial.steps[step] = float(value)
            seen = [t.steps[step] for t in self.complete if step in t.steps]
            if self.prune_after is not None and len(seen) >= self.prune_after and value < np.median(seen):
                raise Pruned(f"step {step}")

        return report

    def run(self, objective: Callable[[dict, Callable[[int, float], None]], float], trials: int, baseline: dict | None = None, same_failures: int = 3, seconds: float = 3 * 3600) -> Study:
        """Up to ``trials`` trials in all, those of the file included.  Stops
        early after ``same_failures`` equal errors in a row or ``seconds``."""
        began = time.monotonic()
        while len(self.trials) < trials and time.monotonic() - began < seconds:
            tail = [t.error for t in self.trials[-same_failures:]]
            if len(tail) == same_failures and tail[0] and len(set(tail)) == 1:
                break
            number = len(self.trials)
            trial = Trial(number, dict(baseline) if number == 0 and baseline is not None else self.suggest(number))
            at = time.monotonic()
            try:
                trial.value = float(objective(trial.params, self._reporter(trial)))
                trial.state = "complete" if np.isfinite(trial.value) else "failed"
                trial.error = "" if trial.state == "complete" else "value is not finite"
            except Pruned:
                trial.state = "pruned"
            except Exception as e:  # a failed trial is a result: it is kept, and repeats end the study
                trial.state, trial.error = "failed", f"{type(e).__name__}: {e}"[:300]
            trial.seconds = round(time.monotonic() - at, 3)
            if trial.state == "failed":
                trial.value = None
            self.trials.append(trial)
            if self.path:
                self.path.parent.mkdir(parents=True, exist_ok=True)
                with self.path.open("a") as out:
                    out.write(json.dumps(asdict(trial)) + "\n")
        return self

    def budget(self, trials: int, smoke: int = 3) -> float:
        """Seconds that ``trials`` trials would take, from the first ``smoke``."""
        spent = [t.seconds for t in self.complete[:smoke]]
        return float(np.mean(spent) * trials) if spent else float("nan")


def reproduces(study: Study, expected: float, within: float = 5e-5) -> bool:
    """Whether trial 0 gives the baseline's known score."""
    return bool(study.trials) and study.trials[0].value is not None and abs(study.trials[0].value - expected) <= within


def revalidate(study: Study, score: Callable[[dict, int], float], seeds: tuple[int, ...] = (42, 7, 2024), k: int = 3) -> list[dict]:
    """The top ``k`` trials again over seeds: mean and sample deviation."""
    out = []
    for t in study.top(k):
        got = [score(t.params, s) for s in seeds]
        out.append({"number": t.number, "params": t.params, "mean": float(np.mean(got)), "sd": float(np.std(got, ddof=1)) if len(got) > 1 else 0.0})
    return sorted(out, key=lambda r: -r["mean"])
