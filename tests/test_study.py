"""The parameter search: baseline first, restart, pruning, stops, improvement."""

import json

import numpy as np
import pytest

from helixframe.operators.study import Choice, Real, Study, gap_objective, reproduces, revalidate

SPACE = {"rate": Real(1e-3, 1.0, log=True), "depth": Real(2, 10, whole=True), "kind": Choice(("a", "b", "c"))}


def score(p, report=None):
    return -((np.log10(p["rate"]) + 1) ** 2) - 0.1 * abs(p["depth"] - 6) + (0.5 if p["kind"] == "b" else 0)


def test_finds_and_restarts(tmp_path):
    path = tmp_path / "deep" / "study.jsonl"
    base = {"rate": 0.5, "depth": 3, "kind": "a"}
    first = Study(SPACE, path).run(score, 12, baseline=base)
    assert first.trials[0].params == base and reproduces(first, score(base)) and not reproduces(first, 9.0)
    with path.open("a") as out:
        out.write('{"number": 12, "par')  # a crash inside a line
    path.write_text(path.read_text() + "\n")
    second = Study(SPACE, path).run(score, 50, baseline=base)
    assert [t.params for t in second.trials[:12]] == [t.params for t in first.trials] and len(second.trials) == 50
    straight = Study(SPACE).run(score, 50, baseline=base)
    assert [t.params for t in straight.trials] == [t.params for t in second.trials]
    drawn = Study(SPACE, startup=50).run(score, 50, baseline=base)
    assert second.top()[0].value > 0.3 and np.mean([t.value for t in second.trials[25:]]) > np.mean([t.value for t in drawn.trials[25:]])
    assert all(isinstance(t.params["depth"], int) and 2 <= t.params["depth"] <= 10 and 1e-3 <= t.params["rate"] <= 1 for t in second.trials)
    assert all(json.loads(x)["state"] == "complete" for x in path.read_text().splitlines() if x.endswith("}"))


def test_stops():
    def broken(p, report):
        raise ValueError("same")

    failed = Study(SPACE).run(broken, 20)
    assert len(failed.trials) == 3 and failed.top() == [] and failed.trials[0].error == "ValueError: same"
    assert len(Study(SPACE).run(score, 20, seconds=0).trials) == 0
    assert Study(SPACE).run(lambda p, report: float("nan"), 2).trials[0].state == "failed"


def test_pruning():
    def stepped(p, report):
        value = score(p)
        report(1, value)
        return value

    study = Study(SPACE, prune_after=3, startup=99).run(stepped, 30)
    states = [t.state for t in study.trials]
    assert "pruned" in states and states[:3] == ["complete"] * 3
    assert "pruned" not in [t.state for t in Study(SPACE, prune_after=None, startup=99).run(stepped, 30).trials]


def test_scores():
    both = {"skf": 0.6, "sgkf": 0.4}
    assert gap_objective(both) == pytest.approx(0.5) and gap_objective(both, "min") == 0.4 and gap_objective(both, "skf") == 0.6
    assert gap_objective(both, gap=0.3, penalty=2, floor=0.1) == pytest.approx(0.1)
    study = Study(SPACE).run(score, 6)
    out = revalidate(study, lambda p, seed: score(p) + seed, seeds=(0, 2), k=2)
    assert len(out) == 2 and out[0]["mean"] == pytest.approx(study.top()[0].value + 1) and out[0]["sd"] == pytest.approx(2**0.5)
    assert study.budget(100) >= 0
