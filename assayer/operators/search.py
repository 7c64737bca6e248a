"""A search over candidates under one time budget: train, score on validation data, choose."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..functions.jsontools import canonical
from ..functions.stats import percentile_95
from .choices import allotted

#: What may become of a candidate.
STATES = ("evaluated", "training_not_completed", "scoring_failed", "scoring_exceeded_budget", "scoring_skipped_budget_exhausted", "not_started_budget_exhausted")


@dataclass(frozen=True)
class Entry:
    candidate: str
    state: str
    n_correct: int | None = None
    n: int | None = None
    seconds: float = 0.0


@dataclass(frozen=True)
class SearchRecord:
    entries: tuple[Entry, ...]
    selected: str | None
    tied: tuple[str, ...]


def run_search(
    candidates: dict[str, Any],
    train: Callable[[str, Any, float], Any | None],
    score: Callable[[str, Any], tuple[int, int]],
    budget_seconds: float,
    fixed_seconds: float | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> SearchRecord:
    """Candidates in declared order. train(name, settings, seconds) gives a model or None; score(name, model) gives (correct, total).

    Each training gets an even share of what remains of the budget, or a fixed time. A
    score that comes too late does not count. The most correct wins, the first declared
    of equals; totals that differ are an error.
    """
    start, entries = clock(), []
    names = list(candidates)
    for k, name in enumerate(names):
        left = budget_seconds - (clock() - start)
        if left <= 0:
            entries.append(Entry(name, "not_started_budget_exhausted"))
            continue
        began = clock()
        model = train(name, candidates[name], allotted(left, len(names) - k, fixed_seconds))
        if model is None:
            entries.append(Entry(name, "training_not_completed", seconds=clock() - began))
            continue
        if clock() - start >= budget_seconds:
            entries.append(Entry(name, "scoring_skipped_budget_exhausted", seconds=clock() - began))
            continue
        try:
            right, total = score(name, model)
        except Exception:  # a candidate that cannot be scored must not end the search
            entries.append(Entry(name, "scoring_failed", seconds=clock() - began))
            continue
        late = clock() - start > budget_seconds
        entries.append(Entry(name, "scoring_exceeded_budget" if late else "evaluated", right, total, clock() - began))
    judged = [e for e in entries if e.state == "evaluated"]
    if len({e.n for e in judged}) > 1:
        raise ValueError("candidates were not judged on the same number of rows")
    best = max((e.n_correct for e in judged), default=None)
    tied = tuple(e.candidate for e in judged if e.n_correct == best)
    return SearchRecord(tuple(entries), tied[0] if tied else None, tied)


def candidate_order(defaults: list[str], known: list[str], explicit: list[str]) -> list[str]:
    """The defaults in order, then the explicit ones in the order in which they are known, each once."""
    if unknown := [x for x in explicit if x not in known]:
        raise ValueError(f"unknown candidates: {', '.join(unknown)}")
    return [*defaults, *[x for x in known if x in explicit and x not in defaults]]


def limitations(report: dict[str, Any], n_labels: int, previous_labels: int) -> dict[str, Any]:
    """report with a note if the number of labels changed; an earlier note of that goes."""
    kept = [x for x in report.get("limitations", []) if x.get("code") != "label_count_changed"]
    if n_labels != previous_labels:
        kept.append({"code": "label_count_changed", "previous": previous_labels, "current": n_labels})
    return {**report, "limitations": kept}


def record_json(record: SearchRecord) -> str:
    """A search's record as one canonical document; seconds are whole milliseconds."""
    entries = [{"candidate": e.candidate, "state": e.state, "n_correct": e.n_correct, "n": e.n, "milliseconds": round(1000 * e.seconds)} for e in record.entries]
    return canonical({"entries": entries, "selected": record.selected, "tied": list(record.tied)})


#: What a training job may do next, by its state; all else is refused.
JOB = {
    ("queued", "start"): "running", ("queued", "cancel"): "cancelled", ("running", "finish"): "done", ("running", "fail"): "failed",
    ("running", "cancel"): "cancelling", ("cancelling", "finish"): "cancelled", ("cancelling", "fail"): "cancelled",
}


def transition(state: str, event: str) -> str:
    """The state of a job after an event; ValueError if the event cannot happen then."""
    if (state, event) not in JOB:
        raise ValueError(f"{event} of a job that is {state}")
    return JOB[state, event]


def job_status(record: dict[str, Any] | None, locked: bool) -> str:
    """What a job is, by its record and whether a process holds its lock: a running job without one was interrupted."""
    if record is None:
        return "none"
    state = record["state"]
    return "interrupted" if state in ("running", "cancelling") and not locked else state


def measured(run: Callable[[], Any], warm: int = 20, times: int = 1000, seconds: float = 60.0, clock: Callable[[], int] = time.monotonic_ns) -> dict[str, Any]:
    """Microseconds of run(): the interpolated 95th percentile (whole part, hundredths), the mean, and how often it ran before time was out."""
    end, samples = clock() + int(seconds * 1e9), []
    for i in range(warm + times):
        began = clock()
        if began >= end:
            break
        run()
        if i >= warm:
            samples.append((clock() - began) // 1000)
    if not samples:
        raise ValueError("no time to measure")
    return {"n": len(samples), "complete": len(samples) == times, "p95_us": percentile_95(samples), "mean_us": sum(samples) / len(samples)}
