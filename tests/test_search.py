import pytest

from assayer.operators import search


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


def run(costs, scores, budget=100.0, **more):
    clock, given = Clock(), {}

    def train(name, settings, seconds):
        given[name] = seconds
        clock.now += costs[name][0]
        return None if costs[name][0] > seconds else name

    def score(name, model):
        clock.now += costs[name][1]
        if scores[name] is None:
            raise RuntimeError
        return scores[name]

    return search.run_search(dict.fromkeys(costs), train, score, budget, clock=clock, **more), given


def test_even_shares_and_the_first_of_equals():
    record, given = run({"a": (10, 0), "b": (10, 0), "c": (10, 0)}, {"a": (5, 9), "b": (7, 9), "c": (7, 9)}, 90)
    assert given == {"a": 30, "b": 40, "c": 70} and record.selected == "b" and record.tied == ("b", "c")


def test_all_states():
    record, _ = run({"slow": (90, 0), "bad": (1, 0), "late": (1, 50), "never": (1, 1)}, {"slow": (1, 2), "bad": None, "late": (2, 2), "never": (2, 2)}, 120, fixed_seconds=60)
    assert [e.state for e in record.entries] == ["training_not_completed", "scoring_failed", "scoring_exceeded_budget", "not_started_budget_exhausted"] and record.selected is None
    record, _ = run({"a": (50, 0)}, {"a": (1, 2)}, 50)
    assert record.entries[0].state == "scoring_skipped_budget_exhausted"
    assert all(s in search.STATES for s in ("evaluated", record.entries[0].state))


def test_totals_must_agree():
    with pytest.raises(ValueError):
        run({"a": (1, 0), "b": (1, 0)}, {"a": (1, 2), "b": (1, 3)})


def test_order_and_notes():
    assert search.candidate_order(["a", "b"], ["x", "y", "z"], ["z", "x", "z"]) == ["a", "b", "x", "z"]
    with pytest.raises(ValueError):
        search.candidate_order(["a"], ["x"], ["q"])
    once = search.limitations({"limitations": [{"code": "other"}]}, 5, 4)
    assert [x["code"] for x in once["limitations"]] == ["other", "label_count_changed"]
    assert [x["code"] for x in search.limitations(once, 5, 5)["limitations"]] == ["other"]
