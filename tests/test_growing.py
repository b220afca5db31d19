"""A growing series without a stream: prefixes that ask together, and the timer that is put off."""

from datetime import timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tideglass.functions import kernels
from tideglass.operators import match
from tideglass.streaming import streams


def made():
    rng = np.random.default_rng(11)
    values = {i: rng.normal(size=int(n)) for i, n in enumerate(rng.integers(12, 60, 40))}
    values = {i: list((v - v.mean()) / v.std()) for i, v in values.items()}
    rows = []
    for n in range(10, 64):
        near = [i for i, v in values.items() if 0.7 * n <= len(v) <= 1.3 * n][:10]
        for label in (None, "a"):
            chosen = near if label is None else near[::-1]
            rows += [{"asked_label": label, "length": n, "place": k + 1, "c_shapelet_id": i, "c_label": "ab"[i % 2], "c_confidence": 0.5, "c_success_rate": i / 40, "c_discriminative_score": 0.2} for k, i in enumerate(chosen)]
    return match.Matcher(rows, values, {None, "a"}), rows, values


def test_prefixes_that_ask_together_are_answered_as_each_alone(monkeypatch):
    matcher, rows, values = made()
    x = np.random.default_rng(12).normal(size=64)
    prefixes = [kernels.prefix_normalised(x[:n]) for n in range(8, 53)]
    calls, whole = [], kernels.most_similar
    monkeypatch.setattr(kernels, "most_similar", lambda *a: calls.append(1) or whole(*a))
    for label in (None, "a", "unknown"):
        calls.clear()
        got = {k: found for k, *found in matcher.matches(prefixes, label)}
        assert len(calls) == 1
        want = {}
        for k, p in enumerate(prefixes):
            best = None
            for r in rows:
                if r["length"] == len(p) and r["asked_label"] == (label if label == "a" else None):
                    sim = float(kernels.multi_metric(p[None], np.array(values[r["c_shapelet_id"]])[None])[0])
                    if best is None or round(sim, 9) > round(best[1], 9):
                        best = (r["c_label"], sim, sim * (0.7 + 0.3 * (0.4 * 0.5 + 0.3 * r["c_success_rate"] + 0.3 * 0.2)))
            if best:
                want[k] = best
        assert got.keys() == want.keys() and len(want) > 30
        assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:]) for k in want)
        least = sorted(w[1] for w in want.values())[-5]
        assert sorted(k for k, _, sim, _ in matcher.matches(prefixes, label, least) if sim >= least) == sorted(k for k, w in want.items() if w[1] >= least)


class Held:
    def __init__(self):
        self.kept, self.timers = None, []

    get = lambda self: self.kept
    clear = lambda self: setattr(self, "kept", None)
    update = lambda self, x: setattr(self, "kept", x)
    getValueState = lambda self, name, schema: self
    registerTimer = lambda self, at: self.timers.append(at)


def test_a_series_asks_few_times_and_its_timer_is_put_off(monkeypatch):
    calls, whole = [], kernels.most_similar
    monkeypatch.setattr(kernels, "most_similar", lambda *a: calls.append(1) or whole(*a))
    x = np.random.default_rng(13).normal(size=64)
    one, held = streams.GrowingSeries(made()[0], 2.0, 0.0, timedelta(seconds=100)), Held()
    one.init(held)
    out = []
    for quarter in range(4):
        at = np.arange(16 * quarter, 16 * quarter + 16)
        frame = pd.DataFrame({"at": at, "value": x[at], "asked_label": None, "expected": 64, "ts": pd.to_datetime(at, unit="s")})
        out += list(one.handleInputRows((7,), iter([frame]), None))
    # 34 prefixes, sixteen together at most and only those that a batch made
    assert len(calls) <= 5
    assert len(out) == 1 and list(out[0]["values"][0]) == list(x) and out[0]["series_id"][0] == 7
    # set once; when it is due it goes on to the last point's time, and only then the state goes
    assert held.timers == [115_000]
    due = lambda t: list(one.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda: t)))
    due(115_000)
    assert held.timers == [115_000, 163_000] and held.kept is not None
    due(163_000)
    assert held.kept is None and len(held.timers) == 2
