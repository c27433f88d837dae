import math

import numpy as np
import pytest

from tidemark.functions.numeric import average_ranks, chi2_one_quantile
from tidemark.operators import kernels, wbs
from tidemark.operators.detect import series_events

SETTINGS = {"cusum": 3, "cusum_ls": 1, "sprt": 0.2, "gma": 0.5, "glr": 0.3, "brandt_glr": 0.05, "shewhart": 0.15, "e_detector": 0.05, "ssr_cusum": 0.3, "adaptive_cusum": 0.3}


def walk(n=400, seed=0):
    rng = np.random.default_rng(seed)
    steps = rng.normal(0, 0.02, n) + np.where(np.arange(n) // 80 % 2, 0.03, -0.01)
    return np.cumsum(steps)


def events(x, method, q, **o):
    ts = np.datetime64("2020-01-01", "ns") + np.arange(len(x)) * np.timedelta64(1, "D")
    return [(e[1], e[2], e[4]) for e in series_events(ts, np.asarray(x, float), method, q, o)]


@pytest.mark.parametrize("method", SETTINGS)
def test_fires_and_never_looks_ahead(method):
    x = walk()
    full = events(x, method, SETTINGS[method])
    assert full, method
    for n in (1, 2, 60, 150, 399):
        assert events(x[:n], method, SETTINGS[method]) == [e for e in full if e[0] < n]


@pytest.mark.parametrize("method", [*SETTINGS, "recursive_param_seg", "wbs_lepage"])
@pytest.mark.parametrize("x", [[], [1.0], [1.0, 1.0], [3.0] * 60])
def test_short_and_constant_series_have_no_events(method, x):
    if len(x) == 60 and method in ("ssr_cusum", "wbs_lepage"):
        pytest.skip("ranks of equal numbers are evidence by definition")
    o = {"draws": 5, "reps": 5} if method == "wbs_lepage" else {}
    assert events(x, method, 1.0, **o) == []


def test_threshold_must_be_exceeded():
    assert events([0.0, 0.5], "cusum", 1.0, h=0.5, nu=0.0) == []
    assert events([0.0, 0.5000001], "cusum", 1.0, h=0.5, nu=0.0) == [(1, 1, pytest.approx(0.5000001))]
    assert events([0.0, -0.6], "cusum", 1.0, h=0.5, nu=0.0)[0][1] == -1


def test_unknown_method():
    with pytest.raises(ValueError):
        kernels.make("nothing")


def test_glr_against_all_splits():
    d = np.diff(walk(150, 3))
    limit, start, want = 0.3 * chi2_one_quantile(0.9999), 0, []
    for t in range(1, len(d)):
        best = -math.inf
        for k in range(start, t):
            left, right = d[start : k + 1], d[k + 1 : t + 1]
            if len(left) >= 20 and len(right) >= 5 and left.var(ddof=1) >= 1e-8:
                best = max(best, (left.mean() - right.mean()) ** 2 / (left.var(ddof=1) * (1 / len(left) + 1 / len(right))))
        if best > limit:
            want.append(t + 1)
            start = t + 1
    assert [e[0] for e in events(walk(150, 3), "glr", 0.3)] == want != []


def test_brandt_against_definition():
    x, L, q = walk(300, 5), 10, 0.05
    limit, want, begin = chi2_one_quantile(1 - 1e-4) * 10 * q, [], 0
    for i in range(len(x)):
        seg = x[begin : i + 1]
        if len(seg) >= L + 5:
            old, win = seg[:-L], seg[-L:]
            if L * (win.mean() - old.mean()) ** 2 / old.var(ddof=1) > limit:
                want.append(i)
                begin = i
    assert [e[0] for e in events(x, "brandt_glr", q)] == want != []


def test_shewhart_run_starts_the_next_segment():
    x = [0.0, 1.0] * 12 + [50.0] * 5 + [50.0, 51.0] * 10 + [200.0] * 5
    got = events(x, "shewhart", 1.0, window=24, c_lim=5, k=10)
    assert [e[0] for e in got][:1] == [28] and all(e[1] == 1 for e in got)


def test_ssr_ignores_scale():
    x = walk(300, 2)
    assert [e[:2] for e in events(x, "ssr_cusum", 0.3)] == [e[:2] for e in events(x * 1000, "ssr_cusum", 0.3)] != []


def test_segmentation_finds_a_level_shift():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(8, 1, 60)])
    beam = kernels.make("recursive_param_seg", 2.0)
    for v in x:
        beam.step(v)
    assert any(abs(p - 60) <= 2 for p in beam.answer())


def test_adaptive_sees_a_change_of_variance():
    rng = np.random.default_rng(4)
    d = np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 6, 100)])
    got = events(np.concatenate([[0], np.cumsum(d)]), "adaptive_cusum", 0.5)
    assert any(200 < e[0] < 240 for e in got)


def test_lepage_split_and_segmentation():
    assert average_ranks(np.array([3.0, 1.0, 3.0])).tolist() == [2.5, 1.0, 2.5]
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(5, 1, 60)])
    assert abs(int(np.argmax(wbs.lepage_splits(x, 10))) - 59) <= 1
    found = wbs.segment(x, draws=40, reps=20)
    assert any(abs(f - 59) <= 3 for f in found)
    assert wbs.segment(x, draws=40, reps=20) == found


def test_segmentation_looks_at_each_drawn_window():
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=90), rng.integers(0, 9, 90).astype(float)):
        stat, at = wbs._largest(x, 5, 84, 60, 10, np.random.default_rng(3))
        again = np.random.default_rng(3)
        size = again.integers(20, 81, 60)
        start = 5 + again.integers(0, 80 - size + 1)
        splits = [(z.max(), s + int(np.argmax(z))) for s, z in ((s, wbs.lepage_splits(x[s : s + m], 10)) for s, m in zip(start, size, strict=True))]
        assert (stat, at) == pytest.approx(max(splits))


def test_segmentation_defaults_and_thresholds_between_lengths():
    import inspect

    o = {k: v.default for k, v in inspect.signature(wbs.segment).parameters.items()}
    assert (o["draws"], o["reps"]) == (10000, 200)
    assert wbs.grid(495) == list(range(20, 495, 10)) and wbs.grid(1700) == [*range(20, 501, 10), 1000]
    value = {20: 2.0, 30: 4.0, 500: 9.0, 1000: 10.0}.get
    assert [wbs.between(n, wbs.grid(1700), value) for n in (20, 25, 750, 1700)] == [2.0, 3.0, 9.5, 10.0]
