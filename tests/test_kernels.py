"""The folds over time against plain loops, limits and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.operators import kernels as k

T, N = 9, 3


@pytest.fixture
def case():
    rng = np.random.default_rng(11)
    return {"y": rng.normal(1.5, 1, (1, T)), "z": rng.normal(size=(T, N)), "a0": np.array([0.4, -0.2, 0.3]), "p0": np.array([0.9, 0.5, 0.7]), "h": 0.7, "q": np.array([0.3, 0.1, 0.2])}


def plain(c, mask=None, exponent=None):
    """One series, one state at a time."""
    a, p, total, path = c["a0"].copy(), c["p0"].copy(), 0.0, []
    for t in range(T):
        if exponent is not None:
            p = p + c["q"] ** 2
        x, g = a.copy(), c["z"][t].copy()
        for i in range(N):
            if exponent is not None and mask[i]:
                x[i] = np.exp(exponent * a[i])
                g[i] = exponent * c["z"][t, i] * x[i]
        v = c["y"][0, t] - sum(c["z"][t, i] * x[i] for i in range(N))
        f = sum(p[i] * g[i] ** 2 for i in range(N)) + c["h"] ** 2
        total += -0.5 * (np.log(2 * np.pi) + np.log(f) + v**2 / f)
        for i in range(N):
            gain = p[i] * g[i] / f
            a[i] += gain * v
            p[i] *= 1 - gain * g[i]
            if exponent is None:
                p[i] += c["q"][i] ** 2
        path.append((a.copy(), p.copy()))
    return total, np.array([a for a, _ in path]), np.array([p for _, p in path])


def run(c, **kw):
    return k.kalman_filter(c["y"], c["z"], c["a0"], c["p0"], c["h"], c["q"], **kw)


def test_step_by_hand():
    level, slope, c = k.dlt_step(np.array([8.0]), np.array([1.0]), np.array([10.0]), 0.5, 0.25, 0.6)
    assert (c[0], level[0]) == (8.6, 9.3)
    assert slope[0] == pytest.approx(0.25 * 1.3 + 0.75)


def test_missing_takes_the_forecast_and_infinite_is_passed_over():
    level, slope, c = k.dlt_step(np.array([8.0]), np.array([1.0]), np.array([np.nan]), 0.5, 0.25, 0.6)
    assert level[0] == c[0] == 8.6
    assert slope[0] == pytest.approx(0.25 * 0.6 + 0.75)
    level, slope, _ = k.dlt_step(np.array([8.0]), np.array([1.0]), np.array([np.inf]), 0.5, 0.25, 0.6)
    assert (level[0], slope[0]) == (8.0, 1.0)


def test_scan_is_its_steps():
    y = np.array([[3.0, 5.0, np.nan, 4.0, 8.0]])
    level, slope, comp = k.dlt_scan(y, 0.4, 0.3, 0.8)
    lv, sl = y[:, 0], np.zeros(1)
    for t in range(5):
        lv, sl, c = k.dlt_step(lv, sl, y[:, t], 0.4, 0.3, 0.8)
        assert (level[0, t], slope[0, t], comp[0, t]) == (lv[0], sl[0], c[0])


def test_a_missing_start_is_an_error():
    with pytest.raises(ValueError):
        k.dlt_scan(np.array([[np.nan, 1.0]]), 0.4, 0.3, 0.8)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=4, max_size=20), st.floats(0.01, 0.99), st.floats(0.01, 0.99), st.floats(0, 1))
def test_the_trend_is_linear_in_its_data(values, lev, slp, theta):
    y = np.array([values])
    x = np.cos(np.arange(len(values)))[None]
    both = k.dlt_scan(y - 2.5 * x, lev, slp, theta)[2]
    assert np.allclose(both, k.dlt_scan(y, lev, slp, theta)[2] - 2.5 * k.dlt_scan(x, lev, slp, theta)[2], atol=1e-9)


def test_filter_is_the_plain_loop(case):
    out, (total, a, p) = run(case), plain(case)
    assert out["log_p"][0] == pytest.approx(total, abs=1e-10)
    assert np.allclose(out["a"][0], a, atol=1e-12)
    assert np.allclose(out["p"][0], p, atol=1e-12)


@pytest.mark.parametrize("mask", [[True, True, True], [False, True, False]])
def test_extended_filter_is_the_plain_loop(case, mask):
    out, (total, a, p) = run(case, exponent=0.4, positivity=mask), plain(case, mask, 0.4)
    assert out["log_p"][0] == pytest.approx(total, abs=1e-10)
    assert np.allclose(out["a"][0], a)
    assert np.allclose(out["p"][0], p)


def test_an_extended_filter_without_positive_states_is_linear(case):
    ekf = run(case, exponent=0.5, positivity=[False] * N)
    linear = k.kalman_filter(case["y"], case["z"], case["a0"], case["p0"] + case["q"] ** 2, case["h"], case["q"])
    assert ekf["log_p"][0] == pytest.approx(linear["log_p"][0])
    assert np.allclose(ekf["a"], linear["a"])
    assert np.allclose(ekf["p"] + case["q"] ** 2, linear["p"])


def test_positive_states_have_a_floor(case):
    out = k.kalman_filter(np.full((1, T), -6.0), np.abs(case["z"]), case["a0"], case["p0"], case["h"], case["q"], positivity=[True, False, True])
    assert out["a"][..., [0, 2]].min() >= 1e-6
    assert out["a"][..., 1].min() < 0


@pytest.mark.parametrize("exponent", [None, 0.5])
def test_disclosure(case, exponent):
    a_obs, p_obs = np.zeros((T, N)), np.full((T, N), np.inf)
    same = run(case, a_obs=a_obs, p_obs=p_obs, exponent=exponent)
    free = run(case, exponent=exponent)
    assert np.allclose(same["a"], free["a"])
    assert same["log_p"] == pytest.approx(free["log_p"])
    a_obs[4, 1], p_obs[4, 1] = 0.8, 1e-9
    tight = run(case, a_obs=a_obs, p_obs=p_obs, exponent=exponent)
    assert abs(tight["a"][0, 4, 1] - 0.8) < 1e-4
    with pytest.raises(ValueError):
        run(case, a_obs=a_obs)


def test_missing_observations(case):
    case["y"][0, 3] = np.nan
    with pytest.raises(ValueError):
        run(case)
    out = run(case, skip_missing=True)
    assert np.isfinite(out["a"]).all()
    assert np.allclose(out["a"][0, 3], out["a"][0, 2])
    assert np.allclose(out["p"][0, 3], out["p"][0, 2] + case["q"] ** 2)


@pytest.mark.parametrize("told", [False, True])
def test_both_smoothers_have_the_same_means(case, told):
    kw = {}
    if told:
        kw = {"a_obs": np.zeros((T, N)), "p_obs": np.full((T, N), np.inf)}
        kw["a_obs"][2, 1], kw["p_obs"][2, 1] = 0.5, 0.05
        kw["a_obs"][6, 2], kw["p_obs"][6, 2] = 0.2, 0.1
    # a single state, for which the diagonal covariance is exact
    one = {**case, "z": case["z"][:, :1]}
    cut = {c: x[..., :1] * 0 + x[..., 1:2] for c, x in kw.items()}
    out = k.kalman_filter(one["y"], one["z"], one["a0"][:1], one["p0"][:1], one["h"], one["q"][:1], **cut)
    a_s, p_s = k.rts_smoother(out, one["q"][:1])
    if told:
        return  # with a disclosure only the innovation smoother sees it at the step itself
    assert np.allclose(a_s, k.dk_smoother(out, one["z"], one["a0"][:1], one["p0"][:1]), atol=1e-8)
    assert (p_s <= out["p"] + 1e-12).all()


def test_smoothed_variances_are_no_larger(case):
    for kw in ({}, {"exponent": 0.5}):
        out = run(case, **kw)
        assert (k.rts_smoother(out, case["q"], ekf=bool(kw))[1] <= out["p"] + 1e-12).all()


def test_extended_smoother_keeps_the_last_row(case):
    out = run(case, exponent=0.5)
    a_s, p_s = k.rts_smoother(out, case["q"], ekf=True)
    assert (a_s[0, -1] == out["a"][0, -1]).all() and (p_s[0, -1] == out["p"][0, -1]).all()
    one = {c: x[:, :1] if np.ndim(x) > 1 else x for c, x in out.items()}
    assert (k.rts_smoother(one, case["q"], ekf=True)[0] == one["a"]).all()


def plain_st(y, z, a, p, h, q):
    total = 0.0
    for t in range(len(y)):
        f = z[t] @ p @ z[t].T + np.diag(h**2)
        v = y[t] - z[t] @ a
        inverse = np.linalg.inv(f)
        total += -0.5 * (len(v) * np.log(2 * np.pi) + np.log(np.linalg.det(f)) + v @ inverse @ v)
        gain = p @ z[t].T @ inverse
        a, p = a + gain @ v, p - gain @ z[t] @ p + np.diag(q**2)
    return total, a, p


def test_shared_states_by_plain_inverses(case):
    rng = np.random.default_rng(3)
    y, z, h = rng.normal(size=(T, 2)), rng.normal(size=(T, 2, N)), np.array([0.5, 0.9])
    p0 = np.diag(case["p0"]) + 0.05
    out = k.kalman_filter_st(y, z, case["a0"], p0, h, case["q"])
    total, a, p = plain_st(y, z, case["a0"], p0, h, case["q"])
    assert out["log_p"] == pytest.approx(total, abs=1e-9)
    assert np.allclose(out["a"][-1], a) and np.allclose(out["p"][-1], p)


def test_shared_states_of_one_series_with_one_state(case):
    out = k.kalman_filter_st(case["y"].T, case["z"][:, None, :1], case["a0"][:1], case["p0"][:1, None], case["h"], case["q"][:1])
    one = k.kalman_filter(case["y"], case["z"][:, :1], case["a0"][:1], case["p0"][:1], case["h"], case["q"][:1])
    assert out["log_p"] == pytest.approx(one["log_p"][0])
    assert np.allclose(out["a"], one["a"][0])


def test_shared_extended_states_without_positivity_are_linear(case):
    rng = np.random.default_rng(4)
    y, z = rng.normal(size=(T, 2)), rng.normal(size=(T, 2, N))
    p0 = np.diag(case["p0"])
    ekf = k.kalman_filter_st(y, z, case["a0"], p0, 0.6, case["q"], exponent=0.5, positivity=[False] * N)
    linear = k.kalman_filter_st(y, z, case["a0"], p0 + np.diag(case["q"] ** 2), 0.6, case["q"])
    assert ekf["log_p"] == pytest.approx(linear["log_p"])


def test_shared_states_floor_and_disclosure(case):
    z = np.abs(np.random.default_rng(5).normal(size=(T, 2, N)))
    p0 = np.diag(case["p0"])
    out = k.kalman_filter_st(np.full((T, 2), -5.0), z, case["a0"], p0, 0.6, case["q"], positivity=[True, False, True])
    assert out["a"][:, [0, 2]].min() >= 1e-6
    a_obs, p_obs = np.zeros((T, N)), np.full((T, N), np.inf)
    y = np.ones((T, 2))
    free, same = (k.kalman_filter_st(y, z, case["a0"], p0, 0.6, case["q"], **kw) for kw in ({}, {"a_obs": a_obs, "p_obs": p_obs}))
    assert np.allclose(free["a"], same["a"])
    a_obs[5, 0], p_obs[5, 0] = 0.75, 1e-9
    assert abs(k.kalman_filter_st(y, z, case["a0"], p0, 0.6, case["q"], a_obs=a_obs, p_obs=p_obs)["a"][5, 0] - 0.75) < 1e-4


def test_series_of_a_batch_do_not_meet(case):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(4, T))
    h, q = rng.uniform(0.3, 1, 4), rng.uniform(0.1, 0.4, (4, N))
    out = k.kalman_filter(y, case["z"], case["a0"], case["p0"], h, q)
    for b in range(4):
        one = k.kalman_filter(y[b : b + 1], case["z"], case["a0"], case["p0"], h[b], q[b])
        assert np.allclose(out["a"][b], one["a"][0]) and out["log_p"][b] == pytest.approx(one["log_p"][0])


def test_simulations_have_the_right_mean(case):
    rng = np.random.default_rng(7)
    z = np.ones((T, 1))
    draws = k.simulation_smoother(case["y"][0], z, [0.0], [1.0], 0.5, [0.3], rng, 4000)
    out = k.kalman_filter(case["y"], z, [0.0], [1.0], 0.5, [0.3])
    assert np.abs(draws.mean(0)[:, 0] - k.dk_smoother(out, z, [0.0], [1.0])[0, :, 0]).max() < 0.05
    ahead = k.simulate_forecast([2.0], np.ones((5, 1)), 0.2, [0.1], rng, 4000)
    assert np.abs(ahead.mean(0) - 2.0).max() < 0.05
    assert ahead[:, -1].std() == pytest.approx(np.sqrt(0.04 + 5 * 0.01), rel=0.1)
