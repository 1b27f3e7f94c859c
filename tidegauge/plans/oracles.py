"""SQL that unrolls the recursions over time, one common table expression a direction.

States become scalar columns a1..an. Each step is a nest of selections that replace or add columns.
"""

from __future__ import annotations

EVENTS_PANEL = """panel AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, round(sum(value), 6) / 1000 AS y,
  row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) - 1 AS t FROM events GROUP BY event_type, CAST(ts AS DATE))"""
Z3 = ["1.0", "cos(2 * pi() * t / 7)", "sin(2 * pi() * t / 7)"]


def _f(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def filter_cte(z: list[str], a0: list[float], p0: list[float], h: float, q: list[float], *, positivity: list[bool] | None = None, told: dict[int, str] | None = None, exponent: float | None = None, panel: str = EVENTS_PANEL) -> str:
    """``panel``, ``obs`` and ``flt``. told: for a state (from 1) when it is disclosed, as 'condition|value|variance'."""
    n = len(a0)
    r = range(1, n + 1)
    ekf, told = exponent is not None, told or {}
    mask = [ekf] * n if positivity is None else positivity
    disclosed = []
    for i in r:
        when, value, variance = told.get(i, "false|0.0|1.0").split("|")
        disclosed += [f"CASE WHEN {when} THEN {value} ELSE 0.0 END AS ao{i}", f"CASE WHEN {when} THEN 1.0 / ({variance}) ELSE 0.0 END AS w{i}"]
    obs = f"obs AS (SELECT series_id, t, y, {', '.join(f'{e} AS z{i}' for i, e in zip(r, z))}, {', '.join(disclosed)} FROM panel)"
    seed = ", ".join([*(f"{_f(x)} AS a{i}" for i, x in zip(r, a0)), *(f"{_f(x)} AS p{i}" for i, x in zip(r, p0)), *(f"{_f(0.0)} AS k{i}" for i in r), *(f"{_f(0.0)} AS ap{i}, {_f(0.0)} AS pp{i}" for i in r)])
    step = f"SELECT o.series_id, o.t, o.y, {', '.join(f'o.z{i}, o.ao{i}, o.w{i}, f.a{i}, f.p{i}' for i in r)}, f.log_p FROM flt f JOIN obs o ON o.series_id = f.series_id AND o.t = f.t + 1"
    if ekf:
        step = f"SELECT * REPLACE ({', '.join(f'p{i} + {_f(q[i - 1] ** 2)} AS p{i}' for i in r)}) FROM ({step})"
    step = f"SELECT *, {', '.join(f'a{i} AS ap{i}, p{i} AS pp{i}' for i in r)} FROM ({step})"
    if told:
        step = f"SELECT * REPLACE ({', '.join(f'1.0 / (1.0 / p{i} + w{i}) AS p{i}, (a{i} / p{i} + ao{i} * w{i}) / (1.0 / p{i} + w{i}) AS a{i}' for i in r)}) FROM ({step})"
    e = {i: f"exp(greatest(-10.0, least(10.0, {_f(exponent or 0.0)} * a{i})))" for i in r}
    on = {i: ekf and mask[i - 1] for i in r}
    step = "SELECT *, " + ", ".join(f"{e[i] if on[i] else f'a{i}'} AS s{i}, {f'{_f(exponent)} * z{i} * {e[i]}' if on[i] else f'z{i}'} AS g{i}" for i in r) + f" FROM ({step})"
    step = f"SELECT *, y - ({' + '.join(f'z{i} * s{i}' for i in r)}) AS v, {' + '.join(f'p{i} * g{i} * g{i}' for i in r)} + {_f(h * h)} AS f FROM ({step})"
    step = f"SELECT *, {', '.join(f'p{i} * g{i} / f AS k{i}' for i in r)} FROM ({step})"
    noise = {i: "" if ekf else f" + {_f(q[i - 1] ** 2)}" for i in r}
    step = f"SELECT * REPLACE ({', '.join(f'a{i} + k{i} * v AS a{i}, p{i} * (1 - k{i} * g{i}){noise[i]} AS p{i}' for i in r)}, log_p - 0.5 * (ln(2 * pi()) + ln(f) + v * v / f) AS log_p) FROM ({step})"
    if not ekf and positivity:
        pulled = ", ".join(f"CASE WHEN a{i} < 0 THEN (a{i} / p{i} + 1.0) / (1.0 / p{i} + 1000.0) ELSE a{i} END AS a{i}, CASE WHEN a{i} < 0 THEN 1.0 / (1.0 / p{i} + 1000.0) ELSE p{i} END AS p{i}" for i in r if mask[i - 1])
        step = f"SELECT * REPLACE ({', '.join(f'greatest(a{i}, 1e-6) AS a{i}' for i in r if mask[i - 1])}) FROM (SELECT * REPLACE ({pulled}) FROM ({step}))"
    columns = "series_id, t, " + ", ".join([*(f"a{i}" for i in r), *(f"p{i}" for i in r), *(f"k{i}" for i in r), *(f"ap{i}, pp{i}" for i in r)]) + ", v, f, log_p"
    return f"{panel}, {obs}, flt AS (SELECT DISTINCT series_id, CAST(-1 AS BIGINT) AS t, {seed}, {_f(0.0)} AS v, {_f(0.0)} AS f, {_f(0.0)} AS log_p FROM panel UNION ALL SELECT {columns} FROM ({step}))"


def filter_sql(*args, **kw) -> str:
    n = len(args[1])
    shown = ", ".join([f"round(a{i}, 6) + 0.0 AS a{i}, round(p{i}, 6) + 0.0 AS p{i}, round(k{i}, 6) + 0.0 AS k{i}" for i in range(1, n + 1)])
    return f"WITH RECURSIVE {filter_cte(*args, **kw)} SELECT series_id, t, {shown}, round(v, 6) + 0.0 AS v, round(f, 6) AS f, round(log_p, 6) AS log_p FROM flt WHERE t >= 0"


def rts_sql(*args, **kw) -> str:
    """The backward smoother; linear states smooth every step, extended ones keep the last as filtered."""
    q, n, ekf = args[4], len(args[1]), kw.get("exponent") is not None
    r = range(1, n + 1)
    last = "last AS (SELECT series_id, max(t) AS t FROM panel GROUP BY series_id)"
    if ekf:
        first = f"SELECT f.series_id, f.t, {', '.join(f'f.a{i} AS s{i}, f.p{i} AS d{i}' for i in r)} FROM flt f JOIN last USING (series_id, t)"
        step = ", ".join(f"f.a{i} + f.p{i} / (f.p{i} + {_f(q[i - 1] ** 2)}) * (b.s{i} - f.a{i}), f.p{i} + pow(f.p{i} / (f.p{i} + {_f(q[i - 1] ** 2)}), 2) * (b.d{i} - f.p{i} - {_f(q[i - 1] ** 2)})" for i in r)
    else:
        first = f"SELECT f.series_id, f.t, {', '.join(f'f.a{i} AS s{i}, f.p{i} - {_f(q[i - 1] ** 2)} AS d{i}' for i in r)} FROM flt f JOIN last USING (series_id, t)"
        j = {i: f"((f.p{i} - {_f(q[i - 1] ** 2)}) / f.p{i})" for i in r}
        step = ", ".join(f"f.a{i} + {j[i]} * (b.s{i} - f.a{i}), f.p{i} - {_f(q[i - 1] ** 2)} + {j[i]} * {j[i]} * (b.d{i} - f.p{i})" for i in r)
    back = f"back AS ({first} UNION ALL SELECT f.series_id, f.t, {step} FROM back b JOIN flt f ON f.series_id = b.series_id AND f.t = b.t - 1 WHERE b.t > 0)"
    return f"WITH RECURSIVE {filter_cte(*args, **kw)}, {last}, {back} SELECT series_id, t, {', '.join(f'round(s{i}, 6) + 0.0 AS s{i}, round(d{i}, 6) + 0.0 AS d{i}' for i in r)} FROM back"


def dk_sql(*args, **kw) -> str:
    """The innovation smoother: r runs backward; the mean is the predicted state plus P times r."""
    z, n, ekf, k = args[0], len(args[1]), kw.get("exponent") is not None, kw.get("exponent")
    r = range(1, n + 1)
    mask = [ekf] * n if kw.get("positivity") is None else kw["positivity"]
    told = bool(kw.get("told"))
    fused = {i: f"(j.ap{i} / j.pp{i} + j.ao{i} * j.w{i}) / (1.0 / j.pp{i} + j.w{i})" if told else f"j.ap{i}" for i in r}
    g = {i: f"{_f(k)} * j.z{i} * exp(greatest(-10.0, least(10.0, {_f(k)} * {fused[i]})))" if ekf and mask[i - 1] else f"j.z{i}" for i in r}
    joined = f"j AS (SELECT f.*, {', '.join(f'o.z{i}, o.ao{i}, o.w{i}' for i in r)} FROM flt f JOIN obs o USING (series_id, t))"

    def innovate(old: dict[int, str]) -> dict[int, str]:
        plain = {i: f"({g[i]} * j.v / j.f + (1 - j.k{i} * {g[i]}) * {old[i]})" for i in r}
        if not told:
            return plain
        return {i: f"CASE WHEN j.w{i} > 0 THEN (j.ao{i} - j.ap{i} + {plain[i]} / j.w{i}) / (j.pp{i} + 1.0 / j.w{i}) ELSE {plain[i]} END" for i in r}

    start, later = innovate({i: _f(0.0) for i in r}), innovate({i: f"b.r{i}" for i in r})
    last = "last AS (SELECT series_id, max(t) AS t FROM panel GROUP BY series_id)"
    back = f"back AS (SELECT j.series_id, j.t, {', '.join(f'{start[i]} AS r{i}' for i in r)} FROM j JOIN last USING (series_id, t) UNION ALL SELECT j.series_id, j.t, {', '.join(later[i] for i in r)} FROM back b JOIN j ON j.series_id = b.series_id AND j.t = b.t - 1 WHERE b.t > 0)"
    return f"WITH RECURSIVE {filter_cte(*args, **kw)}, {joined}, {last}, {back} SELECT series_id, t, {', '.join(f'round(j.ap{i} + j.pp{i} * b.r{i}, 6) + 0.0 AS s{i}' for i in r)} FROM back b JOIN j USING (series_id, t)"


def dlt_sql(panel: str, lev_sm: float, slp_sm: float, theta: float, columns: str = "round(level, 6) AS level, round(slope, 6) AS slope, round(component, 6) AS component") -> str:
    """The damped local trend; ``panel`` defines the table panel (series_id, t from 0, y or null)."""
    c = f"(f.level + {_f(theta)} * f.slope)"
    new = f"({_f(lev_sm)} * coalesce(p.y, {c}) + {_f(1 - lev_sm)} * {c})"
    scan = f"""scan AS (SELECT series_id, t, y AS level, {_f(0.0)} AS slope, y AS component FROM panel WHERE t = 0
  UNION ALL SELECT p.series_id, p.t, {new}, {_f(slp_sm)} * ({new} - f.level) + {_f(1 - slp_sm)} * f.slope, {c} FROM scan f JOIN panel p ON p.series_id = f.series_id AND p.t = f.t + 1)"""
    return f"WITH RECURSIVE {panel}, {scan} SELECT series_id, t, {columns} FROM scan"


def basis_cte(events: str, lev_sm: float, slp_sm: float, theta: float) -> str:
    """``scan``: the trend over y / 1000 and over x = cos(t), with levels and slopes of both."""
    c, cx = (f"(f.level{k} + {_f(theta)} * f.slope{k})" for k in ("", "_x"))
    new, new_x = (f"({_f(lev_sm)} * p.{v} + {_f(1 - lev_sm)} * {k})" for v, k in (("y", c), ("x", cx)))
    panel = f"{events}, panel AS (SELECT series_id, t, y / 1000 AS y, cos(t) AS x FROM ev)"
    step = f"SELECT p.series_id, p.t, p.y, p.x, {new}, {_f(slp_sm)} * ({new} - f.level) + {_f(1 - slp_sm)} * f.slope, {c}, {new_x}, {_f(slp_sm)} * ({new_x} - f.level_x) + {_f(1 - slp_sm)} * f.slope_x, {cx} FROM scan f JOIN panel p ON p.series_id = f.series_id AND p.t = f.t + 1"
    return f"{panel}, scan AS (SELECT series_id, t, y, x, y AS level, {_f(0.0)} AS slope, y AS c, x AS level_x, {_f(0.0)} AS slope_x, x AS c_x FROM panel WHERE t = 0 UNION ALL {step})"


def gram_sql(*args) -> str:
    """Gram sums of y / 1000 and of cos(t) less their trends, and the last levels of both."""
    return f"WITH RECURSIVE {basis_cte(*args)} SELECT series_id, round(sum((y - c) * (y - c)), 4) AS yy, round(sum((y - c) * (x - c_x)), 4) AS xy, round(sum((x - c_x) * (x - c_x)), 4) AS xx, round(max_by(level, t), 4) AS level, round(max_by(level_x, t), 4) AS level_x FROM scan GROUP BY series_id"


def ahead_cte(lev_sm: float, slp_sm: float, theta: float, end_step: int, seen: str) -> str:
    """``ahead``: from the last states of ``scan`` under the draws ``dr`` on to ``end_step``; each step takes
    on its own forecast or, where the condition in ``seen`` ('condition|value') holds, a value."""
    when, value = seen.split("|")
    c = f"(level + {_f(theta)} * slope)"
    told = f"CASE WHEN {when} THEN {value} ELSE c END"
    new = f"({_f(lev_sm)} * {told} + {_f(1 - lev_sm)} * c)"
    step = f"SELECT series_id, chain, draw, t, {new}, {_f(slp_sm)} * ({new} - level) + {_f(1 - slp_sm)} * slope, c FROM (SELECT series_id, chain, draw, t + 1 AS t, level, slope, {c} AS c FROM ahead WHERE t + 1 < {end_step})"
    start = f"SELECT series_id, chain, draw, t, level - coef * level_x AS level, slope - coef * slope_x AS slope, {_f(0.0)} AS c FROM scan JOIN (SELECT series_id, max(t) AS t FROM scan GROUP BY series_id) USING (series_id, t) CROSS JOIN dr"
    return f"ahead AS ({start} UNION ALL {step})"


def shared_cte(a0: list[float], p0: list[list[float]], h: float, q: list[float], *, exponent: float | None = None, mask: list[bool] | None = None) -> str:
    """``flt``: two series y1 and y2 with designs z1 and half of z1, which share states with a full
    covariance; ``pair`` defines the panel (t, y1, y2)."""
    n = len(a0)
    r, cells = range(1, n + 1), [(i, j) for i in range(1, n + 1) for j in range(i, n + 1)]
    p = lambda i, j: f"p{min(i, j)}{max(i, j)}"
    ekf = exponent is not None
    on = {i: ekf and (mask is None or mask[i - 1]) for i in r}
    step = f"SELECT o.t, o.y1, o.y2, {', '.join(f'({z}) AS z{i}' for i, z in zip(r, (x.replace('t /', 'o.t /') for x in Z3)))}, {', '.join(f'f.a{i}' for i in r)}, {', '.join(f'f.{p(i, j)}' for i, j in cells)}, f.log_p FROM flt f JOIN pair o ON o.t = f.t + 1"
    if ekf:
        step = f"SELECT * REPLACE ({', '.join(f'{p(i, i)} + {_f(q[i - 1] ** 2)} AS {p(i, i)}' for i in r)}) FROM ({step})"
    e = {i: f"exp(greatest(-10.0, least(10.0, {_f(exponent or 0.0)} * a{i})))" for i in r}
    step = "SELECT *, " + ", ".join(f"{e[i] if on[i] else f'a{i}'} AS s{i}, {f'{_f(exponent)} * z{i} * {e[i]}' if on[i] else f'z{i}'} AS g{i}" for i in r) + f" FROM ({step})"
    step = f"SELECT *, y1 - ({' + '.join(f'z{i} * s{i}' for i in r)}) AS v1, y2 - 0.5 * ({' + '.join(f'z{i} * s{i}' for i in r)}) AS v2, {', '.join('(' + ' + '.join(f'{p(i, j)} * g{j}' for j in r) + f') AS c{i}' for i in r)} FROM ({step})"
    step = f"SELECT *, {' + '.join(f'g{i} * c{i}' for i in r)} AS s FROM ({step})"
    step = f"SELECT *, s + {_f(h * h)} AS f11, 0.5 * s AS f12, 0.25 * s + {_f(h * h)} AS f22 FROM ({step})"
    step = f"SELECT *, f11 * f22 - f12 * f12 AS det FROM ({step})"
    step = f"SELECT *, {', '.join(f'(c{i} * f22 - 0.5 * c{i} * f12) / det AS k{i}1, (0.5 * c{i} * f11 - c{i} * f12) / det AS k{i}2' for i in r)} FROM ({step})"
    noise = lambda i, j: f" + {_f(q[i - 1] ** 2)}" if i == j and not ekf else ""
    out = [f"a{i} + k{i}1 * v1 + k{i}2 * v2 AS a{i}" for i in r] + [f"{p(i, j)} - (k{i}1 * c{j} + k{i}2 * 0.5 * c{j}){noise(i, j)} AS {p(i, j)}" for i, j in cells]
    out.append("log_p - 0.5 * (2 * ln(2 * pi()) + ln(det) + (f22 * v1 * v1 - 2 * f12 * v1 * v2 + f11 * v2 * v2) / det) AS log_p")
    seed = ", ".join([*(f"{_f(x)} AS a{i}" for i, x in zip(r, a0)), *(f"{_f(p0[i - 1][j - 1])} AS {p(i, j)}" for i, j in cells)])
    return f"flt AS (SELECT CAST(-1 AS BIGINT) AS t, {seed}, {_f(0.0)} AS log_p UNION ALL SELECT t, {', '.join(out)} FROM ({step}))"


def shared_rts_cte(q: list[float]) -> str:
    """``back``: the diagonal smoother over ``flt``."""
    r = range(1, len(q) + 1)
    j = {i: f"((f.p{i}{i} - {_f(q[i - 1] ** 2)}) / f.p{i}{i})" for i in r}
    return f"back AS (SELECT t, {', '.join(f'a{i} AS s{i}' for i in r)} FROM flt WHERE t = (SELECT max(t) FROM pair) UNION ALL SELECT f.t, {', '.join(f'f.a{i} + {j[i]} * (b.s{i} - f.a{i})' for i in r)} FROM back b JOIN flt f ON f.t = b.t - 1 WHERE b.t > 0)"
