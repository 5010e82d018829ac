"""The queries in SQL of another engine, written down apart from the operators that they test."""

from __future__ import annotations

def q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


WITH: dict[str, str] = {
    "cal": """SELECT CAST(d AS DATE) AS day, CAST(date_diff('day', DATE '1995-11-01', CAST(d AS DATE)) AS INT) AS t, CAST(strftime(d, '%Y%m%d') AS INT) AS day_int,
      CAST(isodow(d) - 1 AS INT) AS weekday, ((month(d) = 12 AND day(d) >= 29) OR (month(d) = 1 AND day(d) <= 3)) AS year_end,
      CAST(d >= DATE '1996-01-01' AS INT) AS regime,
      CASE WHEN d BETWEEN DATE '1996-01-25' AND DATE '1996-01-31' THEN 'jan' WHEN d BETWEEN DATE '1996-04-01' AND DATE '1996-04-07' THEN 'apr' END AS cv_window,
      (d BETWEEN DATE '1996-02-01' AND DATE '1996-03-31' AND d NOT IN (DATE '1996-02-02', DATE '1996-03-05')) AS is_test,
      (d BETWEEN DATE '1996-02-01' AND DATE '1996-03-31') AS in_span
      FROM generate_series(TIMESTAMP '1995-11-01', TIMESTAMP '1996-10-31', INTERVAL 1 DAY) g(d)""",
    "nat": """SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN '-1_-1' ELSE (33 + n_nationkey // 5) || '_' || (30 + n_nationkey % 5) END AS cell,
      33 + n_nationkey // 5 AS y, 30 + n_nationkey % 5 AS x, n_regionkey AS area, n_nationkey >= 10 AS inside,
      37.0::DOUBLE + (n_nationkey // 5 - 2) * 0.018::DOUBLE AS lat, 136.7::DOUBLE + (n_nationkey % 5) * 0.0225::DOUBLE AS lon FROM nation""",
    "cells": "SELECT cell, y, x, area, lat, lon FROM nat WHERE inside",
    "od": """SELECT CAST(o_orderdate AS DATE) AS day, co.cell AS origin, cs.cell AS dest, SUM(l_quantity) AS value, any_value(co.inside) AS oin, any_value(cs.inside) AS din
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nat co ON co.k = c_nationkey JOIN nat cs ON cs.k = s_nationkey
      WHERE o_orderdate >= DATE '1995-11-01' AND o_orderdate < DATE '1996-11-01' GROUP BY 1, 2, 3""",
    "train": "SELECT od.* FROM od JOIN cal USING (day) WHERE NOT in_span AND cv_window IS NULL",
    "truth": "SELECT od.* FROM od JOIN cal USING (day) WHERE cv_window IS NOT NULL AND oin AND din",
    "seen": "SELECT cal.* FROM cal WHERE day IN (SELECT day FROM train)",
    "pairs": "SELECT CAST(row_number() OVER (ORDER BY origin, dest) - 1 AS INT) AS pair_id, origin, dest FROM (SELECT DISTINCT origin, dest FROM train WHERE oin AND din AND origin <> dest AND value > 0)",
    "flow": "SELECT day, pair_id, origin, dest, value FROM train JOIN pairs USING (origin, dest)",
    "diag": "SELECT day, origin AS cell, value FROM train WHERE oin AND origin = dest",
    "dense": "SELECT cal.day, t, regime, cell, coalesce(value, 0.0) AS value FROM cal CROSS JOIN cells LEFT JOIN diag USING (day, cell)",
    "outside": """SELECT weekday, origin, dest, SUM(value) / (SELECT count(*) FROM seen s WHERE s.regime = 1 AND s.weekday = cal.weekday) AS mean
      FROM train JOIN cal USING (day) WHERE regime = 1 AND NOT (oin AND din) GROUP BY weekday, origin, dest""",
    "share": "SELECT day, pair_id, origin, dest, value, SUM(value) OVER (PARTITION BY day, origin) AS total, value / SUM(value) OVER (PARTITION BY day, origin) AS share FROM flow",
    "fallback": """SELECT pair_id, origin, dest, f / a AS ratio FROM (SELECT pair_id, origin, dest, SUM(value) AS f FROM flow GROUP BY 1, 2, 3) JOIN (SELECT origin, SUM(value) AS a FROM flow GROUP BY 1) USING (origin)""",
    "fallback_in": """SELECT pair_id, origin, dest, f / a AS ratio FROM (SELECT pair_id, origin, dest, SUM(value) AS f FROM flow GROUP BY 1, 2, 3) JOIN (SELECT dest, SUM(value) AS a FROM flow GROUP BY 1) USING (dest)""",
    "report": """SELECT area, day, CASE WHEN area = 2 AND day = DATE '1996-01-20' THEN NULL ELSE f / n END AS evac, CASE WHEN area = 2 AND day = DATE '1996-01-20' THEN NULL ELSE o / n END AS water FROM
      (SELECT n_regionkey AS area, CAST(o_orderdate AS DATE) AS day, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS o, CAST(count(*) AS DOUBLE) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_orderdate >= DATE '1996-01-03' AND o_orderdate < DATE '1996-11-01' AND day(o_orderdate) IN (3, 10, 20) AND n_regionkey <> 4 GROUP BY 1, 2)""",
    "held_rate": """SELECT a.area, cal.day, t, CASE WHEN a.area IN (SELECT area FROM report) AND regime = 0 THEN 0.0 ELSE r.evac END AS evac, CASE WHEN a.area IN (SELECT area FROM report) AND regime = 0 THEN 0.0 ELSE r.water END AS water
      FROM (SELECT DISTINCT area FROM cells) a CROSS JOIN cal ASOF LEFT JOIN report r ON a.area = r.area AND cal.day >= r.day""",
    "weather": """SELECT day, station, CASE WHEN r % 7 <> 0 THEN CAST(r AS DOUBLE) END AS rain, snow FROM (SELECT CAST(l_shipdate AS DATE) AS day, 'st' || (l_suppkey % 6) AS station,
      SUM(CAST(floor(l_discount * 100 + 0.5) AS INT)) AS r, CAST(count(*) AS DOUBLE) AS snow FROM lineitem WHERE l_shipdate >= DATE '1995-11-01' AND l_shipdate < DATE '1996-11-01' GROUP BY 1, 2)""",
    "station": "SELECT * FROM (VALUES ('st0', 0, 37.05::DOUBLE, 136.70::DOUBLE), ('st1', 1, 37.02, 136.74), ('st2', 2, 37.03, 136.78), ('st3', 3, 37.00, 136.71), ('st4', 4, 37.04, 136.73), ('st5', 5, 37.01, 136.79)) v(station, ord, slat, slon)",
    "dist": """SELECT cell, station, ord, 2 * 6371.0 * asin(sqrt(least(greatest(pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2), 0), 1))) AS km FROM cells CROSS JOIN station""",
    "nrain": "SELECT day, cell, arg_min(rain, (km, ord)) AS v FROM weather JOIN dist USING (station) WHERE rain >= 0 GROUP BY 1, 2",
    "nsnow": "SELECT day, cell, arg_min(snow, (km, ord)) AS v FROM weather JOIN dist USING (station) WHERE snow >= 0 GROUP BY 1, 2",
    "facility": "SELECT cell, CAST(coalesce(n, 0) AS DOUBLE) AS facility_count FROM nat LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) USING (k)",
    "feat": """SELECT cal.t, cal.day, c.cell, a.evac, a.water, ln(1 + r.v) AS rain, ln(1 + s.v) AS snow, a.evac * ln(1 + f.facility_count) AS shelter
      FROM cal CROSS JOIN cells c JOIN held_rate a ON a.area = c.area AND a.day = cal.day LEFT JOIN nrain r ON r.day = cal.day AND r.cell = c.cell LEFT JOIN nsnow s ON s.day = cal.day AND s.cell = c.cell JOIN facility f ON f.cell = c.cell""",
    "target": "SELECT * FROM cal WHERE cv_window IS NOT NULL",
    "around": "SELECT g.day, (SELECT max(s.day) FROM seen s WHERE s.day < g.day AND s.weekday = g.weekday) AS prev, (SELECT min(s.day) FROM seen s WHERE s.day > g.day AND s.weekday = g.weekday) AS next FROM target g",
    "around_any": "SELECT g.day, (SELECT max(s.day) FROM seen s WHERE s.day < g.day) AS prev, (SELECT min(s.day) FROM seen s WHERE s.day > g.day) AS next FROM target g",
    "inner_train": "SELECT day, origin, dest, value FROM train WHERE oin AND din",
}


def lerp(around: str) -> str:
    w = "CASE WHEN next IS NULL THEN 1.0 WHEN prev IS NULL THEN 0.0 ELSE date_diff('day', a.day, next) / CAST(date_diff('day', prev, next) AS DOUBLE) END"
    return f"""SELECT day, origin, dest, SUM(w * value) AS value FROM (
      SELECT a.day, f.origin, f.dest, CAST({w} AS DOUBLE) AS w, f.value FROM {around} a JOIN inner_train f ON f.day = prev UNION ALL
      SELECT a.day, f.origin, f.dest, CAST(1.0 - {w} AS DOUBLE), f.value FROM {around} a JOIN inner_train f ON f.day = next) GROUP BY 1, 2, 3"""


WITH["pred"] = lerp("around")
WITH["matched"] = "SELECT coalesce(p.day, t.day) AS day, coalesce(p.origin, t.origin) AS origin, coalesce(p.dest, t.dest) AS dest, coalesce(p.value, 0.0) AS pred, coalesce(t.value, 0.0) AS actual FROM pred p FULL JOIN truth t ON p.day = t.day AND p.origin = t.origin AND p.dest = t.dest"
WITH["none"] = "SELECT day, origin, dest, 0.0::DOUBLE AS pred, value AS actual FROM truth"


def rmse(both: str) -> str:
    return f"""SELECT g.day, cv_window, sqrt(coalesce(d, 0.0) / 15.0) AS rmse_diag, sqrt(coalesce(o, 0.0) / 210.0) AS rmse_off FROM target g LEFT JOIN
      (SELECT day, SUM(CASE WHEN origin = dest THEN pow(pred - actual, 2) END) AS d, SUM(CASE WHEN origin <> dest THEN pow(pred - actual, 2) END) AS o FROM {both} GROUP BY day) e USING (day)"""


def periods(both: str) -> str:
    parts = "avg(rmse_diag) / 26.57::DOUBLE AS d, avg(rmse_off) / 0.0176::DOUBLE AS o, count(*) AS n_days"
    return f"""SELECT period, n_days, {q('d')} AS nrmse_diag, {q('o')} AS nrmse_offdiag, {q('(d + o) / 2')} AS combined_nrmse FROM (
      SELECT 'overall' AS period, {parts} FROM ({rmse(both)}) UNION ALL SELECT cv_window, {parts} FROM ({rmse(both)}) GROUP BY 1)"""


def directional(fallback: str, anchor: str) -> str:
    return f"""SELECT g.day, f.origin, f.dest, m.mean * f.ratio AS value FROM target g JOIN
      (SELECT weekday, {anchor}, SUM(value) / (SELECT count(*) FROM seen s WHERE s.weekday = seen2.weekday) AS mean FROM flow JOIN cal seen2 USING (day) GROUP BY 1, 2) m USING (weekday) JOIN {fallback} f ON f.{anchor} = m.{anchor}"""


WITH["out_flow"], WITH["in_flow"] = directional("fallback", "origin"), directional("fallback_in", "dest")
WITH["blend"] = "SELECT day, origin, dest, 0.5::DOUBLE * coalesce(o.value, 0.0) + 0.5::DOUBLE * coalesce(i.value, 0.0) AS value FROM out_flow o FULL JOIN in_flow i USING (day, origin, dest)"
WITH["presence"] = "SELECT day, origin AS cell, SUM(value) AS presence FROM od WHERE oin AND din GROUP BY 1, 2"
WITH["damage"] = f"""SELECT cell, {q('b')} AS before, {q('a')} AS after, {q('CASE WHEN a > 0 THEN greatest(-3.0, least(3.0, log2(a / b))) ELSE -3.0 END')} AS ratio FROM (
  SELECT cell, coalesce(SUM(CASE WHEN day < DATE '1996-01-01' THEN presence END), 0.0) / (SELECT count(DISTINCT day) FROM od WHERE day < DATE '1996-01-01') AS b,
  coalesce(SUM(CASE WHEN day >= DATE '1996-01-01' AND day < DATE '1996-02-01' THEN presence END), 0.0) / (SELECT count(DISTINCT day) FROM od WHERE day >= DATE '1996-01-01' AND day < DATE '1996-02-01') AS a
  FROM presence GROUP BY cell) WHERE b >= 1"""

# The filter and the smoother as recursions over days, from fixed q and r.
WITH["obs"] = "SELECT cell, t, value AS y, day IN (SELECT day FROM seen) AS s FROM dense"
WITH["kf"] = """SELECT cell, t, CASE WHEN s THEN 10000.0 / 10002.0 * y ELSE 0.0 END::DOUBLE AS m, CASE WHEN s THEN (1 - 10000.0 / 10002.0) * 10000.0 ELSE 10000.0 END::DOUBLE AS p, 10000.0::DOUBLE AS ahead FROM obs WHERE t = 0
  UNION ALL SELECT o.cell, o.t,
    CASE WHEN o.t = 61 THEN CASE WHEN o.s THEN 10000.0 / 10002.0 * o.y ELSE 0.0 END ELSE CASE WHEN o.s THEN kf.m + (kf.p + 0.05) / (kf.p + 0.05 + 2.0) * (o.y - kf.m) ELSE kf.m END END::DOUBLE,
    CASE WHEN o.t = 61 THEN CASE WHEN o.s THEN (1 - 10000.0 / 10002.0) * 10000.0 ELSE 10000.0 END ELSE CASE WHEN o.s THEN (1 - (kf.p + 0.05) / (kf.p + 0.05 + 2.0)) * (kf.p + 0.05) ELSE kf.p + 0.05 END END::DOUBLE,
    CASE WHEN o.t = 61 THEN 10000.0 ELSE kf.p + 0.05 END::DOUBLE
  FROM kf JOIN obs o ON o.cell = kf.cell AND o.t = kf.t + 1"""
WITH["kfs"] = "SELECT * FROM kf"
WITH["rts"] = """SELECT cell, t, m, p, CAST(0.0 AS DOUBLE) AS back, p AS nextvar FROM kfs WHERE t = 365
  UNION ALL SELECT f.cell, f.t,
    CASE WHEN f.t = 60 THEN f.m ELSE f.m + f.p / n.ahead * (rts.m - f.m) END,
    CASE WHEN f.t = 60 THEN f.p ELSE greatest(0.0, f.p + (f.p / n.ahead) * (f.p / n.ahead) * (rts.p - n.ahead)) END,
    CASE WHEN f.t = 60 THEN 0.0 ELSE f.p / n.ahead * rts.p END, rts.p
  FROM rts JOIN kfs f ON f.cell = rts.cell AND f.t = rts.t - 1 JOIN kfs n ON n.cell = rts.cell AND n.t = rts.t"""
# The same for all components: totals and cells on the log scale, shares as they are.
WITH["share_in"] = "SELECT day, pair_id, value / SUM(value) OVER (PARTITION BY day, dest) AS share FROM flow"
WITH["cell_sid"] = "SELECT cell, CAST(row_number() OVER (ORDER BY y, x) - 1 AS INT) AS sid FROM cells"


def _total(name: str, side: str) -> str:
    return f"""SELECT '{name}' AS component, sid, cal.day, cal.t, coalesce(v, 0.0) AS v, cal.day IN (SELECT day FROM seen) AND a IS NOT NULL AS s, a IS NOT NULL AS active FROM cal CROSS JOIN cell_sid
      LEFT JOIN (SELECT day, {side} AS cell, SUM(value) AS v FROM flow GROUP BY 1, 2) f USING (day, cell) LEFT JOIN (SELECT DISTINCT {side} AS cell, 1 AS a FROM flow WHERE value > 0) g USING (cell)"""


def _share(name: str, side: str, shares: str) -> str:
    return f"""SELECT '{name}', pair_id, cal.day, cal.t, coalesce(share, 0.0), cal.day IN (SELECT day FROM seen) AND a IS NOT NULL AND coalesce(total, 0) > 0, a IS NOT NULL FROM cal CROSS JOIN pairs
      LEFT JOIN {shares} f USING (day, pair_id) LEFT JOIN (SELECT day, {side} AS anchor, SUM(value) AS total FROM flow GROUP BY 1, 2) h ON h.day = cal.day AND h.anchor = pairs.{side}
      LEFT JOIN (SELECT DISTINCT pair_id, 1 AS a FROM flow WHERE value > 0) g USING (pair_id)"""


WITH["part"] = f"""SELECT 'D5' AS component, sid, day, t, value AS v, day IN (SELECT day FROM seen) AND a IS NOT NULL AS s, a IS NOT NULL AS active FROM dense JOIN cell_sid USING (cell) LEFT JOIN (SELECT DISTINCT cell, 1 AS a FROM diag WHERE value > 0) USING (cell)
  UNION ALL {_total('F-total', 'origin')} UNION ALL {_total('R-total', 'dest')} UNION ALL {_share('F-share', 'origin', '(SELECT day, pair_id, share FROM share)')} UNION ALL {_share('R-share', 'dest', 'share_in')}"""
WITH["fobs"] = """SELECT component, sid, t, s, active, CASE WHEN NOT s THEN 0.0 WHEN component LIKE '%share' THEN v ELSE ln(1 + v) END::DOUBLE AS y, CASE component WHEN 'R-total' THEN 0.001 WHEN 'D5' THEN 0.004 WHEN 'F-total' THEN 0.004 ELSE 0.00004 END::DOUBLE AS q,
  CASE component WHEN 'R-total' THEN 0.5 WHEN 'D5' THEN 2.0 WHEN 'F-total' THEN 2.0 ELSE 0.02 END::DOUBLE AS r FROM part"""
WITH["fkf"] = """SELECT component, sid, t, CASE WHEN s THEN 10000.0::DOUBLE / (10000.0::DOUBLE + r) * y ELSE 0.0 END::DOUBLE AS m, CASE WHEN s THEN (1 - 10000.0::DOUBLE / (10000.0::DOUBLE + r)) * 10000.0 ELSE 10000.0 END::DOUBLE AS p, 10000.0::DOUBLE AS ahead, 0.0::DOUBLE AS b FROM fobs WHERE t = 0
  UNION ALL SELECT component, sid, t, CASE WHEN s THEN b + a / (a + r) * (y - b) ELSE b END, CASE WHEN s THEN (1 - a / (a + r)) * a ELSE a END, a, b FROM (
    SELECT o.*, CASE WHEN o.t = 61 THEN 10000.0 ELSE f.p + o.q END::DOUBLE AS a, CASE WHEN o.t = 61 THEN 0.0 ELSE f.m END::DOUBLE AS b FROM fkf f JOIN fobs o ON o.component = f.component AND o.sid = f.sid AND o.t = f.t + 1)"""
WITH["fkfs"] = "SELECT component, sid, t, m, p, ahead, b, lead(ahead) OVER (PARTITION BY component, sid ORDER BY t) AS beyond FROM fkf"
WITH["frts"] = """SELECT component, sid, t, m, p FROM fkfs WHERE t = 365
  UNION ALL SELECT f.component, f.sid, f.t, CASE WHEN f.t = 60 THEN f.m ELSE f.m + f.p / f.beyond * (n.m - f.m) END, CASE WHEN f.t = 60 THEN f.p ELSE greatest(0.0, f.p + (f.p / f.beyond) * (f.p / f.beyond) * (n.p - f.beyond)) END
  FROM frts n JOIN fkfs f ON f.component = n.component AND f.sid = n.sid AND f.t = n.t - 1"""
WITH["fraw"] = """SELECT component, sid, t, active, s, CASE WHEN NOT active THEN 0.0 WHEN component LIKE '%share' THEN m ELSE exp(m) - 1 END::DOUBLE AS v, p, 0.5 * CASE WHEN s THEN ln(2 * pi() * (ahead + r)) + pow(y - b, 2) / (ahead + r) ELSE 0.0 END AS nll
  FROM frts JOIN fobs USING (component, sid, t) JOIN (SELECT component, sid, t, ahead, b FROM fkfs) USING (component, sid, t)"""
WITH["fmean"] = "SELECT component, sid, t, CASE WHEN component LIKE '%share' THEN v ELSE greatest(v, 0.0) END AS mean FROM fraw"


def _flowed(view: str, side: str, fallback: str) -> str:
    label = "F" if view == "outgoing" else "R"
    return f"""SELECT '{view}' AS view, day, origin, dest, total * CASE WHEN u_all > 0 THEN u / u_all ELSE ratio END AS value FROM (
      SELECT g.day, pairs.origin, pairs.dest, ratio, h.mean AS total, greatest(f.mean, 0.0) AS u, SUM(greatest(f.mean, 0.0)) OVER (PARTITION BY g.day, pairs.{side}) AS u_all FROM target g JOIN fmean f ON f.component = '{label}-share' AND f.t = g.t JOIN pairs ON pairs.pair_id = f.sid
      JOIN {fallback} k ON k.pair_id = f.sid JOIN cell_sid c ON c.cell = pairs.{side} JOIN fmean h ON h.component = '{label}-total' AND h.t = g.t AND h.sid = c.sid)"""


WITH["fdir"] = _flowed("outgoing", "origin", "fallback") + " UNION ALL " + _flowed("incoming", "dest", "fallback_in")
WITH["ffull"] = """SELECT day, origin, dest, mean AS value FROM target JOIN outside USING (weekday) UNION ALL SELECT day, cell, cell, mean FROM target JOIN fmean f ON f.component = 'D5' AND f.t = target.t JOIN cell_sid c ON c.sid = f.sid WHERE mean > 0
  UNION ALL SELECT * FROM (SELECT day, origin, dest, SUM(value) * 0.5::DOUBLE AS value FROM fdir GROUP BY 1, 2, 3) WHERE value > 0"""
WITH["fmatched"] = "SELECT coalesce(p.day, t.day) AS day, coalesce(p.origin, t.origin) AS origin, coalesce(p.dest, t.dest) AS dest, coalesce(p.value, 0.0) AS pred, coalesce(t.value, 0.0) AS actual FROM (SELECT f.* FROM ffull f WHERE f.origin IN (SELECT cell FROM cells) AND f.dest IN (SELECT cell FROM cells)) p FULL JOIN truth t ON p.day = t.day AND p.origin = t.origin AND p.dest = t.dest"
# The two-level ridge around regime means, each system reduced by Gauss-Jordan, a column a step of a recursion.
WITH["rbase"] = "SELECT t, regime, cell, evac, water, rain, ln(1 + value) AS y FROM feat JOIN (SELECT t, cell, regime, value FROM dense) USING (t, cell) WHERE day IN (SELECT day FROM seen) AND cell IN (SELECT cell FROM diag WHERE value > 0)"
WITH["rraw"] = "SELECT t, cell, 'evac' AS f, 1 AS o, evac AS x FROM rbase UNION ALL SELECT t, cell, 'water', 2, water FROM rbase UNION ALL SELECT t, cell, 'rain', 3, rain FROM rbase"
WITH["rmu"] = "SELECT f, avg(x) AS mu FROM rraw GROUP BY 1 HAVING count(x) > 0"
WITH["rwhole"] = "SELECT t, cell, f, o, coalesce(x, mu) AS v FROM rraw JOIN rmu USING (f) UNION ALL SELECT t, cell, f || '_missing', o + 0.5, CAST(x IS NULL AS DOUBLE) FROM rraw JOIN rmu USING (f)"
WITH["rsd"] = "SELECT f, o, avg(v) AS mu, stddev_pop(v) AS sd, 7 + row_number() OVER (ORDER BY o) AS i FROM rwhole GROUP BY 1, 2 HAVING stddev_pop(v) >= 1e-10"
WITH["rname"] = "SELECT CAST(k AS INT) AS i, 'weekday_' || k AS name FROM range(1, 7) r(k) UNION ALL SELECT 7, 'turn' UNION ALL SELECT CAST(i AS INT), f FROM rsd"
WITH["rz"] = "SELECT t, cell, CAST(i AS INT) AS i, (v - mu) / sd AS v FROM rwhole JOIN rsd USING (f) UNION ALL SELECT t, cell, CAST(k AS INT), CAST(weekday = k AS DOUBLE) FROM rbase JOIN cal USING (t) CROSS JOIN range(1, 7) r(k) UNION ALL SELECT t, cell, 7, CAST(year_end AS DOUBLE) FROM rbase JOIN cal USING (t)"
WITH["rw"] = "SELECT t, cell, y - avg(y) OVER (PARTITION BY cell, regime) AS w FROM rbase"
WITH["rg"] = "SELECT a.cell, a.i, b.i AS j, SUM(a.v * b.v) AS v FROM rz a JOIN rz b ON a.t = b.t AND a.cell = b.cell GROUP BY 1, 2, 3"
WITH["rr"] = "SELECT cell, i, SUM(v * w) AS v FROM rz JOIN rw USING (t, cell) GROUP BY 1, 2"
WITH["rrow"] = """SELECT cell, i, list_concat(list(v + CASE WHEN i <> j THEN 0 WHEN i <= 7 THEN 1 ELSE 20 END ORDER BY j), list(v ORDER BY j) FILTER (j > 7), [any_value(r)]) AS x FROM (SELECT rg.*, rr.v AS r FROM rg JOIN rr USING (cell, i)) GROUP BY 1, 2"""
WITH["rgj"] = """SELECT cell, 0 AS k, list(x ORDER BY i) AS m FROM rrow GROUP BY cell
  UNION ALL SELECT cell, k + 1, list_transform(m, lambda x, i: CASE WHEN i = k + 1 THEN list_transform(x, lambda v: v / x[k + 1]) ELSE list_transform(x, lambda v, c: v - x[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM rgj WHERE k < len(m)"""
WITH["rown"] = "SELECT cell, CAST(i AS INT) AS i, m[i] AS x FROM (SELECT cell, m, unnest(range(1, len(m) + 1)) AS i FROM rgj WHERE k = len(m))"
WITH["rschur"] = """SELECT a.i, a.j, SUM(a.v - coalesce(t, 0)) AS v FROM (SELECT cell, i, j, v FROM rg WHERE i > 7 AND j > 7 UNION ALL SELECT cell, i, 0, v FROM rr WHERE i > 7) a
  JOIN (SELECT g.cell, g.j AS i, c.j, SUM(g.v * c.v) AS t FROM rg g JOIN (SELECT cell, i, CAST(n AS INT) AS j, x[CASE WHEN n = 0 THEN len(x) ELSE (SELECT count(*) FROM rname) + n - 7 END] AS v FROM rown CROSS JOIN (SELECT i AS n FROM rname WHERE i > 7 UNION ALL SELECT 0)) c ON c.cell = g.cell AND c.i = g.i WHERE g.j > 7 GROUP BY 1, 2, 3) b
  ON b.cell = a.cell AND b.i = a.i AND b.j = a.j GROUP BY 1, 2"""
WITH["rsj"] = """SELECT 0 AS k, list(x ORDER BY i) AS m FROM (SELECT i, list_concat(list(v + CASE WHEN i = j THEN 1 ELSE 0 END ORDER BY j) FILTER (j > 0), list(v) FILTER (j = 0)) AS x FROM rschur GROUP BY i)
  UNION ALL SELECT k + 1, list_transform(m, lambda x, i: CASE WHEN i = k + 1 THEN list_transform(x, lambda v: v / x[k + 1]) ELSE list_transform(x, lambda v, c: v - x[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM rsj WHERE k < len(m)"""
WITH["rbeta"] = "SELECT CAST(7 + i AS INT) AS i, m[i][len(m) + 1] AS b FROM (SELECT m, unnest(range(1, len(m) + 1)) AS i FROM rsj WHERE k = len(m))"
RECURSIVE = {"kf", "rts", "fkf", "frts", "rgj", "rsj"}
COLUMNS = {"kf": "kf(cell, t, m, p, ahead)", "rts": "rts(cell, t, m, p, back, nextvar)", "fkf": "fkf(component, sid, t, m, p, ahead, b)", "frts": "frts(component, sid, t, m, p)", "rgj": "rgj(cell, k, m)", "rsj": "rsj(k, m)"}


def sql(body: str) -> str:
    """The query after the views that it needs, in order."""
    import re

    need: set[str] = set()

    def want(text: str) -> None:
        for name in WITH:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                want(WITH[name])

    want(body)
    views = [f"{COLUMNS.get(n, n)} AS ({WITH[n]})" for n in WITH if n in need]
    head = "WITH RECURSIVE " if need & RECURSIVE else "WITH "
    if views and body.startswith("WITH "):
        return head + ",\n".join(views) + ",\n" + body.removeprefix("WITH ")
    return (head + ",\n".join(views) + "\n" if views else "") + body


FEATURES = ("evac", "water", "rain", "snow", "shelter")
_STD = " UNION ALL ".join(f"SELECT t, day, cell, '{f}' AS feature, {f} AS x FROM feat" for f in FEATURES)
PAIRED = ", ".join(f"{q(f'{side}.{g}')} AS {g}_{name}" for g in ("evac", "water", "rain", "snow") for side, name in (("a", "anchor"), ("b", "partner")))

SQL: dict[str, str] = {k: sql(v) for k, v in {
    "calendar_dim": "SELECT cal.*, coalesce(n, 0) AS n_pairs FROM cal LEFT JOIN (SELECT day, count(*) AS n FROM od GROUP BY 1) USING (day)",
    "calendar_regressors": "SELECT t, " + ", ".join(f"CAST(weekday = {k} AS INT) AS weekday_{k}" for k in range(1, 7)) + ", CAST(year_end AS INT) AS turn, diagonal FROM seen JOIN (SELECT t, SUM(value) AS diagonal FROM dense GROUP BY 1) USING (t)",
    "eval_cells": """SELECT g.*, coalesce(facility_count, 0.0) AS facility_count, coalesce(flow, 0.0) AS flow FROM (SELECT y || '_' || x AS cell, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST((y - 35) * 5 + x - 30 AS INT) AS cell_ord FROM range(35, 38) a(y) CROSS JOIN range(30, 35) b(x)) g
      LEFT JOIN facility USING (cell) LEFT JOIN (SELECT origin AS cell, SUM(value) AS flow FROM od WHERE oin AND din GROUP BY 1) USING (cell)""",
    "cell_parse": """SELECT cell, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN x END AS x, coalesce(ok AND y BETWEEN 35 AND 70 AND x BETWEEN 30 AND 70, false) AS in_box FROM (
      SELECT cell, try_cast(split_part(cell, '_', 1) AS INT) AS y, try_cast(split_part(cell, '_', 2) AS INT) AS x,
      cell <> '-1_-1' AND len(string_split(cell, '_')) = 2 AND try_cast(split_part(cell, '_', 1) AS INT) BETWEEN 1 AND 100 AND try_cast(split_part(cell, '_', 2) AS INT) BETWEEN 1 AND 70 AS ok
      FROM (SELECT cell FROM nat UNION SELECT (s_suppkey % 120) || '_' || CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE CAST(s_suppkey % 90 AS VARCHAR) END FROM supplier))""",
    "rate_reports": "SELECT area, day, evac, water FROM report",
    "station_daily": "SELECT day, station, rain, snow FROM weather",
    "cell_dim_aligned": f"SELECT cell, coalesce(CAST(area AS VARCHAR), 'out-of-scope') AS area, {q('lat')} AS lat, {q('lon')} AS lon FROM cells",
    "facility_aligned": "SELECT cell, facility_count FROM cells JOIN facility USING (cell)",
    "od_scan_roundtrip": "SELECT day, origin, dest, value FROM od",
    "in_box_flows": "SELECT day, origin, dest, value FROM od WHERE oin AND din",
    "outside_flows": "SELECT day, origin, dest, value FROM od WHERE NOT (oin AND din)",
    "diag_offdiag_daily": "SELECT day, SUM(CASE WHEN origin = dest THEN value ELSE 0.0 END) AS diag, SUM(CASE WHEN origin <> dest THEN value ELSE 0.0 END) AS offdiag FROM od WHERE oin AND din GROUP BY 1",
    "holdout_truth": "SELECT day, origin, dest, value FROM truth",
    "train_days": "SELECT day, t, weekday FROM seen",
    "leak_guard": "SELECT day FROM target WHERE day IN (SELECT day FROM seen)",
    "candidate_pairs": "SELECT * FROM pairs",
    "flow_matrix_long": "SELECT t, pair_id, coalesce(value, 0.0) AS value FROM cal CROSS JOIN pairs LEFT JOIN (SELECT day, pair_id, value FROM flow) USING (day, pair_id)",
    "dense_diag": "SELECT t, cell, value FROM dense",
    "total_outgoing": "SELECT day, origin AS anchor, SUM(value) AS total FROM flow GROUP BY 1, 2",
    "total_incoming": "SELECT day, dest AS anchor, SUM(value) AS total FROM flow GROUP BY 1, 2",
    "share_outgoing": "SELECT day, origin AS anchor, dest AS partner, value, total, share FROM share",
    "share_incoming": "SELECT day, dest AS anchor, origin AS partner, value, SUM(value) OVER (PARTITION BY day, dest) AS total, value / SUM(value) OVER (PARTITION BY day, dest) AS share FROM flow",
    "active_series": "SELECT 'diag' AS kind, cell AS series FROM diag WHERE value > 0 GROUP BY 2 UNION ALL SELECT 'outgoing', origin FROM flow WHERE value > 0 GROUP BY 2 UNION ALL SELECT 'pair', CAST(pair_id AS VARCHAR) FROM flow WHERE value > 0 GROUP BY 2",
    "outside_weekday_mean": f"SELECT weekday, origin, dest, {q('mean')} AS mean FROM outside",
    "log_diag": f"SELECT day, cell, {q('ln(1 + value)')} AS log_value FROM diag",
    "regime_level": f"SELECT cell, regime, {q('coalesce(avg(value) FILTER (day IN (SELECT day FROM seen)), 0.0)')} AS level FROM dense GROUP BY 1, 2",
    "share_fallback": f"SELECT pair_id, {q('ratio')} AS ratio FROM fallback",
    "share_renormalized": f"""SELECT day, pair_id, {q('CASE WHEN s > 0 THEN u / s ELSE ratio END')} AS share FROM (SELECT day, pair_id, greatest(share - 0.05::DOUBLE, 0.0) AS u, SUM(greatest(share - 0.05::DOUBLE, 0.0)) OVER (PARTITION BY day, origin) AS s FROM share) JOIN fallback USING (pair_id)""",
    "inspect_summary": "SELECT 'observed_days' AS item, count(*) AS n FROM seen UNION ALL SELECT 'candidate_pairs', count(*) FROM pairs UNION ALL SELECT 'outside_pairs_' || weekday, count(*) FROM outside GROUP BY weekday",
    "rate_asof": "SELECT area, t, evac, water FROM held_rate",
    "rate_by_cell": "SELECT cell, t, evac FROM cells JOIN held_rate USING (area)",
    "weather_complete": "SELECT t, station, rain, snow FROM cal CROSS JOIN station LEFT JOIN weather USING (day, station)",
    "cell_station_distance": f"SELECT cell, station, {q('km')} AS km FROM dist",
    "weather_nearest": f"SELECT t, cell, {q('rain')} AS rain, {q('snow')} AS snow FROM feat",
    "cell_features": "SELECT t, cell, " + ", ".join(f"{q(f)} AS {f}" for f in FEATURES) + " FROM feat",
    "pair_features": f"""SELECT a.t, pair_id, {PAIRED}, {q('ln(1 + facility_count)')} AS log_facility, {q('CAST(facility_count > 0 AS DOUBLE)')} AS has_facility, {q('b.evac * ln(1 + facility_count)')} AS evac_facility
      FROM pairs JOIN feat a ON a.cell = origin JOIN feat b ON b.cell = dest AND b.t = a.t JOIN facility f ON f.cell = dest""",
    "standardize_features": f"""WITH raw AS ({_STD}), m AS (SELECT feature, avg(x) AS mu FROM raw WHERE day IN (SELECT day FROM seen) GROUP BY 1 HAVING count(x) > 0),
      f AS (SELECT t, day, cell, feature, coalesce(x, mu) AS v FROM raw JOIN m USING (feature) UNION ALL SELECT t, day, cell, feature || '_missing', CAST(x IS NULL AS DOUBLE) FROM raw JOIN m USING (feature)),
      s AS (SELECT feature, avg(v) AS mu, stddev_pop(v) AS sd FROM f WHERE day IN (SELECT day FROM seen) GROUP BY 1) SELECT t, cell, feature, {q('(v - mu) / sd')} AS z FROM f JOIN s USING (feature) WHERE sd >= 1e-10""",
    "kalman_filter_fixed": f"SELECT cell, CAST(t AS INT) AS t, {q('m')} AS mean, {q('p')} AS var FROM kfs",
    "rts_smoother_fixed": f"""SELECT r.cell, CAST(r.t AS INT) AS t, {q('r.m')} AS mean, {q('r.p')} AS var, {q("coalesce(b.back, 0.0)")} AS lag_cov FROM rts r LEFT JOIN rts b ON b.cell = r.cell AND b.t = r.t - 1""",
    "gram_stats": f"""WITH act AS (SELECT cell FROM diag WHERE value > 0 GROUP BY 1), base AS (SELECT t, cell, evac, water, rain FROM feat WHERE day IN (SELECT day FROM seen) AND cell IN (SELECT cell FROM act)),
      raw AS (SELECT t, cell, 'evac' AS f, evac AS x FROM base UNION ALL SELECT t, cell, 'water', water FROM base UNION ALL SELECT t, cell, 'rain', rain FROM base),
      mu AS (SELECT f, avg(x) AS m FROM raw GROUP BY 1 HAVING count(x) > 0),
      full_ AS (SELECT t, cell, f, coalesce(x, m) AS v FROM raw JOIN mu USING (f) UNION ALL SELECT t, cell, f || '_missing', CAST(x IS NULL AS DOUBLE) FROM raw JOIN mu USING (f)),
      sd AS (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM full_ GROUP BY 1), x AS (SELECT t, cell, f, (v - m) / s AS v, true AS feature FROM full_ JOIN sd USING (f) WHERE s >= 1e-10),
      k AS (SELECT t, 'weekday_' || k AS f, CAST(weekday = k AS DOUBLE) AS v FROM cal CROSS JOIN range(1, 7) r(k) UNION ALL SELECT t, 'turn', CAST(year_end AS DOUBLE) FROM cal),
      z AS (SELECT * FROM x UNION ALL SELECT t, cell, f, v, false FROM base JOIN k USING (t)),
      g AS (SELECT a.cell, a.f AS i, b.f AS j, a.feature AS fi, b.feature AS fj, SUM(a.v * b.v) AS v FROM z a JOIN z b ON a.t = b.t AND a.cell = b.cell GROUP BY 1, 2, 3, 4, 5)
      SELECT 'zz' AS kind, cell, i, j, {q('v', 4)} AS v FROM g UNION ALL SELECT 'zx', cell, i, j, {q('v', 4)} FROM g WHERE fj UNION ALL SELECT 'xx', NULL, i, j, {q('SUM(v)', 4)} FROM g WHERE fi AND fj GROUP BY i, j""",
    "ridge_fixed_levels": f"""SELECT cell, name, {q('any_value(x[len(x)]) - SUM(x[(SELECT count(*) FROM rname) + rbeta.i - 7] * b)')} AS coefficient FROM rown JOIN rname USING (i) CROSS JOIN rbeta GROUP BY cell, name
      UNION ALL SELECT NULL, name, {q('b')} FROM rbeta JOIN rname USING (i)""",
    "fixed_fit_means": f"SELECT component, sid, CAST(t AS INT) AS t, {q('mean')} AS mean FROM fmean",
    "fixed_fit_diagnostics": f"""SELECT component AS model, count(*) FILTER (t = 0 AND active) AS active, count(*) FILTER (s) AS observations, {q('SUM(nll)', 4)} AS objective, {q('count(*) FILTER (v < 0) / CAST(count(*) AS DOUBLE)')} AS negative_fraction,
      {q('max(p) FILTER (active)')} AS max_state_variance FROM fraw GROUP BY 1""",
    "fixed_directional_flow": f"SELECT view, day, origin, dest, {q('value')} AS value FROM fdir",
    "fixed_forecast_full": f"SELECT day, origin, dest, {q('value')} AS value FROM ffull",
    "fixed_forecast_scores": periods("fmatched"),
    "blend_flow": f"SELECT day, origin, dest, {q('value')} AS value FROM blend",
    "blend_compare": f"""WITH off AS (SELECT day, origin, dest, value FROM truth WHERE origin <> dest), e AS (SELECT coalesce(o.value, 0.0) - coalesce(f.value, 0.0) AS eo, coalesce(i.value, 0.0) - coalesce(f.value, 0.0) AS ei, coalesce(b.value, 0.0) - coalesce(f.value, 0.0) AS eb
      FROM out_flow o FULL JOIN in_flow i USING (day, origin, dest) FULL JOIN blend b USING (day, origin, dest) FULL JOIN off f USING (day, origin, dest))
      SELECT 'outgoing' AS variant, {q('sqrt(avg(eo * eo))')} AS value FROM e UNION ALL SELECT 'incoming', {q('sqrt(avg(ei * ei))')} FROM e UNION ALL SELECT 'blend', {q('sqrt(avg(eb * eb))')} FROM e UNION ALL SELECT 'error_correlation', {q('corr(eo, ei)')} FROM e""",
    "daily_rmse": f"SELECT day, cv_window, {q('rmse_diag')} AS rmse_diag, {q('rmse_off')} AS rmse_off FROM ({rmse('matched')})",
    "score_periods": periods("matched"),
    "combined_nrmse": f"SELECT n_days, combined_nrmse FROM ({periods('matched')}) WHERE period = 'overall'",
    "zero_baseline": periods("none"),
    "weekday_interp": f"SELECT day, origin, dest, {q('value')} AS value FROM pred",
    "linear_interp": f"SELECT day, origin, dest, {q('value')} AS value FROM ({lerp('around_any')})",
    "appearance_times_mean": f"""SELECT g.day, origin, dest, {q('n / CAST((SELECT count(*) FROM seen s WHERE s.weekday = g.weekday) AS DOUBLE) * mean')} AS value FROM target g JOIN
      (SELECT weekday, origin, dest, count(*) AS n, avg(value) AS mean FROM inner_train JOIN cal USING (day) WHERE value > 0 GROUP BY 1, 2, 3) USING (weekday)""",
    "error_hit_extra_miss": f"""SELECT kind, n, {q('e', 3)} AS sq_error, {q('e / SUM(e) OVER ()')} AS share FROM (SELECT CASE WHEN pred > 0 AND actual > 0 THEN 'hit' WHEN pred > 0 THEN 'extra' ELSE 'miss' END AS kind, count(*) AS n, SUM(pow(pred - actual, 2)) AS e
      FROM matched WHERE origin <> dest AND (pred > 0 OR actual > 0) GROUP BY 1)""",
    "error_concentration": f"""WITH p AS (SELECT origin, dest, SUM(pow(pred - actual, 2)) AS e FROM matched WHERE origin <> dest GROUP BY 1, 2), r AS (SELECT e, row_number() OVER (ORDER BY e DESC, origin, dest) AS k FROM p)
      SELECT top, {q('(SELECT SUM(e) FROM r WHERE k <= top) / (SELECT SUM(e) FROM p)')} AS share FROM (VALUES (10), (50)) v(top)""",
    "cell_error_concentration": f"""WITH p AS (SELECT origin, SUM(pow(pred - actual, 2)) AS e FROM matched WHERE origin = dest GROUP BY 1), r AS (SELECT e, row_number() OVER (ORDER BY e DESC, origin) AS k FROM p)
      SELECT CAST(top AS INT) AS top, {q('(SELECT SUM(e) FROM r WHERE k <= top) / (SELECT SUM(e) FROM p)')} AS share FROM (VALUES (5)) v(top)""",
    "error_by_area": f"""SELECT area, CASE WHEN origin = dest THEN 'diagonal' ELSE 'off-diagonal' END AS part, {q('CASE WHEN SUM(actual * actual) > 0 THEN SUM(pow(pred - actual, 2)) / SUM(actual * actual) END', 4)} AS relative_error, {q('SUM(pred)', 4)} AS pred_total, {q('SUM(actual)', 4)} AS actual_total
      FROM matched JOIN cells ON cell = origin GROUP BY 1, 2""",
    "daily_pairs": """SELECT day, coalesce(p, 0) AS n_predicted, coalesce(r, 0) AS n_recorded, coalesce(b, 0) AS n_both FROM target LEFT JOIN (SELECT day, count(*) FILTER (pred > 0) AS p, count(*) FILTER (actual > 0) AS r, count(*) FILTER (pred > 0 AND actual > 0) AS b FROM matched WHERE origin <> dest GROUP BY 1) USING (day)""",
    "daily_bias": f"""SELECT g.day, {q('CASE WHEN ad > 0 THEN (coalesce(pd, 0.0) - ad) / ad END')} AS bias_diag, {q('CASE WHEN ao > 0 THEN (coalesce(po, 0.0) - ao) / ao END')} AS bias_off FROM target g LEFT JOIN
      (SELECT day, SUM(pred) FILTER (origin = dest) AS pd, SUM(actual) FILTER (origin = dest) AS ad, SUM(pred) FILTER (origin <> dest) AS po, SUM(actual) FILTER (origin <> dest) AS ao FROM matched GROUP BY 1) USING (day)""",
    "candidate_coverage": "SELECT count(*) AS n, count(pair_id) AS n_covered, SUM(value) AS amount, SUM(CASE WHEN pair_id IS NOT NULL THEN value ELSE 0.0 END) AS amount_covered FROM truth LEFT JOIN pairs USING (origin, dest) WHERE origin <> dest AND value > 0",
    "submission_shape": "SELECT day, count(*) AS n_rows, count(*) FILTER (value IS NULL OR value < 0) AS n_bad, count(*) - count(DISTINCT (origin, dest)) AS n_twice FROM pred GROUP BY 1",
    "presence_monthly": f"""SELECT month, cell, {q('p / n')} AS mean, {q('ln(1 + p / n)')} AS log_mean FROM (SELECT strftime(day, '%Y-%m') AS month, cell, SUM(presence) AS p FROM presence GROUP BY 1, 2) JOIN (SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT day) AS n FROM od GROUP BY 1) USING (month)""",
    "presence_weekly": f"""SELECT week, cell, {q('p / n')} AS mean FROM (SELECT CAST(floor(date_diff('day', DATE '1996-01-01', day) / 7.0) AS INT) AS week, cell, SUM(presence) AS p FROM presence GROUP BY 1, 2)
      JOIN (SELECT CAST(floor(date_diff('day', DATE '1996-01-01', day) / 7.0) AS INT) AS week, count(DISTINCT day) AS n FROM od GROUP BY 1) USING (week)""",
    "cell_class": """SELECT cell, CASE WHEN k IN (1, 2, 6, 7, 11) THEN 'land' WHEN coalesce(p, 0) > 0 AND (SELECT min(greatest(abs(l.y - nat.y), abs(l.x - nat.x))) FROM nat l WHERE l.k IN (1, 2, 6, 7, 11)) >= 2 THEN 'noise' ELSE 'sea' END AS kind, coalesce(p, 0.0) AS presence
      FROM nat LEFT JOIN (SELECT origin AS cell, SUM(value) AS p FROM od GROUP BY 1) USING (cell) WHERE cell <> '-1_-1'""",
    "damage_ratio": "SELECT * FROM damage",
    "damage_topk": "SELECT * FROM damage ORDER BY ratio, cell LIMIT 5",
    "weekly_recovery": f"""WITH p AS (SELECT CAST(floor(date_diff('day', DATE '1996-01-01', day) / 7.0) AS INT) AS week, CASE WHEN y > 36 THEN 'north' ELSE 'south' END AS part, SUM(presence) AS p FROM presence JOIN cells USING (cell) GROUP BY 1, 2),
      b AS (SELECT part, SUM(p) / 8 AS base FROM p WHERE week BETWEEN -8 AND -1 GROUP BY 1) SELECT week, part, {q('100 * p / base')} AS percent FROM p JOIN b USING (part) WHERE base > 0""",
    "cell_geo": f"SELECT cell, {q('lat')} AS lat, {q('lon')} AS lon FROM nat WHERE cell <> '-1_-1'",
    "daily_total": "SELECT day, SUM(value) AS total, count(*) AS n_pairs FROM od GROUP BY 1",
}.items()}
