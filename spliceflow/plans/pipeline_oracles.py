"""The queries of pipelines.py as DuckDB SQL: name -> SQL. Longer ones start from the SQL of what they build on."""

from __future__ import annotations

from spliceflow.config import CHANGE_WEIGHTS
from spliceflow.plans import oracles as o
from spliceflow.plans.oracles import r6, sql

_W = "WINDOW w AS (PARTITION BY stream_id ORDER BY idx)"


def _with(parent: str, cut: str, steps: str) -> str:
    """The SQL of `parent` from its step `cut` on, over other steps."""
    return f"WITH RECURSIVE {steps}, {cut} AS ({o.ORACLES[parent].split(f', {cut} AS (', 1)[1]}"


# frames, six features, change score
_LIMITS = ", ".join(f"quantile_cont({c}, {q}) FILTER (valid) AS {e}_{c}" for c in CHANGE_WEIGHTS for e, q in (("lo", 0.05), ("hi", 0.95)))
_SCALED = ", ".join(f"least(greatest(CASE WHEN hi_{c} > lo_{c} THEN (f.{c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE f.{c} END, 0.0), 1.0) AS y_{c}" for c in CHANGE_WEIGHTS)
_TOTAL = " + ".join(f"{w} * abs(y_{c} - coalesce(lag(y_{c}) OVER w, y_{c}))" for c, w in CHANGE_WEIGHTS.items())
_FRAMES = f"""ff AS (SELECT frame_id AS idx, frame_id * 22 AS pos, * FROM ({o.ORACLES['frame_features']})), lims AS (SELECT stream_id, {_LIMITS} FROM ff GROUP BY 1),
    ys AS (SELECT f.stream_id, f.idx, f.pos, f.valid, {_SCALED} FROM ff f JOIN lims USING (stream_id)), ds AS (SELECT *, CASE WHEN valid THEN ({_TOTAL}) / {sum(CHANGE_WEIGHTS.values())} ELSE 0 END AS d FROM ys {_W}),
    sco AS (SELECT stream_id, idx, pos, valid, round(sum(d) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 9) AS score FROM ds),
    thr AS (SELECT *, coalesce(quantile_cont(score, 0.85) FILTER (valid) OVER (PARTITION BY stream_id), 0) AS threshold FROM sco)"""
_GREEDY = """pk AS (SELECT * FROM (SELECT *, score > threshold AND score >= lag(score) OVER w AND score >= lead(score) OVER w AND valid AS peak FROM thr WINDOW w AS (PARTITION BY stream_id ORDER BY idx)) WHERE peak),
    pk2 AS (SELECT * FROM pk QUALIFY count(*) OVER (PARTITION BY stream_id) > 1),
    grd AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS pos FROM thr UNION ALL SELECT g.stream_id, min(p.pos) FROM grd g JOIN pk2 p ON p.stream_id = g.stream_id AND p.pos >= g.pos + 66 GROUP BY 1),
    bnd AS (SELECT stream_id, CAST(pos AS DOUBLE) AS t FROM grd UNION ALL SELECT stream_id, CAST(max(pos) AS DOUBLE) FROM thr GROUP BY 1),
    pair AS (SELECT stream_id, t, lead(t) OVER w AS t1, row_number() OVER w - 1 AS seg_id FROM bnd WINDOW w AS (PARTITION BY stream_id ORDER BY t)),
    seg AS (SELECT stream_id, CAST(seg_id AS BIGINT) AS seg_id, CAST(t AS BIGINT) AS i0, CAST(t1 AS BIGINT) AS i1 FROM pair WHERE t1 - t >= 66)"""

# frames of 88 samples that don't overlap, and four detectors
_DETECTORS = f"""{', '.join(f'{s} AS ({o._STEPS[s]})' for s in ('sig', 'cen'))},
    fx AS (SELECT stream_id, idx // 88 AS idx, idx % 88 AS p, x FROM cen QUALIFY count(*) OVER (PARTITION BY stream_id, idx // 88) = 88),
    am AS (SELECT stream_id, idx, round(20 * log10(sqrt(avg(x * x) + 1e-12) + 1e-12), 6) AS db, min(x) FILTER (p = 0) AS first, min(x) FILTER (p = 87) AS last FROM fx GROUP BY 1, 2),
    pw AS (SELECT stream_id, idx, k, pow(sum(h * cos(2 * pi() * ((k * p) % 88) / 88)), 2) + pow(sum(h * sin(2 * pi() * ((k * p) % 88) / 88)), 2) AS power
      FROM (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * p / 87)) AS h FROM fx), range(45) q(k) GROUP BY 1, 2, 3),
    pu AS (SELECT *, sqrt(power) / (sqrt(sum(power) OVER (PARTITION BY stream_id, idx)) + 1e-12) AS u FROM pw),
    sp AS (SELECT stream_id, idx, round(CASE WHEN sum(power) > 1e-10 THEN sum(k * 44100 / 88.0 * power) / sum(power) ELSE 0 END, 6) AS hz, sum(u * prev) AS dot
      FROM (SELECT *, lag(u) OVER (PARTITION BY stream_id, k ORDER BY idx) AS prev FROM pu) GROUP BY 1, 2),
    det AS (SELECT stream_id, idx, hz, round(abs(hz - coalesce(lag(hz) OVER w, hz)), 6) AS centroid, round(abs(db - coalesce(lag(db) OVER w, db)), 6) AS energy, round(abs(first - coalesce(lag(last) OVER w, first)), 6) AS jump,
      CASE WHEN dot IS NULL THEN 0.0 ELSE round(1 - least(greatest(dot, -1.0), 1.0), 6) END AS shape FROM am JOIN sp USING (stream_id, idx) {_W})"""
_FUSED = """ev1 AS (SELECT stream_id, idx, method, score, CASE method WHEN 'centroid' THEN 1.0 WHEN 'energy' THEN 0.8 WHEN 'jump' THEN 0.6 ELSE 1.2 END::DOUBLE AS weight FROM det UNPIVOT (score FOR method IN (centroid, energy, jump, shape))),
    ev2 AS (SELECT *, quantile_cont(score, 0.85) OVER (PARTITION BY stream_id, method) AS threshold FROM ev1),
    ev AS (SELECT stream_id, CAST(idx AS DOUBLE) AS t, method FROM ev2 WINDOW w AS (PARTITION BY stream_id, method ORDER BY idx) QUALIFY score > threshold AND ev2.score >= lag(ev2.score) OVER w AND ev2.score >= lead(ev2.score) OVER w),
    chn AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t, method)),
    chn2 AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY t, method ROWS UNBOUNDED PRECEDING) AS chain FROM chn),
    fus AS (SELECT stream_id, chain, median(t) AS t, count(DISTINCT method) AS n_methods, bool_or(method IN ('centroid', 'shape')) AS strong FROM chn2 GROUP BY 1, 2),
    e AS (SELECT stream_id, CAST(max(idx) + 1 AS DOUBLE) AS t FROM det GROUP BY 1),
    c AS (SELECT DISTINCT f.stream_id, f.t FROM fus f JOIN e USING (stream_id) WHERE strong AND n_methods >= 2 AND f.t BETWEEN 0 AND e.t UNION SELECT * FROM e),
    r AS (SELECT stream_id, 0.0::DOUBLE AS t FROM e UNION ALL SELECT r.stream_id, min(c.t) FROM r JOIN c ON c.stream_id = r.stream_id AND c.t >= r.t + 3 GROUP BY 1)"""
_CENTROID = f"""thr AS (SELECT stream_id, idx, idx AS pos, true AS valid, hz, centroid AS score, quantile_cont(centroid, 0.8) OVER (PARTITION BY stream_id) AS threshold FROM det),
    {_GREEDY.replace('t1 - t >= 66', 't1 > t').replace('66', '3')}, mean AS (SELECT s.stream_id, s.seg_id, s.i0, s.i1, round(avg(d.hz), 3) AS mean_x FROM seg s JOIN det d ON d.stream_id = s.stream_id AND d.idx >= s.i0 AND d.idx < s.i1 GROUP BY ALL)"""

# blocks of 16 samples in windows of 12
_BLOCKS = f"""{', '.join(f'{s} AS ({o._STEPS[s]})' for s in ('sig', 'cen'))}, b16 AS (SELECT stream_id, idx // 16 AS frame_id, idx % 16 AS p, x FROM cen QUALIFY count(*) OVER (PARTITION BY stream_id, idx // 16) = 16),
    pw AS (SELECT stream_id, frame_id, k, k * 8000 / 12.0 AS hz, pow(sum(h * cos(2 * pi() * ((k * p) % 12) / 12)), 2) + pow(sum(h * sin(2 * pi() * ((k * p) % 12) / 12)), 2) AS power
      FROM (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * p / 11)) AS h FROM b16 WHERE p < 12), range(7) q(k) GROUP BY 1, 2, 3),
    pt AS (SELECT *, sum(power) OVER f AS total, sum(hz * power) OVER f AS hp, sum(power) OVER (PARTITION BY stream_id, frame_id ORDER BY k) AS cum FROM pw WINDOW f AS (PARTITION BY stream_id, frame_id)),
    sp AS (SELECT stream_id, frame_id, CASE WHEN max(total) > 1e-10 THEN max(hp) / max(total) ELSE 0 END AS centroid, CASE WHEN max(total) > 1e-10 THEN min(hz) FILTER (cum >= 0.85 * total) ELSE 0 END AS rolloff,
      CASE WHEN max(total) > 1e-10 THEN sqrt(sum(pow(hz - hp / total, 2) * power) / max(total)) ELSE 0 END AS bandwidth FROM pt GROUP BY 1, 2),
    blk AS (SELECT stream_id, frame_id, round(centroid, 6) AS centroid, rms, rolloff, bandwidth FROM sp JOIN (SELECT stream_id, frame_id, sqrt(avg(x * x)) AS rms FROM b16 WHERE p < 12 GROUP BY 1, 2) USING (stream_id, frame_id))"""
_LIVE = f"""cal AS (SELECT stream_id, centroid AS x FROM blk WHERE frame_id < 6 AND centroid > 100), bands AS (WITH RECURSIVE o AS ({o.ORACLES['kmeans1d_quartile'].split(', o AS (', 1)[1].replace('sig', 'cal')}),
    cls AS (SELECT b.stream_id, b.frame_id AS idx, c.band, coalesce(c.c, 0) AS conf FROM (SELECT * FROM blk WHERE frame_id >= 6) b LEFT JOIN (
      SELECT stream_id, frame_id, band, 1 - abs(centroid - (low + high) / 2) / ((high - low) / 2) AS c FROM blk JOIN bands USING (stream_id) WHERE centroid BETWEEN low AND high
        AND 1 - abs(centroid - (low + high) / 2) / ((high - low) / 2) > 0 QUALIFY row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY c DESC, band) = 1) c USING (stream_id, frame_id)),
    cur AS (SELECT *, last_value(CASE WHEN conf >= 0.3 THEN band END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current,
      last_value(CASE WHEN conf >= 0.3 THEN band END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cls),
    sin AS (SELECT *, last_value(CASE WHEN current IS NOT NULL AND (before IS NULL OR before <> current) THEN idx END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM cur)"""

_SHOWN = "frm AS (" + o._STEPS["frm"] + "), ex AS (" + o._STEPS["ex"] + """), hn AS (SELECT stream_id, frame_id, k, sqrt(pow(sum(h * cos(2 * pi() * ((k * p) % 64) / 64)), 2) + pow(sum(h * sin(2 * pi() * ((k * p) % 64) / 64)), 2)) AS m
      FROM (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * p / 63)) AS h FROM ex), range(33) q(k) GROUP BY 1, 2, 3),
    sh AS (SELECT stream_id, frame_id, k, sum(m) OVER (PARTITION BY stream_id, frame_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 160.0 AS v FROM hn)"""

ORACLES: dict[str, str] = {
    "frame_change_score": f"WITH {_FRAMES} SELECT stream_id, idx, valid, {r6('score')}, {r6('threshold')} FROM thr",
    "cfar_detector": f"""WITH {_FRAMES} SELECT stream_id, idx, valid, {r6('score')}, {r6('coalesce(cells[greatest(0, least(CAST(floor(len(cells) * 0.75) AS INTEGER), len(cells) - 1)) + 1], 0) * 3.5', 'threshold')} FROM ({o._CELLS})""",
    "batch_segments": f"""WITH RECURSIVE {_FRAMES}, {_GREEDY} SELECT stream_id, seg_id, i0, i1, {r6('valid_ratio')} FROM seg LEFT JOIN (
        SELECT s.stream_id, s.seg_id, avg(CAST(f.valid AS INTEGER)) AS valid_ratio FROM seg s JOIN ff f ON f.stream_id = s.stream_id AND f.pos >= s.i0 AND f.pos < s.i1 GROUP BY 1, 2) USING (stream_id, seg_id) WHERE valid_ratio IS NULL OR valid_ratio >= 0.3""",
    "segment_features_loud": "SELECT stream_id, seg_id, " + ", ".join(f"CASE WHEN f.rms < 40 THEN 0.0 ELSE f.{c} END AS {c}" for c in ("centroid", "rms", "rolloff", "zcr", "power_std", "bandwidth")) + f" FROM ({o.ORACLES['segment_features']}) f",
    "choose_clusters": f"SELECT stream_id, CASE WHEN max(centroid) - min(centroid) > 3000 OR max(zcr) - min(zcr) > 0.1 THEN 3 ELSE 2 END AS k FROM ({o.ORACLES['segment_features']}) GROUP BY 1",
    "frame_detectors": f"WITH {_DETECTORS} SELECT stream_id, idx, centroid, energy, jump, shape FROM det",
    "frame_fused_boundaries": f"WITH RECURSIVE {_DETECTORS}, {_FUSED} SELECT * FROM r UNION SELECT * FROM e",
    "centroid_sources": f"SELECT m.stream_id, m.seg_id, m.i0, m.i1, m.mean_x AS mean_hz, l.letter FROM (WITH RECURSIVE {_DETECTORS}, {_CENTROID} SELECT * FROM mean) m JOIN ("
    + _with("leader_cluster", "s", f"{_DETECTORS}, {_CENTROID}").replace("<= 12", "<= 500") + ") l USING (stream_id, seg_id)",
    "silence_report": sql("sig cen", "").rstrip() + f""", lim AS (SELECT stream_id, max(abs(x)) * 0.05 AS lim, count(*) AS n FROM cen GROUP BY 1), q AS (SELECT stream_id, idx, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS g FROM cen JOIN lim USING (stream_id) WHERE abs(x) <= lim),
        s AS (SELECT stream_id, count(*) AS c FROM q GROUP BY stream_id, g HAVING count(*) >= 2)
        SELECT stream_id, n_regions, removed, {r6('100.0 * removed / n', 'percent')}, {r6('CASE WHEN n > removed THEN n / (n - removed) END', 'ratio')} FROM (SELECT stream_id, n, count(c) AS n_regions, CAST(coalesce(sum(c), 0) AS BIGINT) AS removed FROM lim LEFT JOIN s USING (stream_id) GROUP BY 1, 2)""",
    "block_features": f"WITH {_BLOCKS} SELECT stream_id, frame_id, centroid, {r6('rms')}, {r6('rolloff')}, {r6('bandwidth')} FROM blk",
    "calibrate_then_live": f"""WITH RECURSIVE {_BLOCKS}, {_LIVE} SELECT stream_id, idx AS frame_id, band AS label, current, {r6('CASE WHEN current = 0 AND conf >= 0.3 THEN least(1.0, (idx - since) * 16 / 64.0) ELSE 0 END', 'gain')} FROM sin
        UNION ALL SELECT stream_id, frame_id, NULL, NULL, 1.0 FROM blk WHERE frame_id < 6""",
    "block_stats": sql("sig cen", "").rstrip() + f""", b AS (SELECT stream_id, idx // 16 AS idx, sqrt(avg(x * x)) AS rms FROM cen GROUP BY 1, 2 HAVING count(*) = 16), c AS (SELECT *, coalesce((rms >= 40) <> (lag(rms) OVER w >= 40), false) AS changed FROM b {_W})
        SELECT stream_id, idx // 10 AS turn, count(*) AS n_blocks, {r6('avg(rms)', 'mean_rms')}, count(*) FILTER (changed) AS n_changes FROM c GROUP BY 1, 2""",
    "boundaries_in_range": sql(o._BOUNDS, "SELECT stream_id, t FROM bnd WHERE t > 0 AND t < 100"),
    "plot_data": sql(o._BOUNDS, f"SELECT stream_id, idx, {r6('x')}, {r6('score')}, EXISTS (SELECT 1 FROM bnd b WHERE b.stream_id = s.stream_id AND b.t = s.idx) AS boundary FROM sco s WHERE idx <= 100"),
    "low_centroid_filter": f"SELECT * FROM ({o.ORACLES['centroid_power']}) WHERE centroid > 2000",
    "centroid_eps": sql("frm ex dft spc", f"SELECT stream_id, frame_id, {r6('sum(hz * power) / (sum(power) + 1e-12)', 'centroid')} FROM spc GROUP BY 1, 2"),
    "display_spectrum": f"WITH {_SHOWN} SELECT stream_id, frame_id, {r6('min(v) FILTER (k = 0)', 'shown0')}, {r6('min(v) FILTER (k = 9)', 'shown9')}, {r6('max(v) FILTER (k < 8)', 'peak')} FROM sh GROUP BY 1, 2",
    "whole_spectrum": sql("sig cen len", f"""SELECT stream_id, k, {r6('k * 8000.0 / n', 'hz')}, {r6('sqrt(pow(sum(x * cos(2 * pi() * ((k * idx) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((k * idx) % n) / n)), 2))', 'magnitude')}
        FROM cen JOIN (SELECT stream_id, n, unnest(range(0, n // 2 + 1)) AS k FROM len) USING (stream_id) GROUP BY stream_id, k, n"""),
    "resampled": sql("sig cen len", f"""SELECT stream_id, m AS idx, {r6('sum(x * h)', 'x')} FROM (SELECT stream_id, unnest(range(0, (n * 3 + 3) // 4)) AS m FROM len) JOIN (
        SELECT ph, d, h / sum(h) OVER (PARTITION BY ph) AS h FROM (SELECT ph, d, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.69 * t) / (pi() * 0.69 * t) END * (0.35875 + 0.48829 * cos(a) + 0.14128 * cos(2 * a) + 0.01168 * cos(3 * a)) AS h
        FROM (SELECT ph, d, ph / 3.0 - d AS t, pi() * least(greatest((ph / 3.0 - d) / 93, -1), 1) AS a FROM range(0, 3) u(ph), range(-92, 94) v(d)))) w ON (m * 4) % 3 = ph
        JOIN cen USING (stream_id) WHERE cen.idx = (m * 4) // 3 + d GROUP BY stream_id, m"""),
    "frame_bins_sql": sql("frm ex dft", f"SELECT stream_id, frame_id, CAST(k AS INTEGER) AS k, {r6('k * 8000.0 / 64', 'hz')}, {r6('power')} FROM dft"),
    "removed_head": sql("sig sil0 sil", "SELECT * FROM sil ORDER BY stream_id, i0 LIMIT 10"),
    "raw_samples": sql("feat", "SELECT stream_id, idx * 2 + channel AS idx, CAST(trunc(least(greatest(CASE channel WHEN 0 THEN zcr ELSE centroid * 10 END, -32768.0), 32767.0)) AS INTEGER) AS x FROM feat, (VALUES (0), (1)) v(channel)"),
    "stereo_copy": sql("sig", "SELECT stream_id, idx, round(x, 6) AS left, round(x, 6) AS right FROM sig").replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
    "compact_crossfaded": _with("crossfade_compact", "n", f"sig AS ({o._STEPS['sig']}), sco AS (SELECT stream_id, idx, CASE WHEN x > 45 THEN x ELSE 0 END AS x FROM sig), lab AS (SELECT stream_id, 0 AS label, min(idx) AS i0, max(idx) + 1 AS i1 FROM (SELECT *, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS g FROM sig WHERE x > 45) GROUP BY stream_id, g)").replace("least(4,", "least(2,"),
}
