"""The queries again as DuckDB SQL over the same tables, written from the definitions: name -> SQL."""

from __future__ import annotations

#: Common table expressions by name; each may use those before it.
_STEPS = {
    "sig": "SELECT event_type AS stream_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value AS x FROM events",
    "cen": "SELECT stream_id, idx, x - avg(x) OVER (PARTITION BY stream_id) AS x FROM sig",
    "frm": "SELECT CAST(label AS VARCHAR) AS stream_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_id, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings WHERE label IS NOT NULL",
    "feat": """SELECT l_returnflag AS stream_id, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS idx, l_quantity AS centroid, l_discount AS rms,
        l_tax AS rolloff, l_extendedprice AS zcr, l_quantity * l_discount AS flux, l_extendedprice * l_tax AS bandwidth, l_quantity >= 5 AS valid FROM lineitem""",
    "trk": """SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS track, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS BIGINT) AS idx, o_totalprice AS x
        FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""",
    "short": "SELECT min(c) AS n FROM (SELECT count(*) AS c FROM trk GROUP BY track)",
    "len": "SELECT stream_id, count(*) AS n FROM sig GROUP BY 1",
    "lim": "SELECT stream_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM sig GROUP BY 1",
    "scl": "SELECT stream_id, idx, x, least(greatest(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE x END, 0.0), 1.0) AS y FROM sig JOIN lim USING (stream_id)",
    "dif": "SELECT stream_id, idx, x, abs(y - coalesce(lag(y) OVER w, y)) AS d FROM scl WINDOW w AS (PARTITION BY stream_id ORDER BY idx)",
    "sco": "SELECT stream_id, idx, x, round(sum(d) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 9) AS score FROM dif",
    "thr": "SELECT sco.*, threshold FROM sco JOIN (SELECT stream_id, quantile_cont(score, 0.85) AS threshold FROM sco GROUP BY 1) USING (stream_id)",
    "pk": "SELECT stream_id, idx, score, threshold FROM thr WINDOW w AS (PARTITION BY stream_id ORDER BY idx) QUALIFY score > threshold AND score >= lag(score) OVER w AND score >= lead(score) OVER w",
    "pk2": "SELECT * FROM pk QUALIFY count(*) OVER (PARTITION BY stream_id) > 1",
    "grd": "SELECT stream_id, CAST(0 AS BIGINT) AS idx FROM len UNION ALL SELECT g.stream_id, min(p.idx) FROM grd g JOIN pk2 p ON p.stream_id = g.stream_id AND p.idx >= g.idx + 10 GROUP BY 1",
    "bnd": "SELECT stream_id, CAST(idx AS DOUBLE) AS t FROM grd UNION ALL SELECT stream_id, CAST(n - 1 AS DOUBLE) FROM len",
    "pair": "SELECT stream_id, t, lead(t) OVER w AS t1, row_number() OVER w - 1 AS seg_id, count(*) OVER (PARTITION BY stream_id) AS n FROM bnd WINDOW w AS (PARTITION BY stream_id ORDER BY t)",
    "seg": "SELECT stream_id, CAST(seg_id AS BIGINT) AS seg_id, t AS t0, t1, CAST(ceil(t) AS BIGINT) AS i0, CAST(ceil(t1) AS BIGINT) AS i1 FROM pair WHERE t1 > t",
    "ins": "SELECT s.*, p.idx, p.x, p.score FROM seg s JOIN sco p ON p.stream_id = s.stream_id AND p.idx >= s.i0 AND p.idx < s.i1",
    "mean": "SELECT stream_id, seg_id, t0, t1, i0, i1, avg(x) AS mean_x, avg(score) AS mean_score, count(*) AS n_points FROM ins GROUP BY ALL",
    "lab": "SELECT *, CAST(least(floor(mean_x / 40), 2) AS INTEGER) AS label FROM mean",
    "ex": "SELECT stream_id, frame_id, p, samples[p + 1] AS x FROM frm, range(64) r(p)",
    "dft": """SELECT stream_id, frame_id, k, pow(sum(x * cos(2 * pi() * ((k * p) % 64) / 64)), 2) + pow(sum(x * sin(2 * pi() * ((k * p) % 64) / 64)), 2) AS power
        FROM ex, range(33) q(k) GROUP BY 1, 2, 3""",
    "spc": "SELECT *, sqrt(power) AS m, k * 125.0::DOUBLE AS hz, sum(power) OVER (PARTITION BY stream_id, frame_id) AS total FROM dft",
    "ev0": """SELECT stream_id, idx, abs(x - coalesce(lag(x) OVER w, x)) AS centroid, abs(x * x - coalesce(lag(x) OVER w, x) * coalesce(lag(x) OVER w, x)) AS energy,
        abs(x - coalesce(lag(x, 2) OVER w, x)) AS jump, abs(coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) AS shape FROM sig WINDOW w AS (PARTITION BY stream_id ORDER BY idx)""",
    "ev1": "SELECT stream_id, idx, method, round(score, 9) AS score, CASE method WHEN 'centroid' THEN 1.0 WHEN 'energy' THEN 0.8 WHEN 'jump' THEN 0.6 ELSE 1.2 END::DOUBLE AS weight FROM ev0 UNPIVOT (score FOR method IN (centroid, energy, jump, shape))",
    "ev2": "SELECT *, quantile_cont(score, 0.93) OVER (PARTITION BY stream_id, method) AS threshold FROM ev1",
    "ev": "SELECT stream_id, CAST(idx AS DOUBLE) AS t, method, score * weight AS score FROM ev2 WINDOW w AS (PARTITION BY stream_id, method ORDER BY idx) QUALIFY score > threshold AND ev2.score >= lag(ev2.score) OVER w AND ev2.score >= lead(ev2.score) OVER w",
    "chn": "SELECT *, CASE WHEN t - lag(t) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t, method)",
    "chn2": "SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY t, method ROWS UNBOUNDED PRECEDING) AS chain FROM chn",
    "fus": "SELECT stream_id, chain, median(t) AS t, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, count(DISTINCT method) AS n_methods, bool_or(method IN ('centroid', 'shape')) AS strong, sum(score) AS score_sum, max(score) AS score_max, count(*) AS n_events FROM chn2 GROUP BY 1, 2",
    "sil0": "SELECT stream_id, idx, idx - row_number() OVER (PARTITION BY stream_id ORDER BY idx) AS g FROM sig WHERE abs(x) <= 45",
    "sil": "SELECT stream_id, min(idx) AS i0, max(idx) + 1 AS i1 FROM sil0 GROUP BY stream_id, g HAVING count(*) >= 3",
    "fr8": "SELECT stream_id, idx // 64 AS frame_id, list(x ORDER BY idx) AS samples FROM sig GROUP BY 1, 2 HAVING count(*) = 64",
}


def sql(steps: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(f'{s} AS ({_STEPS[s]})' for s in steps.split())} {select}"


def r6(e: str, name: str | None = None) -> str:
    """Rounded to six places; adding zero turns -0.0 into 0.0."""
    return f"round({e}, 6) + 0.0 AS {name or e}"


_SCORE = "sig lim scl dif sco"
_PEAKS = f"{_SCORE} thr pk"
_BOUNDS = f"{_PEAKS} pk2 len grd bnd"
_SEGS = f"{_BOUNDS} pair seg"
_MEANS = f"{_SEGS} ins mean"
_LABELS = f"{_MEANS} lab"
_EVENTS = "sig ev0 ev1 ev2 ev chn chn2 fus"
_W = "WINDOW w AS (PARTITION BY stream_id ORDER BY idx)"

ORACLES: dict[str, str] = {
    "segments": sql(_MEANS, f"SELECT stream_id, seg_id, t0, t1, n_points, {r6('mean_x')} FROM mean"),
    "robust_minmax": sql("sig lim scl", f"SELECT stream_id, idx, {r6('y', 'x')} FROM scl"),
    "minmax_scale": sql("sig", f"SELECT stream_id, idx, {r6('(x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p)', 'x')} FROM sig WINDOW p AS (PARTITION BY stream_id)"),
    "zscore": sql("sig", f"SELECT stream_id, idx, {r6('(x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-9)', 'x')} FROM sig WINDOW p AS (PARTITION BY stream_id)"),
    "mad_scale": sql("sig", f"""SELECT stream_id, idx, {r6('(x - med) / (1.4826 * median(abs(x - med)) OVER (PARTITION BY stream_id) + 1e-9)', 'x')}
        FROM (SELECT *, median(x) OVER (PARTITION BY stream_id) AS med FROM sig)"""),
    "robust_minmax_valid": sql("sig", f"""SELECT stream_id, idx, {r6('least(greatest((x - lo) / (hi - lo), 0.0), 1.0)', 'x')} FROM sig
        JOIN (SELECT stream_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM sig WHERE x >= 10 GROUP BY 1) USING (stream_id)"""),
    "exact_percentiles": sql("sig", f"SELECT stream_id, {', '.join(r6(f'quantile_cont(x, {p})', n) for n, p in (('p05', 0.05), ('p50', 0.5), ('p85', 0.85), ('p95', 0.95)))} FROM sig GROUP BY 1"),
    "first_diff": sql("sig", f"SELECT stream_id, idx, {r6('abs(x - coalesce(lag(x) OVER w, x))', 'd')} FROM sig {_W}"),
    "moving_avg5": sql("sig", f"SELECT stream_id, idx, {r6('sum(x) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0', 'x')} FROM sig"),
    "rolling_median_last3": sql("sig", f"""SELECT stream_id, idx, {r6('m')}, {r6('abs(x - m) / greatest(m, 0.001)', 'change')} FROM (
        SELECT *, median(x) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM sig) WHERE idx >= 3"""),
    "cumulative_sum": sql("sig", "SELECT stream_id, idx, round(CAST(sum(CAST(round(x, 2) AS DECIMAL(18, 2))) OVER (PARTITION BY stream_id ORDER BY idx) AS DOUBLE), 6) AS total FROM sig"),
    "boundary_jump": sql("sig", f"SELECT stream_id, idx // 22 AS frame_id, {r6('jump')} FROM (SELECT *, abs(x - lag(x) OVER w) AS jump FROM sig {_W}) WHERE idx % 22 = 0 AND idx > 0"),
    "pct_threshold_peaks": sql(_PEAKS, f"SELECT stream_id, idx, {r6('score')}, {r6('threshold')} FROM pk"),
    "peaks_pm3": sql(f"{_SCORE} thr", f"""SELECT stream_id, idx, {r6('score')} FROM thr WINDOW v AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
        QUALIFY thr.score > threshold AND thr.score >= max(thr.score) OVER v AND count(*) OVER v = 7"""),
    "peaks_open_ends": sql(_SCORE, f"""SELECT stream_id, idx, {r6('s', 'score')} FROM (SELECT stream_id, idx, score AS s, quantile_cont(score, 0.8) OVER (PARTITION BY stream_id) AS threshold FROM sco) {_W}
        QUALIFY s >= threshold AND s >= coalesce(lag(s) OVER w, s) AND s >= coalesce(lead(s) OVER w, s)"""),
    "boundaries_greedy": sql(_BOUNDS, "SELECT stream_id, t FROM bnd"),
    "boundaries_strongest": sql(_PEAKS, "").rstrip() + f""", r AS (SELECT stream_id, idx, score, 0 AS step FROM pk UNION ALL
        SELECT stream_id, idx, score, step + 1 FROM (SELECT *, first_value(idx) OVER (PARTITION BY stream_id ORDER BY score DESC, idx) AS b FROM r) WHERE abs(idx - b) >= 12)
        SELECT stream_id, idx, {r6('s', 'score')} FROM (SELECT stream_id, step, idx, score AS s FROM r) QUALIFY row_number() OVER (PARTITION BY stream_id, step ORDER BY s DESC, idx) = 1""",
    "consolidate_peaks": sql(_PEAKS, f"""SELECT stream_id, idx, {r6('s', 'score')} FROM (SELECT stream_id, idx, score AS s, sum(new) OVER (PARTITION BY stream_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN idx - lag(idx) OVER w <= 5 THEN 0 ELSE 1 END AS new FROM pk {_W})) QUALIFY row_number() OVER (PARTITION BY stream_id, run ORDER BY s DESC, idx) = 1"""),
    "hysteresis": sql(_SCORE, """SELECT stream_id, idx, count(*) FILTER (score > threshold) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS gate
        FROM (SELECT *, quantile_cont(score, 0.7) OVER (PARTITION BY stream_id) AS threshold FROM sco)"""),
    "pick_peaks": sql(_SCORE, "").rstrip() + f""", q AS (SELECT sco.*, threshold FROM sco JOIN (SELECT stream_id, quantile_cont(score, 0.8) AS threshold FROM sco WHERE idx > 0 GROUP BY 1) USING (stream_id)),
        g AS (SELECT stream_id, idx, threshold, CASE WHEN score > threshold AND lag(score) OVER w > threshold THEN score ELSE 0 END AS s FROM q {_W}),
        c AS (SELECT stream_id, idx, s FROM g {_W} QUALIFY s > threshold AND s >= lag(s) OVER w AND s >= lead(s) OVER w),
        r AS (SELECT *, 0 AS step FROM c UNION ALL SELECT stream_id, idx, s, step + 1 FROM (SELECT *, first_value(idx) OVER (PARTITION BY stream_id ORDER BY s DESC, idx) AS b FROM r) WHERE abs(idx - b) >= 8),
        k AS (SELECT stream_id, idx, s FROM r QUALIFY row_number() OVER (PARTITION BY stream_id, step ORDER BY s DESC, idx) = 1),
        n AS (SELECT *, CASE WHEN idx - lag(idx) OVER w <= 10 THEN 0 ELSE 1 END AS new FROM k {_W}),
        m AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
        SELECT stream_id, idx, {r6('s', 'score')} FROM m QUALIFY row_number() OVER (PARTITION BY stream_id, run ORDER BY s DESC, idx) = 1""",
    "segments_deadzone": sql(f"{_BOUNDS} pair", """SELECT * FROM (SELECT stream_id, CAST(seg_id AS BIGINT) AS seg_id, CASE WHEN seg_id > 0 THEN t + 2 ELSE t END AS t0, CASE WHEN seg_id < n - 2 THEN t1 - 2 ELSE t1 END AS t1
        FROM pair WHERE t1 IS NOT NULL) WHERE t1 > t0 AND t1 - t0 >= 8"""),
    "segment_valid_ratio": sql(f"{_SEGS} ins", f"""SELECT stream_id, seg_id, {r6('valid_ratio')} FROM seg LEFT JOIN (SELECT stream_id, seg_id, avg(CAST(x >= 40 AS INTEGER)) AS valid_ratio FROM ins GROUP BY 1, 2) USING (stream_id, seg_id)
        WHERE valid_ratio IS NULL OR valid_ratio >= 0.3"""),
    "segment_means": sql(_MEANS, f"SELECT stream_id, seg_id, {r6('mean_x')}, {r6('mean_score')}, n_points FROM mean"),
    "label_summary": sql(_LABELS, f"SELECT stream_id, label, chr(65 + label) AS letter, count(*) AS n, {r6('avg(mean_x)', 'mean_x')} FROM lab GROUP BY 1, 2"),
    "choose_k": sql(_MEANS, f"SELECT stream_id, {r6('spread')}, CASE WHEN spread > 60 THEN 3 ELSE 2 END AS k FROM (SELECT stream_id, quantile_cont(mean_x, 0.9) - quantile_cont(mean_x, 0.1) AS spread FROM mean GROUP BY 1)"),
    "frame_hop": sql("sig", f"SELECT a.stream_id, a.idx // 22 AS frame_id, CAST(88 AS BIGINT) AS n, {r6('a.x', 'first')}, {r6('b.x', 'last')} FROM sig a JOIN sig b ON a.stream_id = b.stream_id AND b.idx = a.idx + 87 WHERE a.idx % 22 = 0"),
    "frame_tumbling": sql("sig", f"SELECT a.stream_id, a.idx // 64 AS frame_id, {r6('a.x', 'first')}, {r6('b.x', 'last')} FROM sig a JOIN sig b ON a.stream_id = b.stream_id AND b.idx = a.idx + 63 WHERE a.idx % 64 = 0"),
    "frame_padded": f"""WITH q AS (SELECT CAST(l_orderkey AS VARCHAR) AS stream_id, l_quantity AS x, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS idx FROM lineitem)
        SELECT a.stream_id, a.idx // 4 AS frame_id, {r6('a.x', 'first')}, {r6('coalesce(b.x, 0)', 'last')} FROM q a LEFT JOIN q b ON a.stream_id = b.stream_id AND b.idx = a.idx + 3 WHERE a.idx % 4 = 0 AND (a.idx = 0 OR b.x IS NOT NULL)""",
    "taper": sql("frm ex", f"""SELECT stream_id, frame_id, {r6('sqrt(avg(pow(x * (0.5 - 0.5 * cos(2 * pi() * p / 63)), 2)))', 'rms_hann')}, {r6('sqrt(avg(pow(x * (0.54 - 0.46 * cos(2 * pi() * p / 63)), 2)))', 'rms_hamming')} FROM ex GROUP BY 1, 2"""),
    "dft_power": sql("frm ex dft", f"SELECT stream_id, frame_id, k, {r6('power')} FROM dft"),
    "fft_power": sql("frm ex dft", f"SELECT stream_id, frame_id, k, {r6('power')} FROM dft"),
    "centroid_power": sql("frm ex dft spc", f"SELECT stream_id, frame_id, {r6('CASE WHEN sum(power) > 1e-10 THEN sum(hz * power) / sum(power) ELSE 0 END', 'centroid')} FROM spc GROUP BY 1, 2"),
    "centroid_mag": sql("frm ex dft spc", f"SELECT stream_id, frame_id, {r6('CASE WHEN sum(m) > 0 THEN sum(hz * m) / sum(m) ELSE 0 END', 'centroid_magnitude')} FROM spc GROUP BY 1, 2"),
    "rolloff85": sql("frm ex dft spc", f"""SELECT stream_id, frame_id, {r6('CASE WHEN max(total) > 1e-10 THEN min(hz) FILTER (cum >= 0.85 * total) ELSE 0 END', 'rolloff')}
        FROM (SELECT *, sum(power) OVER (PARTITION BY stream_id, frame_id ORDER BY k) AS cum FROM spc) GROUP BY 1, 2"""),
    "bandwidth": sql("frm ex dft spc", f"""SELECT stream_id, frame_id, {r6('CASE WHEN max(total) > 1e-10 THEN sqrt(sum(pow(hz - c, 2) * power) / max(total)) ELSE 0 END', 'bandwidth')}
        FROM (SELECT *, sum(hz * power) OVER (PARTITION BY stream_id, frame_id) / total AS c FROM spc) GROUP BY 1, 2"""),
    "flatness": sql("frm ex dft spc", f"SELECT stream_id, frame_id, {r6('exp(avg(ln(power + 1e-12))) / (avg(power) + 1e-12)', 'flatness')} FROM spc GROUP BY 1, 2"),
    "band_energy": sql("frm ex dft spc", "SELECT stream_id, frame_id, " + ", ".join(r6(f"coalesce(sum(power) FILTER (hz >= {a} AND hz < {b}), 0)", f"band{i}") for i, (a, b) in enumerate(((0, 1000), (1000, 3000), (3000, 6000), (6000, 1e9)))) + " FROM spc GROUP BY 1, 2"),
    "flux": sql("frm ex dft spc", f"""SELECT stream_id, frame_id, {r6('coalesce(sum(pow(m - prev, 2)), 0)', 'flux')} FROM (
        SELECT stream_id, frame_id, m, lag(m) OVER (PARTITION BY stream_id, k ORDER BY frame_id) AS prev FROM spc WHERE frame_id % 7 <> 3
        UNION ALL SELECT stream_id, frame_id, m, NULL FROM spc WHERE frame_id % 7 = 3) GROUP BY 1, 2"""),
    "shape_change": sql("frm ex dft spc", f"""SELECT stream_id, frame_id, {r6('coalesce(1 - least(greatest(sum(u * prev), -1.0), 1.0), 0.0)', 'change')} FROM (
        SELECT stream_id, frame_id, u, lag(u) OVER (PARTITION BY stream_id, k ORDER BY frame_id) AS prev FROM (SELECT *, m / (sqrt(total) + 1e-12) AS u FROM spc)) GROUP BY 1, 2"""),
    "rms_db": sql("frm ex", f"SELECT stream_id, frame_id, {r6('avg(x * x)', 'energy')}, {r6('sqrt(avg(x * x))', 'rms')}, {r6('20 * log10(sqrt(avg(x * x) + 1e-12) + 1e-12)', 'rms_db')} FROM ex GROUP BY 1, 2"),
    "zcr_signdiff": sql("frm ex", f"SELECT stream_id, frame_id, {r6('sum(abs(sign(x) - sign(prev))) / 128.0', 'zcr')} FROM (SELECT *, lag(x) OVER (PARTITION BY stream_id, frame_id ORDER BY p) AS prev FROM ex) GROUP BY 1, 2"),
    "zcr_neq": sql("frm ex", f"SELECT stream_id, frame_id, {r6('count(*) FILTER (sign(x) <> sign(prev)) / 63.0', 'zcr')} FROM (SELECT *, lag(x) OVER (PARTITION BY stream_id, frame_id ORDER BY p) AS prev FROM ex) GROUP BY 1, 2"),
    "frame_features": sql("sig cen", "").rstrip() + f""", fx AS (SELECT a.stream_id, a.idx // 22 AS frame_id, b.idx - a.idx AS p, b.x FROM cen a JOIN cen b ON a.stream_id = b.stream_id AND b.idx BETWEEN a.idx AND a.idx + 87 WHERE a.idx % 22 = 0
        QUALIFY count(*) OVER (PARTITION BY a.stream_id, a.idx) = 88),
        am AS (SELECT stream_id, frame_id, sqrt(avg(x * x)) AS rms, sum(abs(sign(x) - sign(prev))) / 176.0 AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY stream_id, frame_id ORDER BY p) AS prev FROM fx) GROUP BY 1, 2),
        pw AS (SELECT stream_id, frame_id, k, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * p / 87)) * cos(2 * pi() * ((k * p) % 88) / 88)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * p / 87)) * sin(2 * pi() * ((k * p) % 88) / 88)), 2) AS power
          FROM fx JOIN am USING (stream_id, frame_id), range(45) q(k) WHERE rms >= 20 GROUP BY 1, 2, 3),
        ps AS (SELECT *, k * 44100 / 88.0 AS hz, sqrt(power) AS m, sum(power) OVER f AS total, sum(power) OVER (PARTITION BY stream_id, frame_id ORDER BY k) AS cum, lag(sqrt(power)) OVER (PARTITION BY stream_id, k ORDER BY frame_id) AS prev
          FROM pw WINDOW f AS (PARTITION BY stream_id, frame_id)),
        sp AS (SELECT stream_id, frame_id, sum(hz * power) / max(total) AS centroid, min(hz) FILTER (cum >= 0.85 * total) AS rolloff, sqrt(greatest(sum(hz * hz * power) / max(total) - pow(sum(hz * power) / max(total), 2), 0)) AS bandwidth, coalesce(sum(pow(m - prev, 2)), 0) AS flux FROM ps GROUP BY 1, 2)
        SELECT stream_id, frame_id, rms >= 20 AS valid, {r6('frame_id * 22 / 44100.0', 't')}, {r6('rms')}, {r6('CASE WHEN rms >= 20 THEN zcr ELSE 0 END', 'zcr')}, {', '.join(r6(f'coalesce({c}, 0)', c) for c in ('centroid', 'rolloff', 'bandwidth', 'flux'))}
        FROM am LEFT JOIN sp USING (stream_id, frame_id)""",
    "segment_features": sql(_SEGS + " cen", "").rstrip() + f""", sx AS (SELECT s.stream_id, s.seg_id, c.idx - s.i0 AS p, c.x, count(*) OVER (PARTITION BY s.stream_id, s.seg_id) AS n FROM seg s JOIN cen c ON c.stream_id = s.stream_id AND c.idx >= s.i0 AND c.idx < s.i1),
        am AS (SELECT stream_id, seg_id, sqrt(avg(x * x)) AS rms, sum(abs(sign(x) - sign(prev))) / (2.0 * max(n)) AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY stream_id, seg_id ORDER BY p) AS prev FROM sx WHERE n >= 10) GROUP BY 1, 2),
        sw AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * p / (n - 1))) AS h, unnest(range(0, n // 2 + 1)) AS k FROM sx WHERE n >= 10),
        pw AS (SELECT stream_id, seg_id, k, n, k * 44100 / n AS hz, pow(sum(h * cos(2 * pi() * ((k * p) % n) / n)), 2) + pow(sum(h * sin(2 * pi() * ((k * p) % n) / n)), 2) AS power FROM sw GROUP BY 1, 2, 3, 4),
        ps AS (SELECT *, sum(power) OVER (PARTITION BY stream_id, seg_id) AS total, sum(power) OVER (PARTITION BY stream_id, seg_id ORDER BY k) AS cum, sum(hz * power) OVER (PARTITION BY stream_id, seg_id) AS hp FROM pw),
        sp AS (SELECT stream_id, seg_id, max(hp) / max(total) AS centroid, min(hz) FILTER (cum >= 0.85 * total) AS rolloff, stddev_pop(power) AS power_std, sqrt(sum(pow(hz - hp / total, 2) * power) / max(total)) AS bandwidth FROM ps GROUP BY 1, 2)
        SELECT stream_id, seg_id, {', '.join(r6(f'coalesce({c}, 0)', c) for c in ('centroid', 'rms', 'rolloff', 'zcr', 'power_std', 'bandwidth'))} FROM seg LEFT JOIN am USING (stream_id, seg_id) LEFT JOIN sp USING (stream_id, seg_id)""",
    "global_spectrum": sql("sig cen", "").rstrip() + f""", fx AS (SELECT stream_id, idx // 64 AS frame_id, idx % 64 AS p, x FROM cen QUALIFY count(*) OVER (PARTITION BY stream_id, idx // 64) = 64),
        pw AS (SELECT stream_id, frame_id, k, pow(sum(x * cos(2 * pi() * ((k * p) % 64) / 64)), 2) + pow(sum(x * sin(2 * pi() * ((k * p) % 64) / 64)), 2) AS power FROM fx, range(33) q(k) GROUP BY 1, 2, 3)
        SELECT stream_id, k, {r6('k * 125.0::DOUBLE', 'hz')}, {r6('avg(power)', 'power')} FROM pw WHERE k * 125 BETWEEN 500 AND 3000 GROUP BY 1, 2""",
    "nearest_center": sql("sig", f"""SELECT stream_id, idx, center, {r6('abs(x - c)', 'distance')} FROM sig, (VALUES (0, 20.0::DOUBLE), (1, 50.0), (2, 120.0)) v(center, c)
        QUALIFY row_number() OVER (PARTITION BY stream_id, idx ORDER BY abs(x - c), center) = 1"""),
    "kmeans1d_quartile": sql("sig", "").rstrip() + f""", o AS (SELECT stream_id, list_sort(list(x)) AS v, count(*) AS n FROM sig GROUP BY 1),
        r AS (SELECT stream_id, 0 AS turn, v[n // 4 + 1] AS c0, v[n * 2 // 4 + 1] AS c1, v[n * 3 // 4 + 1] AS c2 FROM o UNION ALL
          SELECT stream_id, turn + 1, coalesce(avg(x) FILTER (b = 0), any_value(c0)), coalesce(avg(x) FILTER (b = 1), any_value(c1)), coalesce(avg(x) FILTER (b = 2), any_value(c2)) FROM (
            SELECT r.*, x, CASE WHEN abs(x - c0) <= abs(x - c1) AND abs(x - c0) <= abs(x - c2) THEN 0 WHEN abs(x - c1) <= abs(x - c2) THEN 1 ELSE 2 END AS b FROM r JOIN sig USING (stream_id) WHERE turn < 20) GROUP BY stream_id, turn),
        f AS (SELECT stream_id, x, CASE WHEN abs(x - c0) <= abs(x - c1) AND abs(x - c0) <= abs(x - c2) THEN 0 WHEN abs(x - c1) <= abs(x - c2) THEN 1 ELSE 2 END AS b FROM r JOIN sig USING (stream_id) WHERE turn = 20),
        g AS (SELECT stream_id, b, avg(x) AS center, min(x) * 0.7::DOUBLE AS low, max(x) * 1.3::DOUBLE AS high, count(*) AS n FROM f GROUP BY 1, 2)
        SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY g.low + g.high) - 1 AS INTEGER) AS band, {r6('center')}, {r6('g.low', 'low')}, {r6('g.high', 'high')}, n FROM g""",
    "band_classify": sql("sig", f"""SELECT stream_id, idx, band AS label, {r6('coalesce(c, 0)', 'confidence')} FROM sig LEFT JOIN (
        SELECT stream_id, idx, band, 1 - abs(x - (lo + hi) / 2) / ((hi - lo) / 2) AS c FROM sig JOIN (VALUES (0, 0.0::DOUBLE, 30.0::DOUBLE), (1, 20.0, 80.0), (2, 70.0, 400.0)) v(band, lo, hi) ON x BETWEEN lo AND hi
        WHERE 1 - abs(x - (lo + hi) / 2) / ((hi - lo) / 2) > 0 QUALIFY row_number() OVER (PARTITION BY stream_id, idx ORDER BY c DESC, band) = 1) USING (stream_id, idx)"""),
    "leader_cluster": sql(_MEANS, "").rstrip() + """, s AS (SELECT stream_id, seg_id, round(mean_x, 6) AS v, row_number() OVER (PARTITION BY stream_id ORDER BY seg_id) AS rn FROM mean),
        r AS (SELECT stream_id, seg_id, rn, [v] AS means, [1] AS counts, 0 AS cluster_id FROM s WHERE rn = 1 UNION ALL
          SELECT stream_id, seg_id, rn, CASE WHEN best IS NULL THEN list_append(means, v) ELSE list_transform(means, lambda m, i: CASE WHEN i = best THEN m + (v - m) / (counts[best] + 1) ELSE m END) END,
            CASE WHEN best IS NULL THEN list_append(counts, 1) ELSE list_transform(counts, lambda c, i: CASE WHEN i = best THEN c + 1 ELSE c END) END, CAST(coalesce(best - 1, len(means)) AS INTEGER) FROM (
            SELECT stream_id, s.seg_id, s.rn, v, means, counts, CASE WHEN list_min(list_transform(means, lambda m: abs(m - v))) <= 12
              THEN list_position(list_transform(means, lambda m: abs(m - v)), list_min(list_transform(means, lambda m: abs(m - v)))) END AS best FROM r JOIN s USING (stream_id) WHERE s.rn = r.rn + 1))
        SELECT stream_id, seg_id, cluster_id, CASE WHEN cluster_id < 26 THEN chr(65 + cluster_id) ELSE 'Cluster_' || cluster_id END AS letter FROM r""",
    "majority_vote": sql("sig", f"""SELECT stream_id, idx, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS vote, {r6('greatest(n0, n1, n2) / (n0 + n1 + n2)', 'share')} FROM (
        SELECT stream_id, idx, {', '.join(f'count(*) FILTER (l = {i}) OVER w5 AS n{i}' for i in range(3))} FROM (SELECT *, least(floor(x / 40), 2) AS l FROM sig) WINDOW w5 AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""),
    "label_changes": sql("sig", f"SELECT stream_id, count(*) FILTER (l <> prev) AS n_changes, count(DISTINCT l) AS n_labels FROM (SELECT *, lag(l) OVER w AS prev FROM (SELECT *, least(floor(x / 40), 2) AS l FROM sig) {_W}) GROUP BY 1"),
    "fuse_events": sql(_EVENTS, f"SELECT stream_id, {r6('t')}, methods, {r6('score_sum')}, {r6('score_max')}, n_events FROM fus"),
    "priority_rank": sql(_EVENTS, f"SELECT stream_id, {r6('t')}, CASE WHEN n_methods >= 3 THEN 1 WHEN n_methods = 2 THEN 2 ELSE 3 END AS priority FROM fus WHERE strong"),
    "fused_boundaries": sql(_EVENTS + " len", "").rstrip() + """, e AS (SELECT stream_id, CAST(n - 1 AS DOUBLE) AS t FROM len),
        c AS (SELECT DISTINCT f.stream_id, f.t FROM fus f JOIN e USING (stream_id) WHERE strong AND n_methods >= 2 AND f.t BETWEEN 0 AND e.t UNION SELECT * FROM e),
        r AS (SELECT stream_id, 0.0::DOUBLE AS t FROM len UNION ALL SELECT r.stream_id, min(c.t) FROM r JOIN c ON c.stream_id = r.stream_id AND c.t >= r.t + 10 GROUP BY 1)
        SELECT * FROM r UNION SELECT * FROM e""",
    "hit_rate": sql(_PEAKS, f"""SELECT stream_id, count(*) AS n_truth, count(*) FILTER (hit) AS n_hit, {r6('count(*) FILTER (hit) / count(*)', 'hit_rate')} FROM (
        SELECT s.stream_id, EXISTS (SELECT 1 FROM pk p WHERE p.stream_id = s.stream_id AND abs(p.idx - s.idx) <= 3) AS hit FROM sco s WHERE s.idx % 50 = 0 AND s.idx > 0) GROUP BY 1"""),
    "silence_regions": sql("sig sil0 sil", "SELECT * FROM sil"),
    "keep_regions": sql("sig len sil0 sil", """SELECT stream_id, i0, i1 FROM (SELECT stream_id, coalesce(lag(b) OVER (PARTITION BY stream_id ORDER BY a, b), 0) AS i0, a AS i1
        FROM (SELECT stream_id, i0 AS a, i1 AS b FROM sil UNION ALL SELECT stream_id, n, n FROM len)) WHERE i1 > i0"""),
    "removed_stats": sql("sig len sil0 sil", f"""SELECT stream_id, n_regions, removed, {r6('100.0 * removed / n', 'percent')}, {r6('CASE WHEN n > removed THEN n / (n - removed) END', 'ratio')} FROM (
        SELECT stream_id, n, count(i0) AS n_regions, CAST(coalesce(sum(i1 - i0), 0) AS BIGINT) AS removed FROM len LEFT JOIN sil USING (stream_id) GROUP BY 1, 2)"""),
    "silence_removed": sql("sig sil0 sil", f"""SELECT stream_id, idx, {r6('x')}, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS out_idx FROM sig s
        WHERE NOT EXISTS (SELECT 1 FROM sil r WHERE r.stream_id = s.stream_id AND s.idx >= r.i0 AND s.idx < r.i1)"""),
    "peak_amplitude": sql("sig cen", f"SELECT stream_id, {r6('max(abs(x))', 'peak')}, {r6('max(abs(x)) * 0.02', 'limit')} FROM cen GROUP BY 1").replace("AS limit", 'AS "limit"'),
    "loud_channels": sql("feat", f"SELECT stream_id, count(*) FILTER (top <= 0.5) AS n_silent, {r6('max(top)', 'peak')} FROM (SELECT stream_id, greatest(abs(centroid / 50), abs(rms * 10), abs(rolloff * 10)) AS top FROM feat) GROUP BY 1"),
    "mask_reconstruct": sql(_LABELS, f"SELECT p.stream_id, p.idx, v.label, {r6('CASE WHEN l.label = v.label THEN p.x ELSE 0 END', 'x')} FROM sco p CROSS JOIN (VALUES (0), (1), (2)) v(label) LEFT JOIN lab l ON l.stream_id = p.stream_id AND p.idx >= l.i0 AND p.idx < l.i1"),
    "concat_reconstruct": sql(_LABELS, f"SELECT p.stream_id, l.label, row_number() OVER (PARTITION BY p.stream_id, l.label ORDER BY p.idx) - 1 AS out_idx, {r6('p.x', 'x')} FROM sco p JOIN lab l ON l.stream_id = p.stream_id AND p.idx >= l.i0 AND p.idx < l.i1"),
    "edge_fade": sql(_LABELS, f"""SELECT stream_id, seg_id, idx, {r6('x * CASE WHEN a < f THEN a / f WHEN a >= n - f THEN 1 - (a - (n - f)) / f ELSE 1 END', 'x')} FROM (
        SELECT p.stream_id, l.seg_id, p.idx, p.x, p.idx - l.i0 AS a, l.i1 - l.i0 AS n, least(4, (l.i1 - l.i0) // 2) AS f FROM sco p JOIN lab l ON l.stream_id = p.stream_id AND p.idx >= l.i0 AND p.idx < l.i1)"""),
    "crossfade_compact": sql(_LABELS, "").rstrip() + f""", n AS (SELECT *, i1 - i0 AS n, lag(i1 - i0) OVER w AS b, lead(i1 - i0) OVER w AS a FROM lab WINDOW w AS (PARTITION BY stream_id, label ORDER BY i0)),
        f AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE least(4, b // 2, n // 2) END AS f_in, CASE WHEN a IS NULL THEN 0 ELSE least(4, a // 2, n // 2) END AS f_out FROM n),
        o AS (SELECT *, coalesce(sum(n - f_out) OVER (PARTITION BY stream_id, label ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
        g AS (SELECT o.stream_id, label, CAST(start + p.idx - i0 AS BIGINT) AS out_idx, p.x * CASE WHEN p.idx - i0 < f_in THEN (p.idx - i0) / f_in ELSE 1 END * CASE WHEN p.idx - i0 >= n - f_out THEN 1 - (p.idx - i0 - (n - f_out)) / f_out ELSE 1 END AS y
          FROM o JOIN sco p ON o.stream_id = p.stream_id AND p.idx >= i0 AND p.idx < i1)
        SELECT stream_id, label, out_idx, {r6('sum(y)', 'x')} FROM g GROUP BY 1, 2, 3""",
    "crossfade_whole": sql(_LABELS, "").rstrip() + f""", n AS (SELECT *, i1 - i0 AS n, row_number() OVER (PARTITION BY stream_id, label ORDER BY i0) AS j FROM lab),
        r AS (SELECT stream_id, label, i0, i1, j, 0::BIGINT AS f, 0::BIGINT AS start, CAST(n AS BIGINT) AS acc FROM n WHERE j = 1
          UNION ALL SELECT n.stream_id, n.label, n.i0, n.i1, n.j, least(12, acc, n), acc - least(12, acc, n), acc + n - least(12, acc, n) FROM r JOIN n ON n.stream_id = r.stream_id AND n.label = r.label AND n.j = r.j + 1),
        g AS (SELECT r.stream_id, label, j, CAST(start + p.idx - i0 AS BIGINT) AS out_idx, p.x FROM r JOIN sco p ON r.stream_id = p.stream_id AND p.idx >= i0 AND p.idx < i1),
        h AS (SELECT g.stream_id, g.label, g.j, out_idx, any_value(x) * coalesce(product(CASE WHEN k.j = g.j THEN (out_idx - k.start) / k.f ELSE 1 - (out_idx - k.start) / k.f END), 1) AS y
          FROM g LEFT JOIN r k ON k.stream_id = g.stream_id AND k.label = g.label AND k.j >= g.j AND k.f > 0 AND out_idx >= k.start AND out_idx < k.start + k.f GROUP BY ALL)
        SELECT stream_id, label, out_idx, {r6('sum(y)', 'x')} FROM h GROUP BY 1, 2, 3""",
    "compact_masked": sql("sig", f"SELECT stream_id, idx, {r6('x')}, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS out_idx FROM sig WHERE x > 45"),
    "interleave_fixed": sql("trk short", "SELECT row_number() OVER (ORDER BY idx // 10, track, idx) - 1 AS out_idx, track, idx, x FROM trk, short WHERE idx < n"),
    "interleave_rounds": sql("trk short", """SELECT row_number() OVER (ORDER BY i0, track, idx) - 1 AS out_idx, track, idx, x FROM (SELECT track, idx, x, 120 * (idx // 120) + CASE WHEN idx % 120 < 13 THEN 0 WHEN idx % 120 < 20 THEN 13
        WHEN idx % 120 < 55 THEN 20 WHEN idx % 120 < 100 THEN 55 ELSE 100 END AS i0 FROM trk, short WHERE idx < n)"""),
    "interleave_random": sql("trk short", """SELECT row_number() OVER (ORDER BY round, track, idx) - 1 AS out_idx, track, idx, x FROM (SELECT * FROM trk, short WHERE idx < n) ASOF JOIN (
        SELECT round, sum(len) OVER (ORDER BY round) - len AS i0 FROM (SELECT round, 7 + (((round % 1000003) * 7919 + 104729) % 1000003 * 31337) % 1000033 % 13 AS len FROM short, range(n // 7 + 1) r(round))) ON idx >= i0"""),
    "loop_to_length": sql("trk", """SELECT CAST(track AS VARCHAR) AS stream_id, o AS idx, x FROM (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM trk)
        JOIN range((SELECT max(c) FROM (SELECT count(*) AS c FROM trk GROUP BY track))) r(o) ON o % n = idx"""),
    "int16_round_trip": sql("sig", f"""SELECT stream_id, idx, CAST(i AS INTEGER) AS i, {r6('i / 32768', 'y')} FROM (SELECT stream_id, idx, trunc(least(greatest(2 * ((x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p)) - 1, -1.0), 1.0) * 32767) AS i
        FROM sig WINDOW p AS (PARTITION BY stream_id))"""),
    "stream_sessions": """WITH e AS (SELECT event_type AS stream_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
        SELECT stream_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY stream_id, run""",
    "stream_gate": sql("sig fr8", "SELECT stream_id, frame_id, sqrt(list_sum(list_transform(samples, lambda v: v * v)) / 64) > 150 * pow(10.0, -9.0 / 20) AS present FROM fr8"),
}


def _median(size: int) -> str:
    """Edges are repeated outwards: the neighbour beyond an end is the end itself."""
    near = ", ".join(f"coalesce({'lag' if d < 0 else 'lead'}(x, {abs(d)}) OVER w, {'first' if d < 0 else 'last'}_value(x) OVER v)" for d in range(-(size // 2), size // 2 + 1) if d)
    return sql("sig", f"SELECT stream_id, idx, {r6(f'list_median([x, {near}])', 'x')} FROM sig {_W}, v AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


def _change(weights: dict[str, float], valid: str) -> str:
    limits = ", ".join(f"quantile_cont({c}, {q}) {valid} AS {e}_{c}" for c in weights for e, q in (("lo", 0.05), ("hi", 0.95)))
    scaled = ", ".join(f"least(greatest((f.{c} - lo_{c}) / (hi_{c} - lo_{c}), 0.0), 1.0) AS y_{c}" for c in weights)
    total = " + ".join(f"{w} * abs(y_{c} - coalesce(lag(y_{c}) OVER w, y_{c}))" for c, w in weights.items())
    masked = f"CASE WHEN valid THEN ({total}) / {sum(weights.values())} ELSE 0 END" if valid else f"({total}) / {sum(weights.values())}"
    flag = "valid, " if valid else ""
    return sql("feat", "").rstrip() + f""", lims AS (SELECT stream_id, {limits} FROM feat GROUP BY 1), ys AS (SELECT f.stream_id, f.idx, f.valid, {scaled} FROM feat f JOIN lims USING (stream_id)),
        ds AS (SELECT stream_id, idx, valid, {masked} AS d FROM ys {_W})
        SELECT stream_id, idx, {flag}{r6('sum(d) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0', 'score')} FROM ds"""


_SIDES = "WINDOW l AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 18 PRECEDING AND 4 PRECEDING), r AS (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN 4 FOLLOWING AND 18 FOLLOWING)"
_CELLS = f"SELECT *, list_sort(list_concat(coalesce(list(score) OVER l, []), coalesce(list(score) OVER r, []))) AS cells FROM sco {_SIDES}"
_CA = f"(SELECT *, (coalesce(sum(score) OVER l, 0) + coalesce(sum(score) OVER r, 0)) / (count(score) OVER l + count(score) OVER r) AS noise FROM sco {_SIDES})"

ORACLES |= {
    "median_filter3": _median(3),
    "median_filter5": _median(5),
    "change_score3": _change({"centroid": 2.0, "rms": 1.0, "rolloff": 1.5}, ""),
    "change_score6_masked": _change({"centroid": 2.0, "rms": 1.0, "rolloff": 1.5, "zcr": 1.0, "flux": 1.0, "bandwidth": 1.0}, "FILTER (valid)"),
    "cfar_ca": sql(_SCORE, f"SELECT stream_id, idx, {r6('noise * 3.5', 'threshold')} FROM {_CA}"),
    "cfar_os": sql(_SCORE, f"SELECT stream_id, idx, {r6('coalesce(cells[greatest(0, least(CAST(floor(len(cells) * 0.75) AS INTEGER), len(cells) - 1)) + 1], 0) * 3.5', 'threshold')} FROM ({_CELLS})"),
    "cfar_so": sql(_SCORE, f"""SELECT stream_id, idx, {r6('3.5 * CASE WHEN a > 0 AND b > 0 THEN least(a, b) ELSE greatest(a, b) END', 'threshold')}
        FROM (SELECT stream_id, idx, coalesce(avg(score) OVER l, 0) AS a, coalesce(avg(score) OVER r, 0) AS b FROM sco {_SIDES})"""),
    "cfar_percentile": sql(f"{_SCORE} thr", f"SELECT stream_id, idx, {r6('thr.threshold', 'threshold')} FROM thr"),
    "cfar_boundaries": sql(f"{_SCORE} len", "").rstrip() + f""", ca AS {_CA},
        cp AS (SELECT stream_id, idx FROM ca {_W} QUALIFY score > noise * 1.5 AND score >= lag(score) OVER w AND score >= lead(score) OVER w),
        c2 AS (SELECT * FROM cp QUALIFY count(*) OVER (PARTITION BY stream_id) > 1),
        g AS (SELECT stream_id, CAST(0 AS BIGINT) AS idx FROM len UNION ALL SELECT g.stream_id, min(p.idx) FROM g JOIN c2 p ON p.stream_id = g.stream_id AND p.idx >= g.idx + 10 GROUP BY 1)
        SELECT stream_id, CAST(idx AS DOUBLE) AS t FROM g UNION ALL SELECT stream_id, CAST(n - 1 AS DOUBLE) FROM len""",
    "cfar_sweep": sql(_SCORE, f"""SELECT stream_id, a AS alpha_percent, k AS k_percent, count(*) FILTER (score > a / 10.0 * noise) AS n_above, count(*) AS n_cells FROM (
        SELECT stream_id, k, score, coalesce(cells[greatest(0, least(CAST(floor(len(cells) * (k / 100.0)) AS INTEGER), len(cells) - 1)) + 1], 0) AS noise FROM ({_CELLS}), range(65, 96) ks(k)), range(25, 51) al(a) GROUP BY 1, 2, 3"""),
}
