"""The same queries as SQL, written for themselves."""

from __future__ import annotations

import re

from ..operators.protocol import PACED, TEST, TRAIN

BEATS = """beats AS (
  SELECT user_id AS sensor_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS beat_idx, event_id,
    (epoch_us(ts) - 1704067200000000) * 12 // 1000000000 AS sample,
    ['N', 'S', 'V', 'F', 'Q'][1 + (length(event_type) + ascii(event_type)) % 5] AS symbol
  FROM events)"""
RR0 = """rr0 AS (
  SELECT sensor_id, beat_idx - 1 AS rr_idx, sample / 360.0 AS t_s, (sample - lag(sample) OVER (PARTITION BY sensor_id ORDER BY beat_idx)) / 360.0 AS rr_s FROM beats)"""
RR = f"{BEATS}, {RR0}, rr AS (SELECT *, rr_s BETWEEN 0.2 AND 2.5 AS valid FROM rr0 WHERE rr_s IS NOT NULL)"
SIGNAL = """sig0 AS (
  SELECT user_id AS sensor_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events
), sig AS (
  SELECT sensor_id, i, CASE WHEN sensor_id % 3 = 0 AND i BETWEEN 10 AND 24 THEN 1.0 WHEN sensor_id % 2 = 0 AND i BETWEEN 30 AND 44 THEN NULL ELSE value END AS x FROM sig0)"""
HRV = """hrv AS (
  SELECT sensor_id, count(*) AS n_valid, avg(60 / rr_s) AS mean_hr, min(60 / rr_s) AS min_hr, max(60 / rr_s) AS max_hr, avg(ms) AS mean_rr_ms, stddev_samp(ms) AS sdnn_ms,
    sqrt(avg(d * d)) AS rmssd_ms, 100 * avg(CAST(abs(d) > 50 AS DOUBLE)) AS pnn50, stddev_samp(ms) / avg(ms) AS cv
  FROM (SELECT *, CASE WHEN rr_idx - lag(rr_idx) OVER w = 1 THEN ms - lag(ms) OVER w END AS d FROM (SELECT *, rr_s * 1000 AS ms FROM rr WHERE valid) WINDOW w AS (PARTITION BY sensor_id ORDER BY rr_idx))
  GROUP BY sensor_id)"""
MEDIAN = """series AS (
  SELECT sensor_id, list(rr_s ORDER BY rr_idx) AS a, len(list(rr_s)) AS n FROM rr GROUP BY sensor_id
), med AS (
  SELECT r.sensor_id, r.rr_idx, r.t_s, r.rr_s, r.valid, n,
    list_sort(list_transform(range(-h, h + 1), lambda d: a[1 + greatest(0, least(n - 1, r.rr_idx + d))]))[h + 1] AS local_median
  FROM rr r JOIN (SELECT *, (least(11, n - (1 - n % 2)) - 1) // 2 AS h FROM series) s ON r.sensor_id = s.sensor_id)"""


def af(rr_filter: str = "TRUE") -> str:
    return f"""{RR}, sized AS (
  SELECT sensor_id, count(*) AS n_beats, ceil(max(sample) / 360.0 / 30.0) AS n_windows FROM beats GROUP BY sensor_id
), picked AS (
  SELECT rr.sensor_id, floor(t_s / 30.0) AS w, rr_idx, rr_s FROM rr JOIN sized s ON rr.sensor_id = s.sensor_id WHERE n_beats >= 9 AND floor(t_s / 30.0) < n_windows AND {rr_filter}
), moves AS (
  SELECT *, lag(rr_s) OVER o AS b, lead(rr_s) OVER o AS a, min(rr_s) OVER (PARTITION BY sensor_id, w) AS lo, max(rr_s) OVER (PARTITION BY sensor_id, w) AS hi
  FROM picked WINDOW o AS (PARTITION BY sensor_id, w ORDER BY rr_idx)
), per AS (
  SELECT sensor_id, w, count(*) AS n_rr, sqrt(avg((rr_s - b) * (rr_s - b))) / avg(rr_s) AS nrmssd,
    avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST((rr_s > b AND rr_s > a) OR (rr_s < b AND rr_s < a) AS DOUBLE) END) AS turning
  FROM moves GROUP BY sensor_id, w HAVING count(*) >= 8
), bins AS (
  SELECT sensor_id, w, CASE WHEN hi > lo THEN least(15, floor((rr_s - lo) / (hi - lo) * 16)) ELSE 0 END AS bin, count(*) AS c FROM moves GROUP BY ALL
), ent AS (
  SELECT sensor_id, w, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(16.0) AS entropy FROM bins GROUP BY sensor_id, w
), af AS (
  SELECT p.sensor_id, CAST(p.w AS BIGINT) AS w, n_rr, nrmssd, entropy, turning,
    0.45 * greatest(0, least(1, (nrmssd - 0.05) / 0.20)) + 0.30 * greatest(0, least(1, (entropy - 0.55) / 0.35)) + 0.25 * greatest(0, least(1, (turning - 0.40) / 0.25)) AS score
  FROM per p JOIN ent e ON p.sensor_id = e.sensor_id AND p.w = e.w)"""


SEGMENTS = f"""{SIGNAL}, steps AS (
  SELECT *, x IS NOT NULL AS ok, CASE WHEN i = 0 THEN x - x ELSE abs(x - lag(x) OVER (PARTITION BY sensor_id ORDER BY i)) END AS step, i // 5 AS block FROM sig
), scaled AS (
  SELECT s.*, scale FROM steps s JOIN (SELECT sensor_id, quantile_cont(CASE WHEN i > 0 THEN step END, 0.5) AS scale FROM steps GROUP BY sensor_id) m ON s.sensor_id = m.sensor_id
), flat AS (
  SELECT *, NOT ok OR avg(CAST(NOT ok OR coalesce(step < 0.02 * scale, NOT ok) AS DOUBLE)) OVER (PARTITION BY sensor_id, block) > 0.9 OR coalesce(scale <= 0, TRUE) AS bad FROM scaled
), r1 AS (
  SELECT *, sum(CASE WHEN bad IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY i) AS run FROM (SELECT *, lag(bad) OVER (PARTITION BY sensor_id ORDER BY i) AS p FROM flat)
), r2 AS (
  SELECT sensor_id, run, min(i) AS a, max(i) + 1 AS b, NOT bad OR max(i) + 1 - min(i) < 10 AS usable, bool_or(NOT ok) AS gap FROM r1 GROUP BY sensor_id, run, bad
), r3 AS (
  SELECT *, CASE WHEN NOT usable THEN CASE WHEN gap THEN 'nan' ELSE 'flatline' END END AS reason FROM r2
), r4 AS (
  SELECT *, sum(CASE WHEN usable IS NOT DISTINCT FROM pu AND reason IS NOT DISTINCT FROM pr AND pu IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY a) AS part
  FROM (SELECT *, lag(usable) OVER (PARTITION BY sensor_id ORDER BY a) AS pu, lag(reason) OVER (PARTITION BY sensor_id ORDER BY a) AS pr FROM r3)
), seg AS (
  SELECT sensor_id, usable, reason, min(a) AS start, max(b) AS "end" FROM r4 GROUP BY sensor_id, part, usable, reason)"""


def windowed(n: int, where: str = "TRUE") -> str:
    return f"""{SIGNAL}, win AS (
  SELECT * FROM (SELECT *, i // {n} AS w, count(*) OVER (PARTITION BY sensor_id, i // {n}) AS n_in FROM sig WHERE {where}) WHERE n_in >= {n // 2})"""


KURT = "CASE WHEN count(x) >= 8 AND stddev_pop(x) > 0 THEN kurtosis(x) ELSE 0 END"
STATS = windowed(20, "x IS NOT NULL") + """, st AS (
  SELECT *, abs(x - lag(x) OVER (PARTITION BY sensor_id, w ORDER BY i)) AS step, min(x) OVER (PARTITION BY sensor_id, w) AS lo, max(x) OVER (PARTITION BY sensor_id, w) AS hi FROM win
), sc AS (SELECT sensor_id, w, quantile_cont(step, 0.5) AS scale FROM st GROUP BY sensor_id, w), stats AS (
  SELECT st.sensor_id, st.w, count(*) AS n, quantile_cont(x, 0.99) - quantile_cont(x, 0.01) AS amplitude, CASE WHEN any_value(scale) > 0 THEN avg(CAST(step < 0.05 * scale AS DOUBLE)) ELSE 1.0 END AS flat,
    avg(CAST(x - lo <= 1e-6 * (hi - lo) OR hi - x <= 1e-6 * (hi - lo) AS DOUBLE)) AS saturated
  FROM st JOIN sc ON st.sensor_id = sc.sensor_id AND st.w = sc.w GROUP BY st.sensor_id, st.w)"""
INSTABILITY = windowed(30) + """, subs AS (
  SELECT sensor_id, w, (i % 30) // 10 AS s, quantile_cont(x, 0.975) - quantile_cont(x, 0.025) AS a FROM win GROUP BY sensor_id, w, (i % 30) // 10 HAVING count(*) = 10
), mids AS (SELECT sensor_id, w, quantile_cont(a, 0.5) AS m, count(a) AS k FROM subs GROUP BY sensor_id, w), inst AS (
  SELECT s.sensor_id, s.w, CASE WHEN k < 2 THEN 0.0 WHEN m <= 0 THEN 1.0 ELSE greatest(0, least(1, quantile_cont(abs(a - m), 0.5) / nullif(m, 0))) END AS instability
  FROM subs s JOIN mids ON s.sensor_id = mids.sensor_id AND s.w = mids.w GROUP BY s.sensor_id, s.w, m, k)"""
ARTEFACTS = INSTABILITY + f""", ku AS (SELECT sensor_id, w, {KURT} AS k FROM win GROUP BY sensor_id, w), art AS (
  SELECT ku.sensor_id, ku.w, 0.55 * greatest(0, least(1, 1 - k / 5)) + 0.45 * greatest(0, least(1, coalesce(instability, 0) / 0.5)) AS score
  FROM ku LEFT JOIN inst ON ku.sensor_id = inst.sensor_id AND ku.w = inst.w)"""
CLASS = "CASE symbol WHEN 'N' THEN 0 WHEN 'S' THEN 1 WHEN 'V' THEN 2 WHEN 'F' THEN 3 ELSE 4 END"
LABELLED = f"{BEATS}, lab AS (SELECT {CLASS} AS y_true, CAST(event_id % 5 AS INT) AS y_pred FROM beats)"
SHAPES = "sh AS (SELECT label AS grp, vec_id AS beat_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings)"
POINTS = SHAPES + ", pts AS (SELECT grp, beat_id, unnest(w) AS v, unnest(range(0, len(w))) AS pos FROM sh)"


def corr_with(name: str, template: str) -> str:
    """Correlation of every beat with its group's template table (grp, pos, v)."""
    return f"""{name} AS (
  SELECT p.grp, p.beat_id, coalesce(sum((p.v - mp) * (t.v - mt)) / nullif(sqrt(sum((p.v - mp) ** 2) * sum((t.v - mt) ** 2)), 0), 0) AS corr
  FROM (SELECT *, avg(v) OVER (PARTITION BY beat_id) AS mp FROM pts) p JOIN (SELECT *, avg(v) OVER (PARTITION BY grp) AS mt FROM {template}) t ON p.grp = t.grp AND p.pos = t.pos
  GROUP BY p.grp, p.beat_id)"""


TEMPLATE = f"""{POINTS}, t0 AS (SELECT grp, pos, quantile_cont(v, 0.5) AS v FROM pts GROUP BY grp, pos), {corr_with("c0", "t0")},
use AS (SELECT grp, count(*) AS n, count_if(corr >= 0.8) AS k FROM c0 GROUP BY grp), t1 AS (
  SELECT p.grp, pos, quantile_cont(v, 0.5) AS v FROM pts p JOIN c0 ON p.beat_id = c0.beat_id WHERE corr >= 0.8 GROUP BY p.grp, pos
), tem AS (
  SELECT t0.grp, CASE WHEN k >= greatest(5, 0.2 * n) THEN k ELSE n END AS n_used, t0.pos, CASE WHEN k >= greatest(5, 0.2 * n) THEN t1.v ELSE t0.v END AS v
  FROM t0 JOIN use ON t0.grp = use.grp LEFT JOIN t1 ON t0.grp = t1.grp AND t0.pos = t1.pos)"""
HISTOGRAM = """sizes AS (SELECT sensor_id, greatest(1, ceil({scale} * max(sample) / 360.0 / {bin})) AS n_bins FROM beats GROUP BY sensor_id), every AS (
  SELECT sensor_id, n_bins, unnest(range(0, CAST(n_bins AS BIGINT))) AS bin FROM sizes
), counts AS (
  SELECT b.sensor_id, least(floor({scale} * sample / 360.0 / {bin}), n_bins - 1) AS bin, count(*) AS n FROM beats b JOIN sizes s ON b.sensor_id = s.sensor_id
  WHERE symbol = 'V' AND {scale} * sample / 360.0 <= n_bins * {bin} GROUP BY ALL
), hist AS (SELECT e.sensor_id, CAST(e.bin AS INT) AS bin, {bin} AS bin_s, coalesce(n, 0) AS n FROM every e LEFT JOIN counts c ON e.sensor_id = c.sensor_id AND e.bin = c.bin)"""


def part_of(name: str, low: int, high: int) -> str:
    """Energy, template and correlation of a stretch of every beat's window, as table ``name`` (beat_id, energy, corr)."""
    names = {"sh", "pts", "t0", "t1", "c0", "c1", "use", "tem"}
    sql = TEMPLATE.replace(SHAPES, f"sh AS (SELECT grp, beat_id, w[{low + 1}:{high}] AS w FROM win)") + ", " + corr_with("c1", "tem")
    for n in names:
        sql = re.sub(rf"\b{n}\b", f"{name}_{n}", sql)
    return sql + f""", {name} AS (SELECT c.beat_id, corr, energy FROM {name}_c1 c JOIN (SELECT beat_id, sum(v * v) AS energy FROM {name}_pts GROUP BY beat_id) e ON c.beat_id = e.beat_id)"""


FEATURES = f"""{RR}, {MEDIAN}, win AS (
  SELECT b.sensor_id AS grp, b.event_id AS beat_id, b.beat_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w
  FROM beats b JOIN embeddings e ON e.vec_id = b.event_id % (SELECT max(vec_id) + 1 FROM embeddings)
), {part_of("q", 25, 41)}, {part_of("p", 4, 22)}, wp AS (SELECT beat_id, unnest(w) AS v, unnest(range(0, len(w))) AS pos FROM win
), sl AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE v - lag(v) OVER (PARTITION BY beat_id ORDER BY pos) END AS d FROM wp
), en AS (SELECT beat_id, pos, sum(d * d) OVER (PARTITION BY beat_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 AS e FROM sl
), tp AS (SELECT *, max(CASE WHEN pos = 31 THEN e END) OVER (PARTITION BY beat_id) AS top FROM en
), wd AS (
  SELECT beat_id, CASE WHEN max(top) > 0 THEN 1000 * (coalesce(min(pos) FILTER (WHERE pos BETWEEN 31 AND 43 AND e <= 0.15 * top), 43) - coalesce(max(pos) FILTER (WHERE pos BETWEEN 19 AND 31 AND e <= 0.15 * top), 19)) / 96.0 END AS width
  FROM tp GROUP BY beat_id
), f AS (
  SELECT grp, win.beat_id, beat_idx, abs(w[32]) AS r, width, q.corr AS qc, q.energy AS qe, p.corr AS pc, p.energy AS pe FROM win JOIN wd ON wd.beat_id = win.beat_id JOIN q ON q.beat_id = win.beat_id JOIN p ON p.beat_id = win.beat_id
), md AS (SELECT grp, quantile_cont(r, 0.5) AS mr, quantile_cont(width, 0.5) AS mw, quantile_cont(qe, 0.5) AS mq, quantile_cont(pe, 0.5) AS mp FROM f GROUP BY grp
), rel AS (SELECT sensor_id, rr_idx, CASE WHEN local_median > 0 THEN rr_s / local_median END AS rel FROM med)
SELECT f.grp AS sensor_id, f.beat_idx, round(qc, 6) AS template_corr, round(width, 6) AS qrs_width_ms, round(r, 6) AS r_amplitude, round(CASE WHEN mq > 0 THEN qe / mq ELSE qe END, 6) AS qrs_energy,
  round(a.rel, 6) AS pre_rr_ratio, round(z.rel, 6) AS post_rr_ratio, round(CASE WHEN mr > 0 THEN r / mr END, 6) AS r_amp_ratio, round(CASE WHEN mw > 0 THEN width / mw END, 6) AS width_ratio,
  round(CASE WHEN mp > 0 THEN pe / mp ELSE 0 END, 6) AS p_energy_ratio, round(pc, 6) AS p_corr
FROM f JOIN md ON md.grp = f.grp LEFT JOIN rel a ON a.sensor_id = f.grp AND a.rr_idx = f.beat_idx - 1 LEFT JOIN rel z ON z.sensor_id = f.grp AND z.rr_idx = f.beat_idx"""


def rounding(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def greedy(detected: str, reference: str) -> str:
    """One detection a step and sensor: it takes the closest reference that is within 540 samples and still free. ``pairs`` has
    the matched numbers and ``matches`` the samples of both sides, null where nothing fits."""
    return f"""{BEATS}, det AS (SELECT sensor_id, sample, row_number() OVER (PARTITION BY sensor_id ORDER BY sample) AS k FROM beats WHERE {detected}),
  ref AS (SELECT sensor_id, sample, row_number() OVER (PARTITION BY sensor_id ORDER BY sample) AS j FROM beats WHERE {reference}),
  refs AS (SELECT sensor_id, list({{'j': j, 's': sample}} ORDER BY j) AS r FROM ref GROUP BY sensor_id),
  walk AS (
    SELECT DISTINCT sensor_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM det
    UNION ALL
    SELECT w.sensor_id, d.k, list_append(w.used, coalesce(list_sort(list_transform(list_filter(coalesce(r, []), lambda x: abs(x.s - d.sample) <= 540 AND NOT list_contains(w.used, x.j)), lambda x: {{'a': abs(x.s - d.sample), 'j': x.j}}))[1].j, -1))
    FROM walk w JOIN det d ON d.sensor_id = w.sensor_id AND d.k = w.k + 1 LEFT JOIN refs ON refs.sensor_id = w.sensor_id
  ), pairs AS (SELECT sensor_id, k, used[k] AS j FROM walk WHERE k > 0 AND used[k] > 0
  ), matches AS (
    SELECT det.sensor_id, det.sample AS det_sample, ref.sample AS ref_sample FROM det LEFT JOIN pairs p ON p.sensor_id = det.sensor_id AND p.k = det.k LEFT JOIN ref ON ref.sensor_id = p.sensor_id AND ref.j = p.j
    UNION ALL SELECT sensor_id, NULL, sample FROM ref WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.sensor_id = ref.sensor_id AND p.j = ref.j))"""


NORMAL_AND_EARLY = greedy("symbol = 'N'", "symbol = 'S'")
SCORES = """sc AS (
  SELECT sensor_id, count(det_sample - ref_sample) AS tp, count_if(ref_sample IS NULL) AS fp, count_if(det_sample IS NULL) AS fn,
    avg(abs(det_sample - ref_sample) / 0.36) AS mean_error_ms, stddev_pop(abs(det_sample - ref_sample) / 0.36) AS std_error_ms FROM matches GROUP BY sensor_id)"""
TRANSFER = f"""{greedy("symbol = 'N'", "symbol IN ('S', 'V')")}, lb AS (SELECT sensor_id, sample, max(CAST(symbol = 'V' AS INT)) AS y FROM beats WHERE symbol IN ('S', 'V') GROUP BY ALL),
  tr AS (SELECT m.sensor_id, det_sample AS sample, coalesce(y, 0) AS y FROM matches m LEFT JOIN lb ON lb.sensor_id = m.sensor_id AND lb.sample = m.ref_sample WHERE det_sample IS NOT NULL)"""
HRV_COLUMNS = ("mean_hr", "min_hr", "max_hr", "mean_rr_ms", "sdnn_ms", "rmssd_ms", "pnn50", "cv")
AF_COLUMNS = ("nrmssd", "entropy", "turning", "score")
EXCLUDED = "NOT EXISTS (SELECT 1 FROM beats x WHERE x.sensor_id = rr.sensor_id AND x.symbol = 'V' AND x.beat_idx IN (rr.rr_idx, rr.rr_idx + 1))"

ORACLES = {
    "sensor_overview": f"""WITH {af()}, {HRV} SELECT v.sensor_id, n_beats, round(valid_share, 6) AS valid_share, {rounding("mean_hr", "sdnn_ms", "rmssd_ms", "pnn50")}, round(burden, 6) AS burden
      FROM (SELECT sensor_id, count(*) + 1 AS n_beats, avg(CAST(valid AS DOUBLE)) AS valid_share FROM rr GROUP BY sensor_id) v LEFT JOIN hrv ON hrv.sensor_id = v.sensor_id
      LEFT JOIN (SELECT sensor_id, avg(CAST(score >= 0.5 AS DOUBLE)) AS burden FROM af GROUP BY sensor_id) a ON a.sensor_id = v.sensor_id""",
    "rr_intervals": f"WITH {RR} SELECT sensor_id, rr_idx, {rounding('t_s', 'rr_s')}, valid FROM rr",
    "hrv_metrics": f"WITH {RR}, {HRV} SELECT sensor_id, n_valid, {rounding(*HRV_COLUMNS)} FROM hrv",
    "heart_rate_trend": f"""WITH {RR}, ends AS (SELECT sensor_id, ceil(max(t_s) / 60) AS n FROM rr GROUP BY sensor_id), every AS (SELECT sensor_id, unnest(range(0, CAST(n AS BIGINT))) AS w FROM ends),
      means AS (SELECT sensor_id, floor(t_s / 60) AS w, avg(60 / rr_s) AS mean_hr FROM rr WHERE valid GROUP BY ALL) SELECT e.sensor_id, e.w, round(mean_hr, 6) AS mean_hr FROM every e LEFT JOIN means m ON e.sensor_id = m.sensor_id AND e.w = m.w""",
    "local_median_rr": f"WITH {RR}, {MEDIAN} SELECT sensor_id, rr_idx, round(local_median, 6) AS local_median FROM med",
    "ectopic_candidates": f"""WITH {RR}, {MEDIAN}, q AS (SELECT *, rr_s / nullif(local_median, 0) AS r FROM med), l AS (SELECT *, lead(r) OVER (PARTITION BY sensor_id ORDER BY rr_idx) AS next_r FROM q)
      SELECT sensor_id, rr_idx, {rounding("t_s", "r", "next_r")} FROM l WHERE n >= 5 AND valid AND r < 0.8 AND next_r > 1.15""",
    "pre_post_ratio": f"WITH {RR}, {MEDIAN} SELECT sensor_id, rr_idx + 1 AS beat_idx, round(rr_s / nullif(local_median, 0), 6) AS pre, round(lead(rr_s) OVER (PARTITION BY sensor_id ORDER BY rr_idx) / nullif(local_median, 0), 6) AS post FROM med",
    "af_windows": f"WITH {af()} SELECT sensor_id, w, n_rr, {rounding(*AF_COLUMNS)} FROM af",
    "ectopic_exclusion": f"WITH {af(EXCLUDED)} SELECT sensor_id, w, n_rr, round(nrmssd, 6) AS nrmssd FROM af",
    "af_burden": f"WITH {af()} SELECT sensor_id, count(*) AS n_windows, round(avg(CAST(score >= 0.5 AS DOUBLE)), 6) AS burden FROM af GROUP BY sensor_id",
    "af_episodes": f"""WITH {af()}, f AS (SELECT *, score >= 0.5 AS is_af, row_number() OVER (PARTITION BY sensor_id ORDER BY w) - row_number() OVER (PARTITION BY sensor_id, score >= 0.5 ORDER BY w) AS g FROM af)
      SELECT sensor_id, min(w) * 30.0::DOUBLE AS start_s, (max(w) + 1) * 30.0::DOUBLE AS end_s, count(*) AS n_windows FROM f WHERE is_af GROUP BY sensor_id, g""",
    "dedupe_peaks": f"""WITH RECURSIVE {BEATS}, d AS (SELECT DISTINCT sensor_id, sample FROM beats), k AS (
      SELECT sensor_id, min(sample) AS sample FROM d GROUP BY sensor_id UNION ALL
      SELECT sensor_id, nxt FROM (SELECT k.sensor_id, (SELECT min(d.sample) FROM d WHERE d.sensor_id = k.sensor_id AND d.sample >= k.sample + 72) AS nxt FROM k) WHERE nxt IS NOT NULL) SELECT sensor_id, sample FROM k""",
    "rr_thinning": f"WITH {RR}, t AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY sensor_id) // 20) AS step, row_number() OVER (PARTITION BY sensor_id ORDER BY rr_idx) - 1 AS p FROM rr) SELECT sensor_id, rr_idx, round(rr_s * 1000, 6) AS rr_ms FROM t WHERE p % step = 0",
    "dropout_segments": f'WITH {SEGMENTS} SELECT sensor_id, usable, reason, start, "end" FROM seg',
    "usable_segments": f'WITH {SEGMENTS} SELECT sensor_id, start, "end" FROM seg WHERE usable AND "end" - start >= 10',
    "coverage": f"""WITH {SEGMENTS} SELECT sensor_id, CAST(sum("end" - start) AS BIGINT) AS total, CAST(coalesce(sum("end" - start) FILTER (WHERE usable), 0) AS BIGINT) AS usable, count_if(NOT usable) AS n_gaps,
      round(coalesce(sum("end" - start) FILTER (WHERE usable), 0) / sum("end" - start), 6) AS fraction FROM seg GROUP BY sensor_id""",
    "kurtosis_windows": f"WITH {windowed(20)} SELECT sensor_id, w, round({KURT}, 6) AS kurtosis FROM win GROUP BY sensor_id, w",
    "window_quality_stats": f"WITH {STATS} SELECT sensor_id, w, n, {rounding('amplitude', 'flat', 'saturated')} FROM stats",
    # a window of at most 64 samples is one segment: its spectrum by a table of cosines and sines
    "welch_quality": f"""WITH {STATS.replace("// 20", "// 30").replace(">= 10", ">= 15")}, v AS (
      SELECT sensor_id, i // 30 AS w, x, row_number() OVER o - 1 AS j, count(*) OVER (PARTITION BY sensor_id, i // 30) AS n, avg(x) OVER (PARTITION BY sensor_id, i // 30) AS m
      FROM sig WHERE x IS NOT NULL WINDOW o AS (PARTITION BY sensor_id, i // 30 ORDER BY i)
    ), twiddle AS (
      SELECT n, k, j, cos(2 * pi() * j * k / n) AS c, sin(2 * pi() * j * k / n) AS s, 0.5 - 0.5 * cos(2 * pi() * j / n) AS hann
      FROM range(16, 31) a(n), range(0, 16) b(k), range(0, 30) d(j) WHERE k <= n // 2 AND j < n
    ), spectrum AS (
      SELECT sensor_id, w, n, k, k * 10.0 / n AS f, (sum((x - m) * hann * c) ** 2 + sum((x - m) * hann * s) ** 2) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p
      FROM v JOIN twiddle USING (n, j) GROUP BY sensor_id, w, n, k
    ), areas AS (
      SELECT sensor_id, w, f, (p + lead(p) OVER o) / 2 * (lead(f) OVER o - f) AS area, f >= 0.5 AND lead(f) OVER o <= 40 AS inside FROM spectrum WINDOW o AS (PARTITION BY sensor_id, w ORDER BY k)
    ), power AS (
      SELECT sensor_id, w, least(1, coalesce(sum(area) FILTER (WHERE inside), 0) / nullif(sum(area), 0)) AS power FROM areas GROUP BY sensor_id, w
    ), q AS (
      SELECT sensor_id, w, n, amplitude, flat, saturated, coalesce(power, 0) AS power FROM stats LEFT JOIN power USING (sensor_id, w)
    ), r AS (
      SELECT *, greatest(0, least(1, CASE WHEN amplitude > 0 THEN power * (1 - flat) * (1 - least(1, 5 * saturated)) ELSE 0 END)) AS sqi FROM q
    ) SELECT sensor_id, w, n, {rounding('amplitude', 'flat', 'saturated', 'power', 'sqi')}, sqi >= 0.5 AS is_usable FROM r""",
    "dominant_peaks": f"""WITH {SIGNAL}, m AS (
      SELECT sensor_id, i, x FROM (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS b FROM sig WHERE x IS NOT NULL WINDOW o AS (PARTITION BY sensor_id ORDER BY i)) WHERE x > a AND x > b
    ), o AS (
      SELECT sensor_id, list(i ORDER BY x DESC, i) AS c FROM m GROUP BY sensor_id
    ), k AS (
      SELECT sensor_id, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(c, lambda v: [v])),
        lambda kept, v: CASE WHEN len(list_filter(kept, lambda p: abs(p - v[1]) < 5)) > 0 THEN kept ELSE list_concat(kept, v) END)) AS i FROM o
    ) SELECT sensor_id, i AS sample, round(x, 6) AS height FROM k JOIN m USING (sensor_id, i)""",
    "refractory_pass": f"""WITH {SIGNAL}, m AS (
      SELECT sensor_id, i, x FROM (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS b FROM sig WHERE x IS NOT NULL WINDOW o AS (PARTITION BY sensor_id ORDER BY i)) WHERE x > a AND x > b
    ), o AS (
      SELECT sensor_id, list([{{'i': i, 'x': x}}] ORDER BY i) AS c FROM m GROUP BY sensor_id
    ), k AS (
      SELECT sensor_id, unnest(list_reduce(c, lambda kept, p: CASE WHEN p[1].i - kept[-1].i >= 5 THEN list_concat(kept, p) WHEN p[1].x > kept[-1].x THEN list_concat(kept[:-2], p) ELSE kept END)) AS p FROM o
    ) SELECT sensor_id, p.i AS sample, round(p.x, 6) AS height FROM k""",
    "channel_lookup": """WITH c AS (SELECT user_id AS sensor_id, user_id % 10 AS record_id, count(*) AS n_samples FROM events WHERE user_id % 4 = 1 GROUP BY user_id)
      SELECT record_id, min(sensor_id) AS sensor_id, arg_min(n_samples, sensor_id) AS n_samples FROM c GROUP BY record_id""",
    "result_tree": f"""WITH {af()}, {HRV}, b AS (SELECT sensor_id, count(*) AS n_windows FROM af GROUP BY sensor_id),
      v AS (SELECT sensor_id, count_if(symbol = 'V') AS n_events, max(sample) / 360.0 AS d FROM beats GROUP BY sensor_id)
      SELECT v.sensor_id % 10 AS record_id, count(*) AS n_channels, round(max(d), 6) AS duration_s, min(v.sensor_id) AS first_sensor, arg_min(round_even(mean_hr, 1), v.sensor_id) AS first_hr,
        CAST(coalesce(sum(n_valid), 0) AS BIGINT) AS n_valid, CAST(coalesce(sum(n_windows), 0) AS BIGINT) AS n_windows, CAST(sum(n_events) AS BIGINT) AS n_events, string_agg(v.sensor_id, ',' ORDER BY v.sensor_id) AS sensors
      FROM v LEFT JOIN hrv USING (sensor_id) LEFT JOIN b USING (sensor_id) GROUP BY v.sensor_id % 10""",
    "clock_window_samples": f"""WITH {SIGNAL}, c AS (SELECT DISTINCT sensor_id, sensor_id % 10 AS record_id, (sensor_id % 5 - 2) * 0.25::DOUBLE AS s FROM sig), o AS (SELECT *, s - min(s) OVER (PARTITION BY record_id) AS e FROM c)
      SELECT record_id, sensor_id, min(i) AS start, CAST(count(*) AS INT) AS n, CAST(count(x) AS INT) AS n_finite, round(coalesce(sum(x), 0), 6) AS total
      FROM sig JOIN o USING (sensor_id) WHERE e + i / 10.0::DOUBLE BETWEEN 1.25 AND 4.75 GROUP BY record_id, sensor_id""",
    "score_table": f"""WITH RECURSIVE {NORMAL_AND_EARLY}, {SCORES}, p AS (
      SELECT *, 100.0::DOUBLE * tp / nullif(tp + fn, 0) AS se, 100.0::DOUBLE * tp / nullif(tp + fp, 0) AS ppv, 100.0::DOUBLE * (2 * tp) / nullif(2 * tp + fp + fn, 0) AS f1 FROM sc)
      SELECT sensor_id, format('{{}}: tp {{}} fp {{}} fn {{}} se {{}} ppv {{}} f1 {{}} ms {{}}', sensor_id, tp, fp, fn, {", ".join(f"coalesce(printf('%.2f%%', round_even({c}, 2)), '-')" for c in ("se", "ppv", "f1"))},
        coalesce(printf('%.1f', round_even(mean_error_ms, 1)), '-')) AS line FROM p""",
    "confusion_table": f"""WITH {LABELLED}, c AS (SELECT t.r AS t, p.r AS p, (SELECT count(*) FROM lab WHERE y_true = t.r AND y_pred = p.r) AS n FROM range(5) t(r), range(5) p(r))
      SELECT CAST(t AS INT) AS y_true, rpad(['N', 'S', 'V', 'F', 'Q'][t + 1], 4, ' ') || string_agg(lpad(CAST(n AS VARCHAR), 8, ' '), '' ORDER BY p) AS line FROM c GROUP BY t HAVING sum(n) > 0""",
    "baseline_removal": f"""WITH {SIGNAL}, z AS (SELECT sensor_id, i, coalesce(x, 0.0) AS x FROM sig), a AS (
      SELECT sensor_id, i, x, list_sort([lag(x, 1, 0.0) OVER o, x, lead(x, 1, 0.0) OVER o])[2] AS m FROM z WINDOW o AS (PARTITION BY sensor_id ORDER BY i)
    ) SELECT sensor_id, i, round(x - list_sort([{", ".join(f"{w}(m, {d}, 0.0) OVER o" for w in ("lag", "lead") for d in (1, 2, 3))}, m])[4], 6) AS x FROM a WINDOW o AS (PARTITION BY sensor_id ORDER BY i)""",
    "amplitude_instability": f"WITH {INSTABILITY} SELECT sensor_id, w, round(instability, 6) AS instability FROM inst",
    "artifact_windows": f"WITH {ARTEFACTS} SELECT sensor_id, w, round(score, 6) AS score FROM art",
    "beats_in_artifact": f"WITH {ARTEFACTS} SELECT s.sensor_id, s.i AS sample, coalesce(score >= 0.5, FALSE) AS in_artifact FROM sig s LEFT JOIN art a ON a.sensor_id = s.sensor_id AND a.w = s.i // 30",
    "rank_sensors": f"WITH {STATS}, q AS (SELECT sensor_id, quantile_cont(1 - flat, 0.5) AS sqi FROM stats GROUP BY sensor_id) SELECT sensor_id, round(sqi, 6) AS sqi, row_number() OVER (ORDER BY sqi DESC, sensor_id) AS rank FROM q",
    "overlap_window": """WITH c AS (SELECT user_id AS s, user_id % 10 AS record_id, min(epoch_us(ts)) - 1704067200000000 AS a, max(epoch_us(ts)) - 1704067200000000 AS b FROM events GROUP BY user_id)
      SELECT record_id, count(*) AS n_channels, min(a) AS origin_us, max(b) AS end_us, CASE WHEN min(b) > max(a) THEN max(a) ELSE 0 END AS overlap_start, CASE WHEN min(b) > max(a) THEN min(b) ELSE 0 END AS overlap_end FROM c GROUP BY record_id""",
    "channel_slice": f"WITH {SIGNAL} SELECT sensor_id, i - 12 AS i, round(x, 6) AS x, 1200000 AS start_us FROM sig WHERE i >= 12 AND i < 48 AND x IS NOT NULL",
    "rhythm_intervals": f"""WITH {BEATS} SELECT sensor_id, sample AS start, coalesce(lead(sample) OVER (PARTITION BY sensor_id ORDER BY sample, symbol), n) AS "end", symbol AS label
      FROM (SELECT *, max(sample) OVER (PARTITION BY sensor_id) + 1 AS n FROM beats) WHERE symbol IN ('N', 'V')""",
    "rhythm_mask": f"""WITH {BEATS}, t AS (SELECT sensor_id, sample, max(symbol) AS label FROM beats WHERE symbol IN ('N', 'V') GROUP BY sensor_id, sample)
      SELECT b.sensor_id, b.sample, coalesce(t.label = 'V', FALSE) AS inside FROM beats b ASOF LEFT JOIN t ON b.sensor_id = t.sensor_id AND b.sample >= t.sample""",
    "artifact_mask": f"WITH {ARTEFACTS} SELECT s.sensor_id, s.i, coalesce(score >= 0.5, FALSE) AS masked FROM sig s LEFT JOIN art a ON a.sensor_id = s.sensor_id AND a.w = s.i // 30",
    "greedy_match": f"WITH RECURSIVE {NORMAL_AND_EARLY} SELECT * FROM matches",
    "detection_scores": f"WITH RECURSIVE {NORMAL_AND_EARLY}, {SCORES} SELECT sensor_id, tp, fp, fn, {rounding('mean_error_ms', 'std_error_ms')} FROM sc",
    "detection_gross": f"WITH RECURSIVE {NORMAL_AND_EARLY}, {SCORES} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(mean_error_ms), 6) AS mean_error_ms, round(avg(std_error_ms), 6) AS std_error_ms FROM sc",
    "bsqi": f"WITH RECURSIVE {NORMAL_AND_EARLY} SELECT sensor_id, round(count(det_sample - ref_sample) / count(*), 6) AS bsqi FROM matches GROUP BY sensor_id",
    "label_transfer": f"WITH RECURSIVE {TRANSFER} SELECT sensor_id, sample, y FROM tr",
    "missed_beats": f"""WITH RECURSIVE {TRANSFER} SELECT w.sensor_id, CAST(greatest(0, want - coalesce(got, 0)) AS BIGINT) AS n_missed FROM (SELECT sensor_id, count_if(symbol = 'V') AS want FROM beats WHERE symbol IN ('S', 'V') GROUP BY sensor_id) w
      LEFT JOIN (SELECT sensor_id, sum(y) AS got FROM tr GROUP BY sensor_id) g ON g.sensor_id = w.sensor_id""",
    "record_sets": f"""WITH {BEATS}, r AS (SELECT sensor_id, CAST(sensor_id + 99 AS VARCHAR) AS record, count(*) AS n_beats FROM beats GROUP BY sensor_id)
      SELECT sensor_id, record, CASE WHEN list_contains({list(TRAIN)}, record) THEN 'train' WHEN list_contains({list(TEST)}, record) THEN 'test' WHEN list_contains({list(PACED)}, record) THEN 'paced' END AS record_set, n_beats FROM r""",
    "subject_halves": f"""WITH {BEATS}, o AS (SELECT sensor_id, beat_idx, row_number() OVER (PARTITION BY sensor_id ORDER BY md5('0|' || sensor_id || '|' || beat_idx)) AS r, count(*) OVER (PARTITION BY sensor_id) AS n FROM beats)
      SELECT sensor_id, beat_idx, r <= n // 2 AS first_half FROM o""",
    "classifiable_beats": f"WITH {BEATS} SELECT sensor_id, count_if(symbol <> 'Q') AS n_kept, count_if(symbol = 'Q') AS n_dropped FROM beats GROUP BY sensor_id",
    "bin_examples": f"""WITH {SIGNAL}, f AS (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS b FROM sig WHERE x IS NOT NULL WINDOW o AS (PARTITION BY sensor_id ORDER BY i)), e AS (
        SELECT sensor_id, i, i // 20 AS bin, row_number() OVER (PARTITION BY sensor_id, i // 20 ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY sensor_id, i // 20) AS n FROM f WHERE x > a AND x > b
      ), k AS (SELECT * FROM e WHERE n <= 3 OR p IN (0, (n - 1) // 2, n - 1)), s AS (SELECT sensor_id, i, round(coalesce(x, -1.0), 3) AS x, max(i) OVER (PARTITION BY sensor_id) AS last FROM sig)
      SELECT k.sensor_id, k.bin, round(k.i / 10, 2) AS t, round(max(CASE WHEN s.i = k.i - 4 THEN x END), 6) AS first, round(max(CASE WHEN s.i = k.i + 3 THEN x END), 6) AS last, CAST(count(*) AS INT) AS n
      FROM k JOIN s ON s.sensor_id = k.sensor_id AND s.i BETWEEN k.i - 4 AND k.i + 3 WHERE k.i >= 4 AND k.i + 4 <= s.last GROUP BY k.sensor_id, k.bin, k.i""",
    "clock_window": f"""WITH {BEATS}, c AS (SELECT DISTINCT sensor_id, sensor_id % 10 AS record_id, (sensor_id % 5 - 2) * 0.25::DOUBLE AS s FROM beats), o AS (SELECT *, s - min(s) OVER (PARTITION BY record_id) AS e FROM c)
      SELECT record_id, b.sensor_id, sample, round(e + sample / 360.0::DOUBLE, 6) AS t_s FROM beats b JOIN o ON o.sensor_id = b.sensor_id WHERE e + sample / 360.0::DOUBLE BETWEEN 20 AND 40""",
    "recordings_overview": """WITH c AS (SELECT user_id AS s, user_id % 10 AS record_id, count(*) AS n, CASE WHEN user_id % 7 = 2 THEN '250.0' ELSE '360.0' END AS fs FROM events GROUP BY user_id),
      r AS (SELECT record_id, count(*) AS n_channels, min(s) AS primary_sensor, CAST(sum(n) AS BIGINT) AS n_beats, min(fs) = max(fs) AS uniform_rate, CASE WHEN min(fs) = max(fs) THEN min(fs) ELSE min(fs) || '/' || max(fs) END AS f FROM c GROUP BY record_id)
      SELECT record_id, n_channels, primary_sensor, n_beats, uniform_rate, 'recording ' || record_id || ': ' || n_channels || ' channel(s), ' || f || ' Hz, ' || n_beats || ' beats, primary sensor ' || primary_sensor AS line FROM r""",
    "rhythm_asof_label": f"""WITH {BEATS}, t AS (SELECT sensor_id, sample, max(symbol) AS label FROM beats WHERE symbol IN ('N', 'V') GROUP BY sensor_id, sample)
      SELECT b.sensor_id, b.sample, t.label FROM beats b ASOF LEFT JOIN t ON b.sensor_id = t.sensor_id AND b.sample >= t.sample WHERE b.symbol NOT IN ('N', 'V')""",
    "cross_sensor_agreement": f"""WITH {BEATS}, f AS (SELECT sensor_id, min(symbol) AS first FROM beats GROUP BY sensor_id HAVING count(DISTINCT symbol) > 1), k AS (
      SELECT a.sensor_id, a.event_id, 1 + count(DISTINCT o.symbol) AS n_sensors FROM beats a JOIN f ON a.sensor_id = f.sensor_id AND a.symbol = f.first
      LEFT JOIN beats o ON o.sensor_id = a.sensor_id AND o.symbol <> f.first AND abs(o.sample - a.sample) <= 540 GROUP BY a.sensor_id, a.event_id) SELECT sensor_id, n_sensors, count(*) AS n_events FROM k GROUP BY ALL""",
    "ectopic_semi_join": f"WITH {BEATS} SELECT sensor_id, count(*) AS n FROM beats b WHERE EXISTS (SELECT 1 FROM beats v WHERE v.symbol = 'V' AND v.sensor_id = b.sensor_id AND v.sample = b.sample) GROUP BY sensor_id",
    "peak_sets": f"""WITH {BEATS}, a AS (SELECT sensor_id, sample FROM beats WHERE symbol IN ('N', 'V')), b AS (SELECT sensor_id, sample FROM beats WHERE symbol IN ('S', 'V'))
      SELECT sensor_id, count(*) AS n, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY sensor_id UNION ALL
      SELECT sensor_id, count(*), 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY sensor_id UNION ALL SELECT sensor_id, count(*), 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY sensor_id""",
    "aami_mapping": f"WITH {BEATS} SELECT symbol, {CLASS} AS class_id, count(*) AS n FROM beats GROUP BY symbol",
    "lead_positions": """WITH l AS (SELECT DISTINCT ' ' || CASE n_nationkey % 3 WHEN 0 THEN 'v' || n_nationkey WHEN 1 THEN 'ii' ELSE n_name END || ' ' AS lead FROM nation)
      SELECT lead, CASE WHEN upper(trim(lead)) IN ('I', 'II', 'III', 'AVR', 'AVL', 'AVF') OR upper(trim(lead)) LIKE 'ML%' OR upper(trim(lead)) LIKE 'V%' THEN 'lead_' || upper(trim(lead)) ELSE 'unknown' END AS position FROM l""",
    "classification_score": """WITH c AS (SELECT count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality <> 1 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic <> 1) AS fn, count_if(quality <> 1 AND toxic <> 1) AS tn FROM labels)
      SELECT *, round(tp / nullif(tp + fn, 0), 6) AS se, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "confusion_matrix": f"WITH {LABELLED} SELECT CAST(t.r AS INT) AS y_true, CAST(p.r AS INT) AS y_pred, (SELECT count(*) FROM lab WHERE y_true = t.r AND y_pred = p.r) AS n FROM range(5) t(r), range(5) p(r)",
    "multiclass_scores": f"""WITH {LABELLED}, c AS (SELECT r AS k, (SELECT count(*) FROM lab WHERE y_true = r AND y_pred = r) AS tp, (SELECT count(*) FROM lab WHERE y_true <> r AND y_pred = r) AS fp, (SELECT count(*) FROM lab WHERE y_true = r AND y_pred <> r) AS fn FROM range(5) t(r))
      SELECT CAST(k AS INT) AS class_id, ['N', 'S', 'V', 'F', 'Q'][k + 1] AS class, tp, fp, fn, round(tp / nullif(tp + fn, 0), 6) AS se, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c WHERE tp + fn > 0""",
    "gross_aggregate": f"WITH {BEATS} SELECT sensor_id, count(*) AS n_beats, count_if(symbol = 'V') AS n_ectopic FROM beats GROUP BY ROLLUP (sensor_id)",
    "threshold_selection": f"""WITH {BEATS}, r AS (SELECT sensor_id % 4 AS fold, symbol = 'V' AS y, event_id % 101 AS s FROM beats), g AS (SELECT range AS g FROM range(33)), f AS (
      SELECT g, fold, count_if(y AND s >= 30 + 2 * g) AS tp, count_if(s >= 30 + 2 * g) AS taken, count_if(y) AS pos FROM r, g GROUP BY g, fold HAVING count_if(y) >= 5), q AS (
      SELECT g, sum(coalesce(2 * tp / nullif(taken + pos, 0), 0)) AS f1 FROM f GROUP BY g) SELECT round(0.3 + 0.02 * g, 6)::DOUBLE AS threshold, round(f1, 6) AS f1_sum FROM q ORDER BY q.f1 DESC, g LIMIT 1""",
    "event_histogram": f"WITH {BEATS}, {HISTOGRAM.format(scale=1, bin=10)} SELECT * FROM hist",
    "hourly_histogram": f"WITH {BEATS}, {HISTOGRAM.format(scale=100, bin=3600)} SELECT * FROM hist",
    "busiest_bin": f"WITH {BEATS}, {HISTOGRAM.format(scale=1, bin=10)} SELECT sensor_id, max_by(bin, n * 1000000 + bin) AS bin, max(n) AS n FROM hist GROUP BY sensor_id",
    "bin_choice": """WITH b AS (SELECT n_nationkey * 5000 AS d FROM nation), w AS (SELECT d AS duration_s, CASE WHEN d <= 1200 THEN 60 WHEN d <= 3600 THEN 120 WHEN d <= 7200 THEN 300 WHEN d <= 28800 THEN 900 WHEN d <= 108000 THEN 3600 ELSE 7200 END AS bin_s FROM b)
      SELECT *, CASE WHEN bin_s % 3600 = 0 THEN (bin_s // 3600) || ' h' ELSE (bin_s // 60) || ' min' END AS label FROM w""",
    "events_summary": f"""WITH {BEATS}, s AS (SELECT sensor_id, count_if(symbol = 'V') AS n_events, count(*) AS n_beats, max(sample) / 360.0 / 3600 AS h FROM beats GROUP BY sensor_id)
      SELECT sensor_id, n_events, n_beats, round(100.0 * n_events / n_beats, 6) AS burden_pct, round(n_events / nullif(h, 0), 6) AS per_hour, h < 1 AS is_extrapolated FROM s""",
    "representative_events": f"""WITH {BEATS}, v AS (SELECT sensor_id, sample, row_number() OVER (PARTITION BY sensor_id ORDER BY sample) - 1 AS "at", count(*) OVER (PARTITION BY sensor_id) AS n FROM beats WHERE symbol = 'V')
      SELECT sensor_id, sample, "at" FROM v WHERE n <= 5 OR EXISTS (SELECT 1 FROM range(5) j(j) WHERE j * (n - 1) // 4 = v."at")""",
    "summary_json": f"""WITH {RR}, {HRV} SELECT sensor_id, '{{"sensor_id":' || sensor_id || ',"name":"\\u003cs\\u0026' || sensor_id || '\\u003e","n_valid":' || n_valid || ',"mean_hr":' || round_even(mean_hr, 1) || '}}' AS json FROM hrv""",
    "beat_template": f"WITH {TEMPLATE} SELECT grp AS \"group\", n_used, CAST(pos AS INT) AS pos, round(v, 6) AS v FROM tem",
    "template_correlation": f"WITH {TEMPLATE}, {corr_with('c1', 'tem')} SELECT grp AS \"group\", beat_id, round(corr, 6) AS corr FROM c1",
    "qrs_width": f"""WITH {POINTS}, sl AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE v - lag(v) OVER (PARTITION BY beat_id ORDER BY pos) END AS d FROM pts),
      en AS (SELECT grp, beat_id, pos, sum(d * d) OVER (PARTITION BY beat_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS e FROM sl), tp AS (SELECT *, max(CASE WHEN pos = 32 THEN e END) OVER (PARTITION BY beat_id) AS top FROM en)
      SELECT grp AS "group", beat_id, CASE WHEN max(top) > 0 THEN round((coalesce(min(pos) FILTER (WHERE pos BETWEEN 32 AND 44 AND e <= 0.15 * top), 44) - coalesce(max(pos) FILTER (WHERE pos BETWEEN 20 AND 32 AND e <= 0.15 * top), 20)) / 64.0, 6) END AS width_s FROM tp GROUP BY grp, beat_id""",
    "feature_ratios": f"""WITH {POINTS}, f AS (SELECT grp, beat_id, max(v) - min(v) AS amp, sum(v * v) FILTER (WHERE pos >= 2 AND pos < 16) AS p, sum(v * v) FILTER (WHERE pos >= 24 AND pos < 40) AS q FROM pts GROUP BY grp, beat_id),
      m AS (SELECT grp, quantile_cont(amp, 0.5) AS a, quantile_cont(p, 0.5) AS b, quantile_cont(q, 0.5) AS c FROM f GROUP BY grp)
      SELECT f.grp AS "group", beat_id, round(amp / nullif(a, 0), 6) AS amp_ratio, round(p / nullif(b, 0), 6) AS p_ratio, round(q / nullif(c, 0), 6) AS q_ratio FROM f JOIN m ON f.grp = m.grp""",
    "beat_features": f"WITH {FEATURES}",
    "beat_codes": f"""WITH {BEATS}, m AS (SELECT sensor_id, CASE WHEN event_id % 7 = 3 THEN '+' WHEN event_id % 7 = 5 THEN '~' ELSE symbol END AS symbol FROM beats)
      SELECT sensor_id, symbol IN ('N', 'L', 'R', 'e', 'j', 'A', 'a', 'J', 'S', 'V', 'E', 'F', '/', 'f', 'Q') AS is_beat, count(*) AS n FROM m GROUP BY ALL""",
    "histogram_bars": f"WITH {BEATS}, {HISTOGRAM.format(scale=1, bin=10)} SELECT sensor_id, bin, round((bin + 0.5) * 10 / 60, 6) AS centre_min, round(0.86 * 10 / 60, 6) AS width_min, n FROM hist",
    "channel_clocks": """WITH c AS (SELECT user_id AS sensor_id, user_id % 10 AS record_id, min(epoch_us(ts)) - 1704067200000000 AS us, count(*) AS n, CASE WHEN user_id % 7 = 2 THEN 250.0 ELSE 360.0 END AS fs FROM events GROUP BY user_id),
      s AS (SELECT *, us + (sensor_id % 5 - 2) * 250000 AS start FROM c), r AS (SELECT record_id, min(start) AS origin, min(fs) = max(fs) AS uniform_rate FROM s GROUP BY record_id)
      SELECT s.record_id, sensor_id, start, CAST(start + round(n / CAST(fs AS DOUBLE) * 1e6) AS BIGINT) AS "end", round((start - origin) / 1e6, 6) AS elapsed_s, uniform_rate FROM s JOIN r ON s.record_id = r.record_id""",
    "median_imputation": f"WITH {SIGNAL}, m AS (SELECT sensor_id, quantile_cont(x, 0.5) AS m FROM sig GROUP BY sensor_id) SELECT s.sensor_id, i, round(coalesce(x, m, 0), 6) AS x FROM sig s JOIN m ON s.sensor_id = m.sensor_id",
    "beat_windows": f"""WITH {SIGNAL}, c AS (SELECT sensor_id, i, coalesce(x, -1.0) AS x, max(i) OVER (PARTITION BY sensor_id) AS last FROM sig)
      SELECT b.sensor_id, b.i AS sample, round(max(CASE WHEN c.i = b.i - 5 THEN c.x END), 6) AS first, round(max(CASE WHEN c.i = b.i + 2 THEN c.x END), 6) AS last, round(sum(c.x), 6) AS total
      FROM c b JOIN c ON c.sensor_id = b.sensor_id AND c.i BETWEEN b.i - 5 AND b.i + 2 WHERE b.i >= 5 AND b.i + 3 < b.last + 1 GROUP BY b.sensor_id, b.i""",
    "moving_integration": f"""WITH {SIGNAL}, f AS (SELECT sensor_id, row_number() OVER (PARTITION BY sensor_id ORDER BY i) - 1 AS i, x FROM sig WHERE x IS NOT NULL),
      s AS (SELECT *, 10 * coalesce((lead(x) OVER o - lag(x) OVER o) / 2, lead(x) OVER o - x, x - lag(x) OVER o) AS slope FROM f WINDOW o AS (PARTITION BY sensor_id ORDER BY i))
      SELECT sensor_id, i, round(slope, 6) AS slope, round(sum(slope * slope) OVER (PARTITION BY sensor_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS integrated FROM s""",
    "refine_extremum": f"""WITH {SIGNAL}, n AS (SELECT p.sensor_id, p.i AS p, s.i, row_number() OVER (PARTITION BY p.sensor_id, p.i ORDER BY abs(s.x) DESC, s.i) AS r FROM sig p JOIN sig s ON s.sensor_id = p.sensor_id AND s.i BETWEEN p.i - 3 AND p.i + 3
      WHERE p.x IS NOT NULL AND s.x IS NOT NULL) SELECT DISTINCT sensor_id, i AS sample FROM n WHERE r = 1""",
    "upload_ingest": """SELECT 'r' || user_id AS record_id, 's' || user_id AS sensor_id, CAST(count(*) AS INT) AS n_samples, CASE WHEN user_id % 5 = 1 THEN 'bad sampling rate' WHEN user_id % 7 = 2 THEN 'bad start time' END AS problem
      FROM events GROUP BY user_id""",
}
