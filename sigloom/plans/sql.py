"""SQL of the registered queries, written apart from the DataFrame operators."""

from __future__ import annotations

import math

REGION = (300_000.0, 900_000.0)
BEAT_SECONDS = 50_000.0
CHUNK = (20, 6)
SPLICE = (10, 24, 5)
DELAY = 137
LEVEL_RATE = 4.0
SHORT_FRAME = (8, 2)
TRACK = (12, 6, 6)
LOUD_BLOCK, RANGE_BLOCK = (32, 8), (48, 8)
TAIL = (40, 20)
KEYWORDS = ("ring", "widget", "bolt", "gear")

BEATS = """ev AS (SELECT user_id AS sig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value / 500 AS x FROM events)"""
AB = f"""{BEATS}, ab AS (SELECT *, x AS a, CASE WHEN sig % 7 = 0 THEN x WHEN sig % 5 = 0 AND x > 0.6 THEN 0.6 ELSE x * pow(10, -0.1) END AS b FROM ev)"""
DENSE = "ds AS (SELECT CAST(0 AS BIGINT) AS sig, event_id AS i, value / 500 AS x FROM events)"
SPEC = """fr AS (SELECT CAST(label AS BIGINT) AS stem, vec_id AS frame, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS j FROM embeddings),
sp AS (SELECT stem, frame, bin, bin * 750.0 AS hz, sqrt(pow(sum(v * cos(2 * pi() * bin * j / 64)), 2) + pow(sum(v * sin(2 * pi() * bin * j / 64)), 2)) AS mag
  FROM fr, range(33) AS g(bin) GROUP BY 1, 2, 3)"""
CUT = "cu AS (SELECT stem, frame, bin, hz, mag * CASE WHEN hz >= 5000 AND hz < 10000 THEN pow(10, -0.25) ELSE pow(10, -0.1) END AS mag FROM sp)"
LR = """lr AS (SELECT e.vec_id // 2 AS pair, j AS i, e.v AS l, f.v AS r FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS j FROM embeddings) e
  JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS j FROM embeddings) f USING (j) WHERE e.vec_id % 2 = 0 AND f.vec_id = e.vec_id + 1)"""
NOTES = f"""{BEATS}, nt AS (SELECT sig, k, t AS onset, least(coalesce(lead(t) OVER (PARTITION BY sig ORDER BY k) - t, 1.0), 4.0) AS dur,
  CAST(floor(x * 500) AS BIGINT) % 128 AS pitch, CAST(floor(x * 500) AS BIGINT) // 128 AS instrument FROM ev)"""
NAMES = "st AS (SELECT p_name AS name, min(p_partkey) AS pos, CAST(max(p_size) % 9 AS BIGINT) AS n_beats FROM part GROUP BY 1)"
SIDES = f"""{NAMES}, other AS (SELECT name || '_restored' AS name FROM st WHERE length(name) % 2 = 0 UNION ALL SELECT 'only here_dry'),
ka AS (SELECT regexp_replace(name, '(_restored|_dry|_wet|_processed)$', '') AS key, max(name) AS a FROM st GROUP BY 1),
kb AS (SELECT regexp_replace(name, '(_restored|_dry|_wet|_processed)$', '') AS key, max(name) AS b FROM other GROUP BY 1)"""
KW = " ".join(f"WHEN contains(lower(name), '{k}') THEN {i}" for i, k in enumerate(KEYWORDS))
RANKED = f"{NAMES}, rk AS (SELECT name, pos, n_beats, CAST(CASE {KW} END AS BIGINT) AS kw FROM st WHERE CASE {KW} END IS NOT NULL)"
P95 = f"{SPEC}, p AS (SELECT stem, bin, hz, quantile_cont(mag, 0.95) AS amp, 20 * log10(quantile_cont(mag, 0.95) + 1e-12) AS level FROM sp GROUP BY 1, 2, 3)"
POWERS = f"""{DENSE}, fp AS (SELECT sig, f AS frame, avg(x * x) AS power, count(*) AS n FROM ds, LATERAL (SELECT unnest(range(greatest(0, i // 100 - 3), i // 100 + 1)) AS f) GROUP BY 1, 2 HAVING count(*) = 400),
total AS (SELECT max(i) + 1 AS total FROM ds)"""
LUFS = f"""{POWERS}, lb AS (SELECT sig, -0.691 + 10 * log10(power + 1e-12) AS l FROM fp),
loud AS (SELECT sig, l, pow(10, (l + 0.691) / 10) AS p FROM lb WHERE l > -70)"""
DB = lambda x: f"CASE WHEN {x} > 0 THEN 20 * log10({x}) ELSE CAST('-Infinity' AS DOUBLE) END"
CORR = lambda a, b: f"CASE WHEN count(*) * var_pop({a}) > 1e-12 AND count(*) * var_pop({b}) > 1e-12 THEN (sum({a} * {b}) - sum({a}) * sum({b}) / count(*)) / sqrt((sum({a} * {a}) - sum({a}) * sum({a}) / count(*)) * (sum({b} * {b}) - sum({b}) * sum({b}) / count(*))) END"
SPANS = f"""n AS (SELECT sig, count(*) AS n FROM ev GROUP BY 1), s0 AS (SELECT sig, n, unnest(range(0, n, {CHUNK[0] - CHUNK[1]})) AS start FROM n),
s1 AS (SELECT sig, n, start, lead(start) OVER (PARTITION BY sig ORDER BY start) AS nx, row_number() OVER (PARTITION BY sig ORDER BY start) - 1 AS c FROM s0 WHERE start = 0 OR start + {CHUNK[1]} < n),
spans AS (SELECT sig, c, start, CASE WHEN nx IS NULL THEN n ELSE least(start + {CHUNK[0]}, n) END AS stop, n FROM s1)"""
SLIDE = f"""{LR}, sl AS (SELECT b.pair, b.i - a.i AS start, sum(a.l * b.r) AS lr, sum(a.l) AS l, sum(b.r) AS r, sum(a.l * a.l) AS ll, sum(b.r * b.r) AS rr
  FROM lr a JOIN lr b ON a.pair = b.pair AND a.i < 16 AND b.i >= a.i AND b.i - a.i <= 48 GROUP BY 1, 2),
sw AS (SELECT pair, start, CASE WHEN ll - l * l / 16 > 1e-12 AND rr - r * r / 16 > 1e-12 THEN (lr - l * r / 16) / sqrt((ll - l * l / 16) * (rr - r * r / 16)) ELSE 0 END AS score FROM sl)"""
ANCHORS = f"""{BEATS}, gp AS (SELECT sig, t, t - lag(t) OVER (PARTITION BY sig ORDER BY t) AS gap FROM ev),
tg AS (SELECT sig, CAST(round_even(median(gap) * 100, 0) AS BIGINT) AS target FROM gp GROUP BY 1),
nn AS (SELECT sig, CAST(floor(max(t) * 100) + 1 AS BIGINT) AS n FROM ev GROUP BY 1),
b0 AS (SELECT DISTINCT sig, CAST(least(greatest(round_even(t * 100, 0), 0), n) AS BIGINT) AS src, n FROM ev JOIN nn USING (sig)),
b1 AS (SELECT b0.*, target, lead(src) OVER (PARTITION BY sig ORDER BY src) - src AS len, count(*) OVER (PARTITION BY sig) AS many FROM b0 JOIN tg USING (sig) WHERE src > 0 AND src < n),
b2 AS (SELECT *, greatest(1, round_even(len / target, 0)) * target AS steps FROM b1 WHERE many >= 2),
b3 AS (SELECT *, CASE WHEN len / steps < 0.8 OR len / steps > 1.25 OR abs(len / steps - 1) < 0.005 THEN len ELSE steps END AS too FROM b2),
b4 AS (SELECT *, CAST(first_value(src) OVER w + coalesce(sum(too) OVER (PARTITION BY sig ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dst FROM b3 WINDOW w AS (PARTITION BY sig ORDER BY src)),
an AS (SELECT sig, src, dst FROM b4 UNION ALL SELECT sig, 0, 0 FROM nn UNION ALL SELECT sig, n, dst + n - src FROM b4 WHERE len IS NULL
  UNION ALL SELECT sig, n, n FROM nn WHERE sig NOT IN (SELECT sig FROM b4))"""
REPORT = f"""{AB}, lg AS (SELECT *, abs(a - lag(a) OVER w) AS ja, abs(b - lag(b) OVER w) AS jb FROM ab WINDOW w AS (PARTITION BY sig ORDER BY k)),
g AS (SELECT sig, count(*) AS n, max(t) AS duration, max(abs(a)) AS peak_a, max(abs(b)) AS peak_b, CAST(count(*) FILTER (abs(a) >= 0.999969) AS BIGINT) AS clipped_in, CAST(count(*) FILTER (abs(b) >= 0.999969) AS BIGINT) AS clipped_out,
  sqrt(avg(a * a)) AS ra, sqrt(avg(b * b)) AS rb, sqrt(avg((a - b) * (a - b))) AS rd, median(20 * log10(abs(b / a))) FILTER (a <> 0 AND b <> 0) AS program_gain,
  max(ja) / nullif(max(abs(a)), 0) AS step_a, max(jb) / nullif(max(abs(b)), 0) AS step_b, coalesce({CORR('a', 'b')}, 1.0) AS corr FROM lg GROUP BY 1),
ft AS (SELECT sig, count(*) AS n FROM ab GROUP BY 1), fs2 AS (SELECT sig, unnest(range(0, n - 8, 2)) AS s FROM ft),
fd AS (SELECT f.sig, s, 20 * log10(sqrt(avg(a * a)) + 1e-12) AS da, 20 * log10(sqrt(avg(b * b)) + 1e-12) AS db FROM fs2 f JOIN ab ON ab.sig = f.sig AND k >= s AND k < s + 8 GROUP BY 1, 2),
sb AS (SELECT sig, floor((da + 100) / 6) AS bin, median(db - da) AS gain FROM fd WHERE da >= -100 AND da < -4 GROUP BY 1, 2 HAVING count(*) >= 12),
sd AS (SELECT sig, max(gain) - min(gain) AS spread, arg_min(gain, bin) AS quiet, arg_max(gain, bin) AS loud FROM sb GROUP BY 1),
fw AS (SELECT sig, k // 8 AS w, coalesce({CORR('a', 'b')}, 0.0) AS corr FROM ab GROUP BY 1, 2 HAVING count(*) = 8),
fs AS (SELECT sig, min(corr) AS corr_min, median(corr) AS corr_median FROM fw GROUP BY 1),
rp AS (SELECT g.sig, n, duration, peak_a, peak_b, clipped_in, clipped_out, ({DB('rb')}) - ({DB('ra')}) AS rms_delta, CASE WHEN rd > 0 AND ra > 0 THEN 20 * log10(rd) - 20 * log10(ra) ELSE CAST('-Infinity' AS DOUBLE) END AS residual,
  program_gain, step_a, step_b, corr, coalesce(spread, 0.0) AS spread, coalesce(quiet, 0.0) AS quiet, coalesce(loud, 0.0) AS loud, corr_min, corr_median FROM g LEFT JOIN sd USING (sig) LEFT JOIN fs USING (sig))"""


def END(h, m, h2, m2):  # noqa: N802
    d = f"(((2 * {h} + {h2}) * {m} - {h} * {m2}) / ({h} + {h2}))"
    return f"(CASE WHEN {m2} IS NULL THEN {m} WHEN sign({d}) <> sign({m}) THEN 0 WHEN sign({m}) <> sign({m2}) AND abs({d}) > 3 * abs({m}) THEN 3 * {m} ELSE {d} END)"


def rd(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


BANDS = "(VALUES ('20_100',20,100),('100_250',100,250),('250_500',250,500),('500_1k',500,1000),('1k_2_5k',1000,2500),('2_5k_5k',2500,5000),('5k_8k',5000,8000),('8k_10k',8000,10000),('10k_16k',10000,16000),('16k_24k',16000,24000)) AS bands(band, lo, hi)"
WIDTH = f"least({CHUNK[1]}, (stop - start) // 2)"
TURN = lambda d, w: f"(pi() / 2 * coalesce(({d}) / nullif(CAST({w} AS DOUBLE) - 1, 0), 0))"
RAMP = lambda d: f"pow(sin({TURN(d, WIDTH)}), 2)"
S0, SL, SF = SPLICE

RISK = f"""{BEATS}, t AS (SELECT sig, greatest(avg(x) + 1.5 * stddev_pop(x), 0.4) AS threshold FROM ev GROUP BY 1), up AS (SELECT sig, k, CASE WHEN k - lag(k) OVER (PARTITION BY sig ORDER BY k) - 1 <= 2 THEN 0 ELSE 1 END AS fresh FROM ev JOIN t USING (sig) WHERE x > threshold),
rn AS (SELECT sig, run, min(k) AS s, max(k) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY sig ORDER BY k) AS run FROM up) GROUP BY 1, 2),
be AS (SELECT sig, s * 0.5 AS s, e * 0.5 AS e FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY e - s DESC, s) AS rk FROM rn) WHERE rk = 1),
rg AS (SELECT sig, greatest((s + e) / 2 - greatest((e - s) / 2, 0.5) - 0.25, 0) AS "start", (s + e) / 2 + greatest((e - s) / 2, 0.5) + 0.25 AS "end" FROM be)"""
BAND_NAMES = ("100_250", "250_500", "500_1k", "1k_2_5k", "2_5k_5k", "5k_8k", "8k_10k", "10k_16k")
MOVED = ", ".join(f"max(delta) FILTER (band = '{n}') AS b{n}" for n in BAND_NAMES)
BAD = ", ".join(f"CASE WHEN abs(b{n}) > 1.5 THEN 'band {n}' END" for n in BAND_NAMES)
VERDICT = f"""{REPORT}, lw AS (SELECT sig, k, t, lead(k) OVER (PARTITION BY sig ORDER BY k) IS NULL AS fin FROM ab),
ln AS (SELECT sig, 1000 * (max(t) FILTER (NOT (sig % 13 = 0 AND fin)) - max(t)) AS dd, CASE WHEN sig % 17 = 0 THEN (max(k) - min(k)) * 0.2 ELSE 0 END AS dr FROM lw GROUP BY 1),
fv AS (SELECT sig, k // 16 AS frame, bin, bin * 3000 AS hz, pow(sum(a * cos(2 * pi() * bin * (k % 16) / 16)), 2) + pow(sum(a * sin(2 * pi() * bin * (k % 16) / 16)), 2) AS pa,
  pow(sum(b * cos(2 * pi() * bin * (k % 16) / 16)), 2) + pow(sum(b * sin(2 * pi() * bin * (k % 16) / 16)), 2) AS pb FROM ab, range(9) AS rg(bin) GROUP BY 1, 2, 3 HAVING count(*) = 16),
fl AS (SELECT sig, frame, 10 * log10(sum(pa) + 1e-12) AS da, 10 * log10(sum(pb) + 1e-12) AS db FROM fv GROUP BY 1, 2), ga AS (SELECT sig, quantile_cont(da, 0.4) AS gate FROM fl GROUP BY 1),
lf AS (SELECT fl.*, da >= gate AS loud, count(*) FILTER (da >= gate) OVER (PARTITION BY sig) AS n FROM fl JOIN ga USING (sig)), us AS (SELECT * FROM lf WHERE loud OR n < 4),
gn AS (SELECT sig, median(db - da) AS gain FROM us GROUP BY 1),
bd AS (SELECT sig, frame, band, 10 * log10(sum(pa) + 1e-12) AS ba, 10 * log10(sum(pb) + 1e-12) AS bb FROM fv, {BANDS} WHERE hz >= lo AND hz < least(hi, 24000) GROUP BY 1, 2, 3),
bn AS (SELECT bd.sig, band, median(bb - ba) - any_value(gain) AS delta FROM bd JOIN us USING (sig, frame) JOIN gn ON gn.sig = bd.sig GROUP BY 1, 2 HAVING count(*) >= 4),
mv AS (SELECT sig, {MOVED} FROM bn GROUP BY 1),
ts AS (SELECT o.sig, o.k AS o, avg(s.a * s.a) FILTER (s.k < o.k) AS a0, avg(s.a * s.a) FILTER (s.k >= o.k) AS a1, avg(s.b * s.b) FILTER (s.k < o.k) AS b0, avg(s.b * s.b) FILTER (s.k >= o.k) AS b1
  FROM ab o JOIN ab s ON s.sig = o.sig AND s.k >= o.k - 5 AND s.k < o.k + 6 AND (s.k < o.k - 1 OR s.k >= o.k) WHERE o.a > 0.85 AND o.k >= 6 GROUP BY 1, 2),
sl AS (SELECT sig, median(20 * log10(sqrt(b1) + 1e-12) - 20 * log10(sqrt(b0) + 1e-12)) - median(20 * log10(sqrt(a1) + 1e-12) - 20 * log10(sqrt(a0) + 1e-12)) AS sd FROM ts GROUP BY 1),
v AS (SELECT rp.sig, list_filter([CASE WHEN rp.sig % 11 = 0 THEN 'channels' END, CASE WHEN abs(dd) > 5 THEN 'duration' END, CASE WHEN dr > 5 THEN 'drift' END, CASE WHEN corr_min < 0.9 THEN 'corr_min' END, {BAD},
  CASE WHEN sd < -0.5 THEN 'attack slope' END, CASE WHEN spread > 6 THEN 'spread' END, CASE WHEN clipped_out > clipped_in THEN 'clipping' END], lambda y: y IS NOT NULL) AS p
  FROM rp LEFT JOIN ln USING (sig) LEFT JOIN mv USING (sig) LEFT JOIN sl USING (sig))"""
LAGS = lambda c, s, most: f"""m_{c} AS (SELECT avg(l) AS ml, avg(r) AS mr, sqrt(sum(l * l) - count(l) * avg(l) * avg(l)) * sqrt(sum(r * r) - count(r) * avg(r) * avg(r)) AS norm FROM {c}),
{s} AS (SELECT b.i - a.i AS lag, sum((a.l - ml) * (b.r - mr)) / nullif(any_value(norm), 0) AS score FROM {c} a, {c} b, m_{c} WHERE b.i BETWEEN a.i - {most} AND a.i + {most} GROUP BY 1)"""  # noqa: E731

KW_A, KW_1, KW_2 = 10 ** (3.999843853973347 / 40), 2 * math.pi * 1681.974450955533 / 48_000, 2 * math.pi * 38.13547087602444 / 48_000
KW_S, KW_C = math.sqrt(KW_A) * math.sin(KW_1) / 0.7071752369554196, math.cos(KW_1)
KW_N = KW_A + 1 - (KW_A - 1) * KW_C + KW_S
SHELF = [KW_A * (KW_A + 1 + (KW_A - 1) * KW_C + KW_S) / KW_N, -2 * KW_A * (KW_A - 1 + (KW_A + 1) * KW_C) / KW_N, KW_A * (KW_A + 1 + (KW_A - 1) * KW_C - KW_S) / KW_N,
         2 * (KW_A - 1 - (KW_A + 1) * KW_C) / KW_N, (KW_A + 1 - (KW_A - 1) * KW_C - KW_S) / KW_N]
KW_W, KW_D = math.sin(KW_2) / (2 * 0.5003270373238773), math.cos(KW_2)
PASS = [(1 + KW_D) / 2 / (1 + KW_W), -(1 + KW_D) / (1 + KW_W), (1 + KW_D) / 2 / (1 + KW_W), -2 * KW_D / (1 + KW_W), (1 - KW_W) / (1 + KW_W)]
WEIGHTED = f"""fr AS (SELECT vec_id AS sig, embedding AS x FROM embeddings),
k1 AS (SELECT sig, x, 0 AS i, x[1]::DOUBLE AS v, 0.0::DOUBLE AS v1, {SHELF[0]!r} * x[1]::DOUBLE AS y, 0.0::DOUBLE AS y1, {PASS[0]!r} * ({SHELF[0]!r} * x[1]::DOUBLE) AS z, 0.0::DOUBLE AS z1 FROM fr
  UNION ALL SELECT sig, x, i + 1, x[i + 2]::DOUBLE, v, {SHELF[0]!r} * x[i + 2]::DOUBLE + {SHELF[1]!r} * v + {SHELF[2]!r} * v1 - {SHELF[3]!r} * y - {SHELF[4]!r} * y1, y,
  {PASS[0]!r} * ({SHELF[0]!r} * x[i + 2]::DOUBLE + {SHELF[1]!r} * v + {SHELF[2]!r} * v1 - {SHELF[3]!r} * y - {SHELF[4]!r} * y1) + {PASS[1]!r} * y + {PASS[2]!r} * y1 - {PASS[3]!r} * z - {PASS[4]!r} * z1, z FROM k1 WHERE i + 1 < len(x))"""
BLOCKS = lambda name, size: f"""{name} AS (SELECT sig // 2 AS sig, f AS frame, sum(z * z) / {size[0]} AS power, max(sig % 2) AS top FROM k1, range(0, 65 - {size[0]}, {size[1]}) AS g(f) WHERE i >= f AND i < f + {size[0]} GROUP BY 1, 2)"""
GATED = lambda b: f"""{b}l AS (SELECT sig, -0.691 + 10 * log10(power + 1e-12) AS l FROM {b}), {b}p AS (SELECT *, pow(10, (l + 0.691) / 10) AS p FROM {b}l WHERE l > -70),
{b}g AS (SELECT sig, -0.691 + 10 * log10(avg(p) + 1e-12) AS whole, avg(l) AS plain FROM {b}p GROUP BY 1),
{b}u AS (SELECT sig, coalesce(-0.691 + 10 * log10(avg(p) FILTER (l > whole - 10) + 1e-12), any_value(plain)) AS lufs, CASE WHEN count(*) FILTER (l > whole - 20) < 2 THEN 0 ELSE quantile_cont(l, 0.95) FILTER (l > whole - 20) - quantile_cont(l, 0.1) FILTER (l > whole - 20) END AS lra FROM {b}p JOIN {b}g USING (sig) GROUP BY 1)"""  # noqa: E731
TRACKED = f"""{BEATS}, tn AS (SELECT sig, count(*) AS n FROM ev GROUP BY 1), tb AS (SELECT a.sig, a.k AS i, coalesce(b.x, 0) AS b FROM ev a LEFT JOIN ev b ON b.sig = a.sig AND b.k = a.k - 2),
tw AS (SELECT sig, n, unnest(range(0, n - {TRACK[0]}, {TRACK[1]})) AS s FROM tn), tp AS (SELECT sig, n, s, unnest(range(0, n - {TRACK[0]} + 1)) AS p FROM tw),
tc AS (SELECT tp.sig, s, p, coalesce({CORR('a.x', 'tb.b')}, 0) AS score FROM tp JOIN ev a ON a.sig = tp.sig AND a.k >= s AND a.k < s + {TRACK[0]} JOIN tb ON tb.sig = tp.sig AND tb.i = a.k - s + p GROUP BY 1, 2, 3),
tr AS (SELECT sig, n, CAST(-1 AS BIGINT) AS w, CAST(NULL AS BIGINT) AS lag, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS running FROM tn
  UNION ALL SELECT tr.sig, n, w + 1, arg_max(p - s, round(tc.score, 9) - p * 1e-12), max(tc.score), coalesce(arg_max(p - s, round(tc.score, 9) - p * 1e-12), running)
  FROM tr LEFT JOIN tc ON tc.sig = tr.sig AND s = (w + 1) * {TRACK[1]} AND abs(p - s - coalesce(running, 0)) <= {TRACK[2]} WHERE (w + 1) * {TRACK[1]} < n - {TRACK[0]} GROUP BY tr.sig, n, w, running)"""
QUERIES = {
    "tempo_stability": f"""WITH {BEATS}, gp AS (SELECT sig, t - lag(t) OVER (PARTITION BY sig ORDER BY t) AS gap FROM ev),
n AS (SELECT sig, count(*) AS n_beats, median(gap) AS iv FROM gp GROUP BY 1),
pr AS (SELECT sig, iv, gap / greatest(1, round_even(gap / iv, 0)) AS per FROM gp JOIN n USING (sig) WHERE gap IS NOT NULL AND n_beats >= 4),
ok AS (SELECT *, per > 0.5 * iv AND per < 2 * iv AS ok, count(*) FILTER (per > 0.5 * iv AND per < 2 * iv) OVER (PARTITION BY sig) AS n_ok FROM pr),
q AS (SELECT sig, median(60 / per) AS bpm_median, stddev_pop(60 / per) AS bpm_std, min(60 / per) AS bpm_min, max(60 / per) AS bpm_max FROM ok WHERE ok OR n_ok < 3 GROUP BY 1)
SELECT n.sig, n_beats, {rd('bpm_median', 'bpm_std', 'bpm_min', 'bpm_max')} FROM n LEFT JOIN q USING (sig)""",
    "beat_warp_anchors": f"WITH {ANCHORS} SELECT sig, src, dst FROM an",
    "warp_summary": f"""WITH {ANCHORS}, d AS (SELECT sig, src, dst, src - lag(src) OVER w AS ds, dst - lag(dst) OVER w AS dd FROM an WINDOW w AS (PARTITION BY sig ORDER BY src)),
c AS (SELECT *, CASE WHEN ds <> dd THEN 100 * abs(dd / ds - 1) END AS c FROM d)
SELECT sig, segments, corrected, {rd('median_pct', 'max_pct', 'length_pct')} FROM (SELECT sig, count(ds) AS segments, count(c) AS corrected, coalesce(median(c), 0.0) AS median_pct, coalesce(max(c), 0.0) AS max_pct, 100 * (max(dst) / max(src) - 1) AS length_pct FROM c GROUP BY 1)""",
    "warp_read": f"""WITH {ANCHORS}, gr AS (SELECT DISTINCT sig, (m * j) // 8 AS dst FROM (SELECT sig, max(dst) AS m FROM an GROUP BY 1), range(9) AS g(j)),
w1 AS (SELECT sig, dst, src, lead(dst) OVER w - dst AS h1, (lead(src) OVER w - src) / (lead(dst) OVER w - dst) AS m1 FROM an WINDOW w AS (PARTITION BY sig ORDER BY dst)),
w2 AS (SELECT *, lag(h1) OVER w AS h0, lag(m1) OVER w AS m0, lead(h1) OVER w AS h2, lead(m1) OVER w AS m2, lag(h1, 2) OVER w AS hb, lag(m1, 2) OVER w AS mb FROM w1 WINDOW w AS (PARTITION BY sig ORDER BY dst)),
w3 AS (SELECT sig, dst, src, CASE WHEN m0 IS NULL THEN {END('h1', 'm1', 'h2', 'm2')} WHEN m1 IS NULL THEN {END('h0', 'm0', 'hb', 'mb')} WHEN m0 * m1 > 0 THEN 3 * (h0 + h1) / ((2 * h1 + h0) / m0 + (h1 + 2 * h0) / m1) ELSE 0 END AS d FROM w2),
lo AS (SELECT gr.sig, gr.dst, max(an.dst) AS ad FROM gr JOIN an ON an.sig = gr.sig AND an.dst <= gr.dst GROUP BY 1, 2),
hi AS (SELECT gr.sig, gr.dst, min(an.dst) AS bd FROM gr JOIN an ON an.sig = gr.sig AND an.dst >= gr.dst GROUP BY 1, 2),
ps AS (SELECT lo.sig, lo.dst, bd - ad AS h, coalesce((lo.dst - ad) / nullif(bd - ad, 0), 0) AS t, a.src AS ya, b.src AS yb, a.d AS da, b.d AS db FROM lo JOIN hi USING (sig, dst) JOIN w3 a ON a.sig = lo.sig AND a.dst = ad JOIN w3 b ON b.sig = lo.sig AND b.dst = bd)
SELECT sig, dst, round((2 * t * t * t - 3 * t * t + 1) * ya + (t * t * t - 2 * t * t + t) * h * da + (3 * t * t - 2 * t * t * t) * yb + (t * t * t - t * t) * h * db, 4) + 0.0 AS src FROM ps""",
    "signal_info": f"""WITH {BEATS}, g AS (SELECT sig, count(*) AS n, max(t) AS duration, max(abs(x)) AS peak, CAST(count(*) FILTER (abs(x) >= 0.999969) AS BIGINT) AS clipped, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1)
SELECT sig, n, clipped, {rd('duration', 'peak', 'rms')}, round({DB('peak')}, 6) + 0.0 AS peak_db, round({DB('rms')}, 6) + 0.0 AS rms_db FROM g""",
    "silence_flags": f"WITH {BEATS} SELECT sig, ({DB('max(abs(CASE WHEN sig % 3 = 0 THEN x * 0.001 ELSE x END))')}) < -45 AS silent FROM ev GROUP BY 1",
    "residual_level": f"WITH {AB}, g AS (SELECT sig, sqrt(avg((a - b) * (a - b))) AS d, sqrt(avg(a * a)) AS a FROM ab GROUP BY 1) SELECT sig, CASE WHEN d > 0 AND a > 0 THEN round(20 * log10(d) - 20 * log10(a), 6) + 0.0 ELSE CAST('-Infinity' AS DOUBLE) END AS level FROM g",
    "residual_bucket": f"WITH {AB}, g AS (SELECT sig, sqrt(avg((a - b) * (a - b))) AS d, sqrt(avg(a * a)) AS a FROM ab GROUP BY 1) SELECT sig, CASE WHEN d = 0 OR a = 0 THEN 'identical' WHEN 20 * log10(d / a) < -40 THEN 'light' WHEN 20 * log10(d / a) < -20 THEN 'moderate' ELSE 'heavy' END AS bucket FROM g",
    "frame_rms_hopping": f"WITH {POWERS} SELECT sig, frame, {rd('power', places=9)} FROM fp, total WHERE frame * 100 < total - 400",
    "envelope_blocks": f"""WITH {DENSE}, e AS (SELECT sig, i // 50 AS b, sqrt(avg(x * x)) AS v FROM ds GROUP BY 1, 2 HAVING count(*) = 50), m AS (SELECT avg(v) AS m, sqrt(sum(v * v) - count(*) * avg(v) * avg(v)) AS norm FROM e)
SELECT sig, b, round((v - m) / nullif(norm, 0), 6) + 0.0 AS env FROM e, m""",
    "dft_magnitude": f"WITH {SPEC} SELECT frame, bin, {rd('mag')} FROM sp",
    "spectrum_p95": f"WITH {P95} SELECT stem, bin, {rd('amp', 'level')} FROM p",
    "spectral_cliff": f"""WITH {SPEC}, {CUT}, p AS (SELECT stem, bin, hz, 20 * log10(quantile_cont(mag, 0.95) + 1e-12) AS level FROM cu GROUP BY 1, 2, 3), d AS (SELECT *, level - lead(level, 2) OVER (PARTITION BY stem ORDER BY bin) AS fall FROM p)
SELECT stem, CAST(max(hz) FILTER (hz >= 1500 AND fall >= 0.5) AS DOUBLE) AS cliff_hz FROM d GROUP BY 1""",
    "energy_above": f"WITH {P95} SELECT stem, round(coalesce(100 * coalesce(sum(amp) FILTER (hz >= 13000), 0) / nullif(sum(amp), 0), 0), 6) + 0.0 AS pct FROM p GROUP BY 1",
    "band_delta_gated": f"""WITH {SPEC}, {CUT}, bo AS (SELECT sp.stem, sp.frame, sp.bin, sp.hz, sp.mag * sp.mag AS pa, cu.mag * cu.mag AS pb FROM sp JOIN cu USING (stem, frame, bin)),
f AS (SELECT stem, frame, 10 * log10(sum(pa) + 1e-12) AS da, 10 * log10(sum(pb) + 1e-12) AS db FROM bo GROUP BY 1, 2), gt AS (SELECT stem, quantile_cont(da, 0.4) AS gate FROM f GROUP BY 1),
lf AS (SELECT f.*, da >= gate AS loud, count(*) FILTER (da >= gate) OVER (PARTITION BY stem) AS n FROM f JOIN gt USING (stem)), u AS (SELECT * FROM lf WHERE loud OR n < 4),
gn AS (SELECT stem, median(db - da) AS gain, count(*) AS frames_used FROM u GROUP BY 1),
bd AS (SELECT stem, frame, band, 10 * log10(sum(pa) + 1e-12) AS ba, 10 * log10(sum(pb) + 1e-12) AS bb FROM bo, {BANDS} WHERE hz >= lo AND hz < least(hi, 24000) GROUP BY 1, 2, 3)
SELECT bd.stem, band, round(median(bb - ba) - any_value(gain), 6) + 0.0 AS delta, round(any_value(gain), 6) + 0.0 AS gain, any_value(frames_used) AS frames_used FROM bd JOIN u USING (stem, frame) JOIN gn ON gn.stem = bd.stem GROUP BY 1, 2 HAVING count(*) >= 4""",
    "spectral_features": f"""WITH {SPEC}, s AS (SELECT *, sum(mag) OVER (PARTITION BY frame ORDER BY bin) AS run, sum(mag) OVER (PARTITION BY frame) AS al FROM sp),
g AS (SELECT frame, sum(hz * mag) / sum(mag) AS centroid, min(hz) FILTER (run >= 0.85 * al - 1e-9) AS rolloff85, min(hz) FILTER (run >= 0.99 * al - 1e-9) AS rolloff99, exp(avg(ln(greatest(mag * mag, 1e-10)))) / avg(greatest(mag * mag, 1e-10)) AS flatness FROM s GROUP BY 1)
SELECT frame, {rd('centroid', 'flatness')}, CAST(rolloff85 AS DOUBLE) AS rolloff85, CAST(rolloff99 AS DOUBLE) AS rolloff99, round(least(greatest((flatness - 0.15) / 0.20, 0), 1), 6) + 0.0 AS risk FROM g""",
    "hf_envelope_corr": f"""WITH {SPEC}, {CUT}, a AS (SELECT stem, frame, 20 * log10(sqrt(avg(mag * mag)) + 1e-12) AS u FROM sp GROUP BY 1, 2), b AS (SELECT stem, frame, 20 * log10(sqrt(avg(mag * mag)) + 1e-12) AS v FROM cu WHERE hz >= 10000 GROUP BY 1, 2), q AS (SELECT * FROM a JOIN b USING (stem, frame))
SELECT stem, CASE WHEN count(*) >= 16 AND count(*) * var_pop(u) > 1e-12 AND count(*) * var_pop(v) > 1e-12 THEN round(corr(u, v), 6) + 0.0 END AS corr, count(*) AS n_frames FROM q GROUP BY 1""",
    "hf_modulation": f"""WITH {BEATS}, c AS (SELECT sig, count(*) AS n, avg(x) AS m FROM ev GROUP BY 1), bs AS (SELECT sig, n, m, unnest(range(0, n // 2 + 1)) AS bin FROM c WHERE n >= 16 AND n >= 4 * {LEVEL_RATE}),
g AS (SELECT sig, n, bin, sqrt(pow(sum((x - m) * (0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) * cos(2 * pi() * bin * k / n)), 2) + pow(sum((x - m) * (0.5 - 0.5 * cos(2 * pi() * k / (n - 1))) * sin(2 * pi() * bin * k / n)), 2)) AS mag FROM bs JOIN ev USING (sig) GROUP BY 1, 2, 3),
b3 AS (SELECT *, lag(mag) OVER w AS lo, lead(mag) OVER w AS hi FROM g WINDOW w AS (PARTITION BY sig ORDER BY bin)),
q AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY round(mag, 9) DESC, bin) AS rn FROM b3 WHERE bin > 0 AND n / {LEVEL_RATE} / bin BETWEEN 2 AND 30),
t AS (SELECT sig, n / {LEVEL_RATE} / (bin + CASE WHEN hi IS NULL THEN 0 ELSE coalesce(least(greatest(0.5 * (lo - hi) / nullif(lo - 2 * mag + hi, 0), -0.5), 0.5), 0) END) AS period, mag * 4 / n AS depth FROM q WHERE rn = 1)
SELECT c.sig, round(coalesce(period, 0), 6) + 0.0 AS period, round(coalesce(depth, 0), 6) + 0.0 AS depth FROM c LEFT JOIN t USING (sig)""",
    "risk_regions": f"""WITH {RISK},
ins AS (SELECT ev.sig, avg(x) AS inside FROM ev JOIN rg ON rg.sig = ev.sig AND k * 0.5 >= "start" AND k * 0.5 < "end" GROUP BY 1)
SELECT t.sig, round(threshold, 6) + 0.0 AS threshold, round("start", 6) + 0.0 AS "start", round("end", 6) + 0.0 AS "end", round(inside, 6) + 0.0 AS inside FROM t LEFT JOIN rg USING (sig) LEFT JOIN ins USING (sig)""",
    "gain_curve": """WITH s AS (SELECT event_id AS i, value / 500 * pow(10, -(event_id % 4000) / 1000.0) AS a FROM events), f AS (SELECT i // 50 AS f, avg(a * a) AS pa, avg(pow(a * pow(10, -0.1), 2)) AS pb FROM s GROUP BY 1),
l AS (SELECT 20 * log10(sqrt(pa) + 1e-12) AS da, 20 * log10(sqrt(pb) + 1e-12) AS db FROM f)
SELECT CAST(1 AS BIGINT) AS sig, CAST(floor((da + 100) / 6) * 6 - 100 AS BIGINT) AS bin, round(median(db - da), 6) + 0.0 AS gain, count(*) AS n FROM l WHERE da >= -100 AND da < -4 GROUP BY 2 HAVING count(*) >= 12""",
    "stereo_metrics": f"""WITH {LR}, g AS (SELECT pair, sqrt(avg(pow((l + r) / 2, 2))) AS m, sqrt(avg(pow((l - r) / 2, 2))) AS s, coalesce({CORR('l', 'r')}, 1.0) AS corr FROM lr GROUP BY 1)
SELECT pair, CASE WHEN s > 0 AND m > 0 THEN round(20 * log10(s) - 20 * log10(m), 6) + 0.0 ELSE CAST('-Infinity' AS DOUBLE) END AS side_mid_db, {rd('corr')} FROM g""",
    "mid_side_roundtrip": f"WITH {LR} SELECT pair, round(max(greatest(abs(l - ((l + r) / 2 + (l - r) / 2)), abs(r - ((l + r) / 2 - (l - r) / 2)))), 6) + 0.0 AS error, count(*) AS n FROM lr GROUP BY 1",
    "mono_downmix": f"WITH {LR} SELECT pair, i, round((l + r) / 2, 6) + 0.0 AS mono FROM lr",
    "peak_bars": f"""WITH {BEATS}, n AS (SELECT sig, count(*) AS n FROM ev GROUP BY 1), g AS (SELECT sig, bar, bar * n // 20 AS lo, (bar + 1) * n // 20 AS hi FROM n, range(20) AS b(bar))
SELECT g.sig, bar, round(coalesce(max(abs(x)), 0), 6) + 0.0 AS peak FROM g LEFT JOIN ev ON ev.sig = g.sig AND k >= lo AND k < hi GROUP BY 1, 2""",
    "loudness_gated": f"""WITH {LUFS}, g AS (SELECT sig, -0.691 + 10 * log10(avg(p) + 1e-12) - 10 AS gate, avg(l) AS plain FROM loud GROUP BY 1), k AS (SELECT sig, avg(p) FILTER (l > gate) AS p, any_value(plain) AS plain FROM loud JOIN g USING (sig) GROUP BY 1)
SELECT s.sig, CASE WHEN k.sig IS NULL THEN CAST('-Infinity' AS DOUBLE) ELSE round(CASE WHEN p IS NOT NULL THEN -0.691 + 10 * log10(p + 1e-12) ELSE plain END, 6) + 0.0 END AS lufs FROM (SELECT DISTINCT sig FROM lb) s LEFT JOIN k USING (sig)""",
    "loudness_range": f"""WITH {LUFS}, g AS (SELECT sig, -0.691 + 10 * log10(avg(p) + 1e-12) - 20 AS gate FROM loud GROUP BY 1), k AS (SELECT sig, CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(l, 0.95) - quantile_cont(l, 0.1) END AS lra FROM loud JOIN g USING (sig) WHERE l > gate GROUP BY 1)
SELECT s.sig, round(coalesce(lra, 0), 6) + 0.0 AS lra FROM (SELECT DISTINCT sig FROM lb) s LEFT JOIN k USING (sig)""",
    "max_step": f"WITH {BEATS}, d AS (SELECT sig, x, abs(x - lag(x) OVER (PARTITION BY sig ORDER BY k)) AS d FROM ev) SELECT sig, round(coalesce(max(d) / nullif(max(abs(x)), 0), 0), 6) + 0.0 AS step FROM d GROUP BY 1",
    "loudest_window": f"""WITH {DENSE}, h AS (SELECT sig, f, sum(x * x) / 800 AS power FROM ds, LATERAL (SELECT unnest(range(greatest(0, i // 100 - 7), i // 100 + 1)) AS f) GROUP BY 1, 2 HAVING count(*) = 800), t AS (SELECT max(i) + 1 AS total FROM ds),
q AS (SELECT *, row_number() OVER (ORDER BY round(power, 9) DESC, f) AS rn FROM h, t WHERE f * 100 < total - 800) SELECT sig, f * 100 AS "start", {rd('power', places=9)} FROM q WHERE rn = 1""",
    "lag_correlation": f"""WITH {LR}, m AS (SELECT pair, avg(l) AS ml, avg(r) AS mr, sqrt(sum(l * l) - count(*) * avg(l) * avg(l)) * sqrt(sum(r * r) - count(*) * avg(r) * avg(r)) AS norm FROM lr GROUP BY 1),
s AS (SELECT a.pair, b.i - a.i AS lag, sum((a.l - ml) * (b.r - mr)) / nullif(any_value(norm), 0) AS score FROM lr a JOIN lr b ON a.pair = b.pair AND b.i - a.i BETWEEN -8 AND 8 JOIN m ON m.pair = a.pair GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(score, 9) DESC, lag) AS rn, max(score) OVER (PARTITION BY pair) AS best FROM s) SELECT pair, lag, round(best, 6) + 0.0 AS score FROM q WHERE rn = 1""",
    "sliding_correlation": f"WITH {SLIDE} SELECT pair, start, {rd('score')} FROM sw",
    "correlation_summary": f"""WITH {SLIDE}, g AS (SELECT pair, min(score) AS corr_min, median(score) AS corr_median, avg(score) AS corr_mean, count(*) FILTER (score >= 0.5) AS sure FROM sw GROUP BY 1),
c AS (SELECT sw.* FROM sw JOIN g USING (pair) WHERE sure = 0 OR score >= 0.5), m AS (SELECT pair, max(start) - min(start) AS drift, arg_max(start, abs(start) * 2 + (start > 0)::INT) AS max_offset, count(*) AS confident FROM c GROUP BY 1)
SELECT pair, {rd('corr_min', 'corr_median', 'corr_mean')}, drift, max_offset, confident FROM g JOIN m USING (pair)""",
    "fine_correlation": f"WITH {AB} SELECT sig, k // 8 AS w, round(coalesce({CORR('a', 'b')}, 0), 6) + 0.0 AS corr FROM ab GROUP BY 1, 2 HAVING count(*) = 8",
    "donor_match": f"""WITH {NOTES}, t AS (SELECT * FROM nt WHERE onset >= {REGION[0]} AND onset < {REGION[1]}), l AS (SELECT * FROM nt WHERE NOT (onset >= {REGION[0]} AND onset < {REGION[1]})),
q AS (SELECT t.sig, t.k, t.pitch, l.k AS donor_k, t.pitch - l.pitch AS shift, row_number() OVER (PARTITION BY t.sig, t.k ORDER BY (l.pitch = t.pitch) DESC, CASE WHEN l.pitch = t.pitch THEN round(abs(l.dur - 0.3), 9) ELSE abs(l.pitch - t.pitch) END, l.k) AS rn FROM t JOIN l USING (sig))
SELECT sig, k, pitch, donor_k, shift FROM q WHERE rn = 1""",
    "event_splice_union": f"WITH {NOTES} SELECT sig, k, {rd('onset', 'dur')}, CASE WHEN onset >= {REGION[0]} AND onset < {REGION[1]} THEN (pitch + 1) % 128 ELSE pitch END AS pitch, instrument FROM nt",
    "chroma_histogram": f"""WITH {NOTES}, n AS (SELECT sig, CAST(greatest(1, ceil(max(onset + dur) / {BEAT_SECONDS})) AS BIGINT) AS beats FROM nt GROUP BY 1)
SELECT sig, pitch % 12 AS pc, CAST(least(floor(onset / {BEAT_SECONDS}), beats - 1) AS BIGINT) AS beat, count(*) AS n FROM nt JOIN n USING (sig) GROUP BY 1, 2, 3""",
    "decode_notes": f"WITH {NOTES} SELECT sig, k, round_even(onset * 100, 0) / 100 AS onset, round_even(dur * 100, 0) / 100 AS dur, pitch, instrument FROM nt",
    "chunk_spans": f"WITH {BEATS}, {SPANS} SELECT sig, c, start, stop FROM spans",
    "overlap_add": f"""WITH {BEATS}, {SPANS}, e AS (SELECT s.sig, k AS i, x, (CASE WHEN start > 0 AND k - start < {WIDTH} THEN {RAMP('k - start')} ELSE 1 END) * (CASE WHEN stop < n AND stop - 1 - k < {WIDTH} THEN {RAMP('stop - 1 - k')} ELSE 1 END) AS w FROM spans s JOIN ev ON ev.sig = s.sig AND k >= start AND k < stop)
SELECT sig, i, round(CASE WHEN sum(w) > 1e-6 THEN sum(x * 0.5 * w) / sum(w) ELSE any_value(x) END, 6) + 0.0 AS y FROM e GROUP BY 1, 2""",
    "crossfade_splice": f"""WITH {BEATS}, n AS (SELECT sig, count(*) AS n, least({SL}, count(*), count(*) - {S0}) AS size FROM ev GROUP BY 1),
q AS (SELECT a.sig, a.k AS i, a.x, 1 - p.x AS p, a.k - {S0} AS j, size, least({SF}, size // 2) AS w FROM ev a JOIN n USING (sig) LEFT JOIN ev p ON p.sig = a.sig AND p.k = a.k - {S0} AND p.k < size),
r AS (SELECT *, CASE WHEN j < w THEN {TURN('j', 'w')} WHEN size - 1 - j < w AND w > 1 THEN {TURN('size - 1 - j', 'w')} ELSE pi() / 2 END AS g FROM q)
SELECT sig, i, round(CASE WHEN p IS NULL THEN x ELSE x * cos(g) + p * sin(g) END, 6) + 0.0 AS y FROM r""",
    "peak_limiter": f"WITH {BEATS}, s AS (SELECT sig, k, CASE WHEN sig % 2 = 0 THEN x * 1.5 ELSE x END AS x FROM ev), p AS (SELECT *, max(abs(x)) OVER (PARTITION BY sig) AS peak FROM s) SELECT sig, k, round(CASE WHEN peak > 1 THEN x * 0.95 / peak ELSE x END, 6) + 0.0 AS y FROM p",
    "gain_staging": f"WITH {BEATS} SELECT sig, round(CASE WHEN max(abs(x)) > 0.5 THEN 0.5 / max(abs(x)) ELSE 1 END, 6) + 0.0 AS gain, round(least(max(abs(x)), 0.5), 6) + 0.0 AS staged_peak FROM ev GROUP BY 1",
    "reference_rank": f"WITH {RANKED} SELECT name, kw, pos FROM rk",
    "reference_fallback": f"WITH {RANKED} SELECT name, kw, pos FROM rk WHERE n_beats >= 4 ORDER BY kw, pos LIMIT 1",
    "pair_names": f"WITH {SIDES} SELECT key, a, b FROM ka JOIN kb USING (key)",
    "unpaired_names": f"WITH {SIDES} SELECT key, 'a' AS side FROM ka WHERE key NOT IN (SELECT key FROM kb) UNION ALL SELECT key, 'b' FROM kb WHERE key NOT IN (SELECT key FROM ka)",
    "transient_windows": f"""WITH s AS (SELECT event_id AS i, value / 500 AS a, value / 500 * pow(10, -0.1) AS b FROM events), o AS (SELECT i AS o FROM s WHERE a > 0.85 AND i >= 40),
g AS (SELECT o, avg(a * a) FILTER (i < o) AS a0, avg(a * a) FILTER (i >= o) AS a1, avg(b * b) FILTER (i < o) AS b0, avg(b * b) FILTER (i >= o) AS b1 FROM o JOIN s ON i >= o - 25 AND i < o + 30 AND (i < o - 5 OR i >= o) GROUP BY 1),
q AS (SELECT 20 * log10(sqrt(a1) + 1e-12) - 20 * log10(sqrt(a0) + 1e-12) AS sa, 20 * log10(sqrt(b1) + 1e-12) - 20 * log10(sqrt(b0) + 1e-12) AS sb FROM g WHERE a0 IS NOT NULL AND a1 IS NOT NULL)
SELECT CAST(1 AS BIGINT) AS sig, count(*) AS n, round(median(sa), 6) + 0.0 AS slope_a, round(median(sb), 6) + 0.0 AS slope_b FROM q HAVING count(*) > 0""",
    "quality_report": f"WITH {REPORT} SELECT sig, n, clipped_in, clipped_out, {rd('duration', 'peak_a', 'peak_b', 'rms_delta', 'residual', 'program_gain', 'step_a', 'step_b', 'corr', 'spread', 'quiet', 'loud', 'corr_min', 'corr_median')} FROM rp",
    "verdict": f"WITH {VERDICT} SELECT sig, array_to_string(p, ',') AS problems, len(p) = 0 AS passed FROM v",
    "batch_verdict": f"WITH {VERDICT} SELECT count(*) AS n, count(*) FILTER (len(p) > 0) AS failed, coalesce(bool_and(len(p) = 0), true) AS passed FROM v",
    "offset_estimate": f"""WITH da AS (SELECT event_id AS i, value / 500 AS x FROM events), db AS (SELECT event_id + {DELAY} AS i, value / 500 AS x FROM events),
ea AS (SELECT i // 50 AS i, sqrt(avg(x * x)) AS v FROM da GROUP BY 1 HAVING count(*) = 50), eb AS (SELECT i // 50 AS i, sqrt(avg(x * x)) AS v FROM db GROUP BY 1 HAVING count(*) = 50),
c0 AS (SELECT i, ea.v AS l, eb.v AS r FROM ea FULL JOIN eb USING (i)), {LAGS('c0', 's0', 10)}, k0 AS (SELECT lag * 50 AS coarse FROM s0 ORDER BY round(score, 9) DESC, lag LIMIT 1),
h AS (SELECT f, sum(x * x) / 400 AS power FROM da, LATERAL (SELECT unnest(range(greatest(0, i // 50 - 7), i // 50 + 1)) AS f) GROUP BY 1 HAVING count(*) = 400),
st AS (SELECT f * 50 AS loud FROM h, (SELECT max(i) + 1 AS total FROM da) WHERE f * 50 < total - 400 ORDER BY round(power, 9) DESC, f LIMIT 1),
ps AS (SELECT coarse, least(greatest(loud, 0, 60 - coarse), least((SELECT max(i) + 1 FROM da) - 400, (SELECT max(i) + 1 FROM db) - coarse - 460)) AS start FROM k0, st),
c1 AS (SELECT p, da.x AS l, coalesce(db.x, 0) AS r FROM ps JOIN da ON da.i >= start AND da.i < start + 400, range(-60, 61) AS g(p) LEFT JOIN db ON db.i = da.i + coarse + p),
s1 AS (SELECT p, {CORR('l', 'r')} AS score FROM c1 GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS sig, coarse, coarse + p AS "offset", round(score, 6) + 0.0 AS score FROM k0, (SELECT p, coalesce(score, 0) AS score FROM s1 ORDER BY round(coalesce(score, 0), 9) DESC, p LIMIT 1)""",
    "key_profile": f"""WITH {NOTES}, pc AS (SELECT sig, p AS pc, coalesce(sum(dur) FILTER (pitch % 12 = p), 0) AS w FROM nt, range(12) AS g(p) GROUP BY 1, 2),
pr AS (SELECT unnest(range(12)) AS k, unnest([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88])::DOUBLE AS major, unnest([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])::DOUBLE AS minor),
ks AS (SELECT tonic, m, k, CASE m WHEN 0 THEN major ELSE minor END AS v FROM pr, range(12) AS t(tonic), range(2) AS u(m)),
sc AS (SELECT sig, tonic, m, corr(w, v) AS score FROM pc JOIN ks ON (pc - tonic + 12) % 12 = k GROUP BY 1, 2, 3 HAVING 12 * var_pop(w) > 1e-18),
q AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY round(score, 9) DESC, tonic, m) AS rn FROM sc)
SELECT sig, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][tonic + 1] || CASE m WHEN 0 THEN ' major' ELSE ' minor' END AS key, {rd('score')} FROM q WHERE rn = 1""",
    "column_normalize": f"""WITH {NOTES}, b AS (SELECT sig, CAST(greatest(1, ceil(max(onset + dur) / {BEAT_SECONDS})) AS BIGINT) AS beats FROM nt GROUP BY 1),
c AS (SELECT sig, pitch % 12 AS pc, CAST(least(floor(onset / {BEAT_SECONDS}), beats - 1) AS BIGINT) AS beat, count(*) AS n FROM nt JOIN b USING (sig) GROUP BY 1, 2, 3)
SELECT sig, pc, beat, round(n / (sqrt(sum(n * n) OVER (PARTITION BY sig, beat)) + 1e-9), 6) + 0.0 AS n FROM c""",
    "phase_accumulate": f"""WITH fr AS (SELECT CAST(label AS BIGINT) AS stem, vec_id AS frame, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS j FROM embeddings),
ri AS (SELECT stem, frame, bin, sum(v * cos(2 * pi() * bin * j / 64)) AS re, sum(v * sin(2 * pi() * bin * j / 64)) AS im FROM fr, range(33) AS g(bin) GROUP BY 1, 2, 3),
ph AS (SELECT stem, frame, bin, atan2(round(-im, 9) + 0.0, re) AS p FROM ri),
ad AS (SELECT *, coalesce(lead(p) OVER w, p) - p AS step, 2 * pi() * 16 * bin / 64 AS ex FROM ph WINDOW w AS (PARTITION BY stem, bin ORDER BY frame)),
aw AS (SELECT *, ex + (step - ex) - 2 * pi() * round_even((step - ex) / (2 * pi()), 0) AS advance FROM ad),
tt AS (SELECT *, first_value(p) OVER (PARTITION BY stem, bin ORDER BY frame) + coalesce(sum(advance) OVER (PARTITION BY stem, bin ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM aw)
SELECT stem, frame, bin, round(cos(advance), 6) + 0.0 AS step, round(cos(total), 5) + 0.0 AS re, round(sin(total), 5) + 0.0 AS im FROM tt""",
    "nearest_peak": f"""WITH {SPEC}, t AS (SELECT frame, bin, mag >= coalesce(lag(mag) OVER w, -1) AND mag >= coalesce(lead(mag) OVER w, -1) AS top FROM sp WINDOW w AS (PARTITION BY frame ORDER BY bin)),
pk AS (SELECT frame, bin AS p FROM t WHERE top), q AS (SELECT t.frame, t.bin, p, row_number() OVER (PARTITION BY t.frame, t.bin ORDER BY abs(t.bin - p), p) AS rn FROM t JOIN pk USING (frame))
SELECT frame, bin, p AS peak FROM q WHERE rn = 1""",
    "match_channels": f"WITH {LR} SELECT pair AS sig, ch, i, round((l + r) / 2, 6) + 0.0 AS x FROM lr, range(3) AS c(ch)",
    "source_layout": f"""WITH {LR} SELECT pair AS sig, ch, i, round(least(greatest(CASE ch WHEN 0 THEN l ELSE r END + CASE WHEN pair % 2 = 0 AND i < 40 THEN 8 * l ELSE 0 END, -1), 1), 6) + 0.0 AS x FROM lr, range(2) AS c(ch)""",
    "stage_integrity": f"WITH {LR} SELECT DISTINCT pair AS sig, CASE WHEN pair % 5 = 0 THEN 'lost' ELSE 'channels' END AS problem FROM lr WHERE pair % 5 = 0 OR pair % 7 = 0",
    "stem_summary": f"""WITH {LR} SELECT pair AS sig, CASE WHEN round(sqrt(avg(r * r)), 9) > round(sqrt(avg(l * l)), 9) THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS target,
  round(sqrt(avg(pow(0.1 * r, 2))) / nullif(sqrt(avg(pow(l + 0.9 * r, 2))), 0), 6) + 0.0 AS error FROM lr GROUP BY 1""",
    "repair_rollback": f"""WITH {RISK}, m AS (SELECT ev.sig, avg(x) AS x FROM ev JOIN rg ON rg.sig = ev.sig AND k * 0.5 >= "start" AND k * 0.5 < "end" GROUP BY 1)
SELECT t.sig, round(x, 6) + 0.0 AS before, round(x * CASE WHEN t.sig % 2 = 0 THEN 0.8 ELSE 1.1 END, 6) + 0.0 AS after, coalesce(t.sig % 2 = 0 AND x > 0, false) AS kept FROM t LEFT JOIN m USING (sig)""",
    "labels_and_rates": """SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_size = 0 THEN 'none' ELSE CAST(p_size % 7 * p_size * 100 AS VARCHAR) || 'Hz' END AS cutoff,
  CAST(CASE p_size % 3 WHEN 0 THEN 48000 ELSE p_size % 3 * 22050 END AS BIGINT) AS rate, round(60 / (p_size / 10), 6) + 0.0 AS bpm,
  CASE WHEN p_size % 5 > 0 THEN printf('%.2f%%', p_size / 7) ELSE chr(8212) END AS share FROM part""",
    "waveform_scaling": f"WITH {BEATS} SELECT sig, k, round(x / CASE WHEN sig % 4 = 0 THEN 1 ELSE coalesce(nullif(max(abs(x)) OVER (PARTITION BY sig) * 0.5, 0), 1) END, 6) + 0.0 AS x FROM ev",
    "settings_parse": """WITH q AS (SELECT p_partkey, trim(CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN ' ' WHEN 2 THEN ' Yes' WHEN 3 THEN 'off' WHEN 4 THEN ' -' || p_size || '.75 ' WHEN 5 THEN p_size || 'd' END) AS raw FROM part)
SELECT p_partkey, coalesce(try_cast(raw AS DOUBLE), 2.5) AS number, CAST(trunc(coalesce(try_cast(raw AS DOUBLE), 7)) AS BIGINT) AS whole,
  CASE WHEN coalesce(raw, '') = '' THEN true ELSE lower(raw) IN ('1', 'true', 'yes', 'on') END AS flag, coalesce(nullif(raw, ''), 'none') AS words FROM q""",
    "mid_side_retry": f"""WITH {LR}, g AS (SELECT pair, l * CASE WHEN pair % 9 = 0 THEN 0.001 ELSE 1 END AS l, r * CASE WHEN pair % 9 = 0 THEN 0.001 ELSE 1 END AS r FROM lr),
h AS (SELECT *, (l + r) / 2 AS m, (l - r) / 2 AS s FROM g), t AS (SELECT pair, max(greatest(abs(l), abs(r))) < pow(10, -45 / 20.0) AS quiet, sum(l * l + r * r) AS before,
  sum(2 * pow(m - 0.5 * m * m * m, 2) + 2 * pow(s - 0.5 * s * s * s, 2)) AS later, sqrt(avg(pow(0.5 * m * m * m, 2))) AS gone, sqrt(avg(m * m)) AS level FROM h GROUP BY 1)
SELECT pair AS sig, CASE WHEN quiet THEN 'skipped' ELSE 'mid_side' END AS strategy, round(CASE WHEN quiet THEN before ELSE later END, 6) + 0.0 AS energy,
  CASE WHEN quiet THEN CAST('-Infinity' AS DOUBLE) ELSE round(20 * log10(gone / level), 6) + 0.0 END AS residual FROM t""",
    "wav_roundtrip": """WITH v AS (SELECT vec_id, unnest(embedding)::FLOAT::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings WHERE vec_id - vec_id % 2 + 1 IN (SELECT vec_id FROM embeddings))
SELECT vec_id // 2 AS sig, vec_id % 2 AS ch, i, round(least(greatest(round_even(x * 8388608, 0), -8388608), 8388607) / 8388608, 6) + 0.0 AS x FROM v""",
    "chunked_model": f"""WITH {BEATS}, {SPANS}, e AS (SELECT s.sig, k AS i, CASE WHEN stop - start > 3 AND k < stop - 3 THEN x * 0.5 ELSE x END AS y,
  (CASE WHEN start > 0 AND k - start < {WIDTH} THEN {RAMP('k - start')} ELSE 1 END) * (CASE WHEN stop < n AND stop - 1 - k < {WIDTH} THEN {RAMP('stop - 1 - k')} ELSE 1 END) AS w FROM spans s JOIN ev ON ev.sig = s.sig AND k >= start AND k < stop)
SELECT sig, i, round(CASE WHEN sum(w) > 1e-6 THEN sum(y * w) / sum(w) ELSE any_value(y) END, 6) + 0.0 AS y FROM e GROUP BY 1, 2""",
    "resample": """WITH o AS (SELECT i, i * 48000 / 44100.0 AS pos, unnest(range(-18, 19)) AS k FROM range(0, 59) AS g(i)),
t AS (SELECT i, CAST(floor(pos) AS BIGINT) + k AS tap, (floor(pos) + k - pos) * 44100 / 48000.0 AS d FROM o),
w AS (SELECT i, tap, CASE WHEN abs(d) >= 16 THEN 0 WHEN abs(d) < 1e-12 THEN 1 ELSE sin(pi() * d) / (pi() * d) * pow(cos(pi() * d / 32), 2) END * 44100 / 48000.0 AS w FROM t WHERE tap BETWEEN 0 AND 63)
SELECT vec_id AS sig, i, round(sum(embedding[tap + 1]::DOUBLE * w), 6) + 0.0 AS y FROM embeddings, w GROUP BY 1, 2""",
    "coherence": """WITH f AS (SELECT CAST(label AS BIGINT) AS sig, vec_id AS frame, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings),
m AS (SELECT sig, frame, j, x - avg(x) OVER (PARTITION BY frame) AS x, x + 0.05 * sin(j) - avg(x + 0.05 * sin(j)) OVER (PARTITION BY frame) AS y, 0.5 - 0.5 * cos(2 * pi() * j / 64) AS w FROM f),
s AS (SELECT sig, frame, bin, sum(x * w * cos(2 * pi() * bin * j / 64)) AS xr, sum(x * w * sin(2 * pi() * bin * j / 64)) AS xi, sum(y * w * cos(2 * pi() * bin * j / 64)) AS yr, sum(y * w * sin(2 * pi() * bin * j / 64)) AS yi FROM m, range(8, 33) AS b(bin) GROUP BY 1, 2, 3),
c AS (SELECT sig, bin, (pow(sum(xr * yr + xi * yi), 2) + pow(sum(xi * yr - xr * yi), 2)) / greatest(sum(xr * xr + xi * xi) * sum(yr * yr + yi * yi), 1e-30) AS c FROM s GROUP BY 1, 2)
SELECT sig, round(avg(c), 6) + 0.0 AS coherence FROM c GROUP BY 1""",
    "k_weight": f"WITH RECURSIVE {WEIGHTED} SELECT sig, i, round(z, 6) + 0.0 AS y FROM k1",
    "k_weighted_loudness": f"WITH RECURSIVE {WEIGHTED}, {BLOCKS('q', LOUD_BLOCK)}, {GATED('q')} SELECT DISTINCT q.sig, round(coalesce(lufs, CAST('-Infinity' AS DOUBLE)), 6) + 0.0 AS lufs FROM q LEFT JOIN qu USING (sig)",
    "signal_description": f"""WITH RECURSIVE {WEIGHTED}, {BLOCKS('q', LOUD_BLOCK)}, {GATED('q')}, {BLOCKS('h', RANGE_BLOCK)}, {GATED('h')},
d AS (SELECT sig // 2 AS sig, max(sig % 2) + 1 AS channels, CAST(max(i) + 1 AS INTEGER) AS n, max(abs(v)) AS peak, CAST(count(*) FILTER (abs(v) >= 0.999969) AS BIGINT) AS clipped FROM k1 GROUP BY 1)
SELECT d.sig, channels, n, round(n / 48000.0, 6) + 0.0 AS duration, round(peak, 6) + 0.0 AS peak, round({DB('peak')}, 6) + 0.0 AS peak_db, clipped, round(coalesce(qu.lufs, CAST('-Infinity' AS DOUBLE)), 6) + 0.0 AS lufs, round(coalesce(hu.lra, 0), 6) + 0.0 AS lra
FROM d LEFT JOIN qu USING (sig) LEFT JOIN hu USING (sig)""",
    "local_offset_track": f"WITH RECURSIVE {TRACKED} SELECT sig, w, lag, round(score, 6) + 0.0 AS score FROM tr WHERE lag IS NOT NULL",
    "model_hook": "SELECT vec_id AS sig, CAST(len(embedding) AS INTEGER) AS n FROM embeddings",
}
# Blocks are another way to the same figures.
QUERIES |= {f"block_{n}": QUERIES[n] for n in ("k_weight", "max_step")} | {"block_loudness": QUERIES["k_weighted_loudness"], "block_offset_track": QUERIES["local_offset_track"], "wav_source": QUERIES["wav_roundtrip"]}
WELCH = """WITH f AS (SELECT vec_id AS sig, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings),
w AS (SELECT sig, s, j - s AS m, x, x + 0.05 * sin(j) AS y FROM f, range(0, 33, 16) AS g(s) WHERE j >= s AND j < s + 32),
m AS (SELECT sig, s, m, x - avg(x) OVER (PARTITION BY sig, s) AS x, y - avg(y) OVER (PARTITION BY sig, s) AS y, 0.5 - 0.5 * cos(2 * pi() * m / 32) AS w FROM w),
t AS (SELECT sig, s, bin, sum(x * w * cos(2 * pi() * bin * m / 32)) AS xr, sum(x * w * sin(2 * pi() * bin * m / 32)) AS xi, sum(y * w * cos(2 * pi() * bin * m / 32)) AS yr, sum(y * w * sin(2 * pi() * bin * m / 32)) AS yi FROM m, range(2, 17) AS b(bin) GROUP BY 1, 2, 3),
c AS (SELECT sig, bin, (pow(sum(xr * yr + xi * yi), 2) + pow(sum(xi * yr - xr * yi), 2)) / nullif(sum(xr * xr + xi * xi) * sum(yr * yr + yi * yi), 0) AS c FROM t GROUP BY 1, 2)
SELECT sig, round(avg(c), 6) + 0.0 AS coherence FROM c GROUP BY 1"""
IMAGE = lambda n, t: f"""m{n} AS (SELECT pair AS sig, sqrt(avg(pow((l + r) / 2, 2))) AS m, sqrt(avg(pow((l - r) / 2, 2))) AS s, coalesce({CORR('l', 'r')}, 1.0) AS corr FROM {t} GROUP BY 1)"""
DEEP = lambda n: f"CASE WHEN m{n}.s > 0 AND m{n}.m > 0 THEN round(20 * log10(m{n}.s) - 20 * log10(m{n}.m), 6) + 0.0 ELSE CAST('-Infinity' AS DOUBLE) END AS side_mid_{n}, round(m{n}.corr, 6) + 0.0 AS lr_{n}"
PART = lambda c, k, where: f"avg({c} * {c}) FILTER ({where}) AS {c}{k}"
PARTS = ", ".join(PART(c, k, w) for c in "ab" for k, w in enumerate(("i < o - 5", "i >= o AND i < o + 30", f"i >= o + {TAIL[0]} AND i < o + {sum(TAIL)}")))
LEVEL = lambda x: f"20 * log10(sqrt({x}) + 1e-12)"
QUERIES |= {
    "welch_coherence": WELCH, "block_coherence": WELCH,
    "fine_at_offsets": f"""WITH RECURSIVE {TRACKED}, fo AS (SELECT tr.sig, w, {CORR('a.x', 'b.x')} AS c, count(*) AS n FROM tr JOIN ev a ON a.sig = tr.sig AND a.k >= w * {TRACK[1]} AND a.k < w * {TRACK[1]} + 8
  JOIN ev b ON b.sig = tr.sig AND b.k = a.k + lag - 2 WHERE lag IS NOT NULL GROUP BY 1, 2)
SELECT sig, round(min(c), 6) + 0.0 AS fine_min, round(median(c), 6) + 0.0 AS fine_median FROM fo WHERE n = 8 AND c IS NOT NULL GROUP BY 1""",
    "stereo_both_sides": f"""WITH {LR}, nr AS (SELECT pair, i, 0.75 * l + 0.25 * r AS l, 0.25 * l + 0.75 * r AS r FROM lr), {IMAGE('a', 'lr')}, {IMAGE('b', 'nr')}
SELECT ma.sig, {DEEP('a')}, {DEEP('b')} FROM ma JOIN mb USING (sig)""",
    "transient_decay": f"""WITH s AS (SELECT event_id AS i, value / 500 AS a, value / 500 * pow(10, -0.1) AS b FROM events), o AS (SELECT i AS o FROM s WHERE a > 0.3 AND i >= 40),
g AS (SELECT o, {PARTS} FROM o JOIN s ON i >= o - 25 AND i < o + {sum(TAIL)} GROUP BY 1),
q AS (SELECT {LEVEL('a1')} - {LEVEL('a0')} AS sa, {LEVEL('b1')} - {LEVEL('b0')} AS sb, {LEVEL('a2')} - {LEVEL('a1')} AS da, {LEVEL('b2')} - {LEVEL('b1')} AS db FROM g WHERE a1 IS NOT NULL AND (a0 IS NOT NULL OR a2 IS NOT NULL))
SELECT CAST(1 AS BIGINT) AS sig, count(sa) AS n, {", ".join(f"round(median({k}{c}), 6) + 0.0 AS {n}_{c}" for n, k in (("slope", "s"), ("decay", "d")) for c in "ab")} FROM q HAVING count(*) > 0""",
}
