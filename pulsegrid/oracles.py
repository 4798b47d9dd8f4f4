"""DuckDB SQL of the registered queries, written from the rules, not from the plans."""

from __future__ import annotations

from . import constants as k
from .functions.synth import SELFTEST

MEL = "mel AS (SELECT label AS clip, t, unnest(range(64)) AS m, abs(unnest(embedding)::DOUBLE) AS v FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings))"
FLOOR = f"fl AS (SELECT clip, max(v) * {k.WHITEN_FLOOR} AS floor FROM mel GROUP BY clip)"
SLOPE = f"(-1.0 / ({k.WHITEN_SECS} * 20))"
WHITE = f"""{FLOOR}, wh AS (SELECT clip, t, m, v / peak AS v FROM (SELECT mel.*, greatest(exp(max(CASE WHEN v > 0 THEN ln(v) - t * {SLOPE} END) OVER (PARTITION BY clip, m ORDER BY t) + t * {SLOPE}), floor) AS peak FROM mel JOIN fl USING (clip)))"""
FLUX = "fx AS (SELECT clip, t, coalesce(x, lead(x) OVER (PARTITION BY clip ORDER BY t)) AS x FROM (SELECT clip, t, sum(greatest(d, 0)) AS x FROM (SELECT clip, t, ln(1 + 10 * v) - lag(ln(1 + 10 * v)) OVER (PARTITION BY clip, m ORDER BY t) AS d FROM {src}) GROUP BY clip, t))"
FLUX = FLUX.replace("sum(greatest(d, 0)) AS x", "CASE WHEN count(d) = 0 THEN NULL ELSE sum(greatest(d, 0)) END AS x")
DETREND = "dt AS (SELECT clip, t, x - avg(x) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS x FROM {src})"
ZSCORE = "zs AS (SELECT clip, t, CASE WHEN stddev_pop(x) OVER w > 1e-9 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS x FROM {src} WINDOW w AS (PARTITION BY clip))"
KICK = "kk AS (SELECT clip, t, low / max(whole) OVER (PARTITION BY clip) AS kick FROM (SELECT clip, t, sum(CASE WHEN m < 2 THEN v * v ELSE 0 END) AS low, sum(v * v) AS whole FROM mel GROUP BY clip, t))"
HOURS = "hr AS (SELECT event_type AS clip, h AS t, coalesce(x, 0) AS x FROM (SELECT event_type, unnest(range(720)) AS h FROM (SELECT DISTINCT event_type FROM events)) LEFT JOIN (SELECT event_type, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::BIGINT AS h, sum(value) AS x FROM events GROUP BY ALL) USING (event_type, h))"
ACF = "ac AS (SELECT a.clip, b.t - a.t AS lag, sum(a.x * b.x) / max(e) AS acf FROM hr a JOIN hr b ON a.clip = b.clip AND b.t - a.t BETWEEN 0 AND {most} JOIN (SELECT clip, sum(x * x) AS e FROM hr GROUP BY clip) n ON n.clip = a.clip GROUP BY a.clip, b.t - a.t)"
PRIOR = f"exp(-0.5 * pow(log2(bpm / {k.PRIOR_BPM}) / {k.PRIOR_OCTAVES}, 2))"
PEAKS = f"pk AS (SELECT * FROM (SELECT clip, lag, bpm, w AS weight, row_number() OVER (PARTITION BY clip ORDER BY w DESC, lag) AS rank FROM (SELECT *, lag(w) OVER o AS before, lead(w) OVER o AS after FROM (SELECT *, acf * {PRIOR} AS w FROM (SELECT *, 1200.0 / lag AS bpm FROM ac WHERE lag >= 4)) WINDOW o AS (PARTITION BY clip ORDER BY lag)) WHERE lag > 4 AND lag < 26 AND w > before AND w >= after AND w > 0) WHERE rank <= 10)"
CHROMA = f"""sp AS (SELECT clip, t, m AS b, v AS mag FROM mel), ch AS (
  SELECT clip, pc, sum(e / whole) AS e FROM (SELECT *, sum(e) OVER (PARTITION BY clip, t) AS whole FROM (
    SELECT clip, t, ((round(69 + 12 * log2(b * 55.0 / 440)) % 12) + 12)::INT % 12 AS pc, avg(mag) AS e FROM sp WHERE b * 55.0 BETWEEN {k.CHROMA_LOW} AND {k.CHROMA_HIGH} GROUP BY ALL)) GROUP BY clip, pc)"""
TWELVE = "ch AS (SELECT vec_id AS clip, unnest(range(12)) AS pc, abs(unnest(embedding[1:12])::DOUBLE) AS e FROM embeddings)"
GATES = """gt AS (SELECT clip, CASE WHEN mean > 1e-9 THEN sd / mean ELSE 0 END AS salience, CASE WHEN s > 1e-9 THEN s * s / s2 ELSE 0 END AS tpc FROM (
  SELECT clip, stddev_pop(e) AS sd, avg(e) AS mean, sum(p) AS s, sum(p * p) AS s2 FROM (SELECT *, e - min(e) OVER (PARTITION BY clip) AS p FROM ch) GROUP BY clip))"""
_rows = lambda rows: ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
EDM = "pf AS (SELECT * FROM (VALUES " + _rows((i, str(bool(m)).lower(), w) for m, shape in enumerate(k.PROFILES["edm"]) for i, w in enumerate(shape)) + ") AS p(degree, minor, w))"
LEARNED = "bw AS (SELECT * FROM (VALUES " + _rows((b, i, str(bool(m)).lower(), w) for m, mode in enumerate(k.BAND_WEIGHTS) for b, band in enumerate(mode) for i, w in enumerate(band)) + ") AS p(band, degree, minor, w))"
NAMES = "[" + ", ".join(f"'{p}'" for p in k.PITCHES) + "]"
unit = lambda x: f"least(greatest({x}, 0), 1)"
KEYNAME = lambda t, m: f"({NAMES}[{t} + 1] || CASE WHEN {m} THEN ' minor' ELSE ' major' END)"
CAMELOT = lambda t, m: f"((((CASE WHEN {m} THEN ({t} + 3) % 12 ELSE {t} END) * 7 + 7) % 12 + 1)::VARCHAR || CASE WHEN {m} THEN 'A' ELSE 'B' END)"
VERDICT = "CASE WHEN got IS NULL THEN 'missing' WHEN {near1} THEN 'ok' WHEN {octave} THEN 'octave_error' WHEN {metric} THEN 'metric_error' ELSE 'wrong' END"
_near = lambda *rs: " OR ".join(f"abs(got - want * {r}) <= 2 * greatest({r}, 1)" for r in rs)
VERDICT = VERDICT.format(near1=_near("1.0"), octave=_near("0.5", "2.0", "0.25", "4.0"), metric=_near("(2.0/3)", "1.5", "0.75", "(4.0/3)"))
NORM = lambda x: f"lower(trim(regexp_replace(replace({x}, '&', ' and '), '[^A-Za-z0-9]+', ' ', 'g')))"
WORDS = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
LEV = lambda a, b: f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"
TOK = lambda a, b: f"(CASE WHEN len(list_distinct({WORDS(a)} || {WORDS(b)})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({WORDS(a)}), list_distinct({WORDS(b)})))::DOUBLE / len(list_distinct({WORDS(a)} || {WORDS(b)})) END)"
SIM = lambda a, b: f"(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.5 * {LEV(a, b)} + 0.5 * {TOK(a, b)} END)"
CUT = lambda x, keep: f"trim(regexp_replace(' ' || {x} || ' ', '{'^( [^ ]+)' if keep else '^()'}(.*?) (feat|featuring|ft|with) .*$', '\\1\\2'))"


def neutral(x: str) -> str:
    for phrase in k.NEUTRAL:
        x = f"replace({x}, '{phrase}', ' ')"
    return f"array_to_string(list_filter({WORDS(x)}, lambda w: NOT regexp_full_match(w, '[0-9]{{4}}')), ' ')"


#: Titles and artists to match, made of part names with qualifiers in turn.
TITLED = """ti AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS name, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (Radio Edit)' WHEN 2 THEN p_name || ' (Deep Dish Remix)' WHEN 3 THEN p_name || ' [feat. ' || p_type || ']' WHEN 4 THEN p_name || ' (Remastered 2011)' ELSE p_name || ' feat. ' || p_type END AS title,
  CASE p_partkey % 4 WHEN 0 THEN p_brand || ' & ' || p_type WHEN 1 THEN p_brand || ' feat. Guest' ELSE p_brand END AS artist, p_partkey % 7 <> 0 AS preview FROM part)"""
MATCH = f"""{TITLED}, pt AS (SELECT *, {CUT(NORM("regexp_replace(title, '[(\\[][^)\\]]*[)\\]]', '', 'g')"), True)} AS core,
  {neutral(CUT(NORM("array_to_string(regexp_extract_all(title, '[(\\[]([^)\\]]*)[)\\]]', 1), '  ')"), False))} AS qual,
  {CUT(NORM("artist"), True)} AS act, {NORM("title")} AS plain,
  coalesce(nullif(regexp_extract(' ' || {NORM("array_to_string(regexp_extract_all(title, '[(\\[]([^)\\]]*)[)\\]]', 1), '  ')")} || ' ', ' (?:feat|featuring|ft|with) (.*)$', 1), ''), '') || ' ' ||
  coalesce(nullif(regexp_extract({NORM("regexp_replace(title, '[(\\[][^)\\]]*[)\\]]', '', 'g')")} || ' ', '^[^ ]+(?: [^ ]+)*? (?:feat|featuring|ft) (.*)$', 1), ''), '') AS credit,
  strlen(title) - strlen(regexp_replace(title, '[(\\[][^)\\]]*[)\\]]', '', 'g')) AS qbytes FROM ti),
 sc AS (SELECT q.id AS query_id, c.id AS track_id, c.qbytes, c.preview,
  0.65 * ((0.75 * {SIM("q.core", "c.core")} + 0.25 * {SIM("q.qual", "c.qual")}) * CASE WHEN q.plain <> c.plain THEN 0.97 ELSE 1.0 END)
  + 0.35 * CASE WHEN (len({WORDS("q.act")}) > 0 AND len(list_filter({WORDS("q.act")}, lambda w: NOT list_contains({WORDS("c.act")}, w))) = 0)
      OR (len({WORDS("c.act")}) > 0 AND len(list_filter({WORDS("c.act")}, lambda w: NOT list_contains({WORDS("q.act")}, w))) = 0
          AND len(list_filter({WORDS("q.act")}, lambda w: w <> 'and' AND NOT list_contains({WORDS("c.act")}, w) AND NOT list_contains({WORDS("c.credit")}, w))) = 0)
    THEN greatest({SIM("q.act", "c.act")}, 0.9) ELSE {SIM("q.act", "c.act")} END AS score
  FROM pt q JOIN pt c ON q.brand = c.brand AND q.name = c.name)"""
KEYED = f"turned AS (SELECT clip, tonic, (pc - tonic + 12) % 12 AS degree, e FROM ch, (SELECT unnest(range(12)) AS tonic)), co AS (SELECT clip, tonic, minor, CASE WHEN den > 1e-9 THEN (xy - x * y / 12) / den ELSE 0 END AS score FROM (SELECT clip, tonic, minor, sum(e * w) AS xy, sum(e) AS x, sum(w) AS y, sqrt(greatest(sum(e * e) - sum(e) * sum(e) / 12, 0) * greatest(sum(w * w) - sum(w) * sum(w) / 12, 0)) AS den FROM turned JOIN pf USING (degree) GROUP BY ALL))"
LINES = """ln AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 19 = 0 THEN ' ' WHEN o_orderkey % 17 = 0 THEN 'this is not json' WHEN o_orderkey % 13 = 0 THEN '[1]' ELSE '{' ||
  CASE WHEN o_orderkey % 5 = 0 THEN '"track_id":' || o_custkey || ',' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '"artist":"' || o_orderstatus || '",' END || '"title":"' || CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END || '"}' END AS line FROM orders)"""

SQL: dict[str, str] = {}


def sql(name: str, ctes: str, body: str) -> None:
    SQL[name] = (f"WITH {ctes} " if ctes else "") + body


sql("batch_parse", "", """SELECT line_no, artist, title, track_id, CASE WHEN bad OR (track_id IS NULL AND (artist IS NULL OR trim(title) = '')) THEN 'invalid_input' END AS error FROM (
  SELECT o_orderkey AS line_no, bad, CASE WHEN NOT bad AND o_orderkey % 7 <> 0 THEN o_orderstatus END AS artist, CASE WHEN NOT bad THEN CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END END AS title, CASE WHEN NOT bad AND o_orderkey % 5 = 0 THEN o_custkey END AS track_id
  FROM (SELECT *, o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 AS bad FROM orders WHERE o_orderkey % 19 <> 0))""")
sql("batch_ordered_results", "", """SELECT row_number() OVER (ORDER BY o_orderkey)::BIGINT AS place, o_orderkey AS line_no, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)) THEN 'error' ELSE 'ok' END AS status FROM orders WHERE o_orderkey % 19 <> 0""")
sql("pcm_stats", MEL, "SELECT clip, count(*) AS n, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg((abs(x) < 0.001)::INT), 6) AS silent_fraction FROM (SELECT label AS clip, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY clip")
sql("sanitize", "", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (2, 3) THEN 0.0 ELSE l_extendedprice END AS x, round(least(greatest(CASE WHEN l_linenumber IN (2, 3) THEN 0 ELSE l_discount * 20 - 0.2 END, 0), 1), 3) AS confidence, round(least(greatest(CASE WHEN l_linenumber IN (2, 3) THEN 0 ELSE l_discount * 20 - 0.2 END, 0), 1), 3) <= 0.5 AS uncertain FROM lineitem")
sql("mono_downmix", "", "SELECT l_orderkey AS clip, l_suppkey % 2 AS t, round(avg(l_quantity), 6) AS x FROM lineitem GROUP BY ALL")
sql("kick_energy", f"{MEL}, {KICK}", "SELECT clip, t, round(kick, 6) AS kick FROM kk")
sql("whiten", f"{MEL}, {WHITE}", "SELECT clip, t, m::INT AS m, round(v, 6) AS v FROM wh")
sql("log_flux", f"{MEL}, {FLUX.format(src='mel')}", "SELECT clip, t, round(x, 6) AS x FROM fx")
sql("onset_envelope", f"{MEL}, {WHITE}, {FLUX.format(src='wh')}, {DETREND.format(h=15, src='fx')}, {ZSCORE.format(src='dt')}, {KICK}", "SELECT clip, t, round(x, 6) AS x, round(kick, 6) AS kick FROM zs JOIN kk USING (clip, t)")
sql("detrend", f"{HOURS}, {DETREND.format(h=15, src='hr')}", "SELECT clip, t, round(x, 5) AS x FROM dt")
sql("zscore_pulse", f"{HOURS}, {ZSCORE.format(src='hr')}, pl AS (SELECT clip, stddev_pop(x) / avg(x) AS p FROM hr GROUP BY clip)", "SELECT clip, t, round(x, 6) AS x, round(p, 6) AS pulse_strength FROM zs JOIN pl USING (clip)")
sql("autocorrelation", f"{HOURS}, {ACF.format(most=27)}", "SELECT clip, lag, round(acf, 6) AS acf FROM ac")
sql("acf_peaks_topk", f"{HOURS}, {ACF.format(most=27)}, {PEAKS}", "SELECT clip, lag, round(bpm, 6) AS bpm, round(weight, 6) AS weight, rank FROM pk")
FOLD = lambda b: f"({b} * pow(2.0, -floor(log2({b} / 90.0))))"
sql("tempo_candidates", f"{HOURS}, {ACF.format(most=27)}, {PEAKS}, rt AS (SELECT unnest([1.0, 1.5, 2.0/3, 4.0/3, 0.75]) AS ratio, unnest(range(5)) AS i), fo AS (SELECT clip, list({FOLD('bpm * ratio')} ORDER BY rank, i) AS l FROM pk, rt GROUP BY clip), kept AS (SELECT clip, list_reduce(list_transform(l, lambda v: [v::DOUBLE]), lambda a, v: CASE WHEN len(list_filter(a, lambda o: abs(o - v[1]) < 0.5)) > 0 THEN a ELSE a || v END) AS kept FROM fo)", "SELECT clip, (unnest(range(len(kept))))::INT AS place, round(unnest(kept), 6) AS bpm FROM kept")
sql("hann_smooth", f"{HOURS}, kn AS (SELECT unnest(range(-3, 4)) AS o, unnest([0.5 - 0.5 * cos(2 * pi() * i / 8) for i in range(1, 8)]) AS w)", "SELECT a.clip, a.t, round(sum(b.x * w) / (SELECT sum(w) FROM kn), 6) AS x FROM hr a JOIN kn ON true JOIN hr b ON b.clip = a.clip AND b.t = a.t + o GROUP BY a.clip, a.t")
sql("interp_grid_mean", f"{HOURS}, g AS (SELECT clip, period, phase, unnest(range(floor((719 - phase) / period)::INT + 1)) AS k FROM (SELECT DISTINCT clip FROM hr), (SELECT unnest([7.5, 12.25, 24.0]) AS period), (SELECT unnest([0.0, 1.5]) AS phase))", "SELECT g.clip, period, phase, round(avg(a.x + (coalesce(b.x, a.x) - a.x) * (phase + k * period - floor(phase + k * period))), 4) AS mean FROM g JOIN hr a ON a.clip = g.clip AND a.t = floor(phase + k * period) LEFT JOIN hr b ON b.clip = g.clip AND b.t = floor(phase + k * period) + 1 GROUP BY ALL")
sql("tempo_fold", "", f"SELECT l_orderkey, l_linenumber, round(CASE WHEN b > 0 THEN {FOLD('b')} ELSE 0 END, 9) AS folded FROM (SELECT *, l_extendedprice / l_quantity - CASE WHEN l_linenumber = 7 THEN 1e6 ELSE 0 END AS b FROM lineitem)")
sql("comb_score", f"""{HOURS}, {ZSCORE.format(src='hr')}, tp AS (SELECT unnest([50.0, 97.0, 131.0]) AS bpm), ph AS (SELECT bpm, 1200.0 / bpm AS p, unnest(range(ceil(2400.0 / bpm)::INT)) AS s FROM tp),
  bt AS (SELECT bpm, p, s, floor((719 - s * 0.5) / p)::INT + 1 AS n, unnest(range(floor((719 - s * 0.5) / p)::INT + 1)) AS k FROM ph),
  sm AS (SELECT a.clip, bpm, p, s, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS sd FROM (SELECT a.clip, bpm, p, s, a.x + (coalesce(b.x, a.x) - a.x) * (s * 0.5 + k * p - floor(s * 0.5 + k * p)) AS v FROM bt JOIN zs a ON a.t = floor(s * 0.5 + k * p) LEFT JOIN zs b ON b.clip = a.clip AND b.t = a.t + 1) a GROUP BY ALL),
  be AS (SELECT *, row_number() OVER (PARTITION BY clip, bpm ORDER BY mean DESC, s) AS r FROM sm),
  mi AS (SELECT be.clip, be.bpm, sum(1 - least(near / whole, 1)) AS missed FROM be JOIN LATERAL (SELECT d, sum(CASE WHEN abs((zs.t - be.s * 0.5) / be.p * d - round((zs.t - be.s * 0.5) / be.p * d)) * (be.p / d) <= {k.HALF_WIDTH_SECS} * 20 THEN greatest(zs.x, 0) ELSE 0 END) AS near, sum(greatest(zs.x, 0)) AS whole FROM zs, (SELECT unnest([1, 2, 4]) AS d) WHERE zs.clip = be.clip GROUP BY d) ON true WHERE r = 1 GROUP BY ALL)""",
  "SELECT be.clip, be.bpm, round(mean - sd - 3 * missed, 5) AS score, round(mean, 5) AS mean, round(sd, 5) AS sd, s * 0.5 AS phase FROM be JOIN mi USING (clip, bpm) WHERE r = 1")


def comb_sql(name: str, series: str, tempos: str) -> str:
    """Tables of comb scores: ``tempos`` (clip, tag, bpm) on ``series``, as {name}(clip, tag, bpm, score, mean, sd, phase); 20 frames a second."""
    p = name
    return f"""{p}n AS (SELECT clip, count(*) AS n FROM {series} GROUP BY clip),
  {p}ph AS (SELECT clip, tag, bpm, n, 1200.0 / bpm AS p, unnest(range(ceil(2400.0 / bpm)::INT)) AS s FROM {tempos} JOIN {p}n USING (clip) WHERE 1200.0 / bpm >= 2 AND floor(1200.0 / bpm) < n),
  {p}bt AS (SELECT *, unnest(range(floor((n - 1 - s * 0.5) / p)::INT + 1)) AS k FROM {p}ph),
  {p}sm AS (SELECT q.clip, q.tag, q.bpm, q.p, q.s, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS sd FROM (SELECT c.clip, c.tag, c.bpm, c.p, c.s, a.x + (coalesce(b.x, a.x) - a.x) * (c.s * 0.5 + c.k * c.p - floor(c.s * 0.5 + c.k * c.p)) AS v FROM {p}bt c JOIN {series} a ON a.clip = c.clip AND a.t = floor(c.s * 0.5 + c.k * c.p)::BIGINT LEFT JOIN {series} b ON b.clip = c.clip AND b.t = floor(c.s * 0.5 + c.k * c.p)::BIGINT + 1) q GROUP BY ALL HAVING count(*) >= 4),
  {p}be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, tag ORDER BY mean DESC, s) AS r FROM {p}sm) WHERE r = 1),
  {p}mi AS (SELECT clip, tag, sum(1 - least(near / whole, 1)) AS missed FROM (SELECT e.clip, e.tag, w.d, sum(CASE WHEN abs((x.t - e.s * 0.5) / e.p * w.d - round((x.t - e.s * 0.5) / e.p * w.d)) * (e.p / w.d) <= {k.HALF_WIDTH_SECS} * 20 THEN greatest(x.x, 0) ELSE 0 END) AS near, sum(greatest(x.x, 0)) AS whole FROM {p}be e JOIN {series} x ON x.clip = e.clip JOIN (SELECT unnest([1, 2, 4]) AS d) w ON true GROUP BY ALL) GROUP BY ALL),
  {p} AS (SELECT e.clip, e.tag, e.bpm, mean - sd - 3 * missed AS score, mean, sd, s * 0.5 AS phase FROM {p}be e JOIN {p}mi m ON m.clip = e.clip AND m.tag = e.tag)"""


#: Candidates of the scaled hourly series: cd (clip, place, bpm).
ZS_ACF = ACF.replace("FROM hr", "FROM zs").replace("JOIN hr", "JOIN zs")
CAND = f"""{HOURS}, {ZSCORE.format(src='hr')}, {ZS_ACF.format(most=27)}, {PEAKS}, rt AS (SELECT unnest([1.0, 1.5, 2.0/3, 4.0/3, 0.75]) AS ratio, unnest(range(5)) AS i), fo AS (SELECT clip, list({FOLD('bpm * ratio')} ORDER BY rank, i) AS l FROM pk, rt GROUP BY clip),
  kept AS (SELECT clip, list_reduce(list_transform(l, lambda v: [v::DOUBLE]), lambda a, v: CASE WHEN len(list_filter(a, lambda o: abs(o - v[1]) < 0.5)) > 0 THEN a ELSE a || v END) AS kept FROM fo), cd AS (SELECT clip, unnest(range(len(kept))) AS place, unnest(kept) AS bpm FROM kept)"""
#: The best tempo near each candidate on a series: rf (clip, place, bpm, score, mean, sd, phase).
REFINE = lambda src: f"""rg AS (SELECT clip, place, bpm, {k.REFINE_DRIFT} / (720 / 20.0 * bpm / 60) AS step FROM cd), rh AS (SELECT *, ceil({k.REFINE_SPAN} / step)::INT AS h FROM rg),
  rw AS (SELECT *, unnest(range(-h, h + 1)) AS i FROM rh),
  ri AS (SELECT clip, place * 100000 AS tag, bpm FROM rh UNION ALL SELECT clip, place * 100000 + i + h + 1, bpm * (1 + i * step) FROM rw WHERE bpm * (1 + i * step) >= {k.LOW_BPM} AND bpm * (1 + i * step) < {k.HIGH_BPM}), {comb_sql('rc', src, 'ri')},
  rf AS (SELECT clip, tag // 100000 AS place, bpm, score, mean, sd, phase FROM rc QUALIFY row_number() OVER (PARTITION BY clip, tag // 100000 ORDER BY score DESC, tag) = 1)"""  # noqa: E731
SOFT = "kn AS (SELECT unnest(range(-2, 3)) AS o, unnest([0.5 - 0.5 * cos(2 * pi() * i / 6) for i in range(1, 6)]) AS w), so AS (SELECT a.clip, a.t, sum(b.x * w) / (SELECT sum(w) FROM kn) AS x FROM zs a JOIN kn ON true JOIN zs b ON b.clip = a.clip AND b.t = a.t + o GROUP BY a.clip, a.t)"
sql("tempo_refine", f"{CAND}, {SOFT}, {REFINE('so')}", "SELECT clip, place::INT AS place, round(bpm, 6) AS bpm, round(score, 5) AS score, round(mean, 5) AS mean, round(sd, 5) AS sd, phase FROM rf")
FINAL = f"""{CAND}, {REFINE('zs')}, fw AS (SELECT * FROM (SELECT clip, bpm, row_number() OVER (PARTITION BY clip ORDER BY score DESC, place) AS place FROM rf) WHERE place <= {k.FINALISTS}),
  pi AS (SELECT *, unnest(range(-ceil({k.PRECISION_SPAN} / ({k.PRECISION_DRIFT} / 720))::INT, ceil({k.PRECISION_SPAN} / ({k.PRECISION_DRIFT} / 720))::INT + 1)) AS i FROM fw),
  pg AS (SELECT clip, place, i AS turn, bpm * (1 + i * ({k.PRECISION_DRIFT} / 720)) AS bpm FROM pi),
  pp AS (SELECT *, 1200.0 / bpm AS p, unnest(range(ceil(2400.0 / bpm)::INT)) AS s FROM pg WHERE 1200.0 / bpm >= 2),
  pb AS (SELECT *, unnest(range(floor((719 - s * 0.5) / p)::INT + 1)) AS k FROM pp),
  pm AS (SELECT q.clip, q.place, q.turn, q.bpm, q.s, avg(v) AS mean FROM (SELECT c.clip, c.place, c.turn, c.bpm, c.s, a.x + (coalesce(b.x, a.x) - a.x) * (c.s * 0.5 + c.k * c.p - floor(c.s * 0.5 + c.k * c.p)) AS v FROM pb c JOIN zs a ON a.clip = c.clip AND a.t = floor(c.s * 0.5 + c.k * c.p)::BIGINT LEFT JOIN zs b ON b.clip = c.clip AND b.t = floor(c.s * 0.5 + c.k * c.p)::BIGINT + 1) q GROUP BY ALL HAVING count(*) >= 4),
  ft AS (SELECT clip, place AS tag, {FOLD('bpm')} AS bpm FROM pm QUALIFY row_number() OVER (PARTITION BY clip, place ORDER BY mean DESC, turn) = 1), {comb_sql('fc', 'zs', 'ft')},
  fi AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, tag) AS rank FROM fc)"""
sql("tempo_finalists", FINAL, "SELECT clip, rank::INT AS rank, round(bpm, 6) AS bpm, round(score, 5) AS score, round(mean, 5) AS mean, round(sd, 5) AS sd, phase FROM fi")
SURE = f"pow({unit('mean / 2.5')}, 0.5) * pow(CASE WHEN mean > 0 THEN {unit('mean / (mean + sd)')} ELSE 0 END * CASE WHEN rival IS NULL THEN 1 ELSE {unit('b.score - rival')} END * {unit('periodic / 0.5')} * {unit('720 / 20.0 * b.bpm / 60 / 32')}, 0.25)"
sql("tempo_estimates", f"""{FINAL}, on1 AS (SELECT * FROM fi WHERE rank = 1), rv AS (SELECT b.clip, arg_min(o.score, o.rank) AS rival FROM on1 b JOIN fi o ON o.clip = b.clip WHERE o.rank > 1 AND abs(o.bpm - b.bpm) >= 0.5 GROUP BY b.clip),
  mt AS (SELECT clip, 0 AS tag, bpm / 2 AS bpm FROM on1 UNION ALL SELECT clip, 1, bpm * 2 FROM on1), {comb_sql('mc', 'zs', 'mt')},
  pe AS (SELECT b.clip, a.acf + (coalesce(c.acf, a.acf) - a.acf) * (1200.0 / b.bpm - floor(1200.0 / b.bpm)) AS periodic FROM on1 b JOIN ac a ON a.clip = b.clip AND a.lag = floor(1200.0 / b.bpm)::BIGINT LEFT JOIN ac c ON c.clip = b.clip AND c.lag = floor(1200.0 / b.bpm)::BIGINT + 1)""",
  f"SELECT b.clip, round(b.bpm, 6) AS bpm, round(b.score, 5) AS score, round(rival, 5) AS rival, round(h.score, 5) AS half, round(d.score, 5) AS double, round({SURE}, 3) AS confidence FROM on1 b LEFT JOIN rv ON rv.clip = b.clip LEFT JOIN pe ON pe.clip = b.clip LEFT JOIN (SELECT clip, score FROM mc WHERE tag = 0) h ON h.clip = b.clip LEFT JOIN (SELECT clip, score FROM mc WHERE tag = 1) d ON d.clip = b.clip")
GRID = lambda src, value: f"SELECT c.clip, c.s, avg(a.{value} + (coalesce(b.{value}, a.{value}) - a.{value}) * (c.ph + c.k * c.p - floor(c.ph + c.k * c.p))) AS v FROM (SELECT *, unnest(range(floor((n - 1 - ph) / p)::INT + 1)) AS k FROM {src}) c JOIN ev a ON a.clip = c.clip AND a.t = floor(c.ph + c.k * c.p)::BIGINT LEFT JOIN ev b ON b.clip = c.clip AND b.t = floor(c.ph + c.k * c.p)::BIGINT + 1 GROUP BY c.clip, c.s"
sql("beat_phase", f"""{MEL}, {WHITE}, {FLUX.format(src='wh')}, {DETREND.format(h=15, src='fx')}, {ZSCORE.format(src='dt')}, {KICK}, ev AS (SELECT clip, t, x, kick FROM zs JOIN kk USING (clip, t)),
  tm AS (SELECT clip, (clip * 8.25 + 91.5)::DOUBLE AS bpm, 1200.0 / (clip * 8.25 + 91.5)::DOUBLE AS p, ceil(2400.0 / (clip * 8.25 + 91.5)::DOUBLE)::INT AS steps, count(*) AS n FROM ev GROUP BY clip),
  pz AS (SELECT *, unnest(range(steps)) AS s FROM tm), ps AS (SELECT *, s * 0.5 - floor(s * 0.5 / p) * p AS ph FROM pz),
  kg AS ({GRID('ps', 'kick')}),
  ri AS (SELECT ps.clip, ps.s, sum(u.v - d.v) / 2 AS rise FROM ps JOIN (SELECT unnest([1, 2]) AS i) w ON true JOIN kg u ON u.clip = ps.clip AND u.s = (ps.s + w.i) % ps.steps JOIN kg d ON d.clip = ps.clip AND d.s = (ps.s - w.i + 2 * ps.steps) % ps.steps GROUP BY ps.clip, ps.s),
  tp AS (SELECT *, max(rise) OVER (PARTITION BY clip) AS top FROM ri), st AS (SELECT clip, s FROM tp WHERE top >= {k.KICK_LEAST} AND rise >= {k.KICK_SHARE} * top),
  ne AS (SELECT DISTINCT ps.* FROM ps JOIN (SELECT unnest(range(-20, 21)) AS i) w ON w.i BETWEEN -floor({k.KICK_LAG} * ps.p * 2 + 0.5) AND floor({k.KICK_LEAD} * ps.p * 2 + 0.5) JOIN st ON st.clip = ps.clip AND st.s = (ps.s + w.i + 40 * ps.steps) % ps.steps),
  og AS ({GRID('ne', 'x')}), bp AS (SELECT og.clip, ps.ph FROM og JOIN ps ON ps.clip = og.clip AND ps.s = og.s QUALIFY row_number() OVER (PARTITION BY og.clip ORDER BY og.v DESC, og.s DESC) = 1)""",
  "SELECT tm.clip, bpm, round(coalesce(ph, -1), 6) AS phase FROM tm LEFT JOIN bp ON bp.clip = tm.clip")
PLACE = lambda shift: f"440 * pow(2.0, ({k.GRID_LOW} + j / {k.GRID_STEP}.0 + {shift} / {k.GRID_STEP} - 69) / 12) / (rate / 126)"
sql("grid_taps", f"{MEL}, ra AS (SELECT unnest([8000.0, 22050.0, 44100.0])::DOUBLE AS rate), jj AS (SELECT rate, j, {PLACE('0.0')} AS place, ceil({PLACE('-0.5')}) AS lo, floor({PLACE('0.5')}) AS hi FROM ra, (SELECT unnest(range({k.GRID_BINS})) AS j))",
  "SELECT clip, t, j::INT AS j, rate, round(CASE WHEN max(hi) >= max(lo) THEN max(CASE WHEN m BETWEEN least(lo, 63) AND least(hi, 63) THEN v END) WHEN max(floor(place)) + 1 < 64 THEN sum(CASE WHEN m = floor(place) THEN v * (1 - (place - floor(place))) WHEN m = floor(place) + 1 THEN v * (place - floor(place)) ELSE 0 END) ELSE 0 END, 6) AS g FROM jj, mel GROUP BY clip, t, j, rate")
sql("tempo_confidence", "", f"SELECT l_orderkey, l_linenumber, round(pow({unit('m / 2.5')}, 0.5) * pow(CASE WHEN m > 0 THEN {unit('m / (m + l_tax * 10)')} ELSE 0 END * CASE WHEN l_linenumber = 1 THEN 1 ELSE {unit('l_discount * 12')} END * {unit('l_tax * 8 / 0.5')} * {unit('l_quantity / 32')}, 0.25), 3) AS confidence FROM (SELECT *, l_extendedprice / 40000 - 0.1 AS m FROM lineitem)")
sql("chromagram", f"{MEL}, {CHROMA}", "SELECT clip, pc, round(e, 6) AS e FROM ch")
sql("chroma_gates", f"{TWELVE}, {GATES}", f"SELECT clip, round(salience, 6) AS salience, round(tpc, 6) AS tonal_pitch_classes, round({unit('(salience - 0.02) / 0.08')}, 6) AS structure, round({unit('(tpc - 3.5) / 2.0')}, 6) AS coverage FROM gt")
sql("key_correlation", f"{TWELVE}, {EDM}, {GATES}, {KEYED}, rk AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, tonic, minor) AS r FROM co)", f"SELECT a.clip, {KEYNAME('a.tonic', 'a.minor')} AS key, {CAMELOT('a.tonic', 'a.minor')} AS camelot, round(a.score, 6) AS correlation, round(b.score, 6) AS runner_up, round({unit('(a.score - 0.45) / 0.40')} * (1 - exp(-((a.score - b.score) / a.score) / 0.10)) * {unit('(salience - 0.02) / 0.08')} * {unit('(tpc - 3.5) / 2.0')}, 3) AS confidence FROM rk a JOIN rk b ON a.clip = b.clip AND a.r = 1 AND b.r = 2 JOIN gt ON gt.clip = a.clip WHERE a.score > 0")
sql("key_softmax", f"ba AS (SELECT vec_id AS clip, unnest(range(60)) AS i, abs(unnest(embedding[1:60])::DOUBLE) AS e FROM embeddings), {LEARNED}, z AS (SELECT clip, tonic, minor, sum(w * e) + CASE WHEN minor THEN {k.MODE_BIAS[1]} ELSE {k.MODE_BIAS[0]} END AS z FROM ba, (SELECT unnest(range(12)) AS tonic) t JOIN bw ON bw.band = i // 12 AND bw.degree = (i % 12 - tonic + 12) % 12 GROUP BY clip, tonic, minor)", "SELECT clip, tonic::INT AS tonic, minor, round(exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY clip), 6) AS score FROM (SELECT *, max(z) OVER (PARTITION BY clip) AS mx FROM z)")
sql("key_slopes", f"ba AS (SELECT vec_id AS clip, unnest(range(60)) AS i, abs(unnest(embedding[1:60])::DOUBLE) AS e FROM embeddings), {LEARNED}, z AS (SELECT clip, tonic, minor, sum(w * e) + CASE WHEN minor THEN {k.MODE_BIAS[1]} ELSE {k.MODE_BIAS[0]} END AS z FROM ba, (SELECT unnest(range(12)) AS tonic) t JOIN bw ON bw.band = i // 12 AND bw.degree = (i % 12 - tonic + 12) % 12 GROUP BY clip, tonic, minor), sh AS (SELECT clip, tonic, minor, exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY clip) AS share FROM (SELECT *, max(z) OVER (PARTITION BY clip) AS mx FROM z)), ov AS (SELECT clip, tonic, minor, share, (tonic = clip % 12 AND minor = (clip % 2 = 0)) AS hit FROM sh), gr AS (SELECT ov.minor, ba.i // 12 AS band, (ba.i % 12 - ov.tonic + 12) % 12 AS degree, sum((share - hit::INT) * e) AS g FROM ov JOIN ba ON ba.clip = ov.clip GROUP BY ALL)", "SELECT g.minor, g.band::INT AS band, g.degree::INT AS degree, round(g.g / (SELECT count(*) FROM embeddings) + 0.01 * w, 6) AS slope, round((SELECT -sum(ln(share)) / count(*) FROM ov WHERE hit) + (SELECT 0.005 * sum(w * w) FROM bw), 6) AS loss FROM gr g JOIN bw ON bw.minor = g.minor AND bw.band = g.band AND bw.degree = g.degree")
UP = "((b - a + 12) % 12)"
sql("key_labels", "", f"SELECT a::BIGINT AS tonic, am AS minor, b::BIGINT AS other, bm AS other_minor, {KEYNAME('a', 'am')} AS key, {CAMELOT('b', 'bm')} AS camelot, CASE WHEN am <> bm THEN CASE WHEN NOT am AND {UP} = 9 THEN 'relative_minor' WHEN am AND {UP} = 3 THEN 'relative_major' WHEN {UP} = 0 THEN 'parallel' ELSE 'other' END WHEN {UP} = 7 THEN 'dominant' WHEN {UP} = 5 THEN 'subdominant' ELSE 'other' END AS relation FROM (SELECT n_nationkey % 12 AS a, n_nationkey >= 12 AS am FROM nation WHERE n_nationkey < 24), (SELECT n_nationkey % 12 AS b, n_nationkey >= 12 AS bm FROM nation WHERE n_nationkey < 24)")
sql("stft_dft", "fr AS (SELECT vec_id AS clip, unnest(range(7)) AS t, embedding AS x FROM embeddings), sa AS (SELECT clip, t, unnest(range(16)) AS i, unnest(x[t * 8 + 1 : t * 8 + 16])::DOUBLE AS x FROM fr), wi AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS w FROM sa)", "SELECT clip, t, b, round(sqrt(pow(sum(w * cos(2 * pi() * i * b / 16)), 2) + pow(sum(w * sin(2 * pi() * i * b / 16)), 2)), 6) AS mag FROM wi, (SELECT unnest(range(9)) AS b) GROUP BY clip, t, b")
sql("stft_fft", "cl AS (SELECT label AS clip, flatten(list(embedding ORDER BY vec_id)) AS l FROM embeddings GROUP BY label), sa AS (SELECT clip, len(l) AS n, unnest(l)::DOUBLE AS x, unnest(range(len(l))) AS i FROM cl), wi AS (SELECT clip, i // 1024 AS t, i % 1024 AS i, x * (0.5 - 0.5 * cos(2 * pi() * (i % 1024) / 1024)) AS w FROM sa WHERE (i // 1024 + 1) * 1024 <= n)", "SELECT clip, t::BIGINT AS t, b::INT AS b, round(sqrt(pow(sum(w * cos(2 * pi() * i * b / 1024)), 2) + pow(sum(w * sin(2 * pi() * i * b / 1024)), 2)), 5) AS mag FROM wi, (SELECT unnest(range(513)) AS b) GROUP BY clip, t, b")
sql("band_grid", f"gr AS (SELECT vec_id AS clip, j::INT AS j, abs(embedding[j % 64 + 1]::DOUBLE) AS g FROM embeddings, (SELECT unnest(range(252)) AS j)), lg AS (SELECT clip, j, ln(1 + 100 * g / max(g) OVER (PARTITION BY clip)) AS x FROM gr), lv AS (SELECT *, avg(x) OVER (PARTITION BY clip ORDER BY j ROWS BETWEEN 9 PRECEDING AND 8 FOLLOWING) AS level FROM lg), sm AS (SELECT clip, CASE WHEN midi < 36 THEN 0 WHEN midi < 48 THEN 1 WHEN midi < 60 THEN 2 WHEN midi < 72 THEN 3 ELSE 4 END AS band, midi % 12 AS pc, sum(greatest(x - level, 0)) AS e FROM (SELECT *, 24 + j // 3 AS midi FROM lv WHERE j % 3 = 0) WHERE midi < 96 GROUP BY ALL)", "SELECT clip, band, pc, round(12 * e / sum(e) OVER (PARTITION BY clip), 6) AS e FROM sm")
sql("normalize_text", "", f"SELECT p_partkey, {NORM('x')} AS plain FROM (SELECT p_partkey, '  ' || p_name || ' & ' || p_brand || '--(' || p_type || ')! ' AS x FROM part)")
sql("similarity_pairs", "", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({SIM('a.p_name', 'b.p_name')}, 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
sql("pick_best", MATCH, "SELECT query_id, track_id, round(score, 3) AS match_score, score < 0.85 AS uncertain FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, qbytes, track_id) AS r FROM sc WHERE preview) WHERE r = 1")
sql("match_scores", MATCH, "SELECT query_id, track_id, round(score, 6) AS score, qbytes::BIGINT AS qualifier_bytes FROM sc")
sql("resolution_key", "", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'id' || cc || ':' || c_custkey WHEN c_custkey % 7 = 0 THEN NULL ELSE 'q3' || cc || ':' || lower(trim(c_name)) || chr(1) || lower(trim(c_mktsegment)) END AS key FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '@de' WHEN 2 THEN '' ELSE '' END AS cc FROM customer)")
sql("cache_latest", "", "SELECT o_custkey AS track_id, o_orderstatus AS options, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS payload FROM orders GROUP BY ALL")
sql("cache_hit_miss", "la AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)", "SELECT c_custkey AS track_id, CASE WHEN p % 9 <> 0 THEN p END AS hit, p IS NOT NULL AND p % 9 <> 0 AS cached FROM customer LEFT JOIN la ON o_custkey = c_custkey")
sql("dedupe_analyze", "", "SELECT l_orderkey, l_linenumber, l_partkey AS track_id, n AS shared FROM lineitem JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) USING (l_partkey)")
sql("rate_limit", "ar AS (SELECT event_id, user_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), ow AS (SELECT *, n - 0.3 / 60 * t + max(0.3 / 60 * t - n + 1) OVER (PARTITION BY user_id ORDER BY n) AS u FROM ar)", "SELECT event_id, round(greatest((u - 5) / (0.3 / 60), 0), 4) AS wait FROM ow")
sql("verdict", "", f"SELECT l_orderkey, l_linenumber, {VERDICT} AS verdict FROM (SELECT *, 90 + l_quantity AS want, CASE WHEN l_linenumber <> 6 THEN 60 + l_discount * 2000 END AS got FROM lineitem)")
sql("key_matches", "", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey % 12 = b.n_nationkey % 12 AND (a.n_nationkey >= 24 OR b.n_nationkey >= 24 OR (a.n_nationkey >= 12) = (b.n_nationkey >= 12)) AS matches FROM nation a, nation b")
#: Validation rows of all line items: what ``got`` and the keys are, by turns.
KEYOF = lambda i: f"({NAMES}[{i} + 1] || CASE WHEN l_linenumber % 2 = 0 THEN ' minor' ELSE ' major' END)"
CHECKED = f"""jd AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS label, l_returnflag AS genre, 90 + l_quantity AS want, CASE WHEN l_linenumber <> 6 THEN 60 + l_discount * 2000 END AS got, l_suppkey % 12 AS n FROM lineitem),
  vr AS (SELECT *, {VERDICT} AS verdict, CASE WHEN l_linenumber = 3 THEN '' ELSE {KEYOF('n')} END AS expected_key, CASE WHEN l_linenumber = 4 THEN {KEYOF('(n + 7) % 12')} WHEN l_linenumber <> 5 THEN {KEYOF('n')} END AS key,
    CASE WHEN l_linenumber <> 3 THEN l_linenumber NOT IN (4, 5) END AS key_ok, CASE WHEN got IS NOT NULL THEN round(l_discount * 10, 2) END AS sure, CASE WHEN l_linenumber <> 5 THEN round(l_tax * 12, 2) END AS key_sure FROM jd)"""
sql("validation_rows", CHECKED, "SELECT label, verdict, key_ok, verdict = 'ok' AND coalesce(key_ok, true) AS passed FROM vr")
sql("validation_summary", CHECKED, "SELECT genre, count(*) AS total, count(*) FILTER (verdict = 'ok') AS tempo_ok, count(*) FILTER (verdict = 'octave_error') AS octave_errors, count(*) FILTER (verdict = 'metric_error') AS metric_errors, count(*) FILTER (key_ok) AS key_ok, count(key_ok) AS key_checked, count(*) FILTER (verdict <> 'ok') AS failures FROM vr GROUP BY genre")
sql("validation_diagnostics", CHECKED, """SELECT label, label || CASE WHEN l_linenumber = 7 THEN chr(10) || '    failed: decode: broken' ELSE '' END ||
  CASE WHEN got IS NOT NULL THEN chr(10) || '    tempo: ' || printf('%.2f', got) || ' conf ' || printf('%.2f', sure) || CASE WHEN sure <= 0.5 THEN '  <- DISCARDED by a consumer' ELSE '' END ELSE '' END AS line
  FROM vr WHERE NOT (verdict = 'ok' AND coalesce(key_ok, true)) OR coalesce(sure <= 0.5, false)""")
sql("validation_report", CHECKED, """SELECT label, '| ' || label || ' | ' || genre || ' | ' || printf('%.0f', want) || ' | ' || coalesce(printf('%.2f', got), '—') || ' | ' ||
  CASE verdict WHEN 'ok' THEN 'ok' WHEN 'octave_error' THEN '**OCTAVE**' WHEN 'metric_error' THEN '**METRIC**' WHEN 'missing' THEN '**none**' ELSE '**wrong**' END || ' | ' ||
  CASE WHEN sure <= 0.5 THEN '**' || printf('%.2f', sure) || '**' ELSE coalesce(printf('%.2f', sure), '—') END || ' | ' || CASE WHEN expected_key = '' THEN '—' ELSE expected_key END || ' | ' ||
  CASE WHEN key_ok = false THEN '**' || coalesce(key, 'none') || '**' ELSE coalesce(key, '—') END || ' | — | ' || coalesce(printf('%.2f', key_sure), '—') || ' | ' || CASE WHEN key_sure <= 0.5 THEN 'no' WHEN key_sure > 0.5 THEN 'yes' ELSE '—' END || ' |' AS line FROM vr""")
sql("report_compare", "", "SELECT o_orderkey AS label, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'inconclusive' WHEN o_totalprice > 100000 AND o_totalprice <= 150000 THEN 'tempo_lost' WHEN o_custkey % 2 = 0 AND o_custkey % 4 = 0 THEN 'now_uncertain' WHEN o_orderstatus <> 'O' AND o_custkey % 3 = 0 THEN 'key_lost' ELSE 'same' END AS change FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)")
sql("calibration", "", "SELECT lang AS dataset, least(floor(c / 0.2), 4)::INT AS bin, count(*) AS n, round(avg(quality), 6) AS share FROM (SELECT lang, quality, (doc_id % 101) / 100.0 AS c FROM labels JOIN documents USING (doc_id)) GROUP BY ALL HAVING count(*) >= 10")
sql("mirex", "", f"SELECT a::BIGINT AS tonic, am AS minor, b::BIGINT AS got, bm AS got_minor, CASE WHEN am = bm AND {UP} = 0 THEN 1.0 WHEN am = bm AND {UP} IN (5, 7) THEN 0.5 WHEN am <> bm AND {UP} = CASE WHEN am THEN 3 ELSE 9 END THEN 0.3 WHEN am <> bm AND {UP} = 0 THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM (SELECT n_nationkey % 12 AS a, n_nationkey >= 12 AS am FROM nation WHERE n_nationkey < 24), (SELECT n_nationkey % 12 AS b, n_nationkey >= 12 AS bm FROM nation WHERE n_nationkey < 24)")
sql("fetch_policy", "", "SELECT page_id, regexp_matches(lower(url), '^https://[^/?#:]+') OR regexp_matches(lower(url), '^http://(localhost|127\\.0\\.0\\.1)([:/?#]|$)') AS allowed, kind IN ('', 'video/mp4') OR kind LIKE 'audio/%' AS plausible FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'audio/mpeg' WHEN 2 THEN 'video/mp4' ELSE 'text/html' END AS kind FROM pages)")
sql("search_url", "", "SELECT p_partkey, 'https://catalog.example/search?term=' || replace(replace(replace(p_name || ' ' || p_brand || ' ~*(x)', ' ', '+'), '#', '%23'), '*(x)', '%2A%28x%29') || '&media=music&entity=song&limit=12' || CASE WHEN p_partkey % 2 = 0 THEN '&country=de' ELSE '' END AS url FROM part")

sql("flagship", f"{MEL}, {WHITE}, {FLUX.format(src='wh')}, {DETREND.format(h=15, src='fx')}, {ZSCORE.format(src='dt')}, hr AS (SELECT clip, t, x FROM zs), {ACF.format(most=27)}, {PEAKS}, rt AS (SELECT unnest([1.0, 1.5, 2.0/3, 4.0/3, 0.75]) AS ratio, unnest(range(5)) AS i), fo AS (SELECT clip, list({FOLD('bpm * ratio')} ORDER BY rank, i) AS l FROM pk, rt GROUP BY clip), kept AS (SELECT clip, list_reduce(list_transform(l, lambda v: [v::DOUBLE]), lambda a, v: CASE WHEN len(list_filter(a, lambda o: abs(o - v[1]) < 0.5)) > 0 THEN a ELSE a || v END) AS kept FROM fo)", "SELECT clip, (unnest(range(len(kept))))::INT AS place, round(unnest(kept), 6) AS bpm FROM kept")
#: Requests are a part's brand and name; the catalog has all parts.  Names are plain, so a core is the name and there is no qualifier.
BLOCK = f"""en AS (SELECT p_partkey AS id, p_brand, p_name, {NORM("p_brand")} AS act, {NORM("p_name")} AS core, list_sort(list_distinct({WORDS(NORM("p_brand || ' ' || p_name"))})) AS w FROM part),
  ws AS (SELECT w, count(*) AS n, list_sort(list(id))[1:12] AS ids, first(act) AS act, first(core) AS core, count(DISTINCT act || '|' || core) AS kinds FROM en GROUP BY w),
  df AS (SELECT word, (1099511627776 // sum(n))::BIGINT AS weight FROM (SELECT unnest(w) AS word, n FROM ws) GROUP BY word),
  ix AS (SELECT w, unnest(w) AS word FROM ws),
  mt AS (SELECT a.w AS q, b.w AS c, count(*) AS shared, sum(weight) AS weight FROM ix a JOIN ix b USING (word) JOIN df USING (word) GROUP BY ALL),
  cd AS (SELECT q, id, shared, weight FROM (SELECT mt.*, unnest(ids) AS id FROM mt JOIN ws ON ws.w = mt.c)),
  tp AS (SELECT q, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY shared DESC, weight DESC, id) AS r FROM cd) WHERE r <= 12)"""
sql("block_and_match", BLOCK, f"""SELECT query_id, track_id, round(score, 3) AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, track_id) AS r FROM (
  SELECT q.id AS query_id, c.id AS track_id, 0.65 * (0.75 * {SIM("q.core", "c.core")} + 0.25) * CASE WHEN {NORM("q.p_name")} <> {NORM("c.p_name")} THEN 0.97 ELSE 1.0 END
    + 0.35 * CASE WHEN (len({WORDS("q.act")}) > 0 AND len(list_filter({WORDS("q.act")}, lambda w: NOT list_contains({WORDS("c.act")}, w))) = 0) OR (len({WORDS("c.act")}) > 0 AND len(list_filter({WORDS("c.act")}, lambda w: NOT list_contains({WORDS("q.act")}, w))) = 0 AND len(list_filter({WORDS("q.act")}, lambda w: w <> 'and' AND NOT list_contains({WORDS("c.act")}, w))) = 0) THEN greatest({SIM("q.act", "c.act")}, 0.9) ELSE {SIM("q.act", "c.act")} END AS score
  FROM tp JOIN en q ON q.w = tp.q JOIN en c ON c.id = tp.id)) WHERE r = 1""")
sql("key_alternates", f"{TWELVE}, {EDM}, {KEYED}, rk AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, tonic, minor) AS r FROM co)", f"""SELECT b.clip, (b.r - 2)::INT AS place, regexp_extract({CAMELOT('b.tonic', 'b.minor')}, '[0-9]+')::DOUBLE AS value, {KEYNAME('b.tonic', 'b.minor')} || ' (' || {CAMELOT('b.tonic', 'b.minor')} || ')' AS label,
  CASE WHEN a.minor <> b.minor THEN CASE WHEN NOT a.minor AND (b.tonic - a.tonic + 12) % 12 = 9 THEN 'relative_minor' WHEN a.minor AND (b.tonic - a.tonic + 12) % 12 = 3 THEN 'relative_major' WHEN b.tonic = a.tonic THEN 'parallel' ELSE 'other' END WHEN (b.tonic - a.tonic + 12) % 12 = 7 THEN 'dominant' WHEN (b.tonic - a.tonic + 12) % 12 = 5 THEN 'subdominant' ELSE 'other' END AS relation,
  round(b.score, 3) AS score FROM rk a JOIN rk b ON a.clip = b.clip AND a.r = 1 AND b.r BETWEEN 2 AND 4 WHERE a.score > 0""")
sql("key_bands", f"""ba AS (SELECT vec_id AS clip, unnest(range(60)) AS i, abs(unnest(embedding[1:60])::DOUBLE) AS e FROM embeddings), {LEARNED}, z AS (SELECT clip, tonic, minor, sum(w * e) + CASE WHEN minor THEN {k.MODE_BIAS[1]} ELSE {k.MODE_BIAS[0]} END AS z FROM ba, (SELECT unnest(range(12)) AS tonic) t JOIN bw ON bw.band = i // 12 AND bw.degree = (i % 12 - tonic + 12) % 12 GROUP BY clip, tonic, minor),
  co AS (SELECT clip, tonic::INT AS tonic, minor, exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY clip) AS score FROM (SELECT *, max(z) OVER (PARTITION BY clip) AS mx FROM z)), rk AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, tonic, minor) AS r FROM co),
  ch AS (SELECT clip, i % 12 AS pc, sum(e) AS e FROM ba GROUP BY ALL), {GATES},
  al AS (SELECT a.clip, a.tonic, a.minor, a.score AS r1, b.score AS r2, {unit('(salience - 0.02) / 0.08')} AS structure, {unit('(tpc - 3.0) / 1.0')} AS coverage FROM rk a JOIN rk b ON a.clip = b.clip AND a.r = 1 AND b.r = 2 JOIN gt ON gt.clip = a.clip)""",
  f"SELECT clip, {KEYNAME('tonic', 'minor')} AS key, {CAMELOT('tonic', 'minor')} AS camelot, round(r1 * structure * coverage, 3) AS confidence, round(r1 * structure * coverage, 3) <= 0.5 AS uncertain, round(r1, 6) AS correlation, round(r2, 6) AS runner_up, round(structure, 6) AS structure, round(coverage, 6) AS coverage FROM al")
sql("chroma_key", f"{TWELVE}, {EDM}, {KEYED}, rk AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, tonic, minor) AS r FROM co)", f"SELECT clip, CASE WHEN score > 0 THEN {KEYNAME('tonic', 'minor')} END AS key FROM rk WHERE r = 1")
sql("key_metrics", f"""j AS (SELECT lang AS dataset, doc_id % 12 AS a, doc_id % 2 = 0 AS am, (doc_id + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 9 END) % 12 AS b, (doc_id % 2 = 0) <> (toxic = 1) AS bm, (doc_id % 101) / 100.0 AS c FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT *, (a = b AND am = bm)::INT AS exact, CASE WHEN am = bm AND {UP} = 0 THEN 1.0 WHEN am = bm AND {UP} IN (5, 7) THEN 0.5 WHEN am <> bm AND {UP} = CASE WHEN am THEN 3 ELSE 9 END THEN 0.3 WHEN am <> bm AND {UP} = 0 THEN 0.2 ELSE 0.0 END AS m FROM j)""",
  "SELECT dataset, count(*) AS n, round(avg(exact), 6) AS exact, round(avg(m)::DOUBLE, 6) AS mirex, round(avg((c > 0.5)::INT), 6) AS coverage, round(avg(exact) FILTER (c > 0.5), 6) AS precision FROM s GROUP BY dataset")
sql("track_lookup", "", "SELECT o_orderkey AS line_no, o_custkey AS track_id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN greatest(c_name, 'A') END AS artist, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN 1.0::DOUBLE END AS match_score, CASE WHEN c_custkey IS NULL OR c_custkey % 7 = 0 THEN 'not_found' WHEN c_custkey % 5 = 0 THEN 'no_preview' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
sql("resolution_cache", "la AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1)", "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN p END AS track_id FROM customer LEFT JOIN la ON o_custkey = c_custkey")
sql("resolvable_rows", "", "SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'id:' || c_nationkey ELSE 'q3:' || lower(c_mktsegment) || chr(1) || 't' END AS query_key FROM customer WHERE c_custkey % 3 <> 0")
sql("stream_batch", "", """SELECT CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, artist, title, track_id, error FROM (SELECT artist, title, track_id, CASE WHEN bad OR (track_id IS NULL AND (artist IS NULL OR trim(title) = '')) THEN 'invalid_input' WHEN track_id IS NULL THEN 'no_match' WHEN c_custkey IS NULL THEN 'not_found' ELSE 'no_preview' END AS error FROM (
  SELECT bad, CASE WHEN NOT bad AND o_orderkey % 7 <> 0 THEN o_orderstatus END AS artist, CASE WHEN NOT bad THEN CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END END AS title, CASE WHEN NOT bad AND o_orderkey % 5 = 0 THEN o_custkey END AS track_id
  FROM (SELECT *, o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 AS bad FROM orders WHERE o_orderkey % 19 <> 0)) LEFT JOIN customer ON c_custkey = track_id)""")
sql("search_responses", "", """SELECT p_brand || '/' || p_size AS key, p_partkey AS track_id, p_name AS title, p_brand AS artist, NULL::VARCHAR AS error FROM part WHERE p_size % 10 > 1
  UNION ALL SELECT DISTINCT p_brand || '/' || p_size, NULL, NULL, NULL, CASE WHEN p_size % 10 = 0 THEN 'http' END FROM part WHERE p_size % 10 <= 1""")
sql("manifest_rows", "", "SELECT 'set' AS dataset, c_custkey::VARCHAR AS id, c_name AS url, (c_custkey % 14)::INT AS tonic_pc, CASE WHEN c_custkey % 3 = 0 THEN 'major' ELSE 'minor' END AS mode FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 14 < 12 AND c_custkey % 3 < 2")
sql("confident_labels", "", "SELECT 'set' AS dataset, c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 3 THEN 9 ELSE 11 END::INT AS tonic_pc, CASE WHEN c_custkey % 5 IN (0, 4) THEN 'minor' ELSE 'major' END AS mode FROM customer WHERE c_nationkey % 3 = 2 AND c_custkey % 5 <> 2")
sql("parsed_options", "p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'de' WHEN 4 THEN 'jp' END AS country, CASE c_custkey % 5 WHEN 0 THEN 'bands' WHEN 1 THEN 'krumhansl' WHEN 4 THEN NULL ELSE 'edm' END AS profile, ['bands', 'ks', 'shaath', 'edm', 'other'][c_custkey % 5 + 1] AS said FROM customer)", "SELECT c_custkey, country, profile, 'key_profile=' || said || ',explain_key_scoring=' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS options, 'https://catalog.example/lookup?id=' || c_custkey || '&entity=song' || coalesce('&country=' || country, '') AS lookup_url FROM p")
_pow2 = lambda secs: f"pow(2, ceil(log2(floor({secs} * rate))))::INT"
sql("frame_sizes", f"r AS (SELECT (n_nationkey * 3777 + 4000)::INT AS rate FROM nation), s AS (SELECT rate, {_pow2(k.ONSET_WINDOW)} AS o, {_pow2(k.CHROMA_WINDOW)} AS c, (greatest(1, floor(16384 / 44100 * rate / 256 + 0.5)) * 256)::INT AS b FROM r)", "SELECT rate, o AS onset_window, (o // 8)::INT AS onset_hop, c AS chroma_window, (c // 4)::INT AS chroma_hop, b AS band_window, (b // 8)::INT AS band_hop FROM s")
_mel = lambda hz: f"2595 * log10(1 + {hz} / 700.0)"
sql("mel_filterbank", f"""ed AS (SELECT i, 700 * (pow(10, ({_mel(k.MEL_LOW)} + i * (({_mel(11000.0)}) - {_mel(k.MEL_LOW)}) / 65) / 2595) - 1) AS hz FROM (SELECT unnest(range(66)) AS i)),
  tr AS (SELECT a.i AS m, a.hz AS low, b.hz AS mid, c.hz AS high FROM ed a JOIN ed b ON b.i = a.i + 1 JOIN ed c ON c.i = a.i + 2), bi AS (SELECT b, b * 22000 / 126.0 AS hz FROM (SELECT unnest(range(64)) AS b)),
  wt AS (SELECT m, b, greatest(CASE WHEN hz <= mid THEN (hz - low) / (mid - low) ELSE (high - hz) / (high - mid) END, 0) AS w FROM tr, bi WHERE hz BETWEEN low AND high),
  x AS (SELECT vec_id, unnest(range(64)) AS b, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings)""", "SELECT vec_id AS clip, m::INT AS m, round(sum(w * v), 6) AS v FROM x JOIN wt USING (b) WHERE w > 0 GROUP BY ALL")
sql("middle_slice", "s AS (SELECT vec_id, embedding AS x, vec_id % 7 + 4 AS rate FROM embeddings), c AS (SELECT vec_id, x[floor(greatest(64.0 / rate - 8, 0) / 2 * rate)::INT + 1 : floor(greatest(64.0 / rate - 8, 0) / 2 * rate)::INT + rate * 8] AS y FROM s)", "SELECT vec_id, len(y)::INT AS n, round(list_sum(list_transform(y, lambda v: v::DOUBLE)), 5) AS total FROM c")
#: What each self-test signal was made with: the tempo to the nearest beat and the key must be found.
sql("wav_decode_analyze", "q AS (SELECT label AS clip, trunc(greatest(least(x, 1), -1) * 32767 + CASE WHEN x < 0 THEN -0.5 ELSE 0.5 END) / 32768 AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings)), me AS ("
    f"SELECT clip, count(*) AS n, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg((abs(x) < {k.SILENT})::INT), 6) AS silent_fraction, round(count(*) / 8000.0, 6) AS duration_secs, round(avg((abs(x) < {k.SILENT})::INT), 6) AS told_silent, 8000::INT AS sample_rate FROM q GROUP BY clip), "
    "he AS (SELECT clip::INT AS clip, bpm::DOUBLE AS expected_bpm, bpm::DOUBLE AS bpm, name AS expected_key, true AS key_right, 30.0::DOUBLE AS signal_secs FROM (VALUES " + ", ".join(f"({i}, {bpm}, '{name}')" for i, (bpm, _, _, name, *_) in enumerate(SELFTEST)) + ") AS t(clip, bpm, name))", "SELECT * FROM me FULL JOIN he USING (clip)")
