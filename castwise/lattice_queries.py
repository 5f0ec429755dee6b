"""Queries over the whole lattice (spines x models x aggregations) of adapter D, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import corpus
from .plans.pin import written
from .sources import adapters

D_SQL = r"""
WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS play_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS pos, event_type AS et,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k, (user_id % 12)::INT AS ch, floor(value)::BIGINT AS words, hour(ts)::BIGINT AS middle, (hour(ts) // 6)::BIGINT AS large FROM events),
ty AS (SELECT *, CASE WHEN et = 'signup' THEN CASE WHEN k % 6 = 1 THEN 'merge' ELSE 'entrance' END WHEN et = 'error' THEN CASE WHEN k % 6 = 0 THEN 'split' ELSE 'exit' END
    WHEN et = 'purchase' THEN 'onStage' WHEN et = 'click' AND ch < 9 THEN 'speech' WHEN k % 2 = 1 THEN 'crossing' ELSE 'state-change' END AS type FROM e),
m AS MATERIALIZED (SELECT play_id, pos, type, words, middle, large, CASE WHEN et = 'purchase' AND k % 10 = 0 THEN []::VARCHAR[] WHEN type = 'speech' AND k % 5 = 0 AND ch = 0 THEN ['women'] WHEN type = 'speech' AND k % 5 = 0 AND ch = 3 THEN ['chorus']
    WHEN type = 'speech' AND k % 7 = 0 AND ch <> 1 THEN [ch::VARCHAR, '1'] ELSE [ch::VARCHAR] END AS who, CASE WHEN type IN ('split', 'merge') THEN [((ch + 1) % 12)::VARCHAR] ELSE []::VARCHAR[] END AS corresp FROM ty),
oe AS (SELECT play_id, pos, unnest(who) AS ch, 1 AS on_ FROM m WHERE type IN ('entrance', 'onStage') UNION ALL SELECT play_id, pos, unnest(corresp), 1 FROM m WHERE type IN ('split', 'merge') UNION ALL SELECT play_id, pos, unnest(who), 0 FROM m WHERE type IN ('exit', 'split', 'merge')),
ev AS (SELECT * FROM oe UNION ALL SELECT o.play_id, m.pos, o.ch, 0 FROM (SELECT DISTINCT play_id, ch FROM oe) o JOIN m ON m.play_id = o.play_id AND m.type = 'onStage' AND len(m.who) = 0),
chg AS (SELECT * FROM (SELECT *, lag(on_, 1, 0) OVER (PARTITION BY play_id, ch ORDER BY pos) AS was FROM ev) WHERE on_ <> was),
iv AS MATERIALIZED (SELECT play_id, ch AS char_id, pos AS a, z FROM (SELECT *, lead(pos) OVER (PARTITION BY play_id, ch ORDER BY pos) AS z FROM chg) WHERE on_ = 1),
fl AS (SELECT *, type IN ('entrance', 'exit', 'onStage', 'split', 'merge') AS opens, type = 'onStage' AND len(who) = 0 AND pos = min(CASE WHEN type <> 'speech' THEN pos END) OVER (PARTITION BY play_id) AS marker,
    type = 'onStage' AND len(who) = 0 AND pos = max(CASE WHEN type <> 'speech' THEN pos END) OVER (PARTITION BY play_id) AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.play_id = m.play_id AND iv.a < m.pos AND (iv.z IS NULL OR iv.z >= m.pos)) AS bracket FROM m),
rs AS (SELECT *, coalesce(sum((opens OR type = 'speech')::INT) OVER (PARTITION BY play_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS open_before FROM fl WHERE NOT marker),
rx AS (SELECT *, sum(CASE WHEN bracket AND open_before THEN 0 WHEN opens THEN 1 WHEN type = 'speech' AND NOT open_before THEN 1 ELSE 0 END) OVER (PARTITION BY play_id ORDER BY pos)::BIGINT AS x FROM rs),
mk AS (SELECT play_id, count(*) AS shift FROM fl WHERE marker GROUP BY play_id),
st AS MATERIALIZED (SELECT 'sd' AS sg, rx.play_id, pos, type, who, words, x + coalesce(shift, 0) AS seg, NULL::VARCHAR AS unit FROM rx LEFT JOIN mk USING (play_id) WHERE x > 0 UNION ALL SELECT 'sd', play_id, pos, type, who, words, 1, NULL FROM fl WHERE marker
    UNION ALL SELECT 'middle-seq', play_id, pos, type, who, words, dense_rank() OVER (PARTITION BY play_id ORDER BY middle), 'part/h' || middle::VARCHAR FROM m UNION ALL SELECT 'large-seq', play_id, pos, type, who, words, dense_rank() OVER (PARTITION BY play_id ORDER BY large), 'part/q' || large::VARCHAR FROM m),
s0 AS MATERIALIZED (SELECT sg, play_id, seg, any_value(unit) AS unit, min(pos) AS a, max(pos) AS z, coalesce(sum(words) FILTER (type = 'speech'), 0)::BIGINT AS wc, count(*) FILTER (type = 'speech') AS ns, count(*) FILTER (type = 'crossing') AS nc FROM st GROUP BY sg, play_id, seg),
said0 AS MATERIALIZED (SELECT sg, play_id, seg, pos, unnest(who) AS ch, words FROM st WHERE type = 'speech'),
cast0 AS MATERIALIZED (SELECT sg, s0.play_id, seg, char_id AS ch FROM s0 JOIN iv ON iv.play_id = s0.play_id AND iv.a <= s0.z AND (iv.z IS NULL OR CASE WHEN sg = 'sd' THEN iv.z > s0.z ELSE iv.z >= s0.a END) UNION SELECT sg, play_id, seg, ch FROM said0),
s1 AS MATERIALIZED (SELECT *, seg = min(seg) OVER w AS ini, seg = max(seg) OVER w AND (sg <> 'sd' OR (count(*) OVER w > 1 AND NOT filled)) AS fin FROM (SELECT s0.*, EXISTS (SELECT 1 FROM cast0 c WHERE c.sg = s0.sg AND c.play_id = s0.play_id AND c.seg = s0.seg) AS filled FROM s0) WINDOW w AS (PARTITION BY sg, play_id)),
s2 AS MATERIALIZED (SELECT *, CASE WHEN sg <> 'sd' THEN sg || '-' || seg::VARCHAR || '-' || unit WHEN ini AND NOT filled THEN 'sd-' || seg::VARCHAR || '-initial-empty' WHEN ini THEN 'sd-' || seg::VARCHAR || '-initial' WHEN fin THEN 'sd-' || seg::VARCHAR || '-final' ELSE 'sd-' || seg::VARCHAR END AS label FROM s1),
mp AS (SELECT * FROM (VALUES ('women', '0', 'women'), ('women', '1', 'women'), ('women', '2', 'women'), ('women', '9', 'women')) t(g, part, whole) UNION ALL SELECT x.g, p.part, 'chorus' FROM (VALUES ('chorus'), ('chorus,women')) x(g), (VALUES ('0'), ('1'), ('2'), ('9'), ('women'), ('3')) p(part)),
pl AS (SELECT DISTINCT play_id FROM m),
nm AS (SELECT play_id, ch FROM pl, (SELECT range::VARCHAR AS ch FROM range(12) UNION ALL VALUES ('women'), ('chorus')) c),
hd AS (SELECT DISTINCT play_id, ch FROM said0),
raw AS (SELECT nm.play_id, nm.ch, hd.ch IS NULL AS mute FROM nm LEFT JOIN hd ON hd.play_id = nm.play_id AND hd.ch = nm.ch),
gk AS (SELECT * FROM (VALUES (''), ('women'), ('chorus'), ('chorus,women')) t(g)),
ppl AS MATERIALIZED (SELECT play_id, gk.g, coalesce(whole, ch) AS ch, bool_and(mute) AS mute, bool_or(whole IS NOT NULL OR ch IN ('women', 'chorus')) AS coll, bool_or(ch = 'chorus') AS cho, max(CASE WHEN whole IS NULL THEN ch END) AS own FROM raw CROSS JOIN gk LEFT JOIN mp ON mp.g = gk.g AND mp.part = ch GROUP BY play_id, gk.g, coalesce(whole, ch)),
ab AS (SELECT x.play_id, x.g, x.ch AS part FROM ppl x JOIN ppl y ON y.play_id = x.play_id AND y.g = x.g AND y.ch = 'chorus' AND NOT y.mute WHERE x.mute AND x.ch IN ('0', '1', '2', '9', 'women', '3')),
rl AS MATERIALIZED (SELECT md, play_id, g, part, whole FROM mp, pl, (VALUES ('full'), ('s-speaking')) v(md) UNION ALL SELECT 'p-speaking', pl.play_id, mp.g, mp.part, CASE WHEN ab.part IS NOT NULL THEN 'chorus' ELSE whole END FROM mp CROSS JOIN pl LEFT JOIN ab ON ab.play_id = pl.play_id AND ab.g = mp.g AND ab.part = mp.whole
    UNION ALL SELECT 'p-speaking', play_id, g, part, 'chorus' FROM ab WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.g = ab.g AND mp.part = ab.part)),
lt AS (SELECT * FROM gk, (VALUES ('full'), ('p-speaking'), ('s-speaking')) v(md)),
vst AS MATERIALIZED (SELECT DISTINCT sg, lt.md, lt.g, c.play_id, seg, coalesce(whole, ch) AS ch FROM cast0 c CROSS JOIN lt LEFT JOIN rl ON rl.md = lt.md AND rl.play_id = c.play_id AND rl.g = lt.g AND rl.part = ch),
vsd AS MATERIALIZED (SELECT DISTINCT sg, lt.md, lt.g, c.play_id, seg, pos, coalesce(whole, ch) AS ch, words FROM said0 c CROSS JOIN lt LEFT JOIN rl ON rl.md = lt.md AND rl.play_id = c.play_id AND rl.g = lt.g AND rl.part = ch),
vo AS MATERIALIZED (SELECT DISTINCT sg, md, g, play_id, ch FROM vsd),
spk AS MATERIALIZED (SELECT sg, md, g, play_id, seg, ch, sum(words)::BIGINT AS words FROM vsd GROUP BY ALL),
kst AS MATERIALIZED (SELECT vst.* FROM vst SEMI JOIN vo ON vo.sg = vst.sg AND vo.md = vst.md AND vo.g = vst.g AND vo.play_id = vst.play_id AND vo.ch = vst.ch),
own0 AS (SELECT * FROM vst WHERE md = 'full' UNION ALL SELECT * FROM kst WHERE md = 'p-speaking' UNION ALL SELECT sg, md, g, play_id, seg, ch FROM spk WHERE md = 's-speaking'),
sets AS (SELECT lt.md, lt.g, s2.play_id, s2.seg, list(kst.ch ORDER BY kst.ch) FILTER (kst.ch IS NOT NULL) AS mem FROM s2 JOIN lt ON lt.md <> 'full' LEFT JOIN kst ON kst.sg = 'sd' AND kst.md = lt.md AND kst.g = lt.g AND kst.play_id = s2.play_id AND kst.seg = s2.seg WHERE s2.sg = 'sd' GROUP BY ALL),
eqn AS (SELECT md, g, play_id, seg, coalesce(mem, []) AS mem, CASE WHEN coalesce(mem, []) = lag(coalesce(mem, [])) OVER (PARTITION BY md, g, play_id ORDER BY seg) THEN 0 ELSE 1 END AS new FROM sets),
eqf AS MATERIALIZED (SELECT *, sum(new) OVER (PARTITION BY md, g, play_id ORDER BY seg)::BIGINT AS b FROM eqn),
sv AS (SELECT g, play_id, seg, list(ch) AS said FROM spk WHERE sg = 'sd' AND md = 's-speaking' GROUP BY ALL),
blk AS MATERIALIZED (SELECT eqf.g, eqf.play_id, b, any_value(mem) AS mem, list_distinct(flatten(list(coalesce(said, [])))) AS said FROM eqf LEFT JOIN sv ON sv.g = eqf.g AND sv.play_id = eqf.play_id AND sv.seg = eqf.seg WHERE md = 's-speaking' GROUP BY ALL),
sf AS (SELECT g, play_id, b, 1::BIGINT AS run, mem, []::VARCHAR[] AS cross_, said AS voices FROM blk WHERE b = 1
    UNION ALL SELECT g, play_id, b, run + cut::INT, mem, CASE WHEN cut THEN [] ELSE crossing END, CASE WHEN cut THEN said ELSE list_distinct(list_concat(voices, said)) END
    FROM (SELECT *, (len(mem) > 0) <> (len(last) > 0) OR len(list_intersect(crossing, list_concat(voices, said))) > 0 AS cut FROM (SELECT blk.*, sf.run, sf.mem AS last, sf.voices, list_distinct(list_concat(cross_, list_concat(list_filter(blk.mem, lambda x: NOT list_contains(sf.mem, x)), list_filter(sf.mem, lambda x: NOT list_contains(blk.mem, x))))) AS crossing FROM sf JOIN blk ON blk.g = sf.g AND blk.play_id = sf.play_id AND blk.b = sf.b + 1))),
fo AS MATERIALIZED (SELECT 'sd' AS sg, md, g, play_id, seg, b AS f FROM eqf WHERE md = 'p-speaking' UNION ALL SELECT 'sd', md, eqf.g, eqf.play_id, seg, run FROM eqf JOIN sf ON sf.g = eqf.g AND sf.play_id = eqf.play_id AND sf.b = eqf.b WHERE md = 's-speaking'),
own AS MATERIALIZED (SELECT DISTINCT sg, md, g, play_id, coalesce(f, seg) AS seg, ch FROM own0 LEFT JOIN fo USING (sg, md, g, play_id, seg)),
stg AS MATERIALIZED (SELECT DISTINCT sg, md, g, play_id, coalesce(f, seg) AS seg, ch FROM vst LEFT JOIN fo USING (sg, md, g, play_id, seg)),
sp AS MATERIALIZED (SELECT sg, md, g, play_id, coalesce(f, seg) AS seg, ch, sum(words)::BIGINT AS words FROM spk LEFT JOIN fo USING (sg, md, g, play_id, seg) GROUP BY ALL),
sm AS (SELECT s2.sg, lt.md, lt.g, s2.play_id, coalesce(f, s2.seg) AS seg, min(a) AS a, max(z) AS z, sum(wc)::BIGINT AS wc, sum(ns)::BIGINT AS ns, sum(nc)::BIGINT AS nc, arg_min(ini, s2.seg) AS ini, arg_max(fin, s2.seg) AS fin, arg_min(label, s2.seg) AS l0, max(f) AS folded
    FROM s2 CROSS JOIN lt LEFT JOIN fo ON fo.sg = s2.sg AND fo.md = lt.md AND fo.g = lt.g AND fo.play_id = s2.play_id AND fo.seg = s2.seg GROUP BY ALL),
seg AS MATERIALIZED (SELECT sm.sg, sm.md, sm.g, sm.play_id, sm.seg, a, z, wc, ns, nc, ini, fin, CASE WHEN folded IS NULL THEN l0 WHEN ini AND n IS NULL THEN 'sd-' || sm.seg::VARCHAR || '-initial-empty' WHEN ini THEN 'sd-' || sm.seg::VARCHAR || '-initial' WHEN fin THEN 'sd-' || sm.seg::VARCHAR || '-final' ELSE 'sd-' || sm.seg::VARCHAR END AS label
    FROM sm LEFT JOIN (SELECT sg, md, g, play_id, seg, count(*) AS n FROM stg GROUP BY ALL) q ON q.sg = sm.sg AND q.md = sm.md AND q.g = sm.g AND q.play_id = sm.play_id AND q.seg = sm.seg),
no AS (SELECT * FROM (VALUES ('0', 'women'), ('1', 'women'), ('2', 'women'), ('9', 'women'), ('0', 'chorus'), ('1', 'chorus'), ('2', 'chorus'), ('9', 'chorus'), ('chorus', 'women'), ('3', 'chorus')) t(src, dst)),
ed AS MATERIALIZED (SELECT x.sg, x.md, x.g, x.play_id, x.ch AS src, y.ch AS dst, count(*) AS n, sum(wc)::BIGINT AS w FROM own x JOIN own y ON x.sg = y.sg AND x.md = y.md AND x.g = y.g AND x.play_id = y.play_id AND x.seg = y.seg AND x.ch < y.ch
    JOIN seg ON seg.sg = x.sg AND seg.md = x.md AND seg.g = x.g AND seg.play_id = x.play_id AND seg.seg = x.seg ANTI JOIN no ON no.src = x.ch AND no.dst = y.ch GROUP BY ALL)
"""

V = "sg AS segmentation, md AS model, g AS groups, play_id"

D_COMPARE = D_SQL + r""",
nd AS MATERIALIZED (SELECT DISTINCT sg, md, g, play_id, ch FROM own),
de AS MATERIALIZED (SELECT sg, md, g, play_id, src AS ch, dst AS o FROM ed UNION ALL SELECT sg, md, g, play_id, dst, src FROM ed),
dg AS MATERIALIZED (SELECT nd.*, count(o) AS d FROM nd LEFT JOIN de USING (sg, md, g, play_id, ch) GROUP BY ALL),
tr AS (SELECT a.sg, a.md, a.g, a.play_id, unnest([a.src, a.dst, b.dst]) AS ch FROM ed a JOIN ed b ON b.sg = a.sg AND b.md = a.md AND b.g = a.g AND b.play_id = a.play_id AND b.src = a.dst JOIN ed c ON c.sg = a.sg AND c.md = a.md AND c.g = a.g AND c.play_id = a.play_id AND c.src = a.src AND c.dst = b.dst),
cl AS (SELECT dg.*, CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS c FROM dg LEFT JOIN (SELECT sg, md, g, play_id, ch, count(*) AS t FROM tr GROUP BY ALL) USING (sg, md, g, play_id, ch)),
c1 AS (SELECT sg, md, g, play_id, count(*) AS n, max(d) AS md_, sum(d)::BIGINT // 2 AS e, avg(c) AS ac FROM cl GROUP BY ALL),
bfs AS (SELECT sg, md, g, play_id, ch AS s, ch AS t, 0 AS d FROM nd UNION SELECT bfs.sg, bfs.md, bfs.g, bfs.play_id, s, o, d + 1 FROM bfs JOIN de ON de.sg = bfs.sg AND de.md = bfs.md AND de.g = bfs.g AND de.play_id = bfs.play_id AND de.ch = t WHERE d < 7),
ds AS (SELECT sg, md, g, play_id, s, t, min(d) AS d FROM bfs GROUP BY ALL),
pn AS (SELECT sg, md, g, play_id, s, min(t) AS comp, sum(d)::BIGINT AS total, max(d) AS far FROM ds GROUP BY ALL),
pc AS (SELECT sg, md, g, play_id, comp, count(*) AS k, sum(total) AS total, max(far) AS dia FROM pn GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY sg, md, g, play_id ORDER BY k DESC, comp) AS r, count(*) OVER (PARTITION BY sg, md, g, play_id) AS comps FROM pc),
cn AS (SELECT sg, md, g, play_id, seg, list(ch ORDER BY ch) AS mem FROM own GROUP BY ALL),
sq AS MATERIALIZED (SELECT seg.*, coalesce(mem, []) AS mem, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sg, md, g, play_id) AS n FROM seg LEFT JOIN cn USING (sg, md, g, play_id, seg) WINDOW w AS (PARTITION BY sg, md, g, play_id ORDER BY seg)),
sc AS (SELECT *, row_number() OVER (PARTITION BY sg, md, g, play_id ORDER BY seg) - 1 AS pt, count(*) OVER (PARTITION BY sg, md, g, play_id) AS k FROM sq WHERE NOT (rn = 1 AND ini AND len(mem) = 0 AND n > 1)),
fa AS (SELECT sg, md, g, play_id, ch, min(pt) AS pt, any_value(k) AS k FROM (SELECT sg, md, g, play_id, pt, k, unnest(mem) AS ch FROM sc) GROUP BY ALL),
ai AS (SELECT sg, md, g, play_id, max(pt) AS pt, (max(pt) + 1) / max(k) AS ix, count(*) AS size FROM fa GROUP BY ALL),
al AS (SELECT ai.*, CASE WHEN sc.sg = 'sd' THEN label ELSE regexp_extract(label, '^(?:large-seq|middle-seq)-\d+-(.+)$', 1) END AS lab FROM ai JOIN sc USING (sg, md, g, play_id, pt)),
fz AS (SELECT sg, md, g, play_id, arg_max(len(mem), seg) AS f FROM sq WHERE len(mem) > 0 GROUP BY ALL),
ms AS (SELECT sg, md, g, play_id, max(v) AS v FROM (SELECT sg, md, g, play_id, seg, count(DISTINCT ch) AS v FROM sp WHERE words > 0 GROUP BY ALL) GROUP BY ALL),
ct AS (SELECT sg, md, g, play_id, count(*) AS segments FROM seg GROUP BY ALL),
nx AS (SELECT *, lead(mem) OVER w AS nm, lead(fin) OVER w AS nf, rn = n - 1 AS nl FROM sq WINDOW w AS (PARTITION BY sg, md, g, play_id ORDER BY seg)),
cr AS (SELECT sg, md, g, play_id, avg(CASE WHEN len(mem) + len(nm) = 0 THEN 0 ELSE 1 - len(list_intersect(mem, nm)) / len(list_distinct(list_concat(mem, nm))) END) AS r FROM nx WHERE nm IS NOT NULL AND NOT (rn = 1 AND ini AND len(mem) = 0) AND NOT (nl AND nf AND len(nm) = 0) GROUP BY ALL),
tk AS (SELECT DISTINCT lt.md, lt.g, x.play_id, pos, coalesce(whole, ch) AS ch, words FROM (SELECT play_id, pos, unnest(who) AS ch, words FROM m WHERE type = 'speech') x CROSS JOIN lt LEFT JOIN rl ON rl.md = lt.md AND rl.play_id = x.play_id AND rl.g = lt.g AND rl.part = ch),
tt AS (SELECT md, g, play_id, ch, sum(words)::BIGINT AS w FROM tk WHERE words > 0 GROUP BY ALL),
tg AS (SELECT *, row_number() OVER (PARTITION BY md, g, play_id ORDER BY w) AS i FROM tt),
sd_ AS (SELECT md, g, play_id, 2 * sum(i * w) / (count(*) * sum(w)) - (count(*) + 1) / count(*) AS gini, pow(sum(w), 2) / sum(w * w) AS eff, max(w) / sum(w) AS share, arg_min(ch, (-w, ch)) AS top FROM tg GROUP BY ALL),
ac AS (SELECT sg, md, g, play_id, min(seg) AS lo, max(seg) AS hi FROM stg GROUP BY ALL),
tw AS (SELECT z.sg, z.md, z.g, z.play_id, z.ch, z.seg, coalesce(words, 0) AS w FROM (SELECT sg, md, g, play_id, seg, ch FROM stg UNION SELECT sg, md, g, play_id, seg, ch FROM sp WHERE words > 0) z JOIN ac USING (sg, md, g, play_id) LEFT JOIN sp ON sp.sg = z.sg AND sp.md = z.md AND sp.g = z.g AND sp.play_id = z.play_id AND sp.ch = z.ch AND sp.seg = z.seg WHERE z.seg BETWEEN lo AND hi),
ti AS (SELECT *, row_number() OVER (PARTITION BY sg, md, g, play_id, ch ORDER BY w) AS i FROM tw),
tq AS (SELECT sg, md, g, play_id, ch, 2 * sum(i * w) / (count(*) * sum(w)) - (count(*) + 1) / count(*) AS gini FROM ti GROUP BY ALL HAVING sum(w) > 0)
SELECT ct.play_id AS id, 'Day ' || ct.play_id AS play, 'Author ' || right(ct.play_id, 1) AS author, ct.sg AS segmentation, ct.md AS model, ct.g AS aggregated, coalesce(c1.n, 0) AS "order", coalesce(e, 0) AS edges, round(CASE WHEN c1.n > 1 THEN 2 * e / (c1.n * (c1.n - 1)) ELSE 0 END, 6) AS density,
  round(2 * e / c1.n, 6) AS avg_degree, md_ AS max_degree, dia::BIGINT AS diameter, round(CASE WHEN pr.k > 1 THEN pr.total / (pr.k * (pr.k - 1)) ELSE 0 END, 6) AS avg_path_length, round(ac, 6) AS avg_clustering, comps AS components, segments, round(coalesce(ix, 0), 6) AS all_in_index, lab AS all_in_segment_label,
  round(coalesce(f / size, 0), 6) AS final_segment_cast_share, CASE WHEN size > 0 THEN coalesce(v, 0) ELSE 0 END AS max_simultaneous_speakers, round(coalesce(sd_.gini, 0), 6) AS gini_words, round(coalesce(eff, 0), 6) AS effective_speakers, top AS top_speaker, round(coalesce(share, 0), 6) AS top_speaker_word_share,
  round(tq.gini, 6) AS top_speaker_temporal_gini, round(cr.r, 6) AS drama_change_rate
FROM ct LEFT JOIN c1 USING (sg, md, g, play_id) LEFT JOIN pr ON pr.sg = ct.sg AND pr.md = ct.md AND pr.g = ct.g AND pr.play_id = ct.play_id AND pr.r = 1 LEFT JOIN al ON al.sg = ct.sg AND al.md = ct.md AND al.g = ct.g AND al.play_id = ct.play_id LEFT JOIN fz ON fz.sg = ct.sg AND fz.md = ct.md AND fz.g = ct.g AND fz.play_id = ct.play_id
LEFT JOIN ms ON ms.sg = ct.sg AND ms.md = ct.md AND ms.g = ct.g AND ms.play_id = ct.play_id LEFT JOIN cr ON cr.sg = ct.sg AND cr.md = ct.md AND cr.g = ct.g AND cr.play_id = ct.play_id LEFT JOIN sd_ ON sd_.md = ct.md AND sd_.g = ct.g AND sd_.play_id = ct.play_id
LEFT JOIN tq ON tq.sg = ct.sg AND tq.md = ct.md AND tq.g = ct.g AND tq.play_id = ct.play_id AND tq.ch = sd_.top"""

ROUNDED = ("density", "avg_degree", "avg_path_length", "avg_clustering", "all_in_index", "final_segment_cast_share", "gini_words", "effective_speakers", "top_speaker_word_share", "top_speaker_temporal_gini", "drama_change_rate")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def keyed(a, name: str):
    """A table of the lattice with its variant's own columns."""
    v = a["variants"].withColumnRenamed("play_id", "_vid")
    return a[name].withColumnRenamed("play_id", "_vid").drop(*(c for c in ("play", "segmentation", "model", "groups") if c in a[name].columns)).join(v, "_vid").drop("_vid").withColumnRenamed("play", "play_id")


def d_lattice(spark, d):
    return corpus.lattice(adapters.event_plays(spark, d))


@query(D_COMPARE)
def comparison_table(spark, d):
    """The flagship: every spine, model and aggregation of every play, one row and 26 columns each."""
    c = corpus.analyse(adapters.event_plays(spark, d), nodes_too=False)["comparison"]
    return c.select(*(F.round(x, 6).alias(x) if x in ROUNDED else x for x in c.columns))


D_NODES = D_COMPARE[: D_COMPARE.index("\nSELECT ct.play_id")] + r""",
wd AS (SELECT sg, md, g, play_id, ch, sum(n)::BIGINT AS w FROM (SELECT sg, md, g, play_id, src AS ch, n FROM ed UNION ALL SELECT sg, md, g, play_id, dst, n FROM ed) GROUP BY ALL),
tn AS (SELECT sg, md, g, play_id, ch, count(*) AS t FROM tr GROUP BY ALL),
sx AS (SELECT sg, md, g, play_id, s, t, d, 1.0::DOUBLE AS sigma FROM ds WHERE d = 0 UNION ALL SELECT x.sg, x.md, x.g, x.play_id, x.s, ds.t, ds.d, sum(sigma) FROM sx x JOIN de ON de.sg = x.sg AND de.md = x.md AND de.g = x.g AND de.play_id = x.play_id AND de.ch = x.t
  JOIN ds ON ds.sg = x.sg AND ds.md = x.md AND ds.g = x.g AND ds.play_id = x.play_id AND ds.s = x.s AND ds.t = de.o AND ds.d = x.d + 1 GROUP BY x.sg, x.md, x.g, x.play_id, x.s, ds.t, ds.d),
si AS MATERIALIZED (SELECT * FROM sx),
bw AS (SELECT a.sg, a.md, a.g, a.play_id, a.t AS ch, sum(a.sigma * b.sigma / c.sigma) AS b FROM si a JOIN si b ON b.sg = a.sg AND b.md = a.md AND b.g = a.g AND b.play_id = a.play_id AND b.s = a.t AND a.d > 0 AND b.d > 0
  JOIN si c ON c.sg = a.sg AND c.md = a.md AND c.g = a.g AND c.play_id = a.play_id AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY ALL),
oc AS (SELECT sg, md, g, play_id, count(*) AS n FROM nd GROUP BY ALL),
cs AS (SELECT sg, md, g, play_id, s AS ch, count(*) AS reach, sum(d) AS total FROM ds GROUP BY ALL)
"""


@query(D_NODES + f"SELECT sg AS segmentation, md AS model, g AS groups, play_id, ch AS char_id, cl.d AS degree, coalesce(w, 0) AS weighted_degree, coalesce(tn.t, 0) AS triangles, round(c, 6) AS clustering, round(CASE WHEN total > 0 AND oc.n > 1 THEN (reach - 1) / total * (reach - 1) / (oc.n - 1) ELSE 0 END, 6) AS closeness, "
    "round(coalesce(b, 0) / CASE WHEN oc.n > 2 THEN (oc.n - 1) * (oc.n - 2) ELSE 1 END, 6) AS betweenness FROM cl JOIN oc USING (sg, md, g, play_id) JOIN cs USING (sg, md, g, play_id, ch) LEFT JOIN wd USING (sg, md, g, play_id, ch) LEFT JOIN tn USING (sg, md, g, play_id, ch) LEFT JOIN bw USING (sg, md, g, play_id, ch)")
def lattice_node_metrics(spark, d):
    """Every character's network measures in every variant."""
    a = d_lattice(spark, d)
    rows = keyed(a | {"node_metrics": corpus.node_metrics(a | {"edges": written(a["edges"])})}, "node_metrics")
    return rows.select("segmentation", "model", "groups", "play_id", "char_id", "degree", "weighted_degree", "triangles", "clustering", "closeness", "betweenness")


@query("WITH c AS (" + D_COMPARE + """) SELECT r.id, r.segmentation, r.model, r."order" AS raw_order, r.edges AS raw_edges, r.top_speaker AS raw_top_speaker, a."order" AS agg_order, a.edges AS agg_edges, a.avg_clustering AS agg_clustering, a.top_speaker AS agg_top_speaker
FROM c r LEFT JOIN c a ON a.id = r.id AND a.segmentation = r.segmentation AND a.model = r.model AND a.aggregated = 'chorus,women' WHERE r.aggregated = ''""")
def play_blocks(spark, d):
    """A play's block of each segmentation and model, with its fully aggregated counterpart nested in it."""
    b = corpus.play_blocks(corpus.analyse(adapters.event_plays(spark, d), nodes_too=False))
    told = lambda k, c, name: F.col(f"{k}.{c}").alias(f"{k}_{name}")
    return b.select("id", "segmentation", "model", told("raw", "order", "order"), told("raw", "edges", "edges"), told("raw", "top_speaker", "top_speaker"), told("agg", "order", "order"), told("agg", "edges", "edges"), F.round("agg.avg_clustering", 6).alias("agg_clustering"), told("agg", "top_speaker", "top_speaker"))


@query(D_SQL + f"SELECT {V}, seg AS seg_id, label, a AS start_pos, z AS end_pos, wc AS word_count, ns AS num_speeches, nc AS num_crossings, ini AS is_initial, fin AS is_final FROM seg")
def lattice_segments(spark, d):
    return keyed(d_lattice(spark, d), "segments").select("segmentation", "model", "groups", "play_id", "seg_id", "label", "start_pos", "end_pos", "word_count", "num_speeches", "num_crossings", "is_initial", "is_final")


@query(D_SQL + f"SELECT {V}, seg AS seg_id, ch AS char_id FROM own")
def lattice_casts(spark, d):
    return keyed(d_lattice(spark, d), "cast").select("segmentation", "model", "groups", "play_id", "seg_id", "char_id")


@query(D_SQL + f"SELECT {V}, src, dst, n AS segments_shared, w AS words_shared FROM ed")
def lattice_edges(spark, d):
    return keyed(d_lattice(spark, d), "links").select("segmentation", "model", "groups", "play_id", "src", "dst", "segments_shared", "words_shared")


@query(D_SQL + "SELECT play_id, g AS groups, ch AS char_id, mute AS is_mute, coll AS is_collective, cho AS is_chorus, CASE WHEN own IS NULL THEN NULL ELSE 'No. ' || own END AS name FROM ppl")
def aggregated_characters(spark, d):
    """Declared characters as each aggregation leaves them: groups collective, flags inherited, mutes told anew."""
    t = adapters.event_plays(spark, d)
    return corpus.all_characters(t).select("play_id", "groups", "char_id", "is_mute", "is_collective", "is_chorus", F.col("name_en").alias("name"))


D_PEOPLE = D_SQL + """, dm AS (SELECT play_id, g, count(*) FILTER (NOT mute) AS speakers, count(*) FILTER (mute) AS mutes, count(*) FILTER (coll AND NOT mute) AS collective_speakers, count(*) FILTER (own IN ('0', '1', '2', 'women')) AS female,
  count(*) FILTER (own NOT IN ('0', '1', '2', 'women', '11')) AS male, count(*) FILTER (own IS NULL OR own = '11') AS unspecified, count(*) FILTER (own = '10') AS divine FROM ppl GROUP BY ALL) """


@query(D_PEOPLE + "SELECT play_id, g AS groups, speakers, mutes, collective_speakers, female, male, unspecified, divine FROM dm")
def demographics_by_variant(spark, d):
    t = adapters.event_plays(spark, d)
    x = corpus.demographics(corpus.all_characters(t))
    return x.select("play_id", "groups", "speakers", "mutes", "collective_speakers", "female", "male", "unspecified", "divine")


@query(D_SQL + "SELECT play_id, g AS groups, count(*) AS speakers, count(*) FILTER (coll) AS collectives FROM ppl WHERE NOT mute GROUP BY ALL")
def demographics_of_speakers(spark, d):
    t = adapters.event_plays(spark, d)
    return corpus.demographics(corpus.all_characters(t), include_mutes=False).select("play_id", "groups", "speakers", "collectives")


@query(D_PEOPLE + "SELECT play_id, g AS source, round(speakers / nullif(speakers + mutes, 0), 6) AS speakers_share, round(female / nullif(female + male, 0), 6) AS female_share FROM dm WHERE g = 'chorus,women'")
def composition_source(spark, d):
    """Ratios of a play are told from its fullest aggregation."""
    t = adapters.event_plays(spark, d)
    x = corpus.ratio_source(corpus.demographics(corpus.all_characters(t)))
    return x.select("play_id", "source", F.round("speakers_share", 6).alias("speakers_share"), F.round("female_share", 6).alias("female_share"))


@query(D_SQL + ", hu AS (SELECT DISTINCT sg, md, g, play_id, seg, ch FROM stg), ac AS (SELECT sg, md, g, play_id, min(seg) AS lo, max(seg) AS hi FROM stg GROUP BY ALL), cc AS (SELECT seg.sg, seg.md, seg.g, seg.play_id, seg.seg, ppl.ch FROM seg JOIN ac ON ac.sg = seg.sg AND ac.md = seg.md AND ac.g = seg.g AND ac.play_id = seg.play_id AND seg.seg BETWEEN lo AND hi JOIN ppl ON ppl.play_id = seg.play_id AND ppl.g = seg.g AND cho) "
    "SELECT cc.sg AS segmentation, cc.md AS model, cc.g AS groups, cc.play_id, cc.ch AS char_id, string_agg(coalesce(words, 0)::VARCHAR, ',' ORDER BY cc.seg) AS words, string_agg((hu.ch IS NOT NULL)::VARCHAR, ',' ORDER BY cc.seg) AS present, string_agg((sp.ch IS NOT NULL)::VARCHAR, ',' ORDER BY cc.seg) AS speaks "
    "FROM cc LEFT JOIN hu ON hu.sg = cc.sg AND hu.md = cc.md AND hu.g = cc.g AND hu.play_id = cc.play_id AND hu.seg = cc.seg AND hu.ch = cc.ch LEFT JOIN sp ON sp.sg = cc.sg AND sp.md = cc.md AND sp.g = cc.g AND sp.play_id = cc.play_id AND sp.seg = cc.seg AND sp.ch = cc.ch GROUP BY ALL")
def chorus_series(spark, d):
    """Dense arrays over the active span for each variant's choruses (shown joined)."""
    a = d_lattice(spark, d)
    rows = keyed(a | {"chorus": corpus.chorus_rows(a)}, "chorus")
    told = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return rows.select("segmentation", "model", "groups", "play_id", "char_id", told("words"), told("present"), told("speaks"))
