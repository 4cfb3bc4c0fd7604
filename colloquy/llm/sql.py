"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from colloquy.llm.identity import PLAIN, WIDE

P3 = """
WITH u AS (
  SELECT DISTINCT utt_id, conv_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM utterance WHERE speaker IN (0, 1)
), v AS (
  SELECT DISTINCT seg_id, conv_id, speaker, CAST(round(start_s * 1000) AS BIGINT) + CAST(round(end_s * 1000) AS BIGINT) AS m FROM vad_segment
), near AS (
  SELECT utt_id, seg_id, row_number() OVER (PARTITION BY utt_id ORDER BY abs(u.s + u.e - v.m), seg_id) AS k
  FROM u JOIN v ON u.conv_id = v.conv_id AND u.speaker = v.speaker AND v.m BETWEEN u.s + u.e - 800 AND u.s + u.e + 800
  WHERE u.e > u.s
)
SELECT utt_id, seg_id FROM near WHERE k = 1
"""

P2 = """
WITH RECURSIVE u AS (
  SELECT DISTINCT conv_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM utterance WHERE conv_id IS NOT NULL
), ok AS (SELECT * FROM u WHERE e > s),
mark AS (
  SELECT DISTINCT conv_id, e AS pos FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.conv_id = a.conv_id AND b.s < a.e AND a.e < b.e)
), conv AS (
  SELECT DISTINCT id, CAST(round(duration * 1000) AS BIGINT) AS total FROM conversation WHERE CAST(round(duration * 1000) AS BIGINT) > 120000
), piece AS (
  SELECT id AS conv_id, 1 AS piece_no, CAST(0 AS BIGINT) AS start_ms, total, (SELECT max(pos) FROM mark WHERE conv_id = id AND pos > 10000 AND pos <= 120000) AS cut FROM conv
  UNION ALL
  SELECT n.conv_id, n.piece_no, n.start_ms, n.total,
    CASE WHEN n.total - n.start_ms > 120000 THEN (SELECT max(m.pos) FROM mark m WHERE m.conv_id = n.conv_id AND m.pos > n.start_ms + 10000 AND m.pos <= n.start_ms + 120000) END
  FROM (SELECT conv_id, piece_no + 1 AS piece_no, coalesce(cut, start_ms + 120000) - 10000 AS start_ms, total FROM piece WHERE total - start_ms > 120000) n
)
SELECT conv_id, piece_no, start_ms, CASE WHEN total - start_ms <= 120000 THEN total ELSE coalesce(cut, start_ms + 120000) END AS end_ms FROM piece
"""


# Letters of other scripts and, below them, the Latin ones drawn alike; written out on their own, not taken from the operator.
OTHER = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαγνορσυϲϳϱАВЕЅІЈКМНОРСТУҮХӀԚԜԌаеорсуүхѕіјԛԝһԁӏѵѡгɑɡ‐‑․"
LATIN = "ABEZHIKMNOPTYXCJayvopoucjpABESIJKMHOPCTYYXIQWGaeopcyyxsijqwhdlvwrag--."


def p1(wide: str, plain: str) -> str:
    text = r"regexp_replace(text, '[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]', '', 'g')"
    text = f"translate(translate({text}, '{wide}', '{plain}'), '{OTHER}', '{LATIN}')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), ("‥", "..")):
        text = f"replace({text}, '{a}', '{b}')"
    text = r"nfc_normalize(trim(regexp_replace(" + text + r", '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')))"
    return f"""WITH u AS (SELECT DISTINCT utt_id, conv_id, text, {text} AS form FROM utterance WHERE text IS NOT NULL AND conv_id IS NOT NULL)
SELECT a.utt_id AS utt_id_a, b.utt_id AS utt_id_b FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.form = b.form AND a.utt_id < b.utt_id AND a.text <> b.text WHERE a.form <> ''"""


def p7(wide: str, plain: str) -> str:
    fold = rf"regexp_replace(lower(translate(source, '{wide}', '{plain}')), '[^\p{{L}}\p{{N}}]', '', 'g')"
    return f"""WITH c AS (SELECT DISTINCT id, {fold} AS f, CAST(round(duration * 1000) AS BIGINT) AS ms FROM conversation WHERE id IS NOT NULL),
m AS (SELECT DISTINCT source, weight_pct, max_repeat, {fold} AS f FROM mix_target),
o AS (SELECT m.source, weight_pct, max_repeat, coalesce(sum(ms), 0) AS own FROM m LEFT JOIN c ON c.f = m.f AND ms > 0 GROUP BY 1, 2, 3),
t AS (SELECT *, weight_pct * sum(own) OVER () AS want FROM o)
SELECT source, CAST(CASE WHEN max_repeat * own * 100 < want THEN max_repeat WHEN want = 0 THEN 0 ELSE (want + 100 * own - 1) // (100 * own) END AS INT) AS passes, CAST(max_repeat * own * 100 < want AS INT) AS is_short FROM t"""


def p6(wide: str, plain: str) -> str:
    """Links as in the operator, and from every conversation whatever it reaches."""

    def folded(c: str) -> str:
        return rf"regexp_replace(lower(translate({c}, '{wide}', '{plain}')), '[^\p{{L}}\p{{N}}]', '', 'g')"

    def key(c: str) -> str:
        return rf"CASE WHEN regexp_full_match({folded(c)}, '[a-z]+[0-9]+') THEN regexp_extract({folded(c)}, '^([a-z]+)', 1) || ':' || regexp_extract({folded(c)}, '0*([0-9]+)$', 1) END"

    def person(c: str) -> str:
        digits = f"regexp_extract({folded(c)}, '^p0*([0-9]+)$', 1)"
        return f"CASE WHEN regexp_full_match({folded(c)}, 'p[0-9]+') THEN 'P' || lpad({digits}, CAST(greatest(7, length({digits})) AS INT), '0') END"

    of_conversation = lambda kind, what: f"SELECT node AS u, '{kind}|' || ({what}) AS v FROM cv JOIN nm ON nm.name = cv.id"
    links = [of_conversation("p", person("a")), of_conversation("p", person("b")), of_conversation("r", key("r")), of_conversation("c", key("d")), "SELECT node, node FROM cv JOIN nm ON nm.name = cv.id"]
    links.append(f"SELECT node, 'p|' || ({person('speaker_id')}) FROM vo JOIN nm ON nm.name = vo.conv_id")
    return f"""WITH RECURSIVE cv AS (SELECT DISTINCT id, meta['spk1'] AS a, meta['spk2'] AS b, meta['recording'] AS r, meta['derived_from'] AS d FROM conversation WHERE id IS NOT NULL),
vo AS (SELECT DISTINCT conv_id, speaker_id FROM utterance WHERE conv_id IS NOT NULL AND speaker_id IS NOT NULL),
nm AS (SELECT name, 'c|' || coalesce({key('name')}, '=' || name) AS node FROM (SELECT id AS name FROM cv UNION SELECT conv_id FROM vo)),
ln AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(links)}) WHERE v IS NOT NULL),
ed AS (SELECT u, v FROM ln UNION SELECT v, u FROM ln),
rc AS (SELECT DISTINCT node AS s, node AS t FROM cv JOIN nm ON nm.name = cv.id UNION SELECT rc.s, ed.v FROM rc JOIN ed ON ed.u = rc.t),
al AS (SELECT rc.s, coalesce(CASE WHEN t LIKE 'p|%' THEN substr(t, 3) END, cv.id) AS name FROM rc LEFT JOIN nm ON nm.node = rc.t LEFT JOIN cv ON cv.id = nm.name),
gr AS (SELECT cv.id AS conv_id, min(al.name) AS group_id FROM cv JOIN nm ON nm.name = cv.id JOIN al ON al.s = nm.node WHERE al.name IS NOT NULL GROUP BY 1)
SELECT conv_id, group_id FROM gr"""


# groups go largest first, each to the split furthest below its target; of equal groups, by name, the first ones to the split named first
SPLITS = """,
sz AS (SELECT group_id, count(*) AS size FROM gr GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, group_id) AS k, row_number() OVER (PARTITION BY size ORDER BY group_id) AS r FROM sz),
tg AS (SELECT split, share_pct, row_number() OVER (ORDER BY share_pct DESC, split) AS j FROM (SELECT DISTINCT split, share_pct FROM split_target)),
st AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size, 0 AS pick, (SELECT max(share_pct) FILTER (j = 1) FROM tg) * n AS a, (SELECT max(share_pct) FILTER (j = 2) FROM tg) * n AS b, (SELECT max(share_pct) FILTER (j = 3) FROM tg) * n AS c FROM (SELECT count(*) AS n FROM gr)
  UNION ALL SELECT k, size, pick, a - CASE WHEN pick = 1 THEN 100 * size ELSE 0 END, b - CASE WHEN pick = 2 THEN 100 * size ELSE 0 END, c - CASE WHEN pick = 3 THEN 100 * size ELSE 0 END
  FROM (SELECT o.k, o.size, a, b, c, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS pick FROM st JOIN o ON o.k = st.k + 1)),
nn AS (SELECT size, pick, count(*) AS n FROM st WHERE k > 0 GROUP BY 1, 2),
rg AS (SELECT size, pick, sum(n) OVER (PARTITION BY size ORDER BY pick) - n AS lo, sum(n) OVER (PARTITION BY size ORDER BY pick) AS hi FROM nn)
SELECT gr.conv_id, gr.group_id, tg.split FROM gr JOIN o ON o.group_id = gr.group_id JOIN rg ON rg.size = o.size AND o.r > lo AND o.r <= hi JOIN tg ON tg.j = rg.pick"""

WINDOWS = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 240),
p AS (SELECT doc_id, i, md5(substr(text, i, 240)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 239)) AS i FROM d)),
s AS (SELECT h FROM p GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), k AS (SELECT p.* FROM p JOIN s ON s.h = p.h)
"""
P10 = WINDOWS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM k) a JOIN (SELECT DISTINCT doc_id, h FROM k) b ON a.h = b.h AND a.doc_id < b.doc_id"
P10_SHARED = WINDOWS + """, c AS (SELECT doc_id, sum(least(240, i - coalesce(before, i - 240))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k) GROUP BY 1)
SELECT d.doc_id, CAST(length(text) AS INT) AS n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shared FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""
P6 = p6(WIDE.replace("'", "''"), PLAIN.replace("'", "''"))
SQL = {"p1_found": p1(WIDE.replace("'", "''"), PLAIN.replace("'", "''")), "p2_found": P2, "p3_found": P3, "p7_found": p7(WIDE.replace("'", "''"), PLAIN.replace("'", "''")), "p6_found": P6, "p6_splits": P6.rsplit("\nSELECT", 1)[0] + SPLITS, "p10_found": P10, "p10_shared": P10_SHARED}
