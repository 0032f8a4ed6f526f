"""DuckDB SQL of the queries whose statement is long."""

from __future__ import annotations

import re

from .functions import normal, numbers, text
from .operators import minutes
from .plans.inputs import TURNS_SQL, UTTERANCES_SQL


def fold_sql(column: str) -> str:
    return f"translate(replace(replace(lower(coalesce({column}, '')), 'œ', 'oe'), 'æ', 'ae'), '{text.ACCENTED}', '{text.PLAIN}')"


def folded_tokens_sql(column: str) -> str:
    return f"list_filter(string_split(regexp_replace({fold_sql(column)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def content_sql(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in minutes.STOP_WORDS)
    return f"list_filter({folded_tokens_sql(column)}, lambda w: w NOT IN ({stop}) AND (len(w) >= 3 OR regexp_matches(w, '[0-9]')))"


def terms_sql(column: str) -> str:
    return f"list_distinct({content_sql(column)})"


def clock_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


VTT = rf"""WITH {UTTERANCES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS n FROM utterances)
SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {clock_sql('start_ms')} || ' --> ' || {clock_sql('end_ms')} || chr(10) || '<v ' || speaker || '>'
  || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) || chr(10) ORDER BY n) || chr(10) AS document FROM c GROUP BY meeting_id"""

JSON = rf"""WITH {UTTERANCES_SQL}, r AS (SELECT *, (start_ms + 500) // 1000 AS s FROM utterances), f AS (SELECT meeting_id, speaker, min(idx) AS i FROM utterances GROUP BY ALL),
p AS (SELECT meeting_id, list(speaker ORDER BY i) AS speakers FROM f GROUP BY meeting_id),
g AS (SELECT meeting_id, max(end_ms) / 1000 AS e, CAST(sum(n_words) AS BIGINT) AS n, list(struct_pack(idx := idx, speaker := speaker, "start" := start_ms / 1000, "end" := end_ms / 1000,
  timecode := printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60), text := text) ORDER BY idx) AS u FROM r GROUP BY meeting_id)
SELECT meeting_id, CAST(to_json(struct_pack(schema_version := '1.1', kind := 'transcript', transcript := struct_pack(audio_duration_seconds := e, word_count := n, speakers := speakers, utterances := u))) AS VARCHAR) AS document
FROM g JOIN p USING (meeting_id)"""

#: Speech without a turn over elementary stretches, islands of those, the nearest label, runs of one label.
COVERED_SPEECH = rf"""WITH {TURNS_SQL}, tm AS (SELECT meeting_id, unnest([start_ms, end_ms]) AS t FROM utterances UNION SELECT meeting_id, unnest([start_ms, end_ms]) FROM turns),
cuts AS (SELECT meeting_id, t AS s, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS e FROM tm),
bare AS (SELECT * FROM cuts c WHERE e > s AND EXISTS (SELECT 1 FROM utterances u WHERE u.meeting_id = c.meeting_id AND u.start_ms <= c.s AND u.end_ms >= c.e)
  AND NOT EXISTS (SELECT 1 FROM turns u WHERE u.meeting_id = c.meeting_id AND u.start_ms <= c.s AND u.end_ms >= c.e)),
gaps AS (SELECT meeting_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY s) AS k FROM (
  SELECT *, CASE WHEN lag(e) OVER (PARTITION BY meeting_id ORDER BY s) = s THEN 0 ELSE 1 END AS new FROM bare)) GROUP BY meeting_id, k HAVING max(e) - min(s) >= 150),
near AS (SELECT g.meeting_id, g.s, g.e, arg_min(label, ROW(greatest(start_ms - g.e, g.s - end_ms, 0), pos)) AS label FROM gaps g JOIN turns t ON g.meeting_id = t.meeting_id
  AND greatest(start_ms - g.e, g.s - end_ms, 0) < 2500 GROUP BY ALL),
every AS (SELECT meeting_id, start_ms, end_ms, label FROM turns UNION ALL SELECT meeting_id, s, e, label FROM near WHERE label IS NOT NULL),
runs AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, label ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(label) OVER w = label AND start_ms <= lag(end_ms) OVER w THEN 0 ELSE 1 END AS new
  FROM every WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, end_ms, label)))
SELECT meeting_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(label) AS label FROM runs GROUP BY meeting_id, run"""

TEXTTILING = rf"""WITH t AS (SELECT doc_id, {folded_tokens_sql('text')} AS t FROM documents), n AS (SELECT doc_id, t, len(t) // 20 AS n FROM t),
c AS (SELECT doc_id, n, row, term, count(*) AS c FROM (SELECT doc_id, n, unnest(t) AS term, (generate_subscripts(t, 1) - 1) // 20 AS row FROM n) WHERE row < n GROUP BY ALL),
l AS (SELECT doc_id, n, gap, term, sum(c) AS l FROM (SELECT *, unnest(range(row, row + 6)) AS gap FROM c) WHERE gap < n - 1 GROUP BY ALL),
r AS (SELECT doc_id, n, gap, term, sum(c) AS r FROM (SELECT *, unnest(range(row - 6, row)) AS gap FROM c) WHERE gap >= 0 GROUP BY ALL),
d AS (SELECT doc_id, gap, sum(coalesce(l, 0) * coalesce(r, 0)) AS lr, sum(coalesce(l, 0) * coalesce(l, 0)) AS ll, sum(coalesce(r, 0) * coalesce(r, 0)) AS rr FROM l FULL JOIN r USING (doc_id, gap, term) GROUP BY ALL)
SELECT doc_id, CAST(gap AS BIGINT) AS gap, round(CASE WHEN ll * rr > 0 THEN lr / sqrt(CAST(ll * rr AS DOUBLE)) ELSE 0 END, 6) AS similarity FROM d"""

CHUNK_PLAN = rf"""WITH RECURSIVE {UTTERANCES_SQL}, g AS (SELECT meeting_id, list(idx ORDER BY idx) AS ids, list(n_words ORDER BY idx) AS z FROM utterances GROUP BY meeting_id),
p AS (SELECT meeting_id, 0 AS chunk, CAST(1 AS BIGINT) AS a, list_max(list_filter(range(1, len(z) + 1), lambda e: e = 1 OR list_sum(z[1:e]) <= 120)) AS b, ids, z FROM g
  UNION ALL SELECT meeting_id, chunk + 1, s, list_max(list_filter(range(s, len(z) + 1), lambda e: e = s OR list_sum(z[s:e]) <= 120)), ids, z
  FROM (SELECT *, coalesce(list_min(list_filter(range(a + 1, b + 1), lambda k: list_sum(z[k:b]) <= 20)), b + 1) AS s FROM p WHERE b < len(z)))
SELECT meeting_id, chunk, ids[a] AS first_idx, ids[b] AS last_idx, CAST(list_sum(z[a:b]) AS BIGINT) AS n_tokens FROM p"""


def pairing_sql(shared: str, a: str, b: str, v: str) -> str:
    """CTEs that try every pairing of a meeting's ``a`` with its ``b`` and keep one of the most ``v`` in ``best`` (``total, pairs``)."""
    return f"""ra AS (SELECT meeting_id, {a} AS a, row_number() OVER (PARTITION BY meeting_id ORDER BY {a}) AS k FROM (SELECT DISTINCT meeting_id, {a} FROM {shared})),
 tries AS (SELECT DISTINCT meeting_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST([] AS STRUCT(a VARCHAR, b VARCHAR)[]) AS pairs, CAST(0 AS DOUBLE) AS total FROM {shared}
   UNION ALL SELECT t.meeting_id, t.k + 1, CASE WHEN o.b IS NULL THEN used ELSE list_append(used, o.b) END, CASE WHEN o.b IS NULL THEN pairs ELSE list_append(pairs, struct_pack(a := ra.a, b := o.b)) END, total + o.v
   FROM tries t JOIN ra ON ra.meeting_id = t.meeting_id AND ra.k = t.k + 1
   JOIN (SELECT meeting_id, {a} AS a, {b} AS b, CAST({v} AS DOUBLE) AS v FROM {shared} UNION ALL SELECT DISTINCT meeting_id, {a}, CAST(NULL AS VARCHAR), CAST(0 AS DOUBLE) FROM {shared}) o
     ON o.meeting_id = t.meeting_id AND o.a = ra.a AND (o.b IS NULL OR NOT list_contains(used, o.b))),
 best AS (SELECT meeting_id, max(total) AS total, arg_max(pairs, total) AS pairs FROM tries WHERE k = (SELECT max(k) FROM ra WHERE ra.meeting_id = tries.meeting_id) GROUP BY meeting_id)"""


def der_sql(regions: str) -> str:
    return f"""WITH RECURSIVE {regions}, sh AS (SELECT meeting_id, a, b, sum(d) AS v FROM (SELECT meeting_id, a, unnest(hypothesis) AS b, d FROM (
   SELECT meeting_id, unnest(reference) AS a, hypothesis, end_ms - start_ms AS d FROM regions)) GROUP BY ALL), {pairing_sql('sh', 'a', 'b', 'v')},
 s AS (SELECT meeting_id, CAST(sum(greatest(len(reference) - len(hypothesis), 0) * (end_ms - start_ms)) AS BIGINT) AS missed_ms, CAST(sum(greatest(len(hypothesis) - len(reference), 0) * (end_ms - start_ms)) AS BIGINT) AS false_alarm_ms,
   CAST(sum(least(len(reference), len(hypothesis)) * (end_ms - start_ms)) AS BIGINT) AS both_ms, CAST(sum(len(reference) * (end_ms - start_ms)) AS BIGINT) AS total_ms FROM regions GROUP BY meeting_id),
 e AS (SELECT s.meeting_id, missed_ms, false_alarm_ms, CAST(both_ms - coalesce(total, 0) AS BIGINT) AS confusion_ms, total_ms FROM s LEFT JOIN best USING (meeting_id))
SELECT *, round(CASE WHEN total_ms > 0 THEN (missed_ms + false_alarm_ms + confusion_ms) / total_ms WHEN missed_ms + false_alarm_ms + confusion_ms > 0 THEN 1 ELSE 0 END, 6) AS der FROM e"""


def jer_sql(regions: str) -> str:
    return f"""WITH RECURSIVE {regions}, sh AS (SELECT meeting_id, a, b, sum(d) AS v FROM (SELECT meeting_id, a, unnest(hypothesis) AS b, d FROM (
   SELECT meeting_id, unnest(reference) AS a, hypothesis, end_ms - start_ms AS d FROM regions)) GROUP BY ALL), {pairing_sql('sh', 'a', 'b', 'v')},
 m AS (SELECT meeting_id, p.a AS a, p.b AS b FROM (SELECT meeting_id, unnest(pairs) AS p FROM best)),
 ra2 AS (SELECT meeting_id, a, sum(d) AS ra FROM (SELECT meeting_id, unnest(reference) AS a, end_ms - start_ms AS d FROM regions) GROUP BY ALL),
 hb AS (SELECT meeting_id, b, sum(d) AS hb FROM (SELECT meeting_id, unnest(hypothesis) AS b, end_ms - start_ms AS d FROM regions) GROUP BY ALL)
SELECT r.meeting_id, r.a AS label, round(1 - coalesce(v, 0) / (ra + coalesce(hb, 0) - coalesce(v, 0)), 6) AS jer
FROM ra2 r LEFT JOIN m ON m.meeting_id = r.meeting_id AND m.a = r.a LEFT JOIN sh ON sh.meeting_id = m.meeting_id AND sh.a = m.a AND sh.b = m.b LEFT JOIN hb ON hb.meeting_id = m.meeting_id AND hb.b = m.b"""


SPEAKER_NAMES = f"""WITH RECURSIVE {TURNS_SQL}, total AS (SELECT meeting_id, label, sum(end_ms - start_ms) AS total, min(pos) AS first FROM turns GROUP BY ALL),
 sh AS (SELECT t.meeting_id, t.label, upper(u.speaker) AS name, sum(least(t.end_ms, u.end_ms) - greatest(t.start_ms, u.start_ms)) AS v FROM turns t JOIN utterances u ON t.meeting_id = u.meeting_id
   AND least(t.end_ms, u.end_ms) > greatest(t.start_ms, u.start_ms) GROUP BY ALL), {pairing_sql('sh', 'label', 'name', 'v')},
 m AS (SELECT meeting_id, p.a AS label, p.b AS name FROM (SELECT meeting_id, unnest(pairs) AS p FROM best)),
 j AS (SELECT m.meeting_id, m.label, m.name, s.v, coalesce((SELECT max(o.v) FROM sh o WHERE o.meeting_id = m.meeting_id AND o.label = m.label AND o.name <> m.name), 0) AS rest FROM m JOIN sh s USING (meeting_id, label, name))
SELECT t.meeting_id, t.label, CASE WHEN total > 0 AND v / total >= 0.5 AND (v - rest) / total >= 0.15 THEN name ELSE 'Speaker ' || row_number() OVER (PARTITION BY t.meeting_id ORDER BY first) END AS name
FROM total t LEFT JOIN j USING (meeting_id, label)"""


def sentences_sql(source: str) -> str:
    """CTE ``units`` (``meeting_id, unit, idx, nth, speaker, start_ms, end_ms, text``) of the rows of ``source``."""
    return rf"""cut AS (SELECT meeting_id, idx, speaker, start_ms, end_ms, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS s FROM {source}),
 each AS (SELECT * EXCLUDE s, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS nth, list_transform(s, lambda x: len(x)) AS z FROM cut WHERE len(s) > 0),
 units AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY idx, nth) - 1 AS unit, idx, nth, speaker,
   CAST(start_ms + floor((end_ms - start_ms) * coalesce(list_sum(z[1:nth]), 0) / list_sum(z)) AS BIGINT) AS start_ms,
   CAST(start_ms + floor((end_ms - start_ms) * list_sum(z[1:nth + 1]) / list_sum(z)) AS BIGINT) AS end_ms, text FROM each)"""


GROUNDING = rf"""WITH {UTTERANCES_SQL}, {sentences_sql('utterances')}, claims AS (SELECT meeting_id, {content_sql("CASE WHEN unit % 2 = 0 THEN text || ' zebra budget zebra' WHEN unit % 9 = 3 THEN 'it is to be' ELSE text END")} AS t FROM units WHERE unit % 3 = 0),
 said AS (SELECT meeting_id, list_distinct(flatten(list({folded_tokens_sql('text')}))) AS said FROM utterances WHERE idx % 2 = 0 GROUP BY meeting_id),
 k AS (SELECT meeting_id, len(t) AS n, len(list_filter(t, lambda w: list_contains(coalesce(said, []), w))) >= 0.7 * len(t) - 1e-9 AS ok FROM claims LEFT JOIN said USING (meeting_id))
SELECT meeting_id, count(*) FILTER (n > 0) AS n_claims, count(*) FILTER (n > 0 AND ok) AS supported, CASE WHEN count(*) FILTER (n > 0) > 0 THEN count(*) FILTER (n > 0 AND ok) / count(*) FILTER (n > 0) ELSE 1 END AS score FROM k GROUP BY meeting_id"""


def _any(column: str, patterns: list[str]) -> str:
    either = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '{either}')"


def candidates_sql(cues: list[str]) -> str:
    said = ", ".join(f"'{c}'" for c in cues)
    w = "OVER (PARTITION BY meeting_id ORDER BY unit)"
    near = []
    for k in range(1, 5):
        t = f"lead(t, {k}) {w}"
        says = f"(CASE WHEN len(t) = 0 OR len({t}) = 0 THEN 0 ELSE len(list_intersect(t, {t})) / len(list_distinct(list_concat(t, {t}))) END >= 0.22" + (f" OR {_any(f'lead(f, {k}) {w}', minutes.ANSWER)}" if k <= 2 else "") + ")"
        near.append(f"coalesce(lead(speaker, {k}) {w} <> speaker AND lead(start_ms, {k}) {w} - end_ms <= 150000 AND {says}, false)")
    return rf"""WITH {UTTERANCES_SQL}, cued AS (SELECT * REPLACE (concat_ws(' ', [{said}][idx % {len(cues)} + 1], text) AS text) FROM utterances), {sentences_sql('cued')},
 f AS (SELECT *, {fold_sql('text')} AS f, {terms_sql('text')} AS t, trim(text) LIKE '%?' AS asks FROM units),
 x AS (SELECT *, {_any('f', minutes.STRONG_DECISION)} AS strong, {_any('f', minutes.WEAK_DECISION)} AS weak, {_any('f', minutes.ACTION)} AS does, {' OR '.join(near)} AS answered FROM f),
 k AS (SELECT *, NOT asks AND len(t) >= 2 AND (strong OR weak) AS decides FROM x),
 e AS (SELECT meeting_id, unit, strong, answered, CASE WHEN decides THEN 'decision' WHEN NOT asks AND does THEN 'action' WHEN asks AND len(t) >= 2 AND len({folded_tokens_sql('text')}) >= 4 THEN 'question' END AS kind FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY unit) AS nth FROM e WHERE kind IS NOT NULL)
SELECT meeting_id, unit, kind, strong, kind = 'question' AND answered AS answered FROM r WHERE nth <= CASE kind WHEN 'decision' THEN 20 WHEN 'action' THEN 30 ELSE 12 END"""


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced_sql(column: str, rules: list[tuple[str, str]]) -> str:
    """Replacements one after the other; groups are written ``$1`` in the rules."""
    for pattern, to in rules:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(re.sub('[$]([0-9])', chr(92) * 2 + chr(92) + '1', to))}, 'g')"
    return column


def basic_sql(column: str) -> str:
    return f"trim({replaced_sql(f'lower({replaced_sql(column, [(normal.BRACKETED, chr(32)), (normal.PARENTHESISED, chr(32))])})', [(NOT_WORD, ' '), (SPACES, ' ')])})"


NOT_WORD, SPACES = r"[^\p{L}\p{N}\s]", r"\s+"
ENGLISH_CUES = ["Okay, I won't go, um, Mr. Smith;", "They'd been [noise] at the centre (twice), hadn't they?", "It's 1,200 metres or 5%.", "Let's see etc. and so on", "You're right: we've 3.5 or $20"]
FRENCH_CUES = ["M. Dupont et Mme Durand, euh,", "c'est n° 3 (ou 4) &", "25 % de l'oeuvre", "vingts okay, hein", "Dr. No et Mlle Oui [bruit] etc."]


def cued_sql(cues: list[str]) -> str:
    """CTE ``cued``: a cue and the folded text of each utterance."""
    return f"{UTTERANCES_SQL}, cued AS (SELECT meeting_id, idx, [{', '.join(map(_quoted, cues))}][idx % {len(cues)} + 1] || ' ' || replace({fold_sql('text')}, 'ß', 'ss') AS text FROM utterances)"


def english_sql() -> str:
    x = replaced_sql("lower(text)", [(normal.BRACKETED, ""), (normal.PARENTHESISED, ""), (normal.ENGLISH_FILLERS, ""), (SPACES + "'", "'"), *normal.ENGLISH_FORMS])
    x = replaced_sql(x, [("([0-9]),([0-9])", "$1$2"), (r"\.([^0-9]|$)", " $1"), (r"[^\p{L}\p{N}\s.%$¢€£]", " "), (SPACES, " ")])
    american = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in normal.AMERICAN.items()) + "}"
    y = f"array_to_string(list_transform(string_split(x, ' '), lambda w: coalesce({american}[w], w)), ' ')"
    y = replaced_sql(replaced_sql(y, [("[.$¢€£]([^0-9])", " $1"), ("([^0-9])%", "$1 "), (SPACES, " ")]), normal.SPELLINGS)
    return f"WITH {cued_sql(ENGLISH_CUES)}, a AS (SELECT meeting_id, idx, trim({x}) AS x FROM cued) SELECT meeting_id, idx, trim({y}) AS text FROM a"


def french_sql() -> str:
    """Titles and the number sign take the character after them along, as this dialect cannot look ahead."""
    titles = [(p.replace(r"(?!\p{L})", r"(\P{L}|$)"), to + "$1") for p, to in normal.FRENCH_TITLES]
    x = replaced_sql("lower(text)", [(normal.BRACKETED, " "), (normal.PARENTHESISED, " "), *titles, (r"n\s*[°ºo]\s*([0-9])", "numéro $1")])
    for sign, said in normal.FRENCH_SIGNS.items():
        x = f"replace({x}, '{sign}', ' {said} ')"
    x = replaced_sql(x, [(r"\betc\b\.?", " et cetera "), (r"\bpour[-\s]?cents?\b", " pour cent "), ("'", " "), (NOT_WORD, " "), (normal.FRENCH_PLURALS, "$1"), *normal.SPELLINGS, (normal.FRENCH_FILLERS, " "), (SPACES, " ")])
    return f"WITH {cued_sql(FRENCH_CUES)} SELECT meeting_id, idx, trim({x}) AS text FROM cued"


#: Hundreds and smaller by a CASE over the digits, independently of the expression that is tested.
_UNITS = "[" + ", ".join(f"'{w}'" for w in numbers.FRENCH_UNITS) + "]"
FRENCH_CARDINALS = rf"""WITH k AS (SELECT o_orderkey AS n FROM orders UNION SELECT o_orderkey * 997 FROM orders), d AS (SELECT n, part, CASE part WHEN 0 THEN n // 1000000 WHEN 1 THEN n // 1000 % 1000 ELSE n % 1000 END AS x FROM k, range(3) AS r(part)),
 t AS (SELECT *, x // 100 AS h, x % 100 AS s, CASE WHEN x % 100 >= 80 THEN 80 WHEN x % 100 >= 60 THEN 60 ELSE x % 100 // 10 * 10 END AS ten FROM d),
 w AS (SELECT *, CASE WHEN s < 20 THEN {_UNITS}[s + 1] ELSE CASE ten WHEN 20 THEN 'vingt' WHEN 30 THEN 'trente' WHEN 40 THEN 'quarante' WHEN 50 THEN 'cinquante' WHEN 60 THEN 'soixante' ELSE 'quatre-vingt' END
    || CASE WHEN s = 80 THEN 's' WHEN s = ten THEN '' ELSE CASE WHEN ten < 80 AND s - ten IN (1, 11) THEN '-et-' ELSE '-' END || {_UNITS}[s - ten + 1] END END AS low FROM t),
 v AS (SELECT *, CASE WHEN h = 0 THEN low WHEN h = 1 THEN 'cent' || CASE WHEN s = 0 THEN '' ELSE '-' || low END ELSE {_UNITS}[h + 1] || CASE WHEN s = 0 THEN '-cents' ELSE '-cent-' || low END END AS small FROM w),
 p AS (SELECT *, CASE part WHEN 0 THEN small || CASE WHEN x > 1 THEN '-millions' ELSE '-million' END WHEN 1 THEN CASE WHEN x = 1 THEN 'mille' ELSE small || '-mille' END ELSE small END AS said FROM v WHERE x > 0 OR (part = 2 AND n = 0))
SELECT n, string_agg(said, '-' ORDER BY part) AS words FROM p GROUP BY n"""

ENGLISH_NUMBERS = "SELECT o_orderkey AS n, 'we sold ' || o_orderkey || ' of them' AS text FROM orders"

NORMALIZED_ERRORS = rf"""WITH t AS (SELECT item_id, CAST(len(list_filter(string_split({basic_sql('text')}, ' '), lambda w: w <> '')) AS BIGINT) AS n FROM benchmark)
SELECT item_id, n // 7 AS substitutions, CAST(0 AS BIGINT) AS deletions, n // 11 AS insertions, n - n // 7 AS hits, n AS reference_words, round((n // 7 + n // 11) / greatest(n, 1), 6) AS wer FROM t"""

#: Two of three items are found: one without its last word, or in another order; the others are invented.
ITEM_MATCHES = rf"""WITH {UTTERANCES_SQL}, {sentences_sql('utterances')}, i AS (SELECT meeting_id, unit, row_number() OVER (PARTITION BY meeting_id ORDER BY unit) - 1 AS k FROM units WHERE unit % 4 = 0),
 t AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (k % 3 < 2) AS m, count(*) FILTER (k % 3 = 0) AS own FROM i GROUP BY meeting_id)
SELECT meeting_id, m AS matched, n AS reference_count, n AS hypothesis_count, round(m / n, 6) AS precision, round(m / n, 6) AS recall, round(m / n, 6) AS f1, round(own / m, 6) AS owner_accuracy FROM t"""

_RUN = r"[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’''-]*(?:\s+[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’''-]*)*"
_DIGITS = "[0-9]+(?:[.,][0-9]+)*"
HALLUCINATIONS = rf"""WITH {UTTERANCES_SQL}, {sentences_sql('utterances')},
 said AS (SELECT meeting_id, list_distinct(flatten(list(list_concat(regexp_extract_all({fold_sql('text')}, '[\p{{L}}\p{{N}}]+'), list_transform(regexp_extract_all(text, '{_DIGITS}'), lambda n: regexp_replace(n, '[.,]', '', 'g')))))) AS v
   FROM utterances WHERE idx % 2 = 0 GROUP BY meeting_id),
 c AS (SELECT meeting_id, CASE WHEN unit % 6 = 0 THEN 'So ' || text || ' for 1,' || unit || ' in Paris Nord' ELSE text END AS s FROM units WHERE unit % 3 = 0),
 r AS (SELECT meeting_id, regexp_extract_all(s, '{_DIGITS}') AS d, regexp_extract_all(s, '{_RUN}') AS runs, regexp_matches(s, '^[A-ZÀ-ÖØ-Þ]') AS cap FROM c),
 m AS (SELECT meeting_id, unnest(list_concat(d, CASE WHEN cap AND NOT contains(coalesce(runs[1], ''), ' ') THEN runs[2:] ELSE runs END)) AS m FROM r),
 x AS (SELECT m.meeting_id, CASE WHEN regexp_full_match(m, '{_DIGITS}') THEN list_contains(v, regexp_replace(m, '[.,]', '', 'g')) ELSE len(list_filter(regexp_extract_all({fold_sql('m')}, '[\p{{L}}\p{{N}}]+'), lambda w: NOT list_contains(v, w))) = 0 END AS ok
   FROM m JOIN said USING (meeting_id)),
 s AS (SELECT meeting_id, count(*) AS mentions, count(*) FILTER (NOT ok) AS unsupported FROM x GROUP BY meeting_id)
SELECT DISTINCT meeting_id, coalesce(mentions, 0) AS mentions, coalesce(unsupported, 0) AS unsupported, round(CASE WHEN mentions > 0 THEN unsupported / mentions ELSE 0 END, 6) AS rate FROM c LEFT JOIN s USING (meeting_id)"""

#: Peaks by looking at every gap on either side, without runs.
TOPIC_GAPS = rf"""WITH b AS ({TEXTTILING}), e AS (SELECT doc_id, max(gap) AS edge FROM b GROUP BY doc_id),
 s AS (SELECT b.doc_id, b.gap, round(avg(o.similarity), 9) AS smoothed FROM (SELECT doc_id, gap, edge, unnest(range(-2, 3)) AS k FROM b JOIN e USING (doc_id)) b JOIN b o ON o.doc_id = b.doc_id AND o.gap = least(greatest(b.gap + k, 0), edge) GROUP BY ALL),
 l AS (SELECT doc_id, list(smoothed ORDER BY gap) AS z FROM s GROUP BY doc_id),
 p AS (SELECT s.doc_id, gap, smoothed, z[coalesce(list_max(list_filter(range(2, gap + 2), lambda i: z[i - 1] < z[i])), 1)] AS l, z[coalesce(list_min(list_filter(range(gap + 1, len(z)), lambda i: z[i + 1] < z[i])), len(z))] AS r FROM s JOIN l USING (doc_id)),
 d AS (SELECT doc_id, gap, smoothed, round(l + r - 2 * smoothed, 9) AS depth FROM p)
SELECT *, depth > greatest(avg(depth) OVER w - 0.5 * stddev_pop(depth) OVER w, 0) + 1e-9 AS candidate FROM d WINDOW w AS (PARTITION BY doc_id)"""

#: The same words on both sides, every ninth of an utterance another one: all align in place.
WORD_DIARIZATION = f"""WITH RECURSIVE {TURNS_SQL}, sh AS (SELECT u.meeting_id, u.speaker, t.label, sum(n_words - n_words // 9) AS v FROM utterances u JOIN turns t ON u.meeting_id = t.meeting_id AND u.idx = t.pos GROUP BY ALL HAVING sum(n_words) > 0),
 {pairing_sql('sh', 'speaker', 'label', 'v')}, n AS (SELECT meeting_id, CAST(sum(n_words - n_words // 9) AS BIGINT) AS aligned FROM utterances GROUP BY meeting_id)
SELECT meeting_id, CAST(aligned - coalesce(total, 0) AS BIGINT) AS wrong, aligned, round(CASE WHEN aligned > 0 THEN (aligned - coalesce(total, 0)) / aligned ELSE 0 END, 6) AS wder FROM n LEFT JOIN best USING (meeting_id)"""
