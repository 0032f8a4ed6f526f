"""DuckDB SQL of the queries on sounds of words."""

from __future__ import annotations

from .functions.phonetics import COMMON_SOUNDS, ENGLISH_SOUNDS, FRENCH_SOUNDS, SILENT_AT_END, VOWELS, sounds
from .plans.inputs import UTTERANCES_SQL


def key_sql(text: str, french: bool = False) -> str:
    """The sound key of a text, word by word."""
    w = "w"
    for a, b in sounds(FRENCH_SOUNDS if french else ENGLISH_SOUNDS) + sounds(COMMON_SOUNDS):
        w = f"replace({w}, '{a}', '{b}')"
    for a, b in (("c([eiy])", r"s\1"), ("c", "k"), ("g([eiy])", r"j\1"), ("h", "")):
        w = f"regexp_replace({w}, '{a}', '{b}', 'g')"
    once = "list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i > 1 AND x[i] = x[i - 1] THEN '' ELSE x[i] END)"
    tail = f"regexp_replace(substr(y, 2), '[{VOWELS}]', '', 'g')"
    tokens = f"string_split(regexp_replace(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    plain = f"list_transform({tokens}, lambda w: {w})"
    single = f"list_transform({plain}, lambda x: array_to_string({once}, ''))"
    short = f"list_transform({single}, lambda z: regexp_replace(z, '^(..+?)[{SILENT_AT_END}]+$', '\\1'))"
    last = f"list_transform({short}, lambda y: concat(substr(y, 1, 1), CASE WHEN {tail} = '' THEN substr(y, 2) ELSE {tail} END))"
    return f"array_to_string(list_filter({last}, lambda v: v <> ''), ' ')"


def likeness(a: str, b: str) -> str:
    return f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)"


#: the words of ``spelled``: some misspelled, with confidences; see ``queries.misheard``
MISHEARD = f"""{UTTERANCES_SQL},
each AS (SELECT meeting_id, idx, speaker, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS w,
    generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''), 1) - 1 AS k FROM utterances),
said AS (SELECT meeting_id, idx, CASE idx % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr-FR' ELSE 'mixed' END AS language, k,
    CASE WHEN idx > 0 AND (k + idx) % 4 = 1 THEN replace(replace(replace(w, 'f', 'ph'), 'on', 'onn'), 'i', 'y') ELSE w END AS w,
    CASE WHEN (k * 7 + idx) % 11 = 0 THEN 1.0 ELSE 0.5 END AS sure FROM each),
phrases AS (
  SELECT meeting_id, k AS pos, concat(' ', w) AS phrase FROM each WHERE idx = 0 AND k % 3 = 0 AND length(w) >= 4
  UNION ALL SELECT a.meeting_id, a.k AS pos, concat(a.w, ' ', b.w) AS phrase FROM each a JOIN each b ON a.meeting_id = b.meeting_id AND a.idx = b.idx AND b.k = a.k + 1 WHERE a.idx = 0 AND a.k % 5 = 1)"""

KEYS = f"""
keyed AS (SELECT *, list_filter(list_distinct([{key_sql('phrase')}, {key_sql('phrase', True)}]), lambda v: v <> '') AS keys, {key_sql('phrase')} AS english FROM (SELECT meeting_id, pos, trim(phrase) AS phrase FROM phrases)),
counted AS (SELECT *, len(string_split(CASE WHEN english = '' THEN keys[1] ELSE english END, ' ')) AS n_words FROM keyed WHERE len(keys) > 0),
runs AS (SELECT a.meeting_id, a.idx, a.language, a.k AS first, n.n, string_agg(b.w, ' ' ORDER BY b.k) AS heard, min(b.sure) AS sure
  FROM said a, (SELECT unnest([1, 2, 3, 4]) AS n) n JOIN said b ON b.meeting_id = a.meeting_id AND b.idx = a.idx AND b.k BETWEEN a.k AND a.k + n.n - 1
  GROUP BY ALL HAVING count(*) = n.n),
exact AS (SELECT DISTINCT meeting_id, lower(phrase) AS low FROM counted),
marked AS (SELECT r.*, e.low IS NOT NULL AS exact FROM runs r LEFT JOIN exact e ON e.meeting_id = r.meeting_id AND e.low = lower(r.heard)),
heard AS (SELECT DISTINCT meeting_id, language, heard FROM marked WHERE NOT exact AND sure <= 0.995),
sounds AS (SELECT *, unnest(CASE language WHEN 'en' THEN [{key_sql('heard')}] WHEN 'fr-FR' THEN [{key_sql('heard', True)}] ELSE [{key_sql('heard')}, {key_sql('heard', True)}] END) AS sound FROM heard),
wanted AS (SELECT *, unnest(keys) AS key FROM counted),
scored AS (SELECT s.meeting_id, s.language, s.heard, p.phrase, p.n_words, p.pos, {likeness('s.sound', 'p.key')} AS score FROM sounds s JOIN wanted p ON p.meeting_id = s.meeting_id
  AND length(s.sound) BETWEEN 0.82 * length(p.key) - 1 AND length(p.key) / 0.82 + 1 WHERE s.sound <> ''),
best AS (SELECT meeting_id, language, heard, phrase, n_words FROM scored WHERE score > 0.82
  QUALIFY row_number() OVER (PARTITION BY meeting_id, language, heard ORDER BY score DESC, n_words DESC, pos) = 1),
open AS (SELECT m.meeting_id, m.idx, m.first, m.n, m.heard, CASE WHEN NOT m.exact THEN b.phrase END AS phrase FROM marked m
  LEFT JOIN best b ON b.meeting_id = m.meeting_id AND b.language = m.language AND b.heard = m.heard AND b.n_words = m.n
  WHERE m.exact OR (m.sure <= 0.995 AND b.phrase IS NOT NULL)),
choice AS (SELECT * FROM (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY meeting_id, idx, first ORDER BY n DESC) = 1) WHERE phrase IS NOT NULL),
sizes AS (SELECT meeting_id, idx, count(*) AS size FROM said GROUP BY ALL),
walk AS (SELECT meeting_id, idx, 0 AS at, size FROM sizes
  UNION ALL SELECT w.meeting_id, w.idx, w.at + coalesce(c.n, 1), w.size FROM walk w LEFT JOIN choice c ON c.meeting_id = w.meeting_id AND c.idx = w.idx AND c.first = w.at WHERE w.at < w.size),
kept AS (SELECT c.* FROM choice c JOIN walk w ON w.meeting_id = c.meeting_id AND w.idx = c.idx AND w.at = c.first),
texts AS (SELECT s.meeting_id, s.idx, string_agg(CASE WHEN k.phrase IS NULL THEN s.w WHEN len(string_split(k.phrase, ' ')) = k.n THEN string_split(k.phrase, ' ')[s.k - k.first + 1] WHEN s.k = k.first THEN k.phrase END, ' ' ORDER BY s.k) AS text
  FROM said s LEFT JOIN kept k ON k.meeting_id = s.meeting_id AND k.idx = s.idx AND s.k >= k.first AND s.k < k.first + k.n GROUP BY ALL)"""

BIASED = f"""WITH RECURSIVE {MISHEARD}, {KEYS}
SELECT t.meeting_id, t.idx, t.text, coalesce((SELECT string_agg(concat(k.first, ' ', k.heard, '>', k.phrase), ';' ORDER BY k.first) FROM kept k WHERE k.meeting_id = t.meeting_id AND k.idx = t.idx), '') AS replaced FROM texts t"""

SOUND_KEYS = f"SELECT item_id, {key_sql('text')} AS english, {key_sql('text', True)} AS french FROM benchmark"
