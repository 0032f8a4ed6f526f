"""DuckDB SQL of the queries about topic segments, summaries and captions."""

from __future__ import annotations

from .operators.outline import ENGLISH_SUFFIXES
from .oracles import content_sql, folded_tokens_sql, sentences_sql, terms_sql
from .oracles_words import key_sql, likeness
from .plans.inputs import UTTERANCES_SQL

#: Ten conversations in a row as one meeting, ten minutes apart.
SESSIONS = f"""{UTTERANCES_SQL}, sess AS (SELECT meeting_id // 10 AS meeting_id, meeting_id % 10 * 1000 + idx AS idx, speaker, text, n_words, meeting_id % 10 * 600000 + start_ms AS start_ms, meeting_id % 10 * 600000 + end_ms AS end_ms FROM utterances)"""
_STEM = "CASE WHEN regexp_full_match(w, '[0-9]+') THEN w " + " ".join(f"WHEN ends_with(w, '{s}') AND len(w) - {len(s)} >= {n} THEN left(w, len(w) - {len(s)})" for s, n in ENGLISH_SUFFIXES.items()) + " ELSE w END"

#: Boundaries one after the other, each tried against all parts of the meeting.
_SEGMENTS = rf"""{SESSIONS}, u AS (SELECT *, row_number() OVER w - 1 AS i, lag(end_ms) OVER w AS before, greatest(start_ms - lag(end_ms) OVER w, 0) + CASE WHEN lag(speaker) OVER w <> speaker THEN 1000 ELSE 0 END AS pull FROM sess WINDOW w AS (PARTITION BY meeting_id ORDER BY idx)),
 tk AS (SELECT meeting_id, i, nth, w, {_STEM} AS term FROM (SELECT meeting_id, i, unnest(ws) AS w, generate_subscripts(ws, 1) AS nth FROM (SELECT meeting_id, i, {content_sql('text')} AS ws FROM u))),
 tp AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY i, nth) - 1 AS pos FROM tk),
 ms AS (SELECT meeting_id, count(*) AS n, list(start_ms ORDER BY i) AS st, list(end_ms ORDER BY i) AS en FROM u GROUP BY meeting_id),
 mt AS (SELECT ms.*, nt, least(greatest(CAST(round_even(nt / 60, 0) AS BIGINT), 6), 20) AS width FROM ms JOIN (SELECT meeting_id, count(*) AS nt FROM tp GROUP BY meeting_id) USING (meeting_id)),
 sz AS (SELECT *, least(greatest(CAST(round_even(nt / (width * 6), 0) AS BIGINT), 3), 6) AS block, least(90000, (en[n] - st[1]) / 4) AS least_ms FROM mt),
 c AS (SELECT meeting_id, width, block, nt // width AS rows, pos // width AS row, term, count(*) AS c FROM tp JOIN sz USING (meeting_id) WHERE nt >= width * (block + 1) AND pos // width < nt // width GROUP BY ALL),
 l AS (SELECT meeting_id, rows, gap, term, sum(c) AS l FROM (SELECT *, unnest(range(row, row + block)) AS gap FROM c) WHERE gap < rows - 1 GROUP BY ALL),
 r AS (SELECT meeting_id, rows, gap, term, sum(c) AS r FROM (SELECT *, unnest(range(row - block, row)) AS gap FROM c) WHERE gap >= 0 GROUP BY ALL),
 d AS (SELECT meeting_id, gap, sum(coalesce(l, 0) * coalesce(r, 0)) AS lr, sum(coalesce(l, 0) * coalesce(l, 0)) AS ll, sum(coalesce(r, 0) * coalesce(r, 0)) AS rr FROM l FULL JOIN r USING (meeting_id, gap, term) GROUP BY ALL),
 b AS (SELECT meeting_id, gap, round(CASE WHEN ll * rr > 0 THEN lr / sqrt(CAST(ll * rr AS DOUBLE)) ELSE 0 END, 6) AS similarity FROM d),
 e AS (SELECT meeting_id, max(gap) AS edge FROM b GROUP BY meeting_id),
 s AS (SELECT b.meeting_id, b.gap, round(avg(o.similarity), 9) AS smoothed FROM (SELECT meeting_id, gap, edge, unnest(range(-2, 3)) AS k FROM b JOIN e USING (meeting_id)) b JOIN b o ON o.meeting_id = b.meeting_id AND o.gap = least(greatest(b.gap + k, 0), edge) GROUP BY ALL),
 z AS (SELECT meeting_id, list(smoothed ORDER BY gap) AS z FROM s GROUP BY meeting_id),
 p AS (SELECT s.meeting_id, gap, smoothed, z[coalesce(list_max(list_filter(range(2, gap + 2), lambda i: z[i - 1] < z[i])), 1)] AS l, z[coalesce(list_min(list_filter(range(gap + 1, len(z)), lambda i: z[i + 1] < z[i])), len(z))] AS r FROM s JOIN z USING (meeting_id)),
 dp AS (SELECT meeting_id, gap, round(l + r - 2 * smoothed, 9) AS depth FROM p),
 g AS (SELECT * FROM (SELECT *, depth > greatest(avg(depth) OVER w - 0.5 * stddev_pop(depth) OVER w, 0) + 1e-9 AS candidate FROM dp WINDOW w AS (PARTITION BY meeting_id)) WHERE candidate),
 t AS (SELECT g.meeting_id, gap, depth, tp.i AS t, n FROM g JOIN sz USING (meeting_id) JOIN tp ON tp.meeting_id = g.meeting_id AND tp.pos = least((gap + 1) * width, nt - 1)),
 sn AS (SELECT t.meeting_id, gap, depth, arg_min(u.i, ROW(-pull, u.i)) AS i FROM t JOIN u ON u.meeting_id = t.meeting_id AND u.i BETWEEN greatest(t.t - 2, 1) AND least(t.t + 2, t.n - 1) GROUP BY ALL),
 rk AS (SELECT meeting_id, i, row_number() OVER (PARTITION BY meeting_id ORDER BY depth DESC, gap) AS k FROM sn),
 acc AS (SELECT meeting_id, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT), n] AS edges, st, en, least_ms FROM sz
   UNION ALL SELECT meeting_id, k, CASE WHEN len(trial) = len(edges) + 1 AND len(edges) - 1 < 12 AND len(list_filter(range(1, len(trial)), lambda j: trial[j + 1] - trial[j] < 3 OR en[trial[j + 1]] - st[trial[j] + 1] < least_ms)) = 0 THEN trial ELSE edges END, st, en, least_ms
   FROM (SELECT acc.meeting_id, rk.k, edges, st, en, least_ms, list_sort(list_distinct(list_append(edges, i))) AS trial FROM acc JOIN rk ON rk.meeting_id = acc.meeting_id AND rk.k = acc.k + 1)),
 fin AS (SELECT meeting_id, arg_max(edges, k) AS edges, any_value(st) AS st, any_value(en) AS en FROM acc GROUP BY meeting_id),
 seg AS (SELECT meeting_id, j - 1 AS segment, edges[j] AS first, edges[j + 1] - 1 AS last, st[edges[j] + 1] AS start_ms, en[edges[j + 1]] AS end_ms FROM (SELECT *, unnest(range(1, len(edges))) AS j FROM fin))"""
TOPIC_SEGMENTS = rf"""WITH RECURSIVE {_SEGMENTS},
 tf AS (SELECT meeting_id, segment, term, count(*) AS tf FROM tp JOIN seg USING (meeting_id) WHERE i BETWEEN first AND last AND len(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL),
 df AS (SELECT meeting_id, term, count(DISTINCT i) AS df FROM tp GROUP BY ALL), al AS (SELECT meeting_id, count(DISTINCT i) AS total FROM tp GROUP BY ALL),
 fo AS (SELECT meeting_id, term, arg_min(w, ROW(-c, len(w), w)) AS form FROM (SELECT meeting_id, term, w, count(*) AS c FROM tp GROUP BY ALL) GROUP BY ALL),
 kw AS (SELECT meeting_id, segment, string_agg(form, ', ' ORDER BY rank) FILTER (rank <= 4) AS keywords, string_agg(form, ', ' ORDER BY rank) FILTER (rank <= 3) AS three FROM (
   SELECT meeting_id, segment, term, row_number() OVER (PARTITION BY meeting_id, segment ORDER BY round(tf * ln(1 + total / df), 9) DESC, term) AS rank FROM tf JOIN df USING (meeting_id, term) JOIN al USING (meeting_id)) JOIN fo USING (meeting_id, term) GROUP BY ALL)
SELECT meeting_id, segment, first, last, start_ms, end_ms, coalesce(keywords, '') AS keywords, CASE WHEN three IS NULL THEN 'Topic ' || (segment + 1) ELSE upper(three[1]) || three[2:] END AS title FROM seg LEFT JOIN kw USING (meeting_id, segment)"""

#: Sentences chosen step by step: a step for each segment, then one for each candidate.
SUMMARY = rf"""WITH RECURSIVE {_SEGMENTS}, {sentences_sql('sess')},
 q AS (SELECT meeting_id, unit, u.i, list_sort({terms_sql('units.text')}) AS terms, units.text, len(list_filter(regexp_split_to_array(units.text, '\s+'), lambda x: x <> '')) AS nw FROM units JOIN u USING (meeting_id, idx)),
 f AS (SELECT *, nw >= 6 AND len(terms) >= 2 AND NOT ends_with(text, '?') AS fine FROM q), f2 AS (SELECT *, bool_or(fine) OVER (PARTITION BY meeting_id) AS has FROM f),
 cs AS (SELECT meeting_id, list(struct_pack(unit := unit, i := i, terms := terms) ORDER BY len(terms) DESC, unit) AS cs FROM f2 WHERE fine OR NOT has AND len(terms) > 0 GROUP BY meeting_id),
 sg AS (SELECT meeting_id, list(struct_pack(a := first, b := last) ORDER BY segment) AS sg FROM seg GROUP BY meeting_id),
 ch AS (SELECT meeting_id, 1 AS k, cs, sg, cs[1:0] AS chosen FROM cs JOIN sg USING (meeting_id)
   UNION ALL SELECT meeting_id, k + 1, cs, sg, CASE WHEN len(chosen) < 8 AND x IS NOT NULL THEN list_append(chosen, x) ELSE chosen END
   FROM (SELECT *, CASE WHEN k <= len(sg) THEN list_filter(cs, lambda c: c.i BETWEEN sg[k].a AND sg[k].b AND len(list_filter(chosen, lambda o: len(list_intersect(c.terms, o.terms)) >= 0.6 * len(list_distinct(list_concat(c.terms, o.terms))))) = 0)[1]
     ELSE list_filter([cs[k - len(sg)]], lambda c: len(list_filter(chosen, lambda o: o.unit = c.unit OR len(list_intersect(c.terms, o.terms)) >= 0.6 * len(list_distinct(list_concat(c.terms, o.terms))))) = 0)[1] END AS x FROM ch WHERE k <= len(sg) + len(cs)))
SELECT meeting_id, x.unit AS unit, CAST(len(x.terms) AS DOUBLE) AS score FROM (SELECT meeting_id, unnest(chosen) AS x FROM (SELECT meeting_id, arg_max(chosen, k) AS chosen FROM ch GROUP BY meeting_id))"""

CAPTIONS = rf"""WITH RECURSIVE {UTTERANCES_SQL}, w AS (SELECT meeting_id, idx, speaker, start_ms, end_ms, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM utterances),
 ln AS (SELECT *, string_split(list_reduce(ws, lambda a, x: CASE WHEN len(string_split(a, chr(10))[-1]) + 1 + len(x) <= 42 THEN a || ' ' || x ELSE a || chr(10) || x END), chr(10)) AS ls FROM w WHERE len(ws) > 0),
 ck AS (SELECT *, list_transform(range(0, (len(ls) + 1) // 2), lambda k: ls[2 * k + 1:2 * k + 2]) AS cks FROM ln),
 wt AS (SELECT *, list_transform(cks, lambda c: greatest(len(array_to_string(c, '')), 1)) AS z FROM ck),
 dr AS (SELECT meeting_id, idx, nth, speaker, start_ms + (end_ms - start_ms) * coalesce(list_sum(z[1:nth - 1]), 0) / list_sum(z) AS s, start_ms + (end_ms - start_ms) * list_sum(z[1:nth]) / list_sum(z) AS e, array_to_string(cks[nth], chr(10)) AS text FROM (SELECT *, unnest(range(1, len(cks) + 1)) AS nth FROM wt)),
 o AS (SELECT *, row_number() OVER v AS cue, lead(s) OVER v AS following FROM dr WINDOW v AS (PARTITION BY meeting_id ORDER BY s, e, idx, nth)),
 q AS (SELECT meeting_id, CAST(0 AS BIGINT) AS cue, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS e, CAST('' AS VARCHAR) AS speaker, CAST('' AS VARCHAR) AS text FROM (SELECT DISTINCT meeting_id FROM o)
   UNION ALL SELECT meeting_id, cue, s, CASE WHEN following IS NULL THEN e ELSE least(e, greatest(following, s + 1000)) END, speaker, text FROM (
     SELECT meeting_id, cue, s, least(greatest(e, s + 1000), s + 7000) AS e, following, speaker, text FROM (SELECT o.meeting_id, o.cue, greatest(o.s, q.e) AS s, o.e, o.following, o.speaker, o.text FROM q JOIN o ON o.meeting_id = q.meeting_id AND o.cue = q.cue + 1)))
SELECT meeting_id, CAST(cue AS INTEGER) AS cue, speaker, CAST(round(s) AS BIGINT) AS start_ms, CAST(round(e) AS BIGINT) AS end_ms, text FROM q WHERE cue > 0"""


def _stems(column: str) -> str:
    return f"list_transform({content_sql(column)}, lambda w: {_STEM})"


_NUMBER = "[0-9]+(?:[.,][0-9]+)*"
_PLAIN = "CASE WHEN ltrim(translate(x, '.,', ''), '0') = '' THEN '0' ELSE ltrim(translate(x, '.,', ''), '0') END"
_RUNS = r"regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’''-]*(?:\s+[A-ZÀ-ÖØ-Þ][\p{L}\p{N}_’''-]*)*')"
#: Claims against every utterance of their meeting, pair by pair.
VERIFIED = rf"""WITH {UTTERANCES_SQL}, {sentences_sql('utterances')},
 cl AS (SELECT meeting_id, unit AS claim, CASE unit % 4 WHEN 1 THEN text || ' for 1,0' || unit || ' in Paris Nord' WHEN 2 THEN text || ' zebra quagga okapi gnu antelope ' || text[1:20] WHEN 3 THEN replace(text, 'tion', 'tionn') ELSE text END AS text,
   CASE WHEN unit % 7 = 0 THEN NULL WHEN unit % 5 = 0 THEN start_ms + 100000 ELSE start_ms END AS f, CASE WHEN unit % 7 = 0 THEN NULL WHEN unit % 5 = 0 THEN end_ms + 100000 ELSE end_ms END AS t FROM units WHERE unit % 3 = 0),
 ct AS (SELECT meeting_id, claim, f, t, unnest(s) AS term, generate_subscripts(s, 1) AS nth FROM (SELECT *, {_stems('text')} AS s FROM cl)),
 ut AS (SELECT DISTINCT meeting_id, idx, start_ms, end_ms, unnest(s) AS said FROM (SELECT *, {_stems('text')} AS s FROM utterances)),
 ck AS (SELECT meeting_id, term, {key_sql('term')} AS k FROM (SELECT DISTINCT meeting_id, term FROM ct)), uk AS (SELECT meeting_id, said, {key_sql('said')} AS k FROM (SELECT DISTINCT meeting_id, said FROM ut)),
 li AS (SELECT DISTINCT a.meeting_id, a.term, b.said FROM ck a JOIN uk b ON a.meeting_id = b.meeting_id AND (a.term = b.said OR a.k <> '' AND b.k <> '' AND {likeness('a.k', 'b.k')} >= 0.86 - 1e-9)),
 hi AS (SELECT ct.meeting_id, claim, nth, bool_or(f IS NULL OR start_ms < t + 20000 AND end_ms > greatest(f - 20000, 0) OR start_ms >= greatest(f - 20000, 0) AND start_ms < t + 20000) AS near FROM ct JOIN li USING (meeting_id, term) JOIN ut USING (meeting_id, said) GROUP BY ALL),
 sc AS (SELECT ct.meeting_id, claim, count(*) AS n, count(*) FILTER (near) AS near, count(near) AS known, string_agg(term, ',' ORDER BY nth) FILTER (near IS NOT TRUE) AS missing FROM ct LEFT JOIN hi USING (meeting_id, claim, nth) GROUP BY ALL),
 un AS (SELECT DISTINCT meeting_id, {_PLAIN} AS number FROM (SELECT meeting_id, unnest(regexp_extract_all(text, '{_NUMBER}')) AS x FROM utterances)),
 bn AS (SELECT meeting_id, claim, string_agg(x, ',' ORDER BY x) AS bad_numbers FROM (SELECT meeting_id, claim, x, {_PLAIN} AS number FROM (SELECT meeting_id, claim, unnest(regexp_extract_all(text, '{_NUMBER}')) AS x FROM cl)) ANTI JOIN un USING (meeting_id, number) GROUP BY ALL),
 uw AS (SELECT DISTINCT meeting_id, unnest({folded_tokens_sql("text || ' ' || speaker")}) AS word FROM utterances),
 ru AS (SELECT meeting_id, claim, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT meeting_id, claim, CASE WHEN regexp_matches(text, '^[A-ZÀ-ÖØ-Þ]') AND NOT contains({_RUNS}[1], ' ') THEN {_RUNS}[2:] ELSE {_RUNS} END AS rs FROM cl)),
 bm AS (SELECT meeting_id, claim, string_agg(run, ',' ORDER BY run) AS bad_names FROM (SELECT DISTINCT meeting_id, claim, k, run FROM (SELECT *, unnest({folded_tokens_sql('run')}) AS word FROM ru) ANTI JOIN uw USING (meeting_id, word)) GROUP BY ALL),
 al AS (SELECT cl.meeting_id, cl.claim, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN near / n ELSE 1 END AS cited, CASE WHEN n > 0 THEN known / n ELSE 1 END AS overall, coalesce(missing, '') AS missing, coalesce(bad_numbers, '') AS bad_numbers, coalesce(bad_names, '') AS bad_names
   FROM cl LEFT JOIN sc USING (meeting_id, claim) LEFT JOIN bn USING (meeting_id, claim) LEFT JOIN bm USING (meeting_id, claim))
SELECT meeting_id, claim, CASE WHEN n < 2 THEN CASE WHEN overall >= 0.5 THEN 'supported' ELSE 'weak' END WHEN overall < 0.5 THEN 'unsupported' WHEN cited < 0.6 OR bad_numbers <> '' THEN 'weak' ELSE 'supported' END AS verdict,
  round(cited, 6) AS cited_support, round(overall, 6) AS overall_support, missing, bad_numbers, bad_names FROM al"""
