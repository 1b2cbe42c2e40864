"""The catalogue's queries in DuckDB's SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..functions import markup
from ..functions.charmap import HAN, CharMap
from ..functions.matching import GapLimits, Rules
from . import catalogue, demo
from .kernel_sql import exact_sql, flags_sql, masked_sql, rounds_sql, tracked_sql

WORDS = [(level, w) for level, ws in demo.LEXICON.items() for w in ws]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(text: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, '{flags}')"


def _subs(text: str, *patterns: str) -> str:
    for p in patterns:
        text = _sub(text, p)
    return text


_lexicon = "(VALUES " + ", ".join(f"({q(level)}, {q(w)}, {i})" for i, (level, w) in enumerate(WORDS)) + ") AS l(level, word, ord)"
_masked = "text"
for _, _w in WORDS:
    _masked = _sub(_masked, _w, "*" * len(_w), "gi")
_hits = f"SELECT doc_id, source, text, level, word, ord FROM documents, {_lexicon} WHERE contains(lower(text), word)"
_found = f"SELECT doc_id, source, list(word ORDER BY ord) AS words, list(level ORDER BY ord) AS levels FROM ({_hits}) GROUP BY doc_id, source"
# 0-based starts of words that cannot overlap themselves.
_starts = "list_transform(range(1, len(string_split({t}, {w}))), lambda i: CAST(list_sum(list_transform(string_split({t}, {w})[1:i], lambda s: length(s))) + (i - 1) * length({w}) AS BIGINT))"
_at = f"SELECT doc_id, level, word, unnest({_starts.format(t='lower(text)', w='word')}) AS pos FROM ({_hits})"
_chars = "string_split({t}, '')"
_compressed = "array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: i = 1 OR {c}[i] <> {c}[i - 1]), lambda i: {c}[i]), '')".format(c="c")


def _one_gap(word: str) -> str:
    """At most one character more than the word has, anywhere in it."""
    return "(?s)" + "|".join(word[:k] + ".?" + word[k:] for k in range(1, len(word)))


_gap_values = "(VALUES " + ", ".join(f"({q(w)}, {q(_one_gap(w))}, {q('(?s)^(?:' + _one_gap(w)[4:] + ')')})" for _, w in WORDS) + ") AS g(word, anywhere, begins)"
_kept_context = "CASE source " + " ".join(f"WHEN {q(k)} THEN {q(v or k)}" for k, v in demo.CONTEXTS.items()) + " ELSE source END"
_catalog = demo.CATALOG
_admin = "CASE WHEN levels[1] = 'level-1' THEN {a} ELSE {b} END".format(a=q(_catalog["levels.level-1.admin-warning"]), b=q(_catalog["warnings.admin-warning"]))
_admin_text = f"replace(replace(replace(replace({_admin}, '%player%', 'p' || doc_id), '%context%', {_kept_context}), '%bannedword%', array_to_string(words, ', ')), '%level%', levels[1])"

_ws = "[\\t-\\r ]"
_names = "[" + ", ".join(map(q, [*demo.COMMANDS, "!", "/msgx"])) + "]"
_commands = f"""
SELECT conv_id, turn, CASE WHEN n = '!' THEN '!' || text ELSE (CASE WHEN turn % 2 = 0 THEN upper(n) ELSE n END) || ' ' || role || ' ' || text END AS text
FROM (SELECT *, {_names}[1 + CAST((conv_id + turn) % 8 AS BIGINT)] AS n FROM conversations)"""
_routed = f"""
SELECT *, CASE WHEN regexp_matches(text, '(?is)^/(msg|tell)(\\s|$)') THEN 'msg' WHEN regexp_matches(text, '(?is)^/me(\\s|$)') THEN 'me'
  WHEN regexp_matches(text, '(?is)^/say(\\s|$)') THEN 'say' WHEN starts_with(text, '!') OR regexp_matches(text, '(?is)^/shout(\\s|$)') THEN 'shout' END AS route
FROM ({_commands})"""
_rest = f"""
SELECT *, regexp_replace(regexp_extract(text, '(?s)^([^ \\t-\\r]+)(.*)$', 2), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS rest, regexp_extract(text, '(?s)^([^ \\t-\\r]+)', 1) AS command
FROM ({_routed}) WHERE route IS NOT NULL"""
_second = f"(?s)^([^\\t-\\r ]*{_ws}[^\\t-\\r ]*){_ws}(.*)$"
_checked = f"""
SELECT *, CASE route
  WHEN 'msg' THEN CASE WHEN regexp_matches(rest, {q(_second)}) THEN regexp_extract(rest, {q(_second)}, 2) ELSE rest END
  WHEN 'me' THEN rest
  WHEN 'say' THEN concat_ws(' ', string_split_regex(rest, '\\s+')[1], string_split_regex(rest, '\\s+')[3])
  ELSE CASE WHEN starts_with(text, '!') THEN regexp_replace(substr(text, 2), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') ELSE text END END AS checked
FROM ({_rest})"""
_rebuilt = f"""
SELECT conv_id, turn, CASE route
  WHEN 'msg' THEN CASE WHEN regexp_matches(rest, {q(_second)}) THEN command || ' ' || regexp_extract(rest, {q(_second)}, 1) || ' ' || f ELSE command || ' ' || f END
  WHEN 'me' THEN command || ' ' || f
  WHEN 'say' THEN command || ' ' || array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 THEN v[1] WHEN i = 3 AND len(v) >= 2 THEN v[2] ELSE w[i] END), ' ')
  ELSE CASE WHEN starts_with(text, '!') THEN '!' || f ELSE text END END AS rebuilt
FROM (SELECT *, string_split_regex(rest, '\\s+') AS w, string_split_regex(f, '\\s+') AS v FROM (SELECT *, regexp_replace(checked, 'the', '***', 'gi') AS f FROM ({_checked})))"""

_events = "SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type AS level FROM events"
_day = "date_trunc('day', ts)"
_fifteen = "floor(epoch(ts) / 15)"
_punish = "(VALUES " + ", ".join(f"({q(level)}, {n}, {i}, {q(c)})" for level, by in demo.CONFIG.punish.items() for n, cs in by.items() for i, c in enumerate(cs)) + ") AS p(level, threshold, cmd_ord, command)"


def _escalation(bucket: str) -> str:
    return f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id, level, {bucket} ORDER BY ts, event_id) AS number FROM ({_events}))
SELECT event_id, user_id, v.level, number, replace(command, '%player%', user_id) AS command FROM v JOIN {_punish} ON p.level = v.level AND p.threshold = number"""


_rules = demo.CONFIG.rules()
_gap = GapLimits(1, 1, 1)
_texts = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"
_one_word = Rules((("trash", "", _gap, False),))
_trash_or_idiot = Rules((("trash", "", _gap, False), ("idiot", "", _gap, False)), ("trashy",))
_forward = Rules(tuple((w, lv, _gap, False) for lv, w in WORDS))
_redacted = rounds_sql(_rules, _texts)
_codes = "[§&][0-9a-fA-FklmnorX]"
_SCANNED = "(?s)" + "|".join([markup.SPREAD_HEX.replace("(", "(?:"), markup.SHORT_HEX.replace("(", "(?:", 1), markup.TAG, _codes, "<#[^>]*>"])
_units = "(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def _pieces(text: str, pattern: str) -> str:
    """id and, for each part between matches, where it begins and its length, in units."""
    parts, hits = f"string_split_regex({text}, {q(pattern)})", f"regexp_extract_all({text}, {q(pattern)})"
    sizes = lambda x: f"list_transform({x}, lambda x: {_units.format(x='x')})"
    return f"""
SELECT page_id, i, sizes[i] AS n, coalesce(list_sum(sizes[1:i - 1]), 0) + coalesce(list_sum(hits[1:i - 1]), 0) AS spot
FROM (SELECT page_id, sizes, hits, unnest(range(1, len(sizes) + 1)) AS i FROM (SELECT page_id, {sizes(parts)} AS sizes, {sizes(hits)} AS hits FROM pages))"""


_tip = len(catalogue.TIP)
_quotable = """(SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[<>''"\\\\&§:]', '', 'g') AS t FROM conversations)"""
_chat = "SELECT CAST(conv_id AS VARCHAR) AS user_id, turn AS seq, turn * 1000 AS ms, CASE turn % 4 WHEN 0 THEN 'th ' WHEN 1 THEN 'ing ' ELSE '' END || text AS text, {clear} AS clear FROM conversations WHERE text <> ''"
_words = ["nothing", "gnihton", "thing", "gniht"]


def _cross(messages: str, then: str) -> str:
    return tracked_sql(messages, "thing", "level-1", 3, [("nothing", "level-2")]) + "\n" + then


_hit = f"user_id, seq, hit_word, hit_level, crossed, {exact_sql('masked', _words)} AS filtered"
_line = "CASE WHEN turn % 2 = 1 THEN 'sh ' ELSE '' END || coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' tra' ELSE '' END"
_parts = f"SELECT conv_id, {_line} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {_line}) AS part_no FROM conversations"


def _rounds_of(source: str) -> str:
    """A query of id, filtered, first_word, found of the texts that change."""
    return f"({rounds_sql(_rules, source)} SELECT id, filtered, words, first_word, found FROM done)"


_whole = f"SELECT conv_id, string_agg(text, chr(10) ORDER BY part_no) AS text, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY part_no) AS sizes FROM ({_parts}) GROUP BY conv_id"
_title = f"SELECT conv_id, text || ' id.iot' AS text FROM ({_parts}) WHERE part_no = 1"


_every_word = lambda lists: f"array_to_string(list_transform({lists}, lambda x: regexp_extract(x, '^(.*)/', 1)), ', ')"
_merge = ["thing", "then", "than", "this"]
_found_in = lambda t: "list_filter([" + ", ".join(f"CASE WHEN contains(lower({t}), {q(w)}) THEN {q(w)} END" for w in _merge) + "], lambda w: w IS NOT NULL)"
_styled = (("c", "one"), ("cl", "two"), ("", "three"), ("9", "four"), ("9l", "five"), ("9l", "sixseven"))


def _values(rows, names: str) -> str:
    text = lambda x: "NULL" if x is None else q(x) if isinstance(x, str) else f"CAST({x} AS BIGINT)"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS v({names})"


def _config_rows():
    yield from (("word", lv, w, 100 * i + j) for i, (lv, ws) in enumerate(demo.LEXICON.items()) for j, w in enumerate(ws))
    yield from (("route", n, r, i) for i, (n, r) in enumerate([("msg", "2|/msg,/tell|"), ("me", "|/me|"), ("say", "1,3|/say|"), ("off", "|/other|"), ("shout", "1|/shout|!")]))
    yield from (("punish", lv, c, 100 * n + i) for lv, by in demo.SETTINGS["punish-commands"]["levels"].items() for n, cs in by.items() for i, c in enumerate(cs))
    yield from (("allow", w, w, 0) for w in demo.SETTINGS["whitelist"])
    yield from [("info", "words", "10", 0), ("info", "levels", "2", 0), ("info", "routes", "5", 0), ("missing", "b", "b", 0), ("missing", "d", "d", 0)]


def _span_words(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({q(w)})" for w in words) + ") AS l(word)"


_the = "(VALUES ('the', 'there'), ('ing', 'thing')) AS l(word, cover)"
_count = "(length({t}) - length(replace({t}, {w}, ''))) // length({w})"

SQL = {
    "flagship_redact": f"SELECT doc_id, CAST(len(words) AS BIGINT) AS n_hits, words[1] AS first_word, filtered AS filtered_text FROM ({_found}) JOIN (SELECT doc_id, {_masked} AS filtered FROM documents) USING (doc_id)",
    "exact_flag": f"SELECT doc_id, level, word FROM ({_hits})",
    "exact_count_by_level": f"SELECT level, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM ({_hits}) GROUP BY level",
    "exact_positions": f"SELECT doc_id, word, pos FROM ({_at})",
    "fuzzy_flag": f"SELECT doc_id, word FROM documents, {_gap_values} WHERE regexp_matches(lower(text), anywhere)",
    "fuzzy_gap_classes": f"""
WITH f AS (SELECT doc_id, lower(text) AS t, word, begins FROM documents, {_gap_values} WHERE regexp_matches(lower(text), anywhere)),
p AS (SELECT *, unnest(range(1, length(t) + 1)) AS p FROM f),
m AS (SELECT word, regexp_extract(substr(t, p, length(word) + 1), begins) AS m FROM p WHERE regexp_matches(substr(t, p, length(word) + 1), begins))
SELECT word, CAST(len(regexp_extract_all(m, '[A-Za-z]')) - length(word) AS INTEGER) AS english, CAST(length(m) - len(regexp_extract_all(m, '[A-Za-z]')) AS INTEGER) AS others, count(*) AS n
FROM m GROUP BY ALL""",
    "compressed_flag": flags_sql(_forward, _texts) + "\nSELECT DISTINCT id AS doc_id, word FROM x1",
    "reverse_flag": f"SELECT doc_id, reverse(word) AS word FROM documents, {_span_words(['the', 'tion', 'and', *[w for _, w in WORDS]])} WHERE contains(lower(text), reverse(word))",
    "allowlist_anti": f"SELECT * FROM (SELECT doc_id, word, {_count.format(t='lower(text)', w='word')} - {_count.format(t='lower(text)', w='cover')} AS n FROM documents, {_the}) WHERE n > 0",
    "nonoverlap_select": f"""
WITH RECURSIVE s AS (
  SELECT DISTINCT doc_id, pos AS s, pos + length(word) AS e FROM (
    SELECT doc_id, word, unnest({_starts.format(t='lower(text)', w='word')}) AS pos FROM documents, {_span_words(['than', 'thanan', 'hana', 'idiot', 'trash'])})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS rn FROM s),
r AS (
  SELECT doc_id, rn, s, e, true AS kept, e AS last FROM o WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.rn, o.s, o.e, o.s >= r.last, CASE WHEN o.s >= r.last THEN o.e ELSE r.last END FROM r JOIN o ON o.doc_id = r.doc_id AND o.rn = r.rn + 1)
SELECT doc_id, s AS start, e AS "end" FROM r WHERE kept""",
    "strip_codes": f"SELECT doc_id, md5({_subs('t', markup.SPREAD_HEX, markup.SHORT_HEX, markup.LEGACY, markup.HEX_TAG)}) AS shown_md5 FROM (SELECT doc_id, '&a' || replace(text, ' the ', ' &cthe§r ') || '&x&1&2&3&4&5&6&#abc<#12ab9f>&x' AS t FROM documents)",
    "canonical_hex": f"SELECT doc_id, md5({_sub(_sub('t', markup.SPREAD_HEX, chr(60) + '#' + ''.join(f'{chr(92)}{i}' for i in range(1, 7)) + '>'), markup.SHORT_HEX, '<#' + chr(92) + '1>')}) AS coded_md5 FROM (SELECT doc_id, replace(text, ' the ', ' &#12aB9fthe&#abc ') || '&x&1&2&3&4&5&6' AS t FROM documents)",
    "strip_tags": f"SELECT page_id, md5({_sub('html', '(?s)' + markup.TAG)}) AS stripped_md5 FROM pages",
    "strip_everything": f"SELECT page_id, md5({_subs('html', markup.SPREAD_HEX, markup.SHORT_HEX, '(?s)' + markup.TAG, markup.LEGACY)}) AS stripped_md5 FROM pages",
    "any_tags": f"SELECT page_id, CAST(len(x) AS BIGINT) AS n_tags, md5(array_to_string(x, chr(10))) AS tags_md5 FROM (SELECT page_id, regexp_extract_all(html, {q(markup.ANY_TAG)}) AS x FROM pages)",
    "charmap_fold": f"SELECT doc_id, md5(translate(lower(text), {q(demo.FOLD_FROM)}, {q(demo.FOLD_TO)})) AS folded_md5 FROM documents",
    "class_counts": f"SELECT doc_id, CAST(c AS BIGINT) AS chinese, CAST(e AS BIGINT) AS english, CAST(length(text) - c - e AS BIGINT) AS others FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[{HAN}]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS e FROM documents)",
    "compress_text": f"SELECT doc_id, md5({_compressed}) AS compressed_md5, md5(array_to_string(list_reverse(c), '')) AS reversed_md5 FROM (SELECT doc_id, {_chars.format(t='text')} AS c FROM documents)",
    "redact_exact": f"SELECT * FROM (SELECT doc_id, {_masked} AS filtered, text FROM documents) WHERE filtered <> text".replace("SELECT *", "SELECT doc_id, filtered", 1),
    "detected_agg": f"SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, array_to_string(words, ', ') AS words FROM ({_found})",
    "first_detection": f"SELECT doc_id, pos, word, level FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, word) AS rn FROM ({_at})) WHERE rn = 1",
    "limits_default_join": f"SELECT l.level, word, coalesce(c, 2) AS chinese, coalesce(e, 2) AS english, coalesce(o, 2) AS others FROM {_lexicon} LEFT JOIN (VALUES " + ", ".join(f"({q(k)}, CAST({c} AS BIGINT), CAST({e} AS BIGINT), CAST({o} AS BIGINT))" for k, (c, e, o) in demo.GAPS.items()) + ") AS g(level, c, e, o) ON g.level = l.level",
    "lexicon_size": f"SELECT count(*) AS n_words FROM {_lexicon}",
    "route_commands": f"SELECT route, count(*) AS n FROM ({_routed}) GROUP BY route",
    "extract_args": f"SELECT conv_id, turn, route, checked FROM ({_checked})",
    "rebuild_command": _rebuilt,
    "combine_parts": """
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn, text NULLS FIRST) AS whole, string_agg(CAST(s AS VARCHAR), ',' ORDER BY turn, text NULLS FIRST) AS starts
FROM (SELECT conv_id, turn, text, coalesce(text, '') AS t, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)
GROUP BY conv_id""",
    "split_parts": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) - 1 AS part_no, regexp_replace(coalesce(text, ''), '[tT]he', '***', 'g') AS part FROM conversations",
    "merge_detections": f"""
WITH p AS (SELECT conv_id, {_found_in('text')} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) AS part_no FROM conversations),
e AS (SELECT conv_id, flatten(list(w ORDER BY part_no)) AS pages, min_by(w, part_no) AS title FROM p GROUP BY conv_id),
f AS (SELECT conv_id, pages, CASE WHEN len(title) > 0 THEN list_concat([title[1]], pages) ELSE pages END AS every FROM e)
SELECT conv_id, array_to_string(list_filter(every, lambda w, i: list_position(every, w) = i), ', ') AS merged, array_to_string(pages, ', ') AS every FROM f""",
    "suffix_mask": """
SELECT conv_id, turn, CASE WHEN n IS NULL THEN text ELSE left(text, length(text) - n) || repeat('*', n) END AS masked
FROM (SELECT *, list_min(list_filter(range(1, least(length(text), 8) + 1), lambda i: right(lower(text), i) = right('anything', i))) AS n FROM conversations WHERE text <> '')""",
    "escalation": _escalation(_day),
    "punish_actions": _escalation(_fifteen).replace(f"({_events})", f"(SELECT event_id, date_trunc('day', ts) + to_seconds(CAST(event_id % 60 AS DOUBLE)) AS ts, user_id, level FROM ({_events}))"),
    "violation_numbers": f"SELECT event_id, level, row_number() OVER (PARTITION BY user_id, level, {_day} ORDER BY ts, event_id) AS number FROM ({_events})",
    "violation_resets": f"""
WITH e AS (SELECT *, count(*) FILTER (event_id % 10 = 0) OVER (PARTITION BY user_id, {_day} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM ({_events}))
SELECT event_id, level, row_number() OVER (PARTITION BY user_id, level, {_day}, era ORDER BY ts, event_id) AS number FROM e WHERE event_id % 10 <> 0""",
    "violation_counts": f"SELECT user_id, level, strftime({_day}, '%Y-%m-%d') AS day, count(*) AS n FROM ({_events}) GROUP BY ALL",
    "render_alert": f"SELECT doc_id AS msg_id, {_admin_text} AS text FROM ({_found})",
    "player_warning": f"SELECT doc_id AS msg_id, CAST(doc_id AS VARCHAR) AS user_id, 'player' AS audience, CASE WHEN levels[1] = 'level-1' THEN {q(_catalog['levels.level-1.player-warning'])} ELSE {q(_catalog['warnings.player-warning'])} END AS text FROM ({_found})",
    "admin_fanout": f"SELECT doc_id AS msg_id, n_name AS audience, {_admin_text} AS text FROM ({_found}), nation",
    "context_fallback": f"SELECT {_kept_context} AS context, count(*) AS n FROM documents GROUP BY 1",
    "permission_filter": "SELECT event_id, e.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS admin FROM events e",
    "chat_union": """
SELECT 'chat' AS surface, CAST(conv_id AS VARCHAR) AS user_id, role AS user_name, text, turn AS seq, turn AS "at" FROM conversations WHERE text <> ''
UNION ALL SELECT 'shout', 'shouter', NULL, text, -1, -1 FROM benchmark WHERE text <> '' UNION ALL SELECT 'anvil', NULL, NULL, p_name, -1, -1 FROM part""",
    "redact_fuzzy": _redacted + "\nSELECT id AS doc_id, filtered, words, first_word, first_level FROM done",
    "redact_pass": rounds_sql(_rules, _texts, 1) + "\nSELECT id AS doc_id, filtered FROM done",
    "rewritten_messages": _redacted + "\nSELECT doc_id, md5(text) AS old_md5, filtered AS new_text FROM done JOIN documents ON doc_id = id",
    "refilter_stored": _redacted + "\nSELECT id AS doc_id, filtered, CAST(len(found) AS BIGINT) AS n_words FROM done",
    "detected_long": _redacted + """
SELECT doc_id, regexp_extract(x, '^(.*)/', 1) AS word, regexp_extract(x, '/(.*)$', 1) AS level, place FROM (SELECT id AS doc_id, unnest(found) AS x, generate_subscripts(found, 1) - 1 AS place FROM done)""",
    "contains_any": flags_sql(_rules, _texts) + "\nSELECT DISTINCT id AS doc_id FROM x1",
    "candidate_union": flags_sql(_rules, _texts) + "\nSELECT id AS doc_id, s0 AS start, e0 AS \"end\", word, level FROM x1",
    "chosen_matches": rounds_sql(_rules, _texts, 1) + "\nSELECT id AS doc_id, places[1] AS start, word, array_to_string(places, ',') AS places FROM h1",
    "contains_one": flags_sql(_trash_or_idiot, _texts) + "\nSELECT DISTINCT id AS doc_id, word FROM x1",
    "redact_one_word": flags_sql(_one_word, _texts) + f"\nSELECT id AS doc_id, text AS filtered FROM ({masked_sql('d1', 'x1')})",
    "wide_words": """
SELECT doc_id, md5('a *** ' || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' 𝒴***x' ELSE '' END) AS filtered_md5, '😀x' AS words FROM documents""",
    "markup_detect": f"""
SELECT page_id, true AS changed, md5('<hover:show_text:''<red>*****''><lang:k:''<blue>**&c***''> ' || coalesce(filtered, html)) AS filtered_md5, {_every_word('list_filter(every, lambda x, i: list_position(every, x) = i)')} AS words
FROM (SELECT *, list_concat(['trash/level-1', 'idiot/level-1'], coalesce(found, [])) AS every FROM pages LEFT JOIN {_rounds_of("SELECT page_id AS id, html AS text FROM pages WHERE html IS NOT NULL")} ON id = page_id)""",
    "visible_text": f"SELECT page_id, md5('tip' || {_subs('html', markup.SPREAD_HEX, markup.SHORT_HEX, '(?s)' + markup.TAG, markup.LEGACY)}) AS shown_md5 FROM pages",
    "tag_payloads": f"SELECT conv_id, turn, concat(t, 'one', 'run_command:''/x ', t, '''two', t, t, 'b ', t) AS shown FROM {_quotable}",
    "tag_tokens": f"""
WITH t AS (SELECT page_id, string_split_regex(html, {q('(?s)' + markup.TAG)}) AS texts, regexp_extract_all(html, {q('(?s)' + markup.TAG)}) AS tags FROM pages),
e AS (
  SELECT page_id, 2 * i AS o, texts[i] AS token, false AS tag FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM t) WHERE texts[i] <> ''
  UNION ALL SELECT page_id, 2 * i + 1, tags[i], true FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM t))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS place, md5(token) AS token_md5, tag FROM e""",
    "plain_colons": f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 13 + {_units.format(x='t')} ELSE -1 END AS \"at\" FROM {_quotable}",
    "normalize_text": f"SELECT doc_id, md5(lower(nfc_normalize({_subs('text', markup.SPREAD_HEX, markup.SHORT_HEX, '(?s)' + markup.TAG, markup.LEGACY)}))) AS normal_md5 FROM documents",
    "normalize_letters": f"SELECT doc_id, md5(translate(lower(text), {q(demo.FOLD_FROM)}, {q(demo.FOLD_TO)})) AS normal_md5, CAST({_units.format(x='text')} AS BIGINT) AS n_places FROM documents",
    "position_map": f"""
SELECT page_id, md5('23+3' || coalesce(string_agg(CASE WHEN n > 0 THEN ' ' || CAST(spot + {_tip} AS VARCHAR) || '+' || n END, '' ORDER BY i), '')) AS places_md5 FROM ({_pieces('html', _SCANNED)}) GROUP BY page_id""",
    "mask_ranges": f"SELECT conv_id, turn, '<b>#&c##</b>' || t || '#<red>#&a##' AS masked FROM {_quotable}",
    "spread_hex": f"SELECT doc_id, md5({_sub('t', markup.SPREAD_HEX, chr(60) + '#' + ''.join(f'{chr(92)}{i}' for i in range(1, 7)) + '>')}) AS coded_md5 FROM (SELECT doc_id, replace(text, ' the ', ' &x&1&2&a&B&9&fthe&#abc ') || '&x&1&2&3&4&5&g' AS t FROM documents)",
    "styled_text": f"""
SELECT page_id, md5({q(chr(10).join(f'{style}|{text}' for style, text in _styled))} || coalesce(string_agg(chr(10) || '|' || x, '' ORDER BY i) FILTER (x <> ''), '')) AS runs_md5
FROM (SELECT page_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT page_id, string_split_regex(regexp_replace(html, '<[a-zA-Z0-9_]+>', '', 'g'), '</[a-zA-Z0-9_]+>') AS x FROM pages))
GROUP BY page_id""",
    "suffix_mask_kernel": """
SELECT conv_id, turn, CASE WHEN n IS NULL THEN text || '<b>' ELSE left(text, length(text) - n) || repeat('*', n) || '<b>' END AS masked,
       CASE WHEN n IS NULL THEN text || '<b>' ELSE left(text || '<b>', length(text) + 3 - n) || repeat('*', n) END AS cut
FROM (SELECT *, list_min(list_filter(range(1, least(length(text), 8) + 1), lambda i: right(lower(text), i) = right('anything', i))) AS n FROM conversations WHERE text <> '')""",
    "config_tables": _values(_config_rows(), "kind, name, value, ord"),
    "reversed_spellings": f"SELECT level, word, CASE WHEN level = 'level-1' THEN reverse(word) END AS reversed FROM {_lexicon}",
    "catalog_rows": _values([("en", "warnings.player-warning", "p"), ("en", "warnings.admin-warning", "a"), ("en", "levels.level-1.player-warning", "l"), ("en", "top", "3"), ("de", "fallback.x", "y")], "lang, key, template"),
    "charmap_tables": f"""
WITH c AS (SELECT doc_id, text, string_split(text, '') AS c FROM documents)
SELECT doc_id, md5(translate(text, {q(demo.FOLD_FROM + demo.FOLD_FROM.upper() + 'ß')}, {q(demo.FOLD_TO + demo.FOLD_TO + 'x')})) AS folded_md5,
  md5(array_to_string(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '[{HAN}xXß]') THEN '0' WHEN regexp_matches(x, '[A-Za-z{demo.FOLD_FROM}{demo.FOLD_FROM.upper()}]') THEN '1' WHEN x = '' THEN '' ELSE '2' END), '')) AS kinds_md5 FROM c""",
    "cross_message": _cross(_chat.format(clear="false"), f"SELECT {_hit} FROM tracked WHERE hit_word IS NOT NULL"),
    "cross_message_idle": _cross(_chat.format(clear="false").replace("turn * 1000", "turn * 25000 + (turn // 3) * 120000"), f"SELECT {_hit} FROM tracked WHERE hit_word IS NOT NULL"),
    "cross_message_reset": _cross(_chat.format(clear="turn % 4 = 2"), f"SELECT user_id, seq, hit_word, hit_level, crossed, CASE WHEN seq % 4 = 2 THEN text ELSE {exact_sql('masked', _words)} END AS filtered FROM tracked"),
    "cross_message_commands": tracked_sql(_chat.format(clear="false"), "thing", "level-1", 3, [("nothing", "level-2")]) + "\nSELECT user_id, seq, hit_word, hit_level, crossed, masked AS filtered FROM tracked WHERE crossed",
    "cross_message_nobody": _cross(
        _chat.format(clear="false").replace("CAST(conv_id AS VARCHAR)", "CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'nobody ' || row_number() OVER (ORDER BY conv_id, turn) END"),
        f"SELECT seq, {_hit.partition('seq, ')[2]} FROM tracked WHERE hit_word IS NOT NULL",
    ),
    "shout_api": _cross(
        _chat.format(clear="false"),
        f"""SELECT t.user_id, seq, CASE WHEN o.user_id IS NULL THEN {exact_sql('text', _words)} ELSE {exact_sql('masked', _words)} END AS filtered, CASE WHEN o.user_id IS NOT NULL THEN hit_word END AS hit_word, o.user_id IS NOT NULL AND crossed AS crossed
FROM tracked t LEFT JOIN (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE c_custkey % 2 = 0) o ON o.user_id = t.user_id""",
    ),
    "signs": f"""
WITH p AS (SELECT conv_id, part_no, p.text, x.filtered, x.found FROM ({_parts}) p LEFT JOIN {_rounds_of(f"SELECT conv_id || ' ' || part_no AS id, text FROM ({_parts})")} x ON x.id = conv_id || ' ' || part_no),
l AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY part_no) AS old, string_agg(coalesce(filtered, text), chr(10) ORDER BY part_no) AS lines, coalesce(flatten(list(found ORDER BY part_no) FILTER (found IS NOT NULL)), []) AS found FROM p GROUP BY conv_id),
b AS (SELECT l.*, x.filtered, list_concat(l.found, coalesce(x.found, [])) AS every FROM l LEFT JOIN {_rounds_of(f"SELECT conv_id AS id, text FROM ({_whole})")} x ON x.id = conv_id),
c AS (SELECT *, coalesce(filtered, lines) AS new FROM b)
SELECT conv_id, new AS lines, new <> old AS changed, {_every_word('list_filter(every, lambda x, i: list_position(every, x) = i)')} AS words FROM c""",
    "books": f"""
WITH w AS (SELECT w.conv_id, w.text, w.sizes, x.filtered, x.found FROM ({_whole}) w LEFT JOIN {_rounds_of(f"SELECT conv_id AS id, text FROM ({_whole})")} x ON x.id = w.conv_id),
t AS (SELECT t.conv_id, t.text, x.filtered, x.found FROM ({_title}) t LEFT JOIN {_rounds_of(f"SELECT conv_id AS id, text FROM ({_title})")} x ON x.id = t.conv_id),
a AS (SELECT w.conv_id, coalesce(w.filtered, w.text) AS pages, coalesce(t.filtered, t.text) AS new_title, CASE WHEN w.conv_id % 2 = 0 THEN '*****' END AS new_author,
        w.filtered IS NOT NULL OR t.filtered IS NOT NULL OR w.conv_id % 2 = 0 AS changed,
        list_concat(coalesce(w.found, []), coalesce(t.found, []), CASE WHEN w.conv_id % 2 = 0 THEN ['clown/level-2'] ELSE [] END) AS every, sizes FROM w JOIN t USING (conv_id))
SELECT conv_id, pages, sizes, new_title, new_author, changed, coalesce(regexp_extract(every[1], '^(.*)/', 1), '') AS first_word, {_every_word('every')} AS words FROM a""",
    "item_names": f"""
WITH n AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' i.d.iot hsart' ELSE '' END AS name FROM part WHERE p_partkey % 10 <> 0)
SELECT CAST(p_partkey AS VARCHAR) AS user_id, name, coalesce(filtered, name) AS filtered, filtered IS NOT NULL AS changed
FROM n LEFT JOIN {_rounds_of("SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' i.d.iot hsart' ELSE '' END AS text FROM part")} ON id = p_partkey""",
    "sql_redact": f"""
WITH b AS (SELECT item_id, text || CASE WHEN item_id % 3 = 0 THEN ' you id iot, nwolc!' ELSE '' END AS t FROM benchmark),
y AS ({flags_sql(Rules((("you", "", GapLimits(), False),), _rules.allow), "SELECT item_id AS id, text || CASE WHEN item_id % 3 = 0 THEN ' you id iot, nwolc!' ELSE '' END AS text FROM benchmark")}
  SELECT id, text AS without_you FROM ({masked_sql('d1', 'x1')}))
SELECT item_id, coalesce(filtered, t) AS filtered, filtered IS NOT NULL AS banned, coalesce(without_you, t) AS without_you, first_word
FROM b LEFT JOIN {_rounds_of("SELECT item_id AS id, text || CASE WHEN item_id % 3 = 0 THEN ' you id iot, nwolc!' ELSE '' END AS text FROM benchmark")} x ON x.id = item_id LEFT JOIN y ON y.id = item_id""",
}
