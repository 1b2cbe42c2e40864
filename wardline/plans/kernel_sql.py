"""SQL twins of the kernel: candidates, selection, masks and rounds as recursive queries, for texts without markup.

A round is a chain of CTEs over texts d (id, text): the lower-case text and the text with runs taken together; embeddings
that grow by one character a step; those within the limits and not covered by the allow-list; the choice from the left;
and the masked text, which is the next round's input. Tracking is one recursive query over the messages of a user.
"""

from __future__ import annotations

from ..functions.charmap import HAN, CharMap
from ..functions.columns import embedding_pattern
from ..functions.matching import Rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_rows(rules: Rules):
    """(spelling, level, limits) in the order in which candidates come."""
    for word, level, limits, both in rules.words:
        for spelling in [word, word[::-1]] if both and len(word) >= 2 else [word]:
            yield spelling, level, limits


def rules_sql(rules: Rules) -> str:
    kinds, rows = CharMap(), []
    for i, (spelling, level, g) in enumerate(_rule_rows(rules)):
        needle = spelling.lower()
        own = [kinds.classify(c) for c in needle]
        most = g.most if rules.fuzzy else 0
        values = [str(i), q(spelling), q(needle), q(level), str(len(needle)), str(g.chinese), str(g.english), str(g.others), str(most), str(own.count(0)), str(own.count(1)), q("(?s)" + embedding_pattern(needle, most))]
        rows.append(f"({', '.join(values)})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS r(ord, word, needle, level, size, chinese, english, others, most, own_c, own_e, pattern)"


def candidates_sql(rules: Rules, k: int, d: str) -> str:
    """CTEs of round k over d (id, text), up to x{k}: id, ord, form, s0, e0, places, word, level of every match that counts."""
    every = q("(?s)" + "|".join(embedding_pattern(s.lower(), g.most if rules.fuzzy else 0) for s, _, g in _rule_rows(rules)))
    runs = "list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1])"
    short = f"UNION ALL SELECT id, 1, short FROM t{k} WHERE length(short) < length(t)" if rules.fuzzy else ""
    covers = "".join(
        f" AND NOT contains(substr(t, greatest(e0 - {len(a)}, 0) + 1, s0 + {len(a)} - greatest(e0 - {len(a)}, 0)), {q(a.lower())})" for a in rules.allow
    )
    return f"""
r{k} AS ({rules_sql(rules)}),
t{k} AS (
  SELECT id, text, t, runs, array_to_string(list_transform(runs, lambda i: c[i]), '') AS short
  FROM (SELECT *, {runs} AS runs FROM (SELECT id, text, lower(text) AS t, string_split(lower(text), '') AS c FROM {d} WHERE text <> ''))
  WHERE regexp_matches(t, {every}) OR regexp_matches(array_to_string(list_transform(runs, lambda i: c[i]), ''), {every})),
f{k} AS (SELECT id, 0 AS form, t AS s FROM t{k} {short}),
l{k} AS (SELECT id, form, unnest(string_split(s, '')) AS letter, generate_subscripts(string_split(s, ''), 1) AS p FROM f{k}),
p{k} AS (
  SELECT f.id, f.form, r.ord, l.p, r.needle, r.size, substr(f.s, l.p, r.size + r.most) AS ahead
  FROM f{k} f JOIN r{k} r ON regexp_matches(f.s, r.pattern) JOIN l{k} l ON l.id = f.id AND l.form = f.form AND l.letter = substr(r.needle, 1, 1)),
e{k} AS (
  SELECT id, form, ord, p AS start, needle, size, ahead, 1 AS place, 1 AS n, [p] AS places FROM p{k}
  UNION ALL
  SELECT id, form, ord, start, needle, size, ahead, spot, n + 1, list_append(places, start + spot - 1)
  FROM (SELECT *, place + instr(substr(ahead, place + 1), substr(needle, n + 1, 1)) AS spot FROM e{k} WHERE n < size)
  WHERE spot > place),
w{k} AS (
  SELECT e.id, e.form, e.start, e.places, r.*, left(e.ahead, e.place) AS w FROM e{k} e JOIN r{k} r ON r.ord = e.ord WHERE e.n = e.size),
m{k} AS (
  SELECT * FROM (SELECT *, len(regexp_extract_all(w, '[{HAN}]')) - own_c AS gap_c, len(regexp_extract_all(w, '[A-Za-z]')) - own_e AS gap_e FROM w{k})
  WHERE length(w) = size OR (gap_c <= chinese AND gap_e <= english AND length(w) - size - gap_c - gap_e <= others)),
x{k} AS (
  SELECT id, ord, form, start, s0, e0, places, word, level FROM (
    SELECT id, ord, form, start, word, level, t, places, places[1] AS s0, places[-1] + 1 AS e0
    FROM (SELECT m.id, m.ord, m.form, m.start, m.word, m.level, t.t, CASE WHEN m.form = 0 THEN list_transform(m.places, lambda p: p - 1) ELSE list_transform(m.places, lambda p: t.runs[p] - 1) END AS places
          FROM m{k} m JOIN t{k} t ON t.id = m.id))
  WHERE true{covers})"""




def masked_sql(texts: str, matches: str) -> str:
    """id and text, for texts (id, text) with matches (id, places) in them."""
    return f"""SELECT id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_contains(mask, i - 1) THEN '*' ELSE c[i] END), '') AS text
  FROM (SELECT d.id, string_split(d.text, '') AS c, mask FROM {texts} d JOIN (SELECT id, list_distinct(flatten(list(places))) AS mask FROM {matches} GROUP BY id) USING (id))"""


def rounds_sql(rules: Rules, source: str, rounds: int = 6) -> str:
    """WITH clause up to `done`: id, filtered, words (of all rounds, each once), first_word, first_level; changed texts only.

    source: a query of id and text."""
    parts = [f"d1 AS ({source})"]
    for k in range(1, rounds + 1):
        parts.append(candidates_sql(rules, k, f"d{k}"))
        parts.append(f"""
o{k} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s0, e0 DESC, ord, form, start) AS rn FROM x{k}),
g{k} AS (
  SELECT id, rn, true AS kept, e0 AS last FROM o{k} WHERE rn = 1
  UNION ALL
  SELECT o.id, o.rn, o.s0 >= g.last, CASE WHEN o.s0 >= g.last THEN o.e0 ELSE g.last END FROM g{k} g JOIN o{k} o ON o.id = g.id AND o.rn = g.rn + 1),
h{k} AS (SELECT o.id, o.rn, o.word, o.level, o.places FROM o{k} o JOIN g{k} g ON g.id = o.id AND g.rn = o.rn WHERE kept),
d{k + 1} AS ({masked_sql(f"d{k}", f"h{k}")})""")
    texts = " UNION ALL ".join(f"SELECT id, {k} AS k, text FROM d{k + 1}" for k in range(1, rounds + 1))
    found = " UNION ALL ".join(f"SELECT id, {k} AS k, rn, word, level FROM h{k}" for k in range(1, rounds + 1))
    parts.append(f"""
texts AS ({texts}),
found AS (SELECT id, word, level, min(k * 10000000 + rn) AS spot FROM ({found}) GROUP BY id, word, level),
done AS (
  SELECT id, filtered, words, first_word, first_level, found FROM (SELECT id, max_by(text, k) AS filtered FROM texts GROUP BY id)
  JOIN (SELECT id, string_agg(word, ', ' ORDER BY spot) AS words, min_by(word, spot) AS first_word, min_by(level, spot) AS first_level,
               list(word || '/' || level ORDER BY spot) AS found FROM found GROUP BY id) USING (id))""")
    return "WITH RECURSIVE " + ",".join(parts)


def flags_sql(rules: Rules, source: str) -> str:
    """WITH clause up to x1, the matches of the first round."""
    return f"WITH RECURSIVE d1 AS ({source}),{candidates_sql(rules, 1, 'd1')}"


# Tracking


def _common(text: str, target: str) -> str:
    """How many characters two texts begin with alike."""
    return f"coalesce(list_max(list_filter(range(1, length({target}) + 1), lambda i: length({text}) >= i AND left({text}, i) = left({target}, i))), 0)"


def _ends(text: str, word: str) -> str:
    """Length of the shortest end of the text that the word ends with too; null if there is none."""
    return f"list_min(list_filter(range(1, least(length({text}), {len(word)}) + 1), lambda i: right({text}, i) = right({q(word)}, i)))"


def tracked_sql(messages: str, word: str, level: str, gap: int, others: list[tuple[str, str]], raw: bool = False) -> str:
    """WITH clause up to `tracked`: user_id, seq, text, hit_word, hit_level, crossed, and masked, the text after the mask of a
    word that came over several messages.

    messages: a query of user_id, seq, ms, text, clear (ordered by ms, seq). One word is followed over messages, exactly;
    others (word, level) are only found within one, after it in the order of levels. raw: ends are cut as for commands.
    """
    low = "lower(m.text)"
    single = [f"CASE WHEN contains({low}, {q(w)}) THEN {q(w)} WHEN contains({low}, {q(w[::-1])}) THEN {q(w[::-1])} END" for w, _ in [(word, level), *others]]
    state = "{'place': %s, 'quiet': %s, 'after': %s, 'done': %s, 'seen': %s}"
    kind = "STRUCT(place BIGINT, quiet BIGINT, after BIGINT, done BOOLEAN, seen BIGINT)[]"
    ends = f"({_ends('shown', word)} IS NOT NULL)"
    common = _common("shown", f"substr({q(word)}, s.place + 1)")
    # A state after a message; hit says whether it reports the word, gone whether it ends.
    moved = f"""list_transform(states, lambda s: CASE
      WHEN s.done THEN {{'s': {state % ('s.place', 's.quiet', 's.after + 1', 'true', 'ms')}, 'hit': s.after + 1 <= {gap} AND (one IS NOT NULL OR {ends}), 'gone': s.after + 1 > {gap}}}
      WHEN {common} > 0 THEN {{'s': {state % (f's.place + {common}', '0', 's.after', f's.place + {common} >= {len(word)}', 'ms')}, 'hit': s.place + {common} >= {len(word)}, 'gone': false}}
      ELSE {{'s': {state % ('s.place', 's.quiet + 1', 's.after', 'false', 'ms')}, 'hit': false, 'gone': s.quiet + 1 > {gap}}} END)"""
    first = q(word[0])
    opened = _common("substr(shown, instr(shown, " + first + "))", q(word))
    names = "coalesce(" + ", ".join(["one", *[f"other{i}" for i in range(len(others))]]) + ")"
    levels = "CASE WHEN one IS NOT NULL THEN " + q(level) + "".join(f" WHEN other{i} IS NOT NULL THEN {q(lv)}" for i, (_, lv) in enumerate(others)) + " END"
    alive = lambda x: f"list_filter({x}, lambda s: ms - s.seen <= 60000)"
    tail = _ends("lower(text)", word)
    cut = f"left(text, length(text) - {tail}) || repeat('*', {tail})"
    extra = ", ".join(f"{x} AS other{i}" for i, x in enumerate(single[1:]))
    return f"""
WITH RECURSIVE messages AS ({messages}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, seq) AS rn FROM messages),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS {kind}) AS states, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS hit_word, CAST(NULL AS VARCHAR) AS hit_level, false AS crossed
  FROM (SELECT DISTINCT user_id FROM messages)
  UNION ALL
  SELECT user_id, rn, CAST(CASE WHEN clear THEN [] WHEN coalesce(text, '') = '' THEN {alive('states')}
      ELSE {alive("list_concat(left_over, CASE WHEN any_hit OR instr(shown, " + first + ") = 0 THEN [] ELSE [" + state % (opened, '0', '0', 'false', 'ms') + "] END)")} END AS {kind}),
    seq, text,
    CASE WHEN clear OR coalesce(text, '') = '' THEN NULL WHEN alone IS NOT NULL THEN alone WHEN any_hit THEN crossed_word END,
    CASE WHEN clear OR coalesce(text, '') = '' THEN NULL WHEN alone IS NOT NULL THEN alone_level WHEN any_hit THEN {q(level)} END,
    NOT clear AND coalesce(text, '') <> '' AND alone IS NULL AND any_hit
  FROM (
    SELECT *, alone IS NOT NULL OR len(list_filter(moved, lambda x: x.hit)) > 0 AS any_hit, list_transform(list_filter(moved, lambda x: NOT x.gone), lambda x: x.s) AS left_over, {q(word)} AS crossed_word
    FROM (
      SELECT *, {names} AS alone, {levels} AS alone_level, {moved} AS moved
      FROM (SELECT w.user_id, m.rn, w.states, m.seq, m.text, m.ms, m.clear, {low} AS shown, {single[0]} AS one{', ' + extra if extra else ''} FROM walk w JOIN numbered m ON m.user_id = w.user_id AND m.rn = w.rn + 1)))),
tracked AS (
  SELECT user_id, seq, text, hit_word, hit_level, crossed,
         CASE WHEN crossed AND {tail} IS NOT NULL THEN {cut} ELSE text END AS masked
  FROM walk WHERE rn > 0)"""


def exact_sql(text: str, words: list[str]) -> str:
    """The text with words masked where they stand, each before the next ones; for words that do not overlap in it."""
    for w in words:
        text = f"regexp_replace({text}, {q(w)}, {q('*' * len(w))}, 'gi')"
    return text
