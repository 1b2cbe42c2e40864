"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

Every query runs over its whole table and whole texts and returns values, and each has SQL. Where the tables hold nothing that
an operator looks for, words, markup or commands are put into the texts first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..config import Engine, from_dict, load
from ..functions.charmap import CharMap, parse_charmap
from ..functions.markup import first_plain_colon, parse, split_tags, styled_runs, visible
from ..functions.matching import GapLimits, Text, candidates, contains_word, mask_raw_suffix, mask_suffix, normalize_each, normalize_whole, reverse_word, select
from ..functions.units import from_units, to_units
from ..operators import alerts, detect, parts, route, track
from ..sources import messages as sources
from ..sources import sinks
from . import demo

WORDS = [(level, w) for level, ws in demo.LEXICON.items() for w in ws]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return detect.spread(_t(spark, d, "documents").select("doc_id", "text", "source", "lang"))


def _md5(text):
    return F.md5(text.cast("binary"))


def _places(words, *extra):
    """Arrays of struct<start, end, word, ...> of the occurrences of each word; extra: constants by word."""

    def one(i, w):
        more = [F.lit(values[i]).alias(name) for name, values in extra]
        return F.transform(C.positions("text", w), lambda p: F.struct(p.cast("bigint").alias("start"), (p + len(w)).cast("bigint").alias("end"), F.lit(w).alias("word"), *more))

    return F.concat(*[one(i, w) for i, w in enumerate(words)])


def _windows(text, words, limits):
    """Array of struct<word, window> of the gap matches of each word."""

    def one(w):
        return F.transform(C.gap_matches(text, w, limits), lambda m: F.struct(F.lit(w).alias("word"), m.alias("window")))

    return F.concat(*[one(w) for w in words])


def flagship(spark, d) -> DataFrame:
    """Documents with words of the lexicon: how many words, the first one found, and the text without them."""
    docs = _docs(spark, d)
    out = F.col("text")
    hits = [F.when(C.contains_exact("text", w), F.lit(w)) for _, w in WORDS]
    for _, w in WORDS:
        out = C.mask_exact(out, w)
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return docs.select("doc_id", "text", found.alias("found")).where(F.size("found") > 0).select("doc_id", F.size("found").cast("bigint").alias("n_hits"), F.get("found", F.lit(0)).alias("first_word"), out.alias("filtered_text"))


def exact_flag(spark, d):
    return detect.words_in(_docs(spark, d), demo.CONFIG, "doc_id")


def exact_count_by_level(spark, d):
    hits = exact_flag(spark, d)
    return hits.groupBy("level").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_hits"))


def exact_positions(spark, d):
    x = _docs(spark, d).select("doc_id", F.explode(_places([w for _, w in WORDS])).alias("x"))
    return x.select("doc_id", "x.word", F.col("x.start").alias("pos"))


GAP = GapLimits(1, 1, 1)


def fuzzy_flag(spark, d):
    docs = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    hit = [F.when(F.size(C.gap_matches("t", w, GAP)) > 0, F.lit(w)) for _, w in WORDS]
    return docs.select("doc_id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("word"))


def fuzzy_gap_classes(spark, d):
    docs = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    x = docs.select("doc_id", F.explode(_windows("t", [w for _, w in WORDS], GAP)).alias("x"))
    n = C.class_counts("x.window")
    rows = x.select(F.col("x.word").alias("word"), (n["english"] - F.length("x.word")).alias("english"), n["others"].alias("others"))
    return rows.groupBy("word", "english", "others").agg(F.count("*").alias("n"))


def compressed_flag(spark, d):
    """Words with gaps, as the text stands or with repeats taken together."""
    docs = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    hit = [F.when(C.contains_gap("t", w, GAP), F.lit(w)) for _, w in WORDS]
    return docs.select("doc_id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("word"))


def reverse_flag(spark, d):
    docs = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    hit = [F.when(F.contains("t", F.reverse(F.lit(w))), F.reverse(F.lit(w))) for w in ("the", "tion", "and", *[w for _, w in WORDS])]
    return docs.select("doc_id", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("word"))


def _spans(docs, words, key="doc_id"):
    return docs.select(key, F.explode(_places(words)).alias("x")).select(key, "x.start", "x.end", "x.word")


def allowlist_anti(spark, d):
    docs = _docs(spark, d)
    return detect.drop_allowed(_spans(docs, ["the", "ing"]), _spans(docs, ["there", "thing"]), "doc_id").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def nonoverlap_select(spark, d):
    docs = _docs(spark, d)
    words = ["than", "thanan", "hana", "idiot", "trash"]
    kept = docs.select("doc_id", F.explode(detect.select_spans(_places(words))).alias("x"))
    return kept.select("doc_id", "x.start", "x.end")


def strip_codes(spark, d):
    """Codes are put into the texts first: the tables have none."""
    coded = F.concat(F.lit("&a"), F.regexp_replace("text", " the ", " &cthe§r "), F.lit("&x&1&2&3&4&5&6&#abc<#12ab9f>&x"))
    return _docs(spark, d).select("doc_id", F.md5(C.strip_codes(coded).cast("binary")).alias("shown_md5"))


def canonical_hex(spark, d):
    coded = F.concat(F.regexp_replace("text", " the ", " &#12aB9fthe&#abc "), F.lit("&x&1&2&3&4&5&6"))
    return _docs(spark, d).select("doc_id", F.md5(C.canonical_hex(coded).cast("binary")).alias("coded_md5"))


def strip_tags(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(C.strip_tags("html").cast("binary")).alias("stripped_md5"))


def strip_everything(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(C.strip_everything("html").cast("binary")).alias("stripped_md5"))


def any_tags(spark, d):
    tags = C.any_tags("html")
    return _t(spark, d, "pages").select("page_id", F.size(tags).cast("bigint").alias("n_tags"), _md5(F.array_join(tags, "\n")).alias("tags_md5"))


def charmap_fold(spark, d):
    charmap = CharMap(dict(zip(demo.FOLD_FROM, demo.FOLD_TO)))
    return _docs(spark, d).select("doc_id", F.md5(C.fold(F.lower("text"), charmap).cast("binary")).alias("folded_md5"))


def class_counts(spark, d):
    n = C.class_counts("text")
    return _docs(spark, d).select("doc_id", *[n[k].cast("bigint").alias(k) for k in ("chinese", "english", "others")])


def compress_text(spark, d):
    return _docs(spark, d).select("doc_id", _md5(C.compress("text")).alias("compressed_md5"), _md5(F.reverse("text")).alias("reversed_md5"))


def redact_exact(spark, d):
    docs = _docs(spark, d)
    out = F.col("text")
    for _, w in WORDS:
        out = C.mask_exact(out, w)
    return docs.select("doc_id", "text", out.alias("filtered")).where("filtered <> text").select("doc_id", "filtered")


def detected_agg(spark, d):
    hits = [F.when(C.contains_exact("text", w), F.struct(F.lit(w).alias("word"), F.lit(level).alias("level"))) for level, w in WORDS]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    rows = _docs(spark, d).select("doc_id", found.alias("f")).where(F.size("f") > 0)
    return rows.select("doc_id", F.size("f").cast("bigint").alias("n_words"), alerts.words_of(F.col("f")).alias("words"))


def first_detection(spark, d):
    each = _places([w for _, w in WORDS], ("level", [level for level, _ in WORDS]))
    rows = _docs(spark, d).select("doc_id", F.array_min(each).alias("x")).where("x is not null")
    return rows.select("doc_id", F.col("x.start").alias("pos"), "x.word", "x.level")


def limits_default_join(spark, d):
    lexicon, limits = demo.CONFIG.lexicon(spark), demo.CONFIG.limits_table(spark)
    j = lexicon.join(F.broadcast(limits), "level", "left")
    gap = lambda k: F.coalesce(f"gap.{k}", F.lit(2)).cast("bigint").alias(k)
    return j.select("level", "word", gap("chinese"), gap("english"), gap("others"))


def lexicon_size(spark, d):
    return demo.CONFIG.lexicon(spark).agg(F.count("*").alias("n_words"))


def _commands(spark, d):
    """Turns as commands: which one follows from the turn and the role."""
    c = _t(spark, d, "conversations")
    names = F.array(*[F.lit(x) for x in [*demo.COMMANDS, "!", "/msgx"]])
    which = F.get(names, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)).cast("int"))
    text = F.when(which == "!", F.concat(which, F.col("text"))).otherwise(F.concat(F.when(F.col("turn") % 2 == 0, F.upper(which)).otherwise(which), F.lit(" "), F.col("role"), F.lit(" "), F.col("text")))
    return c.select("conv_id", "turn", text.alias("text"))


def route_commands(spark, d):
    return _commands(spark, d).withColumn("route", route.route_name("text", demo.CONFIG)).groupBy("route").agg(F.count("*").alias("n"))


def extract_args(spark, d):
    return route.route_messages(_commands(spark, d), demo.CONFIG).select("conv_id", "turn", "route", "checked")


def rebuild_command(spark, d):
    routed = route.route_messages(_commands(spark, d), demo.CONFIG).withColumn("filtered", F.regexp_replace("checked", "(?i)the", "***"))
    return route.rebuild_messages(routed, demo.CONFIG).select("conv_id", "turn", "rebuilt")


def _pages_of(spark, d):
    return parts.collect_parts(_t(spark, d, "conversations"), "conv_id", "turn")


def combine_parts(spark, d):
    p = _pages_of(spark, d)
    return p.select("conv_id", parts.combine("parts").alias("whole"), F.array_join(F.transform(parts.starts(F.col("parts")), lambda x: x.cast("string")), ",").alias("starts"))


def split_parts(spark, d):
    p = _pages_of(spark, d).withColumn("filtered", F.regexp_replace(parts.combine("parts"), "[tT]he", "***"))
    pieces = parts.split(F.col("filtered"), parts.starts(F.col("parts")), F.size("parts"))
    return p.select("conv_id", F.posexplode(pieces).alias("part_no", "part")).select("conv_id", F.col("part_no").cast("bigint").alias("part_no"), "part")


def merge_detections(spark, d):
    """Per conversation: the words of its first turn before those of all turns, each once, and the words of all turns as they come."""
    words = ("thing", "then", "than", "this")
    found = lambda text: F.filter(F.array(*[F.when(C.contains_exact(text, w), F.struct(F.lit(w).alias("word"), F.lit("l").alias("level"))) for w in words]), lambda x: x.isNotNull())
    p = _pages_of(spark, d).select("conv_id", found(F.get("parts", F.lit(0))).alias("title"), F.flatten(F.transform("parts", lambda t: F.coalesce(found(t), F.array().cast("array<struct<word:string,level:string>>")))).alias("pages"))
    merged = alerts.merge_detections(F.get(F.coalesce("title", "pages"), F.lit(0)), F.col("pages"))
    return p.select("conv_id", alerts.words_of(merged).alias("merged"), alerts.words_of(F.col("pages")).alias("every"))


def suffix_mask(spark, d):
    c = _t(spark, d, "conversations").where(F.col("text").isNotNull() & (F.col("text") != ""))
    n = C.shortest_common_suffix("text", F.lit("anything"))
    masked = F.when(n.isNull(), F.col("text")).otherwise(F.concat(F.left("text", F.length("text") - n), F.repeat(F.lit("*"), n)))
    return c.select("conv_id", "turn", masked.alias("masked"))


def _violations(spark, d):
    return _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("level"))


def escalation(spark, d):
    """An interval of a day: in the sparse test table the default of 15 seconds never holds three events."""
    out = alerts.escalate(_violations(spark, d), demo.CONFIG.punish_table(spark), 86400, ("ts", "event_id"))
    return out.select("event_id", "user_id", "level", F.col("number").cast("bigint").alias("number"), "command")


def punish_actions(spark, d):
    """Each day's events within its first minute, so that intervals of 15 seconds hold several."""
    close = _violations(spark, d).withColumn("ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 86400) * 86400 + F.col("event_id") % 60))
    out = alerts.escalate(close, demo.CONFIG.punish_table(spark), demo.CONFIG.profile.sweep_seconds, ("ts", "event_id"))
    return out.select("event_id", "user_id", "level", F.col("number").cast("bigint").alias("number"), "command")


def violation_numbers(spark, d):
    out = alerts.violation_numbers(_violations(spark, d), 86400, ("ts", "event_id"))
    return out.select("event_id", "level", F.col("number").cast("bigint").alias("number"))


def violation_resets(spark, d):
    """Every tenth event starts its user's counters anew."""
    out = alerts.violation_numbers(_violations(spark, d).withColumn("clear", F.col("event_id") % 10 == 0), 86400, ("ts", "event_id"), reset="clear")
    return out.select("event_id", "level", F.col("number").cast("bigint").alias("number"))


def _hits(spark, d):
    """Documents with a word as violations: first word and level, source as context, doc_id as player."""
    hits = [F.when(C.contains_exact("text", w), F.struct(F.lit(w).alias("word"), F.lit(level).alias("level"))) for level, w in WORDS]
    rows = _docs(spark, d).select("doc_id", "source", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("detected")).where(F.size("detected") > 0)
    return rows.select(F.col("doc_id").alias("msg_id"), F.col("doc_id").cast("string").alias("user_id"), F.concat(F.lit("p"), "doc_id").alias("user_name"), alerts.context_name(demo.CONTEXTS, "source").alias("context"), alerts.first_of(F.col("detected"), "level").alias("first_level"), "detected")


def render_alert(spark, d):
    return alerts.admin_texts(_hits(spark, d), demo.CATALOG)


def player_warning(spark, d):
    return alerts.player_alerts(_hits(spark, d), demo.CATALOG)


def admin_fanout(spark, d):
    admins = _t(spark, d, "nation").select(F.col("n_name").alias("user_id"))
    return alerts.admin_alerts(_hits(spark, d), demo.CATALOG, admins)


def context_fallback(spark, d):
    return _docs(spark, d).groupBy(alerts.context_name(demo.CONTEXTS, "source").alias("context")).agg(F.count("*").alias("n"))


def permission_filter(spark, d):
    """Grants: customers of one segment are administrators, users of events the messages."""
    grants = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("user_id"), F.lit("admin").alias("permission"))
    v = _violations(spark, d)
    return route.has_permission(v, grants, "admin").select("event_id", F.lit(True).alias("admin")).union(route.has_permission(v, grants, "admin", without=True).select("event_id", F.lit(False)))


# Queries of the kernel.


def redact_fuzzy(spark, d):
    """The whole redaction: gaps, repeats, reversed words, allow-list, masks, and rounds until nothing changes."""
    out = detect.redact_messages(_docs(spark, d), demo.CONFIG)
    return out.where("changed").select("doc_id", "filtered", alerts.words_of(F.col("detected")).alias("words"), "first_word", "first_level")


def redact_pass(spark, d):
    out = detect.redact_messages(_docs(spark, d), demo.CONFIG, recheck=False)
    return out.where("changed").select("doc_id", "filtered")


def rewritten_messages(spark, d):
    out = sinks.rewritten(detect.redact_messages(_docs(spark, d), demo.CONFIG), "doc_id")
    return out.select("doc_id", _md5(F.col("old_text")).alias("old_md5"), "new_text")


def refilter_stored(spark, d):
    """A deferred second pass over documents that are stored as they came."""
    out = sinks.refilter(_docs(spark, d).withColumnRenamed("text", "stored"), lambda s: detect.redact_messages(s, demo.CONFIG, "stored"))
    return out.select("doc_id", "filtered", F.size("detected").cast("bigint").alias("n_words"))


def detected_long(spark, d):
    out = detect.detections_long(detect.redact_messages(_docs(spark, d), demo.CONFIG).where("changed"), "doc_id")
    return out.select("doc_id", "word", "level", F.col("place").cast("bigint").alias("place"))


def contains_any(spark, d):
    return detect.flagged(_docs(spark, d), demo.CONFIG).select("doc_id")


def candidate_union(spark, d):
    """All matches before any is chosen: words and reversed ones, as the text stands and with repeats taken together."""
    rules = demo.CONFIG.rules()

    def rows(text):
        return [{"start": m.start, "end": m.end, "word": m.word, "level": m.level} for m in candidates(Text(normalize_each(text, rules.charmap)[0], rules.allow), rules)]

    found = _scalar(rows, "array<struct<start:bigint,end:bigint,word:string,level:string>>")
    docs = _docs(spark, d).where(detect.may_match("text", rules))
    return docs.select("doc_id", F.explode(found("text")).alias("x")).select("doc_id", "x.*")


def chosen_matches(spark, d):
    """The matches of the first round that do not overlap, with the places they mask."""
    rules = demo.CONFIG.rules()

    def rows(text):
        chosen = select(candidates(Text(normalize_each(text, rules.charmap)[0], rules.allow), rules))
        return [{"start": m.start, "word": m.word, "places": ",".join(map(str, m.places))} for m in chosen]

    found = _scalar(rows, "array<struct<start:bigint,word:string,places:string>>")
    docs = _docs(spark, d).where(detect.may_match("text", rules))
    return docs.select("doc_id", F.explode(found("text")).alias("x")).select("doc_id", "x.*")


def contains_one(spark, d):
    hits = [F.when(_scalar(lambda x, w=w: contains_word(x, w, GAP, allow=("trashy",)), "boolean")("text"), F.lit(w)) for w in ("trash", "idiot")]
    return _docs(spark, d).select("doc_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("word"))


def redact_one_word(spark, d):
    out = detect.redact_one_word(_docs(spark, d), "trash", limits=GAP)
    return out.where("filtered <> text").select("doc_id", "filtered")


def wide_words(spark, d):
    """Words outside the basic plane: each of their characters is two units, and is masked by two signs."""
    config = from_dict({"banned-words": {"level-1": ["😀x", "😈😈"]}, "fuzzy-match": {"enable": True, "levels": {"level-1": {"max-char-gap": 0}}}, "reverse-match": {"enable": False}})
    text = F.concat(F.lit("a 😀x "), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.lit(" 𝒴😀xx")).otherwise(F.lit("")))
    out = detect.redact_messages(_docs(spark, d).select("doc_id", text.alias("text")), config)
    return out.select("doc_id", _md5(F.col("filtered")).alias("filtered_md5"), alerts.words_of(F.col("detected")).alias("words"))


def markup_detect(spark, d):
    """Pages with two words put before them in tags: what the tags show is found and masked inside them."""
    p = _t(spark, d, "pages").select("page_id", F.concat(F.lit("<hover:show_text:'<red>tra"), F.lit("sh'><lang:k:'<blue>id&ciot'> "), F.col("html")).alias("text"))
    out = detect.redact_messages(p, demo.CONFIG)
    return out.select("page_id", "changed", _md5(F.col("filtered")).alias("filtered_md5"), alerts.words_of(F.col("detected")).alias("words"))


def _scalar(fn, kind="string"):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in s])

    return run


def _tipped(spark, d):
    return _t(spark, d, "pages").select("page_id", F.concat(F.lit(TIP), F.col("html")).alias("html"))


TIP = "<hover:show_text:'<red>tip'>"


def visible_text(spark, d):
    show = _scalar(lambda x: from_units(visible(to_units(x))))
    return _tipped(spark, d).select("page_id", _md5(show("html")).alias("shown_md5"))


def _quotable(spark, d):
    """Turns with what has a meaning in tags taken out."""
    return _t(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), r"""[<>'"\\&§:]""", "").alias("t"))


PAYLOADS = ("<hover:show_text:'<red>", "</red>'>one<click:run_command:'/x ", "'>two<insert:", "><lang:key:'", "':'b ", "'></hover><hover:show_item:'no'><!b>")


def tag_payloads(spark, d):
    """Texts in every kind of tag that shows one."""
    show = _scalar(lambda x: from_units(visible(to_units(x))))
    whole = [x for p in PAYLOADS for x in (F.lit(p), F.col("t"))][:-1]
    return _quotable(spark, d).select("conv_id", "turn", show(F.concat(*whole)).alias("shown"))


def tag_tokens(spark, d):
    """Pages as tags and what is between them."""
    tokens = _scalar(lambda x: [{"token": from_units(p), "tag": t} for p, t in split_tags(to_units(x))], "array<struct<token:string,tag:boolean>>")
    x = _t(spark, d, "pages").select("page_id", F.posexplode(tokens("html")).alias("place", "x"))
    return x.select("page_id", F.col("place").cast("bigint").alias("place"), _md5(F.col("x.token")).alias("token_md5"), "x.tag")


def plain_colons(spark, d):
    """The first colon outside quotes."""
    at = _scalar(lambda x: first_plain_colon(to_units(x)), "bigint")
    return _quotable(spark, d).select("conv_id", "turn", at(F.concat(F.lit("'a:b\\':"), F.col("t"), F.lit("' \"c:\""), F.when(F.col("turn") % 2 == 0, F.lit(":")).otherwise(F.lit("")), F.col("t"))).alias("at"))


def normalize_text(spark, d):
    """Plain ASCII only needs lower case; other texts go to the kernel."""
    norm = _scalar(lambda x: from_units(normalize_whole(x)))
    plain = F.col("text").rlike(r"\A[\x00-\x25\x27-\x3B\x3D-\x7F]*\z")
    return _docs(spark, d).select("doc_id", _md5(F.when(plain, F.lower("text")).otherwise(norm.asNondeterministic()(F.when(~plain, F.col("text"))))).alias("normal_md5"))


def normalize_letters(spark, d):
    """Character by character, with a map, and how long the list of places is."""
    charmap = CharMap(dict(zip(demo.FOLD_FROM, demo.FOLD_TO)))
    norm = _scalar(lambda x: from_units(normalize_each(to_units(x), charmap)[0]))
    size = _scalar(lambda x: len(normalize_each(to_units(x), charmap)[1]), "bigint")
    return _docs(spark, d).select("doc_id", _md5(norm("text")).alias("normal_md5"), size("text").alias("n_places"))


def position_map(spark, d):
    """Runs of places in the raw text behind what is shown, as start+length."""

    def runs(x):
        at = parse(to_units(x)).at
        edges = [i for i in range(len(at)) if not i or at[i] != at[i - 1] + 1] + [len(at)]
        return " ".join(f"{at[a]}+{b - a}" for a, b in zip(edges, edges[1:]))

    return _tipped(spark, d).select("page_id", _md5(_scalar(runs)("html")).alias("places_md5"))


def mask_ranges(spark, d):
    """Ranges of what is shown, replaced in the raw text."""

    def masked(x):
        marked = parse(to_units(x))
        return from_units(marked.masked_ranges([(0, 3), (len(marked.shown) - 4, len(marked.shown))], "#"))

    return _quotable(spark, d).select("conv_id", "turn", _scalar(masked)(F.concat(F.lit("<b>a&cbc</b>"), F.col("t"), F.lit("w<red>x&ayz"))).alias("masked"))


def spread_hex(spark, d):
    coded = F.concat(F.regexp_replace("text", " the ", " &x&1&2&a&B&9&fthe&#abc "), F.lit("&x&1&2&3&4&5&g"))
    return _docs(spark, d).select("doc_id", _md5(C.spread_hex(coded)).alias("coded_md5"))


STYLED = "<red>one<bold>two</bold>three§9four§lfive§zsix<i>seven</red>"


def styled_text(spark, d):
    """Runs of one style: the style and the text of each."""
    runs = _scalar(lambda x: "\n".join(f"{style}|{from_units(text)}" for text, style in styled_runs(to_units(x))))
    return _t(spark, d, "pages").select("page_id", _md5(runs(F.concat(F.lit(STYLED), F.col("html")))).alias("runs_md5"))


def suffix_mask_kernel(spark, d):
    """The end of a message, and of a command as it was typed, that a word ends with too."""
    shown, raw = _scalar(lambda x: mask_suffix(x, "anything")), _scalar(lambda x: mask_raw_suffix(x, "anything"))
    c = _t(spark, d, "conversations").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return c.select("conv_id", "turn", shown(F.concat("text", F.lit("<b>"))).alias("masked"), raw(F.concat("text", F.lit("<b>"))).alias("cut"))


def config_tables(spark, d):
    """A configuration written to a file, read again, as the tables that joins use."""
    import json
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "config", "engine.yml")
        first = load(path, defaults=demo.SETTINGS)  # there is no file yet: the defaults are written
        engine = Engine(path=path)
        assert json.dumps(engine.reload().words) == json.dumps(first.words)
    c, info = engine.config, engine.info()
    lexicon = c.lexicon(spark).select(F.lit("word").alias("kind"), F.col("level").alias("name"), F.col("word").alias("value"), (F.col("level_ord") * 100 + F.col("word_ord")).cast("bigint").alias("ord"))
    routes = c.routes_table(spark).select(F.lit("route"), "name", F.concat_ws("|", F.array_join(F.transform("args", lambda a: a.cast("string")), ","), F.array_join("commands", ","), F.array_join("prefixes", ",")), F.col("ord").cast("bigint"))
    punish = c.punish_table(spark).select(F.lit("punish"), "level", "command", (F.col("threshold") * 100 + F.col("cmd_ord")).cast("bigint"))
    allow = c.allow_table(spark).select(F.lit("allow"), "word", "word", F.lit(0).cast("bigint"))
    counts = spark.createDataFrame([("info", k, str(info[k]), 0) for k in ("words", "levels", "routes")] + [("missing", x, x, 0) for x in engine.missing(["a", "c"], ["b", "c", "a", "d"])], "kind string, name string, value string, ord bigint")
    return lexicon.union(routes).union(punish).union(allow).union(counts)


def reversed_spellings(spark, d):
    """Words that are also looked for backwards, by the flags of their levels."""
    c = from_dict({"banned-words": demo.LEXICON, "reverse-match": {"enable": True, "levels": {"level-2": False}}})
    rows = [(level, w, reverse_word(w) if c.reversed_too(level) else None) for level, ws in c.words.items() for w in ws]
    return spark.createDataFrame(rows, "level string, word string, reversed string")


def catalog_rows(spark, d):
    nested = {"warnings": {"player-warning": "p", "admin-warning": "a"}, "levels": {"level-1": {"player-warning": "l"}}, "top": 3}
    return sources.read_catalog(spark, nested, "en").union(sources.read_catalog(spark, {}, "de", {"fallback": {"x": "y"}}))


def charmap_tables(spark, d):
    """Look-alike characters from tables of variants; which of them count as Chinese or English."""
    charmap = parse_charmap([("english", ["序号,基准", *[f"{i},{b},{a}/{a.upper()}" for i, (a, b) in enumerate(zip(demo.FOLD_FROM, demo.FOLD_TO))]]), ("chinese", ["1,x,ß"])])
    kind = _scalar(lambda x: "".join(str(charmap.classify(c)) for c in x))
    return _docs(spark, d).select("doc_id", _md5(C.fold("text", charmap)).alias("folded_md5"), _md5(kind("text")).alias("kinds_md5"))


def _chat(spark, d):
    """Turns as chat, with the two halves of a word put before every fourth turn and the one after it."""
    half = F.when(F.col("seq") % 4 == 0, F.lit("th ")).when(F.col("seq") % 4 == 1, F.lit("ing ")).otherwise(F.lit(""))
    return sources.conversations_as_chat(_t(spark, d, "conversations")).withColumn("text", F.concat(half, "text"))


HIT = ("user_id", "seq", "hit_word", "hit_level", "crossed", "filtered")


def cross_message(spark, d):
    out = track.track_messages(_chat(spark, d), demo.CHAT)
    return out.where("hit_word is not null").select(*HIT)


def cross_message_idle(spark, d):
    """Turns 25 seconds apart, every third one two minutes late: states go when they have been idle for a minute."""
    late = F.timestamp_seconds(F.col("seq") * 25 + F.floor(F.col("seq") / 3) * 120)
    out = track.track_messages(_chat(spark, d).withColumn("ts", late), demo.CHAT)
    return out.where("hit_word is not null").select(*HIT)


def cross_message_reset(spark, d):
    """Every fourth turn is a violation elsewhere, which clears its user's states."""
    out = track.track_messages(_chat(spark, d).withColumn("clear", F.col("seq") % 4 == 2), demo.CHAT, reset="clear")
    return out.select(*HIT)


def cross_message_commands(spark, d):
    """As commands: a word that came over several of them is cut off the raw text."""
    out = track.track_messages(_chat(spark, d), demo.CHAT, commands=True)
    return out.where("crossed").select(*HIT)


def cross_message_nobody(spark, d):
    """Messages without a user have no states."""
    out = track.track_messages(_chat(spark, d).withColumn("user_id", F.when(F.col("seq") % 2 == 0, F.col("user_id"))), demo.CHAT)
    return out.where("hit_word is not null").select("seq", *HIT[2:])


def shout_api(spark, d):
    """Conversations of users that are online (those with a customer of their number) are tracked, others only redacted."""
    online = _t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("user_id"))
    out = track.shout_messages(_chat(spark, d), online, demo.CHAT)
    return out.select("user_id", "seq", "filtered", "hit_word", "crossed")


def violation_counts(spark, d):
    out = alerts.violation_counts(_violations(spark, d), 86400)
    return out.select("user_id", "level", F.date_format("bucket", "yyyy-MM-dd").alias("day"), "n")


def _broken(spark, d):
    """Conversations as parts, with a word put across the ends of even turns and the beginnings of odd ones."""
    c = _t(spark, d, "conversations")
    text = F.concat(F.when(F.col("turn") % 2 == 1, F.lit("sh ")).otherwise(F.lit("")), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.lit(" tra")).otherwise(F.lit("")))
    return parts.collect_parts(c.select("conv_id", "turn", text.alias("text")), "conv_id", "turn")


def signs(spark, d):
    """Conversations as signs: lines one by one and combined."""
    return parts.redact_signs(_broken(spark, d), demo.CONFIG).select("conv_id", F.array_join("lines", "\n").alias("lines"), "changed", alerts.words_of(F.col("detected")).alias("words"))


def books(spark, d):
    """Conversations as books, the first turn as title too."""
    p = _broken(spark, d).withColumn("title", F.concat(F.get("parts", F.lit(0)), F.lit(" id.iot"))).withColumn("author", F.when(F.col("conv_id") % 2 == 0, F.lit("clown")))
    out = parts.redact_books(p, demo.CONFIG)
    sizes = F.array_join(F.transform("pages", lambda p: F.length(p).cast("string")), ",")
    return out.select("conv_id", F.array_join("pages", "\n").alias("pages"), sizes.alias("sizes"), "new_title", "new_author", "changed", "first_word", alerts.words_of(F.col("detected")).alias("words"))


def item_names(spark, d):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, F.lit(" i.d.iot hsart")).otherwise(F.lit("")))
    names = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("user_id"), (F.col("p_partkey") % 10 == 0).alias("bypass"), name.alias("name"))
    return parts.redact_names(names, demo.CONFIG).select("user_id", "name", "filtered", "changed")


def sql_redact(spark, d):
    """The SQL functions over the benchmark's texts, with words put into some."""
    from ..operators import sqlfunctions

    sqlfunctions.register(spark, demo.CONFIG)
    b = _t(spark, d, "benchmark").select("item_id", F.concat("text", F.when(F.col("item_id") % 3 == 0, F.lit(" you id iot, nwolc!")).otherwise(F.lit(""))).alias("t"))
    return b.selectExpr("item_id", "redact(t) AS filtered", "contains_banned(t) AS banned", "redact_word(t, 'you') AS without_you", "get(detect(t).detected, 0).word AS first_word")


def chat_union(spark, d):
    """All surfaces in one shape."""
    chat = sources.conversations_as_chat(_t(spark, d, "conversations"))
    shout = sources.as_messages(_t(spark, d, "benchmark"), "shout", msg_id="item_id", text="text", user_id=F.lit("shouter"))
    item = sources.as_messages(_t(spark, d, "part"), "anvil", msg_id="p_partkey", text="p_name")
    return sources.union(chat, shout, item).select("surface", "user_id", "user_name", "text", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce(F.unix_seconds("ts"), F.lit(-1)).alias("at"))


QUERIES = (
    flagship, exact_flag, exact_count_by_level, exact_positions, fuzzy_flag, fuzzy_gap_classes, compressed_flag, reverse_flag, allowlist_anti, nonoverlap_select, strip_codes, canonical_hex, strip_tags,
    strip_everything, any_tags, charmap_fold, class_counts, compress_text, redact_exact, detected_agg, first_detection, limits_default_join, lexicon_size, route_commands, extract_args,
    rebuild_command, combine_parts, split_parts, merge_detections, suffix_mask, escalation, punish_actions, violation_numbers, violation_resets, violation_counts, render_alert, player_warning, admin_fanout,
    context_fallback, permission_filter, chat_union, redact_fuzzy, redact_pass, rewritten_messages, refilter_stored, detected_long, contains_any, candidate_union, chosen_matches, contains_one,
    redact_one_word, wide_words, markup_detect, visible_text, tag_payloads, tag_tokens, plain_colons, normalize_text, normalize_letters, position_map, mask_ranges, spread_hex, styled_text,
    suffix_mask_kernel, config_tables, reversed_spellings, catalog_rows, charmap_tables, cross_message, cross_message_idle, cross_message_reset, cross_message_commands, cross_message_nobody,
    shout_api, signs, books, item_names, sql_redact,
)


def queries():
    return {"flagship_redact" if f is flagship else f.__name__: f for f in QUERIES}


def oracle_sql():
    from .oracle import SQL

    return dict(SQL)
