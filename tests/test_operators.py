"""Operators on small tables: detection against the kernel, routing, parts, tracking, alerts, SQL functions, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.config import from_dict
from wardline.functions import columns as C
from wardline.functions.matching import GapLimits, contains_word, redact
from wardline.operators import alerts, detect, parts, route, sqlfunctions, track
from wardline.plans import demo
from wardline.sources import messages, sinks
from wardline.streaming import tracker

CHAT = from_dict(
    {
        "banned-words": {"level-1": ["fuck"]},
        "fuzzy-match": {"levels": {"level-1": {"max-char-gap": {"chinese": 3, "english": 0, "others": 3}, "max-chatbox-gap": 3}}},
        "external-plugins": {
            "msg": {"args-number": 2, "extend-to-end": True, "commands": ["/msg", "/w"]},
            "say": {"args-number": "1,3", "commands": ["/say"]},
            "all": {"commands": ["/all"]},
            "hh": {"args-number": 1, "extend-to-end": True, "commands": ["/hh"], "prefixes": ["!"]},
        },
        "punish-commands": {"levels": {"level-1": {3: ["mute %player%", "say x"], 5: ["ban %player%"]}}},
    }
)


def chat(spark, rows):
    data = [(i, u, t, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, (u, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "msg_id long, user_id string, text string, seq long, ts timestamp")


def test_redact_messages_equals_kernel(spark):
    rng = random.Random(6)
    texts = ["fuck", None, "", "f.u.c.k", "hello", "&cfu<b>ck</b>", "ｆｕｃｋ", "kcuf 😀", "fffuck", "f" * 2000, "FÜCK", "ªfuck", "fu\u00a0ck", "f中uck", "f中中中中uck"]
    texts += ["".join(rng.choice("fuckFUCK.éß«-\n  ") for _ in range(rng.choice([6, 15, 60]))) for _ in range(400)]
    df = detect.redact_messages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), CHAT)
    for r in df.collect():
        d = redact(texts[r.id], CHAT.rules())
        assert r.filtered == d.filtered and [(x.word, x.level) for x in r.detected] == (d.found if texts[r.id] else []) and r.changed == (d.filtered != texts[r.id])
    assert detect.flagged(df.select("id", "text"), CHAT).count() == sum(bool(t) and redact(t, CHAT.rules()).found != [] for t in texts)


def test_words_of_wide_characters(spark):
    config = from_dict({"banned-words": {"l": ["😀", "a😀b", "x"]}, "fuzzy-match": {"enable": True, "levels": {"l": {"max-char-gap": 1}}}})
    texts = ["😀", "plain", "a😀b", "a-😀-b", "b😀a", "😁", "ok x", "😃😀", None, "a" * 40, "é😀é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in detect.redact_messages(rows, config).collect():
        d = redact(texts[r.id], config.rules())
        assert r.filtered == d.filtered and [(x.word, x.level) for x in r.detected] == (d.found if texts[r.id] else [])
    assert detect.flagged(rows, config).count() == sum(bool(t) and redact(t, config.rules()).found != [] for t in texts)
    pages = ["one 😀", "two 😀 two", None, "", "three"]
    books = spark.createDataFrame([(1, pages, "t", "a"), (2, ["no"], None, None), (3, [], None, None), (4, None, None, None)], "id long, parts array<string>, title string, author string")
    out = {r.id: r for r in parts.redact_books(books, config).collect()}
    assert out[1].pages == ["one **", "two ** two", "", "", "three"] and out[2].pages == ["no"] and out[3].pages == [] == out[4].pages
    assert parts.redact_signs(books, config).where("id = 1").first().lines == ["one **", "two ** two", "", "", "three"]


def test_small_tables_are_spread(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert detect.spread(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and detect.spread(d).count() == d.count()


def test_native_gap_predicate_equals_kernel(spark):
    texts = ["idiot", "i.d.iot", "iiddiioott", "id iot", "i d i o t", "idi中ot", "toidi", "x" * 50 + "idioot", ""]
    g = GapLimits(1, 1, 2)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.contains_gap("t", "idiot", g).alias("hit"))
    for r in df.collect():
        assert r.hit == contains_word(r.t, "idiot", g), r.t


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,name,checked,rebuilt",
    [
        ("/msg Bob hi there", "msg", "there", "/msg Bob hi ***"),
        ("/MSG Bob hi", "msg", "Bob hi", "/MSG ***"),
        ("/msgx a", None, None, None),
        ("/say a b c d", "say", "a c", "/say *** b c d"),
        ("/all  x y ", "all", "x y", "/all ***"),
        ("/all", "all", "", "/all ***"),
        ("! hi", "hh", "hi", "!***"),
        ("/hh text", "hh", "/hh text", "/hh text"),
        ("hello", None, None, None),
    ],
)
def test_routing(spark, text, name, checked, rebuilt):
    d = spark.createDataFrame([(text,)], "text string")
    rows = route.rebuild_messages(route.route_messages(d, CHAT).withColumn("filtered", F.lit("***")), CHAT).collect()
    assert [r.route for r in rows] == ([name] if name else [])
    if name:
        assert rows[0].checked == checked and rows[0].rebuilt == rebuilt


def test_strict_routing(spark):
    r = CHAT.routes[0]
    assert one(spark, "/msg Bob hi there", route.extract("text", r, strict=True)) == "hi there"
    assert one(spark, "/whisper Bob hi", route.extract("text", r)) == "hi" and one(spark, "/whisper Bob hi", route.extract("text", r, strict=True)) == "whisper Bob hi"


def test_parts(spark):
    d = spark.createDataFrame([(1, ["fu", "ck", None, "fuck"]), (2, ["a", "b"]), (3, [])], "id long, parts array<string>")
    out = {r.id: r for r in parts.redact_signs(d, CHAT).collect()}
    assert out[1].lines == ["**", "**", "", "****"] and out[1].changed and not out[2].changed and out[3].lines == []
    d = spark.createDataFrame([(1, ["fu", "ck"], "fuck", "x"), (2, ["ok"], None, None)], "id long, parts array<string>, title string, author string")
    out = {r.id: r for r in parts.redact_books(d, CHAT).collect()}
    assert out[1].pages == ["**", "**"] and out[1].new_title == "****" and [x.word for x in out[1].detected] == ["fuck", "fuck"] and not out[2].changed
    names = spark.createDataFrame([("u", False, "fuck"), ("v", True, "fuck"), ("w", None, None)], "user_id string, bypass boolean, name string")
    assert [r.filtered for r in parts.redact_names(names, CHAT).collect()] == ["****"]
    back = d.select(parts.split(parts.combine("parts"), parts.starts(F.col("parts")), F.size("parts")).alias("p"), "parts")
    assert all(r.p == r.parts for r in back.collect())


SEQUENCE = [("a", "fu", 0), ("a", "ck", 1), ("a", "ok", 2), ("a", "hello", 3), ("b", "fuck", 0), ("c", "fu", 0), ("c", "ck", 90), ("d", "fu", 0), ("d", "x", 1), ("d", "y", 2), ("d", "z", 3), ("d", "zz", 4), ("d", "ck", 5)]


def test_tracking(spark):
    out = {(r.user_id, r.text): r for r in track.track_messages(chat(spark, SEQUENCE), CHAT).collect()}
    assert (out["a", "fu"].hit_word, out["a", "fu"].filtered) == (None, "fu")
    assert (out["a", "ck"].hit_word, out["a", "ck"].crossed, out["a", "ck"].filtered) == ("fuck", True, "c*")
    assert (out["a", "ok"].crossed, out["a", "ok"].filtered) == (True, "o*")
    assert out["a", "hello"].hit_word is None and out["b", "fuck"].filtered == "****" and not out["b", "fuck"].crossed
    assert out["c", "ck"].crossed  # idle states go after the message, so a late one can still complete
    assert not out["d", "ck"].crossed  # more quiet messages than the gap
    resets = chat(spark, [("a", "fu", 0), ("a", "!", 1), ("a", "ck", 2)]).withColumn("r", F.col("text") == "!")
    assert not any(r.crossed for r in track.track_messages(resets, CHAT, reset="r").collect())
    assert [r.filtered for r in track.track_messages(chat(spark, SEQUENCE[:2]), CHAT, commands=True).orderBy("seq").collect()] == ["fu", "c*"]


def test_streams_equal_batches(spark, tmp_path):
    d = chat(spark, SEQUENCE)
    full = messages.as_messages(d, "chat", **{c: c for c in ("msg_id", "user_id", "text", "seq", "ts")})
    full.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = messages.read(spark, str(tmp_path / "in"), stream=True)
    sinks.start(tracker.track_stream(stream, CHAT), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["msg_id", "filtered", "hit_word", "crossed"]
    batch = sorted(map(tuple, track.track_messages(d, CHAT).select(columns).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == batch
    sinks.start(tracker.redact_stream(stream, CHAT).select("msg_id", "text", "filtered"), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert sinks.rewritten(spark.read.parquet(str(tmp_path / "out2"))).count() == 1
    got = []
    violations = stream.select("user_id", F.lit("level-1").alias("level"), "ts")
    sinks.start(tracker.escalate_stream(violations, CHAT, "0 seconds"), "", str(tmp_path / "cp3"), each_batch=lambda b, i: got.extend(b.collect())).awaitTermination()
    assert {(r.user_id, r.command) for r in got} == {("a", "mute a"), ("a", "say x"), ("d", "mute d"), ("d", "say x"), ("d", "ban d")}


def test_messages_without_a_user_share_nothing(spark, tmp_path):
    d = chat(spark, [(None, "fu", 0), (None, "ck", 1), (None, "fuck", 2), ("a", "fu", 0), ("a", "ck", 1)])
    out = [(r.user_id, r.text, r.crossed, r.filtered) for r in track.track_messages(d, CHAT).collect()]
    want = [(None, "ck", False, "ck"), (None, "fu", False, "fu"), (None, "fuck", False, "****"), ("a", "ck", True, "c*"), ("a", "fu", False, "fu")]
    assert sorted(out, key=str) == sorted(want, key=str)
    d.coalesce(1).select("msg_id", "user_id", F.lit("").alias("user_name"), F.lit("chat").alias("surface"), "text", "seq", "ts").write.parquet(str(tmp_path / "in"))
    stream = messages.read(spark, str(tmp_path / "in"), stream=True)
    sinks.start(tracker.track_stream(stream, CHAT), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [(r.user_id, r.text, r.crossed, r.filtered) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_streams_reset_and_escalate(spark, tmp_path):
    d = chat(spark, [("a", "fu", 0), ("a", "!", 1), ("a", "ck", 2), ("b", "fu", 0), ("b", "ck", 1), ("b", "ck", 2), ("b", "ck", 3), ("b", "!", 4), ("b", "ck", 5), ("b", "ck", 31), ("b", "ck", 32), ("b", "ck", 33)])
    d.coalesce(1).select("msg_id", "user_id", F.lit("").alias("user_name"), F.lit("chat").alias("surface"), "text", "seq", "ts").write.parquet(str(tmp_path / "in"))
    stream = messages.read(spark, str(tmp_path / "in"), stream=True)
    clear = F.col("text") == "!"
    sinks.start(tracker.track_stream(stream.withColumn("r", clear), CHAT, reset="r", commands=True), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["msg_id", "filtered", "hit_word", "crossed"]
    batch = track.track_messages(d.withColumn("r", clear), CHAT, reset="r", commands=True)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    v = stream.select(F.col("msg_id").alias("event_id"), "user_id", F.lit("level-1").alias("level"), "ts", clear.alias("r"))
    sinks.start(tracker.escalate_events(v, CHAT, reset="r"), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    rows = d.select(F.col("msg_id").alias("event_id"), "user_id", F.lit("level-1").alias("level"), "ts", clear.alias("r"))
    numbered = alerts.violation_numbers(rows, 15, ("ts", "event_id"), reset="r").join(CHAT.punish_table(spark).withColumnRenamed("threshold", "number"), ["level", "number"])
    got = sorted((r.event_id, r.number, r.command) for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert got == sorted((r.event_id, r.number, r.command.replace("%player%", r.user_id)) for r in numbered.collect()) and len(got) == 4


def test_shout(spark):
    d = chat(spark, [("a", "fu", 0), ("a", "ck", 1), ("b", "fu", 0), ("b", "ck", 1), ("b", "fuck", 2)])
    online = spark.createDataFrame([("a",), ("a",)], "user_id string")
    out = {(r.user_id, r.text): r for r in track.shout_messages(d, online, CHAT).collect()}
    assert out["a", "ck"].filtered == "c*" and out["b", "ck"].filtered == "ck" and out["b", "fuck"].filtered == "****" and out["b", "fuck"].detected == [] and len(out) == 5


def test_counter_resets(spark):
    v = chat(spark, [("u", "x", 0), ("u", "x", 1), ("u", "reset", 2), ("u", "x", 3), ("u", "x", 4)]).withColumn("level", F.lit("l")).withColumn("r", F.col("text") == "reset")
    assert [r.number for r in alerts.violation_numbers(v, 15, ("ts", "seq"), reset="r").orderBy("seq").collect()] == [1, 2, 1, 2]
    assert alerts.violation_counts(v, 15).first().n == 5


def test_alerts(spark):
    v = chat(spark, [("u", "x", i) for i in range(6)] + [("u", "x", 40)]).withColumn("level", F.lit("level-1"))
    out = alerts.escalate(v, CHAT.punish_table(spark), 15, ("ts", "seq"))
    assert sorted((r.number, r.command) for r in out.collect()) == [(3, "mute u"), (3, "say x"), (5, "ban u")]
    assert one(spark, "level-9", alerts.template(demo.CATALOG, "text", "player-warning")) == "You used a banned word"
    assert one(spark, "x", alerts.template({}, "text", "player-warning")) == "warnings.player-warning"
    assert one(spark, "src1", alerts.context_name(demo.CONTEXTS, "text")) == "src1"
    hit = F.struct(F.lit("w").alias("word"), F.lit("l").alias("level"))
    assert len(one(spark, "x", alerts.merge_detections(hit, F.array(hit, hit)))) == 1
    grants = spark.createDataFrame([("u", "admin")], "user_id string, permission string")
    assert route.has_permission(v, grants, "admin").count() == 7 and route.has_permission(v, grants, "admin", without=True).count() == 0


def test_sql_functions(spark):
    sqlfunctions.register(spark, CHAT)
    r = spark.sql("SELECT redact('fuck') a, contains_banned('kcuf') b, detect('f.uck').detected[0].word c, redact_word('op', 'op') d, redact(NULL) e, normalize_text('<red>Ａ') f").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("****", True, "fuck", "**", None, "a")


def test_sql_functions_equal_the_kernel(spark):
    from wardline.functions.charmap import CharMap
    from wardline.functions.matching import contains_any

    config = from_dict({"banned-words": {"l": ["o'n", "fuck", "a\\b", "x]y", "é"]}, "fuzzy-match": {"enable": True, "levels": {"l": {"max-char-gap": 1}}}}, charmap=CharMap({"'": "’", "\\": "/", "û": "u"}))
    rng = random.Random(4)
    texts = [None, "", "o'n", "o’n", "a\\b", "x]y", "É", "fûck", "ffuucckk", "<b>fuck</b>", "&cf"] + ["".join(rng.choice("fuckoon'x]y\\ab û") for _ in range(20)) for _ in range(150)]
    sqlfunctions.register(spark, config)
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rules = config.rules()
    for r in d.selectExpr("id", "redact(text) a", "contains_banned(text) b", "detect(text) c").collect():
        t = texts[r.id]
        k = redact(t, rules)
        assert r.a == k.filtered and r.b == (None if t is None else contains_any(t, rules)), t
        assert r.c is None if t is None else (r.c.filtered, [(x.word, x.level) for x in r.c.detected]) == (k.filtered, k.found if t else []), t
    sqlfunctions.register(spark, CHAT)


def test_sources(spark, tmp_path):
    nested = {"warnings": {"a": "x"}}
    assert messages.read_catalog(spark, {}, "de", nested).first().key == "warnings.a"
    (tmp_path / "m.txt").write_text("1,a,Á\n")
    assert messages.read_charmap(spark, {"english": str(tmp_path / "m.txt")}).normalize("Á") == "a"
    d = chat(spark, [("u", "x", 0), ("u", "", 1), ("u", None, 2)])
    assert messages.as_messages(d, "chat", text="text").count() == 1 and messages.union(messages.as_messages(d, "sign", text="text"), None).count() == 3
    sinks.write(d, str(tmp_path / "o"), partition_by=("user_id",))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_select_spans_and_positions(spark):
    assert one(spark, "anana banana", C.positions("text", "ana")) == [0, 2, 7, 9] and one(spark, None, C.positions("text", "a")) == []
    spans = F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for a, b in [(3, 5), (0, 2), (0, 4), (4, 6)]])
    assert [(x.start, x.end) for x in one(spark, "", detect.select_spans(spans))] == [(0, 4), (4, 6)]
