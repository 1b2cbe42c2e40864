import pytest

from wardline.config import Engine, GapLimits, Route, from_dict, hash_order, load, parse_args, parse_limits
from wardline.functions.markup import parse
from wardline.plans import demo
from wardline.sources.messages import flatten


def test_parsing():
    assert parse_limits({"chinese": 3}) == GapLimits(3, 2, 2) and parse_limits(4) == GapLimits(4, 4, 4) and parse_limits(-1) == GapLimits(0, 0, 0) and parse_limits(None) == GapLimits()
    assert parse_args("2, x,0,-1, 3") == (2, 3) and parse_args(None) == () and parse_args("") == ()
    c = from_dict({"banned-words": {"a": ["x", "x"], "b": ["x"]}, "whitelist": [None, "y"], "external-plugins": {"r": {"commands": ["/r"], "args-number": 1}}})
    assert c.fuzzy and c.allow == ("y",) and c.routes == (Route("r", True, (1,), False, ("/r",), ()),) and c.gap_of("a") == 0 and c.reversed_too("a")
    assert Engine(c).info()["words"] == 3 and Engine(c).missing(["p"], ["q", "p"]) == ["q"]
    assert not from_dict({}, profile="mod").fuzzy
    assert flatten({"a": {"b": 1}, "c": "x"}) == {"a.b": "1", "c": "x"}


def test_hash_order():
    assert hash_order(["level-2", "level-1"]) == ["level-1", "level-2"]
    assert sorted(hash_order([f"k{i}" for i in range(40)])) == sorted(f"k{i}" for i in range(40))


def test_file_and_reload(tmp_path):
    pytest.importorskip("yaml")
    p = tmp_path / "c.yml"
    p.write_text("banned-words:\n  l:\n    - w\nreverse-match:\n  levels:\n    l: false\n")
    e = Engine(path=str(p))
    assert e.config.words == {"l": ["w"]} and not e.config.reversed_too("l")
    p.write_text("banned-words:\n  l: [w, v]\n")
    assert e.reload().words == {"l": ["w", "v"]} and load(str(p)).words == e.config.words


def test_defaults_are_written_where_there_is_no_file(tmp_path):
    path = str(tmp_path / "new" / "engine.yml")
    assert load(path, defaults=demo.SETTINGS).words == demo.CONFIG.words
    assert load(path, defaults={"banned-words": {}}).routes == demo.CONFIG.routes  # a file that is there stays


def test_ranges_are_masked():
    marked = parse("a<b>b&cc")
    assert marked.masked_ranges([(1, 2), (-4, 0), (2, 99)], "#") == "a<b>#&c#"
