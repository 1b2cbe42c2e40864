"""Golden cases and properties of the matching functions; no Spark."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.functions import markup
from wardline.functions.charmap import CHINESE, ENGLISH, OTHERS, CharMap, parse_charmap
from wardline.functions.matching import (
    GapLimits, Rules, Text, compress, contains_any, contains_word, gap_spans, mask_raw_suffix, mask_suffix, normalize_each, normalize_whole, redact, redact_once, redact_word,
)
from wardline.functions.units import from_units, to_units

L = GapLimits(3, 50, 300)


def rules(*words, **options):
    return Rules(tuple((w, "level-1", L, True) for w in words), **options)


ALPHABET = "abcdefghijklmnopqrstuvwxyz"
GOLDEN = [
    (["傻逼"], "傻他妈的逼", "*他妈的*", ["傻逼"]),
    (["傻逼"], "傻" + ALPHABET * 2 + "逼", None, []),
    (["傻逼"], "傻" + "a" * 51 + "逼", "*" + "a" * 51 + "*", ["傻逼"]),
    (["傻逼"], "傻傻逼逼", "****", ["傻逼"]),
    (["傻逼"], "傻1111逼", "*1111*", ["傻逼"]),
    (["你妈", "他妈"], "你他妈", "*他*", ["你妈"]),
    (["fuck"], "…fuck", "…****", ["fuck"]),
    (["fuck"], "ｆｕｃｋ", "****", ["fuck"]),
    (["fuck", "dick"], "<lang:k:'<red>fuck':'<blue>dick'>", "<lang:k:'<red>****':'<blue>****'>", ["fuck", "dick"]),
    (["fuck"], "kcuf", "****", ["kcuf"]),
    (["fuck"], "&xfuck", "****ck", ["fuck"]),
    (["fuck"], "<#zz>fuck", None, ["fuck"]),
    (["fuck"], "f&cuck", "*&c***", ["fuck"]),
]


@pytest.mark.parametrize("words,text,expected,found", GOLDEN)
def test_golden(words, text, expected, found):
    d = redact(text, rules(*words))
    assert d.filtered == (text if expected is None else expected)
    assert [w for w, _ in d.found] == found


def test_first_pass_and_allow_list_and_strict():
    assert redact_once("傻傻逼逼", rules("傻逼")).filtered == "*傻*逼"
    assert redact("sm", rules("sm", allow=("SM",))).filtered == "sm"
    assert redact("&xfuck", rules("fuck", strict=True)).filtered == "&x****"
    assert redact("<#zz>fuck", rules("fuck", strict=True)).filtered == "<#zz>****"
    assert redact(None, rules("x")).filtered is None
    assert redact("<insert:YfuMY>", rules("fu")).filtered == "<insert:Y**MY>"
    assert redact("😀fu😀ck", rules("fuck")).filtered == "😀**😀**"


def scan(text, word, limits):
    """Every start's greedy embedding, by hand."""
    kind, out = CharMap().classify, []
    for s in range(len(text)):
        if text[s] != word[0]:
            continue
        k, gaps, places = 0, [0, 0, 0], []
        for i in range(s, min(len(text), s + len(word) + limits.most)):
            if text[i] == word[k]:
                places.append(i)
                k += 1
                if k == len(word):
                    break
            else:
                gaps[kind(text[i])] += 1
        if k == len(word) and gaps[0] <= limits.chinese and gaps[1] <= limits.english and gaps[2] <= limits.others:
            out.append(tuple(places))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab中1 ", max_size=30), st.text("ab中", min_size=1, max_size=4), st.tuples(*[st.integers(0, 3)] * 3))
def test_gap_spans_equal_a_scan(text, word, limits):
    g = GapLimits(*limits)
    assert list(gap_spans(Text(text), word, g)) == scan(text, word, g)


@settings(max_examples=200, deadline=None)
@given(st.text("fuckab<&>1c😀…", max_size=25))
def test_redaction_properties(text):
    r = rules("fuck")
    d = redact(text, r)
    assert len(to_units(d.filtered)) == len(to_units(text))
    if not d.found:
        assert d.filtered == text
    # Covering a word never finds more; one more redaction of a stable text changes nothing.
    assert set(redact(text, rules("fuck", allow=("fuck",))).found) <= set(d.found)
    assert redact_once(d.filtered, r).filtered == d.filtered or redact(d.filtered, r).filtered != d.filtered


def test_units_and_normalisation():
    assert to_units("a😀") == "a\ud83d\ude00" and from_units(to_units("a😀é")) == "a😀é"
    assert normalize_whole("<red>ＦＵ…</red>") == "fu..."
    shown, at = normalize_each("…A", CharMap())
    assert (shown, at) == ("...a", [0, 0, 0, 1])
    assert compress("aabbb1") == ("ab1", [0, 2, 5])
    assert unicodedata.normalize("NFKC", "ｆ") == "f"


def test_contains_and_word_redaction():
    assert contains_word("xx f.u.c.k", "fuck", GapLimits(0, 0, 3)) and not contains_word("f.,;:uck", "fuck", GapLimits(0, 0, 3), fuzzy=True)
    assert not contains_word(None, "a") and not contains_word("a", "") and contains_word("FUCK", "fuck", fuzzy=False)
    assert contains_any("kcuf", rules("fuck")) and not contains_any("kcuf", Rules((("fuck", "l", L, False),)))
    assert redact_word("fuck fuck", "fuck", fuzzy=False) == "**** ****"
    assert mask_suffix("ck", "fuck") == "c*" and mask_suffix("ok", "fuck") == "o*" and mask_suffix("hello", "fuck") == "hello"
    assert mask_raw_suffix("c&ck", "fuck") == "c&c*" and mask_raw_suffix("", "x") == ""


def test_markup():
    assert markup.preprocess("&x&1&2&3&4&5&6a")[0] == "<#123456>a"
    assert markup.preprocess("&#abcdefz")[0] == "<#abcdef>z" and markup.preprocess("&#abz")[0] == "&#abz"
    assert markup.visible("<RED>a</red>") == "<RED>a" and markup.visible("<b>a<unknown>") == "a<unknown>"
    assert markup.visible("<hover:show_text:'<red>x'>y") == "xy" and markup.visible("<hover:show_item:x>y") == "y"
    assert markup.visible('<click:open_url:"u">z') == "open_url:\"u\"z" and markup.visible("<tr:key:'a':b:'c'>") == "ac"
    assert markup.strip_everything("&a<hover:show_text:'x'>y") == "y"
    assert markup.split_any_tags("a<x:1>b") == ["a", "<x:1>", "b"]
    assert markup.first_plain_colon("'a:b':c") == 5 and markup.first_plain_colon("abc") == -1 and markup.first_plain_colon("'a:b") == -1
    assert markup.styled_runs("<red>a<bold>b<blue>c</bold>d") == [("a", "c"), ("b", "cl"), ("c", "9l"), ("d", "")]
    assert markup.styled_runs("a§Lb§zc§") == [("a", ""), ("b", "l"), ("c§", "l")] and markup.styled_runs("") == [] and markup.styled_runs("a§§b") == [("a", ""), ("b", "")] and markup.styled_runs("<c:1>x") == [("<c:1>x", "")]
    depth = "<click:" * 8 + "x" + ">" * 8
    assert isinstance(markup.visible(depth), str)
    assert re.compile(markup.TAG).search('<red:"' + "\\" * 40) is None  # no runaway backtracking


def test_charmap():
    m = parse_charmap([("chinese", ["序号,基准,变体", "1,妈,媽/嫲", "2,媽,x"]), ("english", ["a,Á/á", "0,9"])])
    assert m.normalize("媽嫲Áz") == "妈妈az" and m.classify("Á") == ENGLISH and m.classify("é") == OTHERS and m.classify("豈") == CHINESE
    assert redact("你媽", Rules((("你妈", "l", L, True),), charmap=m)).filtered == "**"


def test_long_text_is_fast():
    random.seed(0)
    text = "".join(random.choice("fuckab ") for _ in range(200_000))
    assert len(redact_once(text, Rules((("fuckfuckfuck", "l", GapLimits(1, 2, 2), True),))).filtered) == len(text)


def test_large_lexicons_find_the_same(monkeypatch):
    import random
    import time

    from wardline.functions import matching as m

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    for fuzzy in (True, False):
        words = tuple((word(rng.choice([1, 2, 3, 5])), f"l{i % 2}", m.GapLimits(1, i % 3, 2), i % 4 == 0) for i in range(90))
        rules, few = m.Rules(words, ("ab",), fuzzy), m.Rules(words, ("ab",), fuzzy)
        texts = ["", "a", "é"] + [word(rng.choice([3, 20, 80])) for _ in range(150)]
        large = [(m.redact(t, rules).__dict__, m.contains_any(t, rules)) for t in texts]
        assert m.lexicon_of(rules).large
        monkeypatch.setattr(m, "FEW", 10**9)
        assert large == [(m.redact(t, few).__dict__, m.contains_any(t, few)) for t in texts]
        monkeypatch.undo()
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    words = tuple(("".join(rng.choice(letters) for _ in range(8)), "l", m.GapLimits(1, 2, 2), True) for _ in range(10_000))
    rules, text = m.Rules(words), " ".join("".join(rng.choice(letters[:16]) for _ in range(6)) for _ in range(350))
    m.redact_once(text, rules)
    began = time.process_time()
    m.redact_once(text, rules)
    assert time.process_time() - began < 3
