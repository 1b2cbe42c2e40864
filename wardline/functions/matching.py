"""The central operator: words found exactly, with gaps, through repeated characters and reversed; masked to a fixpoint.

Python on text units. A gap match from s is the earliest embedding of the word that starts there; it holds if no class
of gap characters exceeds its limit and all of them together do not exceed the largest limit. A start costs one `find` for
each character of the word; classes are counted only in windows that hold it. Of a large lexicon only words are tried all of
whose neighbouring characters stand near enough to each other somewhere in the text, which one pass over the text tells.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np

from .charmap import CHINESE, ENGLISH, CharMap
from .markup import parse, visible
from .units import from_units, to_units


@dataclass(frozen=True)
class GapLimits:
    """How many Chinese, English and other characters may stand between those of a word; never below 0."""

    chinese: int = 2
    english: int = 2
    others: int = 2

    def __post_init__(self):
        for name in ("chinese", "english", "others"):
            object.__setattr__(self, name, max(0, int(getattr(self, name))))

    @staticmethod
    def uniform(n: int) -> GapLimits:
        return GapLimits(n, n, n)

    @property
    def most(self) -> int:
        return max(self.chinese, self.english, self.others)


@dataclass(frozen=True)
class Rules:
    """words: (word, level, limits, whether it is also looked for reversed) in order; allow: words that cover matches."""

    words: tuple[tuple[str, str, GapLimits, bool], ...]
    allow: tuple[str, ...] = ()
    fuzzy: bool = True
    charmap: CharMap = CharMap()
    strict: bool = False


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    places: tuple[int, ...]
    word: str
    level: str


@dataclass
class Detection:
    filtered: str | None
    found: list[tuple[str, str]]

    @property
    def first_word(self) -> str:
        return self.found[0][0] if self.found else ""

    @property
    def first_level(self) -> str:
        return self.found[0][1] if self.found else ""

    def add(self, word: str, level: str) -> None:
        if (word, level) not in self.found:
            self.found.append((word, level))


def normalize_whole(text: str) -> str:
    """Markup gone, NFKC over the whole text, lower case; no character map."""
    return to_units(unicodedata.normalize("NFKC", from_units(visible(to_units(text)))).lower())


def normalize_each(shown: str, charmap: CharMap) -> tuple[str, list[int]]:
    """NFKC, lower case and character map unit by unit, and the shown position of each result unit."""
    if shown.isascii() and not charmap.replace:
        return shown.lower(), list(range(len(shown)))
    if _wide.isdisjoint(shown):
        normal = shown.translate(_letters)
        if _wide.isdisjoint(shown) and len(normal) == len(shown):  # the first look may have met new letters
            normal = charmap.normalize(normal)
            if len(normal) == len(shown):
                return normal, list(range(len(shown)))
    out, at = [], []
    for i, c in enumerate(shown):
        n = c if "\ud800" <= c <= "\udfff" else to_units(unicodedata.normalize("NFKC", c).lower())
        n = charmap.normalize(n)
        out.append(n)
        at += [i] * max(1, len(n))
    return "".join(out), at


_wide: set[str] = set()  # units that normalise to none or several


class _Letters(dict):
    """NFKC in lower case by unit, as far as units have been asked for."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        n = self[code] = c if 0xD800 <= code <= 0xDFFF else to_units(unicodedata.normalize("NFKC", c).lower())
        if len(n) != 1:
            _wide.add(c)
        return n


_letters = _Letters()


def normalize_word(word: str, charmap: CharMap) -> str:
    known = _normal_words.get((word, id(charmap)))
    if known is None:
        if len(_normal_words) > 100_000:
            _normal_words.clear()
        known = _normal_words[word, id(charmap)] = (_normalize_word(word, charmap), charmap)
    return known[0]


_normal_words: dict = {}  # a word's form and its map, which is kept so that its identity stays its own


def _normalize_word(word: str, charmap: CharMap) -> str:
    return charmap.normalize(to_units(unicodedata.normalize("NFKC", from_units(visible(to_units(word)))).lower()))


def reverse_word(word: str) -> str:
    return word[::-1]


def compress(text: str) -> tuple[str, list[int]]:
    """Runs of one character as that character, and where each run starts."""
    starts = [i for i, c in enumerate(text) if not i or c != text[i - 1]]
    return "".join(text[i] for i in starts), starts


_RUN = re.compile(r"(.)\1+", re.S)


class Text:
    """A normalised text with what its matches share: prefix counts of classes and allow-listed intervals."""

    def __init__(self, text: str, allow: Sequence[str] = (), charmap: CharMap = CharMap()):
        self.text, self.allow, self.charmap = text, allow, charmap
        self._covers = None
        self._counts = None
        self._compressed = None
        self._starts = None

    def covered(self, start: int, end: int) -> bool:
        """Whether an allow-listed word holds all of the interval."""
        if self._covers is None:
            found = set()
            for w in self.allow:
                n = normalize_whole(w) if w else ""
                if n:
                    found |= {(m.start(), m.start() + len(n)) for m in re.finditer(f"(?={re.escape(n)})", self.text)}
            self._covers = found
        return any(a <= start and end <= b for a, b in self._covers)

    def counts(self):
        if self._counts is None:
            kinds = [self.charmap.classify(c) for c in self.text]
            self._counts = tuple([0, *accumulate(k == which for k in kinds)] for which in (CHINESE, ENGLISH))
        return self._counts

    def compressed(self) -> Text:
        """The text with runs taken together; itself if it has none. Where runs start is asked for only where one matches."""
        if self._compressed is None:
            short = _RUN.sub(r"\1", self.text)
            self._compressed = self if len(short) == len(self.text) else Text(short, (), self.charmap)
        return self._compressed

    def run_starts(self) -> list[int]:
        if self._starts is None:
            self._starts = compress(self.text)[1]
        return self._starts

    def gaps(self, start: int, end: int, own: tuple[int, int], size: int) -> tuple[int, int, int]:
        """Gap characters by class in a window that holds a word of `size` characters, `own` of them Chinese and English."""
        if end - start <= 64:
            kinds = [self.charmap.classify(c) for c in self.text[start:end]]
            chinese, english = kinds.count(CHINESE) - own[0], kinds.count(ENGLISH) - own[1]
        else:
            c, e = self.counts()
            chinese, english = c[end] - c[start] - own[0], e[end] - e[start] - own[1]
        return chinese, english, end - start - size - chinese - english


def exact_spans(t: Text, word: str):
    at = t.text.find(word)
    while at >= 0:
        yield tuple(range(at, at + len(word)))
        at = t.text.find(word, at + 1)


@lru_cache(maxsize=65536)
def _embedding(word: str, most: int) -> re.Pattern:
    """Every gap may be as long as the largest limit: what this does not find no start embeds."""
    return re.compile(re.escape(word[0]) + "".join(f"[^{re.escape(c)}]{{0,{most}}}{re.escape(c)}" for c in word[1:]), re.S)


def gap_spans(t: Text, word: str, limits: GapLimits):
    """Places of the word's characters for every start whose earliest embedding keeps to the limits."""
    text, reach = t.text, len(word) + limits.most
    first = _embedding(word, limits.most).search(text)
    start = first.start() if first else -1
    own = None
    while start >= 0:
        stop, places = start + reach, [start]
        for c in word[1:]:
            p = text.find(c, places[-1] + 1, stop)
            if p < 0:
                break
            places.append(p)
        else:
            end = places[-1] + 1
            if end - start > len(word):
                if own is None:
                    kinds = [t.charmap.classify(c) for c in word]
                    own = kinds.count(CHINESE), kinds.count(ENGLISH)
                gap_c, gap_e, gap_o = t.gaps(start, end, own, len(word))
                if gap_c <= limits.chinese and gap_e <= limits.english and gap_o <= limits.others:
                    yield tuple(places)
            else:
                yield tuple(places)
        start = text.find(word[0], start + 1)


def spans(t: Text, word: str, limits: GapLimits, fuzzy: bool):
    """All matches of a word in order: exact ones, or gap matches and then those through repeated characters."""
    if not fuzzy:
        yield from exact_spans(t, word)
        return
    yield from gap_spans(t, word, limits)
    short = t.compressed()
    if short is not t:  # without runs the same matches would only come twice
        for places in gap_spans(short, word, limits):
            yield tuple(t.run_starts()[p] for p in places)


def contains_word(text: str | None, word: str | None, limits: GapLimits = GapLimits(), fuzzy: bool = True, allow: Sequence[str] = (), charmap: CharMap = CharMap()) -> bool:
    if not text or not word:
        return False
    needle = normalize_whole(word)
    t = Text(normalize_whole(text), allow, charmap)
    return bool(needle) and any(not t.covered(p[0], p[-1] + 1) for p in spans(t, needle, limits, fuzzy))


FEW = 64
_PAIRS = 1 << 20


class Lexicon:
    """The spellings of some rules, normalised, in the order in which they are tried."""

    def __init__(self, rules: Rules, whole: bool):
        self.rules, self.entries = rules, []
        for word, level, limits, both in rules.words:
            for spelling in [word, reverse_word(word)] if both and len(to_units(word)) >= 2 else [word]:
                needle = normalize_whole(spelling) if whole else normalize_word(spelling, rules.charmap)
                if not needle:
                    break
                self.entries.append((spelling, level, limits, needle, frozenset(needle)))
        self.large = len(self.entries) > FEW
        if self.large:
            self.reach = 1 + max((e[2].most for e in self.entries), default=0) * rules.fuzzy
            longest = max(len(e[3]) for e in self.entries)
            codes = np.full((len(self.entries), longest), -1, np.int64)
            for i, e in enumerate(self.entries):
                codes[i, : len(e[3])] = [ord(c) for c in e[3]]
            ahead = np.concatenate([codes[:, 1:], np.full((len(codes), 1), -1)], 1)
            # A pair of neighbours is a place in a table; words of one character are a pair with themselves.
            self.pairs = np.where(ahead >= 0, self._place(codes, ahead), _PAIRS)
            alone = codes[:, min(1, longest - 1)] < 0 if longest > 1 else np.ones(len(codes), bool)
            self.pairs[alone, 0] = self._place(codes[alone, 0], codes[alone, 0])

    @staticmethod
    def _place(a, b):
        return (a * 8191 + b) & (_PAIRS - 1)

    def _near(self, text: str) -> np.ndarray:
        """Which entries have all their pairs of neighbours in the text, near enough for the largest limit."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seen = np.zeros(_PAIRS + 1, bool)
        seen[_PAIRS] = True
        seen[self._place(codes, codes)] = True
        for d in range(1, min(self.reach, len(codes) - 1) + 1):
            seen[self._place(codes[:-d], codes[d:])] = True
        return seen[self.pairs].all(1)

    def possible(self, t: Text):
        """Entries that may be in a text; all that are, are among them."""
        if not self.large:
            have = set(t.text)
            return [e for e in self.entries if e[4] <= have]
        near = self._near(t.text)
        if self.rules.fuzzy and t.compressed() is not t:
            near |= self._near(t.compressed().text)
        return [self.entries[i] for i in np.flatnonzero(near)]


_lexicons: dict = {}


def lexicon_of(rules: Rules, whole: bool = False) -> Lexicon:
    """Built once for some rules; the few last ones are kept."""
    known = _lexicons.get((id(rules), whole))
    if known is None or known.rules is not rules:
        if len(_lexicons) > 32:
            _lexicons.clear()
        known = _lexicons[id(rules), whole] = Lexicon(rules, whole)
    return known


def contains_any(text: str | None, rules: Rules) -> bool:
    """Any word of the rules, as it is or reversed; the text is normalised once."""
    if not text:
        return False
    t = Text(normalize_whole(text), rules.allow, rules.charmap)
    possible = lexicon_of(rules, True).possible(t)
    return any(not t.covered(p[0], p[-1] + 1) for _, _, limits, needle, _ in possible for p in spans(t, needle, limits, rules.fuzzy))


def candidates(t: Text, rules: Rules) -> list[Match]:
    out = []
    for spelling, level, limits, needle, _ in lexicon_of(rules).possible(t):
        for p in spans(t, needle, limits, rules.fuzzy):
            if not t.covered(p[0], p[-1] + 1):
                out.append(Match(p[0], p[-1] + 1, p, spelling, level))
    return out


def select(found: list[Match]) -> list[Match]:
    """From the left, longer ones first, those that do not overlap what is already chosen; ties keep their order."""
    out, end = [], -1
    for m in sorted(found, key=lambda m: (m.start, -m.end)):
        if m.start >= end:
            out.append(m)
            end = m.end
    return out


def redact_once(text: str | None, rules: Rules) -> Detection:
    if text is None:
        return Detection(None, [])
    marked = parse(to_units(text), rules.strict)
    normal, at = normalize_each(marked.shown, rules.charmap)
    result = Detection(text, [])
    mask = set()
    for m in select(candidates(Text(normal, rules.allow, rules.charmap), rules)):
        mask |= {at[p] for p in m.places}
        result.add(m.word, m.level)
    if mask:
        result.filtered = from_units(marked.masked(mask))
    return result


def redact(text: str | None, rules: Rules, rechecks: int = 5) -> Detection:
    """Redacted until nothing changes, at most `rechecks` more times; what later rounds find is added."""
    result = redact_once(text, rules)
    if result.filtered is None or result.filtered == text:
        return result
    for _ in range(rechecks):
        again = redact_once(result.filtered, rules)
        if again.filtered == result.filtered:
            break
        for word, level in again.found:
            result.add(word, level)
        result.filtered = again.filtered
    return result


def redact_word(text: str | None, word: str | None, limits: GapLimits = GapLimits(), fuzzy: bool = True, allow: Sequence[str] = (), charmap: CharMap = CharMap()) -> str | None:
    """Every match of one word is masked, overlapping ones too."""
    if text is None or not word:
        return text
    needle = normalize_whole(word)
    if not needle:
        return text
    marked = parse(to_units(text))
    t = Text(normalize_whole(text), allow, charmap)
    mask = {p for places in spans(t, needle, limits, fuzzy) if not (t.covered(places[0], places[-1] + 1)) for p in places}
    return from_units(marked.masked(mask))


def mask_suffix(text: str | None, word: str | None, charmap: CharMap = CharMap()) -> str | None:
    """Masks the shortest end of what is shown that the word ends with too."""
    if not text or not word:
        return text
    marked = parse(to_units(text))
    shown, target = charmap.normalize(marked.shown.lower()), charmap.normalize(to_units(word).lower())
    for n in range(1, min(len(shown), len(target)) + 1):
        if target.endswith(shown[-n:]):
            return from_units(marked.masked(set(range(len(shown) - n, len(shown)))))
    return text


def mask_raw_suffix(text: str | None, word: str | None) -> str | None:
    """The same for commands: no character map, and the end of the raw text is cut."""
    if not text or not word:
        return text
    raw, shown, target = to_units(text), visible(to_units(text)).lower(), to_units(word).lower()
    for n in range(1, min(len(shown), len(target)) + 1):
        if target.endswith(shown[-n:]):
            return from_units(raw[: len(raw) - n] + "*" * n)
    return text
