"""Formatting markup: colour codes and tags, what of them is shown, and where shown characters stand in the raw text.

Everything works on text units (see units). Shown text and positions are built from lists of (character, raw position).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# The tag names that count as markup; case matters.
TAG_NAMES = (
    "yellow", "white", "black", "red", "green", "blue", "gray", "grey", "dark_gray", "dark_grey", "dark_blue", "dark_green", "dark_aqua", "dark_red", "dark_purple", "gold", "aqua", "light_purple",
    "color", "colour", "c", "shadow",
    "bold", "b", "italic", "em", "i", "underlined", "u", "strikethrough", "st", "obfuscated", "obf",
    "reset", "r",
    "click", "hover", "key", "lang", "tr", "translate", "lang_or", "tr_or", "translate_or",
    "insert", "rainbow", "gradient", "transition", "font", "newline", "br",
    "selector", "sel", "score", "nbt", "pride", "sprite", "head",
)
MOST_DEPTH = 5

HEX = "[0-9a-fA-F]"
SPREAD_HEX = rf"&x&({HEX})&({HEX})&({HEX})&({HEX})&({HEX})&({HEX})"
SHORT_HEX = rf"&#({HEX}{{6}}|{HEX}{{3}})"
LEGACY = "[§&][0-9a-fA-FklmnorxX]"
HEX_TAG = rf"<#{HEX}{{3,6}}>"
# A quoted argument may hold '>' and escapes; the last backslash may also stand for itself, so nothing backtracks twice.
_ARGS = r"""(?::(?:"(?:\\.|[^"\\])*\\?"|'(?:\\.|[^'\\])*\\?'|[^>"'])*)?"""
TAG = rf"</?!?(?:{'|'.join(TAG_NAMES)}){_ARGS}/?>|</?#{HEX}{{3,6}}>"
ANY_TAG = r"</?[a-zA-Z0-9_]+(:[^>]*)?>"

_spread, _short, _legacy, _hex_tag, _tag = (re.compile(p, re.S) for p in (SPREAD_HEX, SHORT_HEX, LEGACY, HEX_TAG, TAG))
_STRIPPED = (_spread, _short, _legacy, _hex_tag)
# What the position scan passes over. It differs from what is stripped: no lower-case x code, and any "<#...>" goes.
_SKIPPED = re.compile(rf"&x(?:&{HEX}){{6}}|{SHORT_HEX}|[&§][0-9a-fA-FklmnorX]|<#[^>]*>", re.S)
_PAYLOAD_TAGS = {"click", "insert"}
_FALLBACK_TAGS = {"lang", "tr", "translate", "lang_or", "tr_or", "translate_or"}

Placed = list[tuple[str, int]]


def _rewrite(pattern: re.Pattern, text: str, at: list[int]) -> tuple[str, list[int]]:
    """Matches become '<#digits>', the digits keep their positions and what is new has -1."""
    out, pos, done = [], [], 0
    for m in pattern.finditer(text):
        digits = [i for g in range(1, m.re.groups + 1) for i in range(*m.span(g))]
        out += [text[done : m.start()], "<#", *(text[i] for i in digits), ">"]
        pos += [*at[done : m.start()], -1, -1, *(at[i] for i in digits), -1]
        done = m.end()
    return "".join([*out, text[done:]]), pos + at[done:]


def preprocess(text: str) -> tuple[str, list[int]]:
    """Both spellings of hexadecimal colours as tags, and where each character comes from (-1: nowhere)."""
    return _rewrite(_short, *_rewrite(_spread, text, list(range(len(text)))))


def first_plain_colon(text: str) -> int:
    """The first colon outside quotes, or -1; a backslash within quotes covers the next character."""
    m = re.match(r"""(?:[^:"']|"(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z))*""", text, re.S)
    return m.end() if m.end() < len(text) else -1


def _arguments(text: str, at: int) -> list[tuple[str, int]]:
    """Parts between plain colons and where each begins."""
    out = []
    while True:
        k = first_plain_colon(text)
        if k < 0:
            return [*out, (text, at)]
        out.append((text[:k], at))
        text, at = text[k + 1 :], at + k + 1


def _quoted(x: str) -> bool:
    return len(x) >= 2 and x[0] in "\"'" and x[-1] == x[0]


def _shown(text: str, at: int, depth: int) -> Placed:
    """Text with tags in it: plain characters and what the tags show."""
    out, done = [], 0
    for m in _tag.finditer(text):
        out += [(text[i], at + i) for i in range(done, m.start())]
        out += tag_payload(m[0], at + m.start(), depth + 1)
        done = m.end()
    return out + [(text[i], at + i) for i in range(done, len(text))]


def _payload(value: str, at: int, depth: int) -> Placed:
    return _shown(value[1:-1], at + 1, depth) if _quoted(value) else _shown(value, at, depth)


def tag_payload(tag: str, at: int = 0, depth: int = 0) -> Placed:
    """The characters that a tag shows: hover texts, click and insert values, quoted fallbacks of translations."""
    if depth > MOST_DEPTH or tag.startswith(("</", "<!")):
        return []
    inner = tag[1:-2] if len(tag) > 3 and tag[-2] == "/" else tag[1:-1]
    colon = first_plain_colon(inner)
    name = (inner if colon < 0 else inner[:colon]).lower()
    args, begin = (inner, at + 1) if colon < 0 else (inner[colon + 1 :], at + colon + 2)
    if name == "hover":
        action = first_plain_colon(args)
        if action < 0 or args[:action].lower() != "show_text":
            return []
        return _payload(args[action + 1 :], begin + action + 1, depth)
    if name in _PAYLOAD_TAGS:
        return _payload(args, begin, depth)
    if name in _FALLBACK_TAGS:
        return [x for value, p in _arguments(args, begin)[1:] if _quoted(value) for x in _payload(value, p, depth)]
    return []


@dataclass(frozen=True)
class Marked:
    """raw: the text; shown: what a reader sees; at: raw position of shown characters (-1: none), maybe of another length."""

    raw: str
    shown: str
    at: list[int]

    def masked(self, mask, sign: str = "*") -> str:
        """The raw text with the characters behind the marked shown positions replaced, one for one."""
        gone = {self.at[i] for i in mask if i < len(self.at)} - {-1}
        return "".join(sign if i in gone else c for i, c in enumerate(self.raw)) if gone else self.raw

    def masked_ranges(self, ranges, sign: str = "*") -> str:
        """The same for ranges (start, end) of shown positions; what lies outside the text counts for nothing."""
        return self.masked({i for a, b in ranges for i in range(max(0, a), min(b, len(self.at)))}, sign)


def strip_codes(text: str) -> str:
    """Text outside tags without its colour codes."""
    for p in _STRIPPED:
        text = p.sub("", text)
    return text


def _strip_placed(text: str, base: int) -> tuple[str, list[int]]:
    """strip_codes, with the position of what is left."""
    at = list(range(base, base + len(text)))
    for p in _STRIPPED:
        keep, done = [], 0
        for m in p.finditer(text):
            keep += range(done, m.start())
            done = m.end()
        keep += range(done, len(text))
        text, at = "".join(text[i] for i in keep), [at[i] for i in keep]
    return text, at


def split_tags(text: str) -> list[tuple[str, bool]]:
    """Parts of a text, and whether each is a tag; unknown tags are text."""
    out, done = [], 0
    for m in _tag.finditer(text):
        if m.start() > done:
            out.append((text[done : m.start()], False))
        out.append((m[0], True))
        done = m.end()
    return [*out, (text[done:], False)] if done < len(text) else out


def parse(raw: str, strict: bool = False) -> Marked:
    """What a text shows and where. strict: positions follow exactly what is stripped; otherwise they come from a scan of
    its own, whose two differences (x codes, and '<#' up to any '>') shift masks as the compatible mode must."""
    if not any(c in raw for c in "<&§"):
        return Marked(raw, raw, list(range(len(raw))))
    text, origin = preprocess(raw)
    shown, at, base = [], [], 0
    for part, is_tag in split_tags(text):
        if is_tag:
            placed = tag_payload(part, base)
            shown += [c for c, _ in placed]
            at += [p for _, p in placed]
        elif strict:
            visible, places = _strip_placed(part, base)
            shown.append(visible)
            at += places
        else:
            shown.append(strip_codes(part))
            done = 0
            for m in _SKIPPED.finditer(part):
                at += range(base + done, base + m.start())
                done = m.end()
            at += range(base + done, base + len(part))
        base += len(part)
    return Marked(raw, "".join(shown), [origin[p] for p in at])


def visible(raw: str) -> str:
    return parse(raw).shown


def strip_everything(text: str) -> str:
    """Codes and tags go, payloads with them."""
    for p in (_spread, _short, _tag, _legacy):
        text = p.sub("", text)
    return text


def split_any_tags(text: str) -> list[str]:
    """Parts around and including anything that looks like a tag, whatever its name."""
    out, done = [], 0
    for m in re.finditer(ANY_TAG, text):
        out += [text[done : m.start()]] * (m.start() > done) + [m[0]]
        done = m.end()
    return [*out, text[done:]] if done < len(text) else out


# Tags with a legacy code each; any closing tag resets.
STYLE_CODES = {
    "black": "0", "dark_blue": "1", "dark_green": "2", "dark_aqua": "3", "dark_red": "4", "dark_purple": "5", "gold": "6", "gray": "7",
    "dark_gray": "8", "blue": "9", "green": "a", "aqua": "b", "red": "c", "light_purple": "d", "yellow": "e", "white": "f",
    "obfuscated": "k", "bold": "l", "strikethrough": "m", "underlined": "n", "italic": "o", "reset": "r",
}


_STYLE_TAG = re.compile("</?([a-zA-Z0-9_]+)>")


def to_style_codes(text: str) -> str:
    """Tags as section-sign codes: closing ones reset, unknown ones go."""
    return _STYLE_TAG.sub(lambda m: "§r" if m[0].startswith("</") else f"§{STYLE_CODES[m[1]]}" if m[1] in STYLE_CODES else "", text)


def styled_runs(text: str) -> list[tuple[str, str]]:
    """(text, style) runs. A style is its colour, if any, and its decorations in alphabetical order; colours replace colours,
    decorations add up, a reset ends both, and a code that is none is passed over."""
    out, colour, marks, piece = [], "", set(), ""

    def put():
        if piece:
            out.append((piece, colour + "".join(sorted(marks))))

    for m in re.finditer(r"§(.)|§\Z|[^§]+", to_style_codes(text), re.S):
        if m[1] is None:
            piece += m[0]
            continue
        put()
        piece, code = "", m[1].lower()
        if code == "r":
            colour, marks = "", set()
        elif code in "0123456789abcdef":
            colour = code
        elif code in "klmno":
            marks = marks | {code}
    put()
    return out
