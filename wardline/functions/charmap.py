"""Look-alike characters: a pluggable table of substitutions and of which characters count as Chinese or English."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

CHINESE, ENGLISH, OTHERS = 0, 1, 2
HAN = "㐀-䶿一-鿿豈-﫿"
_HEADER = re.compile("^序号|基准|简体")


@dataclass(frozen=True)
class CharMap:
    """replace: character to base; chinese and english: characters beyond the ranges of Unicode."""

    replace: dict[str, str] = field(default_factory=dict)
    chinese: frozenset[str] = frozenset()
    english: frozenset[str] = frozenset()

    def normalize(self, text: str) -> str:
        return text.translate(self._table()) if self.replace and text else text

    def _table(self):
        return {ord(k): v for k, v in self.replace.items()}

    def classify(self, c: str) -> int:
        if c in self.chinese or "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿":
            return CHINESE
        if (c.isascii() and c.isalpha()) or c in self.english:
            return ENGLISH
        return OTHERS


def parse_charmap(tables: Iterable[tuple[str, Iterable[str]]]) -> CharMap:
    """A map from tables (kind, lines); kind is 'chinese', 'english' or anything else.

    A line has comma-separated columns of variants, '/' between them. Columns of digits only are row numbers. The first
    character of a line is the base of all others in it, itself included; what a character maps to first stays. A first line that looks like a heading is skipped.
    """
    replace: dict[str, str] = {}
    members: dict[str, set[str]] = {"chinese": set(), "english": set()}
    for kind, lines in tables:
        rows = [x.strip() for x in lines if x.strip()]
        if rows and _HEADER.search(rows[0]):
            rows = rows[1:]
        for row in rows:
            columns = row.rstrip(",").split(",")
            if len(columns) < 2:
                continue
            cells = [c.strip() for c in columns if c.strip() and not re.fullmatch("[0-9]+", c.strip())]
            chars = [x for cell in cells for variant in cell.split("/") for x in variant.strip()]
            for x in chars:
                replace.setdefault(x, chars[0])
                if kind in members:
                    members[kind] |= {y for y in (x, x.lower(), x.upper()) if len(y) == 1}
    return CharMap(replace, frozenset(members["chinese"]), frozenset(members["english"]))
