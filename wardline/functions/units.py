"""Text as UTF-16 code units, in which positions, gaps and masks are counted: one Python character for each unit."""

from __future__ import annotations

import numpy as np


def to_units(text: str) -> str:
    """Astral characters become their two surrogates; all else stays."""
    if text.isascii() or max(text) <= "￿":
        return text
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype("<u4")
    return units.tobytes().decode("utf-32-le", "surrogatepass")


def from_units(units: str) -> str:
    """Surrogate pairs become characters again; a lone surrogate becomes U+FFFD, as UTF-8 cannot hold it."""
    if units.isascii():
        return units
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
