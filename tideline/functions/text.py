"""Titles: normal forms, accent folding, and the bottles of a kit."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Word boundaries of ASCII words, whatever stands beside them.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# The rewrites of a title, in order.
TITLE_REWRITES = (
    (r"\s*-\s*(full|fulfillment|ml fulfillment).*", ""),
    (_B + "full" + _E, ""),
    (_B + "fulfillment" + _E, ""),
    (_B + r"(\d+)\s*lts" + _E, "$1 litros"),
    (_B + r"(\d+)\s*l" + _E, "$1 litros"),
    (r"\s+pack\s+\d+.*", ""),
    (r"\s+kit\s+com\s+\d+.*", ""),
    (r"\s+kit\s+\d+.*", ""),
    (r"\s+cx\s+\d+.*", ""),
    (r"\s+caixa\s+\d+.*", ""),
    (r"\s+", " "),
)
KIT = _B + r"(?:kit|caixa|pack|combo|c/)\s*(?:com\s+)?(\d{1,2})\s*(?:un|und|unid\w*|garrafas?|gfs?)" + _E
KIT_BOTTLES = (2, 24)


def _folds() -> tuple[str, str]:
    """Accented Latin letters and their bases, from the Unicode database."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    plain = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(0x300 <= ord(x) <= 0x36F for x in d[1:])]
    return "".join(c for c, _ in plain), "".join(b for _, b in plain)


_FROM, _TO = _folds()


def fold(text: str | Column) -> Column:
    """Lower case without accents, composed or combining; null as ''."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))
    return F.regexp_replace(F.translate(lower, _FROM, _TO), "[̀-ͯ]", "")


def fold_text(text: str) -> str:
    """The same for a string on the driver."""
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not 0x300 <= ord(c) <= 0x36F)


def normal_title(title: str | Column) -> Column:
    """A title without logistics suffixes and pack sizes; accents stay."""
    out = F.lower(F.coalesce(col(title), F.lit("")))
    for pattern, by in TITLE_REWRITES:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def bottles(title: str | Column) -> Column:
    """Bottles in one sold unit: the number of a kit, else 1."""
    n = F.regexp_extract(fold(title), KIT, 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n.between(*KIT_BOTTLES), n).otherwise(F.lit(1))
