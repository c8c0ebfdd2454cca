"""One consistent form for texts that look alike but are written with different characters.

A transducer is compiled once for each worker: a table from single characters to their consistent
form, built from the Unicode character data by rule and from the fixed look-alikes below, and one
pattern that takes the longest grapheme cluster at each place (a character with all its accents and
the marks without width between them). A text is rewritten in one pass. compile_table() refuses a
table in which an entry's result is itself rewritten, so the form of a form is the form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts with the shape of a Latin letter, and that letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTXYQWaesijopcyxhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj", strict=True))
ARMENIAN = dict(zip("ՕՍօսցհոզ", "OUoughnq", strict=True))
LOOK_ALIKES = CYRILLIC | GREEK | ARMENIAN

#: form() reads a tab as a blank, shown() keeps it; other characters below 0x80 stay.
_TAB = 0x09
_CODES = [_TAB, *range(0x80, 0x30000), *range(0xE0000, 0xE0200)]
#: Marks without width that are not of category Cf.
_NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _width(ch: str) -> str:
    kind = unicodedata.decomposition(ch)
    return "".join(chr(int(x, 16)) for x in kind.split()[1:]) if kind.startswith(("<wide>", "<narrow>")) else ch


def _compose(text: str) -> str:
    """Canonical composition with every base letter read by its shape."""
    whole = unicodedata.normalize("NFD", "".join(_width(ch) for ch in text))
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(ch, ch) for ch in whole))


@lru_cache(maxsize=1)
def compile_table() -> tuple[dict[str, str], list[int], list[int]]:
    """The mapping of single characters, and the codes of accents and of marks without width."""
    table, accents, empty = {}, [], []
    for code in _CODES:
        ch = chr(code)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co"):
            continue
        if cat == "Cf" or code in _NO_WIDTH:
            table[ch] = ""
            empty.append(code)
        elif cat == "Zs" or code == _TAB:
            table[ch] = " "
        elif (form := _compose(ch)) != ch:
            table[ch] = " " if form == "　" else form
        if cat[0] == "M" and code not in _NO_WIDTH or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2 or code in (0xFF9E, 0xFF9F):
            accents.append(code)
    clash = [ch for ch, form in table.items() if any(table.get(x, x) != x for x in form)]
    if clash:
        raise ValueError(f"entries whose result is rewritten again: {clash[:5]}")
    return table, accents, empty


def _ranges(codes: list[int]) -> str:
    out, codes, i = [], sorted(set(codes)), 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[i])) + ("-" + re.escape(chr(codes[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


class Transducer:
    """Rewrites texts into their consistent form; one is kept for each worker."""

    def __init__(self) -> None:
        self.table, accents, empty = compile_table()
        # few texts have marks; a set is asked for them much faster than a pattern of their many ranges
        self.unmarked = frozenset(map(chr, accents + empty)).isdisjoint
        accents, empty = _ranges(accents), _ranges(empty)
        self.cluster = re.compile(f"[^{accents}{empty}]?[{accents}{empty}]+|[{_ranges([ord(x) for x in self.table])}]")
        self.single = str.maketrans(self.table)
        self.changed = re.compile(f"[{_ranges([ord(x) for x in self.table])}]+")
        self.memo: dict[str, str] = {}

    def _read(self, match: re.Match) -> str:
        cluster = match.group()
        form = self.memo.get(cluster)
        if form is None:
            kept = "".join(ch for ch in cluster if self.table.get(ch, ch))
            form = _compose(kept).translate(self.single) if kept else ""
            if len(self.memo) < 100_000:
                self.memo[cluster] = form
        return form

    def _shift(self, match: re.Match) -> str:
        return match.group().translate(self.single)

    def form(self, text: str) -> str:
        """The consistent form: visible differences stay."""
        if text.isascii():
            return text.replace("\t", " ")
        if self.unmarked(text):
            return self.changed.sub(self._shift, text)
        return self.cluster.sub(self._read, text)

    def shown(self, text: str) -> str:
        """The consistent form with tabs kept: they are white space, but no blank of some width."""
        return "\t".join(map(self.form, text.split("\t"))) if "\t" in text else self.form(text)

    def core(self, text: str) -> str:
        """The consistent form in lower case, letters and digits only."""
        return _DROPPED.sub("", self.form(text).lower())


_DROPPED = re.compile(r"[\W_]+")


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()
