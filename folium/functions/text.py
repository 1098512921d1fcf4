"""Text expressions.

Spark has no Unicode normalisation function.  Upper/case folding, compatibility
decomposition and mark removal all work code point by code point, so the folded
form of every code point is tabulated once from Python's ``unicodedata`` and the
text is rewritten with JVM string functions only (no Python worker):

* pure ASCII text (byte length equals character length): ``upper``/``lower``;
* ASCII plus the accented letters of everyday Spanish, Portuguese, French and
  German: ``upper``/``lower`` and one ``replace`` per letter, which is many times
  faster than ``translate`` (a hash lookup per character);
* other Latin text and general punctuation: a few ``replace`` plus one small
  ``translate``;
* anything else: the full ``translate`` table, and a per-character lookup only
  for rows that hold characters with a longer folded form.

The branches are a lazy ``CASE``, so a row pays only for the alphabet it uses.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from folium import fixed_values as fv

# Every character Python treats as white space; JVM ``trim`` and ``\s`` know fewer.
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def _class_of(chars) -> str:
    """Body of a regex character class covering ``chars``, as ranges."""
    points = sorted(ord(ch) for ch in chars)
    spans: list[list[int]] = []
    for cp in points:
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "".join(
        f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans
    )


_ASCII_WS = "".join(ch for ch in WHITESPACE if ch < "\x80")


def _runs(whitespace: str) -> str:
    """Regex of the white-space runs that are not one plain space already."""
    return f"[{_class_of(whitespace)}]{{2,}}|[{_class_of(whitespace.replace(' ', ''))}]"


_HANGUL = ("가", "힣")
_EVERYDAY = (range(0x250), range(0x2000, 0x2070))
_EVERYDAY_LONG = ("ß", "…")
_COMMON_LETTERS = "áéíóúñüçàèâêîôûãõäöëïù"
_PAIR, _ITEM = "\ue000", "\ue001"


def _spaced(text: str) -> str:
    """Without combining marks; white space beyond ASCII becomes a plain space."""
    kept = (ch for ch in text if not unicodedata.combining(ch))
    return "".join(" " if ch.isspace() and ch >= "\x80" else ch for ch in kept)


def _upper_key(ch: str) -> str:
    return _spaced(unicodedata.normalize("NFKD", ch.upper()))


def _casefold_key(ch: str) -> str:
    return _spaced(unicodedata.normalize("NFKD", ch.casefold()))


def _canonical_key(ch: str) -> str:
    text = unicodedata.normalize("NFD", ch)
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


@dataclass(frozen=True)
class FoldTable:
    """Per-code-point rewrite: same length, shorter (dropped) and longer forms."""

    single: dict[str, str]
    dropped: str
    longer: dict[str, str]

    def pairs(self, everyday_only: bool) -> tuple[str, str]:
        """Arguments of ``translate``; characters beyond the second one's length are deleted."""
        kept = [(k, v) for k, v in self.single.items() if not everyday_only or _is_everyday(k)]
        gone = "".join(ch for ch in self.dropped if not everyday_only or _is_everyday(ch))
        return "".join(k for k, _ in kept) + gone, "".join(v for _, v in kept)


def _decomposable() -> list[int]:
    # Planes 3-13 and the CJK extension blocks hold nothing that folds.
    return [
        cp
        for span in (range(0x21, 0xD800), range(0xE000, 0x20000), range(0x2F800, 0x2FA20),
                     range(0xE0100, 0xE01F0))
        for cp in span
        if cp <= sys.maxunicode
    ]


@lru_cache(maxsize=None)
def fold_table(key: Callable[[str], str]) -> FoldTable:
    single, longer, dropped = {}, {}, []
    for cp in _decomposable():
        ch = chr(cp)
        if _HANGUL[0] <= ch <= _HANGUL[1]:
            continue
        folded = key(ch)
        if folded == ch:
            continue
        if not folded:
            dropped.append(ch)
        elif len(folded) == 1:
            single[ch] = folded
        else:
            longer[ch] = folded
    return FoldTable(single, "".join(dropped), longer)


def _is_everyday(ch: str) -> bool:
    return any(ord(ch) in span for span in _EVERYDAY)


@dataclass(frozen=True)
class FoldPlan:
    """Literal arguments of one folding, derived once from its table."""

    common: tuple[tuple[str, str], ...]
    everyday: tuple[str, str]
    beyond_everyday: str
    full: tuple[str, str]
    everyday_longer: tuple[tuple[str, str], ...]
    longer: str
    longer_map: str


_BEYOND_COMMON = f"[^\\x00-\\x7f{_COMMON_LETTERS}{_COMMON_LETTERS.upper()}ß]"


@lru_cache(maxsize=None)
def fold_plan(key: Callable[[str], str]) -> FoldPlan:
    table = fold_table(key)
    cased = _COMMON_LETTERS.upper() if key is _upper_key else _COMMON_LETTERS
    handled = [
        chr(cp)
        for span in _EVERYDAY
        for cp in span
        if chr(cp) not in table.longer or chr(cp) in _EVERYDAY_LONG
    ]
    return FoldPlan(
        common=tuple((ch, key(ch)) for ch in cased + "ß" if key(ch) != ch),
        everyday=table.pairs(everyday_only=True),
        beyond_everyday=f"[^{_class_of(handled)}]",
        full=table.pairs(everyday_only=False),
        everyday_longer=tuple((ch, table.longer[ch]) for ch in _EVERYDAY_LONG if ch in table.longer),
        longer="".join(table.longer),
        longer_map=_PAIR.join(f"{k}{_ITEM}{v}" for k, v in table.longer.items()),
    )


_HANGUL_PARTS = tuple(
    "".join(chr(base + i) for i in range(n)) for base, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
)


def _expand_longer(text: Column, plan: FoldPlan) -> Column:
    """Characters with a longer folded form, one lookup per character.

    Hangul syllables decompose by arithmetic, so they need no table.
    """
    lookup = F.str_to_map(F.lit(plan.longer_map), F.lit(_PAIR), F.lit(_ITEM))
    leads, vowels, tails = (F.split(F.lit(part), "") for part in _HANGUL_PARTS)

    def one(ch: Column) -> Column:
        index = F.ascii(ch) - F.lit(0xAC00)
        tail = F.pmod(index, F.lit(28))
        syllable = F.concat(
            F.get(leads, F.floor(index / 588).cast("int")),
            F.get(vowels, F.floor(F.pmod(index, F.lit(588)) / 28).cast("int")),
            F.when(tail > 0, F.get(tails, (tail - 1).cast("int"))).otherwise(F.lit("")),
        )
        return F.when(ch.between(*_HANGUL), syllable).otherwise(F.coalesce(lookup[ch], ch))

    has_longer = (F.translate(text, plan.longer, "") != text) | text.rlike(f"[{_HANGUL[0]}-{_HANGUL[1]}]")
    expanded = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(has_longer, expanded).otherwise(text)


def _fold(text: Column, key: Callable[[str], str], ascii_case: Callable[[Column], Column]) -> Column:
    plan = fold_plan(key)
    common = ascii_case(text)
    for ch, base in plan.common:
        common = F.replace(common, F.lit(ch), F.lit(base))
    latin = text
    for ch, longer in plan.everyday_longer:
        latin = F.replace(latin, F.lit(ch), F.lit(longer))
    latin = F.translate(latin, *plan.everyday)
    full = _expand_longer(F.translate(text, *plan.full), plan)
    return (
        F.when(F.octet_length(text) == F.char_length(text), ascii_case(text))
        .when(~text.rlike(_BEYOND_COMMON), common)
        .when(~text.rlike(plan.beyond_everyday), latin)
        .otherwise(full)
    )


# --------------------------------------------------------------------------
# White space, blanks, sentinels
# --------------------------------------------------------------------------
def unicode_trim(text: Column) -> Column:
    """Trim every Unicode white space, not only U+0020."""
    return F.trim(text.cast("string"), F.lit(WHITESPACE))


def squeeze(text: Column, whitespace: str = WHITESPACE) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(text, _runs(whitespace), " "))


def non_empty(col: Column) -> Column:
    """Not null and not blank."""
    return col.isNotNull() & (unicode_trim(col) != "")


def is_others(col: Column) -> Column:
    """Trimmed, case-insensitive ``otros``."""
    return F.lower(unicode_trim(col)) == fv.OTHERS_LOWER


def is_empty_category(col: Column) -> Column:
    """Null, blank or one of the "no value" labels (accents are kept)."""
    return F.coalesce(F.lower(unicode_trim(col)).isin(fv.EMPTY_CATEGORIES), F.lit(True))


def is_unique_flag(col: Column) -> Column:
    """Upper-cased flag equals ``SI``; deliberately not trimmed."""
    return F.upper(F.coalesce(col.cast("string"), F.lit(""))) == "SI"


# --------------------------------------------------------------------------
# Folding
# --------------------------------------------------------------------------
def fold_upper(col: Column) -> Column:
    """Comparison key: upper case, no marks, single spaces; null becomes ``""``."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return squeeze(_fold(text, _upper_key, F.upper), _ASCII_WS)


def fold_lower(col: Column) -> Column:
    """Case-folded text without marks, single spaces; null becomes ``""``."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return squeeze(_fold(text, _casefold_key, F.lower), _ASCII_WS)


def strip_marks_lower(col: Column) -> Column:
    """Trimmed lower case without non-spacing marks; inner white space is kept."""
    text = F.lower(unicode_trim(F.coalesce(col, F.lit(""))))
    return _fold(text, _canonical_key, lambda c: c)


def is_present_key(key: Column) -> Column:
    """The folded value holds something and is not a "no value" label."""
    return ~key.isin("", *fv.ABSENT_LABELS)


def is_present(col: Column) -> Column:
    return is_present_key(fold_lower(col))


def joined_present_keys(*keys: Column) -> Column:
    """Folded values that hold something, joined by a bar."""
    return F.concat_ws(" | ", *[F.when(is_present_key(k), k) for k in keys])


# --------------------------------------------------------------------------
# Numbers and labels
# --------------------------------------------------------------------------
def to_number(col: Column) -> Column:
    """Numeric coercion: text that is not a number (NaN included) becomes null."""
    value = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_year(col: Column) -> Column:
    """Whole year, through double so that ``2015.0`` survives."""
    return to_number(col).cast("int")


def thousands(col: Column) -> Column:
    """Whole number with a space every three digits; other text unchanged.

    Numbers are cut to their whole part, text counts only when it is a whole number.
    """
    text = col.cast("string")
    whole = F.when(F.typeof(col) != "string", F.regexp_replace(text, r"\..*$", "")).otherwise(
        F.when(unicode_trim(col).rlike(r"^[+-]?\d+$"), unicode_trim(col))
    )
    label = F.translate(F.format_number(whole.try_cast("decimal(38,0)"), 0), ",", " ")
    return F.coalesce(label, text)


def has_numeric_prefix(col: Column) -> Column:
    return unicode_trim(col).rlike(fv.DATABASE_PREFIX)


def database_name(col: Column) -> Column:
    """Collapse spaces, drop a leading ``12. `` and apply the exact corrections."""
    text = F.regexp_replace(squeeze(col.cast("string")), fv.DATABASE_PREFIX, "")
    return recode(text, fv.DATABASE_NAMES)


PATH_SEPARATOR = " › "


def path_label(*parts: Column | str) -> Column:
    """Hierarchy path ``A › B › C``."""
    return F.concat_ws(
        PATH_SEPARATOR, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def path_leaf(col: Column) -> Column:
    """Text after the last separator (the whole text when there is none)."""
    return F.substring_index(col, PATH_SEPARATOR, -1)


def path_rest(col: Column) -> Column:
    """Text after the first separator (the whole text when there is none)."""
    at = F.instr(col, PATH_SEPARATOR)
    return F.when(at > 0, F.substr(col, at + len(PATH_SEPARATOR))).otherwise(col)


# --------------------------------------------------------------------------
# Recoding
# --------------------------------------------------------------------------
def literal_map(values: dict[str, str]) -> Column:
    text = _PAIR.join(f"{k}{_ITEM}{v}" for k, v in values.items())
    return F.str_to_map(F.lit(text), F.lit(_PAIR), F.lit(_ITEM))


def lookup(col: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """Exact lookup; values that are not listed become ``default`` (null)."""
    found = F.try_element_at(literal_map(values), col)
    return found if default is None else F.coalesce(found, default)


def recode(col: Column, values: dict[str, str]) -> Column:
    """Exact replacement; values that are not listed stay."""
    return lookup(col, values, col)


def otros_if_empty(col: Column) -> Column:
    """Trimmed value, or the public label for blanks."""
    return F.when(non_empty(col), unicode_trim(col)).otherwise(F.lit(fv.OTHERS))
