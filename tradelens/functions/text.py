"""Text Column functions (X1-X15): normalisation, diacritics, matching,
truncation, keywords and the goods-name shortening rule.

Everything is a built-in expression (``translate``, ``regexp_replace``,
``levenshtein``, higher-order array functions).  NFC has no SQL function in
Spark 4.1; the ICU library of Spark's collations is called for it.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelens.schema import SHORT_NAME_MAX

ColumnOrName = Column | str

# Whitespace runs for Java regexes (Unicode-aware: covers NBSP like JS \s) without
# the lone spaces, which need no replacing and are most of them.
_WS_UNEVEN = r"(?U) \s+|[\s&&[^ ]]\s*"

# Vietnamese lower-case letters with diacritics and their base letter,
# in alphabet order (a, đ, e, i, o, u, y) — 67 characters.
VI_LOWER_ACCENTED = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
VI_LOWER_BASE = "aaaaaaaaaaaaaaaaadeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"

# Letters with a stroke or horn that have no decomposition rule,
# handled before the accent table (đ/Đ plus the Vietnamese base vowels).
VI_SPECIAL_FROM = "đĐăĂâÂêÊôÔơƠưƯ"
VI_SPECIAL_TO = "dDaAaAeEoOoOuU"

# Vietnamese stop words dropped by keyword extraction.
VI_STOP_WORDS = (
    "và", "hoặc", "nhưng", "của", "cho", "với", "từ", "trong", "ngoài", "trên",
    "dưới", "về", "theo", "để", "đến", "đang", "đã", "sẽ", "có", "là",
    "các", "những", "này", "đó", "kia", "một", "hai", "ba",
)

# Break characters tried, in this order, by the name shortener.
SHORTEN_BREAK_CHARS = (",", ";", "-", "(")


def _accent_table() -> tuple[str, str]:
    """Latin letters with accents -> base letter, built by rule.

    For every code point in the Latin-1 Supplement, Latin Extended-A/B and
    Latin Extended Additional blocks whose canonical decomposition starts
    with an ASCII letter, map it to that letter.
    """
    src, dst = [], []
    for block in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for cp in range(*block):
            ch = chr(cp)
            base = unicodedata.normalize("NFD", ch)[0]
            if base != ch and base.isascii() and base.isalpha():
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c: ColumnOrName) -> Column:
    """Every whitespace run -> one space, then trim.

    Collapsing first makes Spark's ``trim`` (which strips only U+0020) act
    like a Unicode-aware trim."""
    return F.trim(F.regexp_replace(_col(c), _WS_UNEVEN, " "))


def remove_diacritics(c: ColumnOrName) -> Column:
    """``Điện Tử`` -> ``Dien Tu`` (case kept)."""
    x = F.translate(_col(c), VI_SPECIAL_FROM, VI_SPECIAL_TO)
    return F.translate(x, ACCENTED, UNACCENTED)


def normalize_text(
    c: ColumnOrName,
    remove_accents: bool = False,
    case_sensitive: bool = False,
    trim_whitespace: bool = True,
) -> Column:
    """Trim + collapse whitespace -> optional diacritics -> lower."""
    x = _col(c)
    if trim_whitespace:
        x = collapse_whitespace(x)
    if remove_accents:
        x = remove_diacritics(x)
    if not case_sensitive:
        x = F.lower(x)
    return x


def normalize_text_py(s: str, remove_accents: bool = False) -> str:
    """Driver-side twin of :func:`normalize_text` for literal filter values."""
    s = " ".join(s.split())
    if remove_accents:
        s = s.translate(str.maketrans(VI_SPECIAL_FROM, VI_SPECIAL_TO))
        s = s.translate(str.maketrans(ACCENTED, UNACCENTED))
    return s.lower()


def strip_vietnamese(c: ColumnOrName) -> Column:
    """Lower-case, then the 67-letter Vietnamese accent map."""
    return F.translate(F.lower(_col(c)), VI_LOWER_ACCENTED, VI_LOWER_BASE)


def _not_composed() -> str:
    """Regex class of the characters whose presence may mean that a text is
    not in NFC: marks, Hangul vowels and finals, and letters that are
    replaced.  Few wide ranges, with others between them, test faster; the
    blocks of letters that never are in the class (Latin with Vietnamese, CJK,
    Hangul syllables) are ruled out before any of them is tried."""
    spans: list[list[int]] = [[0x0300, 0x036F]]
    for code in range(0x0370, sys.maxunicode + 1):
        ch = chr(code)
        jamo = 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2
        if 0xD800 <= code < 0xE000 or not (jamo or unicodedata.category(ch)[0] == "M" or not unicodedata.is_normalized("NFC", ch)):
            continue
        if code - spans[-1][1] < (16 if code < 0x0590 else 64):
            spans[-1][1] = code
        else:
            spans.append([code, code])

    def ranges(of) -> str:
        return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in of)

    # the gaps between the ranges with Latin, Cyrillic, Vietnamese, punctuation, kana, CJK and Hangul
    gaps = [(a[1] + 1, b[0] - 1) for a, b in zip([[0, -1], *spans], spans)]
    usual = [g for g in gaps if any(g[0] <= code <= g[1] for code in (0x0041, 0x0430, 0x1EA0, 0x2019, 0x3042, 0x4E00, 0xAC00))]
    return f"[[^{ranges(usual[:1])}]&&[^{ranges(usual[1:])}]&&[{ranges(spans)}]]"


_NOT_COMPOSED = _not_composed()


def nfc(c: ColumnOrName) -> Column:
    """Unicode composition (NFC) by the ICU library that Spark brings along.

    Rows without a combining mark or the like - nearly all - are returned
    after one regex test.  Spark takes the call for non-deterministic: it can
    stand in any projection or filter, but not in a join condition."""
    x = _col(c)
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(False))
    return F.when(x.rlike(_NOT_COMPOSED), composed).otherwise(x)


def _nfc_start(x: Column, n: int) -> Column:
    """A text whose first ``n`` characters are those of ``nfc(x)``.

    A composed character stands for at most four code points, so ``4 * n`` of
    them give ``n`` characters; the next one must start a character of its own,
    or the whole text is composed."""
    inside = F.coalesce(F.substring(x, 4 * n + 1, 1).rlike(_NOT_COMPOSED), F.lit(False))
    return F.when(inside, nfc(x)).otherwise(nfc(F.substring(x, 1, 4 * n)))


def normalize_vietnamese(c: ColumnOrName, compose: bool = True) -> Column:
    """NFC, trim, collapse whitespace.  ``compose=False`` skips NFC for
    input already known to be composed."""
    x = nfc(c) if compose else _col(c)
    return collapse_whitespace(x)


def searchable_text(c: ColumnOrName, compose: bool = True) -> Column:
    """Normalised, accent-free, lower-case text."""
    return strip_vietnamese(normalize_vietnamese(c, compose))


def fuzzy_match_vietnamese(text: ColumnOrName, query: ColumnOrName, compose: bool = True) -> Column:
    """Accent- and case-insensitive substring test."""
    return F.contains(searchable_text(text, compose), searchable_text(query, compose))


def levenshtein(a: ColumnOrName, b: ColumnOrName, threshold: int | None = None) -> Column:
    """Edit distance; with ``threshold`` Spark stops early and returns -1."""
    if threshold is None:
        return F.levenshtein(_col(a), _col(b))
    return F.levenshtein(_col(a), _col(b), threshold)


def last_index_of(c: Column, ch: str) -> Column:
    """0-based index of the last ``ch`` in ``c``; -1 when absent."""
    pos = F.locate(ch, F.reverse(c))
    return F.when(pos == 0, F.lit(-1)).otherwise(F.length(c) - pos)


def truncate_at_word(c: ColumnOrName, max_length: int, suffix: str = "...", compose: bool = True) -> Column:
    """Cut at ``max_length``; back up to the last space when it lies
    beyond 80 % of the limit; append ``suffix``.  Text within the limit is
    returned unchanged; NFC is applied before cutting unless ``compose`` is off."""
    x = _col(c)
    src = _nfc_start(x, max_length) if compose else x

    def shortened(cut: Column) -> Column:
        last_space = last_index_of(cut, " ")
        return F.when(
            last_space > max_length * 0.8,
            F.concat(F.substring(cut, F.lit(1), last_space), F.lit(suffix)),
        ).otherwise(F.concat(cut, F.lit(suffix)))

    # bound as a lambda's variable: the cut text is made once, not at every mention
    cut = F.transform(F.array(F.substring(src, 1, max_length)), shortened)[0]
    return F.when(F.length(x) <= max_length, x).otherwise(cut)


def capitalize_words(c: ColumnOrName) -> Column:
    """First letter of each space-separated word upper-cased with the
    full case mapping (``ß`` -> ``SS``), the rest lower-cased.

    ``initcap`` is not used: it title-cases ``ß`` as ``Ss``."""
    words = F.split(_col(c), " ")
    cap = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1))))
    return F.array_join(cap, " ")


def keywords(c: ColumnOrName, min_length: int = 3, compose: bool = True) -> Column:
    """``array<string>`` of lower-cased words of at least ``min_length``
    characters that are not stop words."""
    words = F.split(F.lower(normalize_vietnamese(c, compose)), " ")  # single spaces are all that is left
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*VI_STOP_WORDS))


def collate_vietnamese(c: ColumnOrName, collation: str = "vi_CI_AI") -> Column:
    """A collated copy of ``c`` for ordering/comparison.

    ``vi_CI_AI`` equates case and tone marks but keeps the letters of the
    Vietnamese alphabet apart (ô after o, ``Tôm`` <> ``TOM``); pass ``vi_CI`` to
    tell tones apart too."""
    return F.collate(_col(c), collation)


def shorten_name(c: ColumnOrName, max_length: int = SHORT_NAME_MAX) -> Column:
    """X11: fallback goods-name shortening.

    Names up to ``max_length`` stay.  Otherwise the first of ``, ; - (``
    (tried in that order) whose first occurrence lies at 0-based index
    21..max_length-1 cuts the name there (trimmed); failing that, the first
    ``max_length - 3`` characters plus ``...``.
    """
    x = _col(c)
    out = F.concat(F.substring(x, 1, max_length - 3), F.lit("..."))
    for ch in reversed(SHORTEN_BREAK_CHARS):
        idx = F.instr(x, ch) - 1
        out = F.when((idx > 20) & (idx < max_length), F.trim(F.substring(x, F.lit(1), idx))).otherwise(out)
    return F.when(F.length(x) <= max_length, x).otherwise(out)


def shortening_metrics(original: ColumnOrName, short: ColumnOrName) -> Column:
    """struct(original_length, short_length, compression_ratio)."""
    o, s = F.length(_col(original)), F.length(_col(short))
    return F.struct(
        o.alias("original_length"),
        s.alias("short_length"),
        F.when(o > 0, s / o).alias("compression_ratio"),
    )


# A category named in free text after the word "category".
_CATEGORY_TEXT = r"(?iu)category[:\s]+[\"']?([\p{L}\p{M}\p{N}_\s&]+)"
_CLASSIFICATION_JSON = "category string, confidence double, reasoning string"


def parse_classification(c: ColumnOrName, default_category: str = "Khác") -> Column:
    """Model text -> struct(category, confidence, reasoning).

    The greedy ``{...}`` span is parsed as JSON; falsy fields take defaults
    (``Khác``, 0.5, ``''``).  Without valid JSON, a ``category: X`` phrase is
    used with confidence 0.5, else the default category.
    """
    x = _col(c)
    blob = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(blob != "", blob), _CLASSIFICATION_JSON, {"mode": "PERMISSIVE"})
    # A span that is not valid JSON reads back as NULL from get_json_object.
    has_json = (blob != "") & F.coalesce(F.get_json_object(blob, "$").isNotNull(), F.lit(False))
    text_cat = F.trim(F.regexp_extract(x, _CATEGORY_TEXT, 1))
    category = F.when(
        has_json,
        F.when(F.coalesce(parsed["category"], F.lit("")) != "", parsed["category"]).otherwise(F.lit(default_category)),
    ).otherwise(F.when(text_cat != "", text_cat).otherwise(F.lit(default_category)))
    confidence = F.when(
        has_json,
        F.when(F.coalesce(parsed["confidence"], F.lit(0.0)) != 0, parsed["confidence"]).otherwise(F.lit(0.5)),
    ).otherwise(F.lit(0.5))
    reasoning = F.when(has_json, F.coalesce(parsed["reasoning"], F.lit(""))).otherwise(F.lit("Parsed from text response"))
    return F.struct(category.alias("category"), confidence.alias("confidence"), reasoning.alias("reasoning"))


def clean_short_name(c: ColumnOrName, max_length: int = SHORT_NAME_MAX) -> Column:
    """U2 helper: first line of a model answer, outer quotes removed, capped
    at ``max_length`` (97 + ``...``); NULL when under 3 characters."""
    x = F.trim(_col(c))
    x = F.regexp_replace(x, r"^[\"']|[\"']$", "")
    x = F.trim(F.regexp_replace(x, r"\n(?s).*", ""))
    x = F.when(F.length(x) > max_length, F.concat(F.substring(x, 1, max_length - 3), F.lit("..."))).otherwise(x)
    return F.when(F.length(x) >= 3, x)
