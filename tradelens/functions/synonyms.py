"""Synonym groups and the synonym predicate.

Two values are synonyms when both fall in the same variant group, where
"falls in" means equal to a variant **or a substring of it in either
direction** after normalisation (``reference`` mode).  ``exact`` mode keeps
only equality.  For a literal filter value the matching groups are chosen
on the driver (the table is a handful of strings), and the Column side is a
small OR of ``=``/``contains`` tests that stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelens.functions.text import normalize_text, normalize_text_py

# Default synonym groups, canonical name -> variants.
COUNTRY_SYNONYMS = {
    "United States": ["US", "USA", "United States", "Hoa Kỳ", "America", "U.S.", "U.S.A"],
    "Vietnam": ["VN", "Vietnam", "Việt Nam", "VNM"],
    "China": ["CN", "China", "Trung Quốc", "CHN", "PRC"],
    "Japan": ["JP", "Japan", "Nhật Bản", "JPN"],
    "Korea": ["KR", "Korea", "Hàn Quốc", "South Korea", "ROK"],
    "Germany": ["DE", "Germany", "Đức", "DEU"],
    "United Kingdom": ["UK", "United Kingdom", "Anh", "GB", "Britain", "Great Britain"],
}
COMPANY_SYNONYMS = {
    "CÔNG TY": ["CÔNG TY", "Cty", "CTY", "Co.", "Company", "COMPANY"],
}
DEFAULT_SYNONYMS = {**COUNTRY_SYNONYMS, **COMPANY_SYNONYMS}


def merged_groups(extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Default groups overlaid with the caller's (a caller key replaces a default)."""
    return {**DEFAULT_SYNONYMS, **(extra or {})}


def _in_group_py(value: str, variants: list[str], mode: str) -> bool:
    if mode == "exact":
        return value in variants
    return any(v == value or v in value or value in v for v in variants)


def synonyms_py(a: str, b: str, extra: dict[str, list[str]] | None = None, mode: str = "reference") -> bool:
    """Driver-side reference of the predicate, used for tests and planning."""
    na, nb = normalize_text_py(a), normalize_text_py(b)
    if na == nb:
        return True
    for variants in merged_groups(extra).values():
        norm = [normalize_text_py(v) for v in variants]
        if _in_group_py(na, norm, mode) and _in_group_py(nb, norm, mode):
            return True
    return False


def synonym_match(
    c: Column, value: str, extra: dict[str, list[str]] | None = None, mode: str = "reference", normalized: bool = False
) -> Column:
    """P19 for a column against a literal: boolean Column (NULL-safe false).

    ``normalized=True`` says ``c`` already holds ``normalize_text`` output."""
    if mode not in ("reference", "exact"):
        raise ValueError(f"unknown synonym mode {mode!r}")
    norm_value = normalize_text_py(value)
    field = c if normalized else normalize_text(c)
    conds = [field == F.lit(norm_value)]
    for variants in merged_groups(extra).values():
        norm = sorted({normalize_text_py(v) for v in variants})
        if not _in_group_py(norm_value, norm, mode):
            continue
        if mode == "exact":
            conds.append(field.isin(*norm))
        else:
            for v in norm:
                conds.append((field == F.lit(v)) | F.contains(field, F.lit(v)) | F.contains(F.lit(v), field))
    out = conds[0]
    for cond in conds[1:]:
        out = out | cond
    return F.coalesce(out, F.lit(False))
