"""Text functions: comparison forms, placeholders, sentences, keywords, loose JSON, html rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation folded for comparison, zero-width characters, placeholder values, ends of sentences, labels inside values.
WIDE, NARROW = "，：；（）［］　", ",:;()[] "
INVISIBLE = r"(?U)[\s​‌‍﻿]+"
PLACEHOLDERS = ("无", "暂无", "略", "详见", "见附件", "见招标公告", "见投标人须知前附表", "见前附表", "详见附件", "详见下表", "详见第五章", "/", "—", "-", "无要求")
SENTENCE_END = r"[。；;\n]"
SUB_LABELS = "名称|项目名称|工程名称|金额|大写"


def compare_form(v: Column) -> Column:
    """SF-1: narrow punctuation, small letters, no white space."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(v, F.lit("")), WIDE, NARROW)), INVISIBLE, "")


def is_placeholder(v: Column) -> Column:
    """PF-2."""
    return compare_form(v).isin(*PLACEHOLDERS)


def diversity(v: Column) -> Column:
    """PF-3: distinct characters over characters; 0 for blank text."""
    dense = F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)\s", "")
    return F.when(dense == "", 0.0).otherwise(F.size(F.array_distinct(F.split(dense, ""))) / F.length(dense))


def is_meaningful(v: Column) -> Column:
    return (F.coalesce(v, F.lit("")) != "") & ~is_placeholder(v) & (diversity(v) >= 0.3)


def squeeze_ocr_spaces(v: Column) -> Column:
    """SF-8: no spaces between letters, digits and hyphens."""
    return F.regexp_replace(v, r"(?<=[A-Za-z0-9-])[  ]+(?=[A-Za-z0-9-])", "")


def number_text(v: Column) -> Column:
    """SF-9: whole numbers without decimals."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def strip_sub_label(v: Column) -> Column:
    """SF-10: without a leading sub-label and outer brackets."""
    bare = F.regexp_replace(F.trim(v), f"^(?:{SUB_LABELS})\\s*[：:]\\s*", "")
    return F.trim(F.regexp_replace(bare, "^[（()）]+|[（()）]+$", ""))


def sentences(v: Column) -> Column:
    """SF-15: trimmed sentences of four characters or more."""
    return F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) >= 4)


def contained(words, text: Column) -> Column:
    """SF-26: those of the words that the text contains, in the words' order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def dense(v: Column) -> Column:
    """SF-53: without white space."""
    return F.regexp_replace(v, r"(?U)\s+", "")


def half_digits(v: Column) -> Column:
    """SF-54: narrow digits."""
    return F.translate(F.coalesce(v, F.lit("")), "０１２３４５６７８９", "0123456789")


def extension(path: Column) -> Column:
    """SF-55: the small-letter extension of a path or URL, "" without one."""
    name = F.regexp_extract(path, r"([^/?#\\]*)(?:[?#].*)?$", 1)
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def loose_json(v: Column) -> Column:
    """SF-48: the text if it is JSON, else its outermost {...} or [...] if that is, else null."""
    span = F.regexp_extract(v, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.when(F.try_parse_json(v).isNotNull(), v), F.when(F.try_parse_json(span).isNotNull(), span))


def html_rows(html: Column) -> Column:
    """SF-17: array of rows, each an array of its cells' text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))


def quote_at(quote: Column, text: Column) -> Column:
    """SF-49: 1-based place of a quote in a text, white space aside; 0 if it is not there."""
    return F.instr(dense(text), dense(quote))


def quote_prefix_at(quote: Column, text: Column, n: int = 15) -> Column:
    """SF-50: 1-based place of the quote's first n characters in a text as it is; 0 if they are not there."""
    return F.when(F.length(quote) > 0, F.instr(text, F.substring(quote, 1, n))).otherwise(0)


def around(text: Column, place: Column, length: Column, reach: int = 120) -> Column:
    """WN-13: what surrounds a span, with the span's offset in it."""
    start = F.greatest(place - reach, F.lit(1))
    cut = F.substr(text, start, place - start + length + reach)
    return F.struct(cut.alias("context"), (place - start).alias("offset"))
