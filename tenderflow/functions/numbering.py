"""Heading numbers: level, normalised number and bare title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerals import ordinal

# Numbering forms in order of priority, with the level of each.
CN = "一二三四五六七八九十百"
CHAPTER = rf"^第\s*([{CN}]+|\d+)\s*[章编]"
ARTICLE = rf"^第\s*([{CN}]+|\d+)\s*[节条]"
BRACKET = rf"^（[{CN}]+）"
COMMA = "^[一二三四五六七八九十]+、"
THREE = r"^(\d{1,2})\.(\d{1,2})\.(\d{1,2})[^\d.]"
TWO = r"^(\d{1,2})\.(\d{1,2})[^\d.]"
ONE = r"^(\d{1,2})[、．.]\s*\S"
FORMS = ((CHAPTER, 1), (ARTICLE, 2), (BRACKET, 3), (COMMA, 2), (THREE, 4), (TWO, 3), (ONE, 2))


def numbering(text: Column) -> Column:
    """SF-12: struct<level, no> of the first form that fits, null without one."""
    counted = lambda form: F.coalesce(F.nullif(ordinal(F.regexp_extract(text, form, 1)).cast("string"), F.lit("0")), F.regexp_extract(text, form, 1))
    dotted = lambda form, n: F.concat_ws(".", *(F.regexp_extract(text, form, i) for i in range(1, n + 1)))
    numbers = (counted(CHAPTER), counted(ARTICLE), F.lit(""), F.lit(""), dotted(THREE, 3), dotted(TWO, 2), counted(ONE))
    out = F
    for (form, level), no in zip(FORMS, numbers):
        out = out.when(F.rlike(text, F.lit(form)), F.struct(F.lit(level).alias("level"), no.alias("no")))
    return out


def bare_title(text: Column) -> Column:
    """SF-13: the title without its number."""
    out = F
    for form, _ in FORMS:
        out = out.when(F.rlike(text, F.lit(form)), F.regexp_replace(F.regexp_replace(text, form, ""), "^[　 .。、：:]+|[　 .。、：:]+$", ""))
    return out.otherwise(text)


def heading_level(style: Column, text: Column) -> Column:
    """SF-14: the style's level, else the number's, else 0."""
    return F.coalesce(F.nullif(style, F.lit(0)), numbering(text)["level"], F.lit(0))


# Outline number forms, titles without content, and what puts a title in a bucket.
OUTLINE_FORMS = (r"^（[一二三四五六七八九十]+）", r"^[一二三四五六七八九十]+[、.．]", r"^\d+(?:\.\d+)*[、.．]?\s*")
JUNK_TITLE = r"^(不适用|无|/|—|-|＿|_)?[。．.，,：:/\s]*$"
BUCKETS = (("price", "价格|报价|投标函|开标|唱标"), ("commercial", "商务|资格|资质|业绩|财务|信用|证书|承诺|偏差表|保证金|保险"), ("technical", "技术|方案|施工组织|人员配置|服务方案"))


def split_outline_number(title: Column) -> Column:
    """SF-44: struct<no, name>."""
    made = lambda no, name: F.struct(no.alias("no"), name.alias("name"))
    out = F
    for form in OUTLINE_FORMS:
        out = out.when(F.rlike(title, F.lit(form)), made(F.regexp_replace(F.regexp_extract(title, form, 0), "[、.． ]+$", ""), F.trim(F.regexp_replace(title, form, ""))))
    return out.otherwise(made(F.lit(""), title))


def is_junk_title(title: Column) -> Column:
    return F.rlike(title, F.lit(JUNK_TITLE))


def bucket_hint(name: Column) -> Column:
    """SF-44: the first bucket whose words the name has, else null."""
    out = F
    for bucket, words in BUCKETS:
        out = out.when(F.rlike(name, F.lit(words)), bucket)
    return out
