"""Predicates on identifiers, ranges, names and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check-digit weights and signs of the national identity number, organisation suffixes.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_SIGNS = "10X98765432"
SUFFIXES = "有限公司|有限责任公司|股份公司|集团公司|集团|公司|企业|人民政府|委员会|管理局|财政局|教育局|住建局|中心|医院|学院|大学|研究院|研究所|事务所"
AMOUNTS = {"amount": (1.0, 1e10), "deposit": (1e3, 1e9)}
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "100.100.100.200")


def _text(v: Column) -> Column:
    return F.trim(F.coalesce(v, F.lit("")))


def _shaped(v: Column, pattern: str) -> Column:
    return F.rlike(v, F.lit(f"^(?:{pattern})$"))


def id_sign(v: Column) -> Column:
    """The check sign that the first 17 digits ask for."""
    digits = F.transform(F.split(F.substring(v, 1, 17), ""), lambda c: c.try_cast("int"))
    products = F.zip_with(digits, F.array(*map(F.lit, ID_WEIGHTS)), lambda d, w: d * w)
    rest = F.aggregate(products, F.lit(0), lambda a, x: a + x) % 11
    return F.substr(F.lit(ID_SIGNS), rest + 1, F.lit(1))


def is_id_number(v: Column) -> Column:
    """PF-4: shape, date of birth, check sign."""
    t = F.upper(_text(v))
    shape = _shaped(t, r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX]")
    return F.when(shape, F.substring(t, 18, 1) == id_sign(t)).otherwise(False)


def is_organisation(v: Column) -> Column:
    """PF-5."""
    return F.rlike(_text(v), F.lit(f"(?:{SUFFIXES})$"))


def in_range(v: Column, kind: str) -> Column:
    """PF-6: inclusive, by kind of amount."""
    return F.coalesce(v.between(*AMOUNTS[kind]), F.lit(False))


def date_in_window(v: Column, as_of: Column, past: int = 3650, future: int = 1825) -> Column:
    """PF-7: an ISO date within days of `as_of`."""
    day = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
    return F.coalesce(day.between(F.date_sub(as_of, past), F.date_add(as_of, future)), F.lit(False))


def is_credit_code(v: Column) -> Column:
    """PF-8."""
    return _shaped(F.upper(_text(v)), "[0-9A-HJ-NPQRTUWXY]{18}")


def is_phone(v: Column) -> Column:
    """PF-9."""
    return _shaped(_text(v), r"1[3-9]\d{9}|0\d{2,3}-?\d{7,8}(?:-\d{1,5})?")


def is_person_name(v: Column) -> Column:
    """PF-10."""
    return _shaped(_text(v), "[一-龥]{2,4}")


def is_tender_number(v: Column) -> Column:
    """PF-11."""
    t = _text(v)
    return _shaped(t, r"[A-Za-z0-9\-_—－()（）/、.]{4,40}") & F.rlike(t, F.lit("[0-9A-Za-z]"))


def is_public_url(url: Column) -> Column:
    """PF-22: http(s) with a host that is not local, private, reserved or a metadata service."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    octet = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2, 3, 4)]
    a, b, c, _ = octet
    inside = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    sixth = F.rlike(host, F.lit(r"^\[(?:::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]*:.*|ff[0-9a-f]*:.*)\]$"))
    local = host.isin("localhost", *METADATA_HOSTS) | host.endswith(".localhost") | sixth
    return scheme.isin("http", "https") & (host != "") & ~local & ~F.coalesce(inside, F.lit(False))
