"""Rules as data: field packs, cell labels and zone words as rows of a stored, versioned table.

Rules are few (at most MOST rows are taken) and belong to the plan: a version is read on the driver,
checked, and compiled into the expressions of one pass over the blocks. Adding a field, a pattern
or a zone is adding rows.

A pack has a row for each pattern; rows of one field agree in kind, words, squeeze and zones.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .. import commits
from ..functions.packs import LABELS, PACKS, Pack, Pattern
from .structure import ZONE_WORDS

SCHEMA = "rule string, field_key string, kind string, words string, squeeze boolean, zones array<string>, place int, confidence double, regex string"
MOST = 10_000
KINDS = ("amount", "contact", "credit", "date", "duration", "number", "org", "person", "text")
FLAGS = "(?mdU)"


class Row(NamedTuple):
    """rule is `pack`, `label` or `zone`; a zone's field_key is its name, its regex a plain word."""

    rule: str
    field_key: str
    kind: str | None = None
    words: str | None = None
    squeeze: bool | None = None
    zones: list[str] | None = None
    place: int = 0
    confidence: float | None = None
    regex: str | None = None


@dataclass(frozen=True)
class Rules:
    packs: dict[str, Pack] = field(default_factory=lambda: PACKS)
    labels: dict[str, str] = field(default_factory=lambda: LABELS)
    zones: dict[str, tuple[str, ...]] = field(default_factory=lambda: ZONE_WORDS)

    def rows(self) -> list[Row]:
        packs = [Row("pack", k, p.kind, p.words, p.squeeze, list(p.zones), i, x.confidence, x.regex) for k, p in self.packs.items() for i, x in enumerate(p.patterns)]
        labels = [Row("label", k, regex=label) for k, label in self.labels.items()]
        return [*packs, *labels, *(Row("zone", z, place=i, regex=w) for z, ws in self.zones.items() for i, w in enumerate(ws))]


BUILT_IN = Rules()


class RuleError(ValueError):
    """What is wrong with which rows."""

    def __init__(self, problems: list[tuple[str, str, int, str]]):
        super().__init__("; ".join(f"{rule} {key} {place}: {what}" for rule, key, place, what in problems))
        self.problems = problems


def _groups(spark: SparkSession, regex: str) -> int | None:
    """Groups of a pattern as Spark's expressions read it; None if it is none."""
    pattern = spark.sparkContext._jvm.java.util.regex.Pattern
    try:
        return pattern.compile(regex).matcher("").groupCount()
    except Exception:
        return None


def problems(spark: SparkSession, rows: Iterable[Row]) -> list[tuple[str, str, int, str]]:
    """rule, field_key, place and what is wrong, of each row that cannot be used."""
    rows, found, kinds, seen = list(rows), [], {}, set()
    zones = {r.field_key for r in rows if r.rule == "zone"}

    def wrong(r: Row, what: str) -> None:
        found.append((r.rule, r.field_key or "", r.place or 0, what))

    for r in rows:
        if r.rule not in ("pack", "label", "zone") or not r.field_key or not r.regex:
            wrong(r, "rule, key or pattern is missing")
            continue
        if (r.rule, r.field_key, r.place) in seen:
            wrong(r, "place is taken")
        seen.add((r.rule, r.field_key, r.place))
        if r.rule == "label" and _groups(spark, r.regex) is None:
            wrong(r, "pattern does not compile")
        if r.rule == "pack":
            groups = _groups(spark, FLAGS + r.regex)
            if groups is None:
                wrong(r, "pattern does not compile")
            elif not groups:
                wrong(r, "pattern has no group for the value")
            if not r.words or _groups(spark, r.words) is None:
                wrong(r, "words do not compile")
            if r.kind not in KINDS:
                wrong(r, f"kind is none of {', '.join(KINDS)}")
            if r.confidence is None or not 0 < r.confidence <= 1:
                wrong(r, "confidence is not in (0, 1]")
            if set(r.zones or ()) - zones:
                wrong(r, "zones are not known")
            if kinds.setdefault(r.field_key, (r.kind, r.words, bool(r.squeeze), tuple(r.zones or ()))) != (r.kind, r.words, bool(r.squeeze), tuple(r.zones or ())):
                wrong(r, "differs from the field's other rows")
    fields = {r.field_key for r in rows if r.rule == "pack"}
    for r in rows:
        if r.rule == "label" and r.field_key and r.field_key not in fields:
            wrong(r, "field has no pack")
    return found


def compiled(spark: SparkSession, rows: Iterable[Row]) -> Rules:
    """The rules of the rows; RuleError if one cannot be used."""
    rows = sorted(rows, key=lambda r: r.place or 0)
    if wrong := problems(spark, rows):
        raise RuleError(wrong)
    packs: dict[str, Pack] = {}
    for r in rows:
        if r.rule == "pack":
            old = packs.get(r.field_key)
            packs[r.field_key] = Pack(r.kind, r.words, (*(old.patterns if old else ()), Pattern(r.confidence, r.regex)), tuple(r.zones or ()), bool(r.squeeze))
    zones: dict[str, tuple[str, ...]] = {}
    for r in rows:
        if r.rule == "zone":
            zones[r.field_key] = (*zones.get(r.field_key, ()), r.regex)
    return Rules(packs, {r.field_key: r.regex for r in rows if r.rule == "label"}, zones)


def frame(spark: SparkSession, rows: Iterable[Row]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def store(rows: DataFrame, path: str) -> int:
    """Check the rows and commit them as the next version; its number."""
    spark = rows.sparkSession
    compiled(spark, _taken(rows))
    name = commits.fresh()
    rows.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(f"{path}/rules/{name}")
    return commits.append(spark, path, name)


def load(spark: SparkSession, path: str, version: int | None = None) -> Rules:
    """One version of the stored rules, the latest by default."""
    found = commits.versions(spark, path)
    wanted = max(found, default=0) if version is None else version
    if wanted not in found:
        raise FileNotFoundError(f"no version {wanted} in {path}")
    return compiled(spark, _taken(spark.read.schema(SCHEMA).parquet(f"{path}/rules/{found[wanted]}")))


def _taken(rows: DataFrame) -> list[Row]:
    taken = rows.select(*Row._fields).limit(MOST + 1).collect()
    if len(taken) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return [Row(*r) for r in taken]
