"""Secret scans: keyword prefilter, anchored expressions near hits, checksum validation.

An Aho-Corasick automaton finds every keyword of a text in one pass. Only at a hit is the
expression of its kind matched, anchored there. Hits are taken in order and one that lies in an
earlier match of its kind is skipped, which gives the leftmost non-overlapping matches of a scan
with the whole expression, as each of them starts with a keyword. Runs of hex digits have no
keyword and are found by their shape. Tokens that embed a CRC-32 are kept only if it holds.

Kinds, in order: assign, access, hex; then github and npm, with checksum. Spans are code points,
end exclusive.

Edge cases: a null text is empty; an empty text has no spans; repeated rows each give a row; an
empty table gives an empty result; columns other than doc_id and text are ignored by the scan.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[oprsu]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
GITHUB_WORDS = ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {a: a + 32 for a in range(ord("A"), ord("Z") + 1)}
MASK = "[secret]"


def checksum_holds(token: str) -> bool:
    """The last six digits are the CRC-32 of the thirty before them, in base 62."""
    body, sent = token[4:34], token[34:]
    value = 0
    for c in sent:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", GITHUB_WORDS), ("npm", ("npm_",))):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


#: Kind: anchored expression, and what a match must satisfy to be kept.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, lambda m: checksum_holds(m[0])),
    "npm": (NPM, lambda m: checksum_holds(m[0])),
}


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every secret, sorted."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer
        lowered = text.translate(LOWER)
    spans = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    free = dict.fromkeys(RULES, 0)
    for last, (kind, length) in automaton().iter(lowered):
        start = last + 1 - length
        if start < free[kind]:
            continue
        expression, holds = RULES[kind]
        m = expression.match(text, start)
        if m:
            free[kind] = m.end()
            if holds(m):
                spans.append((start, KINDS.index(kind), m.end()))
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found, array<struct<kind, start, end>>, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in find_spans(t or "")] for t in batch["text"].to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "found"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def mask_text(text: str) -> str:
    """The text with each run of overlapping secrets replaced by MASK."""
    out, at, open_to = [], 0, -1
    for start, _, end in find_spans(text):
        if start >= open_to:
            out += [text[at:start], MASK]
            open_to = end
        open_to = max(open_to, end)
        at = open_to
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns, secrets replaced in `column`; null stays null."""
    read = docs.withColumn(column, F.col(column).cast("string"))
    at = read.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            masked = pa.array([None if t is None else mask_text(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], masked, *batch.columns[at + 1 :]], batch.schema.names)

    return read.mapInArrow(run, read.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def digest(text: str) -> dict:
    """The same columns for one text, for the tests."""
    spans = find_spans(text)
    show = lambda some: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in some)
    return {"base_sha256": hashlib.sha256(show([s for s in spans if s[1] < BASE]).encode()).hexdigest(), "spans": show(spans)}
