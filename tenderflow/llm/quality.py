"""Quality rules on repetition inside a text, from a suffix array over its words.

Words are numbered, and ranks of windows of 1, 2, 4, 8, ... words are made by sorting pairs of
ranks, each from the last, until every suffix that repeats MIN_REPEAT words or more stands alone.
The ranks give the suffix array of those suffixes and, by lifting over the same windows, the
longest common prefixes of its neighbours; in texts of over LONG words, whose windows would take
too much memory, one pass in the order of the text gives them instead. A suffix's deepest prefix interval is the longest
repeat that starts there; those that no longer one contains are the maximal repeats. Their spans
are united. A text fails if the union covers too large a part of it, or one repeat is too long.

Plain rules come first: too few words, or too many words in repeated five-word windows.

Each text is judged alone, in the task that reads it: no shuffle. Edge cases: a null text has no
words and fails; repeated rows each give a row; an empty table gives an empty result; columns
other than doc_id and text are ignored, and `keep_good` returns them all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

WINDOW = 5
MIN_REPEAT = 8
MIN_WORDS = 10
MAX_WINDOW_PERCENT = 20
MAX_COVERED_PERCENT = 20
MAX_LONGEST = 100
LONG = 1 << 20
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeated(ranks: np.ndarray) -> np.ndarray:
    """Whether each rank occurs more than once."""
    return np.bincount(ranks)[ranks] > 1 if len(ranks) else np.zeros(0, bool)


def union_size(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """How many of n places the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def padded(ids: np.ndarray) -> np.ndarray:
    """The ids and, after them, others that occur once, so each word starts a window of MIN_REPEAT."""
    return np.append(ids, int(ids.max(initial=0)) + np.arange(1, MIN_REPEAT))


def window_ranks(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Ranks of all windows of 1, 2, 4, ... words, up to `most`."""
    ranks, h = [ids], 1
    while 2 * h <= min(most, len(ids)):
        ranks.append(paired(ranks[-1][:-h], ranks[-1][h:]))
        h *= 2
    return ranks


def shared_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix in `order` but the first shares with the one before it. In the order
    of the text a suffix shares at most one word less than the suffix a word earlier did, as long
    as what is left is a window that `order` is about."""
    n, before, shared = len(ids), np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    before[order[1:]] = order[:-1]
    words, earlier, out = memoryview(ids), memoryview(before), memoryview(shared)
    h, last = 0, -2
    for i in memoryview(np.sort(order)):
        j = earlier[i]
        h = h - 1 if i == last + 1 and j >= 0 and h > MIN_REPEAT else 0
        last = i
        if j >= 0:
            while max(i, j) + h < n and words[i + h] == words[j + h]:
                h += 1
            out[i] = h
    return shared[order[1:]]


def maximal_repeats(ids: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeats of MIN_REPEAT words and more.

    `levels` are the window ranks up to MIN_REPEAT, a power of two, of the `padded` ids. Only suffixes whose first
    window repeats are refined and sorted; every other suffix shares fewer words with any.
    """
    none = np.zeros(0, np.int64)
    if len(ids) <= MIN_REPEAT or not (at := np.flatnonzero(repeated(levels[-1]))).size:
        return none, none
    n, h = len(ids), MIN_REPEAT
    rank = np.append(levels[-1], levels[-1].max() + 1)  # the end comes after all, as in the padded text
    long = n > LONG
    lifted = [] if long else [(1 << k, np.append(x[:n], -1)) for k, x in enumerate(levels)]
    order = at
    while True:  # refine the buckets that still hold several suffixes by the bucket h words on
        order = order[np.lexsort((rank[np.minimum(order + h, n)], rank[order]))]
        first, second = rank[order], rank[np.minimum(order + h, n)]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        if new.all():
            break
        base = np.int64(n + 1) * 2
        fresh = rank * base  # order between buckets stays
        fresh[order] += np.cumsum(new)
        rank = np.unique(fresh, return_inverse=True)[1].astype(np.int64)
        h *= 2
        if not long:
            lifted.append((h, rank.copy()))
    a, b, lcp = order[:-1].copy(), order[1:].copy(), shared_prefixes(ids, order) if long else np.zeros(len(order) - 1, np.int64)
    for h, ranks in reversed(lifted):
        same = ranks[np.minimum(a, n)] == ranks[np.minimum(b, n)]
        lcp[same] += h
        a[same] += h
        b[same] += h
    deepest = np.maximum(np.concatenate([[0], lcp]), np.concatenate([lcp, [0]]))
    length = np.zeros(n + 1, np.int64)
    length[order] = deepest
    kept = order[(deepest >= MIN_REPEAT) & (length[order - 1] <= deepest)]  # not the tail of a longer repeat
    return kept, length[kept]


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of a text."""
    words = text.encode().split()
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(SPACES):
            seen.add(line)
    n = len(words)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    levels = window_ranks(padded(ids), MIN_REPEAT)
    again = np.zeros(0, np.int64)
    if n >= WINDOW:
        again = np.flatnonzero(repeated(paired(levels[2][:-1], levels[2][1:])))
    starts, lengths = maximal_repeats(ids, levels)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        union_size(again, np.full(len(again), WINDOW), n),
        union_size(starts, lengths, n),
        int(lengths.max(initial=0)),
    )


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """`row`, a struct of the named columns (doc_id by default), and the measures of its text."""
    row = F.struct(*(columns or ("doc_id",))).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            text = batch["text"] if "text" in batch.schema.names else batch["row"].field("text")
            rows = [measure(t or "") for t in text.to_pylist()]
            made = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch["row"], *made], ["row", *MEASURES])

    read = docs.select(row) if "text" in columns else docs.select(row, "text")
    return read.mapInArrow(run, ", ".join([f"row {read.schema['row'].dataType.simpleString()}", *(f"{m} long" for m in MEASURES)]))


def base_failed():
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_WINDOW_PERCENT * n)


def repeats_too_much():
    return (100 * F.col("n_covered_words") > MAX_COVERED_PERCENT * F.col("n_words")) | (F.col("longest_repeat") > MAX_LONGEST)


def judged(docs: DataFrame, *columns: str) -> DataFrame:
    return measured(docs, *columns).withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | repeats_too_much()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judged(docs, *docs.columns).filter("kept").select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
w5 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS c FROM places WHERE i + 4 <= len(w)),
w8 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS c FROM places WHERE i + 7 <= len(w)),
w101 AS (SELECT doc_id, max(c) AS c FROM (
  SELECT doc_id, count(*) AS c FROM places WHERE i + 100 <= len(w) GROUP BY doc_id, md5(array_to_string(w[i:i+100], ' '))) GROUP BY doc_id),
cover5 AS (SELECT doc_id, count(DISTINCT i + k) AS r5 FROM w5, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
cover8 AS (SELECT doc_id, count(DISTINCT i + k) AS r8 FROM w8, (SELECT unnest(range(8)) AS k) WHERE c > 1 GROUP BY doc_id), lines AS (
  SELECT doc_id, sum(c - 1) AS dup FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r5, 0)::BIGINT AS n_repeat_words,
    coalesce(r8, 0)::BIGINT AS n_covered_words, coalesce(w101.c, 0) > 1 AS long_repeat
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cover5 USING (doc_id) LEFT JOIN cover8 USING (doc_id) LEFT JOIN w101 USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_covered_words > 20 * n_words OR long_repeat) AS kept
FROM m
"""
