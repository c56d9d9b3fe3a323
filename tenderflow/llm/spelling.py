"""Grouping of spelling variants by full neighbourhood generation.

Each word's neighbourhood is all strings one edit away: its distinct deletions, replacements and
insertions over the alphabet that the vocabulary shows. A string of the neighbourhood that is itself
a word is a near word; the hash join with the vocabulary finds them, and no distance is computed.

A neighbourhood has some 2 * length * letters strings, near a thousand a word, of which few are
words. So strings are generated as 64-bit sums (letter codes times powers of an odd base) from
prefix and suffix sums of many equally long words at once, and only those that a Bloom filter of the
vocabulary's sums lets through become strings and rows of the join, which compares the strings
themselves: the filter loses none and decides none. It has BITS_A_WORD bits a word, FILTER_BITS
at most (32 MB; then it lets more through).

Counting happens in the scans: a task sums up to HELD words before it sends them on, so a word of a
third of all running text is a few rows. Forms lead to more frequent words, so chains end; roots
come from pointer doubling over the words that have a form.

Edge cases: a null or empty text has no words; a null id counts as the empty string before the colon;
repeated rows count as often as they stand there; an empty table gives an empty result; texts of any
length are read whole; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
DOMINANCE = 10
ONE_IN = 31
HELD = 1 << 18
BITS_A_WORD = 48
FILTER_BITS = 1 << 28
LEAST_BITS = 1 << 16
ROWS = 1 << 10
#: An odd base of the sums, its inverse, and mixing factors of the filter's two bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def noisy_words(doc_id: int | None, text: str, least: int, one_in: int) -> Iterator[tuple[str, int]]:
    """The words of a text and how often each stands there; some lose a letter, as the checksum of
    document and word says."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    small = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    for run, n in Counter(RUN.findall(small)).items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), head)
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                yield run, n


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, one_in: int = ONE_IN, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        sent = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                for word, n in noisy_words(doc_id, text.as_py() or "", least, one_in):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield sent()
                    held.clear()
        yield sent()

    counted = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


@dataclass(frozen=True)
class Alphabet:
    """Letters by code point, sorted, and a random code for each."""

    letters: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, letters: list[str]) -> Alphabet:
        points = np.array(sorted(map(ord, letters)), np.uint32)
        return cls(points, np.random.default_rng(11).integers(0, 1 << 64, len(points), np.uint64))


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(BASE)
    return np.multiply.accumulate(out)


def by_length(words: list[str], alphabet: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equally long words, ROWS at most, and their letters' numbers, a word a row."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        for at in np.array_split(np.flatnonzero(lengths == n), -(-(lengths == n).sum() // ROWS)):
            points = np.array([words[i] for i in at], f"U{n}").view(np.uint32).reshape(len(at), n)
            yield at, np.searchsorted(alphabet.letters, points)


def filter_bits(sums: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of a sum's bits in a filter of `size` bits, a power of two."""
    for factor in MIX:
        mixed = (sums ^ (sums >> np.uint64(32))) * factor
        yield mixed >> np.uint64(65 - size.bit_length())


def held_in(bits: np.ndarray, sums: np.ndarray, size: int) -> np.ndarray:
    """Places in the flat sums of those that the filter may hold."""
    at = np.arange(sums.size)
    sums = sums.ravel()
    for k in range(len(MIX)):
        bit = [*filter_bits(sums[at], size)][k] if k else next(filter_bits(sums, size))
        at = at[(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def neighbourhood(letters: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The sums of all strings one edit from equally long words, by kind of edit, and which count, as
    a string that several edits give counts at its last place. Axes: word, place, letter."""
    rows, n = letters.shape
    power, every = powers(n + 1), np.arange(len(alphabet.letters))
    terms = alphabet.codes[letters] * power[:n]
    before = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    after = before[:, -1:] - before  # the terms from a place on
    last = np.ones((rows, n), bool)
    last[:, :-1] = letters[:, 1:] != letters[:, :-1]
    yield "delete", before[:, :-1] + after[:, 1:] * np.uint64(INVERSE), last
    other = letters[:, :, None] != every
    yield "replace", (before[:, -1:] - terms)[:, :, None] + power[:n, None] * alphabet.codes, other
    fresh = np.ones((rows, n + 1, len(every)), bool)
    fresh[:, :-1] = other
    yield "insert", (before + after * np.uint64(BASE))[:, :, None] + power[:, None] * alphabet.codes, fresh


def edited(word: str, kind: str, at: int, letter: str) -> str:
    return word[:at] + ("" if kind == "delete" else letter) + word[at + (kind != "insert") :]


def word_filter(words: DataFrame, alphabet: Alphabet, size: int) -> np.ndarray:
    """The Bloom filter of the words' sums, size / 8 bytes. Spark gathers it, 64 bits a row."""
    held = words.sparkSession.sparkContext.broadcast(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in by_length(batch["word"].to_pylist(), held.value):
                sums = (held.value.codes[letters] * powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*filter_bits(sums, size)]).astype(np.int64))], ["bit"])

    bits = words.select("word").mapInArrow(run, "bit long")
    slots = bits.groupBy(F.expr("bit div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, "<i8")
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return out.view(np.uint8)


def candidates(words: DataFrame, alphabet: Alphabet, bits: np.ndarray) -> DataFrame:
    """word and near: the strings of each word's neighbourhood that the filter lets through."""
    held = words.sparkSession.sparkContext.broadcast((alphabet, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, bits = held.value
        names = [*map(chr, alphabet.letters)]
        for batch in batches:
            words = batch["word"].to_pylist()
            for at, letters in by_length(words, alphabet):
                source, near = [], []
                for kind, sums, counts in neighbourhood(letters, alphabet):
                    some = held_in(bits, sums, 8 * len(bits))
                    some = some[counts.ravel()[some]]
                    row, place, *letter = np.unravel_index(some, sums.shape)
                    for i, p, a in zip(at[row].tolist(), place.tolist(), letter[0].tolist() if letter else [0] * len(row)):
                        source.append(words[i])
                        near.append(edited(words[i], kind, p, names[a]))
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(near, pa.string())], ["word", "near"])

    return words.select("word").mapInArrow(run, "word string, near string")


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n for all pairs of words one edit apart, from either side."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").distinct()
    seen = [r.letter for r in letters.collect()]  # at most the letters of RUN
    if not seen:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    alphabet = Alphabet.of(seen)
    size = max(LEAST_BITS, min(FILTER_BITS, 1 << (BITS_A_WORD * words.count()).bit_length()))
    found = candidates(words, alphabet, word_filter(words, alphabet, size))
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of the forms from word on, for the words that have a form."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialise(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, one_in: int = ONE_IN, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = materialise(vocabulary(docs, least, one_in))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("top"))
    joined = words.join(near, "word", "left")
    strong = -F.col("top.n") >= dominance * F.col("n")
    formed = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("top.near")).alias("form"), F.when(strong, -F.col("top.n")).alias("form_n")))
    discard(words)
    rooted = roots(formed.filter("form is not null"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
