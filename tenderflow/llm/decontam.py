"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers are <num>, units of measure <unit>, names <name>, other words
their small letters. A name is a capitalised word inside a sentence, or one that starts a
sentence and is capitalised inside another. So a benchmark question and one with other numbers
and names have the same template. As what opens a sentence, and what is a name, depends on the
text around a passage, a text has several readings: with such sentence-opening names as <name>,
with fewer units, with all opening words as plain words, an item also with all of them as <name>, and the words as
they stand, without slots. Windows of WINDOW words of each reading are hashed; windows of
documents and benchmark meet in a hash join. Hits of a document and an item on one diagonal make
a run, whatever the readings; its slots, the values behind the placeholders, must agree: equal
benchmark values stand for equal values in the document, and the reverse. A run counts if

* it covers RUN words of the item (all of a shorter item) and its slots agree, or
* it covers as many plain words, slots aside.

What a document sends to the join is only what a bitmap of the benchmark's window hashes lets
through; its size is fixed by BITS, whatever the benchmark's. Common passages make hot keys of
the join; its benchmark side has few rows a key, and Spark splits skewed partitions.

A unit is one of a few words that always are, or a word of a table in four languages or a symbol after a
number. In scripts without spaces each character is a word.

Edge cases: a null or empty text has no words; items under MIN_WORDS words cannot be told from
chance inside of a sentence and match only where they are a whole sentence or line, as they stand;
items under WINDOW words are one window; windows with under PLAIN plain
words (or under half of a short item's) are used only with their words as they stand; rows that share an id, a null id too, are judged each by
its own text and reported under the id; repeated rows are reported once; empty tables give an empty
result; columns other than doc_id, item_id and text are ignored, and `keep_clean` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, sliced, split_by_ids, table

WINDOW = 8
PLAIN = 4
RUN = 13
MIN_WORDS = 4
BITS = 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)
FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Unit words that always are; stems of further ones in English, German, French and
#: Spanish with their endings and prefixes, and symbols, that are units after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kph kmh".split()
)
UNIT_STEMS = (
    "acre hectare stone gallon pint quart barrel cup dozen decade century penny pence celsius fahrenheit knot amp ampere newton kelvin mole "
    "zoll fuß meile morgen hektar unze pfund tonn stunde sekund minute tag woche monat jahr jahrzehnt jahrhundert prozent stück dutzend "
    "pouce pied mille once livre seconde heure jour semaine mois an année décennie siècle centime degré douzaine "
    "tonelada pulgada pie milla onza libra segundo minuto hora día semana mes año década siglo céntimo centavo peso porcentaje"
).split()
SCALED_STEMS = "meter metre liter litre gram gramme gramm metr litr watt wattstunde volt byte bit joule hertz pascal mètre metro gramo litro calorie kalorie caloría".split()
UNIT_ENDINGS = ("", "s", "es", "e", "n", "en", "er", "ern")
UNIT_PREFIXES = ("", "kilo", "milli", "mili", "centi", "zenti", "deci", "dezi", "hecto", "hekto", "mega", "giga", "tera", "micro", "mikro", "nano")
SYMBOLS = "m g l L t W Wh V A J N Pa Hz B b bit eV s h cal mol Ω".split()
SYMBOL_PREFIXES = ("", "k", "m", "c", "d", "h", "M", "G", "T", "µ", "n")
PLAIN_SYMBOLS = "C F K ha min d a lb lbs oz ft in yd mi rpm psi bar".split()
AFTER_NUMBERS = frozenset(f"{stem}{e}" for stem in (*UNIT_STEMS, *(f"{p}{x}" for p in UNIT_PREFIXES for x in SCALED_STEMS)) for e in UNIT_ENDINGS)
UNIT_SYMBOLS = frozenset((*(f"{p}{x}" for p in SYMBOL_PREFIXES for x in SYMBOLS), *PLAIN_SYMBOLS))
#: Scripts that write words without spaces: each character is a word.
UNSPACED = "฀-໿က-႟ក-៿々-〇぀-ヿ㐀-䶿一-鿿豈-﫿"
MARKS = ".!?。！？\n"
TOKEN = re.compile(rf"[^\W\d_{UNSPACED}]+(?:['’-][^\W\d_{UNSPACED}]+)*|[.!?。！？\n]|\d(?:[\d.,]*\d)?|[{UNSPACED}]")
SLOTS = ("<num>", "<unit>", "<name>")
MARK, PLAIN_WORD, NUMBER, UNIT, CAPITALISED, AFTER_NUMBER, CAPITALISED_AFTER = range(7)
KIND_BITS = np.uint64(7)
MOST_KNOWN = 1 << 17


class Kinds(dict):
    """For each token the hash of its small letters, its kind in the lowest three bits."""

    def __missing__(self, token: str) -> int:
        small, first = token.lower(), token[0]
        if first in MARKS:
            kind = MARK
        elif first.isdigit():
            kind = NUMBER
        elif small in UNITS:
            kind = UNIT
        elif small in AFTER_NUMBERS or token in UNIT_SYMBOLS:
            kind = CAPITALISED_AFTER if first.isupper() else AFTER_NUMBER
        else:
            kind = CAPITALISED if first.isupper() and not (token.isupper() and len(token) > 1) else PLAIN_WORD
        if len(self) >= MOST_KNOWN:
            self.clear()
        self[token] = made = xxh64_intdigest(small, 42) & ~7 | kind
        return made


class Template:
    """The words of a text without marks, and for each of the `readings` the slots (0 for a plain
    word, else a number of SLOTS from 1). The last reading has no slots."""

    def __init__(self, text: str, kinds: Kinds, item: bool):
        self.found = TOKEN.findall(text)
        coded = np.fromiter(map(kinds.__getitem__, self.found), np.uint64, len(self.found))
        kind = (coded & KIND_BITS).astype(np.int8)
        self.word = np.flatnonzero(kind != MARK)
        opens = np.ones(len(kind), bool)
        opens[1:] = kind[:-1] == MARK
        closes = np.ones(len(kind), bool)
        closes[:-1] = kind[1:] == MARK
        coded, kind, opens = coded[self.word], kind[self.word], opens[self.word]
        self.opens, self.closes = opens, closes[self.word]
        slots = np.zeros(len(kind), np.int8)
        slots[kind == NUMBER], slots[kind == UNIT] = 1, 2
        counted = np.append(False, kind == NUMBER)[:-1] & (kind >= AFTER_NUMBER)
        kind[(kind == AFTER_NUMBER) | counted], kind[kind == CAPITALISED_AFTER] = PLAIN_WORD, CAPITALISED
        capital = kind == CAPITALISED
        inside, first = np.flatnonzero(capital & ~opens), np.flatnonzero(capital & opens)
        slots[inside] = 3
        plainer = slots
        if counted.any():  # and once with only the words that always are units
            slots = slots.copy()
            slots[counted] = 2
        self.readings = [slots] if slots.any() else []
        if counted.any() and plainer.any():
            self.readings.append(plainer)
        for some in (first[np.isin(coded[first], coded[inside])], first if item else first[:0]):
            if some.size:
                named = slots.copy()
                named[some] = 3
                self.readings.append(named)
        self.readings.append(np.zeros(len(kind), np.int8))
        self.coded = coded & ~KIND_BITS

    def __len__(self) -> int:
        return len(self.word)

    def values(self, at: int, n: int) -> list[str]:
        return [self.found[i].lower() for i in self.word[at : at + n]]

    def words(self, slots: np.ndarray, at: int, n: int) -> list[str]:
        return [SLOTS[s - 1] if s else v for v, s in zip(self.values(at, n), slots[at : at + n])]


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    out = a * BASE
    out += b
    out ^= out >> np.uint64(29)
    out *= FACTOR
    out ^= out >> np.uint64(32)
    return out


def all_windows(hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the windows of each length that fits: windows of 1, 2, 4, … words, each of two of
    the last, joined as the length's binary digits say."""
    powers = [hashes]
    while 2 << len(powers) - 1 <= min(max(lengths), len(hashes)):
        half = 1 << len(powers) - 1
        powers.append(joined(powers[-1][:-half], powers[-1][half:]))
    for n in lengths:
        if n > len(hashes):
            continue
        out, have = None, 0
        for k in reversed(range(len(powers))):
            if n >> k & 1:
                part = powers[k][have : have + len(hashes) - n + 1]
                out = part if out is None else joined(out, part)
                have += 1 << k
        yield n, out.view(np.int64)


def window_hashes(template: Template, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each reading and length: the length, the reading's slots, the hashes of the windows, and
    whether each counts: it has enough plain words or is read as it stands, and no reading before
    gives the same."""
    done: dict[int, list] = {n: [] for n in lengths}
    for slots in template.readings:
        hashes = np.where(slots > 0, slots.astype(np.uint64), template.coded)
        plain = np.append(0, np.cumsum(slots == 0))
        for n, made in all_windows(hashes, lengths):
            good = plain[n:] - plain[:-n] >= min(PLAIN, (n + 1) // 2)
            if n < MIN_WORDS:  # nothing but a whole sentence or line, as it stands
                good &= template.opens[: len(made)] & template.closes[n - 1 :] & (not slots.any())
            for other, taken in done[n]:
                good &= ~(taken & (other == made))
            done[n].append((made, good.copy()))
            yield n, slots, made, good


WINDOW_FIELDS = "id long, sig long, at int, length int, n_words int, hash long, words array<string>, values array<string>"


def windows(rows: DataFrame, lengths: list[int] | None, seen: np.ndarray | None) -> DataFrame:
    """Windows of (id, text) rows. Without lengths a text is an item: its windows are WINDOW
    words or, for a shorter item, all of them. With `seen`, only windows that the bitmap has."""
    held = rows.sparkSession.sparkContext.broadcast((lengths, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = held.value
        kinds = Kinds()
        schema = pa.schema([*((c, pa.int64()) for c in ("id", "sig")), *((c, pa.int32()) for c in ("at", "length", "n_words")), ("hash", pa.int64()), *((c, pa.list_(pa.string())) for c in ("words", "values"))])
        for batch in sliced(batches):
            out = []
            for row_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                template = Template(text or "", kinds, lengths is None)
                if not len(template):
                    continue
                sig = None
                for length, slots, hashes, good in window_hashes(template, lengths or [min(WINDOW, len(template))]):
                    if seen is not None:
                        bit = hashes.view(np.uint64) % np.uint64(BITS)
                        good &= (seen[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    for at in np.flatnonzero(good):
                        sig = xxh64_intdigest(text.encode(), 42) >> 1 if sig is None else sig
                        out.append((row_id, sig, at, length, len(template), hashes[at], template.words(slots, at, length), template.values(at, length)))
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, WINDOW_FIELDS)


def bitmap(items: DataFrame) -> np.ndarray:
    """BITS bits of the items' window hashes. Bits are gathered to words in Spark, so at most
    BITS / 32 rows reach the driver."""
    bit = F.expr(f"cast(mod(mod(cast(hash as decimal(20,0)) + case when hash < 0 then 18446744073709551616BD else 0BD end, {BITS}BD), {BITS}BD) as long)")
    words = items.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 32, "<u4")
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint64).astype("<u4")
    return out.view(np.uint8)


def covered(starts: Column, length: Column) -> Column:
    """How many places windows of a length at the sorted starts cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")),
        lambda acc, s: F.struct((acc["n"] + s + length - F.greatest(s, acc["to"])).cast("int").alias("n"), (s + length).cast("int").alias("to")),
    )["n"]


def runs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id, sig (of the text), item_id, kind, same, n_covered and doc_start of all contaminated runs."""
    items = materialise(windows(benchmark.selectExpr("cast(item_id as long) id", "cast(text as string) text"), None, None))
    lengths = sorted(r.length for r in items.select("length").distinct().collect()) or [WINDOW]  # 1 to WINDOW
    texts = docs.selectExpr("cast(doc_id as long) id", "cast(text as string) text")
    hits = windows(texts, lengths, bitmap(items))
    item = items.select(F.col("id").alias("item_id"), F.col("sig").alias("item_sig"), F.col("at").alias("item_at"), "length", F.col("n_words").alias("item_words"), "hash", F.col("words").alias("item_template"), F.col("values").alias("item_values"))
    met = hits.join(item, ["hash", "length"]).filter("words = item_template")
    run = ["id", "sig", "item_id", "item_sig", "item_words", "length", (F.col("at") - F.col("item_at")).alias("diagonal")]
    cells = F.transform(F.arrays_zip("words", "values", "item_values"), lambda c, i: F.struct((F.col("item_at") + i).alias("place"), c["words"].alias("word"), c["item_values"].alias("theirs"), c["values"].alias("ours")))
    gathered = met.select(*run, "item_at", cells.alias("cells")).groupBy("id", "sig", "item_id", "item_sig", "item_words", "length", "diagonal").agg(
        F.sort_array(F.collect_set("item_at")).alias("starts"), F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells")
    )
    slots = F.filter("cells", lambda c: c["word"].isin(*SLOTS))
    pairs = F.array_distinct(F.transform(slots, lambda c: F.struct(c["theirs"], c["ours"])))
    theirs, ours = (F.size(F.array_distinct(F.transform(pairs, lambda p: p[k]))) for k in ("theirs", "ours"))
    judged = gathered.select(
        "id",
        "sig",
        "item_id",
        covered(F.col("starts"), F.col("length")).alias("n_covered"),
        (F.size("cells") - F.size(slots)).alias("n_plain"),
        ((F.size(pairs) == theirs) & (F.size(pairs) == ours)).alias("agree"),
        F.forall(pairs, lambda p: p["theirs"] == p["ours"]).alias("same"),
        (F.col("starts")[0] + F.col("diagonal")).alias("doc_start"),
        F.least(F.lit(RUN), F.col("item_words")).alias("needed"),
    )
    counted = judged.filter((F.col("n_covered") >= F.col("needed")) & (F.col("agree") | (F.col("n_plain") >= F.col("needed"))))
    kind = F.when(F.col("same"), "exact").when(F.col("agree"), "reparameterised").otherwise("plain words")
    return counted.select("id", "sig", "item_id", kind.alias("kind"), "same", "n_covered", "doc_start")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, n_covered, doc_start of each contaminated pair, its best run."""
    rank = F.struct("n_covered", "same", -F.col("doc_start"))
    best = runs(docs, benchmark).groupBy("id", "item_id").agg(F.max_by(F.struct("kind", "n_covered", "doc_start"), rank).alias("best"))
    return best.select(F.col("id").alias("doc_id"), "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose texts are in no contaminated pair, with all their columns."""
    leaked = materialise(runs(docs, benchmark).select(F.col("sig").alias("_sig"), F.col("id").alias("_leaked")).distinct())
    signed = docs.withColumn("_sig", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1))
    some, rest = split_by_ids(signed, "_sig", leaked)
    held = leaked.withColumnRenamed("_sig", "_leak")
    clean = some.join(held, (F.col("_sig") == F.col("_leak")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_leaked")), "left_anti")
    return clean.unionByName(rest).select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
