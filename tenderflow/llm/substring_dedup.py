"""Exact substring dedup: every byte of a LENGTH-byte string that also starts earlier goes.

Bucket-pointer refinement over a corpus. The suffixes that matter start LENGTH-byte windows, and
all windows of one run share an anchor: the q-gram of least hash in the window, leftmost on ties.
Equal windows have equal anchors at equal distance, so each anchor stands for its run of windows.

1. `anchors`: each task finds the anchors of its texts and drops those whose whole context it has
   met earlier, as spans. Buckets are the anchors' q-grams, so what is shuffled is one short row
   for about 35 bytes of text, once.
2. `judge`: in each bucket, anchors with equal contexts form a class. All but its first are
   copies. A bucket with one class is settled; the first of each class in other buckets is open.
   Q-grams that are common in a sample are dealt out by context, so no bucket has to fit a task;
   what the sample says never changes the result.
3. `refine`: the contexts of open anchors, short strings, are gathered by bucket. Windows in
   them are refined from 8-byte buckets by sorting on the bucket numbers of later offsets: 8 and 8
   give 16 bytes, then 32, 64, and 64 with an overlap gives LENGTH. Each step sorts only what is
   not alone in its bucket and reuses the numbers as the last step left them. In buckets with more
   than BUCKET classes the same refinement runs over all of Spark: windows are dealt out one by
   one, and a round for each later q-gram keeps those that are not alone.
4. `remove`: the spans of each document are united and cut out of its text.

Texts are shuffled only where a document has open anchors or spans. Documents without, as far as a
bitmap of fixed size tells, pass by.

Order is by doc_id, then start; strings are judged on the input. Edge cases: a null or empty text
has no bytes; rows with a null id are kept whole and never make others copies; rows that share an
id are one document with several texts: equal starts are not earlier than each other, and each
text is judged by its own spans; an empty table gives an empty result; columns other than doc_id
and text are ignored. Texts may have up to 2 ** 31 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, split_by_ids, table

LENGTH = 100
Q = 32
WINDOW = LENGTH - Q + 1
CHUNK = 1 << 19
BUCKET = 4000
BLOCK = BUCKET
#: Bytes of text that a task works on at once, a longer text alone.
SLICE = 4 << 20
#: Common q-grams: one document in SAMPLE is looked at; those met COMMON times, HELD at most, are dealt out.
SAMPLE, COMMON, HELD = 16, 32, 1 << 16
BASES = (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15)
FACTOR = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)


class Hasher:
    """Hashes of all substrings of a chunk, from prefix sums of its bytes."""

    def __init__(self, base: int):
        self.powers = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(CHUNK + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> HALF)) * FACTOR
    return x ^ (x >> HALF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def chunk_anchors(data: np.ndarray, ends: np.ndarray, hashers: tuple[Hasher, Hasher]) -> tuple[np.ndarray, ...]:
    """Anchors of a chunk of texts: hash, context hash, place, first and last window.

    `ends` has, for each byte, where its text ends in the chunk.
    """
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    places = np.arange(len(data) - Q + 1)
    gram = hashers[0].spans(hashers[0].prefix(data), places, places + Q)
    low = np.uint64(CHUNK - 1)
    anchor = (sliding_min(gram & ~low | places.astype(np.uint64), WINDOW) & low).astype(np.int64)
    windows = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[: len(anchor)])
    at = anchor[windows]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    runs = np.flatnonzero(new)
    first, place = windows[runs], at[runs]
    last = windows[np.append(runs[1:], len(windows)) - 1] if len(runs) else first
    context = hashers[1].spans(hashers[1].prefix(data), first, last + LENGTH)
    shape = ((place - first) << 8 | (place - last)).astype(np.uint64)
    return gram[place], mixed(context ^ (shape * FACTOR)), place, first, last


def chunks(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Texts joined to chunks of at most CHUNK bytes: (text, offset in it, length) parts, bytes.

    A longer text is cut into parts that overlap, so that each window is in exactly one.
    """
    parts, size = [], 0
    for k, text in enumerate(texts):
        step = CHUNK - LENGTH + 1
        for offset in range(0, max(1, len(text) - LENGTH + 1), step):
            n = min(CHUNK, len(text) - offset)
            if n < LENGTH:
                continue
            if size + n > CHUNK:
                yield parts, b"".join(texts[i][o : o + m] for i, o, m in parts)
                parts, size = [], 0
            parts.append((k, offset, n))
            size += n
    if parts:
        yield parts, b"".join(texts[i][o : o + m] for i, o, m in parts)


def batch_anchors(rows: np.ndarray, texts: list[bytes], hashers) -> tuple[np.ndarray, ...]:
    """hash, context, row, place, first and last window of all anchors, places within the texts."""
    found = []
    for parts, data in chunks(texts):
        text, offset, length = (np.array(x, np.int64) for x in zip(*parts))
        starts = np.cumsum(length) - length
        h, c, place, first, last = chunk_anchors(np.frombuffer(data, np.uint8), np.repeat(starts + length, length), hashers)
        part = np.searchsorted(starts, first, "right") - 1
        shift = offset[part] - starts[part]
        found.append((h, c, rows[text[part]], place + shift, first + shift, last + shift))
    if not found:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, zip(*found)))


def joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted spans with those that touch united."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    wide = np.int64(1 << 32)
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], reach[np.append(heads[1:], len(doc)) - 1]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE bytes of `data`."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["data"]).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def anchors(docs: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """Rows h, deal, c, doc_id, sig, a, b: an anchor at a with distances b to its windows, or, where
    c is null, a span [a, b) that is a copy of something the task met earlier. deal is 0 but for
    anchors of `common` q-grams, a sorted array, where it deals contexts out."""
    held = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        hashers = tuple(map(Hasher, BASES))
        for batch in slices(batches):
            doc_ids, sigs = batch["doc_id"].to_numpy(), batch["sig"].to_numpy()
            h, c, row, place, first, last = batch_anchors(np.arange(batch.num_rows), batch["data"].to_pylist(), hashers)
            order = np.lexsort((place, doc_ids[row], c, h))
            h, c, row, place, first, last = (x[order] for x in (h, c, row, place, first, last))
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
            copy = (doc_ids[row] != doc_ids[row[lead]]) | (place != place[lead])
            r, s, e = joined_spans(row[copy], first[copy], last[copy] + LENGTH)
            own = ~copy
            some = mixed(doc_ids[r].astype(np.uint64) * FACTOR + s.astype(np.uint64))
            deal = np.zeros(len(h), np.int32)
            if common.size:
                hot = common[np.minimum(np.searchsorted(common, h), common.size - 1)] == h
                deal[hot] = (c[hot] >> np.uint64(34)).astype(np.int32) + 1
            rows = np.concatenate([row[own], r])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[own], some]).view(np.int64)),
                    pa.array(np.concatenate([deal[own], np.zeros(len(r), np.int32)])),
                    pa.array(np.concatenate([c[own].view(np.int64), np.zeros(len(r), np.int64)]), mask=np.repeat([False, True], [own.sum(), len(r)])),
                    pa.array(doc_ids[rows]),
                    pa.array(sigs[rows]),
                    pa.array(np.concatenate([place[own], s]).astype(np.int32)),
                    pa.array(np.concatenate([(place - first)[own] << 8 | (place - last)[own], e]).astype(np.int32)),
                ],
                ["h", "deal", "c", "doc_id", "sig", "a", "b"],
            )

    return docs.mapInArrow(run, "h long, deal int, c long, doc_id long, sig int, a int, b int")


def common_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of q-grams that a sample of documents shows to be common, HELD at most."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "sig"), F.lit(SAMPLE)) == 0)
    met = anchors(sample).filter("c is not null").groupBy("h").count().filter(F.col("count") >= COMMON)
    found = met.orderBy(F.desc("count"), "h").limit(HELD).toPandas()
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def far():
    """From an anchor back to its first window."""
    return F.shiftright("b", 8)


def near():
    """From an anchor back to its last window."""
    return F.col("b").bitwiseAND(F.lit(255))


def judge(found: DataFrame) -> DataFrame:
    """Spans and open anchors: h, doc_id, sig, a, b, classes; classes is null for a span [a, b),
    and 0 for the first of a class of a q-gram that was dealt out."""
    spec = Window.partitionBy("h", "deal", "c").orderBy("doc_id", "a")
    dealt = found.repartition("h", "deal")  # serves both windows
    ranked = dealt.withColumn("r", F.rank().over(spec)).withColumn("lead", F.row_number().over(spec) == 1)
    first = F.when(F.col("lead") & F.col("c").isNotNull(), 1)
    counted = ranked.withColumn("classes", F.when(F.col("deal") > 0, 0).otherwise(F.count(first).over(Window.partitionBy("h", "deal"))))
    span = F.col("c").isNull() | (F.col("r") > 1)
    kept = counted.filter(span | (F.col("classes") != 1))
    anchor_span = span & F.col("c").isNotNull()
    return kept.select(
        "h",
        "doc_id",
        "sig",
        F.when(anchor_span, F.col("a") - far()).otherwise(F.col("a")).alias("a"),
        F.when(anchor_span, F.col("a") - near() + LENGTH).otherwise(F.col("b")).alias("b"),
        F.when(~span, F.col("classes")).alias("classes"),
    )


def still_open(judged: DataFrame) -> DataFrame:
    """The open anchors; classes of q-grams that were dealt out are counted here, for HELD at most."""
    opened = judged.filter("classes is not null")
    met = opened.filter("classes = 0").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    classes = F.when(F.col("classes") > 0, F.col("classes")).otherwise(F.col("n"))
    return opened.join(F.broadcast(met), "h", "left").withColumn("classes", classes).drop("n").filter("classes > 1")


def contexts(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """h, doc_id, sig, start, windows, classes and the bytes that an open anchor's windows cover."""
    listed = opened.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("h", (F.col("a") - far()).alias("start"), (far() - near() + 1).alias("windows"), "classes")).alias("opened"))
    met, _ = split_by_ids(docs, "doc_id", opened)
    read = met.join(listed, ["doc_id", "sig"]).select("doc_id", "sig", "data", F.explode("opened").alias("o"))
    context = F.substring("data", F.col("o.start") + 1, F.col("o.windows") + LENGTH - 1)
    return read.select("o.h", "doc_id", "sig", "o.start", "o.windows", "o.classes", context.alias("context"))


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the LENGTH-byte windows at `starts` are not alone in their bucket, and the bucket's
    number, by bucket-pointer refinement."""
    n = len(data)
    grams = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(7, np.uint8)), 8)
    number = np.unique(np.ascontiguousarray(grams).view("<u8")[:, 0], return_inverse=True)[1]
    used, have, at = int(number.max(initial=-1)) + 1, 8, np.arange(n)

    def finer(at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Places not alone in their buckets, as indices of `at`, and their bucket's part by the bucket `step` on."""
        shared = np.flatnonzero(np.bincount(number)[number[at]] > 1)
        later = number[np.minimum(at[shared] + step, n - 1)]
        return shared, np.unique(number[at[shared]] * np.int64(used) + later, return_inverse=True)[1]

    while 2 * have < LENGTH:
        shared, parts = finer(at, have)
        at = at[shared]
        number[at] = used + parts  # what is alone keeps its number
        used, have = used + len(at), 2 * have
    shared, parts = finer(starts, LENGTH - have)
    again = np.bincount(parts, minlength=1)[parts] > 1
    return shared[again], parts[again]


def refine_block(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, context: list[bytes]) -> tuple[np.ndarray, ...]:
    """Spans (row of the block, start, end) of the windows in it that also start earlier in it."""
    lengths = np.array([len(x) for x in context], np.int64)
    base = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(doc)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    found, number = repeated_windows(np.frombuffer(b"".join(context), np.uint8), base[owner] + step)
    owner, step = owner[found], step[found]
    d, s = doc[owner], start[owner] + step
    order = np.lexsort((s, d, number))
    number, r, d, s = number[order], owner[order], d[order], s[order]
    head = np.append(True, number[1:] != number[:-1])[: len(number)]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    copy = (d != d[lead]) | (s != s[lead])
    return joined_spans(r[copy], s[copy], s[copy] + LENGTH)


def refine_dealt(found: DataFrame) -> DataFrame:
    """doc_id, sig, a, b of the windows that also start earlier, for buckets too large for a task.

    Windows start in the buckets of their first Q bytes; each round goes Q bytes on, the last with
    an overlap, and what is then alone is settled. At the end equal windows share a bucket, which
    the window itself names. A bucket is only ever counted or reduced to its least place, and what
    that gives is written out, so Spark may split a large bucket in the join that follows.
    """
    step = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
    each = found.select("doc_id", "sig", "start", "context", step.alias("step"))
    window = F.substring("context", F.col("step") + 1, F.lit(LENGTH))
    rows = each.select("doc_id", "sig", (F.col("start") + F.col("step")).alias("a"), window.alias("window"), F.lit(0).cast("long").alias("bucket"))
    for offset in (*range(0, LENGTH - Q, Q), LENGTH - Q):
        finer = rows.withColumn("bucket", F.xxhash64("bucket", F.substring("window", F.lit(offset + 1), F.lit(Q))))
        shared = materialise(finer.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
        before, rows = rows, materialise(finer.join(shared, "bucket", "left_semi"))
        discard(before)
        discard(shared)
    leads = materialise(rows.groupBy("window").agg(F.min(F.struct("doc_id", "a")).alias("lead")))
    copies = rows.join(leads, "window").filter(F.struct("doc_id", "a") > F.col("lead"))
    return copies.select("doc_id", "sig", "a", (F.col("a") + LENGTH).cast("int").alias("b"))


def refine(found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, sig, a, b: spans of copies among open anchors' windows, from their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, block by block: rows come sorted by bucket."""

        def spans(block: pa.Table) -> pa.RecordBatch:
            docs, sigs = block["doc_id"].to_numpy(), block["sig"].to_numpy()
            row, a, b = refine_block(docs, block["start"].to_numpy(), block["windows"].to_numpy(), block["context"].to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(sigs[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "sig", "a", "b"])

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows > BLOCK:
                h = held["h"].to_numpy()
                cut = int(np.searchsorted(h, h[BLOCK], "left")) or int(np.searchsorted(h, h[0], "right"))
                if cut == held.num_rows:
                    break  # the bucket may go on
                yield spans(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield spans(held)

    large = found.filter(F.col("classes") > bucket)
    small = found.filter(F.col("classes") <= bucket).repartition("h").sortWithinPartitions("h")
    spans = small.mapInArrow(run, "doc_id long, sig int, a int, b int")
    return spans if large.isEmpty() else spans.unionByName(refine_dealt(large))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of every document.

    spans has doc_id, sig and spans, the list of a text's spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, some in zip(batch["data"].to_pylist(), batch["spans"].to_pylist()):
                kept, at, n = [], 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in some or ()):
                    if a > at or not n:
                        n += 1
                        kept.append(data[at:a])
                    at = max(at, b)
                kept = b"".join([*kept, data[at:]])
                rows.append((kept, len(data), len(data) - len(kept), n))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    touched, whole = split_by_ids(docs, "doc_id", spans)  # a null id is not touched
    cut = touched.join(spans, ["doc_id", "sig"], "left").select("doc_id", "data", "spans")
    whole = whole.select("doc_id", "data", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return cut.unionByName(whole).mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def dedup(docs: DataFrame, bucket: int = BUCKET, common: np.ndarray | None = None) -> DataFrame:
    """The whole operator: see the module's text. `common` are q-grams to deal out, found if not given."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("sig"), text.alias("data"))
    identified = read.filter("doc_id is not null")
    judged = materialise(judge(anchors(identified, common_grams(identified) if common is None else common)))
    opened = materialise(contexts(identified, still_open(judged)))
    found = judged.filter("classes is null").select("doc_id", "sig", "a", "b").unionByName(refine(opened, bucket))
    spans = materialise(found.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    discard(judged)
    discard(opened)
    return remove(read, spans)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
