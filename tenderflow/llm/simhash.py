"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if more than half of the text's shingle hashes set it. Fingerprints link
at RADIUS or fewer differing bits. Each of the 64 bits has a nonzero vector of RADIUS + 1 bits;
table v keeps the bits whose vector has an odd product with v. Up to RADIUS differing bits give
as many equations in RADIUS + 1 unknowns, so some v drops all of them: every linked pair shares
its kept bits in at least one of the 2 ** (RADIUS + 1) - 1 tables.

Copies count once: only distinct fingerprints enter the tables. A bucket is searched in its task
and yields a spanning forest of its links, not its pairs. Buckets over BUCKET fingerprints are
dealt out again by a second covering family on the bits that the first dropped; what is left then
differs in about 14 bits at most, which bounds a bucket. Components come from alternating star
contraction, each round written to the shared folder.

Edge cases: a null or empty text has fingerprint 0, linked like any other; a text shorter than a
shingle is one shingle; repeated rows each give a row; a null id never names a component that has
another; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialise, sliced, split_by_ids, table

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
BLOCK = 1 << 15
#: Near copies: families of word-set fingerprints, bits that the tables of each cover, differing
#: bits of a candidate over all families, words in a shingle and the least similarity. The first
#: three only set how much the exact search has left to do.
FAMILIES = 8
COPY_BITS = 52
COPY_REACH = 100
COPY_SHINGLE = 5
SIMILARITY = 0.8
#: Exact candidates: one text in SAMPLE is counted for how common shingles are, of which COMMON are
#: held; pairs of a shingle are met in parts of PART rows.
SAMPLE = 8
COMMON = 1 << 18
PART = 1024
#: Rows of texts that a task's Python holds at once.
BATCH = 1000
STRIDE = 0x9E3779B97F4A7C15
FACTOR = np.uint64(0xD6E8FEB86659FD93)


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = np.array([simhash(t or "", shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """One mask per table over the given bits, the structured family of the module's text."""
    tables = range(1, 1 << (radius + 1))
    vector = {b: 1 + k % len(tables) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in tables]


def bucketed(rows: DataFrame, masks, *keys: str) -> DataFrame:
    """fp in each of its tables: the keys, the table's number t and the bits it keeps."""
    return rows.select(*keys, "fp", F.posexplode(masks).alias("t", "mask")).select(*keys, "t", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), "fp")


def forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints."""
    left = fps
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                for other in found:
                    yield at, other


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links k, a, b within rows of k and fps, array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["fps"]
            values, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            families, out = batch["k"].to_numpy(), []
            for k, a, z in zip(families, np.append(0, ends), ends):
                out += ((k, x, y) for x, y in forest(values[a:z], radius))
            k, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(k, np.int32)), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))], ["k", "a", "b"])

    return buckets.select("k", "fps").mapInArrow(run, "k int, a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links k, a > b between distinct fingerprints (k, fp) of one family k; they span the same
    components as all links."""
    every = list(range(BITS))
    masks = covering_masks(radius, every)
    finer = [[m | s for s in covering_masks(radius, [b for b in every if not m >> b & 1])] for m in masks]
    literal = lambda some: F.array(*(F.lit(signed(m)) for m in some))

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("n > 1")

    first = counted(bucketed(fps, literal(masks), "k"), "k", "t", "kept")
    small = first.filter(F.col("n") <= bucket).groupBy("k", "t", "kept").agg(F.collect_list("fp").alias("fps"))
    found = bucket_links(small, radius)
    large = materialise(first.filter(F.col("n") > bucket).select("k", F.col("t").alias("t0"), "fp"))
    if not large.isEmpty():
        keys = ("k", "t0", "t", "kept")
        again = bucketed(large, F.get(F.array(*map(literal, finer)), F.col("t0")), "k", "t0")
        found = found.unionByName(bucket_links(counted(again, *keys).groupBy(*keys).agg(F.collect_list("fp").alias("fps")), radius))
    return found.select("k", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges a > b; the root is the component's least node.

    Alternating large and small stars: each node links to the least node it knows, until
    nothing changes. Every round is written out and the round before it is deleted.
    """
    now = materialise(edges)
    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least).distinct()
        new = materialise(small)
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if seen == mark:
            return now.toDF("node", "root")
        mark = seen


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the least id that links reach, for every document."""
    prints = materialise(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(distinct.select(F.lit(0).alias("k"), "fp"), radius).select("a", "b"))
    rooted = materialise(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    return prints.join(named.select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def word_prints(text: str, families: int) -> list[int]:
    """Fingerprints of a text's set of words, one for each family of hashes."""
    import xxhash

    words = set(text.encode().lower().split())
    if not words:
        return [0] * families
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64)
    out = []
    for k in range(families):
        mixed = hashes ^ np.uint64(k * STRIDE % (1 << BITS))
        for _ in range(2):
            mixed = (mixed ^ (mixed >> np.uint64(32))) * FACTOR
        mixed ^= mixed >> np.uint64(32)
        ones = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(mixed), bitorder="little").view("<u8")[0]))
    return out


def similar(a: str, b: str, shingle: int, similarity: float) -> bool:
    """Whether the Jaccard similarity of the texts' word shingles reaches `similarity`."""
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append(set(zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else {tuple(words)})
    both = len(sets[0] & sets[1])
    return both >= similarity * (len(sets[0]) + len(sets[1]) - both)


def spanning_links(nodes: np.ndarray, prints: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """The minimum spanning tree's links of at most `reach` bits between rows of fingerprints.

    Copies of one text differ less from it than from each other, so the tree's links lead to it.
    """
    at, left = 0, np.arange(1, len(nodes))
    best, source = np.full(len(left), 1 << 30), np.zeros(len(left), np.int64)
    while left.size:
        apart = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.int64)
        nearer = apart < best
        best[nearer], source[nearer] = apart[nearer], at
        j = int(np.argmin(best))
        at = int(left[j])
        if best[j] <= reach:
            yield int(nodes[source[j]]), int(nodes[at])
        keep = np.arange(len(left)) != j
        left, best, source = left[keep], best[keep], source[keep]


def candidate_links(prints: DataFrame, families: int, bucket: int = BUCKET, bits: int = COPY_BITS, reach: int = COPY_REACH) -> DataFrame:
    """Links a > b between nodes that share a bucket: a spanning tree of each bucket.

    prints has node and fps, a fingerprint per family. Buckets hold nodes only, and equal ones of
    several tables count once; then the fingerprints are joined to them again. A bucket that the
    finer split leaves over `bucket` is dealt out in parts, each with the bucket's least node, so
    no row holds more than about `bucket` nodes; `exact_pairs` finds what that parts.
    """
    every = list(range(bits))
    masks = covering_masks(RADIUS, every)
    finer = [[m | s for s in covering_masks(RADIUS, [b for b in every if not m >> b & 1])] for m in masks]
    literal = lambda some: F.array(*(F.lit(signed(m)) for m in some))

    def kept_in(rows: DataFrame, mask, *keys: str) -> DataFrame:
        cut = rows.select(*keys, "node", "fp", F.posexplode(mask).alias("t", "mask")).select(*keys, "t", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), "node")
        return cut.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "t", "kept"))).filter("n > 1")

    def gathered(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys, "t", "kept").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes")

    first = kept_in(prints.select("node", F.posexplode("fps").alias("k", "fp")), literal(masks), "k")
    met = materialise(gathered(first.filter(F.col("n") <= bucket), "k").distinct())
    large = materialise(first.filter(F.col("n") > bucket).select("k", F.col("t").alias("t0"), "node"))
    if not large.isEmpty():
        again = large.join(prints, "node").select("k", "t0", "node", F.get("fps", F.col("k")).alias("fp"))
        second = kept_in(again, F.get(F.array(*map(literal, finer)), F.col("t0")), "k", "t0")
        keys, one = ["k", "t0", "t", "kept"], F.lit(1)
        dealt = second.withColumn("deals", F.ceil(F.col("n") / bucket).cast("int")).withColumn("least", F.min("node").over(Window.partitionBy(*keys)))
        leads = dealt.filter("node = least").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - one)))
        others = dealt.filter("node > least").withColumn("deal", F.pmod(F.xxhash64("node"), "deals").cast("int"))
        parts = leads.select(*keys, "deal", "node").union(others.select(*keys, "deal", "node"))
        met = materialise(met.union(gathered(parts, "k", "t0", "deal").filter("size(nodes) > 1")).distinct())
    known = prints.select("node", "fps")
    rows = met.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node")).distinct().join(known, "node")
    sets = rows.groupBy("bucket").agg(F.collect_list(F.struct("node", "fps")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, out = batch["members"], []
            flat, ends = members.flatten(), np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))
            nodes = flat.field("node").to_numpy()
            fps = flat.field("fps").flatten().to_numpy().view(np.uint64).reshape(-1, families)
            for a, z in zip(np.append(0, ends), ends):
                out += spanning_links(nodes[a:z], fps[a:z], reach)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1, initial=-(1 << 63))), pa.array(pairs.min(axis=1, initial=(1 << 63) - 1))], ["a", "b"])

    return sets.select("members").mapInArrow(run, "a long, b long").distinct()


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles that `similar` compares."""
    import xxhash

    words = text.encode().lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def prefix_rows(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """part, node, size, place: each text's rarest shingles, as many as make sure that two texts of
    the least similarity share one; size is the text's number of shingles.

    Any one order of all shingles would do. Shingles that are common in a sample come last, so what
    many texts have in common brings few of them together.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for text in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text, shingle).view(np.int64))], ["part"])

    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(every, "part long")
    seen = sample.groupBy("part").count().filter("count > 1").orderBy(F.desc("count"), "part").limit(COMMON).toPandas()
    common, often = seen["part"].to_numpy(np.int64).view(np.uint64), seen["count"].to_numpy(np.int64)
    order = np.argsort(common)
    held = texts.sparkSession.sparkContext.broadcast((common[order], often[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = held.value
        for batch in sliced(batches):
            parts, sizes, counts = [np.zeros(0, np.uint64)], [], []
            for text in batch["text"].to_pylist():
                hashes = shingle_hashes(text, shingle)
                if common.size:
                    at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
                    hashes = hashes[np.argsort(np.where(common[at] == hashes, often[at], 0), kind="stable")]
                sizes.append(len(hashes))
                counts.append(len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1)
                parts.append(hashes[: counts[-1]])
            nodes, sizes = (np.repeat(np.array(x, np.int64), counts) for x in (batch["node"].to_numpy(), sizes))
            places = np.concatenate([np.zeros(0, np.int64), *map(np.arange, counts)])
            columns = [pa.array(np.concatenate(parts).view(np.int64)), pa.array(nodes), pa.array(sizes.astype(np.int32)), pa.array(places.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "node", "size", "place"])

    return texts.select("node", "text").mapInArrow(run, "part long, node long, size int, place int")


def exact_pairs(texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs a > b of different roots, with these, that hold all pairs of the least similarity.

    A pair is met at a shingle of both prefixes if the sizes and what can follow the shingle allow
    the similarity; for the first one that a similar pair shares they do. Shingles of many texts
    are dealt out: one side's rows to parts, the other side's to all of them.
    """
    rows = prefix_rows(texts, shingle, similarity)
    many = materialise(rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part"))).filter("n > 1"))
    rooted = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("part").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("part")
    shared_rows = materialise(rooted.join(apart, "part", "left_semi").withColumn("deals", F.ceil(F.col("n") / PART).cast("int")))
    left = shared_rows.select("part", F.pmod(F.xxhash64("node"), "deals").cast("int").alias("deal"), *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "place", "root")))
    right = shared_rows.select("part", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "place", "root")))
    sized = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6
    follow = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = follow >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    met = left.join(right, ["part", "deal"]).filter((F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & sized & enough)
    pairs = materialise(met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "root_a", "root_b").agg(F.count(F.lit(1)).alias("shared")))
    discard(many)
    discard(shared_rows)
    return pairs


def near_copies(docs: DataFrame, families: int = FAMILIES, shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, doc_id, text_check and leader of the documents that another one stands for; a node is an
    id with its text, so several texts of one id, or of none, are documents of their own.

    Equal texts (two 64-bit hashes agree): the least id stays. The rest are joined to groups by all pairs of the least
    similarity; in a group the least id leads and all others go. Fingerprints of word sets join
    most of a group cheaply: the links of the buckets' spanning trees, checked on the texts. They
    find no pair for sure, so `exact_pairs` then gives every pair that is left between groups:
    first the likeliest of two groups is checked, then all whose groups are still apart.

    Texts stay where they are read but for those that links name.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        return _near_copies(docs, families, shingle, similarity)


def _near_copies(docs: DataFrame, families: int, shingle: int, similarity: float) -> DataFrame:
    read = with_nodes(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    same = ["text_hash", "text_check"]
    slim = read.select("node", "doc_id", *same).distinct()
    firsts = materialise(slim.groupBy(*same).agg(F.min_by(F.struct("node", "doc_id"), order).alias("f")).select(*same, "f.node", "f.doc_id"))
    equal = materialise(slim.join(firsts.select(*same, F.col("node").alias("first")), same).select("node", "doc_id", "text_check", "first"))
    doubted, sure = split_by_ids(read, "node", equal.filter("node <> first"))
    whole = doubted.join(firsts, "node", "left_semi").unionByName(sure).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [np.array(word_prints(t, families), np.uint64).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(made, pa.list_(pa.int64()))], ["node", "fps"])

    prints = materialise(whole.mapInArrow(run, "node long, fps array<long>").dropDuplicates(["node"]))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            held = [similar(x, y, shingle, similarity) for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(held, pa.bool_()))

    def checked(links: DataFrame) -> DataFrame:
        """The links whose texts are alike; the given ones are discarded."""
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        named, _ = split_by_ids(read, "node", nodes)
        texts = materialise(named.join(nodes, "node", "left_semi").select("node", "text").dropDuplicates(["node"]))
        both = links.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        held = materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(alike, "a long, b long").distinct())
        discard(texts)
        discard(links)
        return held

    def grown(roots: DataFrame, links: DataFrame) -> DataFrame:
        made = components(roots.filter("node > root").toDF("a", "b").union(links).distinct())
        discard(links)
        return made

    links = checked(materialise(candidate_links(prints, families)))
    discard(prints)
    roots = components(links)
    discard(links)
    pairs = exact_pairs(whole, roots, shingle, similarity)
    likely = pairs.groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("pair"))
    before, roots = roots, grown(roots, checked(materialise(likely.select("pair.*"))))
    discard(before)
    of = lambda side: roots.toDF(side, f"new_{side}")
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("new_a", "root_a") != F.coalesce("new_b", "root_b"))
    tried = likely.select("pair.*")
    before, roots = roots, grown(roots, checked(materialise(rest.select("a", "b").join(tried, ["a", "b"], "left_anti"))))
    discard(before)
    discard(pairs)
    grouped = equal.join(roots, equal["first"] == roots["node"], "left").select(equal["node"], "doc_id", "text_check", F.coalesce("root", "first").alias("root"))
    led = materialise(grouped.groupBy("root").agg(F.min_by(F.struct("node", "doc_id"), order).alias("lead")))
    gone = materialise(grouped.join(led, "root").filter("node <> lead.node").select("node", "doc_id", "text_check", F.col("lead.doc_id").alias("leader")))
    for frame in (firsts, equal, roots, led):
        discard(frame)
    return gone


def text_keys(text: Column) -> dict[str, Column]:
    """Two hashes of a text; both stand for its equality."""
    return {"text_hash": F.xxhash64(text), "text_check": F.xxhash64(F.lit("check"), text)}


def with_nodes(docs: DataFrame) -> DataFrame:
    """node, doc_id, text_hash, text_check and the text as a string, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(text_keys(F.col("text")))
    return read.withColumn("node", F.xxhash64("doc_id", "text_hash"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents without near copies of others, with all their columns.

    Rows with equal id and text are one document. A row goes only if node, id and check are those
    of a document that another one stands for.
    """
    gone = near_copies(docs, **how).select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), F.col("text_check").alias("_check"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = text_keys(text)
    noded = docs.withColumns({"_node": F.xxhash64(F.col("doc_id").cast("long"), keys["text_hash"]), "_id_of": F.col("doc_id").cast("long"), "_check_of": keys["text_check"]})
    some, rest = split_by_ids(noded, "_node", gone)
    named = gone.withColumnRenamed("_node", "_gone")
    left = some.join(named, (F.col("_node") == F.col("_gone")) & F.col("_id_of").eqNullSafe(F.col("_id")) & (F.col("_check_of") == F.col("_check")), "left_anti")
    return left.unionByName(rest).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
