"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand virtual slots. Bytes are summed per slot, and a
versioned slot-to-shard map places whole slots on shards. A table's map has one place in the shared
folder, where a version is committed whole under a number of its own: of two writers one gets the
number, the other starts from what that one wrote. Rebalancing edits the latest version by the
slots' sizes and commits the next; records never hash again. The map and the slot sizes have
`n_slots` rows at most, whatever the data's size, so they may pass through the driver and be
broadcast.

Equal texts are documents of their own, each in the slot of its id: no group is held together.
Edge cases: a null text has no bytes (size 1); a null id hashes like any other value; repeated
rows each take a place of their own; an empty table gives an empty result; other columns are
kept by `assign` and never used.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import commits
from ..shared import remove, shared_base
from .common import table, text_or_empty

N_SLOTS = 4096
N_SHARDS = 8
MAP_SCHEMA = "version int, vslot int, shard int"


def with_slot(df: DataFrame, key: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """Add `vslot`, the record's virtual slot; it depends on the key alone and never changes."""
    return df.withColumn("vslot", F.pmod(F.xxhash64(F.col(key)), F.lit(n_slots)).cast("int"))


def slot_sizes(slotted: DataFrame, size: str = "size") -> DataFrame:
    """Bytes and rows of each slot that has any; combined before the shuffle."""
    return slotted.groupBy("vslot").agg(F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def first_map(sizes: list[tuple[int, int]], n_slots: int, n_shards: int) -> list[tuple[int, int, int]]:
    """Version 1: largest slot first, each to the shard with the fewest bytes."""
    known = dict(sizes)
    order = sorted(range(n_slots), key=lambda s: (-known.get(s, 0), s))
    heap = [(0, k, k) for k in range(n_shards)]
    out = []
    for s in order:
        load, n, shard = heapq.heappop(heap)
        out.append((1, s, shard))
        heapq.heappush(heap, (load + known.get(s, 0), n + n_shards, shard))
    return sorted(out)


def edit_map(current: list[tuple[int, int, int]], sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int]]:
    """The next version of a map, for `n_shards` shards.

    Slots leave shards that go, and overfull shards; they move to the shard with the fewest
    bytes. All other slots stay where they are, so a rebalance moves little more than it must.
    """
    known, version = dict(sizes), current[0][0] + 1
    held: dict[int, list[int]] = {k: [] for k in range(n_shards)}
    homeless = []
    for _, s, shard in current:
        (held[shard] if shard in held else homeless).append(s)
    load = {k: sum(known.get(s, 0) for s in v) for k, v in held.items()}
    fair = (sum(load.values()) + sum(known.get(s, 0) for s in homeless)) / n_shards
    for k, v in held.items():
        for s in sorted(v, key=lambda s: (known.get(s, 0), s)):
            if load[k] - known.get(s, 0) < fair:
                break
            v.remove(s)
            homeless.append(s)
            load[k] -= known.get(s, 0)
    for s in sorted(homeless, key=lambda s: (-known.get(s, 0), s)):
        k = min(load, key=lambda k: (load[k], k))
        held[k].append(s)
        load[k] += known.get(s, 0)
    return sorted((version, s, k) for k, v in held.items() for s in v)


def collect_sizes(sizes: DataFrame) -> list[tuple[int, int]]:
    """At most n_slots rows."""
    return [(r.vslot, r.slot_bytes) for r in sizes.select("vslot", "slot_bytes").collect()]


def map_frame(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, MAP_SCHEMA)


def map_place(spark: SparkSession, name: str, n_slots: int) -> str:
    """Where the maps of a table stand; it outlives the run."""
    return f"{shared_base(spark)}/slot-maps/{sha256(name.encode()).hexdigest()[:24]}-{n_slots}"


def store_map(slot_map: DataFrame, path: str) -> bool:
    """Commit a map as the version that it names; False, and no trace, if there is one already."""
    spark, name = slot_map.sparkSession, commits.fresh()
    version = slot_map.first().version
    slot_map.coalesce(1).write.parquet(f"{path}/maps/{name}")
    if commits.commit(spark, path, version, name):
        return True
    remove(spark, f"{path}/maps/{name}")
    return False


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map; the latest by default."""
    found = commits.versions(spark, path)
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/maps/{found[version or max(found)]}")


def is_fair(current: list[tuple[int, int, int]], sizes: list[tuple[int, int]], n_shards: int) -> bool:
    """Whether a map has these shards and none is over the mean by more than the largest slot."""
    known, load = dict(sizes), dict.fromkeys(range(n_shards), 0)
    for _, s, k in current:
        load[k] = load.get(k, 0) + known.get(s, 0)
    held = {k for *_, k in current}
    return held == set(range(n_shards)) and max(load.values()) - sum(load.values()) / n_shards <= max(known.values(), default=0)


def stored_map(spark: SparkSession, path: str, sizes: list[tuple[int, int]], n_slots: int, n_shards: int) -> DataFrame:
    """The map to use: version 1 if none is stored, else the latest, edited into the next version
    until it is fair. What another writer commits meanwhile is read and judged anew."""
    while True:
        found = commits.numbers(spark, path)
        latest = sorted(map(tuple, load_map(spark, path).collect())) if commits.versions(spark, path) else []
        if not latest:
            made = [(max(found, default=0) + 1, s, k) for _, s, k in first_map(sizes, n_slots, n_shards)]
        elif is_fair(latest, sizes, n_shards):
            return load_map(spark, path, latest[0][0])
        else:
            made = [(max(found) + 1, s, k) for _, s, k in edit_map(latest, sizes, n_shards)]
        if store_map(map_frame(spark, made), path):
            return load_map(spark, path, made[0][0])


def assign(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add `shard` from the map, which has n_slots rows at most and so is broadcast."""
    return slotted.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot", "left")


def place(assigned: DataFrame, sizes: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Add `slot`, the record's place in its shard, gapless from 0.

    A place is the number of records in the shard's earlier virtual slots (from the slot
    sizes) plus the rank in its own: no sort ever holds more than one virtual slot.
    """
    first = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
        .withColumn("slot_start", F.coalesce(F.sum("slot_rows").over(first), F.lit(0)))
        .select("vslot", "slot_start")
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy(*order))
    return assigned.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("slot_start") + rank - 1).drop("slot_start")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None, name: str = "documents") -> DataFrame:
    """Documents with size, checksum, shard and place, balanced by bytes (law `bytes`).

    map_path is where the slot map's versions are stored, by default the place of the table `name` in
    the shared folder. The text is only measured in the scans; what is shuffled has a few numbers a record.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    slim = with_slot(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")),
        "doc_id",
        n_slots,
    )
    sizes = slot_sizes(slim)
    slot_map = stored_map(spark, map_path or map_place(spark, name, n_slots), collect_sizes(sizes), n_slots, n_shards)
    return place(assign(slim, slot_map), sizes, slot_map, ["doc_id", "text_crc32", "size"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), name=f"{sf_dir}/documents")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
