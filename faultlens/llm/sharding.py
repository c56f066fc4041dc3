"""Sharding by fixed virtual slots. DataFrame operations only.

A record's virtual slot is the hash of its doc_id modulo n_slots (thousands, fixed for the life of the data set).
Bytes are summed by slot; a versioned map says which shard holds a slot. Version 1 deals slots out in turn;
rebalancing edits single entries of the map (the slots that move), so records never get another slot, and a new
shard is filled by slots taken from the others. The map has n_slots rows, a constant, so it is edited on the driver
and joined by broadcast.

Law: `bytes`, shard sizes are near equal: the edits go on until no move or exchange of slots narrows the gap between
the largest and the smallest shard. Results: a null text has 0 bytes and size 1; a null doc_id hashes like any value;
repeated rows count each; `slot` numbers the rows of a shard from 0 by (virtual slot, doc_id, text_crc32, size); an
empty table gives an empty result, and a map all the same; columns besides doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.llm.shared import new_folder


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. edits: (slot, from, to) of the step from the version before."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = field(default=())

    @classmethod
    def first(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(1, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def edited(self, moves: dict[int, int], n_shards: int | None = None) -> SlotMap:
        shard_of = list(self.shard_of)
        done = tuple((s, shard_of[s], to) for s, to in sorted(moves.items()) if shard_of[s] != to)
        for s, _, to in done:
            shard_of[s] = to
        return SlotMap(self.version + 1, n_shards or self.n_shards, tuple(shard_of), done)

    def rebalanced(self, load: list[int]) -> SlotMap:
        """Move slots from the fullest shard to the emptiest, or exchange two, while that narrows the gap."""
        slots: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for s, shard in enumerate(self.shard_of):
            if load[s]:
                slots[shard].append((load[s], s))
        for own in slots:
            own.sort()
        total = [sum(w for w, _ in own) for own in slots]
        moves: dict[int, int] = {}
        stuck: set[int] = set()  # shards that cannot give (one large slot); the others are evened out without them
        for _ in range(8 * len(load)):
            order = sorted((k for k in range(self.n_shards) if k not in stuck), key=lambda k: (total[k], k))
            if len(order) < 2:
                break
            low, high = order[0], order[-1]
            gap = total[high] - total[low]
            best, step = gap, None  # the gap that is left
            at = bisect_left(slots[high], (gap // 2, -1))
            for i in (at - 1, at):
                if 0 <= i < len(slots[high]) and abs(gap - 2 * slots[high][i][0]) < best:
                    best, step = abs(gap - 2 * slots[high][i][0]), (i, None)
            if best > 1:
                for i, (w, _) in enumerate(slots[high]):
                    at = bisect_left(slots[low], (w - gap // 2, -1))
                    for j in (at - 1, at):
                        if 0 <= j < len(slots[low]) and abs(gap - 2 * (w - slots[low][j][0])) < best:
                            best, step = abs(gap - 2 * (w - slots[low][j][0])), (i, j)
            if step is None:
                stuck.add(high)
                continue
            i, j = step
            out = slots[high].pop(i)
            back = slots[low].pop(j) if j is not None else None
            for (w, s), source, to in ((out, high, low), *([(back, low, high)] if back else [])):
                slots[to].insert(bisect_left(slots[to], (w, s)), (w, s))
                total[source] -= w
                total[to] += w
                moves[s] = to
        return self.edited(moves)

    def grown(self, load: list[int]) -> SlotMap:
        """One more shard; slots move only into it, from the fullest shards, up to its fair share."""
        share = sum(load) / (self.n_shards + 1)
        by = {k: sorted((load[s], s) for s, own in enumerate(self.shard_of) if own == k) for k in range(self.n_shards)}
        total = {k: sum(w for w, _ in own) for k, own in by.items()}
        moves, filled = {}, 0
        while filled < share:
            high = max(total, key=lambda k: (total[k], -k))
            fitting = [x for x in by[high] if 0 < x[0] <= share - filled]
            if not fitting:
                break
            w, s = max(fitting)
            by[high].remove((w, s))
            total[high] -= w
            filled += w
            moves[s] = self.n_shards
        return self.edited(moves, self.n_shards + 1)

    def save(self, spark: SparkSession, place: str) -> None:
        """Adds this version to the map's folder, which keeps all versions: the whole map, and each slot's shard in the
        version before where this one moved it."""
        before = {s: k for s, k, _ in self.edits}
        rows = [(self.n_shards, s, k, before.get(s)) for s, k in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "n_shards int, virtual_slot int, shard int, moved_from int").coalesce(1).write.parquet(f"{place}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, place: str, version: int) -> SlotMap:
        rows = sorted(tuple(r) for r in spark.read.parquet(f"{place}/version={version}").select("virtual_slot", "shard", "n_shards", F.coalesce("moved_from", F.lit(-1))).collect())
        edits = tuple((s, old, k) for s, k, _, old in rows if old >= 0)
        return cls(version, rows[0][2], tuple(r[1] for r in rows), edits)

    @classmethod
    def latest(cls, spark: SparkSession, place: str) -> SlotMap | None:
        """The newest complete version in the folder; None where there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/version=*/_SUCCESS"))
        versions = [int(f.getPath().getParent().getName().partition("=")[2]) for f in done or []]
        return cls.load(spark, place, max(versions)) if versions else None


def with_slot(docs: DataFrame, n_slots: int) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    ).withColumn("size", F.col("bytes") + 1)


def slot_loads(records: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """(bytes, rows) of every virtual slot; n_slots rows reach the driver at most."""
    load, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).collect():
        load[r["virtual_slot"]], rows[r["virtual_slot"]] = r["load"], r["n"]
    return load, rows


def assigned(records: DataFrame, mapping: SlotMap, rows: list[int]) -> DataFrame:
    """records with shard and slot, the row's number within its shard. Only windows over one virtual slot are
    needed: a slot's rows start where the shard's earlier slots end."""
    spark, start, seen = records.sparkSession, [], [0] * mapping.n_shards
    for s, shard in enumerate(mapping.shard_of):
        start.append((s, shard, seen[shard]))
        seen[shard] += rows[s]
    listing = F.broadcast(spark.createDataFrame(start, "virtual_slot int, shard int, start long").coalesce(1))
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        records.withColumn("rank", F.row_number().over(order))
        .join(listing, "virtual_slot")
        .withColumn("slot", F.col("start") + F.col("rank") - 1)
        .drop("rank", "start")
    )


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = 8192, place: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, map_version.

    place: the map's folder. Its newest version is edited (version 1 is dealt out where the folder holds none), the
    edited one is stored as the next version, and rows are assigned by what is read back."""
    spark = docs.sparkSession
    place = place or new_folder(spark, "slot-map")
    records = with_slot(docs, n_slots)
    load, rows = slot_loads(records, n_slots)
    held = SlotMap.latest(spark, place)
    if held is None:
        SlotMap.first(n_slots, n_shards).save(spark, place)
        held = SlotMap.load(spark, place, 1)
    if (held.n_shards, len(held.shard_of)) != (n_shards, n_slots):
        raise ValueError(f"the stored map has {held.n_shards} shards and {len(held.shard_of)} slots")
    held.rebalanced(load).save(spark, place)
    mapping = SlotMap.load(spark, place, held.version + 1)
    return assigned(records, mapping, rows).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", F.lit(mapping.version).alias("map_version"))
