"""An inverted index that follows changes: immutable segments, lists of deleted keys, a manifest swapped last.

A segment is built in one pass and one shuffle: a document's postings are counted within its row (Arrow), dealt to
buckets by term and document slice, so that no term fills a bucket alone, sorted, and packed into blocks of BLOCK documents.
A block row has term, keys, tfs, dls and positions, and its peaks: the (tf, dl) pairs that no other of the block beats, from
which the block's best BM25 part follows exactly whatever the corpus statistics become. The list of documents is
kept as the postings of the empty term. A query reads only the buckets of its words.

An update writes a segment of the changed documents and, for each segment that held some of their earlier forms, a list of
deleted keys: nothing else is rewritten. When FAN segments have about one size, they are merged into one without being
tokenised again. The manifest names the segments of a version with their live counts; readers of an earlier version are
not disturbed until `vacuum`.

`top_k` returns the k best documents for any of some words without scoring all postings: from the blocks' best parts follows
a score that k documents surely reach, and only blocks that overlap a stretch of documents which may reach it are opened.

Rows without a key are not indexed; a key that comes twice in one change is two documents, and both are replaced by the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.ranking import top_n
from faultlens.plans.search import K1, B, Index, terms

BLOCK = 128
FAN = 4
SLICE_DOCS = 1_000_000
TOKENS = 200_000  # of one counting step
BUCKET_TOKENS = 1_000_000  # about so many are sorted by one task
WORD_CHARS = 5
RARE = 1000  # postings of a word that is looked at whole for the least score
PUSHED = 1000  # block numbers that are sent along as a filter of the scan


@dataclass(frozen=True)
class Segment:
    name: str
    n_docs: int  # live
    sum_dl: int  # of live documents
    n_deleted: int
    slices: int
    buckets: int
    deletes: tuple[str, ...] = ()


_SEGMENT = "struct<name: string, n_docs: long, sum_dl: long, n_deleted: long, slices: int, buckets: int, deletes: array<string>>"
_MANIFEST = f"key string, key_type string, text string, stem boolean, stop array<string>, segments array<{_SEGMENT}>"


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _bucket(term, key, slices: int, buckets: int):
    return F.pmod(F.crc32(term) + F.pmod(F.xxhash64(key), F.lit(slices)), F.lit(buckets)).cast("int")


def _counted(key: str):
    """Rows (key, t: its terms, empty where a word is left out) -> key, dl, term, tf, positions; the empty term has a
    row for each document."""

    def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends, first = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOKENS, side="right")))
            yield batch.slice(first, last - first)
            first = last

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in steps(batch):
                n = pc.list_value_length(some.column("t")).to_numpy(zero_copy_only=False)
                coded = some.column("t").flatten().dictionary_encode()
                code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                used = np.not_equal(words.to_numpy(zero_copy_only=False), "")[code] if len(code) else np.zeros(0, bool)
                row, at, code = row[used], at[used], code[used]
                dl = np.bincount(row, minlength=len(n)).astype(np.int32)
                order = np.argsort(row * max(1, len(words)) + code, kind="stable")
                row, at, code = row[order], at[order], code[order]
                head = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(code) != 0)))) if len(row) else row
                ends = np.append(head, len(row)).astype(np.int32)
                every = np.concatenate((row[head], np.arange(len(n))))
                term = pa.concat_arrays([words.take(pa.array(code[head])), pa.array([""] * len(n), words.type)])
                offsets = np.concatenate((ends, np.full(len(n), len(row), np.int32)))
                tf = np.concatenate((np.diff(ends), np.zeros(len(n), np.int32))).astype(np.int32)
                positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(key).take(pa.array(every)), pa.array(dl[every]), term, pa.array(tf), positions], [key, "dl", "term", "tf", "positions"])

    return run


def _packed(key: str):
    """Sorted rows (bucket, term, key, dl, tf, positions) -> blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, tf, dl = (batch.column(c).to_numpy() for c in ("bucket", "tf", "dl"))
            term = batch.column("term").dictionary_encode().indices.to_numpy()
            new = np.concatenate(([True], (np.diff(term) != 0) | (np.diff(bucket) != 0)))
            start = np.flatnonzero(new)
            within = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
            head = np.flatnonzero(within % BLOCK == 0)
            ends = np.append(head, len(term)).astype(np.int32)
            block = np.repeat(np.arange(len(head)), np.diff(ends))
            order = np.lexsort((dl, -tf, block))  # peaks: from the highest tf down, each shorter than all before
            low = np.minimum.accumulate(dl[order].astype(np.int64) - (block[order] << 33))
            peak = np.concatenate(([True], low[1:] < low[:-1]))
            peaks = np.append(0, np.cumsum(np.bincount(block[order][peak], minlength=len(head)))).astype(np.int32)
            lists = lambda values, at=ends: pa.ListArray.from_arrays(pa.array(at), values)
            ids = (bucket[head].astype(np.int64) << 40) + nth + np.arange(len(head))
            nth += len(head)
            keys, first, last = batch.column(key), pa.array(head), pa.array(ends[1:] - 1)
            columns = {
                "bucket": pa.array(bucket[head]), "term": batch.column("term").take(first), "block": pa.array(ids), "n": pa.array(np.diff(ends)), "first": keys.take(first), "last": keys.take(last),
                "peak_tf": lists(pa.array(tf[order][peak]), peaks), "peak_dl": lists(pa.array(dl[order][peak]), peaks), "keys": lists(keys), "tfs": lists(batch.column("tf")), "dls": lists(batch.column("dl")), "positions": lists(batch.column("positions")),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


class SegmentIndex(Index):
    """The newest (or a given) version of the index in a folder."""

    def __init__(self, spark: SparkSession, place: str, version: int | None = None) -> None:
        self.spark, self.place = spark, place
        self.version = max(_versions(spark, place)) if version is None else version
        row = spark.read.schema(_MANIFEST).parquet(f"{place}/manifest/v{self.version:08d}").first()
        self.key, self.key_type, self.text, self.stem, self.stop = row["key"], row["key_type"], row["text"], row["stem"], list(row["stop"])
        self.segments = [Segment(**{**s.asDict(), "deletes": tuple(s["deletes"])}) for s in row["segments"]]

    @classmethod
    def write(cls, docs: DataFrame, key: str, text: str, place: str, stem: bool = False, stop: Iterable[str] = ()) -> SegmentIndex:
        """A new index of docs. stem: English stems instead of words; stop: words that are left out (they keep their
        places)."""
        _save(docs.sparkSession, place, 0, (key, docs.schema[key].dataType.simpleString(), text, stem, sorted(stop), []))
        return cls(docs.sparkSession, place, 0).update(docs)

    # --- changes

    def update(self, changed: DataFrame | None = None, deleted: DataFrame | None = None, merge: bool = True) -> SegmentIndex:
        """The index after documents were added or changed and keys deleted (a key that is in both is changed)."""
        keys = [df.select(self.key) for df in (changed, deleted) if df is not None]
        gone = reduce(DataFrame.unionByName, keys).where(F.col(self.key).isNotNull()).distinct() if keys else None
        segments = self.segments if gone is None else [self._without(s, gone) for s in self.segments]
        if changed is not None:
            n_docs, chars = changed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(self.text)), F.lit(0))).first()
            made = self._build(self._tokenised(changed.where(F.col(self.key).isNotNull())), n_docs, chars // WORD_CHARS)
            segments = [*segments, made]
        return self._next([s for s in segments if s.n_docs], merge)

    def _next(self, segments: list[Segment], merge: bool) -> SegmentIndex:
        while merge:
            tiers: dict[int, list[Segment]] = {}
            for s in segments:
                tiers.setdefault((s.n_docs - 1).bit_length() // 2, []).append(s)  # sizes by powers of 4
            full = [t for t in tiers.values() if len(t) >= FAN]
            if not full:
                break
            made = self._build(reduce(DataFrame.unionByName, map(self._rows, full[0])), sum(s.n_docs for s in full[0]), sum(s.sum_dl for s in full[0]))
            segments = [*[s for s in segments if s not in full[0]], made]
        listed = [(s.name, s.n_docs, s.sum_dl, s.n_deleted, s.slices, s.buckets, list(s.deletes)) for s in segments]
        _save(self.spark, self.place, self.version + 1, (self.key, self.key_type, self.text, self.stem, self.stop, listed))
        return SegmentIndex(self.spark, self.place, self.version + 1)

    def _tokenised(self, docs: DataFrame) -> DataFrame:
        from faultlens.functions.stem import stemmed

        t = terms(F.col(self.text))
        if self.stop:
            t = F.transform(t, lambda w: F.when(w.isin(self.stop), F.lit("")).otherwise(w))
        rows = docs.select(self.key, (stemmed(t) if self.stem else t).alias("t"))
        return rows.mapInArrow(_counted(self.key), f"{self._field()}, dl int, term string, tf int, positions array<int>")

    def _field(self) -> str:
        return f"`{self.key}` {self.key_type}"

    def _kinds(self) -> str:
        k = self.key_type
        return f"bucket int, term string, block long, n int, first {k}, last {k}, peak_tf array<int>, peak_dl array<int>, keys array<{k}>, tfs array<int>, dls array<int>, positions array<array<int>>"

    def _build(self, rows: DataFrame, n_docs: int, tokens: int) -> Segment:
        """A segment of postings rows; n_docs and tokens: about how many documents and words they are of. Buckets grow with
        the words, so that a task sorts its bucket in memory at any size."""
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
        slices = max(1, min(buckets, -(-n_docs // SLICE_DOCS)))
        name = f"{self.version + 1:08d}-{uuid4().hex[:8]}"
        dealt = rows.withColumn("bucket", _bucket(F.col("term"), F.col(self.key), slices, buckets)).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "term", self.key)
        blocks = dealt.mapInArrow(_packed(self.key), self._kinds()).sortWithinPartitions("bucket", "term", "block")
        blocks.write.partitionBy("bucket").option("parquet.block.size", 16 << 20).parquet(f"{self.place}/segments/{name}")
        made = Segment(name, 0, 0, 0, slices, buckets)
        n, dl = self._documents(made).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return replace(made, n_docs=n, sum_dl=dl)

    def _without(self, s: Segment, gone: DataFrame) -> Segment:
        place = f"{self.place}/deletes/{self.version + 1:08d}-{uuid4().hex[:8]}"
        self._documents(s).join(gone, self.key, "left_semi").select(self.key, "dl").write.parquet(place)
        n, dl = self.spark.read.parquet(place).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return replace(s, n_docs=s.n_docs - n, sum_dl=s.sum_dl - dl, n_deleted=s.n_deleted + n, deletes=(*s.deletes, place)) if n else s

    def vacuum(self) -> None:
        """Deletes what this version does not use, and all earlier versions."""
        kept = {s.name for s in self.segments} | {d.rpartition("/")[2] for s in self.segments for d in s.deletes} | {f"v{self.version:08d}"}
        for kind in ("segments", "deletes", "manifest"):
            fs, path = _fs(self.spark, f"{self.place}/{kind}")
            for status in fs.listStatus(path) if fs.exists(path) else ():
                if status.getPath().getName() not in kept:
                    fs.delete(status.getPath(), True)

    # --- reading

    def _blocks(self, s: Segment, words: list[str] | None = None) -> DataFrame:
        every = self.spark.read.schema(self._kinds()).parquet(f"{self.place}/segments/{s.name}")
        if words is None:
            return every
        buckets = sorted({(zlib.crc32(w.encode()) + k) % s.buckets for w in words for k in range(s.slices)})
        return every.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    def _live(self, rows: DataFrame, s: Segment) -> DataFrame:
        return rows.join(self.spark.read.parquet(*s.deletes).select(self.key), self.key, "left_anti") if s.deletes else rows

    def _exploded(self, blocks: DataFrame, *more: str) -> DataFrame:
        each = F.explode(F.arrays_zip("keys", "tfs", "dls", *more)).alias("e")
        return blocks.select("term", each).select(F.col("e.keys").alias(self.key), F.col("e.dls").alias("dl"), "term", F.col("e.tfs").alias("tf"), *[f"e.{c}" for c in more])

    def _documents(self, s: Segment) -> DataFrame:
        return self._live(self._exploded(self._blocks(s, [""])), s).select(self.key, "dl")

    def _rows(self, s: Segment, words: list[str] | None = None) -> DataFrame:
        """Live postings with positions."""
        return self._live(self._exploded(self._blocks(s, words), "positions"), s)

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _asked(self, words: list[str]) -> list[str]:
        words = [w for w in dict.fromkeys(words) if w not in self.stop]
        if self.stem:
            from faultlens.functions.stem import stem

            words = list(dict.fromkeys(map(stem, words)))
        return words

    @property
    def all(self) -> DataFrame:
        kinds = f"{self._field()}, dl int, term string, tf int, positions array<int>"
        return self._union([self._rows(s) for s in self.segments], kinds).where("term <> ''")

    @property
    def stats(self) -> DataFrame:
        n = sum(s.n_docs for s in self.segments)
        return self.spark.createDataFrame([(n, sum(s.sum_dl for s in self.segments) / n if n else None)], "n_docs long, avg_dl double")

    def postings(self, words: list[str]) -> DataFrame:
        words = self._asked(words)
        parts = [self._live(self._exploded(self._blocks(s, words)), s).select(self.key, "dl", "term", "tf") for s in self.segments]
        return self._union(parts, f"{self._field()}, dl int, term string, tf int")

    def places(self, words: list[str]) -> DataFrame:
        words = self._asked(words)
        return self._union([self._rows(s, words) for s in self.segments], f"{self._field()}, dl int, term string, tf int, positions array<int>")

    # --- the best documents without all postings

    def top_k(self, words: list[str], k: int) -> DataFrame:
        """key, score: the k best documents for any of the words, by score rounded to 6 places, then key."""
        found, _ = self.opened(words, k)
        return found

    def opened(self, words: list[str], k: int) -> tuple[DataFrame, DataFrame]:
        """(top_k, the blocks that it opens: term, n)."""
        words = self._asked(words)
        heads = self._union(
            [self._blocks(s, words).select(F.lit(i).alias("segment"), "bucket", "term", "block", "n", "first", "last", "peak_tf", "peak_dl") for i, s in enumerate(self.segments)],
            f"segment int, bucket int, term string, block long, n int, first {self.key_type}, last {self.key_type}, peak_tf array<int>, peak_dl array<int>",
        )
        # frequencies of the words: a row each
        df = dict(heads.groupBy("term").agg(F.sum("n")).collect())
        for i, s in enumerate(self.segments):
            if s.deletes:
                keys = self._blocks(s, words).select("term", F.explode("keys").alias(self.key))
                lost = keys.join(self.spark.read.parquet(*s.deletes).select(self.key), self.key, "left_semi").groupBy("term").count()
                for term, n in lost.collect():
                    df[term] -= n
        n_docs = sum(s.n_docs for s in self.segments)
        average = sum(s.sum_dl for s in self.segments) / n_docs if n_docs else 1.0
        idf = {w: float(np.log(1 + (n_docs - n + 0.5) / (n + 0.5))) for w, n in df.items() if n > 0}
        weight = F.create_map(*[F.lit(x) for w, v in (idf or {"": 0.0}).items() for x in (w, v)])
        part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
        bound = weight[F.col("term")] * F.array_max(F.zip_with("peak_tf", "peak_dl", part))
        heads = heads.withColumn("bound", bound).where("bound is not null")
        # peaks of one word's blocks are different documents: the k-th best is reached by k of them (deleted ones are
        # made up for by going as many places further); a rare word's postings are looked at one by one
        lost = sum(s.n_deleted for s in self.segments)
        rare = [w for w in idf if df[w] <= max(RARE, 10 * k)]
        peaks = heads.where(~F.col("term").isin(rare)).select("term", "bound", F.lit(k + lost).alias("place"))
        parts = [self._live(self._exploded(self._blocks(s, rare)), s) for s in self.segments] if rare else []
        parts = [p.select("term", (weight[F.col("term")] * part(F.col("tf"), F.col("dl"))).alias("bound"), F.lit(k).alias("place")) for p in parts]
        ranked = top_n(reduce(DataFrame.unionByName, parts, peaks), ["term"], [F.desc("bound")], k + lost)
        best = ranked.where(F.col("rn") == F.col("place")).agg(F.max("bound")).first()[0]
        floor = (best or 0.0) - 2e-6
        slices = F.create_map(*[F.lit(x) for i, s in enumerate(self.segments) for x in (i, s.buckets)]) if self.segments else F.lit(1)
        placed = heads.withColumn("slice", F.pmod(F.col("bucket") - F.crc32("term"), slices[F.col("segment")] if self.segments else slices).cast("int"))
        kept = placed.repartition("segment", "slice").sortWithinPartitions("segment", "slice").mapInArrow(_reachable(floor), "segment int, term string, block long, n int")
        parts = []
        near = kept.limit(PUSHED + 1).collect()
        for i, s in enumerate(self.segments):
            blocks = self._blocks(s, words)
            if len(near) <= PUSHED:
                blocks = blocks.where(F.col("block").isin([r["block"] for r in near if r["segment"] == i]))
            else:
                blocks = blocks.join(kept.where(F.col("segment") == i).select("block"), "block", "left_semi")
            parts.append(self._live(self._exploded(blocks), s).select(self.key, "dl", "term", "tf"))
        every = self._union(parts, f"{self._field()}, dl int, term string, tf int")
        score = every.groupBy(self.key).agg(F.sum(weight[F.col("term")] * part(F.col("tf"), F.col("dl"))).alias("score"))
        return score.select(self.key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), self.key).limit(k), kept


def _reachable(floor: float):
    """Blocks of whole (segment, slice) groups -> those that overlap a stretch of keys where the bounds add up to floor."""

    def of(rows: list[dict]) -> list[dict]:
        cuts = sorted({r["first"] for r in rows} | {r["last"] for r in rows})
        place = {c: 2 * i for i, c in enumerate(cuts)}  # odd places are the gaps between
        total = np.zeros(2 * len(cuts))
        spans = []
        for term in {r["term"] for r in rows}:  # a word's blocks may share a border key, but no document
            best = np.zeros(2 * len(cuts))
            for r in rows:
                if r["term"] == term:
                    a, b = place[r["first"]], place[r["last"]] + 1
                    best[a:b] = np.maximum(best[a:b], r["bound"])
            total += best
        reach = np.concatenate(([0], np.cumsum(total >= floor)))
        for r in rows:
            a, b = place[r["first"]], place[r["last"]] + 1
            if reach[b] > reach[a]:
                spans.append(r)
        return spans

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("segment", pa.int32()), ("term", pa.string()), ("block", pa.int64()), ("n", pa.int32())])
        held, at = [], None
        for batch in batches:
            for r in batch.select(["segment", "slice", "term", "block", "n", "first", "last", "bound"]).to_pylist():
                if (r["segment"], r["slice"]) != at:
                    if held:
                        yield pa.RecordBatch.from_pylist([{c: x[c] for c in kind.names} for x in of(held)], kind)
                    held, at = [], (r["segment"], r["slice"])
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in kind.names} for x in of(held)], kind)

    return run


def _save(spark: SparkSession, place: str, version: int, row: tuple) -> None:
    """A version appears as a whole or not at all; one that exists is refused."""
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").parquet(f"{place}/manifest/v{version:08d}")


def _versions(spark: SparkSession, place: str) -> list[int]:
    fs, path = _fs(spark, f"{place}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [int(n[1:]) for n in names if fs.exists(_fs(spark, f"{place}/manifest/{n}/_SUCCESS")[1])]
