"""Full-text retrieval: postings, conjunctive tiers in one pass, BM25, route merging and link expansion.

A postings table has doc_id, term, tf, dl (terms of the document) and positions. `Index.write` stores it once, sorted
by term in ranges of terms, beside one row of corpus statistics: a query then reads the row groups of the terms it
asks for, and only their postings are grouped by document. Without an index the same plans run over postings that are
counted in place, which tokenises the whole corpus for each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.operators.ranking import max_normalised, top_n

SPLIT = r"[^\p{L}\p{N}_]+"
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """key, term, tf, dl. stem: English stems instead of words (an Arrow-batched Python function)."""
    from faultlens.functions.stem import stemmed

    t = terms(F.col(text))
    each = docs.select(F.col(key), (stemmed(t) if stem else t).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def wanted_postings(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Postings of the asked terms only, counted in place: nothing but them is moved."""
    t = terms(F.col(text))
    base = docs.select(F.col(key), t.alias("t")).select(key, F.size("t").alias("dl"), F.explode(F.filter("t", lambda x: x.isin(words))).alias("term"))
    return base.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """n_docs, avg_dl over all documents: one row."""
    return docs.select(F.size(terms(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def scored(found: DataFrame, stats: DataFrame, key: str, words: list[str], match_all: bool = False, every: DataFrame | None = None) -> DataFrame:
    """key, matched (distinct terms), score (BM25) from the postings of the words. every: the postings that terms are
    counted in, where found is only a part of them."""
    words = list(dict.fromkeys(words))
    df = (found if every is None else every).groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each asked term
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    out = found.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(key).agg(F.count(F.lit(1)).alias("matched"), F.sum(part).alias("score"))
    return out.where(F.col("matched") == len(words)) if match_all else out


def bm25(docs: DataFrame, key: str, text: str, words: list[str], match_all: bool = False) -> DataFrame:
    """`scored` over documents without an index."""
    return scored(wanted_postings(docs, key, text, list(dict.fromkeys(words))), corpus_stats(docs, text), key, words, match_all)


def tiers_of(found: DataFrame, key: str, words: list[str], least: int = 3) -> DataFrame:
    """key, prefix (how many leading keywords all occur), tier (the same for all rows) from the postings of the words.

    The longest conjunction of leading keywords that at least `least` documents satisfy is chosen, tier 0 (any
    keyword) if none is. One pass instead of one query a tier: a document satisfies tier k iff its prefix is >= k."""
    words = list(dict.fromkeys(words))
    rows = found.groupBy(key).agg(F.collect_set("term").alias("t"))
    prefix = F.lit(len(words))
    for k in range(len(words) - 1, -1, -1):
        prefix = F.when(~F.array_contains("t", words[k]), F.lit(k)).otherwise(prefix)
    rows = rows.select(key, prefix.alias("prefix"))
    counts = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))  # a row for each length
    reach = counts.select(F.sum("n").over(Window.orderBy(F.desc("prefix"))).alias("reached"), "prefix").where(f"reached >= {least} and prefix > 0")
    tier = reach.agg(F.coalesce(F.max("prefix"), F.lit(0)).alias("tier"))
    return rows.join(F.broadcast(tier)).where((F.col("tier") == 0) | (F.col("prefix") >= F.col("tier")))


def tiers(docs: DataFrame, key: str, text: str, words: list[str], least: int = 3) -> DataFrame:
    """`tiers_of` over documents without an index."""
    return tiers_of(wanted_postings(docs, key, text, list(dict.fromkeys(words))), key, words, least)


class Index:
    """An inverted index in a folder: postings/ (key, term, tf, dl, positions; ascending ranges of terms) and stats/."""

    def __init__(self, spark: SparkSession, place: str, key: str) -> None:
        self.key, self.all = key, spark.read.parquet(f"{place}/postings")
        self.stats = spark.read.parquet(f"{place}/stats")

    @classmethod
    def write(cls, docs: DataFrame, key: str, text: str, place: str, stem: bool = False) -> Index:
        """Each term's postings stand together, in order of key; a frequent term may fill several files."""
        from faultlens.functions.stem import stemmed

        t = terms(F.col(text))
        own = docs.select(F.col(key), (stemmed(t) if stem else t).alias("t"))
        each = own.select(key, F.size("t").alias("dl"), F.posexplode("t").alias("at", "term"))
        made = each.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
        made.repartitionByRange("term", key).sortWithinPartitions("term", key).write.option("parquet.block.size", 16 << 20).parquet(f"{place}/postings")
        own.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("t")).alias("avg_dl")).coalesce(1).write.parquet(f"{place}/stats")
        return cls(docs.sparkSession, place, key)

    def postings(self, words: list[str]) -> DataFrame:
        return self.all.where(F.col("term").isin(list(dict.fromkeys(words)))).select(self.key, "dl", "term", "tf")

    def bm25(self, words: list[str], match_all: bool = False) -> DataFrame:
        return scored(self.postings(words), self.stats, self.key, words, match_all)

    def tiers(self, words: list[str], least: int = 3) -> DataFrame:
        return tiers_of(self.postings(words), self.key, words, least)

    def tiered_search(self, words: list[str], limit: int, kept: DataFrame | None = None) -> DataFrame:
        """key, tier, score: the chosen tier's documents by BM25; kept: only of these keys (chosen before the tier)."""
        every = self.postings(words)
        found = every if kept is None else every.join(kept.select(self.key), self.key, "left_semi")
        return _ranked(tiers_of(found, self.key, words).join(scored(found, self.stats, self.key, words, every=every), self.key), self.key, limit)

    def places(self, words: list[str]) -> DataFrame:
        """The words' postings with positions."""
        return self.all.where(F.col("term").isin(words))

    def cover_rank(self, words: list[str]) -> DataFrame:
        """key, rank: cover density of documents that have all words, from stored positions."""
        words = list(dict.fromkeys(words))
        found = self.places(words).groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
        every = found.where(F.size("m") == len(words)).select(self.key, F.array(*[F.col("m")[w] for w in words]).alias("p"))
        return _cover_ranked(every, self.key)


def _ranked(found: DataFrame, key: str, limit: int) -> DataFrame:
    return found.select(key, "tier", "score").orderBy(F.desc(F.round("score", 6)), key).limit(limit)


def tiered_search(docs: DataFrame, key: str, text: str, words: list[str], limit: int) -> DataFrame:
    """key, tier, score: the chosen tier's documents by BM25."""
    return _ranked(tiers(docs, key, text, words).join(bm25(docs, key, text, words), key), key, limit)


def inject(hits: DataFrame, edges: DataFrame, source_route: str, factor: float, step: int, sources: int = 10, per_source: int | None = None) -> DataFrame:
    """Commit hits reached over links from a route's best hits: score x factor; per_source caps links of one hit. A link
    may stand in edges several times; only those of the best hits are made distinct."""
    top = top_n(hits.where(F.col("route") == source_route), ["route"], [F.desc("score"), F.col("id")], sources)
    linked = F.broadcast(top.select("id", "score")).join(edges.select(F.col("source").alias("id"), F.col("target")), "id").distinct()
    if per_source:
        linked = top_n(linked, ["id"], [F.col("target")], per_source)
    return linked.select(F.lit("commit").alias("route"), F.col("target").alias("id"), (F.col("score") * factor).alias("score"), F.lit(step).alias("step"))


def merged(hits: DataFrame, injected: list[DataFrame], limit: int = 100) -> DataFrame:
    """Hits and injected hits (earlier steps win, present ones are not added again), normalised by route, with the
    tier bonus, in one total order."""
    base = hits.withColumn("step", F.lit(0))
    every = base
    for more in injected:
        every = every.unionByName(more.withColumn("tier", F.lit(0)), allowMissingColumns=True)
    first = top_n(every, ["route", "id"], [F.col("step"), F.desc("score")], 1).drop("rn")
    score = max_normalised(first, "route", "score") * (1 + 0.25 * F.coalesce("tier", F.lit(0)))
    return first.withColumn("final", score).orderBy(F.desc(F.round("final", 6)), "route", "id").limit(limit)


def cover_density(positions: list[list[int]]) -> float:
    """Clarke, Cormack and Tudhope's cover density: the sum over shortest covers of all terms, each worth its terms
    over its length. positions: ascending places of each term."""
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted((x, k) for k, p in enumerate(positions) for x in p)
    last: dict[int, int] = {}
    total, covered = 0.0, -1
    for x, k in events:
        last[k] = x
        if len(last) == len(positions):
            start = min(last.values())
            if start > covered:
                total += len(positions) / max(1, x - start + 1)
                covered = start
    return total


def _cover_ranked(places: DataFrame, key: str) -> DataFrame:
    """key, p (ascending positions of each word) -> key, rank."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "rank": [cover_density([list(p) for p in row]) for row in frame["p"]]})

    return places.mapInPandas(run, f"{key} {places.schema[key].dataType.simpleString()}, rank double")


def cover_rank(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """key, rank: cover density of documents that have all words."""
    t = terms(F.col(text))
    places = F.array(*[F.filter(F.transform("t", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()) for w in words])  # noqa: B023
    return _cover_ranked(docs.select(F.col(key), t.alias("t")).select(key, places.alias("p")).where(F.forall("p", lambda x: F.size(x) > 0)), key)


def flagship(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return tiered_search(docs, "doc_id", "text", ["the", "tion", "of"], 20)
