"""Readers for feeds, archives and evaluation files, and normalisers of their rows."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import text


def atom_hits(spark: SparkSession, path: str, snippet: int = 500) -> DataFrame:
    """message_id, title, permalink, updated, snippet of Atom search results; entries whose last segment is no id go."""
    schema = "title string, link struct<_href:string>, updated string, summary string, content string"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    last = F.element_at(F.filter(F.split(F.col("link._href"), "/"), lambda x: x != ""), -1)
    return rows.where(last.contains("@")).select(
        last.alias("message_id"), F.trim("title").alias("title"), F.col("link._href").alias("permalink"), text.timestamp_or_null(F.col("updated")).alias("updated"),
        F.left(F.coalesce("summary", "content", F.lit("")), F.lit(snippet)).alias("snippet"),
    )


def pair_file(spark: SparkSession, path: str) -> DataFrame:
    """commit_hash, bug_ref, confidence of a JSON array of pairs."""
    return spark.read.schema("commit_hash string, bug_ref string").json(path, multiLine=True).where("commit_hash is not null").select(F.lower("commit_hash").alias("commit_hash"), "bug_ref", F.lit(0.92).alias("confidence")).distinct()


def commit_csv(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, date, subject of a CSV with a header; dates that cannot be read are NULL."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.select("hash", "author", text.timestamp_or_null(F.col("date")).alias("date"), "subject").where("hash is not null").dropDuplicates(["hash"])


def published_cves(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, hashes of a tree with a .sha1 (one hash) and a .dyad (colon-separated, the 4th field is a backport) file
    a record."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    cve = F.regexp_extract("file", r"(CVE-\d{4}-\d{4,7})\.", 1)
    field = F.when(F.col("file").endswith(".sha1"), F.col("line")).otherwise(F.try_element_at(F.split("line", ":"), F.lit(4)))
    found = lines.select(cve.alias("cve_id"), F.regexp_extract(F.coalesce(field, F.lit("")), r"^([0-9a-f]{12,40})$", 1).alias("hash")).where("hash <> ''")
    return found.groupBy("cve_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))


def code_hits(df: DataFrame, key: str, markdown: str, lines: int = 8) -> DataFrame:
    """key, nth, file, score, snippet of Markdown search results ('## file (score: x)' and a fenced block); blocks
    without lines go."""
    block = F.posexplode(F.filter(F.split(F.coalesce(markdown, F.lit("")), r"(?m)^#{2,3} "), lambda b: F.trim(b) != ""))
    body = F.regexp_extract("b", r"(?s)```[^\n]*\n(.*?)\n?```", 1)
    return (
        df.select(key, block.alias("nth", "b"))
        .select(key, "nth", F.regexp_extract("b", r"^`?([^\s`(]+)", 1).alias("file"), F.regexp_extract("b", r"(?i)score:?\s*([\d.]+)", 1).try_cast("double").alias("score"), F.array_join(F.slice(F.split(body, "\n"), 1, lines), "\n").alias("snippet"))
        .where("snippet <> ''")
    )


CASES = "id string, category string, kernel_version string, question string, error_keywords array<string>, expected_commit_hashes array<string>, expected_bug_ids array<string>, expected_route string, notes string"


def eval_cases(spark: SparkSession, path: str, ids: list[str] | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Cases of a JSON list, or of a {cases: [...]} object; by ids, else by category and limit."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_typed(CASES)}>>")
    wrapped = F.from_json("value", f"cases array<struct<{_typed(CASES)}>>")["cases"]
    whole = raw.select(F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped).alias("c"))
    df = whole.select(F.inline("c"))
    if ids:
        return df.where(F.col("id").isin(ids))
    df = df.where(F.col("category") == category) if category else df
    return df.orderBy("id").limit(limit) if limit else df


def _typed(schema: str) -> str:
    return ", ".join(c.strip().replace(" ", ":", 1) for c in schema.split(", "))


REPORT = "path string, uname string, dmesg string, hostname string"
_MEMBERS = {"uname": ("sos_commands/kernel/uname_-a", "uname"), "dmesg": ("sos_commands/kernel/dmesg", "var/log/dmesg", "dmesg"), "hostname": ("hostname", "etc/hostname")}


def system_reports(spark: SparkSession, path: str, last_lines: int = 200) -> DataFrame:
    """path, uname, dmesg (last lines), hostname of support archives (tar, any compression); the first of the usual
    places that an archive has counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for place, content in zip(frame["path"], frame["content"], strict=True):
                found: dict[str, str | None] = dict.fromkeys(_MEMBERS)
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        names = {m.name.partition("/")[2] or m.name: m for m in tar.getmembers() if m.isfile()}
                        for field, places in _MEMBERS.items():
                            member = next((names[p] for p in places if p in names), None)
                            if member is not None:
                                found[field] = tar.extractfile(member).read().decode("utf-8", "replace").strip()
                except tarfile.TarError:
                    pass
                if found["dmesg"]:
                    found["dmesg"] = "\n".join(found["dmesg"].splitlines()[-last_lines:])
                rows.append({"path": place, **found})
            yield pd.DataFrame(rows, columns=["path", *_MEMBERS])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, REPORT)


def bug_rows(raw: DataFrame, source: str) -> DataFrame:
    """Rows of a tracker's JSON as bugs: source, external_id, title, status, resolution, severity, created, updated."""
    return raw.select(
        F.lit(source).alias("source"), F.col("id").cast("string").alias("external_id"), F.left("summary", F.lit(1024)).alias("title"), text.mapped(F.col("status"), text.STATUS).alias("status"),
        text.mapped(F.col("resolution"), text.RESOLUTION).alias("resolution"), text.mapped(F.col("severity"), text.SEVERITY).alias("severity"),
        text.timestamp_or_null(F.col("creation_time")).alias("created"), text.timestamp_or_null(F.col("last_change_time")).alias("updated"),
    )


def commit_rows(raw: DataFrame, origin: str) -> DataFrame:
    """Parsed commits as table rows: trailers, inclusion (vendor trees only), subsystem, short hash; merges are dropped."""
    body = F.col("body")
    some = lambda a: F.when(F.size(a) > 0, a)
    vendor = origin != "mainline"
    i = text.inclusion(body)
    out = raw.select(
        "hash", F.substring("hash", 1, 12).alias("short_hash"), "author", F.col("date").alias("commit_date"), "subject", "body", some(text.fixes(body)).alias("fixes_refs"), some(text.reported_by(body)).alias("reported_by"),
        some(text.trailer_urls(body, "Closes")).alias("closes_refs"), text.subsystem(F.col("files")).alias("subsystem"), F.lit(origin).alias("origin"),
        (i["kind"] if vendor else F.lit(None).cast("string")).alias("inclusion_type"), (F.when(i["kind"] == "backport", i["best"]) if vendor else F.lit(None).cast("string")).alias("upstream_commit"),
    )
    return out.where("inclusion_type is null or inclusion_type <> 'merge'")


def event_rows(events: DataFrame, raw: Column, kind: Column, trace: Column) -> DataFrame:
    """Log events as stored rows: a content hash as key, raw text and trace cut to their column widths."""
    return events.select("*", text.event_id(raw, kind).alias("event_id"), F.left(raw, F.lit(50_000)).alias("raw_text"), F.left(F.array_join(trace, "\n"), F.lit(20_000)).alias("trace_text")).dropDuplicates(["event_id"])


def cached_responses(cache: DataFrame, requests: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """requests with cache_key and response: SHA-256 of the request as canonical JSON; entries past their time and
    requests with a temperature miss."""
    key = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(requests.columns)])), 256)
    fresh = cache.where(F.col("created") >= now - F.expr(f"interval {ttl_days} days")).select("cache_key", "response")
    asked = requests.withColumn("cache_key", key)
    hit = asked.join(fresh, "cache_key", "left")
    return hit.withColumn("response", F.when(F.col("temperature") == 0, F.col("response"))) if "temperature" in requests.columns else hit


def free_space(folder: str) -> tuple[float, str]:
    """(share of the disk that is free, ok | low | stop): below 20 % low, below 10 % stop."""
    import shutil

    usage = shutil.disk_usage(folder)
    share = usage.free / usage.total
    return share, "stop" if share < 0.1 else "low" if share < 0.2 else "ok"
