"""File sources and sinks. Fetching from networks and running commands are left to the caller: files come in."""

from __future__ import annotations

import datetime
import email
import email.policy
import email.utils
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_LIKE = r"^[^\s#<>:][^\s]*$"


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, email, date, subject, body, files of a log written with SOH between records and NUL between
    fields (hash, author, email, date, subject, body and files). A record's last path-like lines are its files; dates
    that cannot be read are NULL."""
    raw = spark.read.text(path, lineSep="\x01").where("trim(value) <> ''")
    f = F.split("value", "\x00")
    at = lambda i: F.try_element_at(f, F.lit(i))
    hashes = F.regexp_extract_all(at(1), F.lit(r"(?m)^([0-9a-f]{40})$"), F.lit(1))
    lines = F.split(F.rtrim(at(6)), "\n")
    path_like = lambda x: x.rlike(PATH_LIKE) & (x.contains("/") | x.rlike(r"^(?:Makefile|Kconfig|README|MAINTAINERS|[\w-]+\.\w+)$"))
    # walk from the end while lines are paths or blank: struct<open, files>
    walked = F.aggregate(
        F.reverse(lines),
        F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((acc["open"] & (path_like(x) | (F.trim(x) == ""))).alias("open"), F.when(acc["open"] & (path_like(x) | (F.trim(x) == "")), acc["n"] + 1).otherwise(acc["n"]).alias("n")),
    )["n"]
    split = F.size(lines) - walked
    return raw.where(F.size(f) >= 6).select(
        F.element_at(hashes, -1).alias("hash"), at(2).alias("author"), at(3).alias("email"), F.try_to_timestamp(at(4)).alias("date"), at(5).alias("subject"),
        F.trim(F.array_join(F.slice(lines, F.lit(1), split), "\n")).alias("body"), F.filter(F.slice(lines, split + 1, walked), lambda x: F.trim(x) != "").alias("files"),
    )


MAIL = "message_id string, in_reply_to string, refs array<string>, author string, date timestamp, subject string, body string"


def _mail(raw: bytes) -> dict | None:
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    own = (m.get("Message-ID") or m.get("Message-Id") or "").strip().strip("<>")
    if not own:
        return None
    try:
        date = email.utils.parsedate_to_datetime(m.get("Date"))
        date = (date if date.tzinfo else date.replace(tzinfo=datetime.UTC)).astimezone(datetime.UTC).replace(tzinfo=None)
    except (TypeError, ValueError):
        date = None
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()), None)
    payload = part.get_payload(decode=True) if part is not None else b""
    ids = lambda h: [x.strip("<>") for x in str(m.get(h) or "").split() if "@" in x]
    return {
        "message_id": own, "in_reply_to": (ids("In-Reply-To") or [None])[0], "refs": ids("References"), "author": str(m.get("From") or "") or None,
        "date": date, "subject": str(m.get("Subject") or "") or None, "body": _decoded(payload or b"", part.get_content_charset() if part is not None else None),
    }


def _decoded(raw: bytes, charset: str | None) -> str:
    """By the stated charset, or as UTF-8; what does not fit is Latin-1."""
    for name in (charset, "utf-8"):
        try:
            return raw.decode(name or "utf-8")
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("latin-1")


def mailbox(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Mails of mbox files, each file read in parts of split_bytes; a mail begins at a 'From ' line. Those without an id
    are left out. The parser sees the bytes of the file."""
    from faultlens.sources import splittable

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [m for raw in frame["raw"] if (m := _mail(raw.partition(b"\n")[2] if raw.startswith(b"From ") else raw))]
            yield pd.DataFrame(rows, columns=["message_id", "in_reply_to", "refs", "author", "date", "subject", "body"]).astype({"date": "datetime64[us]"})

    splittable.register(spark)
    return spark.read.format("mailbox").option("split_bytes", split_bytes).load(path).select("raw").mapInPandas(run, MAIL)


def maintainers(spark: SparkSession, path: str) -> DataFrame:
    """name, status, people (array), files (array), excluded (array): sections of a MAINTAINERS file; sections of one
    name are merged."""
    block = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("b")).where(F.col("b").rlike(r"(?m)^[A-Z]:\s"))
    tag = lambda t: F.transform(F.regexp_extract_all("b", F.lit(rf"(?m)^{t}:[^\S\n]*(\S[^\n]*)$"), F.lit(1)), lambda x: F.trim(x))
    one = block.select(F.regexp_extract("b", r"(?m)^([^\n:]*\S[^\n:]*)\n[A-Z]:\s", 1).alias("name"), F.try_element_at(tag("S"), F.lit(1)).alias("status"), tag("M").alias("people"), tag("F").alias("files"), tag("X").alias("excluded"))
    many = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return one.groupBy("name").agg(F.min("status").alias("status"), many("people"), many("files"), many("excluded"))


def json_logs(spark: SparkSession, path: str, since: str | None = None, level: int = 0, trace_id: str | None = None, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Lines of JSON logs in folders date=YYYY-MM-DD; folders before `since` are not read. limit: only so many, the
    newest, in order: one task reads from the newest folder back and stops when it has them (pattern is then one of
    Python); without one all files are read at once and the lines come unordered."""
    if limit is not None:
        from faultlens.sources import splittable

        splittable.register(spark)
        first = (datetime.date.fromisoformat(since[:10]) - datetime.timedelta(days=1)).isoformat() if since else None
        options = {"limit": limit, "from_date": first, "since": since, "least_level": level, "trace_id": trace_id, "pattern": pattern}
        found = spark.read.format("dated_logs").options(**{k: v for k, v in options.items() if v is not None}).load(path)
        return found.orderBy(F.desc("ts"), "module", "message")
    from faultlens.functions.text import level_rank

    df = spark.read.schema("ts string, level string, module string, trace_id string, message string, date date").json(path)
    for keep in (
        F.col("date") >= F.date_sub(F.to_date(F.lit(since)), 1) if since else None,
        F.col("ts") >= since if since else None,
        level_rank(F.col("level")) >= level if level else None,
        F.col("trace_id") == trace_id if trace_id else None,
        F.col("message").rlike(pattern) if pattern else None,
    ):
        df = df if keep is None else df.where(keep)
    return df


def cve_records(spark: SparkSession, path: str) -> DataFrame:
    """cve_id, description, score, references (array of url and tags) of JSON lines: the first English description,
    the version 3.1 score or else the 3.0 one."""
    schema = (
        "id string, descriptions array<struct<lang:string,value:string>>, metrics struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double>>>,"
        "cvssMetricV30:array<struct<cvssData:struct<baseScore:double>>>>, references array<struct<url:string,tags:array<string>>>"
    )
    df = spark.read.schema(schema).json(path)
    first = lambda a: F.try_element_at(a, F.lit(1))
    score = F.coalesce(first(F.col("metrics.cvssMetricV31"))["cvssData"]["baseScore"], first(F.col("metrics.cvssMetricV30"))["cvssData"]["baseScore"])
    return df.select(F.col("id").alias("cve_id"), first(F.filter("descriptions", lambda x: x["lang"] == "en"))["value"].alias("description"), score.cast("decimal(4,1)").alias("score"), "references")


def crash_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, trace (first <pre>), fix_commits (distinct hashes, only on pages with a fix marker)."""
    body = F.col(html)
    text = F.regexp_replace(F.regexp_extract(body, r"(?is)<pre[^>]*>(.*?)</pre>", 1), "<[^>]+>", "")
    hashes = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b[0-9a-f]{12,40}\b"), F.lit(0)))
    return pages.select(
        key, F.nullif(F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"), F.nullif(F.trim(text), F.lit("")).alias("trace"),
        F.when(F.lower(body).rlike("fix(?:ed)? commit|fix:"), hashes).otherwise(F.array().cast("array<string>")).alias("fix_commits"),
    )


def write_mailbox(mails: DataFrame, path: str) -> None:
    """Raw mails as compressed text in folders by list and year."""
    mails.select("list", "year", "raw").write.partitionBy("list", "year").option("compression", "gzip").mode("append").text(path)


def quarantine(df: DataFrame, bad, reason: str, path: str) -> DataFrame:
    """Writes rows for which `bad` holds (or is NULL) with a reason and the time, and returns the others."""
    wrong = F.coalesce(bad, F.lit(True))
    df.where(wrong).select(F.to_json(F.struct(*df.columns)).alias("item"), F.lit(reason).alias("reason"), F.current_timestamp().alias("at")).write.mode("append").json(path)
    return df.where(~wrong)


def replay(spark: SparkSession, path: str, schema: str, reason: str | None = None, most: int = 100) -> DataFrame:
    """Quarantined items as rows again, those of the newest runs first."""
    items = spark.read.schema("item string, reason string, at timestamp").json(path)
    items = items if reason is None else items.where(F.col("reason") == reason)
    return items.orderBy(F.desc("at"), "item").limit(most).select(F.from_json("item", schema).alias("row")).select("row.*")
