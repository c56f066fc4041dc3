"""Column functions over commit bodies, mails, bug texts and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords of a question, and status maps of bug trackers
QUESTION_STOP_WORDS = [
    "the", "and", "for", "that", "this", "how", "what", "why", "when", "with", "from", "into", "does", "are", "can",
    "has", "have", "its", "not", "but", "was", "had", "our", "all",
]
STATUS = {
    "NEW": "new", "ASSIGNED": "in_progress", "IN_PROGRESS": "in_progress", "REOPENED": "new", "RESOLVED": "resolved",
    "VERIFIED": "resolved", "CLOSED": "closed", "NEEDINFO": "need_info",
}
RESOLUTION = {
    "FIXED": "fixed", "INVALID": "invalid", "WONTFIX": "wont_fix", "DUPLICATE": "duplicate",
    "WORKSFORME": "works_for_me", "NOTABUG": "not_a_bug", "": "",
}
SEVERITY = {
    "BLOCKER": "critical", "CRITICAL": "critical", "MAJOR": "major", "NORMAL": "normal", "MINOR": "minor",
    "TRIVIAL": "trivial", "ENHANCEMENT": "enhancement",
}
LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "WARNING": 2, "ERROR": 3}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it: functions of arrays are evaluated as they are
    written, and what stands inside one of their lambdas is evaluated for each element."""
    return F.transform(F.array(value), then)[0]


def every(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a group; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or NULL."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def fixes(body: Column) -> Column:
    return F.transform(every(body, r"(?im)^Fixes:\s+([0-9a-f]{7,40})"), F.lower)


def reported_by(body: Column) -> Column:
    return F.transform(every(body, r"(?im)^Reported-by:[^\S\n]*(\S[^\n]*)"), lambda x: F.trim(x))


def trailer_urls(body: Column, name: str) -> Column:
    return every(body, rf"(?im)^{name}:\s*(https?://\S+)")


def review_trailers(body: Column) -> Column:
    """array<struct<kind,name,email>> of review trailers."""
    pattern = r"(?im)^(Reviewed|Acked|Tested|Signed-off|Reported)-by:[^\S\n]*([^<\n]*?)[^\S\n]*<([^>\n]+)>"
    kinds, names, mails = (every(body, pattern, g) for g in (1, 2, 3))
    return F.arrays_zip(F.transform(kinds, F.lower).alias("kind"), names.alias("name"), mails.alias("email"))


def patch_tag(subject: Column) -> Column:
    """struct<is_patch,version,number,total> of [PATCH vN i/n]."""
    tag = r"(?i)\[[^\]]*PATCH(?:[^\]]*?\bv(\d+))?(?:[^\]]*?\b(\d+)/(\d+))?[^\]]*\]"
    number = lambda g: first(subject, tag, g).try_cast("int")
    return F.struct(subject.rlike(tag).alias("is_patch"), number(1).alias("version"), number(2).alias("number"), number(3).alias("total"))


def inclusion(body: Column) -> Column:
    """struct<kind,tag,head,upstream,best>: what a vendor tree's inclusion header says about a commit's origin.

    The header stands above the first dashed line; mainline and stable are backports, other tags native. A stable
    header's mainline hash stands below the line. best is the mainline hash to link to."""
    zones = F.split(F.coalesce(body, F.lit("")), r"(?m)^-{3,}[^\S\n]*$", 2)
    header, tail = zones[0], F.coalesce(F.try_element_at(zones, F.lit(2)), F.lit(""))
    pattern = r"(?im)^([\w\-]+)\s+inclusion\s*\n(?:from\s+\S+\s*\n)?commit\s+([0-9a-f]{7,40})\b"
    tag, head = F.lower(first(header, pattern, 1)), F.lower(first(header, pattern, 2))
    merge = F.coalesce(body.rlike(r"(?im)^Merge (?:pull request|request)|^Merge .* from "), F.lit(False))
    upstream = F.when(tag == "stable", F.lower(first(tail, r"\[\s*[Uu]pstream\s+commit\s+([0-9a-f]{7,40})\s*\]")))
    kind = F.when(merge, "merge").when(tag.isNull(), "no_header").when(tag.isin("mainline", "stable"), "backport").otherwise("native")
    known = kind.isin("backport", "native")
    best = F.when(tag == "mainline", head).when(tag == "stable", F.coalesce(upstream, head))
    return F.struct(kind.alias("kind"), F.when(known, tag).alias("tag"), F.when(known, head).alias("head"), F.when(known, upstream).alias("upstream"), F.when(known, best).alias("best"))


def subsystem(files: Column) -> Column:
    """Common prefix (by characters) of the files' directories, at most three segments; NULL without directories.
    The prefix of all equals that of the smallest and the largest."""
    dirs = F.transform(F.filter(files, lambda f: f.contains("/")), lambda f: F.regexp_replace(f, "[^/]*$", ""))

    def common(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        length = F.aggregate(
            F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(low, n + 1, F.lit(1)) == F.substring(high, n + 1, F.lit(1))), i).otherwise(n)
        )
        prefix = F.regexp_replace(F.substring(low, F.lit(1), length), "/+$", "")
        return F.nullif(F.array_join(F.slice(F.split(prefix, "/"), 1, 3), "/"), F.lit(""))

    found = let(dirs, lambda of: F.struct(F.array_min(of).alias("low"), F.array_max(of).alias("high")))
    return let(found, lambda ends: F.when(ends["low"].isNotNull(), common(ends)))


def message_ids(body: Column, host: str = r"lore\.kernel\.org") -> Column:
    return every(body, rf"(?i)https?://{host}/[^\s]+/([^/\s>]+@[^/\s>]+)")


def clean_message_id(raw: Column) -> Column:
    """Without brackets and trailing punctuation; NULL if it cannot be an id."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^<+|>+$", ""), r"[.,;:'\")\]}>]+$", "")
    return F.when(F.length(bare).between(5, 998) & bare.contains("@") & ~bare.rlike(r"\s"), bare)


def bug_refs(body: Column, host: str = r"bugzilla\.kernel\.org") -> Column:
    """array<struct<id,link_type>>: a tracker URL closes, a short form fixes."""
    by = lambda pattern, kind: F.transform(every(body, pattern), lambda i: F.struct(i.alias("id"), F.lit(kind).alias("link_type")))
    return F.array_distinct(F.concat(by(rf"{host}/show_bug\.cgi\?id=(\d+)", "closes"), by(r"(?i)(?:bsc#|BZ-|bz#|bug #?)(\d+)", "fixes")))


def issue_ids(body: Column, host_path: str, pattern: str) -> Column:
    """Upper-cased ids of issue URLs below host_path."""
    return F.array_distinct(F.transform(every(body, rf"(?i){host_path}/issues/({pattern})"), F.upper))


def cve_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(every(text, r"(?i)CVE-\d{4}-\d{4,7}", 0), F.upper)))


def fix_hashes(urls: Column, description: Column) -> Column:
    """Hashes of commit URLs (one a URL) and those named behind fix, commit or patch in a text; sorted."""
    of_urls = F.filter(F.transform(urls, lambda u: F.lower(first(u, r"(?i)(?:commit/|commit/\?id=|[?;&]id=|/c/)([0-9a-f]{7,40})"))), lambda h: h.isNotNull())
    return F.array_sort(F.array_union(of_urls, F.transform(every(description, r"(?i)(?:fix(?:ed)?|commit|patch)\s+(?:in\s+|by\s+)?([0-9a-f]{7,40})\b"), F.lower)))


def hashes(text: Column, least: int = 7) -> Column:
    return every(text, rf"\b[0-9a-f]{{{least},40}}\b", 0)


def keywords(question: Column, most: int = 15) -> Column:
    tokens = every(F.lower(question), r"[a-z_][a-z0-9_]{2,}", 0)
    return F.slice(F.filter(tokens, lambda t: ~t.isin(QUESTION_STOP_WORDS)), 1, most)


def clean_keywords(query: Column, most: int = 15) -> Column:
    """Split at blanks, without quotes, two characters at least, without (case-insensitive) repeats, in order."""
    words = F.filter(F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.regexp_replace(w, "[\"']", "")), lambda w: F.length(w) >= 2)
    low = F.transform(words, F.lower)
    return F.slice(F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's value for an upper-cased key; others fall through lower-cased."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.upper(value)), F.lower(value))


def level_rank(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.upper(level)), F.lit(1))


def versions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(every(text, r"\bv?(\d+\.\d+(?:\.\d+)?)\b")))


def version_label(text: Column, known: tuple[str, ...] = ("6.6", "5.10"), prefix: str = "LTS-") -> Column:
    out = F.lit(None).cast("string")
    for v in reversed(known):
        out = F.when(text.rlike(rf"(?<![\d.])v?{v.replace('.', chr(92) + '.')}(?![\d])"), F.lit(prefix + v)).otherwise(out)
    return F.coalesce(out, F.when(text.rlike(r"(?i)\bmainline\b"), F.lit("mainline")))


def significant_tokens(text: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(every(F.lower(text), r"[a-z0-9_]{4,}", 0), lambda t: ~t.isin(stop)))


def overlap(claim: Column, evidence: Column, stop: list[str]) -> Column:
    """Share of the claim's tokens that the evidence has; 0 without tokens."""
    a, b = significant_tokens(claim, stop), significant_tokens(evidence, stop)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge_hashes(existing: Column, more: Column, head: int = 12) -> Column:
    """existing, then those of more whose first `head` characters are new, in order."""
    return F.aggregate(more, F.coalesce(existing, F.array().cast("array<string>")), lambda have, h: F.when(F.exists(have, lambda x: F.substring(x, 1, head) == F.substring(h, 1, head)), have).otherwise(F.array_append(have, h)))


def event_id(raw: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat(raw, F.lit("\0"), kind), 256), 1, 32)


def timestamp_or_null(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def since_cutoff(since: Column, now: Column) -> Column:
    """now less a span of hours or days (6h, 7d); less 24 hours for anything else."""
    unit = F.regexp_extract(since, r"^(\d+)([hd])$", 2)
    hours = F.regexp_extract(since, r"^(\d+)([hd])$", 1).try_cast("int") * F.when(unit == "d", 24).otherwise(1)
    return now - F.make_dt_interval(F.lit(0), F.coalesce(hours, F.lit(24)))


def first_label(labels: Column, pattern: str) -> Column:
    """What the pattern's first group takes from the first label that it matches, in small letters; NULL for none."""
    found = F.filter(labels, lambda x: F.coalesce(x, F.lit("")).rlike(pattern))
    return F.lower(F.regexp_extract(F.try_element_at(found, F.lit(1)), pattern, 1))


def evidence_lines(rank: Column, score: Column, title: Column, body: Column, **ids: Column) -> Column:
    """A hit for reading: rank, score, title and the ids it has; below, the first 300 characters of its body in one line."""
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] score="), F.format_string("%.2f", score), F.lit(" | "), F.coalesce(title, F.lit("")))
    for name, value in ids.items():
        shown = F.nullif(value.cast("string"), F.lit(""))
        head = F.concat(head, F.coalesce(F.concat(F.lit(f" | {name}="), shown), F.lit("")))
    return F.concat(head, F.coalesce(F.concat(F.lit("\n    "), F.translate(F.left(F.nullif(body, F.lit("")), F.lit(300)), "\n", " ")), F.lit("")))
