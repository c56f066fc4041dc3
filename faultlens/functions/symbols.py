"""Symbols touched by a diff, from the function context of its hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are never symbols
KEYWORDS = [
    "static", "const", "extern", "inline", "void", "char", "int", "long", "short", "unsigned", "signed", "u8", "u16",
    "u32", "u64", "s8", "s16", "s32", "s64", "size_t", "ssize_t", "bool", "struct", "union", "enum", "typedef", "auto",
    "register", "volatile", "if", "else", "for", "while", "do", "return", "goto", "switch", "case", "break", "continue",
    "default", "endif", "ifdef", "ifndef", "elif", "include", "pragma", "the", "The", "This", "this", "and", "or", "not",
    "is", "Description", "TODO", "FIXME", "XXX",
]
# Fixed patterns: names, and the lines that begin a file's part and a hunk of a diff
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
FILE = r"^diff --git a/(.+?) b/.+?$"
HUNK = r"^@@\s+-\d+(?:,\d+)?\s+\+\d+(?:,\d+)?\s+@@\s*(.*)$"


def plausible(token: Column) -> Column:
    """Macro-like, snake case, or long camel case; never a short or reserved word."""
    shape = token.rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$") | token.contains("_") | ((F.length(token) >= 8) & token.rlike("^.+[A-Z]"))
    return (F.length(token) >= 4) & ~token.isin(KEYWORDS) & shape


def symbol(context: Column) -> Column:
    """struct<symbol,kind>: a macro, else a called or defined function, else an array or assigned name, else the
    first plausible name; (NULL, unknown) if there is none."""
    s = F.trim(F.coalesce(context, F.lit("")))
    one = lambda words: F.try_element_at(words, F.lit(1))
    macro = F.nullif(F.regexp_extract(s, rf"^#\s*define\s+({IDENTIFIER})", 1), F.lit(""))
    called = one(F.filter(F.regexp_extract_all(s, F.lit(rf"({IDENTIFIER})\s*\("), F.lit(1)), lambda w: ~w.isin(KEYWORDS)))
    assigned = one(F.filter(F.regexp_extract_all(s, F.lit(rf"({IDENTIFIER})\s*(?:\[|=(?!=))"), F.lit(1)), plausible))
    named = one(F.filter(F.regexp_extract_all(s, F.lit(IDENTIFIER), F.lit(0)), plausible))
    kind = F.when(macro.isNotNull(), "macro").when(called.isNotNull(), "function").when(assigned.isNotNull(), "struct").otherwise("unknown")
    return F.struct(F.coalesce(macro, called, assigned, named).alias("symbol"), kind.alias("kind"))


def diff_symbols(diffs: DataFrame, key: str, text: str, sentinel: str = "__NONE__") -> DataFrame:
    """key, file, symbol, kind: one row for each symbol of each file; a diff without any has one sentinel row."""
    lines = diffs.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    name = F.nullif(F.regexp_extract("line", FILE, 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        lines.withColumn("file", F.last(name, ignorenulls=True).over(w))
        .where(F.col("line").rlike(HUNK) & F.col("file").isNotNull())
        .withColumn("s", symbol(F.regexp_extract("line", HUNK, 1)))
        .where("s.symbol is not null")
        .groupBy(key, "file", F.col("s.symbol").alias("symbol"))
        .agg(F.min_by("s.kind", "at").alias("kind"))
    )
    none = diffs.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(none.select(key, F.lit(sentinel).alias("file"), F.lit(sentinel).alias("symbol"), F.lit("sentinel").alias("kind")))


def patch_fingerprint(diff: Column) -> Column:
    """SHA-256 over a diff's file names and changed lines without white space, so that neither line numbers nor
    re-indented context matter; NULL without changed lines."""
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.rlike(r"^(?:diff --git |[+-](?![+-]{2} ))"))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", ""))
    changed = F.exists(lines, lambda x: x.rlike("^[+-]"))
    return F.when(changed, F.sha2(F.array_join(bare, "\n"), 256))
