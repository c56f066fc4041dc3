"""Registration of queries and of text tables that are derived from whole fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


class Derived:
    """A text table with a row for every row of a fixture table, written once and read alike by both engines: row number
    key % n takes the n-th form. In its texts {k} stands for the key, {a} for the key in letters, {h} for 12 hexadecimal
    digits of it, and {g} for a number that n neighbouring keys have in common. The first column is the key."""

    def __init__(self, schema: str, forms: list[tuple], table: str = "orders", key: str = "o_orderkey", pick: str | None = None) -> None:
        self.columns = [c.split() for c in schema.split(", ")]
        self.forms, self.table, self.key, self.pick = forms, table, key, pick or key

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        n, key = len(self.forms), F.col(self.key).cast("string")
        marks = {"{k}": key, "{a}": F.translate(key, "0123456789", "abcdefghij"), "{h}": F.left(F.sha1(key.cast("binary")), F.lit(12)), "{g}": F.floor(F.col(self.key) / n).cast("string")}
        (name, kind), *rest = self.columns
        out = [F.col(self.key).cast(kind).alias(name)]
        for at, (column, sort) in enumerate(rest):
            made = F.element_at(F.array(*[F.lit(f[at]).cast(sort) for f in self.forms]), (F.expr(self.pick) % n + 1).cast("int"))
            for mark, value in marks.items() if sort == "string" else ():
                made = F.replace(made, F.lit(mark), value)
            out.append(made.alias(column))
        return table(spark, sf_dir, self.table).select(*out)

    def sql(self, name: str) -> str:
        cast = {"long": "BIGINT", "boolean": "BOOLEAN", "string": "VARCHAR"}
        (first, kind), *rest = self.columns
        out = [f"CAST({self.key} AS {cast[kind]}) AS {first}"]
        for at, (column, sort) in enumerate(rest):
            said = [v if v is None or isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in (f[at] for f in self.forms)]
            made = f"[{', '.join('NULL' if v is None else str(v) for v in said)}][CAST({self.pick} % {len(self.forms)} AS INT) + 1]"
            for mark, value in self._marks().items() if sort == "string" else ():
                made = f"replace({made}, '{{{mark}}}', {value})"
            out.append(f"CAST({made} AS {cast[sort]}) AS {column}")
        return f"{name} AS (SELECT {', '.join(out)} FROM {self.table})"

    def _marks(self) -> dict[str, str]:
        key = f"CAST({self.key} AS VARCHAR)"
        return {"k": key, "a": f"translate({key}, '0123456789', 'abcdefghij')", "h": f"left(sha1({key}), 12)", "g": f"CAST({self.key} // {len(self.forms)} AS VARCHAR)"}

    def expected(self, columns: str, rows: dict[int, list[str]]) -> str:
        """SQL of the rows that each form has to give, written as SQL values over id, k, a, h and g."""
        marks = ", ".join(f"{v} AS {m}" for m, v in self._marks().items())
        parts = [f"SELECT {row} FROM keys WHERE form = {form}" for form, own in rows.items() for row in own]
        return f"WITH keys AS (SELECT {self.key} AS id, {self.pick} % {len(self.forms)} AS form, {marks} FROM {self.table}) SELECT * FROM ({' UNION ALL '.join(parts)}) v({columns})"
