"""A table dealt by a hash of its key, so that deletes, updates and replacements rewrite only the parts that they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import fresh
from ..shared import written

#: Parts of a table; also how many numbers a rewrite gathers at most.
PARTS = 64
PART, LIVE = "part_of_key", "row_is_live"


class KeyedTable:
    """Parquet below path in parts by the hash of key; a null key is a key.

    A rewrite is made in the shared folder first and then takes the place of the touched parts in one dynamic overwrite.
    If it fails before that, the table is as it was; if it fails within, running it again gives the same table, since each
    of the changes gives the same when it is made twice. Every part that is written holds a row that isn't live, so that an
    emptied part is overwritten too.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = PARTS):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts

    def _part(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, touched: list[int], mode: str | None) -> None:
        live = rows.withColumn(LIVE, F.lit(True)).withColumn(PART, self._part(self.key))
        marks = self.spark.createDataFrame([(p, False) for p in touched], f"{PART} int, {LIVE} boolean")
        out = live.unionByName(marks, allowMissingColumns=True)
        writer = out.write.partitionBy(PART).mode("overwrite")
        (writer.option("partitionOverwriteMode", mode) if mode else writer).parquet(self.path)

    def create(self, rows: DataFrame) -> "KeyedTable":
        """The table of these rows, in place of any there was; also how it is emptied (rows.limit(0))."""
        if {PART, LIVE} & {c.lower() for c in rows.columns}:
            raise ValueError(f"{PART} and {LIVE} are the table's own columns")
        self._write(rows, list(range(self.parts)), "static")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where(LIVE).drop(LIVE, PART)

    def _rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        touched = sorted(r[0] for r in keys.select(self._part(self.key)).distinct().collect())  # PARTS numbers at most
        if touched:
            own = self.spark.read.parquet(self.path).where(F.col(PART).isin(touched)).where(LIVE).drop(LIVE, PART)
            self._write(written(change(own), "rewritten"), touched, "dynamic")

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        other = fresh(rows, "key_of_change")
        gone = keys.select(F.col(self.key).alias(other)).distinct()
        return rows.join(gone, F.col(self.key).eqNullSafe(F.col(other)), "left_anti")

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of keys (a table with the key's column)."""
        self._rewrite(keys, lambda rows: self._without(rows, keys))

    def update(self, changes: DataFrame) -> None:
        """Give rows of a key the values that changes has for it (one row a key; nulls leave what is there)."""
        cells = [c for c in changes.columns if c != self.key]

        def change(rows: DataFrame) -> DataFrame:
            names = {c: fresh(rows, f"new_{i}") for i, c in enumerate([self.key, *cells])}
            new = changes.withColumnsRenamed(names)
            joined = rows.join(new, F.col(self.key).eqNullSafe(F.col(names[self.key])), "left")
            return joined.select(*[F.coalesce(names[c], F.col(c)).alias(c) if c in cells else F.col(c) for c in rows.columns])

        self._rewrite(changes, change)

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """All rows of keys go, and rows (of these keys only) take their place."""
        kept = rows.join(keys.select(self.key).distinct(), self.key, "left_semi").select(*rows.columns)
        self._rewrite(keys, lambda old: self._without(old, keys).unionByName(kept.select(*old.columns)))
