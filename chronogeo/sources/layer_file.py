"""Layers of GeoPackage files (SQLite) as a partitioned data source.

    spark.dataSource.register(LayerFile)
    spark.read.format("layer_file").option("path", file).option("layer", name).load()

A layer is read in ranges of its row ids, one partition each: nothing of it
passes through the driver but its columns' names and its least and greatest
row id. The file must lie where executors can open it. Comparisons of columns
with values, and tests for null, go into each range's own SQL where Spark
pushes filters to Python sources (spark.sql.python.filterPushdown.enabled);
option columns (comma-separated) prunes the scan.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

PARTITIONS = 8
BATCH = 10_000
#: Declared types, by how they begin; all others, geometries among them, are binary.
TYPES = {"BOOL": "boolean", "TINYINT": "bigint", "SMALLINT": "bigint", "MEDIUMINT": "bigint", "INT": "bigint", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "TEXT": "string", "DATE": "string", "VARCHAR": "string"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class LayerFile(DataSource):
    """Options: path, layer, columns (all but the row id's, if not given), partitions, pushdown (true only where Spark pushes filters)."""

    @classmethod
    def name(cls) -> str:
        return "layer_file"

    def columns(self) -> list[tuple[str, str]]:
        with opened(self.options["path"]) as con:
            found = con.execute(f"SELECT name, type, pk FROM pragma_table_info({quoted(self.options['layer'])})").fetchall()
        if not found:
            raise ValueError(f"no layer {self.options['layer']!r} in {self.options['path']}")
        wanted = self.options.get("columns")
        kind = lambda t: next((v for k, v in TYPES.items() if t.upper().startswith(k)), "binary")
        every = {n: kind(t) for n, t, pk in found if not pk}
        return [(n.strip(), every[n.strip()]) for n in wanted.split(",")] if wanted else list(every.items())

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self.columns())

    def reader(self, schema) -> DataSourceReader:
        kind = FilteredLayerReader if self.options.get("pushdown", "false").lower() == "true" else LayerReader
        return kind(self.options["path"], self.options["layer"], [(f.name, f.dataType.simpleString()) for f in schema.fields], int(self.options.get("partitions", PARTITIONS)))


class LayerReader(DataSourceReader):
    def __init__(self, path: str, layer: str, columns: list[tuple[str, str]], partitions: int):
        self.path, self.layer, self.columns, self.n = path, layer, columns, max(1, partitions)
        self.where: list[tuple[str, tuple]] = []

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.layer)}").fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = -(-(high - low + 1) // self.n)
        return [InputPartition((at, min(at + step - 1, high))) for at in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tests = ["rowid BETWEEN ? AND ?", *[sql for sql, _ in self.where]]
        values = [*partition.value, *[v for _, more in self.where for v in more]]
        names = ", ".join(quoted(n) for n, _ in self.columns) or "NULL"
        flags = [i for i, (_, t) in enumerate(self.columns) if t == "boolean"]
        with opened(self.path) as con:
            cursor = con.execute(f"SELECT {names} FROM {quoted(self.layer)} WHERE {' AND '.join(tests)}", values)
            while rows := cursor.fetchmany(BATCH):
                for row in rows:
                    yield tuple(None if v is None else bool(v) if i in flags else v for i, v in enumerate(row)) if flags else row


class FilteredLayerReader(LayerReader):
    """A reader that filters where it reads."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what SQL tells as Spark does: comparisons of plain columns; hands back all else."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if column is None or dict(self.columns).get(column) not in ("bigint", "double", "string") or isinstance(value, (bytes, bool)):
                yield f
            elif type(f) in COMPARED and not isinstance(f, EqualNullSafe):
                self.where.append((f"{quoted(column)} {COMPARED[type(f)]} ?", (value,)))
            elif isinstance(f, In) and value:
                self.where.append((f"{quoted(column)} IN ({', '.join('?' * len(value))})", tuple(value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append((f"{quoted(column)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", ()))
            else:
                yield f
