"""Tables of an SQLite file as a source: ranges of rowids are partitions, filters of Spark go into the file's own WHERE, and only asked columns are read.

The file must be where the driver and all executors see it under one path (option `path`); `table` names the table, `partitions` the number of tasks (8), `columns` the columns (all).
Types follow the declared affinity: INTEGER is long, REAL double, BLOB binary, all else string; a value that does not fit its column's type reads as null.

Defined results: an empty table gives an empty result; tables without rowids are one partition; null names and extra columns are kept as they are."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_PYTHON = {LongType: int, DoubleType: float, BinaryType: bytes, StringType: str}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def _kind(declared: str):
    declared = declared.upper()
    return LongType() if "INT" in declared else DoubleType() if re.search("REAL|FLOA|DOUB", declared) else BinaryType() if "BLOB" in declared else StringType()


class Rowids(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what the file can compare as Spark does; gives the rest back. Text is left to Spark where the file's own collation might differ."""
        kinds = {f.name: type(f.dataType) for f in self.schema.fields}
        for f in filters:
            path = getattr(f, "attribute", ())  # a negation has none
            name = path[0] if len(path) == 1 else None
            number = kinds.get(name) in (LongType, DoubleType)
            column = quoted(name or "")
            if name in kinds and isinstance(f, (IsNull, IsNotNull)) and kinds[name] is StringType:
                self.where.append((f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
            elif number and type(f) in _COMPARED and isinstance(f.value, (int, float)):
                self.where.append((f"typeof({column}) IN ('integer', 'real') AND {column} {_COMPARED[type(f)]} ?", [f.value]))
            elif number and isinstance(f, In) and all(isinstance(v, (int, float)) for v in f.value):
                self.where.append((f"typeof({column}) IN ('integer', 'real') AND {column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with _connected(self.options["path"]) as db:
            try:
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # no rowids
                return [Rowids(None, None)]
        if first is None:
            return [Rowids(0, -1)]  # no rows
        n = min(int(self.options.get("partitions", 8)), last - first + 1)
        cuts = [first + (last - first + 1) * i // n for i in range(n + 1)]
        return [Rowids(a, b - 1) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Rowids) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        where, values = [w for w, _ in self.where], [v for _, vs in self.where for v in vs]
        if partition.first is not None:
            where, values = ["rowid BETWEEN ? AND ?", *where], [partition.first, partition.last, *values]
        sql = f"SELECT {', '.join(map(quoted, names)) or '1'} FROM {quoted(self.options['table'])}" + (" WHERE " + " AND ".join(where) if where else "")
        made = [_PYTHON[type(f.dataType)] for f in self.schema.fields]

        def fit(value, kind):
            if value is None or isinstance(value, kind):
                return value
            if kind is float and isinstance(value, int):
                return float(value)
            if kind is str and not isinstance(value, bytes):
                return str(value)
            return None

        with _connected(self.options["path"]) as db:
            for row in db.execute(sql, values):
                yield tuple(fit(v, k) for v, k in zip(row, made, strict=True)) if names else ()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _connected(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        asked = self.options.get("columns")
        fields = {name: StructField(name, _kind(kind or "")) for _, name, kind, *_ in found}
        return StructType([fields[c.strip()] for c in asked.split(",")] if asked else list(fields.values()))

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, *, columns: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """A table of the file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "table": table, "partitions": str(partitions)} | ({"columns": ",".join(columns)} if columns else {})
    return spark.read.format("sqlite").options(**options).load()


#: What columns of the training table are called afterwards. Fixed names.
TRAINING = {"strategy_name": "strategy", "risk_reward_actual": "r_multiple", "mfe_r_multiple": "mfe_r", "mae_r_multiple": "mae_r", "atr_value": "atr_at_entry"}


def read_training(spark: SparkSession, path: str, *, table: str = "ml_training_data", partitions: int = 8) -> DataFrame:
    """Trades with a known outcome, under the names of the trade tables."""
    df = read_table(spark, path, table, partitions=partitions).where("outcome IS NOT NULL")
    return df.select([F.col(c).alias(TRAINING.get(c, c)) for c in df.columns])
