"""OCEL 2.0 SQLite files as a Spark data source and sink.

The source reads one table of a file; each table is split by row id into as many reading
tasks as asked, so a large file is not read by one task. Files must be on a path all
executors see.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from braidlog.model import CHANGES, EVENTS, O2O, Log, empty, from_tables

STANDARD = ("ocel_id", "ocel_type", "ocel_time", "ocel_changed_field")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _columns(path: str, table: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [row[1] for row in db.execute(f"PRAGMA table_info({quoted(table)})")]


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int) -> None:
        self.path, self.table, self.parts = path, table, parts

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(i, min(high, i + step - 1)) for i in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT * FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(None if v is None else str(v) for v in row)


class SqliteTable(DataSource):
    """``spark.read.format("ocel_sqlite").option("table", ...).load(path)``: all columns as strings."""

    @classmethod
    def name(cls) -> str:
        return "ocel_sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in _columns(self.options["path"], self.options["table"]))

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("parts", 8)))


def timestamps(text: Column) -> Column:
    """Timestamps in any of the usual formats; what does not parse is null."""
    formats = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def read(spark: SparkSession, path: str, parts: int = 8) -> Log:
    """Load an OCEL 2.0 SQLite file.

    Rows of an object table with ``ocel_changed_field`` change that field only; the object's
    attributes are the latest real values, and all values with their times are the changes.
    """
    spark.dataSource.register(SqliteTable)
    load = lambda table: spark.read.format("ocel_sqlite").option("table", table).option("parts", parts).load(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        event_maps = db.execute("SELECT ocel_type, ocel_type_map FROM event_map_type").fetchall()
        object_maps = db.execute("SELECT ocel_type, ocel_type_map FROM object_map_type").fetchall()
    events, changes = empty(spark, EVENTS), empty(spark, CHANGES)

    def attributes(df: DataFrame) -> Column:
        names = [c for c in df.columns if c not in STANDARD]
        if not names:
            return F.create_map().cast("map<string,string>")
        return F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull())

    for kind, suffix in event_maps:
        if (table := f"event_{suffix}") in tables:
            own = load(table)
            events = events.unionByName(own.select(F.col("ocel_id").alias("event_id"), F.lit(kind).alias("activity"), timestamps(F.col("ocel_time")).alias("ts"), attributes(own).alias("attrs")))
    for kind, suffix in object_maps:
        if (table := f"object_{suffix}") in tables:
            own = load(table)
            when = timestamps(F.col("ocel_time")) if "ocel_time" in own.columns else F.lit(None).cast("timestamp")
            changed = F.col("ocel_changed_field") if "ocel_changed_field" in own.columns else F.lit(None).cast("string")
            long = own.select(F.col("ocel_id").alias("object_id"), F.lit(kind).alias("object_type"), when.alias("ts"), changed.alias("only"), F.explode(attributes(own)).alias("field", "value"))
            changes = changes.unionByName(long.where("only is null or only = field").select("object_id", "object_type", "ts", "field", "value"))
    real = changes.where(F.col("value") != F.concat(F.lit("no_"), F.col("field")))
    latest = real.groupBy("object_id", "field").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    details = latest.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("attrs"))
    objects = load("object").select(F.col("ocel_id").alias("object_id"), F.col("ocel_type").alias("object_type")).join(details, "object_id", "left")
    objects = objects.withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    e2o = load("event_object").select(F.col("ocel_event_id").alias("event_id"), F.col("ocel_object_id").alias("object_id"), F.coalesce(F.col("ocel_qualifier"), F.lit("")).alias("qualifier"))
    e2o = e2o.join(objects.select("object_id", "object_type"), "object_id").select("event_id", "object_id", "object_type", "qualifier")
    o2o = empty(spark, O2O)
    if "object_object" in tables:
        o2o = load("object_object").select(F.col("ocel_source_id").alias("source_id"), F.col("ocel_target_id").alias("target_id"), F.coalesce(F.col("ocel_qualifier"), F.lit("")).alias("qualifier"))
    return from_tables(spark, events, objects, e2o, o2o, changes)


def suffixes(kinds: list[str]) -> dict[str, str]:
    """Table suffix of every type; two types with the same one raise."""
    out = {k: re.sub(r"[^0-9A-Za-z]+", "", k.title()) or "Type" for k in kinds}
    if len(set(out.values())) < len(out):
        raise ValueError(f"types share a table name: {out}")
    return out


def write(log: Log, path: str) -> None:
    """Write an OCEL 2.0 SQLite file with keys; relations of unknown ends are left out.

    One SQLite file has one writer: rows stream through the driver in batches and are never
    held as a whole. For large logs use the Parquet sink.
    """
    kinds = sorted(r.object_type for r in log.objects.select("object_type").distinct().collect())
    acts = sorted(r.activity for r in log.events.select("activity").distinct().collect())
    object_suffix, event_suffix = suffixes(kinds), suffixes(acts)

    def names(df: DataFrame, kind: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in df.select(F.col(kind).alias("t"), F.explode(F.map_keys("attrs")).alias("k")).distinct().orderBy("t", "k").collect():
            out.setdefault(r.t, []).append(r.k)
        return out

    object_names, event_names = names(log.objects, "object_type"), names(log.events, "activity")
    with sqlite3.connect(path) as db:
        db.executescript(
            """CREATE TABLE event_map_type (ocel_type TEXT PRIMARY KEY, ocel_type_map TEXT);
            CREATE TABLE object_map_type (ocel_type TEXT PRIMARY KEY, ocel_type_map TEXT);
            CREATE TABLE event (ocel_id TEXT PRIMARY KEY, ocel_type TEXT REFERENCES event_map_type(ocel_type));
            CREATE TABLE object (ocel_id TEXT PRIMARY KEY, ocel_type TEXT REFERENCES object_map_type(ocel_type));
            CREATE TABLE event_object (ocel_event_id TEXT REFERENCES event(ocel_id), ocel_object_id TEXT REFERENCES object(ocel_id), ocel_qualifier TEXT, PRIMARY KEY (ocel_event_id, ocel_object_id, ocel_qualifier));
            CREATE TABLE object_object (ocel_source_id TEXT REFERENCES object(ocel_id), ocel_target_id TEXT REFERENCES object(ocel_id), ocel_qualifier TEXT, PRIMARY KEY (ocel_source_id, ocel_target_id, ocel_qualifier));"""
        )
        db.executemany("INSERT INTO event_map_type VALUES (?, ?)", event_suffix.items())
        db.executemany("INSERT INTO object_map_type VALUES (?, ?)", object_suffix.items())
        for prefix, suffix, columns in (("event", event_suffix, event_names), ("object", object_suffix, object_names)):
            for kind, name in suffix.items():
                extra = "".join(f", {quoted(c)} TEXT" for c in columns.get(kind, []))
                changed = ", ocel_changed_field TEXT" if prefix == "object" else ""
                db.execute(f"CREATE TABLE {quoted(f'{prefix}_{name}')} (ocel_id TEXT REFERENCES {prefix}(ocel_id), ocel_time TEXT{changed}{extra})")

        def fill(sql: str, rows: Iterator[tuple]) -> None:
            db.executemany(sql, rows)

        for r in log.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).toLocalIterator():
            own = event_names.get(r.activity, [])
            db.execute("INSERT INTO event VALUES (?, ?)", (r.event_id, r.activity))
            db.execute(f"INSERT INTO {quoted('event_' + event_suffix[r.activity])} VALUES ({', '.join('?' * (2 + len(own)))})", (r.event_id, r.ts, *[r.attrs.get(k) for k in own]))
        for r in log.objects.toLocalIterator():
            own = object_names.get(r.object_type, [])
            db.execute("INSERT INTO object VALUES (?, ?)", (r.object_id, r.object_type))
            db.execute(f"INSERT INTO {quoted('object_' + object_suffix[r.object_type])} VALUES ({', '.join('?' * (3 + len(own)))})", (r.object_id, "1970-01-01 00:00:00", None, *[r.attrs.get(k) for k in own]))
        ids = log.objects.select("object_id")
        e2o = log.e2o.join(log.events.select("event_id"), "event_id", "left_semi").join(ids, "object_id", "left_semi")
        fill("INSERT INTO event_object VALUES (?, ?, ?)", ((r.event_id, r.object_id, r.qualifier) for r in e2o.toLocalIterator()))
        o2o = log.o2o.join(ids, log.o2o["source_id"] == ids["object_id"], "left_semi")
        o2o = o2o.join(ids, o2o["target_id"] == ids["object_id"], "left_semi").distinct()
        fill("INSERT INTO object_object VALUES (?, ?, ?)", ((r.source_id, r.target_id, r.qualifier) for r in o2o.toLocalIterator()))
