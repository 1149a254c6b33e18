"""OCEL 1.0 and 2.0 JSON, flat and OCEL 2.0 XML, CSV and Parquet sources and sinks."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any, TextIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.runtime import delete_path, shared_dir, written
from braidlog.model import Log, from_tables
from braidlog.sources import sqlite
from braidlog.sources.sqlite import timestamps

#: Fixed schemas of the elements of the JSON dialects.
OCEL1_EVENT = "struct<`ocel:activity`:string,`ocel:timestamp`:string,`ocel:omap`:array<string>,`ocel:vmap`:map<string,string>>"
OCEL1_OBJECT = "struct<`ocel:type`:string,`ocel:ovmap`:map<string,string>>"
OCEL1_O2O = "struct<source:string,target:string,qualifier:string>"
_ATTR = "array<struct<name:string,value:string,time:string>>"
_REL = "array<struct<objectId:string,qualifier:string>>"
OCEL2_OBJECT = f"struct<id:string,type:string,attributes:{_ATTR},relationships:{_REL}>"
OCEL2_EVENT = f"struct<id:string,type:string,time:string,attributes:{_ATTR},relationships:{_REL}>"
#: Characters of a JSON file read at once, and elements in one batch.
CHUNK, BATCH = 1 << 20, 1000
#: Bytes of a JSON file that one task reads.
PART = 16 << 20
#: By byte: whether it is a quote (1), a bracket (2) or a comma (3), and what a bracket adds to the depth.
_KIND, _DEPTH = np.zeros(256, np.uint8), np.zeros(256, np.int64)
_KIND[34], _KIND[[91, 93, 123, 125]], _KIND[44] = 1, 2, 3
_DEPTH[[91, 123]], _DEPTH[[93, 125]] = 1, -1


def no_attributes() -> Column:
    return F.create_map().cast("map<string,string>")


def members(source: TextIO, chunk: int = CHUNK) -> Iterator[tuple[str, str | None, str]]:
    """``(section, key, JSON text)`` of all members of the arrays and objects in a JSON object, read piece by piece.

    Members of arrays have no key. No more than one member and one piece are held.
    """
    decode, text, at, done = json.JSONDecoder(strict=False).raw_decode, "", 0, False

    def more() -> None:
        nonlocal text, at, done
        piece = source.read(max(chunk, len(text) - at))
        text, at, done = text[at:] + piece, 0, not piece

    def peek() -> str:
        nonlocal at
        while True:
            while at < len(text):
                if not text[at].isspace():
                    return text[at]
                at += 1
            if done:
                raise ValueError("the JSON text ends early")
            more()

    def take(*marks: str) -> str:
        nonlocal at
        found = peek()
        if found not in marks:
            raise ValueError(f"{' or '.join(marks)} expected in JSON, not {found}")
        at += 1
        return found

    def value() -> tuple[Any, str]:
        nonlocal at
        peek()
        while True:
            try:
                found, end = decode(text, at)
                if end < len(text) or done:  # a number could go on
                    out = text[at:end]
                    at = end
                    return found, out
            except json.JSONDecodeError:
                if done:
                    raise
            more()

    def key() -> str:
        found, _ = value()
        take(":")
        return found

    take("{")
    if peek() == "}":
        return
    while True:
        section, kind = key(), peek()
        if kind in "[{":
            close = take(kind) and {"[": "]", "{": "}"}[kind]
            if peek() == close:
                take(close)
            else:
                while True:
                    name = key() if kind == "{" else None
                    yield section, name, value()[1]
                    if take(",", close) == close:
                        break
        else:
            value()
        if take(",", "}") == "}":
            return


def _opened(name: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), "/" + name[5:].lstrip("/")) if name.startswith("file:") else fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)


def _escaped(read: Callable[[int, int], bytes], at: int) -> bool:
    """Whether a run of backslashes that ends before ``at`` escapes what is there."""
    n = 0
    while at > n and read(at - n - 1, at - n) == b"\\":
        n += 1
    return n % 2 == 1


def _marks(data: bytes, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, brackets and commas of JSON text, whether each is outside strings, and what it adds to the depth.

    ``escaped`` and ``inside`` tell of the first byte: whether it is escaped and whether it is in a string.
    """
    bytes_ = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_KIND[bytes_])
    kind = _KIND[bytes_[at]]
    quotes = kind == 1
    for i in np.flatnonzero(quotes & (bytes_[at - 1] == 92) & (at > 0)).tolist():
        n = 1
        while n < at[i] and data[at[i] - n - 1] == 92:
            n += 1
        quotes[i] = (n - (escaped and n == at[i])) % 2 == 0
    if len(at) and at[0] == 0 and escaped:
        quotes[0] = False
    outside = ~quotes & (kind != 1) & ((np.cumsum(quotes) + inside) % 2 == 0)
    return at, outside, np.where(outside, _DEPTH[bytes_[at]], 0) + 100 * quotes


def _members(spark: SparkSession, path: str) -> DataFrame:
    """``(section, key, value)``: the members of JSON files' sections, each file read in parts of ``PART`` bytes by as many tasks.

    A first pass tells what each part adds to the depth, inside and outside strings, so each part
    knows where in the document it begins. A member belongs to the part in which the bracket or
    comma before it lies.
    """
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    parts = [(name, low, min(size, low + PART)) for name, size in sorted(files) for low in range(0, size, PART)]

    def each(work: Callable[[int, Callable[[int, int], bytes]], list], schema: str) -> DataFrame:
        kinds = {"int": pa.int32(), "string": pa.string()}
        fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    store, own = _opened(parts[i][0])
                    with store.open_input_file(own) as source:
                        rows = work(i, lambda low, high, source=source: source.read_at(high - low, low))
                        for k in range(0, len(rows), 10 * BATCH):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[k : k + 10 * BATCH], strict=True), fields, strict=True)], [n for n, _ in fields])

        return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(kernel, schema)

    def depths(i: int, read: Callable[[int, int], bytes]) -> list[tuple[int, int, int, int]]:
        _, low, high = parts[i]
        _, _, adds = _marks(data := read(low, high), escaped := _escaped(read, low), False)
        quotes = int((adds == 100).sum())
        _, _, other = _marks(data, escaped, True)
        return [(i, quotes % 2, int(adds.sum()) - 100 * quotes, int(other.sum()) - 100 * quotes)]

    begins: list[tuple[bool, int]] = []
    inside, depth = 0, 0
    for i, parity, outer, inner in sorted(map(tuple, each(depths, "part int, parity int, outer int, inner int").collect())):
        if not parts[i][1]:
            inside, depth = 0, 0
        begins.append((bool(inside), depth))
        inside, depth = inside ^ parity, depth + (inner if inside else outer)
        if (inside or depth) and (i + 1 == len(parts) or not parts[i + 1][1]):
            raise ValueError("the JSON text ends early")

    def section_before(read: Callable[[int, int], bytes], at: int) -> str:
        size = 1 << 12
        while True:
            text = read(max(0, at - size), at).rstrip()
            if text.endswith(b":"):
                text = text[:-1].rstrip()
                for k in range(len(text) - 2, -1, -1):
                    if text[k] == 34 and (len(text[:k]) - len(text[:k].rstrip(b"\\"))) % 2 == 0 and (k or size >= at):
                        return json.loads(text[k:], strict=False)
            if size >= at:
                raise ValueError("sections have names in JSON")
            size *= 16

    def found(i: int, read: Callable[[int, int], bytes]) -> list[tuple[int, str | None, str | None, str | None]]:
        name, low, high = parts[i]
        end = max(p[2] for p in parts if p[0] == name)
        more = 1 << 16
        while True:
            data = read(low, min(end, high + more))
            at, outside, adds = _marks(data, _escaped(read, low), begins[i][0])
            depth = begins[i][1] + np.cumsum(np.where(outside, adds, 0))
            edge = np.flatnonzero(outside & (((adds == 1) & (depth == 2)) | ((adds == 0) & (depth == 2) & (np.frombuffer(data, np.uint8)[at] == 44)) | ((adds == -1) & (depth == 1))))
            own = edge[at[edge] < high - low]
            if not len(own) or len(edge) > len(own) or low + len(data) >= end:
                break
            more *= 4
        out: list[tuple[int, str | None, str | None, str | None]] = []
        section = None
        for k, e in enumerate(edge[: len(own)].tolist()):
            if adds[e] == 1:
                section = section_before(read, low + int(at[e]))
                out.append((i, section, f"{at[e]:012}", None))
            if adds[e] < 0 or k + 1 >= len(edge):
                continue
            text = data[at[e] + 1 : at[edge[k + 1]]].decode().strip()
            if not text:
                continue
            key = None
            if text[0] == '"':
                string, stop = json.decoder.scanstring(text, 1, False)
                if (rest := text[stop:].lstrip()).startswith(":"):
                    key, text = string, rest[1:].lstrip()
            out.append((i, section, key, text))
        return out

    table = written(each(found, "part int, section string, key string, value string"), "json")
    last = {}
    for r in table.where("value is null").groupBy("part").agg(F.max_by("section", "key").alias("section")).collect():
        last[r.part] = r.section
    begun, before, now = F.lit(None).cast("string"), [], None
    for i in range(len(parts)):
        if now is not None and (not before or before[-1][1] != now):
            before.append((i, now))
        now = last.get(i, now)
    for i, name in before:
        begun = F.when(F.col("part") >= i, F.lit(name)).otherwise(begun)
    return table.where("value is not null").select(F.coalesce("section", begun).alias("section"), "key", "value")


def read_ocel1_json(spark: SparkSession, path: str) -> Log:
    """Events, objects and object relations of an OCEL 1.0 JSON file; value maps become attributes."""
    return _ocel1(spark, _members(spark, path))


def _ocel1(spark: SparkSession, found: DataFrame) -> Log:
    part = lambda name, kind: found.where(F.col("section") == name).select("key", F.from_json("value", kind).alias("e"))
    ev = part("ocel:events", OCEL1_EVENT).withColumnRenamed("key", "event_id")
    ob = part("ocel:objects", OCEL1_OBJECT).select(F.col("key").alias("object_id"), F.col("e").alias("o"))
    events = ev.select("event_id", F.col("e.`ocel:activity`").alias("activity"), timestamps(F.col("e.`ocel:timestamp`")).alias("ts"), F.coalesce("e.`ocel:vmap`", no_attributes()).alias("attrs"))
    objects = ob.select("object_id", F.col("o.`ocel:type`").alias("object_type"), F.coalesce("o.`ocel:ovmap`", no_attributes()).alias("attrs"))
    rel = ev.select("event_id", F.explode("e.`ocel:omap`").alias("object_id")).join(objects.select("object_id", "object_type"), "object_id")
    o2o = part("ocel:o2o", OCEL1_O2O).select(F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"), F.coalesce("e.qualifier", F.lit("")).alias("qualifier"))
    return from_tables(spark, events, objects, rel.select("event_id", "object_id", "object_type", F.lit("").alias("qualifier")), o2o)


def _last(attributes: Column) -> Column:
    """Attribute map of ``{name, value, time}`` entries; the latest value of a name wins."""
    entries = F.sort_array(F.transform(attributes, lambda a: F.struct(a["time"].alias("time"), a["name"].alias("name"), a["value"].alias("value"))))
    names = F.array_distinct(F.transform(entries, lambda a: a["name"]))
    pick = lambda n: F.element_at(F.filter(entries, lambda a: a["name"] == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, pick)), no_attributes())


def _ocel2(spark: SparkSession, ob: DataFrame, ev: DataFrame) -> Log:
    """A log from ``id, type, attributes, relationships`` objects and the same with ``time`` as events."""
    objects = ob.select(F.col("id").alias("object_id"), F.col("type").alias("object_type"), _last(F.col("attributes")).alias("attrs"))
    events = ev.select(F.col("id").alias("event_id"), F.col("type").alias("activity"), timestamps(F.col("time")).alias("ts"), _last(F.col("attributes")).alias("attrs"))
    rel = ev.select(F.col("id").alias("event_id"), F.explode("relationships").alias("r")).select("event_id", F.col("r.objectId").alias("object_id"), F.coalesce("r.qualifier", F.lit("")).alias("qualifier"))
    rel = rel.join(objects.select("object_id", "object_type"), "object_id").select("event_id", "object_id", "object_type", "qualifier")
    o2o = ob.select(F.col("id").alias("source_id"), F.explode("relationships").alias("r")).select("source_id", F.col("r.objectId").alias("target_id"), F.coalesce("r.qualifier", F.lit("")).alias("qualifier"))
    changes = ob.select(F.col("id").alias("object_id"), F.col("type").alias("object_type"), F.explode("attributes").alias("a")).select("object_id", "object_type", timestamps(F.col("a.time")).alias("ts"), F.col("a.name").alias("field"), F.col("a.value").alias("value"))
    return from_tables(spark, events, objects, rel, o2o, changes)


def read_ocel2_json(spark: SparkSession, path: str) -> Log:
    return _ocel2_json(spark, _members(spark, path))


def _ocel2_json(spark: SparkSession, found: DataFrame) -> Log:
    part = lambda name, kind: found.where(F.col("section") == name).select(F.from_json("value", kind).alias("e")).select("e.*")
    return _ocel2(spark, part("objects", OCEL2_OBJECT), part("events", OCEL2_EVENT))


def read_json(spark: SparkSession, path: str) -> Log:
    """Either JSON dialect, told apart by its keys."""
    found = _members(spark, path)
    return _ocel2_json(spark, found) if found.where(F.col("section").startswith("ocel:")).isEmpty() else _ocel1(spark, found)


_XML_ATTR = "attributes struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>"
_XML_REL = "objects struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>, relationship array<struct<`_object-id`:string,_qualifier:string>>"
_FLAT_ATTR = "attribute array<struct<_name:string,_value:string,_time:string,_VALUE:string>>"


def read_xml(spark: SparkSession, path: str) -> Log:
    """OCEL 2.0 XML, or its flat dialect with attributes and relationships directly in objects and events."""

    def rows(tag: str) -> DataFrame:
        schema = f"_id string, _type string, _time string, {_XML_ATTR}, {_XML_REL}, {_FLAT_ATTR}"
        raw = spark.read.format("xml").option("rowTag", tag).option("valueTag", "_text").schema(schema.replace("_VALUE", "_text")).load(path).where("_id is not null and _type is not null")
        none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
        nested = F.transform("attributes.attribute", lambda a: F.struct(a["_name"].alias("name"), F.trim(a["_text"]).alias("value"), a["_time"].alias("time")))
        flat = F.transform("attribute", lambda a: F.struct(a["_name"].alias("name"), F.trim(F.coalesce(a["_value"], a["_text"])).alias("value"), a["_time"].alias("time")))
        link = lambda c: F.transform(c, lambda r: F.struct(r["_object-id"].alias("objectId"), r["_qualifier"].alias("qualifier")))
        return raw.select(
            F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_time").alias("time"),
            F.coalesce(nested, flat, none("name:string,value:string,time:string")).alias("attributes"),
            F.coalesce(link("objects.relationship"), link("relationship"), none("objectId:string,qualifier:string")).alias("relationships"),
        )

    return _ocel2(spark, written(rows("object"), "xml"), written(rows("event"), "xml"))  # each is read several times


def read_csv(spark: SparkSession, path: str, object_types: list[str], activity: str = "event_activity", timestamp: str = "event_timestamp") -> Log:
    """A wide CSV: a row for each event, object columns as Python list literals (``set()`` and blanks are empty).

    Event ids are the row's id column if there is one, else a hash of the row and its place.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    key = F.col("event_id") if "event_id" in raw.columns else F.concat(F.lit("e"), F.monotonically_increasing_id().cast("string"))
    raw = raw.withColumn("event_id", key.cast("string"))
    others = [c for c in raw.columns if c not in (*object_types, activity, timestamp, "event_id")]
    attrs = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if others else no_attributes()
    events = raw.select("event_id", F.col(activity).alias("activity"), timestamps(F.col(timestamp)).alias("ts"), attrs.alias("attrs"))
    e2o = None
    for t in object_types:
        found = F.regexp_extract_all(F.coalesce(F.col(f"`{t}`"), F.lit("")), F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
        part = raw.select("event_id", F.explode(found).alias("o")).select("event_id", F.substring("o", F.lit(2), F.length("o") - 2).alias("object_id"), F.lit(t).alias("object_type"), F.lit("").alias("qualifier"))
        e2o = part if e2o is None else e2o.unionByName(part)
    objects = e2o.select("object_id", "object_type").distinct().withColumn("attrs", no_attributes())
    return from_tables(spark, events.join(e2o.select("event_id").distinct(), "event_id", "left_semi"), objects, e2o)


def write_csv(log: Log, path: str, object_types: list[str]) -> None:
    """The wide table as a folder of CSV files that ``read_csv`` reads: attributes become columns, object ids list literals.

    Attribute names are collected: there is one column for each. Ids must not hold quotes.
    """
    names = [r[0] for r in log.events.select(F.explode(F.map_keys("attrs"))).distinct().orderBy("col").collect()]
    literal = lambda t: F.concat(F.lit("["), F.array_join(F.transform(F.col(f"`{t}`"), lambda o: F.concat(F.lit("'"), o, F.lit("'"))), ", "), F.lit("]")).alias(t)
    wide = log.wide(object_types).join(log.events.select("event_id", "attrs"), "event_id")
    wide.select(
        "event_id", F.col("activity").alias("event_activity"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_timestamp"),
        *[literal(t) for t in object_types], *[F.col("attrs")[n].alias(n) for n in names],
    ).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_parquet(spark: SparkSession, path: str) -> Log:
    """The five tables of the model: the format for large logs."""
    return Log(*[spark.read.parquet(f"{path}/{t}") for t in ("events", "objects", "e2o", "o2o", "object_changes")])


def write_parquet(log: Log, path: str) -> None:
    for t in ("events", "objects", "e2o", "o2o", "object_changes"):
        getattr(log, t).write.mode("overwrite").parquet(f"{path}/{t}")


def read_ocel(spark: SparkSession, path: str) -> Log:
    """Choose the reader by the file's ending."""
    if path.endswith((".sqlite", ".db")):
        return sqlite.read(spark, path)
    if path.endswith((".xml", ".xmlocel")):
        return read_xml(spark, path)
    if path.endswith((".json", ".jsonocel")):
        return read_json(spark, path)
    return read_parquet(spark, path)


def _stamp() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _ocel2_rows(log: Log) -> tuple[DataFrame, DataFrame]:
    """Events and objects with nested attributes and relationships."""
    pairs = lambda when: F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), when.alias("time")))
    e_rel = log.e2o.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(F.col("object_id").alias("objectId"), "qualifier"))).alias("relationships"))
    o_rel = log.o2o.groupBy(F.col("source_id").alias("object_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("target_id").alias("objectId"), "qualifier"))).alias("relationships"))
    none = F.array().cast("array<struct<objectId:string,qualifier:string>>")
    events = log.events.join(e_rel, "event_id", "left").select(F.col("event_id").alias("id"), F.col("activity").alias("type"), _stamp().alias("time"), pairs(F.lit(None).cast("string")).alias("attributes"), F.coalesce("relationships", none).alias("relationships"))
    objects = log.objects.join(o_rel, "object_id", "left").select(F.col("object_id").alias("id"), F.col("object_type").alias("type"), pairs(F.lit("1970-01-01T00:00:00Z")).alias("attributes"), F.coalesce("relationships", none).alias("relationships"))
    return events, objects


def _one_file(rows: list[tuple[str, DataFrame, str, str]], path: str) -> None:
    """Write rows into one text file: parts of ``(opening, one-column frame, separator, closing)``.

    Tasks write the rows as pieces into the shared folder, which are joined as they are.
    ``path`` may name any file system that pyarrow knows by its scheme.
    """
    store, name = _opened(path)
    with store.open_output_stream(name, compression=None) as out:
        for opening, df, separator, closing in rows:
            out.write(opening.encode())
            pieces = f"{shared_dir(df.sparkSession)}/braidlog-pieces-{uuid.uuid4().hex}"
            whole = F.coalesce("value", F.raise_error(F.lit("a row without an id cannot be written")))
            df.toDF("value").select(whole.alias("value")).write.option("lineSep", separator).option("compression", "none").text(pieces)
            held, folder = _opened(pieces)
            found = [f for f in held.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-") and f.size]
            for i, piece in enumerate(sorted(found, key=lambda f: f.base_name)):
                left = piece.size - (len(separator) if i + 1 == len(found) else 0)
                with held.open_input_stream(piece.path, compression=None) as source:
                    while left:
                        out.write(data := source.read(min(left, 8 << 20)))
                        left -= len(data)
            delete_path(df.sparkSession, pieces)
            out.write(closing.encode())


def write_ocel2_json(log: Log, path: str) -> None:
    """One JSON document, whose rows tasks write."""
    events, objects = _ocel2_rows(log)
    as_json = lambda df: df.select(F.to_json(F.struct("*")))
    kinds = json.dumps([{"name": r[0]} for r in log.objects.select("object_type").distinct().orderBy("object_type").collect()])
    acts = json.dumps([{"name": r[0]} for r in log.events.select("activity").distinct().orderBy("activity").collect()])
    _one_file([('{"objectTypes":' + kinds + ',"eventTypes":' + acts + ',"objects":[', as_json(objects), ",", '],"events":['), ("", as_json(events), ",", "]}")], path)


def write_ocel1_json(log: Log, path: str) -> None:
    omap = log.e2o.groupBy("event_id").agg(F.sort_array(F.collect_set("object_id")).alias("omap"))
    entry = lambda key, body: F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), F.to_json(body))
    body = F.struct(F.col("activity").alias("ocel:activity"), _stamp().alias("ocel:timestamp"), F.coalesce("omap", F.array().cast("array<string>")).alias("ocel:omap"), F.col("attrs").alias("ocel:vmap"))
    events = log.events.join(omap, "event_id", "left").select(entry(F.col("event_id"), body))
    objects = log.objects.select(entry(F.col("object_id"), F.struct(F.col("object_type").alias("ocel:type"), F.col("attrs").alias("ocel:ovmap"))))
    o2o = log.o2o.select(F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "qualifier")))
    _one_file([('{"ocel:events":{', events, ",", '},"ocel:objects":{'), ("", objects, ",", '},"ocel:o2o":['), ("", o2o, ",", "]}")], path)


def write_xml(log: Log, path: str) -> None:
    """OCEL 2.0 XML."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda a: F.concat(F.lit('<attribute name="'), safe(a["name"]), F.lit('"'), F.when(a["time"].isNotNull(), F.concat(F.lit(' time="'), a["time"], F.lit('"'))).otherwise(""), F.lit(">"), safe(a["value"]), F.lit("</attribute>"))
    relation = lambda r: F.concat(F.lit('<relationship object-id="'), safe(r["objectId"]), F.lit('" qualifier="'), safe(r["qualifier"]), F.lit('"/>'))
    inner = F.concat(F.lit("<attributes>"), F.array_join(F.transform("attributes", attribute), ""), F.lit("</attributes><objects>"), F.array_join(F.transform("relationships", relation), ""), F.lit("</objects>"))
    head = lambda tag, more: F.concat(F.lit(f'<{tag} id="'), safe(F.col("id")), F.lit('" type="'), safe(F.col("type")), F.lit('"'), more, F.lit(">"), inner, F.lit(f"</{tag}>"))
    events, objects = _ocel2_rows(log)
    o = objects.select(head("object", F.lit("")))
    e = events.select(head("event", F.concat(F.lit(' time="'), F.col("time"), F.lit('"'))))
    _one_file([("<log><objects>\n", o, "\n", "\n</objects><events>\n"), ("", e, "\n", "\n</events></log>")], path)


def write_ocel(log: Log, path: str, dialect: str | None = None) -> None:
    """Write by the ending or a named dialect (``ocel1``)."""
    if path.endswith((".sqlite", ".db")):
        sqlite.write(log, path)
    elif path.endswith((".xml", ".xmlocel")):
        write_xml(log, path)
    elif path.endswith((".json", ".jsonocel")):
        (write_ocel1_json if dialect == "ocel1" else write_ocel2_json)(log, path)
    else:
        write_parquet(log, path)


def merge(a: Log, b: Log) -> Log:
    """Union of two logs; an event or object in both takes the second's row."""
    events = b.events.unionByName(a.events.join(b.events.select("event_id"), "event_id", "left_anti"))
    objects = b.objects.unionByName(a.objects.join(b.objects.select("object_id"), "object_id", "left_anti"))
    gone = a.e2o.join(b.events.select("event_id"), "event_id", "left_anti")
    return Log(events, objects, b.e2o.unionByName(gone).distinct(), a.o2o.unionByName(b.o2o).distinct(), a.object_changes.unionByName(b.object_changes).distinct())


def constraint_instances(spark: SparkSession, path: str) -> DataFrame:
    """``(name, start, end)`` rows of a CSV file."""
    return spark.read.schema("name string, start long, end long").option("header", True).csv(path)


def as_json_lines(df: DataFrame, path: str) -> None:
    """Hierarchies, lattices and other small reports as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
