"""The log model: five DataFrames that every operator reads.

``events(event_id, activity, ts, attrs)``, ``objects(object_id, object_type, attrs)``,
``e2o(event_id, object_id, object_type, qualifier)``, ``o2o(source_id, target_id, qualifier)``
and ``object_changes(object_id, object_type, ts, field, value)``. Ids are strings, attributes
are string maps. All are lazy; nothing here triggers a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id string, activity string, ts timestamp, attrs map<string,string>"
OBJECTS = "object_id string, object_type string, attrs map<string,string>"
E2O = "event_id string, object_id string, object_type string, qualifier string"
O2O = "source_id string, target_id string, qualifier string"
CHANGES = "object_id string, object_type string, ts timestamp, field string, value string"


@dataclass(frozen=True)
class Numbered:
    """A log's events with its objects as numbers.

    ``rows(pe, inner, ts, <each shared type>)`` are the events' ids of shared objects, microseconds and the object of the
    leading type, all null where there is none. A row with ``inner`` is an event with an object of the inner type that
    no other event has; it lists that object. The others with one ``pe`` are one event with all their objects, which may be
    several of the types in the first stage; each lists the leading object once, and without ``pe`` they are no event.
    An event has objects of at most one type of a stage. ``listed`` has the ``key`` of every other object of the log. Object
    relations join a leading object with an inner one of its own.
    """

    rows: DataFrame
    leading: str
    inner: str
    stages: tuple[tuple[str, ...], ...]
    listed: dict[str, DataFrame]
    #: ``(object_type, activity)``: what the events' relations name.
    activities: DataFrame

    def types(self) -> list[str]:
        return [self.leading, self.inner, *[t for stage in self.stages for t in stage]]


@dataclass(frozen=True)
class Log:
    """An object-centric event log."""

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    object_changes: DataFrame
    #: The events and relations for which a source knows each event with its objects, and that table.
    known: tuple[DataFrame, DataFrame, DataFrame] | None = None
    #: The same for types of whose objects a source knows all events: ``(pe_id, events)`` with event structs as in ``packed``.
    #: Every event with an id has an object of the type (maybe without an id) and is in the case of each, once.
    cases: tuple[DataFrame, DataFrame, dict[str, DataFrame]] | None = None
    #: The parts of the log for which a source numbers the objects, and how.
    numbers: tuple[DataFrame, DataFrame, DataFrame, DataFrame, Numbered] | None = None
    #: The events and relations for which a source knows each event with two objects as numbers, and ``(a, b, us, id)``: the
    #: name of object ``a`` comes before that of ``b``, ``us`` are microseconds, ids are whole numbers as text. What is no such number is null.
    pairs: tuple[DataFrame, DataFrame, DataFrame] | None = None
    #: Whether the events are the source's own, with those that have no relation.
    whole: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    def with_events(self, events: DataFrame) -> Log:
        """The log with fewer events, and the relations that remain."""
        return replace(self, events=events, e2o=self.e2o.join(events.select("event_id"), "event_id", "left_semi"))

    def with_relations(self, e2o: DataFrame) -> Log:
        """The log with fewer relations; events and objects without any go."""
        return replace(
            self,
            e2o=e2o,
            events=self.events.join(e2o.select("event_id").distinct(), "event_id", "left_semi"),
            objects=self.objects.join(e2o.select("object_id").distinct(), "object_id", "left_semi"),
        )

    def without_types(self, types: list[str]) -> Log:
        """Drop object types, and every relation that touches one of their objects."""
        known = self._known()
        objects = self.objects.where(~F.col("object_type").isin(types))
        ids = objects.select("object_id")
        o2o = self.o2o.join(ids, self.o2o["source_id"] == ids["object_id"], "left_semi")
        e2o = self.e2o.where(~F.col("object_type").isin(types))
        keep = lambda o: ~o["object_type"].isin(types)
        left = None if known is None else known.withColumn("objects", F.filter("objects", keep))
        cases = {t: c.withColumn("events", _with_objects(keep)) for t, c in self._cases().items() if t not in types}
        return replace(
            self,
            objects=objects,
            e2o=e2o,
            o2o=o2o.join(ids, o2o["target_id"] == ids["object_id"], "left_semi"),
            object_changes=self.object_changes.where(~F.col("object_type").isin(types)),
            known=None if left is None else (self.events, e2o, left),
            cases=(self.events, e2o, cases),
        )

    def on_types(self, types: list[str]) -> Log:
        """The relations of some object types, and the events and objects that have them."""
        out, known = self.with_relations(self.e2o.where(F.col("object_type").isin(types))), self._known()
        if known is None:
            return out
        keep = lambda o: o["object_type"].isin(types)
        left = known.withColumn("objects", F.filter("objects", keep)).where(F.size("objects") > 0)
        cases = {t: c.withColumn("events", _with_objects(keep)) for t, c in self._cases().items() if t in types}
        return replace(out, known=(out.events, out.e2o, left), cases=(out.events, out.e2o, cases), whole=False)

    def _known(self) -> DataFrame | None:
        """The source's table, if this log still has the events and relations it was made for."""
        return self.known[2] if self.known is not None and self.known[0] is self.events and self.known[1] is self.e2o else None

    def _cases(self) -> dict[str, DataFrame]:
        return self.cases[2] if self.cases is not None and self.cases[0] is self.events and self.cases[1] is self.e2o else {}

    def cases_of(self, object_type: str) -> DataFrame | None:
        """``(pe_id, events)`` of every object of a type, if the source knows them."""
        return self._cases().get(object_type)

    def cased(self) -> str | None:
        """A type whose cases are known, if any."""
        return next(iter(sorted(self._cases())), None)

    def numbered(self) -> Numbered | None:
        """The source's numbers, if this log still has all that they were made for."""
        own = (self.events, self.objects, self.e2o, self.o2o)
        return self.numbers[4] if self.numbers is not None and all(a is b for a, b in zip(self.numbers, own, strict=False)) else None

    def paired(self) -> DataFrame | None:
        """The source's events of two numbered objects, if this log still has the events and relations they were made for."""
        return self.pairs[2] if self.pairs is not None and self.pairs[0] is self.events and self.pairs[1] is self.e2o else None

    def packed_known(self) -> bool:
        """Whether events and their relations come from one table, so that each relation has its event."""
        return self._known() is not None

    def packed(self) -> DataFrame:
        """``(event_id, activity, ts, objects)``: every event with a struct (type, id, qualifier) for each of its relations."""
        known = self._known()
        if known is not None:
            return known
        objects = self.e2o.groupBy("event_id").agg(F.collect_list(F.struct("object_type", "object_id", "qualifier")).alias("objects"))
        none = F.array().cast("array<struct<object_type:string,object_id:string,qualifier:string>>")
        return self.events.join(objects, "event_id", "left").select("event_id", "activity", "ts", F.coalesce("objects", none).alias("objects"))

    def timed(self) -> DataFrame:
        """Relations with the activity and time of their event: the fact table of most operators."""
        known = self._known()
        if known is None:
            return self.e2o.join(self.events.select("event_id", "activity", "ts"), "event_id")
        each = known.where("event_id is not null").select("event_id", "activity", "ts", F.explode("objects").alias("o"))
        return each.select("event_id", "o.object_id", "o.object_type", "o.qualifier", "activity", "ts")

    def wide(self, types: list[str]) -> DataFrame:
        """One row for each event, with an array column of object ids for every type."""
        pivoted = self.e2o.groupBy("event_id").pivot("object_type", types).agg(F.sort_array(F.collect_set("object_id")))
        empty = F.array().cast("array<string>")
        return self.events.join(pivoted, "event_id", "left").select(
            "event_id", "activity", "ts", *[F.coalesce(F.col(f"`{t}`"), empty).alias(t) for t in types]
        )


def _with_objects(keep: Callable[[Column], Column]) -> Column:
    """Events of a case with some of their objects only."""
    return F.transform("events", lambda e: e.withField("objects", F.filter(e["objects"], keep)))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def from_tables(spark: SparkSession, events: DataFrame, objects: DataFrame, e2o: DataFrame, o2o: DataFrame | None = None, object_changes: DataFrame | None = None) -> Log:
    """Build a log; relations become distinct, and missing parts empty."""
    return Log(
        events,
        objects,
        e2o.dropDuplicates(["event_id", "object_id", "qualifier"]),
        empty(spark, O2O) if o2o is None else o2o,
        empty(spark, CHANGES) if object_changes is None else object_changes,
    )
