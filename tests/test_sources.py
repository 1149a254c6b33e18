"""Round trips of every format, and streaming views."""

import io
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from braidlog import model
from braidlog.operators import explorer
from braidlog.sources import documents, sqlite
from braidlog.streaming import incremental


@pytest.fixture(scope="module")
def log(spark):
    at = datetime(2024, 3, 1, 12, 30, 15, 250000)
    events = [("e1", "place order", at, {"cost": "1.5"}), ("e2", "ship & go", at + timedelta(hours=1), {}), ("e3", "pay", at + timedelta(hours=2), {"cost": "2"})]
    objects = [("o1", "order", {"prio": "high"}), ("i1", "item", {"name": 'a "quoted" <x>'}), ("i2", "item", {})]
    e2o = [("e1", "o1", "order", "made"), ("e1", "i1", "item", ""), ("e2", "i1", "item", "sent"), ("e2", "i2", "item", ""), ("e3", "o1", "order", "")]
    return model.from_tables(spark, spark.createDataFrame(events, model.EVENTS), spark.createDataFrame(objects, model.OBJECTS), spark.createDataFrame(e2o, model.E2O), spark.createDataFrame([("o1", "i1", "has")], model.O2O))


def content(log, qualifiers=True):
    events = sorted((r.event_id, r.activity, r.ts, tuple(sorted(r.attrs.items()))) for r in log.events.collect())
    objects = sorted((r.object_id, r.object_type, tuple(sorted(r.attrs.items()))) for r in log.objects.collect())
    e2o = sorted((r.event_id, r.object_id, r.object_type, r.qualifier if qualifiers else "") for r in log.e2o.collect())
    return events, objects, e2o, sorted(tuple(r) for r in log.o2o.collect())


@pytest.mark.parametrize("name", ["log.sqlite", "log.json", "log.xml", "log"])
def test_round_trip(spark, log, tmp_path, name):
    path = str(tmp_path / name)
    documents.write_ocel(log, path)
    assert content(documents.read_ocel(spark, path)) == content(log)


def test_ocel1_round_trip(spark, log, tmp_path):
    path = str(tmp_path / "log.jsonocel")
    documents.write_ocel(log, path, "ocel1")
    assert "ocel:events" in json.loads((tmp_path / "log.jsonocel").read_text())
    assert content(documents.read_ocel(spark, path)) == content(log, False)


def test_flat_xml(spark, tmp_path):
    path = tmp_path / "flat.xml"
    path.write_text('<log><object id="o" type="order"><attribute name="p" value="1"/></object><event id="e" type="a" time="2024-01-01T00:00:00Z"><relationship object-id="o" qualifier="q"/></event></log>')
    got = documents.read_xml(spark, str(path))
    assert [tuple(r) for r in got.e2o.collect()] == [("e", "o", "order", "q")]
    assert got.objects.first().attrs == {"p": "1"}


def test_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("event_id,event_activity,event_timestamp,order,item,cost\ne1,a,2024-01-01 00:00:00,\"['o1', 'o2']\",set(),3\ne2,b,2024-01-02 00:00:00,,\"{'i1'}\",\ne3,c,2024-01-03 00:00:00,,,\n")
    got = documents.read_csv(spark, str(path), ["order", "item"])
    assert sorted((r.event_id, r.object_id) for r in got.e2o.collect()) == [("e1", "o1"), ("e1", "o2"), ("e2", "i1")]
    assert sorted(r.event_id for r in got.events.collect()) == ["e1", "e2"]
    assert got.events.where("event_id = 'e1'").first().attrs == {"cost": "3"}


def test_sqlite_changes_and_orphans(spark, log, tmp_path):
    import sqlite3

    path = str(tmp_path / "c.sqlite")
    sqlite.write(log, path)
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO object_Order VALUES ('o1', '2024-05-01 00:00:00', 'prio', 'low')")
        db.execute("INSERT INTO object_Order VALUES ('o1', '2024-06-01 00:00:00', 'prio', 'no_prio')")
    got = documents.read_ocel(spark, path)
    assert got.objects.where("object_id = 'o1'").first().attrs == {"prio": "low"}
    assert got.object_changes.where("object_id = 'o1'").count() == 3
    with pytest.raises(ValueError):
        sqlite.suffixes(["a b", "ab", "A B"])


def test_merge(spark, log):
    both = documents.merge(log, log)
    assert content(both) == content(log)


def test_bundle(spark, tmp_path):
    t = spark.createDataFrame([(0, "p", "x")], "config_id int, pattern_id string, pe_id string")
    kpis = spark.createDataFrame([("x", "duration", 1.0), ("y", "duration", 2.0)], "pe_id string, kpi string, value double")
    configs = spark.createDataFrame([(0, "top", None)], "config_id int, text string, reason string")
    contrast = spark.createDataFrame([(0, "p", "duration", 1.0)], "config_id int, pattern_id string, kpi string, abs_delta double")
    classes = spark.createDataFrame([(0, "x", "x"), (0, "y", "x")], "config_id int, pe_id string, class_id string")
    members = spark.createDataFrame([(0, "duration", 0, "all", "x"), (1, "duration", 1, "b1", "x")], "config_id int, kpi string, leaf int, label string, pe_id string")
    explorer.Bundle(configs, t, t, kpis, contrast, classes, t, members).save(str(tmp_path / "b"))
    b = explorer.Bundle.load(spark, str(tmp_path / "b"))
    assert explorer.summary(b).first().n_executions == 2
    assert explorer.options(b).count() == 1
    assert explorer.behaviours(b, 0, "duration").first().abs_delta == 1.0
    table = explorer.situation(b, 0, ["p"], ["duration"])
    assert {r.pe_id: r.b1 for r in table.collect()} == {"x": "Y", "y": "N"}
    assert explorer.filtered(table, {"duration": (1.5, None)}, "duration").first().pe_id == "y"
    assert explorer.leaves(b, 0).first().executions == ["x", "y"]
    assert explorer.compact_cross(b, "duration", 0, 0).first().leaf_b == 1
    assert explorer.leaf_index(b).count() == 2 and explorer.tree_leaves(b, 0, "duration").count() == 1
    assert explorer.leaf_members(b, 0, "duration", 0).first().value == 1.0


def test_streaming_views(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(str(i), "ab"[i % 2], at + timedelta(minutes=i), f"o{i % 3}", "order") for i in range(12)]
    spark.createDataFrame(rows, incremental.RELATIONS).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_relations(spark, str(tmp_path / "in"))
    for name, df in (("pairs", incremental.directly_follows(stream)), ("windows", incremental.windowed_activity(stream, "1 hour"))):
        mode = "append" if name == "pairs" else "complete"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    pairs = spark.table("pairs")
    assert pairs.count() == 9
    assert {r.gap for r in pairs.collect()} == {180.0}
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 12


def test_json_is_read_piece_by_piece():
    text = '{"a": [{"x": "}],\\"é"}, 12, [1, {"y": 2}]], "n": 123, "e": [], "f": {}, "o": {"k\\"1": {"z": null}, "k2": "v"}}'
    wanted = [("a", None, '{"x": "}],\\"é"}'), ("a", None, "12"), ("a", None, '[1, {"y": 2}]'), ("o", 'k"1', '{"z": null}'), ("o", "k2", '"v"')]
    for chunk in (1, 3, 1000):
        assert list(documents.members(io.StringIO(text), chunk)) == wanted
    with pytest.raises(ValueError):
        list(documents.members(io.StringIO(text[:-5])))


def test_json_members_are_not_sorted(spark, tmp_path, monkeypatch):
    """The task that streams a JSON document sends its members on without sorting them, and loses none."""
    import json

    from braidlog.sources import documents

    path, seen = str(tmp_path / "log.json"), []
    with open(path, "w") as out:
        json.dump({"ocel:events": {f"e{i}": {} for i in range(3500)}, "ocel:o2o": [{"source": str(i)} for i in range(3)]}, out)
    monkeypatch.setattr(documents, "written", lambda df, label: seen.append(df) or df)
    found = documents._members(spark, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "Sort" not in plan
    rows = found.collect()
    assert {r.key for r in rows if r.section == "ocel:events"} == {f"e{i}" for i in range(3500)}
    assert len(rows) == 3503


def test_json_is_read_in_parts(spark, tmp_path, monkeypatch):
    """Parts that begin anywhere, in strings, escapes and names too, give the members of the stream."""
    text = '\ufeff {"a\\"x": ["}],\\\\\\"é", 12, [1, {"y": "[\\\\"}], "b:", true] , "n": 123,"s":"{[,", "e": [ ], "f": {}, "o" : {"k\\"1,": {"z": null}, "k2":"v,\\\\", "é": [1,2]}, "z":[{"s": 1}]}'
    path = str(tmp_path / "log.json")
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    key = lambda rows: sorted(((a, b, c.strip()) for a, b, c in rows), key=str)
    wanted = key(documents.members(io.StringIO(text[1:])))
    assert len(wanted) == 9
    for part in (1, 2, 3, 7, 40, 1 << 20):
        monkeypatch.setattr(documents, "PART", part)
        assert key(documents._members(spark, path).collect()) == wanted
    with open(path, "w", encoding="utf-8") as out:
        out.write(text[:-5])
    with pytest.raises(ValueError):
        documents._members(spark, path)


def test_documents_are_not_streamed_by_the_driver(spark, log, tmp_path, monkeypatch):
    """Tasks write a document's rows, and objects and events are parsed once each."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    seen, own = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df, label: seen.append(label) or own(df, label))
    for name, dialect in (("a.jsonocel", "ocel1"), ("a.json", None), ("a.xml", None)):
        documents.write_ocel(log, str(tmp_path / name), dialect)
        found = documents.read_ocel(spark, str(tmp_path / name))
        assert found.events.count() == log.events.count() and found.objects.count() == log.objects.count()
    assert seen == ["json", "json", "xml", "xml"]
