"""Shards, their store, CSV, streams, and queries over multi-valued and group fields, on small tables worked out by hand."""

import datetime
import json
import random

import pytest

from lodestar.engine import Engine, closure
from lodestar.plans.schema import Application, Catalog
from lodestar.sources import shards
from lodestar.streaming import live

DOCS = "_ID string, name string, size int, tags array<string>"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def by_id(df):
    return {r["_ID"]: r.asDict() for r in df.collect()}


def test_store_merges_batches(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.add(docs(spark, ("1", "a", 1, ["x"]), ("2", "b", 2, None), ("3", "c", 3, ["z"])), "2013")
    store.add(docs(spark, ("1", "A", None, ["y"])), "2013")
    store.delete(docs(spark, ("2", None, None, None)), "2013")
    again = shards.ShardStore(spark, f"file://{tmp_path}/s")  # goes on where the first one stopped
    assert again.orders == [0, 3]
    again.add(docs(spark, ("1", "old", 9, ["w"]), ("4", "d", 4, None)), "2013", overwrite=False)
    again.add(docs(spark, ("2", "new", None, ["n"])), "2013")
    got = by_id(again.merge())
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["name"], got["1"]["size"], got["1"]["tags"]) == ("A", 1, ["w", "x", "y"])
    assert (got["2"]["name"], got["2"]["size"], got["2"]["tags"]) == ("new", None, ["n"])
    again.add(docs(spark, ("1", "x", 1, None)), "2014")
    assert [(r["_ID"], r["shards"]) for r in shards.duplicates(again.merge()).collect()] == [("1", "2013,2014")]
    before = again.properties()["2013"]["cube"]
    assert again.merge("2014").count() == 5 and again.properties()["2013"]["cube"] == before  # nothing new there
    again.merge("2013", force=True)
    assert again.properties()["2013"]["cube"] != before
    assert by_id(again.get("1", "2013"))["1"]["name"] == "A" and again.get("2", "2014").count() == 0
    again.drop("2014")
    assert [r["_shard"] for r in again.shards().collect()] == ["2013"]


def test_segments_and_expiry(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.add(docs(spark, ("1", "a", 1, ["p", "q"])), "x")
    last = store.add(docs(spark, ("1", "b", None, ["q", "r"]), ("2", "c", 2, None)), "x")
    store.add(docs(spark, ("9", "z", 9, None)), "y")
    assert store.segments("x") == [1, 2] and by_id(store.merge())["1"]["name"] == "b"
    assert sorted(map(tuple, shards.edges(store.snapshot("x"), "tags").collect())) == [("1", "p"), ("1", "q"), ("1", "r")]  # links unite
    store.drop_segment("x", last)
    assert {k: v["name"] for k, v in by_id(store.merge()).items()} == {"1": "a", "9": "z"}
    store.expire("y", "2024-01-01 00:00:00")
    assert store.age("2023-12-31 00:00:00") == [] and store.age("2024-01-01 00:00:00") == ["y"]
    assert [r["_ID"] for r in store.snapshot().collect()] == ["1"]
    mono = shards.MonoStore(spark, f"file://{tmp_path}/m")
    mono.update(docs(spark, ("1", "a", 1, None)))
    assert by_id(mono.update(docs(spark, ("1", "b", None, None))))["1"] == {"_shard": "mono", "_ID": "1", "name": "b", "size": 1, "tags": []}


def test_auto_merge(spark, tmp_path):
    rows = spark.createDataFrame([("x", "1", "a"), ("y", "2", "b")], "_shard string, _ID string, name string")
    rows.write.parquet(f"file://{tmp_path}/in")
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    live.auto_merge(live.tail(spark, f"file://{tmp_path}/in", rows.schema), store, f"file://{tmp_path}/cp", once=True).awaitTermination(120)
    assert sorted((r["_shard"], r["_ID"], r["name"]) for r in store.snapshot().collect()) == [("x", "1", "a"), ("y", "2", "b")]


def test_links_and_upserts(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    got = shards.with_links(e(("1", "a"), ("1", "b")), e(("2", "a"), ("1", "a")), e(("1", "b"), ("7", "x")))
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "a")]
    df = docs(spark, ("1", "a", 1, ["x"]), ("2", "b", 2, None))
    got = by_id(shards.upserted(df, spark.createDataFrame([("1", "A"), ("3", "c")], "_ID string, name string"), ("size",)))
    assert {k: (v["name"], v["size"]) for k, v in got.items()} == {"1": ("A", None), "2": ("b", 2), "3": ("c", None)}


def test_catalog():
    c = Catalog()
    spec = {"App": {"tables": {"T": {"fields": {"a": {}, "g": {"fields": {"x": {}, "L": {"type": "LINK", "table": "T", "inverse": "M"}}}}, "aliases": {"$q": {"expression": "a=1"}}}}}}
    c.define(spec)
    assert c.list() == ["App"] and Application.from_dict(c.get("App").to_dict()).to_dict() == c.get("App").to_dict()
    spec["App"]["tables"]["T"]["fields"]["b"] = {"type": "INTEGER"}
    assert "b" in c.modify(spec).tables["T"].fields
    spec["App"]["tables"]["T"]["fields"]["a"] = {"type": "LINK", "table": "T"}
    with pytest.raises(ValueError, match="T.a"):
        c.modify(spec)
    assert not c.get("App").tables["T"].fields["a"].is_link
    with pytest.raises(ValueError, match="Other"):
        c.modify({"Other": {"tables": {}}})
    c.delete("App")
    assert c.list() == []


def test_analyzers(spark):
    fields = {"t": {}, "h": {"analyzer": "HTMLAnalyzer"}, "o": {"analyzer": "OpaqueTextAnalyzer"}, "n": {"analyzer": "NullAnalyzer"}}
    app = Application.from_dict({"A": {"options": {"text-sums": "none"}, "tables": {"T": {"fields": fields}}}})
    rows = spark.createDataFrame([("1", "a b", '<p class="b">x</p>y', "New York", "z")], "_ID string, t string, h string, o string, n string")
    e = Engine(spark, app, {"T": rows})
    hits = {q: e.select("T", q).count() for q in ("t:b", "h:x", "h:class", "h:'x y'", "o:york", "o:'new york'", "o:'new*'", "n:z", "n=z")}
    assert hits == {"t:b": 1, "h:x": 1, "h:class": 0, "h:'x y'": 1, "o:york": 0, "o:'new york'": 1, "o:'new*'": 1, "n:z": 0, "n=z": 1}
    assert sorted(r[0] for r in e.aggregate("T", "*", "TERMS(h)").collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="no text"):
        e.aggregate("T", "*", None, "SUM(t)")


def test_empty_batch(spark, tmp_path):
    assert shards.merged(shards.batch(docs(spark), "s", 1)).count() == 0
    assert shards.field_statistics(docs(spark)).where("objects > 0 or values > 0").count() == 0


def test_field_statistics(spark):
    got = shards.field_statistics(docs(spark, ("1", "b", 3, ["x", "y"]), ("2", None, -1, []), ("3", "a", None, None)))
    assert {r["field"]: tuple(r)[1:] for r in got.collect()} == {"name": (2, 2, "a", "b"), "size": (2, 2, "-1", "3"), "tags": (1, 2, "x", "y")}


def test_deltas_and_updates(spark):
    df = docs(spark, ("1", "a", 1, ["x", "y"]), ("2", "b", 2, None))
    delta = lambda *rows: spark.createDataFrame(list(rows), "_ID string, values array<string>")
    got = by_id(shards.with_delta(df, "tags", delta(("1", ["z"]), ("2", ["q"])), delta(("1", ["x"]))))
    assert sorted(got["1"]["tags"]) == ["y", "z"] and got["2"]["tags"] == ["q"]
    got = by_id(shards.update_where(df, df.size == 2, {"name": "two"}))
    assert (got["1"]["name"], got["2"]["name"]) == ("a", "two")


def test_csv_and_rendering(spark, tmp_path):
    df = docs(spark, ("1", 'a, "q"', 1, ["x", "y"]), ("2", None, None, None))
    shards.write_csv(df, f"file://{tmp_path}/c")
    got = by_id(shards.read_csv(spark, f"file://{tmp_path}/c", DOCS))
    assert got == by_id(df)
    assert sorted((json.loads(r["value"]) for r in shards.as_json(df).collect()), key=lambda d: d["_ID"]) == [{"_ID": "1", "name": 'a, "q"', "size": 1, "tags": ["x", "y"]}, {"_ID": "2"}]
    assert "<_ID>2</_ID>" in [r["value"] for r in shards.as_xml(df).collect()][1].replace(" ", "")


def test_streams(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 2, h, m)
    rows = spark.createDataFrame([(at(1), "a"), (at(1, 30), "a"), (at(2), "b")], "Timestamp timestamp, level string")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = live.tail(spark, f"file://{tmp_path}/in", rows.schema)
    live.ingest(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination(60)
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == 3 and [str(r[0]) for r in log.select("_day").distinct().collect()] == ["2024-01-02"]
    seen = []
    q = live.upserts(stream, lambda df, i: seen.append(live.counts(df, by="level").collect()), f"file://{tmp_path}/cp2")
    q.awaitTermination(60)
    assert sorted(r["count"] for r in seen[0]) == [1, 2]


@pytest.fixture(scope="module")
def mail(spark):
    fields = {"name": {}, "tags": {"collection": "true"}, "size": {"type": "INTEGER"}, "Ends": {"fields": {"From": {"type": "LINK", "table": "Person", "inverse": "Sent"}, "To": {"type": "LINK", "table": "Person", "inverse": "Got"}}}}
    app = Application.from_dict({"Mail": {"tables": {"Message": {"fields": fields, "aliases": {"$big": {"expression": "size>5"}}}, "Person": {"fields": {"who": {}}}}}})
    edges = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    messages = docs(spark, ("1", "a", 1, ["red", "blue"]), ("2", "b", 9, ["red"]), ("3", "c", 7, None))
    people = spark.createDataFrame([("p", "Ann"), ("q", "Bob")], "_ID string, who string")
    return Engine(spark, app, {"Message": messages, "Person": people}, {("Message", "From"): edges(("1", "p"), ("2", "q"), ("3", "q")), ("Message", "To"): edges(("1", "q"), ("3", "p"))})


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("ANY(tags)=red", "12"),
        ("ALL(tags)=red", "2"),
        ("NONE(tags)=blue", "23"),
        ("tags IS NULL", "3"),
        ("COUNT(tags)=2", "1"),
        ("$big", "23"),
        ("From.who=bob AND $big", "23"),
        ("NONE(To).who=Ann", "12"),
        ("Ends.who=Ann", "13"),
    ],
)
def test_queries(mail, q, want):
    assert "".join(sorted(r["_ID"] for r in mail.select("Message", q).collect())) == want


def test_pair(mail):
    got = mail.pair("Message", "_pair.first.who=Ann AND _pair.second.who=Bob", ("From", "To"))
    assert sorted(r["_ID"] for r in got.collect()) == ["1", "3"]


def test_group_fields_and_pairs_in_aggregates(mail):
    by = lambda df: sorted((r[0] or "", *r[1:]) for r in df.collect())
    assert by(mail.aggregate("Message", "*", "Ends.who", "COUNT(*), SUM(size)")) == [("Ann", 2, 8), ("Bob", 3, 17)]
    assert by(mail.aggregate("Message", "*", "name", "COUNT(Ends.who)")) == [("a", 2), ("b", 1), ("c", 2)]
    pair = ("From", "To")
    assert by(mail.aggregate("Message", "_pair.first.who=Ann", "_pair.second.who", "COUNT(*)", pair=pair)) == [("Bob", 2)]
    assert by(mail.aggregate("Message", "*", "_pair.first.who", "COUNT(*)", pair=pair)) == [("", 1), ("Ann", 2), ("Bob", 3)]


def test_top_of_upper_levels(mail):
    """A parent is ranked by its own mean, not by the sum of its children's."""
    got = mail.aggregate("Message", "*", "TOP(1,From.who),name", "AVERAGE(size) AS a").collect()
    assert sorted((r[0], r[1], r["a"]) for r in got) == [("Bob", "b", 9.0), ("Bob", "c", 7.0)]
    got = mail.aggregate("Message", "*", "BOTTOM(1,To.who),TOP(1,name)", "SUM(size) AS a").collect()
    assert [(r[0], r[1], r["a"]) for r in got] == [("Bob", "a", 1)]


def test_link_rows(mail):
    got = {r["_ID"]: r for r in mail.query("Message", "*", "_all,From(who,Sent[1](name))", s=0).collect()}
    assert [x["who"] for x in got["2"]["From"]] == ["Bob"] and got["2"]["To"] is None and got["1"]["tags"] == ["blue", "red"]
    got = mail.query("Message", "size>5", "From(who,Sent.WHERE(size>5).WHERE(size<9)[1](name))", s=0).collect()
    assert {r["_ID"]: [(x["who"], [y["name"] for y in x["Sent"]]) for x in r["From"]] for r in got} == {"2": [("Bob", ["c"])], "3": [("Bob", ["c"])]}
    page = mail.query("Message", "size>5", "name", s=1, total=True).collect()
    assert [(r["_ID"], r["_total"]) for r in page] == [("2", 2)]


def test_groups_of_many_values(mail):
    got = mail.aggregate("Message", "*", "tags", "COUNT(*), SUM(size)").collect()
    assert sorted(((r[0] or "", r[1], r[2]) for r in got)) == [("", 1, 7), ("blue", 1, 1), ("red", 2, 10)]


def test_closure_of_long_chains(spark):
    fields = {"role": {}, "Before": {"type": "LINK", "table": "Turn", "inverse": "After"}}
    app = Application.from_dict({"Talk": {"tables": {"Turn": {"fields": fields}}}})
    turns = spark.createDataFrame([(f"{i}", "system" if i == 0 else "user") for i in range(150)], "_ID string, role string")
    before = spark.createDataFrame([(f"{i}", f"{i - 1}") for i in range(1, 150)], "src string, dst string")
    talk = Engine(spark, app, {"Turn": turns}, {("Turn", "Before"): before})
    assert talk.aggregate("Turn", "*", None, "COUNT(Before^) AS n").first()["n"] == sum(range(150))
    assert talk.select("Turn", "Before^.role=system").count() == 149
    assert talk.select("Turn", "Before^(120).role=system").count() == 120


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 6, 7, -1])
def test_closure_of_graphs(spark, depth):
    r = random.Random(depth)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(36)] + [(i, i + 1) for i in range(40, 52)] + [(52, 40), (1, 1)]
    want, frontier = set(edges), set(edges)
    for _ in range(depth - 1 if depth > 0 else 60):
        frontier = {(a, d) for a, b in frontier for c, d in edges if b == c} - want
        want |= frontier
    got = [(x["src"], x["dst"]) for x in closure(spark.createDataFrame(edges, "src int, dst int"), depth).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a != b}
