"""The full ingest: replays, later batches, stubs, subsets of the sources."""

import pytest
from pyspark.sql import functions as F

from verisift.functions.keys import entity_key
from verisift.plans import ingest

PEOPLE = "PersonID long, FirstName string, LastName string, IsCurrent boolean, seq long"
VOTES = "vote_id string, kmmbr_id string, kmmbr_name string, vote_result string, seq long"
BILLS = "BillID long, Name string, KnessetNum int, StatusID long, seq long"
STARTED = "BillInitiatorID long, BillID long, PersonID long, IsInitiator boolean, Ordinal int, seq long"


@pytest.fixture(scope="module")
def raw(spark):
    make = spark.createDataFrame
    return {
        "people": make([(1, "Ann", "Lee", True, 1), (1, None, None, None, 2), (None, "x", "y", True, 3)], PEOPLE),
        "votes": make([("7", "0001", None, "1", 1), ("7", "0001", None, "2", 2), ("7", "0009", None, "0", 3), ("8", "0009", None, "3", 4), (None, "1", None, "1", 5)], VOTES),
        "bills": make([(5, "Road", 20, 1, 1), (5, None, None, 2, 2)], BILLS),
        "initiators": make([(1, 5, 1, True, 1, 1), (2, 6, 1, True, 2, 2), (3, 6, 2, False, 3, 3)], STARTED),
    }


@pytest.fixture(scope="module")
def graph(raw, tmp_path_factory):
    return ingest.ingest(raw, str(tmp_path_factory.mktemp("first")))


def rows(df):
    return sorted(map(str, df.collect()))


def key(spark, kind, ident):
    return spark.range(1).select(entity_key(kind, F.lit(ident)).alias("k")).first().k


def test_tables(spark, graph):
    ann, nine, one = key(spark, "knesset_person", "1"), key(spark, "knesset_person", "9"), key(spark, "knesset_vote", "7")
    people = {r.person_id: r.canonical_name for r in graph.nodes["person"].collect()}
    # a name is never overwritten by null, but by the label that a later record without names has; a voter nobody described is a stub
    assert people == {ann: "person:1", nine: None} and {r.hebrew_name for r in graph.nodes["person"].collect()} == {"Ann Lee", None}
    assert sorted((r.person_id, r.value) for r in graph.edges["cast_vote"].collect() if r.vote_event_id == one) == [(ann, "against")]
    assert graph.edges["cast_vote"].count() == 2 and graph.nodes["vote_event"].count() == 2
    assert sorted((r.title or "", r.status or "") for r in graph.nodes["bill"].collect()) == [("", ""), ("bill:5", "status:2")]
    assert graph.edges["sponsored"].count() == 2 and set(graph.nodes) == {"person", "bill", "vote_event"} and set(graph.edges) == {"cast_vote", "sponsored"}
    assert {r.label: r.n for r in graph.counts().collect()} == {"person": 2, "bill": 2, "vote_event": 2, "cast_vote": 2, "sponsored": 2}


def test_replay_changes_nothing(raw, graph, tmp_path):
    again = ingest.ingest(raw, str(tmp_path / "second"), current=graph)
    assert all(rows(again.nodes[t]) == rows(graph.nodes[t]) for t in graph.nodes)
    assert all(rows(again.edges[t]) == rows(graph.edges[t]) for t in graph.edges)


def test_later_batch_fills_a_stub(spark, graph, tmp_path):
    """A source alone: other tables stay; the stub of bill 6 gets its attributes."""
    more = ingest.ingest({"bills": spark.createDataFrame([(6, "Rail", 21, 0, 9)], BILLS)}, str(tmp_path / "third"), current=graph)
    assert sorted(r.title for r in more.nodes["bill"].collect()) == ["Rail", "bill:5"]
    assert more.nodes["person"] is graph.nodes["person"] and more.edges == graph.edges


def test_ends_exist_and_nothing_is_joined_for_them(raw, graph, tmp_path, monkeypatch):
    """Both ends of every edge are rows or stubs; a first ingest needs no look at the entity tables, a later one checks old edges only."""
    calls = []
    monkeypatch.setattr(ingest, "with_endpoints", lambda e, *a: calls.append(e) or e)
    first = ingest.ingest(raw, str(tmp_path / "ends"))
    assert not calls
    for name, (_, src, dst, _) in ingest.LINKS.items():
        if name in first.edges:
            source, target, _ = ingest.EDGES[name]
            e = first.edges[name]
            for c, t in ((src, source), (dst, target)):
                assert e.join(first.nodes[t], e[c] == first.nodes[t][ingest.ENTITY_KEYS[t]], "left_anti").count() == 0
            assert rows(e) == rows(graph.edges[name])
    ingest.ingest({"votes": raw["votes"]}, str(tmp_path / "more"), current=first)
    assert len(calls) == 1
