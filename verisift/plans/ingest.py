"""Full ingest: raw rows of all sources -> entity and edge tables, as one job over sets.

Each source is normalised once and written; every table is then one upsert of all records about it, with rows without attributes for
keys that only facts name, and every edge table one merge. Nothing is done row by row, and a replay gives the same tables.

Records hold the names that keys are made of, which compress to a few bytes; rows are folded by name and get their keys when that is done.
A batch's edges need no look at the entity tables: both ends are rows or stubs of the same batch. Edges of a table given as ``current`` are
checked. A table that is new is the folded batch, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key_name, uuid5
from ..operators import adapters, quality
from ..operators.upsert import DEFAULTS, first_rows, merge_edges, stub_rows, upsert, with_endpoints
from .schemas import EDGES, ENTITY_KEYS, TABLES

SEQ = ("seq",)

#: Entity table -> the records it takes rows from, with their columns by name. Fixed values.
ROWS: dict[str, list[tuple[str, dict[str, str]]]] = {
    "person": [("people", {c: c for c in ("canonical_name", "hebrew_name", "external_ids", "source_tier")})],
    "party": [("party_terms", {"canonical_name": "party_name"})],
    "office": [("office_terms", {c: c for c in ("canonical_name", "office_type", "scope")})],
    "committee": [("committees", {c: c for c in ("canonical_name", "hebrew_name")})],
    "bill": [("bills", {c: c for c in ("title", "knesset_number", "status")})],
    "vote_event": [("votes", {})],
    "attendance_event": [("sessions", {c: c for c in ("committee_id", "occurred_at")})],
    "position_term": [("position_terms", {c: c for c in ("person_id", "office_id", "appointing_body", "valid_from", "valid_to", "is_acting")})],
    "election_result": [("elections", {c: c for c in ("election_date", "knesset_number", "list_name", "ballot_letters", "list_party_id", "votes", "seats_won", "vote_share", "passed_threshold")})],
    "government_decision": [("decisions", {c: c for c in ("decision_number", "government_number", "decision_date", "title", "summary", "issuing_body", "source_url")})],
}
#: Entity table -> where facts name its keys. Fixed values.
NAMED = {
    "person": [(r, "person_id") for r in ("party_terms", "office_terms", "position_terms", "memberships", "initiators", "votes", "attendances")],
    "party": [("elections", "list_party_id")], "committee": [("memberships", "committee_id"), ("sessions", "committee_id")], "bill": [("initiators", "bill_id")],
}
#: Edge table -> its records, the columns of its two ends, and its properties. Fixed values.
LINKS = {
    "cast_vote": ("votes", "person_id", "vote_event_id", ["value"]), "attended": ("attendances", "person_id", "attendance_event_id", ["presence"]), "sponsored": ("initiators", "person_id", "bill_id", ["ordinal"]),
    "member_of": ("party_terms", "person_id", "party_id", ["valid_from", "valid_to"]), "held_office": ("office_terms", "person_id", "office_id", ["valid_from", "valid_to"]),
    "member_of_committee": ("memberships", "person_id", "committee_id", ["valid_from", "valid_to"]), "has_position_term": ("position_terms", "person_id", "position_term_id", []),
    "about_office": ("position_terms", "position_term_id", "office_id", []), "for_party": ("elections", "election_result_id", "list_party_id", []),
}


#: Columns of records that hold names of keys. Fixed values.
KEYS = {*ENTITY_KEYS.values(), "list_party_id"}


def keyed(df: DataFrame) -> DataFrame:
    """Keys in place of their names."""
    return df.select(*[uuid5(F.col(c)).alias(c) if c in KEYS else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """(label, n) of every table."""
        return quality.count_labels({**self.nodes, **self.edges})


def records(raw: dict[str, DataFrame], members: DataFrame | None = None, lists: DataFrame | None = None, compose: bool = False) -> dict[str, DataFrame]:
    """Typed records of the sources that are there, with the names of keys for keys. members: the lookup of individual ids; lists: the mapping of election lists."""
    out = {}
    if "people" in raw:
        out["people"] = adapters.people(raw["people"], compose, SEQ, key_name)
    if "positions" in raw:
        lanes = adapters.positions(raw["positions"], SEQ, key_name)
        out |= {"party_terms": lanes["party"], "office_terms": lanes["office"], "position_terms": lanes["term"]}
    if "attendance" in raw:
        out["sessions"], out["attendances"] = adapters.attendance(raw["attendance"], members, SEQ, key_name)
    single = {"committees": adapters.committees, "bills": adapters.bills, "initiators": adapters.bill_initiators, "votes": adapters.votes, "decisions": adapters.government_decisions}
    out |= {name: f(raw[name], keep=SEQ, key=key_name) for name, f in single.items() if name in raw}
    if "memberships" in raw:
        out["memberships"] = adapters.committee_memberships(raw["memberships"], members, SEQ, key_name)
    if "elections" in raw:
        out["elections"] = adapters.election_results(raw["elections"], lists, SEQ, key_name)
    return out


def ingest(raw: dict[str, DataFrame], path: str, current: Graph | None = None, members: DataFrame | None = None, lists: DataFrame | None = None, compose: bool = False) -> Graph:
    """raw: rows by source, each with a column ``seq`` that orders records of one key. Tables are written below ``path``.

    Any subset of the sources may be there; tables that no source touches stay as they were.
    """
    known = current or Graph()
    spark = next(iter(raw.values())).sparkSession

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")  # keys are hexadecimal: half their length
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    found = {name: kept(f"records/{name}", df) for name, df in records(raw, members, lists, compose).items()}
    nodes, edges = dict(known.nodes), dict(known.edges)
    for name, sources in ROWS.items():
        key, about = ENTITY_KEYS[name], [(r, columns) for r, columns in sources if r in found]
        facts = [found[r].select(F.col(c).alias(key)) for r, c in NAMED.get(name, []) if r in found]
        if not about and not facts:
            continue
        out = nodes.get(name)
        for r, columns in about:
            batch, how = found[r].select(key, "seq", *[F.col(c).alias(n) for n, c in columns.items()]), {"defaults": DEFAULTS.get(name), "finish": keyed}
            out = first_rows(TABLES[name], batch, key, "seq", **how) if out is None else upsert(out, batch, key, "seq", **how)
        out = spark.createDataFrame([], TABLES[name]) if out is None else out
        stubs = None
        for f in facts:
            stubs = f if stubs is None else stubs.unionByName(f)
        if stubs is not None:
            stubs = keyed(stubs.where(F.col(key).isNotNull()).distinct())
            known_keys = kept(f"attributed/{name}", out)
            out = known_keys.unionByName(stub_rows(stubs, key, known_keys))
        nodes[name] = kept(f"nodes/{name}", out)
    for name, (r, src, dst, properties) in LINKS.items():
        if r in found:
            source, target, _ = EDGES[name]
            batch = found[r].select(src, dst, *properties, "seq").where(F.col(src).isNotNull() & F.col(dst).isNotNull())
            old = edges.get(name)
            if old is not None:
                ends = lambda t, c: nodes[t].select(F.col(ENTITY_KEYS[t]).alias(c))
                old = with_endpoints(old, src, ends(source, src), dst, ends(target, dst))
            edges[name] = kept(f"edges/{name}", merge_edges(old, batch, src, dst, "seq", finish=keyed))
    return Graph(nodes, edges)
