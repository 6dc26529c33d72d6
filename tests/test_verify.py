"""The whole check on a small knowledge base: checkable claims meet their facts, all others stay where they lie."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verisift import queries_records
from verisift.operators import extract, rank, resolve, retrieve, verdict
from verisift.plans import verify
from verisift.streaming import jobs

SAID = [
    ("s1", "Ann Lee voted for the clean air bill in 2020."), ("s2", "Ann Lee voted against the clean air bill in 2020."), ("s3", "Ann Lee sponsored the clean air bill."), ("s4", "Bob Ray voted for the clean air bill in 2020."),
    ("s5", "Ann Lee voted for the clean air bill."), ("s6", "Ann Lee voted for the new roads bill in 2020."), ("s7", "Nothing of that kind."),
]
#: statement -> checkability, status, evidence, top evidence
WANT = {
    "s1": ("checkable", "supported", 1, 1), "s2": ("checkable", "contradicted", 1, 1), "s3": ("checkable", "supported", 1, 1), "s4": ("insufficient_entity_resolution", "non_checkable", 0, 0),
    "s5": ("insufficient_time_scope", "non_checkable", 0, 0), "s6": ("checkable", "insufficient_evidence", 0, 0),
}


def day():
    return F.to_date(F.lit("2023-06-01"))


def statements(spark, *ids):
    return spark.createDataFrame([(*r, "en") for r in SAID if not ids or r[0] in ids], "statement_id string, text string, language string")


def kb(spark):
    at = dt.datetime(2020, 5, 1)
    facts = {
        "cast_vote": spark.createDataFrame([("p1", "e1", "for"), ("p2", "e1", "against")], "person_id string, vote_event_id string, value string"), "vote_event": spark.createDataFrame([("e1", "b1", at)], "vote_event_id string, bill_id string, occurred_at timestamp"),
        "bill": spark.createDataFrame([("b1", "clean air", 23), ("b2", "new roads", 23)], "bill_id string, title string, knesset_number int"), "sponsored": spark.createDataFrame([("p1", "b1", at)], "person_id string, bill_id string, sponsored_at timestamp"),
    }
    named = [("person", "p1", "ann lee"), ("person", "p2", "bob ray"), ("person", "p3", "bob ray"), ("bill", "b1", "clean air"), ("bill", "b2", "new roads")]
    entities = spark.createDataFrame([(k, i, n, None, n, {}) for k, i, n in named], "kind string, entity_id string, canonical_name string, hebrew_name string, english_name string, external_ids map<string,string>")
    aliases = spark.createDataFrame([(k, n, "en", i, 100) for k, i, n in named], "entity_kind string, alias_text string, alias_locale string, canonical_entity_id string, confidence int")
    return verify.KnowledgeBase(facts, entities, aliases, fuzzy=False)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("few", [resolve.FEW_TEXTS, 0])
def test_check(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "FEW_TEXTS", few)
    out = verify.verify(statements(spark), kb(spark), day())
    assert {r.statement_id: (r.checkability, r.status, r.n_evidence, len(r.top_evidence)) for r in out.collect()} == WANT


def test_closed_claims_stay(spark):
    """Without a checkable claim nothing is shuffled: no claim, and none of the facts."""
    out = verify.verify(statements(spark, "s4", "s5", "s7"), kb(spark), day())
    assert exchanges(out) == 0 and {r.statement_id: r.status for r in out.collect()} == {"s4": "non_checkable", "s5": "non_checkable"}
    assert exchanges(verify.verify(statements(spark), kb(spark), day())) > 0


def test_written_claims_are_lean(spark):
    claims = verify.for_check(extract.extract(statements(spark), day())[0], kb(spark))
    assert claims.count() == 6 and not {"raw_text", "normalized_text"} & set(claims.columns)


def test_declarations_are_shuffled_once(spark):
    """Claims meet their declaration in one aggregate; besides it only the declarations are shuffled."""
    said = lambda *ids: statements(spark, *ids).withColumnRenamed("statement_id", "declaration_id").withColumn("uttered_at", F.lit(None).cast("timestamp"))
    out, edges, tasks = verify.verify_declarations(said(), kb(spark), day())
    assert {r.declaration_id: (r.claim_family, r.checkability, r.overall_relation, len(r.derived_atomic_claim_ids)) for r in out.collect()} == {
        "s1": ("formal_action", "checkable_formal_action", "supported_by", 1), "s2": ("formal_action", "checkable_formal_action", "contradicted_by", 1), "s3": ("formal_action", "checkable_formal_action", "supported_by", 1),
        "s4": ("formal_action", "insufficient_entity_resolution", "entity_ambiguous", 1), "s5": ("formal_action", "insufficient_time_scope", "time_scope_mismatch", 1), "s6": ("formal_action", "checkable_formal_action", "not_checkable_against_record", 1),
        "s7": ("unknown", "not_checkable", "not_checkable_against_record", 0),
    }
    assert {r.from_declaration_id for r in edges.collect()} == {f"s{i}" for i in range(1, 7)} and tasks.count() == 3
    closed, _, _ = verify.verify_declarations(said("s4", "s5", "s7"), kb(spark), day())
    assert exchanges(closed) == 2 and closed.count() == 3


def test_dealt_rows_are_landed_where_they_lie(spark, tmp_path):
    """A file for each task's rows, without another exchange, in as many batches as asked for."""
    rows = spark.range(600).select(F.col("id").cast("string").alias("statement_id")).repartition(6)
    seen = []

    def check(batch):
        seen.append((batch.select(F.input_file_name()).distinct().count(), batch.count()))
        return batch

    jobs.check_stream(queries_records.stream_of_dealt(rows, "in", 2), check, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert [n for n, _ in seen] == [3, 3] and sum(n for _, n in seen) == 600 and jobs.appended(spark, f"{tmp_path}/out").distinct().count() == 600


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_facts_near_the_asked_ones(spark, monkeypatch, bits):
    """Whatever its size, the filter keeps all that is asked for; with room enough it drops nearly all else."""
    monkeypatch.setattr(retrieve, "FILTER_BITS", bits)
    pair = [(F.col("id") % 97).cast("string").alias("person_id"), F.col("id").cast("string").alias("bill_id")]
    facts, claims = spark.range(20_000).select(*pair), spark.range(0, 20_000, 10).select(*pair)
    near = retrieve.near_asked(facts, claims, "person_id", "bill_id")
    assert near.join(claims, ["person_id", "bill_id"], "left_semi").count() == 2_000 and 2_000 <= near.count() < 3_500


def test_evidence_is_computed_once(spark):
    """Verdict and top evidence of a claim come from one aggregate, equal to both apart."""
    facts = [*kb(spark).facts.items()]
    claims = spark.createDataFrame(
        [("c1", "vote_cast", "checkable", "for", "p1", "b1"), ("c2", "vote_cast", "checkable", "for", "p2", "b1"), ("c3", "vote_cast", "checkable", "for", "p1", "b2"), ("c4", "vote_cast", "insufficient_time_scope", "for", "p1", "b1")],
        "claim_id string, claim_type string, checkability string, expected_vote_value string, speaker_person_id string, bill_id string",
    )
    nulls = {"time_start": "timestamp", "time_end": "timestamp", "expected_seats": "int", "expect_passed_threshold": "boolean", "government_decision_id": "string"}
    claims = claims.withColumns({k: F.lit(None).cast(v) for k, v in nulls.items()}).withColumn("resolved_ids", F.create_map(F.lit("bill_id"), F.col("bill_id")))
    ranked = rank.score(retrieve.vote_cast(claims, dict(facts)), claims)
    apart, once = verdict.bundle(verdict.decide(claims, ranked), ranked), verdict.bundles(claims, ranked)
    shown = lambda df: sorted((r.claim_id, r.status, len(r.top_evidence), [e.node_ids["vote_event_id"] for e in r.top_evidence]) for r in df.collect())
    assert shown(once) == shown(apart) == [("c1", "supported", 1, ["e1"]), ("c2", "contradicted", 1, ["e1"]), ("c3", "insufficient_evidence", 0, []), ("c4", "non_checkable", 1, ["e1"])]
    assert exchanges(once) < exchanges(apart)


def test_best_names_only(monkeypatch):
    """Of names that are all alike a task hands on the best only, equal ones in order, whatever the block of texts."""
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    cn, he = [f"supplier#{i:06d}" for i in range(300)] + [word("abc", 9) for _ in range(40)], [""] * 300 + [word("אבג", 9) for _ in range(40)]
    asked = [(i, word("אבגד", 7), word("abcd", 9)) for i in range(40)] + [(40, "", "supxlier#000123"), (41, "", "a" * 70), (42, "", "")]
    want = []
    for ident, h, e in asked:
        ratio = lambda a, b: resolve.ratio(a, b) if a and b else 0.0
        score = [int(max(ratio(h, nh), ratio(e, nc), int(resolve.partial_ratio(h, nh) * resolve.PARTIAL if h and nh else 0))) for nh, nc in zip(he, cn)]
        want += [(ident, i, score[i]) for i in sorted(range(len(cn)), key=lambda i: (-score[i], i))[:5] if score[i] >= resolve.FLOOR]
    names = [resolve.Names(x) for x in (he, cn)]
    for pairs in (1 << 15, 1):
        monkeypatch.setattr(resolve, "PAIRS_AT_ONCE", pairs)
        assert [hit[:3] for hit in resolve.best_names(asked, names[0], names[1], names[1], resolve.FLOOR, 5)] == want
    assert sum(ident == 40 for ident, *_ in want) == 5
