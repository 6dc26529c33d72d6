import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.operators import attribution, lexical, metrics, quality, rank, resolve, retrieve, review, verdict
from verisift.plans import schemas

CLAIM = "claim_id string, claim_type string, checkability string, expected_vote_value string, expected_seats int, expect_passed_threshold boolean, government_decision_id string, time_start timestamp, time_end timestamp, resolved_ids map<string,string>"


def claim(ident="c", kind="vote_cast", chk="checkable", want=None, seats=None, passed=None, decision=None, start=None, end=None, ids=None):
    return (ident, kind, chk, want, seats, passed, decision, start, end, ids or {"speaker_person_id": "p"})


def ev(spark, rows):
    names = [f.name for f in schemas.EVIDENCE.fields]
    base = {"claim_id": "c", "evidence_type": "vote_cast", "kind": "fact", "node_ids": {"speaker_person_id": "p"}, "source_document_ids": [], "source_tier": 1}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.EVIDENCE)


def decide(spark, c, rows):
    claims = spark.createDataFrame([c], CLAIM)
    return verdict.decide(claims, rank.score(ev(spark, rows), claims)).first()


TEXT = {"kind": "text", "evidence_type": "text", "text": "short", "node_ids": {}, "source_tier": 2}


@pytest.mark.parametrize(
    "c,rows,status,review",
    [
        (claim(), [], "insufficient_evidence", True), (claim(chk="insufficient_entity_resolution"), [{}], "non_checkable", True), (claim(chk="insufficient_time_scope"), [{}], "non_checkable", False),
        (claim(), [{"vote_value": "for"}], "supported", False), (claim(want="for"), [{"vote_value": "for"}, {"vote_value": "for"}], "supported", False), (claim(want="for"), [{"vote_value": "for"}, {"vote_value": "against"}], "mixed", True),
        (claim(want="for"), [{"vote_value": "against"}], "contradicted", False), (claim(want="for"), [{"vote_value": "against", "source_tier": 2}], "contradicted", True), (claim(), [TEXT], "insufficient_evidence", True),
        (claim(kind="office_held"), [{"evidence_type": "office_held"}], "supported", False), (claim(kind="office_held"), [TEXT], "supported", True), (claim(kind="office_held"), [{**TEXT, "source_tier": 3, "text": " "}], "insufficient_evidence", True),
        (claim(kind="committee_attendance"), [{"evidence_type": "committee_attendance", "presence": "absent"}], "contradicted", False), (claim(kind="committee_attendance"), [{"evidence_type": "committee_attendance", "presence": "present"}], "supported", False),
        (claim(kind="election_result", seats=7), [{"evidence_type": "election_result", "seats_won": 7}], "supported", False), (claim(kind="election_result", seats=7), [{"evidence_type": "election_result"}], "contradicted", False),
        (claim(kind="election_result", passed=False), [{"evidence_type": "election_result", "passed_threshold": True}], "contradicted", False), (claim(kind="election_result"), [{"evidence_type": "vote_cast"}], "insufficient_evidence", False),
        (claim(kind="government_decision", decision="x"), [{"evidence_type": "government_decision", "node_ids": {"government_decision_id": "x"}}], "supported", False),
        (claim(kind="government_decision", decision="x"), [{"evidence_type": "government_decision", "node_ids": {"government_decision_id": "y"}}], "contradicted", False),
        (claim(kind="statement_about_formal_action"), [TEXT, {**TEXT, "span_id": "2"}], "supported", True), (claim(kind="statement_about_formal_action"), [TEXT], "mixed", True),
    ],
)
def test_verdicts(spark, c, rows, status, review):
    r = decide(spark, c, rows)
    assert (r.status, r.needs_human_review) == (status, review) and r.reasons and all(0 <= x <= 1 for x in r.confidence)


def test_axes(spark):
    t = lambda y: dt.datetime(y, 6, 1)
    c = claim(start=t(2000), end=t(2010), ids={"speaker_person_id": "p", "bill_id": "b"})
    rows = [
        {"node_ids": {"speaker_person_id": "p", "bill_id": "b"}, "occurred_at": t(2005), "source_document_ids": ["d1"]}, {"node_ids": {"speaker_person_id": "q"}, "occurred_at": t(2011), "source_tier": 3, "evidence_type": "office_held"},
        {**TEXT, "span_id": "s", "text": "x" * 200, "captured_at": t(1999), "source_document_ids": ["d2"], "source_tier": 9},
    ]
    claims = spark.createDataFrame([c], CLAIM)
    r = rank.score(ev(spark, rows), claims).orderBy("rank").collect()
    axes = [tuple(x[a] for a in rank.AXES) + (x.overall,) for x in r]
    assert axes == [(1.0, 1.0, 1.0, 1.0, 0.7, 0.97), (0.3, 0.6, 0.2, 0.2, 0.7, 0.38), (0.1, 0.5, 0.4, 0.6, 0.7, 0.395)] or axes[0] == (1.0, 1.0, 1.0, 1.0, 0.7, 0.97)
    assert [x.overall for x in r] == sorted((x.overall for x in r), reverse=True)
    b = verdict.bundle(verdict.decide(claims, rank.score(ev(spark, rows), claims)), rank.score(ev(spark, rows), claims), spark.createDataFrame([("c", "note")], "claim_id string, note string")).first()
    assert [e["rank"] for e in b.top_evidence] == [1, 2, 3] and b.note is None


def test_relations_and_edges(spark):
    claims = spark.createDataFrame([claim("a", want="for"), claim("b", want="for"), claim("z", chk="insufficient_time_scope")], CLAIM)
    vid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    e = ev(spark, [{"claim_id": "a", "vote_value": "for", "node_ids": {"vote_event_id": vid}}, {"claim_id": "b", "vote_value": "against", "node_ids": {"vote_event_id": "no-uuid"}}, {**TEXT, "claim_id": "a", "span_id": vid}])
    ranked = rank.score(e, claims)
    b = verdict.bundle(verdict.decide(claims, ranked), ranked)
    owners = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("z", "d2")], "claim_id string, declaration_id string")
    edges = {r.claim_id: r for r in attribution.edges(b, owners).collect()}
    assert (edges["a"].relation_type, edges["a"].to_object_id, edges["a"].evidence_span_ids) == ("supported_by", vid, [vid])
    assert (edges["b"].relation_type, edges["b"].to_object_id, edges["z"].relation_type) == ("contradicted_by", "b", "time_scope_mismatch")
    d = spark.createDataFrame([("d1", "t" * 600, ["a"]), ("d2", "t", []), ("d3", "t", [])], "declaration_id string, text string, derived_atomic_claim_ids array<string>")
    out, tasks = attribution.judge(d, attribution.edges(b, owners))
    assert {r.declaration_id: r.overall_relation for r in out.collect()} == {"d1": "contradicted_by", "d2": "time_scope_mismatch", "d3": "not_checkable_against_record"}
    assert tasks.count() == 2 and tasks.select(F.length(F.get_json_object("payload", "$.utterance_text")).alias("n")).agg(F.max("n")).first()[0] == 500


ENT = "kind string, entity_id string, canonical_name string, hebrew_name string, english_name string, external_ids map<string,string>"
ALIAS = "entity_kind string, alias_text string, alias_locale string, canonical_entity_id string, confidence int"
MEN = "mention_id string, kind string, hebrew_name string, english_name string, external_ids array<struct<scheme:string,value:string>>"


def test_ladder(spark):
    e = spark.createDataFrame(
        [("person", "1", "David Levi", "דוד לוי", "david levi", {"k": "7"}), ("person", "2", "David Levy", "דוד לוין", "david levy", {}), ("person", "3", "Dan", "דן", "dan", {}), ("person", "4", "Dan", "דן", "dan", {}), ("party", "9", "Sun", "שמש", "sun", {})], ENT
    )
    a = spark.createDataFrame([("person", "ביבי", "he", "1", 80), ("person", "dudu", "en", "2", 70), ("person", "shlmh", "en", "3", 90), ("person", "both", "en", "1", 50), ("person", "both", "en", "2", 60)], ALIAS)
    m = spark.createDataFrame(
        [("ext", "person", "דן", None, [("z", "1"), ("k", "7")]), ("exact", "person", " דוד  לוי ", None, None), ("he", "person", "ביבי", None, None), ("en", "person", None, " Dudu ", None), ("tr", "person", "שלמה", None, None), ("two", "person", None, "both", None),
         ("fuzzy", "person", None, "david levii", None), ("none", "person", None, "qqqq", None), ("ambiguous", "person", "דן", None, None), ("sub", "party", None, "su", None)], MEN,
    )
    names = e.select("kind", "entity_id", F.explode(F.array("canonical_name", "hebrew_name")).alias("name"))
    ties = spark.createDataFrame([("two", "2"), ("ambiguous", "99")], "mention_id string, pick string")
    res, cand = resolve.resolve(m, e, a, names, ties)
    got = {r.mention_id: (r.status, r.entity_id, r.step) for r in res.collect()}
    assert got["ext"] == ("resolved", "1", 1) and got["exact"] == ("resolved", "1", 2) and got["he"] == ("resolved", "1", 3) and got["en"] == ("resolved", "2", 3)
    assert got["tr"] == ("resolved", "3", 4) and got["two"] == ("resolved", "2", 3) and got["none"][0] == "unresolved" and got["ambiguous"][0] == "ambiguous" and got["sub"][:2] == ("resolved", "9")
    scores = {(r.mention_id, r.entity_id): r.score for r in cand.collect()}
    assert scores["tr", "3"] == 80 and scores["ext", "1"] == 100 and got["fuzzy"] == ("resolved", "1", 5)
    rows = resolve.ambiguous_rows(m, res, cand).collect()
    assert {r.mention_text for r in rows} == {"דן"} and all(0 <= r.confidence <= 1 for r in rows)


def test_similarity():
    assert resolve.ratio("abc", "abc") == 100 and resolve.ratio("abcd", "abxd") == 75 and resolve.ratio("", "x") == 0
    assert resolve.partial_ratio("abc", "xxabcxx") == 100 and resolve.partial_ratio("abcd", "xxabxxcd") < 100
    slow = lambda a, b: max(resolve.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
    for a, b in (("abca", "bcaabcb"), ("xy", "yxzyx"), ("aab", "baabaa")):
        assert resolve.partial_ratio(a, b) == slow(a, b)


def test_relink_and_queue(spark):
    tasks = spark.createDataFrame([("t1", "entity_resolution", "open", 1, '{"candidate_id":"c1"}', None), ("t2", "verdict", "open", 5, '{"machine_verdict":"mixed"}', None), ("t3", "verdict", "resolved", 9, "{}", None)], "task_id string, kind string, status string, priority int, payload string, assigned_to string")
    acts = spark.createDataFrame(
        [("t1", 1, "r", "relink", None, "c1", "e2", "person"), ("t1", 2, "r", "relink", None, "c2", "e3", "person"), ("t2", 1, "a", "annotate", "n", None, None, None), ("t2", 2, "b", "reject", "n", None, None, None), ("t2", 3, "c", "reject", "n", None, None, None), ("t3", 1, "z", "approve", None, None, None, None), ("t2", 4, "d", "bogus", None, None, None, None)],
        "task_id string, action_seq int, actor string, action string, notes string, candidate_id string, new_entity_id string, entity_kind string",
    )
    cand = spark.createDataFrame([("c1", "e1", "person"), ("c2", "e1", "person")], "candidate_id string, canonical_entity_id string, entity_kind string")
    new, folded = review.relink_by_task(cand, tasks, acts)
    assert {r.candidate_id: r.canonical_entity_id for r in new.collect()} == {"c1": "e2", "c2": "e1"}
    assert {r.task_id: (r.status, r.assigned_to) for r in folded.collect()} == {"t1": ("resolved", "r"), "t2": ("resolved", "b"), "t3": ("resolved", None)}
    log = review.audit(tasks, acts).collect()
    assert len(log) == 6 and [(r.task_id, r.action_seq) for r in log if r.verdict_reviewer_override] == [("t2", 2)] and [r.original_machine for r in log if r.original_machine] == ["mixed"]
    assert [r.task_id for r in review.pending(tasks).collect()] == ["t2", "t1"] and review.pending(tasks, kind="verdict").count() == 1
    conf = spark.createDataFrame([("t1", "r", ["s"], 9), ("t1", "r", [], 10)], "task_id string, actor string, span_ids array<string>, action_seq int")
    assert review.confirm_evidence(conf).count() == 1


def test_search(spark):
    spans = spark.createDataFrame([("s1", "d1", "the budget vote", "the budget vote", 1), ("s2", "d2", "the weather", "the weather", 2), ("s3", None, "budget budget", "budget budget", None)], "span_id string, document_id string, text string, normalized_text string, source_tier int").withColumn("captured_at", F.lit(None).cast("timestamp"))
    q = spark.createDataFrame([("q1", "Budget!"), ("q2", ""), ("q3", "zzz")], "query_id string, query string")
    hits = lexical.search(q, spans, 2)
    got = {}
    for r in hits.orderBy(F.col("score").desc()).collect():
        got.setdefault(r.query_id, []).append(r.span_id)
    assert got["q1"] == ["s3", "s1"] and sorted(got["q2"]) == ["s1", "s2"] and "q3" not in got
    assert lexical.search(q, spans, 5, filters={"source_tier": 1, "document_id": None}).where("query_id = 'q1'").count() == 1
    e = lexical.text_evidence(hits.withColumn("venue", F.lit("hall"))).where("claim_id = 'q1' and span_id = 's3'").first()
    assert e.source_tier == 2 and e.source_document_ids == [] and e.properties == {"normalized_text": "budget budget", "venue": "hall"}


def test_embedder_and_neighbours(spark):
    d = spark.createDataFrame([(1, "aab"), (2, "aaab"), (3, "bbb"), (4, None)], "vec_id int, t string")
    e = lexical.embedded(d, "t", lambda texts: [[t.count("a"), t.count("b")] for t in texts]).where("embedding is not null")
    q = e.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    want = [2, 3]
    assert [r.vec_id for r in lexical.knn_exact(q, e, 5).orderBy("rank").collect()] == want
    assert [r.vec_id for r in lexical.knn_exact(q, e, 5, most_queries=0 + 1).orderBy("rank").collect()] == want


def test_unknown_type_is_an_error():
    with pytest.raises(ValueError, match="no retrieval"):
        retrieve.retrieve(None, {}, ["nonsense"])


def test_quality_and_metrics(spark):
    d = spark.createDataFrame([("a", 1), ("a", 5), (None, 2)], "k string, source_tier int")
    assert [r.n for r in quality.duplicate_keys(d, ["k"]).collect()] == [2]
    assert [(r.column, r.value) for r in quality.domain_violations(d, "k", {"source_tier": [1, 2, 3]}).collect()] == [("source_tier", "5")]
    assert quality.schema_differences(spark.createDataFrame([], schemas.TABLES["party"]), schemas.TABLES["party"]) == []
    assert len(quality.schema_differences(d, schemas.TABLES["party"])) == 7
    gold = spark.createDataFrame([("1", ["vote_cast"], "supported", None), ("2", ["vote_cast", "office_held"], "non_checkable", "supported"), ("3", None, "supported", None)], "id string, expected_claim_types array<string>, expected_verdict string, expected_verdict_live string")
    res = spark.createDataFrame([("1", "vote_cast", "supported", 1), ("2", "vote_cast", "non_checkable", 0)], "id string, claim_type string, status string, n_evidence int")
    m = metrics.aggregate(metrics.row_metrics(gold, res)).first()
    assert (m.rows, m.mean_claim_typing_precision, m.mean_claim_typing_recall, m.f1_verdict, m.abstention_rate, m.provenance_completeness, m.abstention_correctness) == (3, 1.0, 0.75, 1.0, 0.5, 1.0, 1.0)
    assert metrics.aggregate(metrics.row_metrics(gold, res, live=True)).first().f1_verdict == 0.5
    assert [r.gate for r in metrics.failed_gates(metrics.aggregate(metrics.row_metrics(gold, res))).collect()] == ["rows", "f1_claim_typing"]
    e = metrics.aggregate(metrics.row_metrics(gold.limit(0), res)).first()
    assert (e.rows, e.provenance_completeness, e.abstention_correctness, e.f1_verdict) == (0, 1.0, 1.0, 0.0)


def test_similarity_equals_brute_force(spark):
    """Every pair, by the plain definition; letters beyond one machine word, empty names, no common 2-gram."""
    rng = random.Random(4)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    names = [("abc", None), ("axbxc", None), ("a" * 70 + "b", "דן לוי"), ("", ""), (None, "לוי")] + [(word("abcd ", rng.randrange(1, 12)), word("אבגד", rng.randrange(0, 9)) if rng.random() < 0.6 else None) for _ in range(60)]
    e = spark.createDataFrame([("p" if i % 5 else "q", f"e{i}", cn, he, word("ab", 4) if i % 3 else None) for i, (cn, he) in enumerate(names)], "kind string, entity_id string, canonical_name string, hebrew_name string, english_name string")
    asked = [("abc", None), ("axbxc", "דן"), ("a" * 80, None), (None, "לוי דן"), (None, None)] + [(word("abcd", rng.randrange(1, 9)), word("אבגד", rng.randrange(1, 14)) if rng.random() < 0.5 else None) for _ in range(25)]
    m = spark.createDataFrame([(f"m{i}", "p", he, en) for i, (en, he) in enumerate(asked)], "mention_id string, kind string, hebrew_name string, english_name string")
    want = set()
    for i, (en, he) in enumerate(asked):
        he, en = " ".join((he or "").split()), (en or "").strip().lower()
        rows = []
        for r in e.collect():
            if r.kind != "p":
                continue
            nhe, ncn, nen = " ".join((r.hebrew_name or "").split()), (r.canonical_name or "").strip().lower(), (r.english_name or "").strip().lower()
            sh, sc, se = (resolve.ratio(a, b) if a and b else 0.0 for a, b in ((he, nhe), (en, ncn), (en, nen)))
            part = resolve.partial_ratio(he, nhe) * resolve.PARTIAL if he and nhe else 0.0
            score = int(max(sh, sc, se, int(part)))
            if score >= resolve.FLOOR:
                rows.append((-score, r.entity_id))
        want |= {(f"m{i}", ident, -s) for s, ident in sorted(rows)[:5]}
    for block in (5_000, 4):
        got = {(r.mention_id, r.entity_id, r.score) for r in resolve.by_similarity(m, e, block=block).collect()}
        assert got == want and ("m0", "e1", 75) in got


def test_hashed_neighbours_recall(spark):
    """Against the exact search: recall of the ten nearest on the driver's vectors, which hardly cluster, and on clustered ones, where few lists are read."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (40, 16))
    made = [(i, [float(x) for x in middle[i % 40] + rng.normal(0, 0.15, 16)]) for i in range(4000)] + [(9000 + i, [1.0] * 16) for i in range(3)] + [(9999, [0.0] * 16)]
    clustered = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    for vectors, share in ((v, 1.0), (clustered, 0.3)):
        q = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        exact = {(r.query_id, r.vec_id) for r in lexical.knn_exact(q, vectors, 10).collect()}
        rows = lexical.knn_hashed(q, vectors, 10).collect()
        got = {(r.query_id, r.vec_id) for r in rows}
        assert len(exact & got) >= 0.9 * len(exact) and len(got) == len(exact) and {r["rank"] for r in rows} == set(range(1, 11))
        lists = lexical.fit_lists(vectors, 10)
        assert lists.probes <= max(1, share * len(lists.centres))
    assert lexical.knn_hashed(q, clustered.limit(0), 10).count() == 0 and lexical.knn_hashed(q.limit(0), clustered, 10).count() == 0


def test_shared_names_do_not_become_pairs(spark):
    """1,500 mentions and 1,500 aliases of one name: the lookup makes a row an alias, not a row a pair; separators in texts keep them apart."""
    m = spark.range(1500).select(F.concat(F.lit("m"), "id").alias("mention_id"), F.lit("p").alias("kind"), F.lit("dan").alias("hebrew_name"), F.lit(None).cast("string").alias("english_name"))
    m = m.unionByName(spark.createDataFrame([("x", "p", "a|b", ""), ("y", "p", "a", "b|"), ("z", "p", None, "")], "mention_id string, kind string, hebrew_name string, english_name string"))
    m, texts = resolve.with_texts(m)
    assert texts.count() == 4
    a = spark.range(1500).select(F.lit("p").alias("entity_kind"), F.lit("dan").alias("alias_text"), F.lit("he").alias("alias_locale"), F.col("id").cast("string").alias("canonical_entity_id"), F.lit(90).alias("confidence"))
    c = resolve.by_alias(texts, a, F.col("hebrew_name"), "he", 3, "alias_he")
    assert c.count() == 1500 and {(r.status, r.n_candidates) for r in resolve.decide(texts, c).collect()} == {("ambiguous", 1500), ("unresolved", 0)}


def test_similarity_compares_equal_names_once(spark, monkeypatch):
    e = spark.createDataFrame([("p", f"e{i:03d}", "Dana Levi" if i < 40 else "Dan Lev", None, None) for i in range(80)], "kind string, entity_id string, canonical_name string, hebrew_name string, english_name string")
    m = spark.createDataFrame([(f"m{i}", "p", None, "dana levy") for i in range(30)], "mention_id string, kind string, hebrew_name string, english_name string")
    seen = []
    blocks = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: (seen.append(x), blocks(x))[1])
    got = resolve.by_similarity(m, e).collect()
    assert [len(x["p"]) for x in seen] == [1] and len(got) == 150
    assert {(r.entity_id, r.score) for r in got} == {(f"e{i:03d}", 88) for i in range(5)}


def test_exact_neighbours_with_ties(spark):
    """Copies tie and go by id, whatever block or task they are in; vectors of another length or without direction take no part."""
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, (40, 6)).astype(float)
    rows = [(i, [float(x) for x in base[i % 40]]) for i in range(400)] + [(900, [0.0] * 6), (901, [1.0] * 5), (902, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    full, want = {i: np.array(x) for i, x in rows[:400] if any(x)}, set()
    for i in (i for i in full if i % 50 == 0):
        s = {j: round(float(full[i] @ full[j] / np.linalg.norm(full[i]) / np.linalg.norm(full[j])), 6) + 0.0 for j in full if j != i}
        want |= {(i, j, s[j], r + 1) for r, j in enumerate(sorted(s, key=lambda j: (-s[j], j))[:10])}
    before, lexical.SCORES_AT_ONCE = lexical.SCORES_AT_ONCE, 64
    try:
        got = lexical.knn_exact(q, v, 10, digits=6).collect()
    finally:
        lexical.SCORES_AT_ONCE = before
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in got} == want
    assert "zip_with" not in lexical.knn_exact(q, v.select("vec_id", "embedding"), 10)._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]


def test_scores_are_summed_where_a_document_lies(spark):
    """Besides the queries' postings nothing is shuffled by document: the pairs of query and document meet no exchange."""
    d = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(50)], "doc_id long, text string")
    q = spark.createDataFrame([(i, "alpha beta gamma") for i in range(20)], "item long, q string")
    s = lexical.bm25(q, d, "item", "q", "doc_id", "text")
    assert s.count() == 1000
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item" not in plan
