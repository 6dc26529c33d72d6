import pytest
from pyspark.sql import functions as F

from verisift.operators import extract, resolve
from verisift.plans import demo

REF = "2023-06-01"

GOLD = [
    ("he", "דוד לוי הצביע בעד חוק התקציב ב2021.", "vote_cast", {"speaker_person_id": "דוד לוי", "vote_value": "for", "bill_id": "התקציב", "time_phrase": "2021"}),
    ("he", "רות כהן התנגדה נגד הצעת חוק הגיוס בכנסת ה-24", "vote_cast", {"speaker_person_id": "רות כהן", "vote_value": "against"}),
    ("he", "משה לוי יזם את הצעת חוק החשמל", "bill_sponsorship", {"speaker_person_id": "משה לוי", "bill_id": "החשמל"}),
    ("he", "יעל בר כיהן כשר החינוך", "office_held", {"speaker_person_id": "יעל בר", "office_id": "שר החינוך"}),
    ("he", "אבי גיל השתתף בישיבת ועדת הכספים ב2020", None, {}),
    ("he", "אבי גיל השתתף בועדת הכספים ב2020", "committee_attendance", {"committee_id": "הכספים", "time_phrase": "2020"}),
    ("he", "מפלגת השמש זכתה 12 מנדטים", "election_result", {"party_id": "מפלגת השמש", "expected_seats": "12"}),
    ("he", "מפלגת הירח לא עברה את אחוז החסימה", "election_result", {"party_id": "מפלגת הירח", "expect_passed_threshold": "false"}),
    ("he", "על פי החלטת ממשלה מספר 2084 של הממשלה ה-37.", "government_decision", {"government_decision_id": "2084", "government_number": "37"}),
    ("he", "ראו בהחלטה מספר 55/3!", "government_decision", {"government_decision_id": "55/3"}),
    ("en", "Ann Lee voted for the clean air bill in 2020.", "vote_cast", {"speaker_person_id": "Ann Lee", "vote_value": "for", "bill_id": "clean air", "time_phrase": "2020"}),
    ("en", "ann lee VOTED in favour of the road bill", "vote_cast", {"vote_value": "for", "bill_id": "road", "speaker_person_id": "ann lee"}),
    ("en", "Bob Ray co-sponsored the water bill in the 18th Knesset!", "bill_sponsorship", {"bill_id": "water", "time_phrase": "the 18th Knesset"}),
    ("en", "Bob Ray served as Minister of Health in 2019", "office_held", {"office_id": "Minister of Health", "time_phrase": "2019"}),
    ("en", "Bob Ray sat on the Finance Committee", "committee_membership", {"committee_id": "Finance"}),
    ("en", "Bob Ray attended a session of the Finance committee in 2019", "committee_attendance", {"committee_id": "Finance", "time_phrase": "2019"}),
    ("en", "The Sun Party won 12 seats in 2022", "election_result", {"party_id": "The Sun Party", "expected_seats": "12"}),
    ("en", "The Moon Party did not pass the electoral threshold", "election_result", {"expect_passed_threshold": "false"}),
    ("en", "As government decision number 12/4 says, and cabinet resolution 99.", "government_decision", {"government_decision_id": "12/4"}),
    ("en", "Nothing to see here.", None, {}), ("en", "", None, {}), ("en", None, None, {}), ("de", "Ann Lee voted for the clean air bill", None, {}),
]


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(f"s{i}", t, lang) for i, (lang, t, _, _) in enumerate(GOLD)]
    c, s = extract.extract(spark.createDataFrame(rows, "statement_id string, text string, language string"), F.to_date(F.lit(REF)))
    return {k: [r for r in c.collect() if r.statement_id == k] for k, _, _ in rows}, {r.statement_id: r for r in s.collect()}, c


def test_gold(claims):
    by, summary, _ = claims
    for i, (_, text, kind, slots) in enumerate(GOLD):
        got = sorted(by[f"s{i}"], key=lambda r: r.span_start)
        if kind is None:
            assert got == [], text
            continue
        assert got and got[0].claim_type == kind, text
        for k, v in slots.items():
            assert got[0][k] == v, (text, k, got[0][k])
        assert text[got[0].span_start : got[0].span_end].strip() == got[0].normalized_text
    assert len(by["s18"]) == 2 and len({r.claim_id for v in by.values() for r in v}) == sum(map(len, by.values()))
    assert len(summary) == len(GOLD) and summary["s19"].n_claims == 0


def test_overlaps(spark):
    m = lambda *x: {"rule": x[0], "start": x[1], "end": x[2], "parts": []}
    d = spark.createDataFrame([([m(3, 0, 10), m(1, 5, 20), m(2, 20, 25), m(0, 0, 10), m(4, 24, 26)],), ([],)], f"m {extract.MATCH}")
    got = [[(x.rule, x.start) for x in r.x] for r in d.select(extract.without_overlaps(F.col("m")).alias("x")).collect()]
    assert got == [[(1, 5), (2, 20)], []]


def test_missing_vote_word_is_reported(spark):
    c, s = extract.extract(spark.createDataFrame([("a", "דוד לוי הצביע חוק התקציב", "he")], "statement_id string, text string, language string"), F.to_date(F.lit(REF)))
    assert c.count() == 0 and s.first().errors == ["required slot vote_value is empty for vote_cast"] and s.first().rule_matches == 1


def test_fallback_answers(spark):
    from verisift.functions.keys import statement_key

    st = spark.createDataFrame([("a", "He was there", "en"), ("b", "Ann Lee voted for the clean air bill", "en")], "statement_id string, text string, language string")
    cols = ["answer_seq", "claim_type", *extract.SLOTS, "government_number", "normalized_text", "time_phrase"]
    rows = [(0, "office_held", "Ann", None, None, None, "Mayor", None, None, None, None, None, None, None, "2020"), (1, "office_held", None, None, None, None, "Mayor", None, None, None, None, None, None, None, None)]
    a = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'answer_seq' else 'string'}" for c in cols))
    a = st.select("language", statement_key(F.col("language"), F.trim("text")).alias("text_key")).join(a)
    c, s = extract.extract(st, F.to_date(F.lit(REF)), a)
    got = {(r.statement_id, r.method): r for r in c.collect()}
    assert set(got) == {("a", "llm"), ("b", "rules")} and got["a", "llm"].normalized_text == "He was there"
    s = {r.statement_id: r for r in s.collect()}
    assert s["a"].fallback_used and s["a"].errors == ["answer rejected by slot check"] and not s["b"].fallback_used


def test_checkability_and_declarations(claims, spark):
    _, _, c = claims
    c = resolve.resolve_claims(c, None, None)
    c = c.withColumn("checkability", extract.claim_checkability(c))
    by = {r.statement_id: r.checkability for r in c.collect()}
    assert by["s0"] == "checkable" and by["s11"] == "insufficient_time_scope" and by["s13"] == "checkable"
    u = spark.createDataFrame([("s0", GOLD[0][1], None), ("s11", GOLD[11][1], None), ("s19", "said in 2011", None)], "declaration_id string, text string, uttered_at timestamp")
    d = {r.declaration_id: r for r in extract.declarations(u, c).collect()}
    assert (d["s0"].claim_family, d["s0"].checkability, len(d["s0"].derived_atomic_claim_ids)) == ("formal_action", "checkable_formal_action", 1)
    assert (d["s11"].checkability, d["s19"].claim_family, d["s19"].checkability, str(d["s19"].utterance_time)) == ("insufficient_time_scope", "unknown", "not_checkable", "2011-01-01 00:00:00")


def test_unresolved_slot(spark, claims):
    _, _, c = claims
    bad = c.where("statement_id = 's0'").withColumn("slot_statuses", F.create_map(F.lit("bill_id"), F.lit("ambiguous")))
    assert bad.select(extract.claim_checkability(bad).alias("x")).first().x == "insufficient_entity_resolution"
    d = spark.createDataFrame([("a", x) for x in ("insufficient_time_scope", "non_checkable")] + [("b", "non_checkable")], "k string, checkability string")
    assert {r.k: r.x for r in d.groupBy("k").agg(extract.declaration_checkability().alias("x")).collect()} == {"a": "partially_checkable", "b": "not_checkable"}


def test_valid_means_without_violations(spark):
    rows = [(t, *[(None, "", "x")[(i * 7 + j * (i // 3 + 1)) % 3] for j in range(len(extract.SLOTS))]) for i in range(60) for t in [*extract.SLOT_TEMPLATES, "other", None]]
    rows += [(t, *["x" if s in required else None for s in extract.SLOTS]) for t, (required, _) in extract.SLOT_TEMPLATES.items()]
    d = spark.createDataFrame(rows, "claim_type string, " + ", ".join(f"{s} string" for s in extract.SLOTS))
    slots = {s: F.col(s) for s in extract.SLOTS}
    got = d.select(extract.is_valid(F.col("claim_type"), slots).alias("a"), (F.size(extract.violations(F.col("claim_type"), slots)) == 0).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {True, False}


def test_sentences_are_dealt_by_rows(spark, tmp_path):
    """A task of the matching has a bounded number of sentences, however few bytes they are; offline resolution moves no rows."""
    for n in ("lineitem", "supplier", "part"):
        spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet").write.parquet(str(tmp_path / f"{n}.parquet"))
    demo_each, demo.SENTENCES_EACH = demo.SENTENCES_EACH, 1_000
    try:
        s = demo.Tables(spark, str(tmp_path)).sentences()
        assert s.rdd.getNumPartitions() == 60 and max(s.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 1_300
        c, _ = extract.extract(s, F.lit("2024-06-01").cast("date"))
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        assert plan(resolve.resolve_claims(c, None, None)).count("Exchange") == plan(c).count("Exchange")
    finally:
        demo.SENTENCES_EACH = demo_each
