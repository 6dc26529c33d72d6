"""Claim extraction over a table of statements: a table of rules, matched, overlapping matches resolved, slots checked.

Everything is a Column expression over the statement's row; the only shuffle is the per-statement summary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_key, statement_key
from ..functions.text import blank_to_null, vote_value
from ..functions.timescope import bind, normalize_time_scope, utterance_time
from ..plans.schemas import SLOT_TEMPLATES, SLOTS, TIME_REQUIRED

#: Pieces of the rule patterns, readable by Java and RE2 alike. Fixed values.
HE = r"\x{0590}-\x{05FF}"
SUBJECT_HE = rf"([{HE}A-Za-z'\"\-\s]{{2,40}}?)"
SUBJECT_EN = r"([A-Z][A-Za-z'\-\s]{2,50}?)"
BILL_HE = rf"([{HE}0-9A-Za-z'\"\-\s,]{{2,120}}?)"
BILL_EN = r"([A-Za-z0-9'\"\-\s,]{3,120}?)"
COMMITTEE_HE = rf"([{HE}0-9A-Za-z'\"\-\s,]{{2,80}}?)"
COMMITTEE_EN = r"([A-Za-z0-9\-\s,]{2,80}?)"
TIME_HE = r"(?:\s+(?:ב(?:-)?(\d{4}|הקדנציה(?:\s+הקודמת)?|כנסת(?:\s+ה[-]?\d+)?)))?"
TIME_HE_SHORT = r"(?:\s+(?:ב(?:-)?(\d{4}|כנסת(?:\s+ה[-]?\d+)?)))?"
TIME_EN = r"(?:\s+in\s+(\d{4}|the\s+\d+(?:st|nd|rd|th)\s+Knesset|last\s+term))?"
END = r"[\.\?\!]?\s*\z"


@dataclass(frozen=True)
class Rule:
    claim_type: str
    language: str
    pattern: str
    groups: tuple[str, ...]
    ignore_case: bool = False
    many: bool = False  # not anchored at the end: may match several times
    below: bool = False  # says that a list did not pass the threshold
    name: str = field(default="")
    hint: str = field(default="")  # a plain test that every match passes, so that most rules cost one search

    def java(self) -> str:
        return ("(?iu)" if self.ignore_case else "") + self.pattern

    def re2(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The rules, in order of precedence for ties. Fixed values.
RULES: list[Rule] = [
    Rule("vote_cast", "he", SUBJECT_HE + r"\s+(?:הצביע(?:ה)?|תמך(?:ה)?|התנגד(?:ה)?|נמנע(?:ה)?)\s+(בעד|נגד|נמנע(?:ה)?)?\s*(?:(?:ב(?:עד)?|על|נגד|לגבי)\s+)?(?:חוק|הצעת\s+חוק)\s+" + BILL_HE + TIME_HE + END, ("subject", "vote_value", "bill", "time"), name="R1", hint=r"חוק"),
    Rule("bill_sponsorship", "he", SUBJECT_HE + r"\s+(?:יזם(?:ה)?|הגיש(?:ה)?|חתם(?:ה)?\s+על|הציע(?:ה)?)\s+(?:את\s+)?(?:הצעת\s+חוק|חוק)\s+" + BILL_HE + TIME_HE + END, ("subject", "bill", "time"), name="R2", hint=r"חוק"),
    Rule("office_held", "he", SUBJECT_HE + r"\s+(?:כיהן(?:ה)?|שימש(?:ה)?|מונה|היה|הייתה)\s+(?:כ)?" + rf"(שר(?:ת)?(?:\s+[{HE}\-\s]+)?|סגן(?:ית)?\s+שר(?:ת)?(?:\s+[{HE}\-\s]+)?|ראש\s+הממשלה|חבר(?:ת)?\s+כנסת|יו\"ר\s+[{HE}\-\s]+)" + TIME_HE + END, ("subject", "office", "time"), name="R3", hint=r"כיהן|שימש|מונה|היה|הייתה"),
    Rule("committee_membership", "he", SUBJECT_HE + r"\s+(?:היה|הייתה|כיהן(?:ה)?|חבר(?:ה)?(?:\s+ב)?)\s+(?:חבר(?:ה)?\s+)?(?:ב)?ועד(?:ת|ה)\s+" + COMMITTEE_HE + TIME_HE + END, ("subject", "committee", "time"), name="R4", hint=r"ועד"),
    Rule("committee_attendance", "he", SUBJECT_HE + r"\s+(?:נכח(?:ה)?|השתתף(?:ה)?|פקד(?:ה)?)\s+(?:בישיבת|ב)(?:ועדת|ועדה)\s+" + COMMITTEE_HE + TIME_HE + END, ("subject", "committee", "time"), name="R5", hint=r"נכח|השתתף|פקד"),
    Rule("vote_cast", "en", SUBJECT_EN + r"\s+(?:voted|cast\s+(?:a|their)\s+vote)\s+(for|against|in\s+favou?r\s+of|opposed|abstained|to\s+abstain)\s+(?:on\s+|the\s+)?(?:the\s+)?" + BILL_EN + r"\s+bill" + TIME_EN + END, ("subject", "vote_value", "bill", "time"), ignore_case=True, name="R6", hint=r"(?i)vote"),
    Rule("bill_sponsorship", "en", SUBJECT_EN + r"\s+(?:sponsored|initiated|introduced|co-?sponsored)\s+(?:the\s+)?" + BILL_EN + r"\s+bill" + TIME_EN + END, ("subject", "bill", "time"), ignore_case=True, name="R7", hint=r"(?i)sponsored|initiated|introduced"),
    Rule("office_held", "en", SUBJECT_EN + r"\s+(?:served\s+as|held\s+the\s+office\s+of|was\s+appointed)\s+(?:the\s+)?" + r"(Prime\s+Minister|Minister\s+of\s+[A-Za-z\s]+|Deputy\s+Minister(?:\s+of\s+[A-Za-z\s]+)?|Member\s+of\s+Knesset|Chair(?:person)?\s+of\s+[A-Za-z\s]+)" + TIME_EN + END, ("subject", "office", "time"), ignore_case=True, name="R8", hint=r"(?i)served|held|appointed"),
    Rule("committee_membership", "en", SUBJECT_EN + r"\s+(?:was\s+a\s+member\s+of|served\s+on|sat\s+on)\s+(?:the\s+)?" + COMMITTEE_EN + r"\s+[Cc]ommittee" + TIME_EN + END, ("subject", "committee", "time"), name="R9", hint=r"member|served|sat"),
    Rule("committee_attendance", "en", SUBJECT_EN + r"\s+(?:attended|was\s+present\s+at)\s+(?:a\s+|the\s+)?(?:session\s+of\s+)?(?:the\s+)?" + COMMITTEE_EN + r"\s+[Cc]ommittee" + TIME_EN + END, ("subject", "committee", "time"), name="R10", hint=r"attended|present"),
    Rule("election_result", "he", rf"([{HE}A-Za-z'\"\-\s]{{2,50}}?)" + r"\s+(?:זכה(?:ה)?|קיבל(?:ה)?|זכתה|קיבלה)\s+(?:ב-?)?(\d{1,3})\s+(?:מנדטים|מושבים)" + TIME_HE + END, ("party", "seats", "time"), name="R11", hint=r"מנדטים|מושבים"),
    Rule("election_result", "he", rf"([{HE}A-Za-z'\"\-\s]{{2,45}}?)" + r"\s+לא\s+עבר(?:ה)?\s+(?:את\s+)?אחוז\s+החסימה" + TIME_HE_SHORT + END, ("party", "time"), below=True, name="R12", hint=r"החסימה"),
    Rule("election_result", "en", SUBJECT_EN + r"\s+(?:won|received|got)\s+(\d{1,3})\s+seats" + TIME_EN + END, ("party", "seats", "time"), ignore_case=True, name="R13", hint=r"(?i)seats"),
    Rule("election_result", "en", SUBJECT_EN + r"\s+did\s+not\s+pass\s+(?:the\s+)?electoral\s+threshold" + TIME_EN + END, ("party", "time"), ignore_case=True, below=True, name="R14", hint=r"(?i)threshold"),
    Rule("government_decision", "he", r"(?:(?:הממשלה\s+החליטה)|(?:בהחלטת?\s+ממשלה)|(?:החלטת?\s+ממשלה))\s*(?:מספר|מס'?|מס\.?)?\s*(\d[\d/\-]*)(?:\s+(?:של\s+)?(?:הממשלה\s+)?(?:ה-?\s*)?(\d{1,2}))?[\.\?\!,]?\s*", ("decision_number", "government_number"), many=True, name="R15", hint=r"ממשלה"),
    Rule("government_decision", "he", r"(?:בהחלטה|להחלטה|החלטה)\s+(?:מספר|מס'?|מס\.?)\s*(\d[\d/\-]*)[\.\?\!,]?\s*", ("decision_number",), many=True, name="R16", hint=r"החלטה"),
    Rule("government_decision", "en", r"(?:(?:government\s+(?:decision|resolution)(?:\s+number)?)|(?:cabinet\s+(?:decision|resolution)(?:\s+number)?)|(?:the\s+cabinet\s+decided))\s*(?:number\s+)?(?:no\.?\s+)?(\d[\d/\-]*)[\.\?\!,]?\s*", ("decision_number",), ignore_case=True, many=True, name="R17", hint=r"(?i)government|cabinet"),
]

#: A match: its rule, its place, and what the rule's groups caught, in the rule's order.
MATCH = "array<struct<rule:int,start:int,end:int,parts:array<string>>>"


#: Stands between the groups when a match is written out; taken from statements beforehand.
MARK = "\x01"


def _written_out(rule: Rule, text: Column) -> Column:
    """The text with each match replaced by its marked groups, split: what stands before the match, then the groups.

    One search gives the match, its place and all groups; without a match the array has one element.
    """
    groups = "".join(f"{MARK}${i + 1}" for i in range(len(rule.groups)))
    return F.split(F.regexp_replace(text, rule.java(), groups), MARK)


def _match(number: int, written: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(number).alias("rule"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.slice(written, F.lit(2), F.lit(len(RULES[number].groups))).alias("parts"))


def caught(group: str) -> Column:
    """What a group caught, of a match ``m`` of any rule: the rule's place for the group comes from a table."""
    at = F.array(*[F.lit(r.groups.index(group) if group in r.groups else -1) for r in RULES])
    return blank_to_null(F.nullif(F.get("m.parts", F.get(at, F.col("m.rule"))), F.lit("")))


def rule_matches(number: int, text: Column) -> Column:
    """All matches of one rule as an array (empty if the rule does not match)."""
    rule = RULES[number]
    if not rule.many:  # anchored at the end of the statement: one match at most
        one = lambda p: F.when(F.size(p) > 1, F.array(_match(number, p, F.length(F.get(p, F.lit(0))), F.length(text)))).otherwise(F.array()).cast(MATCH)
        return F.flatten(F.transform(F.array(_written_out(rule, text)), one))
    found = F.regexp_extract_all(text, F.lit(rule.java()), F.lit(0))
    # the places of the matches: each is the first occurrence of its text behind the one before it
    place = lambda acc, m: F.call_function("locate", m, text, acc.at + 1) - 1
    step = lambda acc, m: F.struct((place(acc, m) + F.length(m)).alias("at"), F.concat(acc.out, F.array(F.struct(place(acc, m).alias("s"), m.alias("m")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,m:string>>").alias("out"))
    placed = F.aggregate(found, start, step, lambda acc: acc.out)
    return F.transform(placed, lambda p: _match(number, _written_out(rule, p.m), p.s, p.s + F.length(p.m))).cast(MATCH)


def all_matches(text: Column, language: Column) -> Column:
    parts = [F.when((language == r.language) & text.rlike(r.hint), rule_matches(i, text)).otherwise(F.array().cast(MATCH)) for i, r in enumerate(RULES)]
    return F.concat(*parts)


def without_overlaps(matches: Column) -> Column:
    """Longer spans first, then earlier, then rule order; a match that overlaps a kept one is dropped."""
    order = F.array_sort(matches, lambda a, b: F.coalesce(*[F.nullif(F.signum(x).cast("int"), F.lit(0)) for x in ((b.end - b.start) - (a.end - a.start), a.start - b.start, a.rule - b.rule)], F.lit(0)))
    clash = lambda kept, m: F.exists(kept, lambda k: (m.end > k.start) & (k.end > m.start))
    return F.aggregate(order, F.array().cast(MATCH), lambda kept, m: F.when(clash(kept, m), kept).otherwise(F.concat(kept, F.array(m))))


def slot_columns() -> dict[str, Column]:
    """Claim slots from a match's groups; blanks are null. The decision number stands in for the id until resolved."""
    m = caught
    below = [i for i, r in enumerate(RULES) if r.below]
    none = F.lit(None).cast("string")
    return {
        "speaker_person_id": m("subject"), "target_person_id": none, "bill_id": m("bill"), "committee_id": m("committee"), "office_id": m("office"), "vote_value": vote_value(m("vote_value")),
        "party_id": m("party"), "expected_seats": m("seats"), "expect_passed_threshold": F.when(F.col("m.rule").isin(below), "false"), "government_decision_id": m("decision_number"), "government_number": m("government_number"),
    }


def violations(claim_type: Column, slots: dict[str, Column]) -> Column:
    """Messages for empty required and filled forbidden slots; an unknown type is one message."""
    template = F.create_map(*[x for t, (required, optional) in SLOT_TEMPLATES.items() for x in (F.lit(t), F.struct(_names(required).alias("required"), _names([*required, *optional]).alias("allowed")))])
    is_set = F.array_compact(F.array(*[F.when(~(slots[s].isNull() | (slots[s].cast("string") == "")), F.lit(s)) for s in SLOTS]))
    said = lambda kind, what: lambda s: F.concat(F.lit(f"{kind} slot "), s, F.lit(f" is {what} for "), claim_type)

    def test(x: Column) -> Column:
        missing = F.transform(F.filter(x.t.required, lambda s: ~F.array_contains(x.set, s)), said("required", "empty"))
        extra = F.transform(F.filter(x.set, lambda s: ~F.array_contains(x.t.allowed, s)), said("forbidden", "set"))
        return F.when(x.t.isNull(), F.array(F.concat(F.lit("unknown claim_type: "), F.coalesce(claim_type, F.lit("null"))))).otherwise(F.concat(missing, extra))

    return bind(F.struct(F.when(claim_type.isNotNull(), F.try_element_at(template, F.coalesce(claim_type, F.lit("")))).alias("t"), is_set.alias("set")), test)


def is_valid(claim_type: Column, slots: dict[str, Column]) -> Column:
    """Whether ``violations`` finds none, as one plain condition: most rows ask no more than that."""
    filled = {s: F.coalesce(slots[s].cast("string") != "", F.lit(False)) for s in SLOTS}
    out = F.lit(False)
    for t, (required, optional) in SLOT_TEMPLATES.items():
        ok = F.lit(True)
        for s in SLOTS:
            ok = ok & filled[s] if s in required else ok if s in optional else ok & ~filled[s]
        out = F.when(claim_type == t, ok).otherwise(out)
    return out


def _names(slots: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(s) for s in slots]).cast("array<string>")


def extract(statements: DataFrame, reference_date: Column | None = None, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """statements: statement_id, text, language -> (claims, summary per statement).

    answers (language, text_key, answer_seq, claim_type, slots..., normalized_text, time_phrase): cached answers that
    only statements without a valid claim use; they pass the same slot check and get the method ``llm``.
    """
    s = statements.withColumn("text", F.trim(F.translate("text", MARK, " ")))
    ref = F.current_date() if reference_date is None else reference_date
    picked = s.withColumn("_m", F.when(F.length("text") > 0, without_overlaps(all_matches(F.col("text"), F.col("language")))).otherwise(F.array().cast(MATCH)))
    # outer, as for a plain explode the optimizer adds a filter on the array's size, which would match all rules again
    rows = picked.select("statement_id", "text", "language", F.posexplode_outer("_m").alias("position", "m")).where("m IS NOT NULL")
    kinds = F.array(*[F.lit(r.claim_type) for r in RULES])
    # the slots become columns by a generator, so what reads them (slot check, keys) does not compute them again
    made = F.struct(F.element_at(kinds, F.col("m.rule") + 1).alias("claim_type"), F.col("m.rule").alias("rule"), F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), *[c.alias(k) for k, c in slot_columns().items()], caught("time").alias("time_phrase"))
    rows = rows.select("statement_id", "text", "language", "position", F.inline(F.array(made)))
    fits = is_valid(F.col("claim_type"), {k: F.col(k) for k in SLOTS})
    rows = rows.withColumns({"violations": violations(F.col("claim_type"), {k: F.col(k) for k in SLOTS}), "_fits": fits})
    ident = F.concat_ws(":", F.col("statement_id").cast("string"), F.col("span_start").cast("string"), F.col("span_end").cast("string"), F.col("rule").cast("string"))
    rows = rows.withColumns({"claim_id": entity_key("claim", ident), "raw_text": F.col("text"), "normalized_text": F.trim(F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))), "method": F.lit("rules")})
    valid = rows.where("_fits")

    if answers is not None:
        rest = s.join(valid.select("statement_id").distinct(), "statement_id", "left_anti").withColumn("text_key", statement_key(F.col("language"), F.col("text")))
        a = rest.join(answers, ["language", "text_key"])
        a = a.withColumn("vote_value", vote_value(F.col("vote_value"))).withColumns({"violations": violations(F.col("claim_type"), {k: F.col(k) for k in SLOTS}), "_fits": fits})
        ident = F.concat_ws(":", F.col("statement_id").cast("string"), F.lit("answer"), F.col("answer_seq").cast("string"))
        a = a.withColumns(
            {
                "claim_id": entity_key("claim", ident), "raw_text": F.col("text"), "normalized_text": F.trim(F.coalesce(F.nullif("normalized_text", F.lit("")), F.col("text"))), "method": F.lit("llm"),
                "position": F.col("answer_seq").cast("int"), "rule": F.lit(None).cast("int"), "span_start": F.lit(None).cast("int"), "span_end": F.lit(None).cast("int"),
            }
        )
        rows = rows.unionByName(a.select(*rows.columns))
        valid = rows.where("_fits")

    claims = valid.drop("violations", "_fits", "text").withColumn("time_scope", normalize_time_scope(F.col("time_phrase"), ref))
    by_rule = F.col("method") == "rules"
    errors = F.when(by_rule, F.col("violations")).otherwise(F.when(F.size("violations") > 0, F.array(F.lit("answer rejected by slot check"))).otherwise(F.array().cast("array<string>")))
    per = rows.withColumn("_e", errors).groupBy("statement_id").agg(
        F.count_if(by_rule).alias("rule_matches"), F.count_if("_fits").alias("n_claims"), F.bool_or(~by_rule).alias("fallback_used"), F.array_sort(F.flatten(F.collect_list("_e"))).alias("errors")
    )
    summary = s.select("statement_id").join(per, "statement_id", "left").select(
        "statement_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rule_matches", "n_claims")], F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors")
    )
    return claims, summary


def claim_checkability(claims: DataFrame) -> Column:
    """Column over claims with slots, slot_statuses (map slot -> status) and time_scope."""
    kind = F.col("claim_type")
    bad = F.lit(False)
    for t, (required, _) in SLOT_TEMPLATES.items():
        unresolved = F.lit(False)
        for x in required:
            unresolved = unresolved | ~F.coalesce(F.try_element_at("slot_statuses", F.lit(x)), F.lit("not_applicable")).isin("resolved", "not_applicable")
        bad = F.when(kind == t, unresolved).otherwise(bad)
    return (
        F.when(~kind.isin(list(SLOT_TEMPLATES)), "non_checkable")
        .when(~is_valid(kind, {k: F.col(k) for k in SLOTS}), "insufficient_entity_resolution")
        .when(bad, "insufficient_entity_resolution")
        .when(kind.isin(TIME_REQUIRED) & (F.col("time_scope.granularity") == "unknown"), "insufficient_time_scope")
        .otherwise("checkable")
    )


#: Families by precedence. Fixed values.
FAMILIES = [("formal_action", ["vote_cast", "bill_sponsorship", "committee_attendance"]), ("position_claim", ["office_held", "committee_membership"]), ("electoral_claim", ["election_result"])]


def family() -> Column:
    """Aggregate over a group's claim types."""
    out = F.lit("unknown")
    for name, types in reversed(FAMILIES):
        out = F.when(F.coalesce(F.bool_or(F.col("claim_type").isin(types)), F.lit(False)), name).otherwise(out)
    return out


def declaration_checkability() -> Column:
    """Aggregate over a group's checkability values (none: not_checkable)."""
    n = lambda v: F.count_if(F.col("checkability") == v)
    total = F.count("checkability")
    return (
        F.when(total == 0, "not_checkable")
        .when(n("checkable") > 0, "checkable_formal_action")
        .when(n("insufficient_time_scope") == total, "insufficient_time_scope")
        .when(n("insufficient_entity_resolution") == total, "insufficient_entity_resolution")
        .when(n("non_checkable") == total, "not_checkable")
        .when((n("insufficient_time_scope") > 0) | (n("insufficient_entity_resolution") > 0), "partially_checkable")
        .otherwise("not_checkable")
    )


def declarations(utterances: DataFrame, claims: DataFrame) -> DataFrame:
    """utterances: declaration_id (= statement_id), text, language, uttered_at (optional, null), ...; one row each, even without a claim."""
    return with_declared(utterances, claims.groupBy(F.col("statement_id").alias("declaration_id")).agg(*declared()))


def declared() -> list[Column]:
    """Aggregates over a declaration's claims."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "claim_id"))), lambda x: x.claim_id)
    return [family().alias("claim_family"), declaration_checkability().alias("checkability"), ids.alias("derived_atomic_claim_ids")]


def with_declared(utterances: DataFrame, per: DataFrame) -> DataFrame:
    """per: declaration_id and what ``declared`` gives; it may have more columns."""
    u = utterances.withColumn("utterance_time", F.coalesce(F.col("uttered_at").cast("timestamp"), utterance_time(F.col("text"))))
    out = u.join(per, "declaration_id", "left")
    return out.withColumns({"claim_family": F.coalesce("claim_family", F.lit("unknown")), "checkability": F.coalesce("checkability", F.lit("not_checkable")), "derived_atomic_claim_ids": F.coalesce("derived_atomic_claim_ids", F.array().cast("array<string>"))})


def offline_granularity(phrase: Column, reference: Column) -> Column:
    return F.when(F.trim(F.coalesce(phrase, F.lit(""))) == "", "unknown").otherwise(normalize_time_scope(phrase, reference).granularity)

