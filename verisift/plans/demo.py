"""The driver's tables seen as the tables of the statement checker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .materialise import dealt, spread

#: Sentences a task of the rule matching: a second or so of work each.
SENTENCES_EACH = 50_000
#: Bills up to this number are broadcast to the lines or come near it; more are joined by a shuffle.
FEW_BILLS = 1_000_000


class Tables:
    """Lazy reads of one data folder, and the views built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return spread(self.spark.read.parquet(f"{self.dir}/{name}.parquet"))

    # facts -----------------------------------------------------------
    def vote_events(self) -> DataFrame:
        return self.lineitem.select(vote_id().alias("vote_event_id"), s("l_partkey").alias("bill_id"), F.col("l_shipdate").alias("occurred_at"))

    def cast_votes(self) -> DataFrame:
        return self.lineitem.select(s("l_suppkey").alias("person_id"), vote_id().alias("vote_event_id"), vote_value().alias("value"))

    def bills(self) -> DataFrame:
        return self.part.select(s("p_partkey").alias("bill_id"), F.col("p_name").alias("title"), F.col("p_size").alias("knesset_number"))

    def vote_documents(self) -> DataFrame:
        return self.lineitem.select(vote_id().alias("vote_event_id"), F.concat(F.lit("doc"), F.col("l_linenumber").cast("string")).alias("document_id"))

    def order_pairs(self) -> DataFrame:
        """One (supplier, part) pair an order: the least of its lines."""
        pair = self.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_suppkey", "l_partkey")).alias("p")).select(F.col("l_orderkey").alias("o_orderkey"), "p.*")
        return self.orders.join(pair, "o_orderkey")

    def vote_claims(self) -> DataFrame:
        """An order claims how its supplier voted on its part, in the three years from the order's year on, or at any time."""
        k = F.col("o_orderkey")
        year = F.year("o_orderdate")
        return self.order_pairs().select(
            s("o_orderkey").alias("claim_id"), F.lit("vote_cast").alias("claim_type"), s("l_suppkey").alias("speaker_person_id"), s("l_partkey").alias("bill_id"),
            F.when(k % 5 == 0, None).otherwise(pick(k % 3, "for", "against", "abstain")).alias("expected_vote_value"),
            F.when(k % 4 != 0, F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")).alias("time_start"), F.when(k % 4 != 0, F.make_date(year + 3, F.lit(1), F.lit(1)).cast("timestamp_ntz")).alias("time_end"),
            F.when(k % 11 == 0, "insufficient_time_scope").when(k % 13 == 0, "insufficient_entity_resolution").otherwise("checkable").alias("checkability"),
        ).withColumns(no_slots("expected_seats", "expect_passed_threshold", "government_decision_id")).withColumn("resolved_ids", ids("speaker_person_id", "bill_id"))

    def vote_kb(self) -> dict[str, DataFrame]:
        return {"cast_vote": self.cast_votes(), "vote_event": self.vote_events(), "bill": self.bills(), "vote_documents": self.vote_documents()}

    def terms(self) -> DataFrame:
        """Membership terms: a customer in its nation from each order date on, 90 days unless the order is open."""
        c = self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
        return self.orders.join(c, "o_custkey").select(s("o_orderkey").alias("term_id"), s("o_custkey").alias("person_id"), s("c_nationkey").alias("org_id"), F.col("o_orderdate").alias("valid_from"), end.alias("valid_to"), F.col("o_orderstatus").alias("kind"))

    def term_claims(self, claim_type: str, slot: str) -> DataFrame:
        """A customer claims to be in its nation (every third: in the next one) in 1996 and 1997."""
        k = F.col("c_custkey")
        nation = F.when(k % 3 == 0, F.pmod(F.col("c_nationkey") + 1, F.lit(25))).otherwise(F.col("c_nationkey"))
        out = self.customer.select(
            s("c_custkey").alias("claim_id"), F.lit(claim_type).alias("claim_type"), s("c_custkey").alias("speaker_person_id"), nation.cast("string").alias(slot),
            F.lit("1996-01-01").cast("timestamp_ntz").alias("time_start"), F.lit("1997-12-31").cast("timestamp_ntz").alias("time_end"), F.lit("checkable").alias("checkability"),
        )
        return out.withColumns(no_slots("expected_vote_value", "expected_seats", "expect_passed_threshold", "government_decision_id")).withColumn("resolved_ids", ids("speaker_person_id", slot))

    def nations(self, ident: str) -> DataFrame:
        return self.nation.select(s("n_nationkey").alias(ident), F.col("n_name").alias("canonical_name"), F.col("n_name").alias("title"), F.lit("seat").alias("office_type"))

    def attendance(self) -> tuple[DataFrame, DataFrame]:
        e = self.events
        presence = F.when(F.col("value") < 20, "present").when(F.col("value") < 40, "partial").otherwise("absent")
        edges = e.select(s("user_id").alias("person_id"), s("event_id").alias("attendance_event_id"), presence.alias("presence"))
        return e.select(s("event_id").alias("attendance_event_id"), F.col("event_type").alias("committee_id"), F.col("ts").alias("occurred_at")), edges

    def election_rows(self) -> DataFrame:
        """Result lines: a region is an election, its supplier nations are lists, quantities are votes."""
        n = self.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
        lists = self.supplier.join(n, "s_nationkey").join(self.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity"), "s_suppkey").groupBy("n_regionkey", "n_name").agg(F.sum("l_quantity").cast("long").alias("votes"))
        total = lists.groupBy("n_regionkey").agg(F.sum("votes").alias("valid_votes"))
        j = lists.join(total, "n_regionkey")
        share = F.concat(F.format_string("%.2f", F.col("votes") * 100.0 / F.col("valid_votes")), F.lit("%"))
        return j.select(
            F.col("n_regionkey").alias("knesset_number"), F.lit("2022-11-01").cast("timestamp_ntz").alias("election_date"), F.col("n_name").alias("list_name"), F.concat(F.lit("L"), F.regexp_extract("n_name", r"(\d+)$", 1)).alias("ballot_letters"),
            F.floor(F.col("votes") * 120 / F.col("valid_votes")).cast("int").alias("seats_won"), share.alias("vote_share_pct"), "votes", "valid_votes",
        )

    def list_mapping(self) -> DataFrame:
        letters = F.concat(F.lit("L"), F.regexp_extract("n_name", r"(\d+)$", 1))
        return self.nation.select(F.col("n_regionkey").alias("knesset_number"), letters.alias("ballot_letters"), F.when(F.col("n_nationkey") % 2 == 0, s("n_nationkey")).alias("faction_id"))

    def decisions(self) -> DataFrame:
        return self.orders.select(
            s("o_orderkey").alias("government_decision_id"), s("o_custkey").alias("decision_number"), (F.col("o_orderkey") % 7).cast("int").alias("government_number"), F.col("o_orderdate").alias("decision_date"),
            F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("d"), s("o_orderkey"))).alias("source_document_id"),
        )

    # text ------------------------------------------------------------
    def sentences(self, each: int | None = None) -> DataFrame:
        """One English sentence a line, its digits written as letters.

        The lines are dealt as numbers, before they meet the names. Where bills are many, by bill, so that the join with them asks
        for no second exchange of the lines.
        """
        name, bill = letters(F.col("s_name")), letters(F.col("p_name"))
        verb = pick(F.col("l_orderkey") % 4, "voted for the", "voted against the", "sponsored the", "abstained from the")
        when_ = pick(F.col("l_partkey") % 3, "", " in the 18th Knesset", " in last term")
        year = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" in "), F.year("l_shipdate").cast("string"))).otherwise(when_)
        own = ["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber"]
        lines = self.spark.read.parquet(f"{self.dir}/lineitem.parquet").select(*own, "l_shipdate")
        lines = dealt(lines, lines.count(), each or SENTENCES_EACH, *(own if self.part.count() <= FEW_BILLS else ["l_partkey"]))  # the counts are in the files' footers
        j = lines.join(self.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").join(self.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
        return j.select(vote_id().alias("statement_id"), F.concat(name, F.lit(" "), verb, F.lit(" "), bill, F.lit(" bill"), year, F.lit(".")).alias("text"), F.lit("en").alias("language"), F.col("l_shipdate").alias("uttered_at"))


def s(c: str) -> Column:
    return F.col(c).cast("string")


def vote_id() -> Column:
    return F.concat_ws("-", s("l_orderkey"), s("l_suppkey"), s("l_partkey"), s("l_linenumber"), F.date_format("l_shipdate", "yyyyMMdd"))


def vote_value() -> Column:
    return F.when(F.col("l_returnflag") == "A", "for").when(F.col("l_returnflag") == "R", "against").otherwise("abstain")


def pick(n: Column, *values: str) -> Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(n == i, v).otherwise(out)
    return out


def no_slots(*names: str) -> dict[str, Column]:
    return {n: F.lit(None).cast("string") for n in names}


def ids(*slots: str) -> Column:
    return F.create_map(*[x for c in slots for x in (F.lit(c), F.col(c))])


def letters(c: Column) -> Column:
    """Digits as letters, as the sentence rules want names without digits."""
    return F.translate(F.regexp_replace(c, "[#_]", ""), "0123456789", "abcdefghij")
