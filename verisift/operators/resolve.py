"""Entity resolution: a ladder of joins over a table of mentions. A step sees only what no earlier step matched.

mentions: mention_id, kind, hebrew_name, english_name, external_ids (array of struct(scheme, value), in order; optional).
entities: kind, entity_id, canonical_name, hebrew_name, english_name, external_ids (map).
aliases: entity_kind, alias_text, alias_locale, canonical_entity_id, confidence.
Candidates: mention_id, entity_id, step, reason, score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_hebrew, normalize_hebrew, transliterate_hebrew
from ..plans.materialise import checkpointed, kept
from ..plans.schemas import SLOT_KINDS
from .retrieve import top_k

RESOLVE_AT, MARGIN, FLOOR, PARTIAL = 88, 7, 60, 0.92
COLUMNS = ["mention_id", "entity_id", "step", "reason", "score"]


def candidate(step: int, reason: str, score: Column | int) -> list[Column]:
    s = F.lit(score) if isinstance(score, int) else score
    return [F.lit(step).alias("step"), F.lit(reason).alias("reason"), s.cast("int").alias("score")]


def by_external_id(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The first scheme, in the mention's order, whose value an entity has."""
    asked = mentions.select("mention_id", "kind", F.posexplode("external_ids").alias("at", "x")).select("mention_id", "kind", "at", "x.scheme", "x.value")
    have = entities.select("kind", "entity_id", F.explode("external_ids").alias("scheme", "value"))
    hit = asked.join(have, ["kind", "scheme", "value"]).groupBy("mention_id").agg(F.min_by("entity_id", F.struct("at", "entity_id")).alias("entity_id"))
    return hit.select("mention_id", "entity_id", *candidate(1, "external_id", 100))


def by_exact_name(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Normalised Hebrew name equal to a stored name that only one entity of the kind has."""
    names = entities.where(F.col("hebrew_name").isNotNull()).groupBy("kind", F.col("hebrew_name").alias("name")).agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    m = mentions.where(F.length("hebrew_name") > 0).select("mention_id", "kind", normalize_hebrew(F.col("hebrew_name")).alias("name"))
    return m.join(names, ["kind", "name"]).select("mention_id", "entity_id", *candidate(2, "hebrew_exact", 95))


def by_alias(mentions: DataFrame, aliases: DataFrame, text: Column, locale: str, step: int, reason: str, penalty: int = 0) -> DataFrame:
    a = aliases.where(F.col("alias_locale") == locale).select(F.col("entity_kind").alias("kind"), F.col("alias_text").alias("name"), F.col("canonical_entity_id").alias("entity_id"), "confidence")
    m = mentions.select("mention_id", "kind", text.alias("name")).where(F.length("name") > 0)
    return m.join(a, ["kind", "name"]).select("mention_id", "entity_id", *candidate(step, reason, F.greatest(F.col("confidence") - penalty, F.lit(0))))


# ---------------------------------------------------------------- similarity


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        m = where.get(ch, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    n = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text against windows of its length in the longer one (shorter at the ends)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n, best = len(a), 0.0
    own = set(a)
    for i in range(1 - n, len(b)):
        w = b[max(0, i) : i + n]
        edge = w[0] if i < 0 else w[-1]
        if (i < 0 and w[-1] not in own) or (i >= 0 and edge not in own):
            continue
        best = max(best, ratio(a, w))
        if best == 100.0:
            break
    return best


def grams(c: Column, q: int = 2) -> Column:
    """Distinct q-grams of a text (shorter texts: the text itself)."""
    n = F.length(c)
    return F.when(n < q, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(q)))))


#: Letters of a text that fit one machine word.
WORD_BITS = 64


class Names:
    """A column of names, as an array of letter numbers, compared with one text at a time."""

    def __init__(self, names: list[str]):
        self.names, self.length = names, np.array([len(n) for n in names], np.int64)
        self.number = {c: i + 1 for i, c in enumerate(sorted(set("".join(names))))}
        self.letters = np.zeros((int(self.length.max(initial=0)), len(names)), np.intp)
        for j, n in enumerate(names):
            self.letters[: len(n), j] = [self.number[c] for c in n]

    def common(self, texts: list[str]) -> np.ndarray:
        """Length of the longest common subsequence of each text with every name: bit rows, all texts and names at once."""
        out, short = np.zeros((len(texts), len(self.names)), np.int64), [i for i, t in enumerate(texts) if 0 < len(t) <= WORD_BITS]
        for i, t in enumerate(texts):
            if len(t) > WORD_BITS:
                out[i] = [lcs_length(t, n) for n in self.names]
        if not short or not len(self.letters):
            return out
        masks, length = np.zeros((len(short), len(self.number) + 1), np.uint64), np.array([len(texts[i]) for i in short], np.int64)[:, None]
        for j, i in enumerate(short):
            own: dict[int, int] = {}
            for k, c in enumerate(texts[i]):
                own[self.number.get(c, 0)] = own.get(self.number.get(c, 0), 0) | 1 << k
            own.pop(0, None)  # letters that no name has
            masks[j, list(own)] = np.array(list(own.values()), np.uint64)
        full = np.array([(1 << len(texts[i])) - 1 for i in short], np.uint64)[:, None]
        row = np.repeat(full, len(self.names), axis=1)
        u, carried = np.empty_like(row), np.empty_like(row)
        with np.errstate(over="ignore"):
            for letters in self.letters:  # bits above a text's never reach the others, so they are cut off once at the end
                np.take(masks, letters, axis=1, out=u, mode="clip")
                np.bitwise_and(u, row, out=u)
                np.add(row, u, out=carried)
                np.subtract(row, u, out=row)
                np.bitwise_or(row, carried, out=row)
        out[short] = length - np.bitwise_count(row & full)
        return out

    def ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ratio of each text with every name, common letters); nothing is like an empty text."""
        common, length = self.common(texts), np.array([len(t) for t in texts], np.int64)[:, None]
        return np.where((self.length > 0) & (length > 0), 100.0 * 2 * common / np.maximum(1, self.length + length), 0.0), common


#: Pairs of text and name compared by one array operation.
PAIRS_AT_ONCE = 1 << 15


def best_names(asked: list[tuple], nhe: Names, ncn: Names, nen: Names, floor: int, top: int) -> Iterator[tuple]:
    """asked: (id, he, en). -> (id, number of the name, score, reason) of each text's best names, a block of texts at a time."""
    each = max(1, PAIRS_AT_ONCE // max(1, len(ncn.names)))
    for at in range(0, len(asked), each):
        ids, he, en = (list(x) for x in zip(*asked[at : at + each]))
        (sh, common), (sc, _) = nhe.ratios(he), ncn.ratios(en)
        se = sc if nen is ncn else nen.ratios(en)[0]
        for j, ident in enumerate(ids):
            for hit in fuzzy_scores(he[j], nhe, sh[j], common[j], sc[j], se[j], floor, top):
                yield (ident, *hit)


def fuzzy_scores(he: str, nhe: Names, sh: np.ndarray, common: np.ndarray, sc: np.ndarray, se: np.ndarray, floor: int, top: int) -> list[tuple[int, int, str]]:
    """(number of the name, score, reason) of a text's ``top`` best names at the floor or above, of equal ones the first.

    Only names whose best possible score reaches the best ones' are looked at one by one.
    """
    exact = np.maximum(sh, np.maximum(sc, se))
    # a window has at most the common letters of the whole, and is at its best when it has no others
    short = np.minimum(nhe.length, len(he))
    bound = np.where((common > 0) & (short > 0), 100.0 * 2 * common / np.maximum(1, short + common), 0.0) * PARTIAL
    score, most = exact.astype(np.int64), np.maximum(exact, bound).astype(np.int64)
    least = max(floor, int(np.partition(score, -top)[-top])) if len(score) > top else floor
    at = np.flatnonzero(most >= least)
    part = {i: partial_ratio(he, nhe.names[i]) * PARTIAL for i in at[bound[at] > exact[at]]}
    for i, p in part.items():
        score[i] = int(max(exact[i], int(p)))
    at = at[score[at] >= floor]
    out = []
    for i in at[np.argsort(-score[at], kind="stable")[:top]]:
        reason = "fuzzy_en" if se[i] >= sh[i] and se[i] >= sc[i] else "fuzzy_cn" if sc[i] > sh[i] else "fuzzy_he"
        out.append((int(i), int(score[i]), "fuzzy_partial_he" if part.get(i, 0.0) > exact[i] else reason))
    return out


def by_similarity(mentions: DataFrame, entities: DataFrame, floor: int = FLOOR, top: int = 5, block: int = 5_000) -> DataFrame:
    """Every mention against every entity of its kind, at the floor or above, best five.

    The mentions are a stated query set: blocks of about ``block`` are shipped to the tasks, which read the entities where they lie
    and compare a batch of names with one text at a time, of which they keep the best. Equal texts and equal names are compared once. A ratio of 60 leaves no common part that a join could use
    (``abc`` and ``axbxc`` reach 75 without a common 2-gram), so no pair is left out.
    """
    m = mentions.select("mention_id", "kind", F.when(F.length("hebrew_name") > 0, normalize_hebrew(F.col("hebrew_name"))).otherwise("").alias("he"), F.lower(F.trim(F.coalesce("english_name", F.lit("")))).alias("en"))
    m = m.where((F.length("he") > 0) | (F.length("en") > 0)).withColumn("_text", text_key("kind", "he", "en"))
    asked_texts = checkpointed(m.groupBy(F.col("_text").alias("mention_id")).agg(*[F.first(c).alias(c) for c in ("kind", "he", "en")]))
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    e = entities.select("kind", "entity_id", normalize_hebrew(F.col("hebrew_name")).alias("nhe"), text("canonical_name").alias("ncn"), text("english_name").alias("nen"))
    own = ["kind", "nhe", "ncn", "nen"]  # entities of equal names score alike, so of them only the first ``top`` ids can be among the best
    e = top_k(e, own, [F.col("entity_id")], top).groupBy(*own).agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    n, schema = max(1, -(-asked_texts.count() // block)), T.StructType([T.StructField("mention_id", T.StringType()), T.StructField("ids", e.schema["ids"].dataType), T.StructField("reason", T.StringType()), T.StructField("score", T.IntegerType())])
    e = e.repartition(2 * e.sparkSession.sparkContext.defaultParallelism)  # the names are few bytes and much work
    hits = None
    for part in range(n):
        asked: dict[str, list[tuple]] = {}
        for r in asked_texts.where(F.pmod(F.xxhash64("mention_id"), F.lit(n)) == part).collect():  # a block
            asked.setdefault(r.kind, []).append((r.mention_id, r.he, r.en))
        shipped = e.sparkSession.sparkContext.broadcast(asked)

        def compare(frames: Iterator[pd.DataFrame], shipped: Broadcast = shipped) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame[frame["ids"].map(len) > 0]
                frame = frame.iloc[np.argsort(frame["ids"].map(lambda x: x[0]).to_numpy(), kind="stable")]  # equal scores go by id
                for kind, rows in frame[frame["kind"].isin(shipped.value)].groupby("kind"):
                    ids, names = list(rows["ids"]), [Names(list(rows[c].fillna(""))) for c in ("nhe", "ncn", "nen")]
                    if names[1].names == names[2].names:
                        names[2] = names[1]
                    out = [(ident, ids[i], reason, score) for ident, i, score, reason in best_names(shipped.value[kind], *names, floor, top)]
                    if out:
                        yield pd.DataFrame({f.name: pd.Series([r[i] for r in out], dtype=object) for i, f in enumerate(schema.fields)})

        found = e.mapInPandas(compare, schema).select("mention_id", F.explode("ids").alias("entity_id"), "reason", "score")
        found = top_k(found, ["mention_id"], [F.col("score").desc(), F.col("entity_id")], top)
        hits = found if hits is None else hits.unionByName(found)
    hits = m.select("mention_id", "_text").join(hits.withColumnRenamed("mention_id", "_text"), "_text")
    return hits.select("mention_id", "entity_id", F.lit(5).alias("step"), "reason", "score")


def ladder(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Candidates of the first step that has any, for each mention.

    The steps by key are looked up side by side and the first one kept, so mentions meet the tables once; similarity is
    asked only for what they leave.
    """
    steps = [by_external_id(mentions, entities)] if "external_ids" in mentions.columns else []
    steps += [
        by_exact_name(mentions, entities), by_alias(mentions, aliases, normalize_hebrew(F.col("hebrew_name")), "he", 3, "alias_he"), by_alias(mentions, aliases, F.lower(F.trim("english_name")), "en", 3, "alias_en"),
        by_alias(mentions, aliases, transliterate_hebrew(F.col("hebrew_name")), "en", 4, "transliteration", 10),
    ]
    hits = None
    for i, step in enumerate(steps):
        s = step.select(*COLUMNS, F.lit(i).alias("_at"))
        hits = s if hits is None else hits.unionByName(s)
    first = F.min("_at").over(Window.partitionBy("mention_id"))
    found = kept(hits.withColumn("_first", first).where("_at = _first").select(*COLUMNS), "found")  # two branches read it: the result and what is left
    if not fuzzy:
        return found
    left = mentions.join(found.select("mention_id"), "mention_id", "left_anti")
    return found.unionByName(checkpointed(by_similarity(left, entities).select(*COLUMNS)))


def decide(mentions: DataFrame, candidates: DataFrame, tiebreaks: DataFrame | None = None) -> DataFrame:
    """One id among the candidates: resolved, whatever its score. Several: the best fuzzy one at 88 with a lead of 7, else a
    listed pick of the tie-break table (mention_id, pick), else ambiguous. No candidate: unresolved."""
    lead = F.lead("score", 1, 0).over(Window.partitionBy("mention_id").orderBy(F.col("score").desc(), "entity_id"))
    fuzzy = candidates.where("step = 5").withColumn("_second", lead)
    best = top_k(fuzzy, ["mention_id"], [F.col("score").desc(), F.col("entity_id")], 1).select("mention_id", F.when((F.col("score") >= RESOLVE_AT) & (F.col("score") - F.col("_second") >= MARGIN), F.col("entity_id")).alias("_clear"))
    per = candidates.groupBy("mention_id").agg(
        F.count_distinct("entity_id").alias("n_ids"), F.max_by("entity_id", "score").alias("_one"), F.array_sort(F.collect_set("entity_id")).alias("candidate_ids"), F.max("score").alias("top_score"), F.min("step").alias("step")
    )
    out = mentions.select("mention_id", "kind").join(per, "mention_id", "left").join(best, "mention_id", "left")
    pick = F.lit(None).cast("string")
    if tiebreaks is not None:
        out = out.join(tiebreaks.select("mention_id", "pick"), "mention_id", "left")
        pick = F.when(F.array_contains("candidate_ids", F.col("pick")), F.col("pick"))
    ident = F.when(F.col("n_ids") == 1, F.col("_one")).otherwise(F.coalesce("_clear", pick))
    status = F.when(F.col("n_ids").isNull(), "unresolved").when(ident.isNotNull(), "resolved").otherwise("ambiguous")
    return out.select("mention_id", "kind", status.alias("status"), ident.alias("entity_id"), F.coalesce("candidate_ids", F.array().cast("array<string>")).alias("candidate_ids"), "top_score", "step", F.coalesce("n_ids", F.lit(0)).alias("n_candidates"))


def text_key(*columns: str) -> Column:
    """One key for each combination of texts; lengths stand before them, so no two combinations read alike."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.length(c), F.lit(-1)).cast("string") for c in columns], *columns))


def with_texts(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with the key of their text, the distinct texts as mentions): equal texts of a kind are looked up once, so names that
    many mentions and many entities share do not become all their pairs."""
    m = mentions.withColumn("_text", text_key("kind", "hebrew_name", "english_name"))
    return m, m.groupBy(F.col("_text").alias("mention_id")).agg(*[F.first(c).alias(c) for c in ("kind", "hebrew_name", "english_name")])


def by_substring(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Fallback: mention text inside a name field (case-blind) of exactly one entity of its kind.

    names: kind, entity_id, name (one row a name field). Candidates share the mention's rarest 3-gram, so a pair is
    tested only where the name can hold the text; texts of one or two letters use their own grams.
    """
    text = F.lower(F.coalesce("hebrew_name", "english_name"))
    m = mentions.select("mention_id", "kind", text.alias("t")).where(F.length("t") > 0)
    n = names.select("kind", "entity_id", F.lower("name").alias("n")).where(F.length("n") > 0)
    q = lambda c: F.concat(grams(c, 1), grams(c, 2), grams(c, 3))
    gram_rows = n.select("kind", "entity_id", "n", F.explode_outer(F.array_distinct(q(F.col("n")))).alias("g")).where("g IS NOT NULL")
    df = gram_rows.groupBy("kind", "g").agg(F.count(F.lit(1)).alias("df"))
    asked = m.select("mention_id", "kind", "t", F.explode_outer(grams(F.col("t"), 3)).alias("g")).where("g IS NOT NULL").join(df, ["kind", "g"], "left")
    rare = top_k(asked.withColumn("df", F.coalesce("df", F.lit(0))), ["mention_id"], [F.col("df"), F.col("g")], 1)
    hit = rare.where("df > 0").join(gram_rows, ["kind", "g"]).where(F.col("n").contains(F.col("t"))).groupBy("mention_id").agg(F.count_distinct("entity_id").alias("k"), F.min("entity_id").alias("entity_id"))
    return hit.where("k = 1").select("mention_id", "entity_id")


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, names: DataFrame | None = None, tiebreaks: DataFrame | None = None, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row a mention: status, entity_id; all candidates). names turns the substring fallback on."""
    mentions = kept(mentions, "mentions")
    found = ladder(mentions, entities, aliases, fuzzy)
    out = decide(mentions, found, tiebreaks)
    if names is not None:
        rest = mentions.join(out.where("status <> 'resolved'").select("mention_id"), "mention_id", "left_semi")
        back = by_substring(rest, names).select("mention_id", F.col("entity_id").alias("_f"))
        out = out.join(back, "mention_id", "left").withColumns({"status": F.when(F.col("_f").isNotNull(), "resolved").otherwise(F.col("status")), "entity_id": F.coalesce("entity_id", "_f")}).drop("_f")
    return out, found


def ambiguous_rows(mentions: DataFrame, resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows for the candidate table: confidence = score / 100, the step as evidence."""
    open_ = resolved.where("status = 'ambiguous'").select("mention_id", "kind").join(mentions.select("mention_id", F.coalesce("hebrew_name", "english_name", F.lit("")).alias("mention_text")), "mention_id")
    return open_.join(candidates, "mention_id").select(
        F.md5(F.concat_ws("|", F.col("mention_id").cast("string"), "entity_id", "reason")).alias("candidate_id"), "mention_text", F.col("kind").alias("entity_kind"), F.col("entity_id").alias("canonical_entity_id"),
        (F.col("score") / 100.0).alias("confidence"), F.col("reason").alias("method"), F.to_json(F.struct(F.col("step").alias("match_step"))).alias("evidence"),
    )


#: Distinct texts whose results are broadcast to the claims.
FEW_TEXTS = 500_000


def slot_texts(claims: DataFrame, *columns: str) -> DataFrame:
    """The columns named, and slot, kind and value: a row for each filled slot."""
    each = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(k).alias("kind"), F.col(s).alias("value")) for s, k in SLOT_KINDS.items()])
    return claims.select(*columns, F.explode(each).alias("x")).select(*columns, "x.*").where(F.col("value").isNotNull())


def text_mentions(claims: DataFrame) -> DataFrame:
    """The distinct texts of each kind as mentions, the script deciding the name field."""
    rows, he = slot_texts(claims).select("kind", "value").distinct(), has_hebrew(F.col("value"))
    return rows.select(text_id(F.col("kind"), F.col("value")).alias("mention_id"), "kind", F.when(he, F.col("value")).alias("hebrew_name"), F.when(~he, F.col("value")).alias("english_name"))


def text_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("|"), value)


def resolve_claims(claims: DataFrame, entities: DataFrame, aliases: DataFrame, names: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Adds slot_statuses and resolved_ids (maps). Without entities (None) every present slot is resolved as it is (offline mode).

    Equal texts are resolved once. Where they are few (a checked number) their results go to the claims, which stay where they
    lie; else the claims' keys and texts go to them.
    """
    if entities is None:  # a claim's own row says it all
        present = F.map_filter(F.create_map(*[x for s in SLOT_KINDS for x in (F.lit(s), F.col(s))]), lambda _, v: v.isNotNull())
        return claims.withColumns({"slot_statuses": F.transform_values(present, lambda _, v: F.lit("resolved")), "resolved_ids": present})
    res = kept(resolve(text_mentions(claims), entities, aliases, names, fuzzy=fuzzy)[0].select("mention_id", "kind", "status", "entity_id"), "texts")
    if res.count() <= FEW_TEXTS:
        return with_broadcast_texts(claims, res)
    got = slot_texts(claims, "claim_id").select("claim_id", "slot", text_id(F.col("kind"), F.col("value")).alias("mention_id")).join(res, "mention_id")
    per = got.groupBy("claim_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "status"))).alias("slot_statuses"), F.map_from_entries(F.collect_list(F.when(F.col("entity_id").isNotNull(), F.struct("slot", "entity_id")))).alias("resolved_ids")
    )
    empty = F.create_map().cast("map<string,string>")
    out = claims.join(per, "claim_id", "left").withColumns({"slot_statuses": F.coalesce("slot_statuses", empty), "resolved_ids": F.coalesce("resolved_ids", empty)})
    return kept(out, "resolved")  # several branches read it


def with_broadcast_texts(claims: DataFrame, res: DataFrame) -> DataFrame:
    """Each slot looks its text up; slots of kinds without any text are passed over."""
    kinds = [r.kind for r in res.select("kind").distinct().collect()]
    slots, out = [s for s, k in SLOT_KINDS.items() if k in kinds], claims
    for s in slots:
        own = res.where(F.col("kind") == SLOT_KINDS[s]).select(F.col("mention_id").alias(f"_text_{s}"), F.col("status").alias(f"_status_{s}"), F.col("entity_id").alias(f"_entity_{s}"))
        out = out.join(F.broadcast(own), text_id(F.lit(SLOT_KINDS[s]), F.col(s)) == F.col(f"_text_{s}"), "left")
    of = lambda what: F.map_filter(F.create_map(*[x for s in slots for x in (F.lit(s), F.col(f"_{what}_{s}"))]).cast("map<string,string>"), lambda _, v: v.isNotNull())
    return out.select(*claims.columns, of("status").alias("slot_statuses"), of("entity").alias("resolved_ids"))


def relink(candidates: DataFrame, tasks: DataFrame, actions: DataFrame) -> DataFrame:
    """actions: task_id, action, candidate_id, new_entity_id, entity_kind. Re-points a candidate row if an entity_resolution
    task's payload names it and the kind is known."""
    kinds = ["person", "party", "office", "committee", "bill"]
    t = tasks.where("kind = 'entity_resolution'").select("task_id", F.get_json_object("payload", "$.candidate_id").alias("_c"))
    ok = actions.where((F.col("action") == "relink") & F.col("entity_kind").isin(kinds)).join(t, "task_id").where(F.col("_c") == F.col("candidate_id"))
    new = ok.groupBy("candidate_id").agg(F.max_by("new_entity_id", "action_seq").alias("_e"), F.max_by("entity_kind", "action_seq").alias("_k"))
    return candidates.join(new, "candidate_id", "left").withColumns({"canonical_entity_id": F.coalesce("_e", "canonical_entity_id"), "entity_kind": F.coalesce("_k", "entity_kind")}).drop("_e", "_k")
