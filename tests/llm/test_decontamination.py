import hashlib
import random
import re

from docs import corpus, table

from verisift.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = split(text)
    hit, found = set(), set()
    for ident, item in items:
        b = split(item)
        if ident is None or not b:
            continue
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(max(1, len(b) - 12))}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(ident))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(30)}" for _ in range(rng.randrange(1, 40)))) for i in range(12)]
    items += [(3, "Übung, macht DEN Meister!"), (None, "q1 q2"), (90, ""), (91, None), (92, "q1 q2 q3"), (93, "q1 q2 q3")]
    docs = [r[1] for r in corpus(2, 40)]
    for i in range(60):
        _, t = items[rng.randrange(12)]
        w = t.split()
        a = rng.randrange(len(w))
        docs.append("É; " + " ".join(f"z{rng.randrange(9)}" for _ in range(rng.randrange(30))) + " " + ", ".join(w[a : a + rng.randrange(5, 40)]).upper())
    docs += ["ÜBUNG macht den meister", "übung macht den meister", "Übung-macht-den-meister x"]
    return items, docs


def test_against_brute_force(spark):
    items, docs = cases()
    d = table(spark, [(i, t, None, None, 0) for i, t in enumerate(docs)])
    b = table(spark, items, "item_id long, text string")
    for most in (decontamination.MOST_WORDS, 60):
        got = {r.doc_id: r for r in decontamination.mark_contamination(d, b, most_words=most).collect()}
        for i, t in enumerate(docs):
            n, hit, ids, bad = brute(t, items)
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) == (n, hit, len(ids), ids, bad)
            for s in r.hit_spans:  # offsets are those of the original text
                assert split(t[s.start : s.end]) and (s.start == 0 or len(split(t[: s.start])) + len(split(t[s.start : s.end])) + len(split(t[s.end :])) == n)
            assert sum(len(split(t[s.start : s.end])) for s in r.hit_spans) == hit


def test_stage_and_edges(spark):
    items, docs = cases()
    b = table(spark, items, "item_id long, text string")
    d = spark.createDataFrame([(1, "q1 q2 q3", True), (2, "clean text", None), (3, None, None)], "doc_id long, text string, contaminated boolean")
    kept = decontamination.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    assert decontamination.mark_contamination(d.drop("contaminated"), b.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.mark_contamination(d.drop("contaminated").limit(0), b).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
