import collections
import math
import random
import re

import numpy as np
import pytest
from docs import DOCS, corpus, table

from verisift.llm import quality_outliers as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = collections.defaultdict(list), set()
    for k in range(len(w) - 2):
        seen[tuple(w[k : k + 3])].append(k)
    for places in seen.values():
        if len(places) > 1:
            for k in places:
                covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed), len(lines)


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def vector(m, n_lines):
    n, chars, symbols, dup, rep = m[:5]
    x = [math.log(n + 1), math.log(max(chars, 1) / max(n, 1)), math.sqrt(symbols / max(n, 1)), math.sqrt(dup / max(n_lines, 1)), math.sqrt(rep / max(n, 1))]
    return tuple(half_up(q.SCALE * v) for v in x)


def share(values, a, b):
    """The bucket in which the share is reached."""
    buckets = sorted(math.floor(q.BUCKETS * math.log2(max(v, 1e-6))) for v in values)
    return buckets[-(-len(buckets) * a // b) - 1], [math.floor(q.BUCKETS * math.log2(max(v, 1e-6))) for v in values]


def d2(x, mean, cov):
    r = x - mean
    return (r * np.linalg.solve(cov, r.T).T).sum(axis=1)


FLOOR = np.diag((np.array(q.SPREAD) * q.SCALE) ** 2)


def moments(x):
    return x.mean(axis=0), np.cov(x.T, bias=True) + FLOOR


def mcd(x):
    """Mean, covariance and factor of one group's vectors, by numpy."""
    n = len(x)
    order = np.sort(x, axis=0)
    at = [order[-(-n * k // 4) - 1] for k in (1, 2, 3)]
    med, sd = at[1].astype(float), np.maximum((at[2] - at[0]) / 1.349, np.array(q.SPREAD) * q.SCALE)
    z = (x - med) / sd
    whole = np.vectorize(half_up)
    t, u = whole(1024 * np.tanh(z)).astype(float), whole(1024 * z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]).astype(float)
    c = np.cov(t.T, bias=True)
    v = np.sqrt(np.diag(c) + 1)
    r1 = c / np.outer(v, v)
    np.fill_diagonal(r1, 1)
    found = []
    for start in (np.eye(5), r1, (u.T @ u) / n * 5 / 1024**2 + 0.01 * np.eye(5)):
        mean, cov = med, start * np.outer(sd, sd)
        for _ in range(q.TRIAL_STEPS):
            cut, b = share(d2(x, mean, cov), *q.SUBSET)
            mean, cov = moments(x[np.array(b) <= cut])
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: round(f[0], 9))
    for _ in range(q.MOST_STEPS - q.TRIAL_STEPS):
        cut, b = share(d2(x, mean, cov), *q.SUBSET)
        mean, cov = moments(x[np.array(b) <= cut])
    factor = lambda d: max(2 ** ((share(d, 1, 2)[0] + 1) / q.BUCKETS) / q.chi_square(0.5), 1)
    d = d2(x, mean, cov)
    mean, cov = moments(x[d / factor(d) <= q.chi_square(0.975)])
    return mean, cov, factor(d2(x, mean, cov))


def brute(rows):
    got = [(*measures(r[1]), r) for r in rows]
    distinct = {(r[2], r[3], n, m[:5]) for m, n, r in got if not m[5]}
    sizes = collections.Counter(k[:2] for k in distinct)
    pooled = collections.Counter()
    for (lang, _), n in sizes.items():
        pooled[lang] += n if n < q.LEAST_ROWS else 0
    name = {k: (k if n >= q.LEAST_ROWS else (k[0],) if pooled[k[0]] >= q.LEAST_ROWS else ()) for k, n in sizes.items()}
    groups = collections.defaultdict(list)
    for lang, source, n, m in distinct:
        groups[name[lang, source]].append(vector(m, n))
    fits = {g: mcd(np.array(sorted(x))) for g, x in groups.items()}
    out = []
    for m, n, r in got:
        dist = None
        if not m[5]:
            mean, cov, factor = fits[name[r[2], r[3]]]
            dist = float(d2(np.array([vector(m, n)], float), mean, cov)[0] / factor)
        out.append((r[0], *m, dist, not m[5] and dist <= q.chi_square(1 - q.TAIL)))
    return out, set(name.values())


def compare(spark, rows, parts=3):
    want, groups = brute(rows)
    key = lambda t: tuple(str(v) for v in t[:7])
    got = sorted((tuple(r) for r in q.quality(table(spark, rows).repartition(parts)).collect()), key=key)
    want = sorted(want, key=key)
    assert [g[:7] + g[8:] for g in got] == [w[:7] + w[8:] for w in want]
    assert all((g[7] is None) == (w[7] is None) and (g[7] is None or g[7] == pytest.approx(w[7], rel=1e-6, abs=1e-6)) for g, w in zip(got, want, strict=True))
    return got, groups


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    """The registered query's test makes them all."""
    monkeypatch.setattr(q, "MOST_STEPS", 4)


def prose(rng, n):
    return [rng.choice("an or the then erst thing other".split()) + rng.choice(["", "e", "ed", "ing"]) + str(rng.randrange(60)) for _ in range(n)]


def sample(seed=11, n=330):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = prose(rng, rng.randrange(50, 400))
        text = " ".join(w[:30]) + "\n" + " ".join(w[30:])
        if i % 9 == 0:
            text = " ".join(x + " #<>|" for x in w)  # symbols
        elif i % 23 == 1:
            text = " ".join(x * 6 for x in w)  # long words
        elif i % 11 == 2:
            text += "\n" + text.split("\n")[0]  # a repeated line
        elif i % 13 == 3:
            text = " ".join(w[:10] * 9)  # fails the base rules
        rows.append((i, text, "en" if i % 3 else "de", ["a", "b", None][min(i % 7, 2)], len(text)))
    return rows


def test_measures(spark):
    odd = ["", None, " \t\n", "a b c a b c", "a b c d", "x\n\nx\r\n x\nx", "é ü 日本 é ü 日本\x0b#*$%&|<>", "a  b\x0cc", "a b a b a b", "one\n" * 60, "w " * 20_000, " ".join(map(str, range(60))), "\xa0 \xa0 \xa0 \xa0", "\x1f\x1f a\x1c b"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(odd)] + corpus(3, 80)
    got = q.measured(table(spark, rows)).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.doc_id, *(r[c] for c in q.MEASURES), r.base_failed) for r in got), key=key) == sorted(((r[0], *measures(r[1])[0]) for r in rows), key=key)


def test_equals_numpy(spark):
    """Whole estimates against numpy, whatever the partitioning; symbols and long words are rejected, prose and repeated lines stay."""
    rows = sample()
    got, groups = compare(spark, rows)
    assert len(groups) > 1 and () in groups or ("de",) in groups
    kept = {g[0]: g[8] for g in got if not g[6]}
    junk = {r[0] for r in rows if r[0] % 9 == 0 or r[0] % 23 == 1 and r[0] % 9}
    assert not any(kept.get(i) for i in junk)
    assert all(v for i, v in kept.items() if i not in junk)
    assert got == sorted((tuple(r) for r in q.quality(table(spark, rows).repartition(11)).collect()), key=lambda t: tuple(str(v) for v in t[:7]))


def test_nulls_copies_and_few_rows(spark):
    """Copies do not take an estimate over, few rows share one, null languages and sources are groups."""
    rows = sample(5, 140)
    hot = rows[4]
    rows += [(1000 + i, *hot[1:]) for i in range(300)] + [(2000, None, None, None, None), (None, hot[1], None, "z", 1), (2001, " ".join(prose(random.Random(1), 70)), "xx", None, 1), hot]
    got, _ = compare(spark, rows)
    kept = {g[0]: g[8] for g in got}
    assert all(kept[1000 + i] for i in range(300)) and kept[2001] and not kept[2000]


def test_join_beyond_few_groups(spark, monkeypatch):
    monkeypatch.setattr(q, "FEW_GROUPS", 0)
    monkeypatch.setattr(q, "LEAST_ROWS", 30)
    compare(spark, sample(7, 200))


def test_empty_tables_and_clashing_columns(spark):
    assert q.quality(table(spark, [])).collect() == []
    assert [r.kept for r in q.quality(table(spark, [(1, "short", "en", "a", 1)])).collect()] == [False]
    extra = spark.createDataFrame([(1, "a b", "en", "a", 1, 2, "x")], DOCS + ", x0 long, __words string")
    assert [(r.doc_id, r["__words"], r.n_words) for r in q.quality(extra, keep=("doc_id", "__words")).collect()] == [(1, "x", 2)]
    assert q.measured(extra).columns[:7] == extra.columns


def test_chi_square():
    assert [round(q.chi_square(p), 3) for p in (0.5, 0.975, 0.999)] == [4.351, 12.833, 20.515]
