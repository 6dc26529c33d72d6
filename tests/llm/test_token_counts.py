import random

import pytest
from docs import corpus, table

from verisift.llm import token_counts

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
BITS = ["<|endoftext|>", " ", "  ", "\n", "\t", "'s", "'ll", "'re", "%%%", "the", "ß", "😀", "\x1c", "\x85", "　", "½", "²", "word", "12", "日本", "é", "A", "<|", "-", "_"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts(n=1500):
    rng = random.Random(6)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(n)] + [r[1] or "" for r in corpus(3, 40)]


def test_counts_and_prefixes(library):
    c = token_counts.PrefixCounter(PATH)
    rng = random.Random(1)
    for t in texts():
        size = lambda s: len(library.encode(s, add_special_tokens=False))
        assert c.count(t) == size(t)
        ends, counts = c.store(t)
        assert (counts[-1] if counts else 0) == c.count(t)
        if len(t) < 200:
            n = rng.randrange(len(t) + 1)
            if "<|endoftext|>" not in t:
                assert c.at(t, ends, counts, n) == size(t[:n])
            fit = c.fit(t, ends, counts, 5)
            assert size(t[:fit]) <= 5 or "<|endoftext|>" in t


def test_small_memory_is_exact(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    c = token_counts.PrefixCounter(PATH)
    for t in texts(200):
        assert c.count(t) == len(library.encode(t, add_special_tokens=False))


def test_table(spark, library):
    d = table(spark, corpus()).withColumnRenamed("lang", "n")
    got = token_counts.count_tokens(d, PATH).collect()
    assert len(got) == d.count()
    for r in got:
        assert r.n_bytes == len((r.text or "").encode()) and r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False))
    cut = token_counts.truncate_to_budget(token_counts.prefix_store(d, PATH), PATH, 10).collect()
    for r in cut:
        assert len(library.encode((r.text or "")[: r.kept_chars], add_special_tokens=False)) <= 10
    assert token_counts.count_tokens(d.limit(0), PATH).count() == 0
