import hashlib
import random
import re

import pytest

from mercato.llm import substring_dedup as op

from . import hard


def expected(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < key(i):
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_awkward_documents(spark):
    rows = hard.rows()
    got = op.remove_repeats(hard.frame(spark))
    assert found(got) == expected([r[:2] for r in rows], op.WINDOW)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents_against_brute_force(spark, seed):
    """Few words, short windows: repeats inside documents, across documents,
    overlapping, periodic, at the ends; several slices."""
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        t = hard.words(rng, rng.randrange(0, 40), vocabulary=rng.choice([1, 2, 4, 50]))
        if texts and rng.random() < 0.6:
            a, b = rng.choice(texts).split(), t.split()
            cut = rng.randrange(len(a) + 1)
            t = " ".join(b[:5] + a[cut:cut + rng.randrange(30)] + b[5:])
        texts.append(t)
    ids = rng.sample(range(1000), len(texts))
    docs = hard.plain(spark, zip(ids, texts))
    got = op.remove_repeats(docs, window=6, gram=2, slice_anchors=50, keep_text=True, piece=7)
    assert found(got) == expected(list(zip(ids, texts)), 6)
    for r in got.collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_null_and_repeated_ids_in_many_slices(spark):
    """Equal rows without an id fall into several slices; none removes the
    words of another."""
    rng = random.Random(5)
    shared = hard.words(rng, 30, vocabulary=500)
    rows = [(None, shared)] * 40 + [(None, f"{k} {shared}") for k in range(20)] + [(7, shared), (7, "x " + shared), (3, shared[len(shared) // 2:])]
    got = op.remove_repeats(hard.plain(spark, rows), window=6, gram=2, slice_anchors=30)
    assert found(got) == expected(rows, 6)
    candidates, _ = op.dealt_out(op.numbered(hard.plain(spark, rows)), 6, 2, 30)
    assert candidates.where("doc_id is null").select("slice").distinct().count() > 5


def test_a_shared_footer_sends_no_passages(spark):
    """Pairs of copies with one 30-word footer in all documents: passages sent
    to slices grow with the documents, since copies alone share windows."""
    rng = random.Random(9)
    footer = hard.words(rng, 30, vocabulary=1000)
    sent = []
    for n in (100, 200, 400):
        texts = [f"{hard.words(rng, 120, vocabulary=5000)} {footer}" for _ in range(n // 2)]
        docs = hard.plain(spark, enumerate(texts + texts))
        candidates, needed = op.dealt_out(op.numbered(docs), op.WINDOW, op.GRAM, 40)
        assert candidates.select("slice").distinct().count() > n // 10
        sent.append(needed.count())
    assert sent == [50, 100, 200]


def test_empty_table(spark):
    assert op.remove_repeats(hard.frame(spark, [])).count() == 0
