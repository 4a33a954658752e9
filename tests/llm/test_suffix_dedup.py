import hashlib
import random

import numpy as np
import pytest

from mercato.llm import suffix_dedup as op

from . import hard


def expected(rows, window):
    key = lambda i: float("inf") if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - window + 1):
            k = b[s:s + window]
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if first[b[s:s + window]] < key(i):
                gone[s:s + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for n in range(len(b)) if gone[n] and (n == 0 or not gone[n - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_awkward_documents(spark):
    assert found(op.remove_repeats(hard.frame(spark))) == expected([r[:2] for r in hard.rows()], op.WINDOW)


@pytest.mark.parametrize("seed, hot", [(1, op.HOT), (2, 3), (3, op.HOT)])
def test_random_documents_against_brute_force(spark, seed, hot):
    """Short windows and few letters: repeats inside and across documents,
    periodic texts, copies at the ends, several blocks, buckets and sorts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        letters = rng.choice(["a", "ab", "abcdé", "abcdefghijklmnopqrstuvwxyz ñ"])
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))
        if texts and rng.random() < 0.7:
            a = rng.choice(texts)
            cut = rng.randrange(len(a) + 1)
            t = t[:7] + a[cut:cut + rng.randrange(80)] + t[7:]
        texts.append(t)
    ids = rng.sample(range(1000), len(texts))
    docs = hard.plain(spark, zip(ids, texts))
    got = op.remove_repeats(docs, window=20, gram=9, bucket_bytes=900, hot=hot, block_bytes=700, sort_block=40, keep_bytes=True)
    assert found(got) == expected(list(zip(ids, texts)), 20)
    for r in got.collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_suffix_order_is_that_of_the_bytes():
    """The order of the places, against sorting the suffixes as bytes."""
    rng = random.Random(5)
    for letters, n in (("a", 400), ("ab", 700), ("abcd", 900)):
        text = np.frombuffer("".join(rng.choice(letters) for _ in range(n)).encode() + bytes(-n % 16 + 80), np.uint8)
        ranks = op.CoverRanks(text, 64)
        places = np.array(rng.sample(range(n), 300))
        words = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,)).astype(np.uint64)
        got = op.sorted_block(places, words[places], words[places + 8], ranks, op.shifts())
        whole = text.tobytes()
        assert [whole[p:p + 50] for p in got] == sorted(whole[p:p + 50] for p in places)
        assert sorted(got) == sorted(places)


def test_empty_table(spark):
    assert op.remove_repeats(hard.frame(spark, [])).count() == 0
