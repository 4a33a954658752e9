import hashlib
import re
import string

import numpy as np

from mercato.llm import imatch as op

from . import hard

SF = "/root/testdata/sf0.01"


def brute(rows):
    """(n_chars, digest of the edited text) in descending order of doc_id."""
    rows = sorted(rows, key=lambda r: -float("inf") if r[0] is None else r[0], reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        new = t[:n - n // 2] + after[:n // 2]
        out.append((i, n, hashlib.sha256(new.encode()).hexdigest()))
    return out


def brute_terms(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {w.strip(string.punctuation) for w in words} - {""}


def test_edits_and_likeness_on_a_whole_table(spark):
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op.op8_imatch_fingerprints(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(brute(texts))
    by_text = {}
    of = {r["doc_id"]: r for r in rows}
    for i, t in texts:
        by_text.setdefault(t, set()).add(of[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    ids = sorted(of, reverse=True)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        a, b = (np.frombuffer(bytes.fromhex(of[x]["fingerprint"]), ">u4") for x in (i, after))
        assert of[i]["near_next"] == op.likeness(a, b)
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95


def test_the_lexicon_is_the_band_of_document_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = {}
    texts = [r["text"] for r in docs.collect()]
    for t in texts:
        for w in brute_terms(t):
            counts[w] = counts.get(w, 0) + 1
    want = sorted(w.encode() for w, n in counts.items() if max(2, 0.02 * len(texts)) <= n <= max(2, 0.2 * len(texts)))
    assert op.lexicon(docs, 0.02, 0.2) == want


def test_sub_lexicons_ignore_order_and_repeats():
    maker = op.Fingerprinter(sorted(f"w{i}".encode() for i in range(500)))
    a = maker.hashes("w1 w2 w3 W4 w4, unknown")
    assert (a == maker.hashes("w4 w3\nw2 w1 w1 other")).all() and (a != 0).any()
    assert (maker.hashes("unknown") == 0).all()
    b = maker.hashes("w1 w2 w3 w4 w5")
    assert 0 < op.likeness(a, b) < 1 and op.likeness(a, a) == 1 and op.likeness(a, 0 * a) == 0 and op.likeness(0 * a, 0 * a) == 1


def test_awkward_documents(spark):
    rows = hard.rows()[:-1]  # ids that repeat are tested below
    null_ids = [r for r in rows if r[0] is None][1:]
    rows = [r for r in rows if r not in null_ids]
    got = op.edited_fingerprints(hard.frame(spark, rows)).collect()
    want = brute([(r[0], r[1] or "") for r in rows])
    assert sorted(map(repr, ((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got))) == sorted(map(repr, want))
    assert op.edited_fingerprints(hard.frame(spark)).count() == len(hard.rows())
    assert op.fingerprints(hard.frame(spark)).count() == len(hard.rows())
    assert op.edited_fingerprints(hard.frame(spark, [])).count() == 0


def test_one_and_equal_ids(spark):
    one = op.edited_fingerprints(hard.plain(spark, [(5, "abcdef")])).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in one] == [(hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    same = op.edited_fingerprints(hard.plain(spark, [(5, "abcd"), (5, "abcd"), (7, "xy")])).collect()
    assert sorted(r["edited_sha256"] for r in same) == sorted(hashlib.sha256(t).hexdigest() for t in (b"xa", b"abab", b"abxy"))
