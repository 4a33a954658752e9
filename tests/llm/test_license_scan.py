import math
import random
import re

from mercato.llm import license_scan as op

from . import hard

SF = "/root/testdata/sf0.01"


def brute_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, templates=op.TEMPLATES, phrases=op.PHRASES, threshold=op.THRESHOLD, block=op.BLOCK_WORDS):
    """Every phrase at every word, every template against the block at every word."""
    w = brute_words(text)
    starts, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += hits
        base |= {label} if hits else set()
    labels, score = set(base), 1.0 if base else 0.0
    for label, texts in templates.items():
        for t in (texts,) if isinstance(texts, str) else texts:
            size = max(block, 2 * len(brute_words(t)))
            t = set(brute_words(t))
            if not t & set(w):
                continue
            best = max(len(t & set(w[s:s + size])) for s in range(len(w)) if s == 0 or w[s] in t)
            if best >= math.ceil(threshold * len(t) - 1e-9):
                labels.add(label)
                score = max(score, best / len(t))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op.op6_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == brute(texts[r["doc_id"]]), r["doc_id"]
    assert {x for r in rows for x in r["base_labels"].split(",")} >= {"mit", "apache", "gpl"}
    assert any(r["labels"] != r["base_labels"] for r in rows)


def test_random_blocks_against_brute_force(spark):
    rng = random.Random(4)
    templates = {f"t{i}": " ".join(f"v{x}" for x in rng.sample(range(30), rng.randrange(2, 12))) for i in range(8)}
    texts = [" ".join(f"v{rng.randrange(rng.choice([12, 30, 60]))}" for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    texts += ["MIT License, mit-license MIT licenses the mit license", "Général public license GENERAL PUBLIC\nLICENSE"]
    docs = hard.plain(spark, enumerate(texts))
    for threshold in (0.5, 0.8, 1.0):
        got = {r["doc_id"]: tuple(r)[1:] for r in op.scan_licenses(docs, templates, threshold=threshold, block_words=10).collect()}
        assert got == {i: brute(t, templates, threshold=threshold, block=10) for i, t in enumerate(texts)}


def test_awkward_documents(spark):
    rows = op.scan_licenses(hard.frame(spark)).collect()
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr((r[0], *brute(r[1]))) for r in hard.rows())
    assert op.scan_licenses(hard.frame(spark, [])).count() == 0


def test_long_texts_are_scanned_in_parts(monkeypatch):
    rng = random.Random(9)
    templates = {f"t{i}": " ".join(f"v{x}" for x in rng.sample(range(25), 6)) for i in range(5)}
    scanner = op.Scanner(templates, op.PHRASES, 0.8, 10, {})
    monkeypatch.setattr(op, "SEGMENT", 200)
    for _ in range(300):
        n = rng.randrange(0, 400)
        text = " ".join(rng.choice(["mit", "license", "apache", "-", *[f"v{rng.randrange(25)}"] * 2]) for _ in range(n))
        assert scanner.scan_text(text) == brute(text, templates, threshold=0.8, block=10)


def test_a_copy_is_found_wherever_it_starts():
    rng = random.Random(12)
    for n in (3, 60, 100, 200):
        words = [f"v{rng.randrange(n)}" for _ in range(n // 4)] + [f"v{i}" for i in range(n)]
        scanner = op.Scanner({"t": " ".join(words)}, {}, 0.8, 64, {})
        for before in range(130):
            text = " ".join(["x"] * before + words + ["y"] * 90)
            assert scanner.scan_text(text)[5:] == ("t", 1.0), (n, before)
        # every second word foreign, so that the copy fills its longest block
        spread = " ".join(x for w in words for x in (w, "z"))
        assert scanner.scan_text(spread)[5:] == ("t", 1.0)


def test_blocks_that_just_meet_or_miss_the_threshold():
    words = [f"v{i}" for i in range(50)]
    scanner = op.Scanner({"t": " ".join(words)}, {}, 0.8, 64, {b"v3": 7, b"v9": 2})
    for gap in range(0, 120):
        for missing in (9, 10, 11):
            text = " ".join(words[:20] + ["x"] * gap + words[20:50 - missing] + ["y"] * 30)
            assert scanner.scan_text(text) == brute(text, {"t": " ".join(words)}, {}, 0.8, 64), (gap, missing)


def test_whole_license_texts(spark):
    longest = {label: max([t] if isinstance(t, str) else t, key=len) for label, t in op.TEMPLATES.items()}
    docs = hard.plain(spark, [(i, ("some words " * i) + t.upper() + " more" * i) for i, t in enumerate(longest.values())])
    for r in op.scan_licenses(docs).collect():
        assert list(longest)[r["doc_id"]] in r["labels"].split(",") and r["score"] == 1.0
