import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mercato.llm import exact_dedup as op

from . import hard


def expected(rows):
    norm = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_groups_of_awkward_documents(spark):
    assert found(op.exact_groups(hard.frame(spark))) == expected(hard.rows())


def test_chunks_of_equal_hash_are_told_apart(spark):
    """A hash of three values: identifiers rest on the chunk texts."""
    got = op.exact_groups(hard.frame(spark), chunk_hash=lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("long"),
                          min_chars=4, max_chars=20)
    assert found(got) == expected(hard.rows())


def test_chunks_join_to_the_text_and_follow_its_content(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aeinostrldm") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    df = spark.createDataFrame([(text,), ("zz" * 40 + text,), ("",)], "t string")
    a, b, none = (r[0] for r in df.select(op.chunks_of(F.col("t"))).collect())
    assert "".join(a) == text and none == []
    assert max(map(len, a)) <= op.MAX_CHARS + 3
    assert len(set(a) & set(b)) > len(a) // 2  # cuts come back after an insertion


def test_dedup_keeps_all_columns_and_one_of_each(spark):
    docs = hard.frame(spark)
    kept = op.dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert set(ids) == {e[0] for e in expected(hard.rows()) if e[3]}


def test_empty_table(spark):
    assert op.exact_groups(hard.frame(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = op.exact_groups(hard.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("script", ["latin", "cyrillic", "greek", "arabic", "han", "kana", "hangul", "thai"])
def test_chunks_survive_an_insertion_in_any_script(spark, script):
    """A text with characters put in front, and one changed in its middle,
    share most chunks with the text."""
    rng = random.Random(script)
    first, last, spaced = {"latin": (0x61, 0x7A, True), "cyrillic": (0x430, 0x44F, True), "greek": (0x3B1, 0x3C9, True),
                           "arabic": (0x627, 0x64A, True), "han": (0x4E00, 0x9FA5, False), "kana": (0x3041, 0x3093, False),
                           "hangul": (0xAC00, 0xD7A3, False), "thai": (0xE01, 0xE2E, False)}[script]
    letters = [chr(c) for c in range(first, last + 1)]
    text = (" " if spaced else "").join("".join(rng.choices(letters, k=rng.choice([1, 2, 2, 3, 4, 5, 6, 7, 8, 9])))
                                        for _ in range(6000))
    half = len(text) // 2
    texts = [text, letters[0] * 3 + text, text[:half] + letters[1] + text[half:]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(op.chunks_of(F.col("text"))).collect()]
    assert ["".join(c) for c in got] == texts
    assert max(map(len, got[0][:-1])) <= op.MAX_CHARS + 8 and len(got[0]) >= 20
    for other in got[1:]:
        assert len(set(got[0]) & set(other)) > 0.6 * len(got[0])


def test_texts_are_normalised_and_cut_once(spark):
    """No filter below the cut repeats it for every text."""
    text = hard.frame(spark).select("doc_id", op.normalised(op.text_or_empty()).alias("_text"))
    chunked = text.select("doc_id", "_text", op.chunks_of(F.col("_text")).alias("_chunks"))
    plan = op.distinct_chunks(chunked, F.xxhash64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "Filter (size" not in plan
