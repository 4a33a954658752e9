import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mercato.llm import simhash as op

from . import hard


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, bits):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_spark_has_the_same_hash(spark):
    rows = spark.createDataFrame([("a",), ("é b c d",), ("x" * 100,)], "t string").select("t", F.xxhash64("t")).collect()
    assert all(xxhash.xxh64_intdigest(t.encode(), 42) == h % 2 ** 64 for t, h in rows)


def test_fingerprints_of_awkward_texts():
    for r in hard.rows():
        assert op.fingerprint(r[1]) == brute_fingerprint(r[1])
    long = hard.words(random.Random(3), 300_000)  # several blocks
    assert len(long) > 1 << 20 and op.fingerprint(long) == op_whole(long)


def op_whole(text):
    w = text.encode().lower().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(len(w) - 3)], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


@pytest.mark.parametrize("max_list,bits", [(8192, 4), (3, 4), (3, 3), (8192, 2)])
def test_components_against_brute_force(spark, max_list, bits):
    """Chains and clouds of fingerprints; short lists force the midpoints."""
    rng = random.Random(max_list + bits)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        f = rng.choice(fps)
        for _ in range(rng.randrange(0, 7)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in op.connected(op.near_links(df, bits, max_list)).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_components(fps, signed, bits)
    assert len(set(want)) < len(want) - 50
    assert got == want


def test_awkward_documents(spark):
    rows = hard.rows()
    got = op.near_components(hard.frame(spark)).collect()
    assert len(got) == len(rows)
    known = [r for r in rows if r[0] is not None]
    want = dict(zip([r[0] for r in known], brute_components([brute_fingerprint(r[1]) for r in known], [r[0] for r in known], 4)))
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
            text = next(x[1] for x in rows if x[0] == r["doc_id"])
            assert r["fingerprint"] == f"{brute_fingerprint(text):016x}"
        else:
            assert r["component_id"] in want.values()


def test_near_dedup_keeps_one_and_all_columns(spark):
    docs = hard.frame(spark)
    kept = op.near_dedup(docs)
    comps = op.near_components(docs).collect()
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in comps}


def test_empty_table(spark):
    assert op.near_components(hard.frame(spark, [])).count() == 0


def test_long_chain_settles(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    assert {r["root"] for r in op.connected(links).collect()} == {0}
