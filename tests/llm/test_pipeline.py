import re

import corpus_pipeline
from mercato.llm import mixing, simhash

from .test_packing import check_packed, whole_text_ids
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    language, exact, near, mixed, packed = seen
    assert all(df.columns == columns for df in seen[:-1])
    assert {r["doc_id"] for r in language.collect()} == set(rows)  # all of them are prose in a known language

    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"]), i)
    kept = sorted(first.values())
    assert sorted(r["doc_id"] for r in exact.collect()) == kept

    roots = brute_components([brute_fingerprint(rows[i]["text"]) for i in kept], kept, simhash.MAX_BITS)
    kept = sorted(set(roots))
    assert sorted(r["doc_id"] for r in near.collect()) == kept

    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(near).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert r == rows[r["doc_id"]]
    assert got == {i: c for i, c in copies.items() if c}

    taken = [i for i, c in got.items() for _ in range(c)]
    ids = list(zip(taken, whole_text_ids([rows[i]["text"] for i in taken])))
    check_packed(packed.collect(), ids, 4096)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_take_awkward_documents(spark):
    """The results that the stages' docstrings give for nulls, empty texts,
    repeated rows and empty tables."""
    import re

    from . import hard
    rows = hard.rows()
    out = {name: stage(spark, hard.frame(spark, rows), SF) for name, stage in corpus_pipeline.STAGES}
    for name in list(out)[:-1]:
        assert out[name].columns == hard.frame(spark).columns
    got = {name: [tuple(r) for r in df.collect()] for name, df in out.items()}

    assert got["language_id"] and all(any(c.isalpha() for c in r[1] or "") for r in got["language_id"])
    assert all(got["language_id"].count(r) <= rows.count(r) for r in got["language_id"])

    first = {}
    for r in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        first[text] = min(first.get(text, float("inf")), float("inf") if r[0] is None else r[0])
    assert sorted(r[0] for r in got["exact_dedup"]) == sorted(first.values())

    near = [r[0] for r in got["simhash_near_dedup"]]
    assert None not in near and len(near) == len(set(near)) and 3 in near  # the first text without words
    assert all((r[1] or "").split() for r in got["mix_sources"]) and set(got["mix_sources"]) <= set(rows)

    pieces = [r.asDict() for r in out["best_fit_packing"].collect()]
    assert sum(p["piece"] == 0 for p in pieces) == len(rows)
    assert all(p["length"] == 1 for p in pieces if p["doc_id"] in {r[0] for r in rows if r[0] is not None and not r[1]})

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, hard.frame(spark, []), SF).count() == 0
