import pytest

from mercato.llm import mixing as op

from . import hard

SF = "/root/testdata/sf0.01"


def fill(sizes, weights, total, cap):
    """Targets by sharing again and again."""
    target, full = {s: 0.0 for s in sizes}, set()
    while True:
        left = total - sum(target[s] for s in full)
        free = [s for s in sizes if s not in full]
        for s in free:
            target[s] = left * weights[s] / sum(weights[x] for x in free)
        over = [s for s in free if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            full.add(s)


def test_targets_fill_like_water(spark):
    rows = op.mixture(spark.read.parquet(f"{SF}/documents.parquet")).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        sizes[r["source"]], targets[r["source"]] = r["source_size"], r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s]


def test_awkward_documents_and_reruns(spark):
    docs = hard.frame(spark)
    first = sorted(map(repr, op.mixture(docs).collect()))
    assert first == sorted(map(repr, op.mixture(docs.repartition(7)).collect()))
    rows = op.mixture(docs).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        by_source.setdefault(r["source_size"], []).append(r)
    assert sum(len(x) for x in by_source.values()) == len(rows)
    assert sum(r["target"] for r in {(r["source_size"], r["target"]): r for r in rows}.values()) == pytest.approx(
        1.5 * sum(r["size"] for r in rows))


def test_the_mix_repeats_rows(spark):
    docs = hard.frame(spark, [r for r in hard.rows() if r[0] is not None][:-1])
    copies = {r["doc_id"]: r["copies"] for r in op.mixture(docs).collect()}
    mixed = op.mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: c for i, c in copies.items() if c}


def test_no_words_and_no_rows(spark):
    rows = op.mixture(hard.plain(spark, [(1, None), (2, "  ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
    assert op.mixture(hard.frame(spark, [])).count() == 0


def test_a_long_document_does_not_end_the_sample(spark):
    """One document holds half of its source, 200 small ones the rest; with
    copies, half of the source is to be sampled. Wherever the long one comes
    in the order, the words taken come near the target."""
    for seed in ("a", "b", "c", "d"):
        rows = [(i, "w " * 20) for i in range(200)] + [(1000, "w " * 4000)]
        docs = hard.plain(spark, rows)
        got = op.mixture(docs, share=1.5, seed=seed).collect()
        assert abs(sum(r["taken"] for r in got) - got[0]["target"]) < 20


def brute_mix(rows, weights=(5, 2, 1), share=1.5, cap=2, seed=op.SEED):
    """doc_id -> words taken, source by source and document by document."""
    import hashlib
    import math
    sized = {}
    for i, text, source in rows:
        u = (int(hashlib.md5(f"{i}|{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        sized.setdefault(source, []).append((i, len((text or "").split()), u))
    size = {s: sum(n for _, n, _ in x) for s, x in sized.items()}
    goal = fill(size, {s: weights[i % 3] for i, s in enumerate(sorted(size))}, share * sum(size.values()), cap)
    out = {}
    for s, docs in sized.items():
        whole = math.floor(goal[s] / size[s] + 1e-12) if size[s] else 0
        rest = goal[s] - whole * size[s]
        certain = set()
        while True:
            free = [(i, n, u) for i, n, u in docs if i not in certain and n]
            left = max(0, rest - sum(n for i, n, _ in docs if i in certain))
            c = left / sum(n * n for _, n, _ in free) if free else 0
            new = {i for i, n, _ in free if c * n >= 1}
            if not new:
                break
            certain |= new
        order = sorted(free, key=lambda d: math.log(d[2] / (1 - d[2])) - (math.log(c * d[1] / (1 - c * d[1])) if c else 0))
        extra, gap, spare = set(certain), left, order
        run, stopped = 0, []
        for i, n, _ in order:
            if not stopped and run + n <= left:
                run += n
                extra.add(i)
            else:
                stopped.append((i, n))
        gap, spare = left - run, stopped
        while spare:
            near = min(spare, key=lambda d: abs(gap - d[1]))
            miss = min(gap, abs(gap - near[1]))
            if miss < min(n for _, n in spare):
                break
            taken, run = [], 0
            for d in [d for d in spare if d[1] <= gap]:
                if run + d[1] > gap:
                    break
                run += d[1]
                taken.append(d)
            if not taken:
                break
            gap -= run
            extra |= {i for i, _ in taken}
            spare = [d for d in spare if d not in taken]
        misses = [(abs(gap - n), u, i) for i, n, u in docs if i not in extra and n and abs(gap - n) < gap]
        if misses:
            extra.add(min(misses)[2])
        for i, n, _ in docs:
            out[i] = n * (whole + (i in extra)) if n else 0
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_whole_rule_against_brute_force(spark, seed):
    """Long documents, equal ones, sources that fill up and that do not."""
    import random
    rng = random.Random(seed)
    rows = []
    for source in "abcdef":
        for _ in range(rng.choice([3, 30, 120])):
            n = rng.choice([0, 1, rng.randrange(1, 40), rng.randrange(200, 900)]) if rng.random() < 0.9 else 4000
            rows.append((len(rows), "w " * n, source))
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["taken"] for r in op.mixture(docs).collect()}
    assert got == brute_mix(rows)


def test_odds_grow_with_the_words(spark):
    """Over many seeds, a document of three times the words is sampled about
    three times as often, and one whose odds pass 1 always."""
    rows = [(i, "w " * (10 if i % 2 else 30)) for i in range(60)] + [(99, "w " * 900)]
    often = {}
    for seed in range(12):
        for r in op.mixture(hard.plain(spark, rows), share=1.6, max_copies=2, seed=str(seed)).collect():
            often[r["size"]] = often.get(r["size"], 0) + r["copies"] - 1
    assert often[900] == 12
    assert 2 < often[30] / often[10] < 5
