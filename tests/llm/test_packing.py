import random
import zlib

import numpy as np
import pytest

from mercato.llm import packing as op

from . import hard


def whole_text_ids(texts):
    """The tokenizer's own ids of whole texts, then the end id."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(op.tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, op.END_ID], "<u4") for x in texts]


def check_packed(rows, ids, capacity):
    """Pieces are the documents cut as they must be; sequences are gapless."""
    want = sorted((repr(i), p, p * capacity, len(x[p * capacity:(p + 1) * capacity]), zlib.crc32(x[p * capacity:(p + 1) * capacity].tobytes()))
                  for i, x in ids for p in range(-(-len(x) // capacity)))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_awkward_documents(spark):
    rows = hard.rows()
    for capacity in (op.CAPACITY, 64):
        got = op.pack(hard.frame(spark), capacity=capacity).collect()
        ids = list(zip([r[0] for r in rows], whole_text_ids([r[1] for r in rows])))
        n = check_packed(got, ids, capacity)
        assert n <= -(-sum(len(x) for _, x in ids) // capacity) + 2
    assert op.pack(hard.frame(spark, [])).count() == 0


def test_words_give_the_ids_of_whole_texts():
    texts = ["don't 'S foo's İstanbul ΣΑΣ 12ab a1", "a\x1cb <|endoftext|> x<|ENDOFTEXT|>", "ß. ẞ!! ﬀ, É́a ǅ", "x" * 5000, "", " ",
             "a  b​c", *[hard.words(random.Random(1), 500)] * 2]
    coder = op.WordIds(op.tokenizer_path())
    want = [x[:-1].tobytes() for x in whole_text_ids(texts)]
    assert [coder.encode(t) for t in texts] == want == [coder.encode(t) for t in texts]
    assert all(len(w) <= op.LONG_WORD for w in coder.known)


def naive_best_fit(lengths, capacity):
    """Best fit of items from the longest on, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 97])
    lengths = [min(capacity, 1 + int(rng.expovariate(rng.choice([0.05, 0.3])))) for _ in range(rng.randrange(1, 500))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, sequences = op.plan_runs(counts, capacity)
    seats = {}
    for n in counts:
        own = sorted(r for r in runs if r[0] == n)
        assert [r[1] for r in own] == [0, *[r[2] for r in own[:-1]]] and own[-1][2] == counts[n]
        for _, first, last, sequence, each, offset in own:
            for i in range(first, last):
                seats.setdefault(sequence + (i - first) // each, []).append((offset + (i - first) % each * n, n))
    assert sorted(seats) == list(range(sequences))
    for places in seats.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in places) <= 2
    assert -(-sum(lengths) // capacity) <= sequences <= naive_best_fit(lengths, capacity)


def test_kept_ids(spark):
    row = op.token_pieces(hard.plain(spark, [(1, "one two")]), keep_ids=True).collect()[0]
    assert zlib.crc32(row["ids"]) == row["ids_crc32"] and len(row["ids"]) == 4 * row["length"]
