import functools
import hashlib
import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from mercato.llm import token_alignment as op

from . import hard


@functools.cache
def reference():
    made = Tokenizer.from_file(op.tokenizer_paths()[0])
    made.encode_special_tokens = True
    return made


def whole_text(own, text):
    """Ids of a whole text at once, without segments; None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    a = reference().encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    if b"".join(own.a_bytes[i] for i in a) != data or b"".join(own.b_bytes[i] for i in b) != data:
        return None
    return a, b


def expected(rows):
    own = op.Tokenizers.get(op.tokenizer_paths())
    made, counts = [], Counter()
    for _, text in rows:
        ids = whole_text(own, text)
        if ids is None:
            made.append(None)
            continue
        spans = []
        for tokens, data in zip(ids, (own.a_bytes, own.b_bytes)):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(data[t]), t))
                at += len(data[t])
            spans.append(out)
        links, j = [], 0
        for x, y, a in spans[0]:
            while j and spans[1][j - 1][1] > x:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < y:
                if spans[1][j][1] > x:
                    links.append((a, spans[1][j][2]))
                j += 1
        both = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        groups, i, j = [], 0, 0
        for end in both:
            parts = []
            for k, s in ((i, spans[0]), (j, spans[1])):
                n = k
                while n < len(s) and s[n][1] <= end:
                    n += 1
                parts.append((",".join(str(t) for _, _, t in s[k:n]), n))
            (pa_, i), (pb, j) = parts
            groups.append(f"{pa_}|{pb}")
        counts.update(links)
        made.append((len(ids[0]), len(ids[1]), groups, links))
    top = {}
    for (a, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for (i, _), m in zip(rows, made):
        if m is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = m
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                        sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr), counts


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hostile(rng, n):
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "▁", "\x00", "\x1c", "\x85", "a", "the", "The", "'s", "'ll", "é", "é", "ﬁ", "漢字",
             "🙂", "​", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "123", ".", "...", "#", "_", "Ünï", "м", "﻿", "internationalization"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(n)))


def test_hostile_documents_against_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, hostile(rng, 40)) for i in range(400)]
    rows += [(i, t) for i, t, *_ in hard.rows()] + [(7000, "x" * 5000), (7001, " ".join("ab" * rng.randrange(9) for _ in range(3000)))]
    want, counts = expected(rows)
    made = op.Alignment(hard.plain(spark, rows), block_bytes=3000, buckets=7)
    assert found(made.documents()) == want
    assert {(r.a_id, r.b_id): r.n for r in made.counts().collect()} == counts
    assert sum(w[1] > 0 for w in want) > 200 and sum(w[1] == 0 for w in want) > 20


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(op, "FAN", 2)
    rows = [(i, f"the cat {i % 7} sat, on {i} mats. " * (i % 5)) for i in range(60)]
    made = op.Alignment(hard.plain(spark, rows), block_bytes=300, buckets=3)
    assert made.leaves > 8
    assert found(made.documents()) == expected(rows)[0]


def test_long_texts_are_cut_in_steps(monkeypatch):
    monkeypatch.setattr(op, "_STEP", 50)
    rng = random.Random(1)
    for _ in range(100):
        text = hostile(rng, 200)
        parts = list(op.segments(text))
        assert "".join(s for p in parts for s in p) == " " + text
        assert all(s.startswith(" ") for p in parts for s in p)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        made = op.PerfectHash.unpacked(op.PerfectHash.of(keys).packed())
        assert sorted(made.places(keys).tolist()) == list(range(len(keys)))


def test_awkward_and_empty_tables(spark):
    assert found(op.Alignment(hard.frame(spark)).documents()) == expected([r[:2] for r in hard.rows()])[0]
    assert op.Alignment(hard.frame(spark, [])).documents().count() == 0
