"""Documents with every awkward case: nulls in any column, empty, blank and
long texts, copies, repeated rows, extra columns with clashing names."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "keep_id string, fp long, size string, rank int, _text string, _copies int, slice int, id string")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "one", "a\tb", "a b", "a  b", "Ünïcödé ß", base, base.replace(" ", "\n"), base + " more",
             "x " + base, "#$%", words(rng, 6000), "lll " * 400, "lll " * 300, base, None, "", words(rng, 60)]
    texts += [words(rng, rng.randrange(1, 150)) for _ in range(20)]
    out = []
    for i, t in enumerate(texts):
        out.append((i + 3, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "é"]), None))
    out.append((None, base, None, None, None))
    out.append((None, None, "en", "a", 3))
    out.append(out[8])  # a repeated row
    return [r + ("k", 7, "s", 1, "t", 5, 2, "i") for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def plain(spark, pairs):
    """Documents of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in pairs],
                                 "doc_id long, text string, lang string, source string, n_chars long")
