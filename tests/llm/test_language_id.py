import zlib

import numpy as np

from mercato.llm import language_id as op

from . import hard

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op.predictions(docs, max_train=400, landmarks=100).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache()
    copies = docs.selectExpr("doc_id + 100000000 as doc_id", "text", "cast(null as string) lang", "'zz' source", "n_chars")
    rows = op.predictions(docs.unionByName(copies), max_train=200, landmarks=50).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"] % 100000000, set()).add((r["lang_pred"], round(r["score"], 5)))
    assert all(len(x) == 1 for x in by.values())


def test_und_and_awkward_documents(spark):
    rows = op.predictions(hard.frame(spark)).collect()
    assert len(rows) == len(hard.rows())
    texts = {r[0]: r[1] for r in hard.rows() if r[0] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            none = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == none and (r["score"] == 0) <= none
    kept = op.keep_identified(hard.frame(spark))
    assert kept.columns == hard.frame(spark).columns
    assert 12 not in [r["doc_id"] for r in kept.collect() if r["text"] is None]


def test_nothing_to_learn_from(spark):
    docs = hard.plain(spark, [(1, "abc"), (2, None)]).selectExpr("doc_id", "text", "cast(null as string) lang", "source")
    assert {(r["lang_pred"], r["score"]) for r in op.predictions(docs).collect()} == {("und", 0.0)}
    assert op.predictions(hard.frame(spark, [])).count() == 0


def test_presence_is_the_set_of_ngrams_at_any_length():
    text = "abcd éfg " * 50000  # longer than a slice
    whole = op.presence([text])
    assert whole.sum() == op.presence(["abcd éfg abcd éfg abcd"]).sum()
    a, b = op.presence(["abc", "xyz"])
    assert (np.concatenate([op.presence(["abc"]), op.presence(["xyz"])]) == np.stack([a, b])).all()


def test_nystroem_with_all_rows_as_landmarks_is_kernel_ridge():
    texts = ["the cat and the dog", "der hund und die katze", "the house of the man", "das haus von dem mann", "le chat et le chien"]
    langs = ["en", "de", "en", "de", "fr"]
    sample = sorted((n, np.packbits(op.presence([t]), axis=1).tobytes(), i) for i, (n, t) in enumerate(zip(langs, texts)))
    names, w = op.fit(sample, landmarks=5, ridge=1e-3)
    x = op.unit(op.presence([texts[s[2]] for s in sample]))
    k = (x @ x.T).astype(float)
    y = np.array([[1.0 if s[0] == n else -1.0 for n in names] for s in sample])
    exact = k @ np.linalg.solve(k + 1e-3 * 5 * np.eye(5), y)
    assert np.abs(x @ w - exact).max() < 1e-3


def test_texts_of_an_unlearned_script_are_not_identified(spark):
    import random
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(1500)

    def prose(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    greek, kana = "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x3042, 0x3090)))
    strange = [(-i - 1, prose(a, n), None, "x", None) for i, (a, n) in enumerate(
        [(greek, 5), (greek, 100), (greek, 3000), (kana, 5), (kana, 100), (kana, 3000)])]
    both = docs.unionByName(spark.createDataFrame(strange, docs.schema))
    for less in (docs, docs.where("lang in ('en', 'de')")):  # whatever the number of languages
        kept = {r["doc_id"] for r in op.keep_identified(less.unionByName(both.where("doc_id < 0")), max_train=400).collect()}
        assert kept == {r["doc_id"] for r in less.select("doc_id").collect()}


def test_numbers_and_keys_do_not_hide_the_language():
    text = 'Whoron, on 4163591243156570 it token = "2f6b80d240108f566bc3c38f339eaad41510fe0e" thhash o'
    assert op.prose(text).split() == ["Whoron,", "on", "it", "token", "=", "thhash", "o"]
    assert op.prose("12a4 5") == "12a4 5"


def test_rows_that_share_an_id_are_learned(spark):
    import random
    rng = random.Random(3)
    for shared in (1, 4):  # ids that are not held out
        assert zlib.crc32(str(shared).encode()) % 4 != 2
        rows = [(shared, "der hund und die " + "".join(rng.choice("abcdefgh") for _ in range(9)), "de", "s", None) for _ in range(3000)]
        rows += [(100 + i, "the dog and the " + "".join(rng.choice("abcdefgh") for _ in range(9)), "en", "s", None) for i in range(500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        sample = op.train_rows(docs, 200)
        assert [sum(s[0] == lang for s in sample) for lang in ("de", "en")] == [100, 100]
        assert sample == op.train_rows(docs.repartition(7).unionByName(docs), 200)  # repeated rows change nothing
        pred = op.predictions(docs, 200, 50).where(f"doc_id = {shared}").select("lang_pred").distinct().collect()
        assert [r[0] for r in pred] == ["de"]


def test_more_languages_than_rows_to_learn_from(spark):
    rows = [(i, f"text {i}", f"l{i % 40:02d}" if i < 400 else "many", "s", None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sample = op.train_rows(docs, 10)
    assert len(sample) == 10 and "many" in {s[0] for s in sample}


def test_whole_table_against_plain_kernel_ridge(spark):
    """The registered query against a ridge on sets of n-grams of every
    usable row: no hashing, no landmarks, no sample."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r["lang_pred"] for r in op.op4_language_id(spark, SF).collect()}
    assert len(got) == len(docs)

    def grams(text):
        text = " ".join(text.lower().replace("\0", " ").split())
        return {text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    lettered = [(r, grams(r["text"])) for r in docs if any(c.isalpha() for c in r["text"] or "")]
    place = {g: i for i, g in enumerate(sorted(set().union(*(g for _, g in lettered))))}
    x = np.zeros((len(lettered), len(place)), np.float32)
    for row, (_, own) in zip(x, lettered):
        row[[place[g] for g in own]] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    learn = [i for i, (r, _) in enumerate(lettered) if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    names = sorted({lettered[i][0]["lang"] for i in learn})
    y = np.array([[1.0 if lettered[i][0]["lang"] == n else -1.0 for n in names] for i in learn])
    k = (x @ x[learn].T).astype(float)
    values = k @ np.linalg.solve(k[learn] + op.RIDGE * len(learn) * np.eye(len(learn)), y)
    plain = {r["doc_id"]: names[v.argmax()] for (r, _), v in zip(lettered, values)}
    assert all(got[r["doc_id"]] == "und" for r in docs if r["doc_id"] not in plain)
    assert np.mean([got[i] == n for i, n in plain.items()]) >= 0.995


def test_the_kept_rows_are_those_of_the_predicted_language():
    """A text goes by the language that the kernel gives it: where the
    regression is turned round, the share of another language doesn't keep it."""
    import pyarrow as pa
    texts = ["the cat and the dog", "the house of the man", "der hund und die katze", "das haus von dem mann"]
    sample = sorted((n, np.packbits(op.presence([t]), axis=1).tobytes(), i) for i, (n, t) in enumerate(zip(["en", "en", "de", "de"], texts)))
    _, weights = op.fit(sample)
    known, bounds = op.known_places(sample)[0], np.array([0.9, 0.9])
    has, text = pa.array([True] * 4 + [False]), pa.array([*texts, None])
    assert op.recognised(has, text, weights, known, bounds).tolist() == [True] * 4 + [False]
    assert not op.recognised(has, text, -weights, known, bounds).any()
    assert not op.recognised(has, text, weights[:, :0], known[:, :0], bounds[:0]).any()
