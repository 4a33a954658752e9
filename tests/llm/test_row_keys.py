"""The stages judge rows: null and repeated ids take no other row with them."""

from mercato.llm import exact_dedup, language_id, mixing, simhash

from . import hard

PROSE = ["the cat sat on the mat with the dog", "a house stands by the river in the valley",
         "we went to the market to buy bread and milk", "rain falls on the green hills of the north"]


def texts(df):
    return sorted(r["text"] or "" for r in df.collect())


def test_a_rejected_row_takes_no_other_null_id(spark):
    known = [(i, t) for i, t in enumerate(PROSE * 3)]
    docs = hard.plain(spark, known + [(None, t) for t in PROSE] + [(None, "123 #"), (3, None)])
    assert texts(language_id.keep_identified(docs)) == sorted([t for _, t in known] + PROSE)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(None, "a b"), (None, "a  b"), (None, "c"), (None, "d"), (5, "e"), (5, "e"), (5, "f"), (None, "e"), (7, "d"), (8, "g")]
    assert texts(exact_dedup.dedup(hard.plain(spark, rows)))[1:] == ["c", "d", "e", "f", "g"]
    kept = [tuple(r) for r in exact_dedup.dedup(hard.plain(spark, rows)).select("doc_id", "text").collect()]
    assert len(kept) == 6 and (7, "d") in kept and (5, "e") in kept


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rows = [(None, t) for t in PROSE] + [(None, PROSE[0].upper()), (4, PROSE[1]), (4, PROSE[1]), (4, PROSE[2] + " x y z q")]
    kept = simhash.near_dedup(hard.plain(spark, rows)).collect()
    assert len(kept) == 5 and len({r["text"].lower() for r in kept}) == 5
    assert [r["doc_id"] for r in kept if r["text"] == PROSE[1]] == [4]


def test_the_mix_takes_each_row_as_often_as_its_own_copies(spark):
    rows = [(None, "w " * n) for n in range(1, 30)] + [(3, "v " * 40), (3, "v " * 50)] + [(i, "u " * 9) for i in range(10, 20)]
    docs = hard.plain(spark, rows).selectExpr("doc_id", "text", "lang", "if(text like 'w%', 'a', 'b') source", "n_chars")
    want = sum(r["taken"] for r in mixing.mixture(docs).collect())
    assert sum(len(r["text"].split()) for r in mixing.mix(docs).collect()) == want
