"""Operator 4, language ID by a string kernel.

The kernel is the blended spectrum of character n-grams (n = 1 to 3, by
presence): the number of distinct n-grams that two texts share, over the
geometric mean of their own numbers. n-grams are kept in a hashed table of
``DIM`` places. A bounded, balanced sample of labelled rows trains one
ridge regression per language against the rest in the Nystroem space of a
few landmarks: ``alpha = (K_nm' K_nm + l n K_mm)^-1 K_nm' Y``. A document's
values are its kernel row against the landmarks times ``alpha``; as both are
linear in the presence rows, ``landmarks' alpha`` is multiplied once and
batches of documents are scored by one matrix product each.

Cases: ``und`` with score 0 for a null text and for one without letters, and
for every text where no row can be learned from; a null lang is never
learned; a null doc_id counts as held out; rows that repeat a doc_id are
drawn one by one, by doc_id and text, and a row repeated in both counts once;
where there are more languages than the sample has rows, those of the fewest
rows are not learned; a text of any length is read whole, in slices; ties
between languages go to the first in code point order; repeated rows are
predicted alike; an empty table gives an empty result. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import own_name, stored, table

ORDERS, DIM = 3, 1 << 15
MAX_TRAIN, LANDMARKS, RIDGE = 2048, 256, 1e-3  # bounds of the fit: rows learned from, landmarks
COMMON_IN, LEAST_ROWS = 50, 8  # an n-gram in one of 50 rows of a language is common; rows that set a bound
SLICE, BATCH_CHARS = 1 << 17, 1 << 18
UNKNOWN = "und"


def presence(texts: list[str]) -> np.ndarray:
    """A row of ``DIM`` 0/1 bytes per text: which n-grams it has."""
    out = np.zeros((len(texts), DIM), np.uint8)
    flat = out.reshape(-1)
    pieces, rows = [], []
    held = 0

    def flush():
        if not pieces:
            return
        code = np.frombuffer("\0".join(pieces).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", "<u4").astype(np.uint32)
        row = np.repeat(np.array(rows, np.int64) * DIM, [len(p) + 1 for p in pieces])
        gram, whole = code, code != 0
        for n in range(1, ORDERS + 1):
            if n > 1:
                gram = gram[:-1] * np.uint32(0x9E3779B1) + code[n - 1:]
                whole = whole[:-1] & (code[n - 1:] != 0)
            place = (gram ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(17)
            flat[row[:len(place)][whole] + place[whole]] = 1
        pieces.clear()
        rows.clear()

    for i, text in enumerate(texts):
        text = " ".join(text.lower().replace("\0", " ").split())
        for at in range(0, len(text), SLICE):  # slices overlap, so no n-gram is cut
            pieces.append(text[at:at + SLICE + ORDERS - 1])
            rows.append(i)
            held += len(pieces[-1])
            if held > BATCH_CHARS:
                flush()
                held = 0
    flush()
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def train_rows(docs: DataFrame, max_train: int = MAX_TRAIN) -> list[tuple[str, bytes]]:
    """(lang, presence bits, doc_id) of the sample: as many rows of each
    language, those with the smallest hashes; ``max_train`` in all."""
    usable = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("_of_text"), "text").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & has_letters())
    row = ["doc_id", "lang", "_of_text"]
    ids = stored(usable.select(row).distinct().withColumn(
        "_u", F.pmod(F.xxhash64("doc_id", "_of_text"), F.lit(1 << 40)) / float(1 << 40)), "labelled")
    counts = stored(ids.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
                    .orderBy(F.col("_n").desc(), "_lang").limit(max_train), "langs")
    langs = counts.count()
    if not langs:
        return []
    quota = max(1, max_train // langs)
    # only draws that can be among a language's first `quota` go on to be ranked
    near = ids.join(counts, ids["lang"] == counts["_lang"]).where(F.col("_u") * F.col("_n") <= quota + 8 * quota ** 0.5 + 64)
    first = W.partitionBy("lang").orderBy("_u", *row)
    chosen = near.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= quota).select(row)
    rows = usable.join(F.broadcast(chosen), row)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                packed = np.packbits(presence(part.column(3).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2),
                                                  pa.array([p.tobytes() for p in packed], pa.binary())], [*row, "bits"])

    found = (rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "_of_text", "text")
             .mapInArrow(bits, "doc_id long, lang string, _of_text long, bits binary").dropDuplicates(row).collect())  # max_train rows of 4 KB
    return sorted((r["lang"], bytes(r["bits"]), r["doc_id"]) for r in found)


def fit(sample: list[tuple], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages, and a weight for each n-gram place and language."""
    langs = sorted({s[0] for s in sample})
    packed = np.frombuffer(b"".join(s[1] for s in sample), np.uint8).reshape(len(sample), -1)
    y = np.array([[1.0 if s[0] == n else -1.0 for n in langs] for s in sample])
    # landmarks: every language in turn, each in the order of its presence bits
    seen: Counter = Counter()
    turn = [(seen.update([s[0]]) or seen[s[0]], i) for i, s in enumerate(sample)]
    order = [i for _, i in sorted(turn)[:landmarks]]
    marks = unit(np.unpackbits(packed[order], axis=1))
    k_mm = (marks @ marks.T).astype(np.float64)
    k_nm = np.concatenate([unit(np.unpackbits(packed[at:at + 256], axis=1)) @ marks.T
                           for at in range(0, len(packed), 256)]).astype(np.float64)
    left = k_nm.T @ k_nm + ridge * len(sample) * k_mm + 1e-6 * np.eye(len(order))
    alpha = np.linalg.solve(left, k_nm.T @ y)
    return langs, (marks.T @ alpha.astype(np.float32)).astype(np.float32)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def has_letters():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def model_of(docs: DataFrame, max_train: int, landmarks: int) -> tuple:
    """The languages, and the weights (DIM x languages) for the executors."""
    sample = train_rows(docs, max_train)
    langs, weights = fit(sample, landmarks) if sample else ([], np.zeros((DIM, 0), np.float32))
    return langs, docs.sparkSession.sparkContext.broadcast(weights)


def known_places(sample: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram places that are common in each language (DIM x languages),
    and the share of a text's places that must be among them: half way from
    the share that chance gives to what all but 1 in 20 labelled rows reach,
    each measured against the other rows of its language."""
    langs = sorted({s[0] for s in sample})
    known, bounds = np.zeros((DIM, len(langs)), np.float32), np.full(len(langs), np.nan)
    for k, lang in enumerate(langs):
        own = [s[1] for s in sample if s[0] == lang]
        least, count = -(-len(own) // COMMON_IN), np.zeros(DIM, np.int64)
        for bits in own:
            count += np.unpackbits(np.frombuffer(bits, np.uint8))
        known[:, k] = count >= least
        if len(own) >= LEAST_ROWS:
            without = count > least  # common without the row itself
            shares = [without[np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)].mean() for bits in own]
            low, chance = np.quantile(shares, 0.05), known[:, k].mean()
            bounds[k] = (low + min(low, chance)) / 2
    # a language of too few rows takes the lowest bound of the others
    some = bounds[~np.isnan(bounds)]
    return known, np.where(np.isnan(bounds), some.min() if len(some) else 0.0, bounds)


def prose(text: str) -> str:
    """The text without numbers, keys and addresses (words with a digit),
    which are of no language; the whole text if no letter is left."""
    left = re.sub(r"\S*\d\S*", " ", text)
    return left if any(c.isalpha() for c in left) else text


def recognised(has: pa.Array, text: pa.Array, weights: np.ndarray, known: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have letters and the n-grams of the language that the
    kernel's regression gives them."""
    pred, _ = best_of(has, text, weights)
    out = pred >= 0
    if out.any():
        rows = presence([prose(t) for t, p in zip(text.to_pylist(), pred) if p >= 0]).astype(np.float32)
        of = pred[out]
        out[out] = (rows @ known / rows.sum(1, keepdims=True))[np.arange(len(of)), of] >= bounds[of]
    return out


def best_of(has: pa.Array, text: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the place of its best language (-1 for none) and the score."""
    letters = np.asarray(has.to_pylist(), bool)
    pred, best = np.full(len(letters), -1), np.zeros(len(letters))
    if weights.shape[1] and letters.any():
        values = unit(presence([t for t, has in zip(text.to_pylist(), letters) if has])) @ weights
        pred[letters] = values.argmax(1)
        best[letters] = np.clip((values.max(1) + 1) / 2, 0, 1)
    return pred, best


def predictions(docs: DataFrame, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    langs, model = model_of(docs, max_train, landmarks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                pred, best = best_of(part.column(2), part.column(3), model.value)
                names = [langs[p] if p >= 0 else UNKNOWN for p in pred.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()),
                                                  pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       has_letters().alias("letters"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: the kernel's
    prediction, as in ``predictions``, and a check that the text has as large
    a share of the n-grams of that language as its labelled rows have. The
    score says which language is best, not whether one is: its values depend
    on the number of languages."""
    sample = train_rows(docs, max_train)
    weights = fit(sample)[1] if sample else np.zeros((DIM, 0), np.float32)
    model = docs.sparkSession.sparkContext.broadcast((weights, *known_places(sample)))
    text, letters = docs.columns.index("text"), len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # each row is judged by its own text
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield part.select(range(letters)).filter(pa.array(recognised(part.column(letters), part.column(text), *model.value)))

    return docs.select("*", has_letters().alias(own_name())).mapInArrow(keep, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
