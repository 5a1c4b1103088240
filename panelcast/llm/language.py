"""Language identification as a mixture of languages.

Training counts hashed letter trigrams per language over every labelled row that
the caller passes. For a text, expectation-maximisation finds the proportions of
all languages that make its trigrams likeliest. Then the smallest proportion
goes, again and again, as long as the penalised likelihood (log-likelihood minus
``PENALTY`` times languages times log of the trigrams) does not fall; what is
left is the text's language set.

The model has languages x ``BUCKETS`` counts however many rows there are: 32 KB for each
label are gathered, and 16 KB broadcast. A task that has met ``FLUSHED`` labels sends its
counts and starts anew, so its memory does not grow with the labels. Texts are never
shuffled.

Defined cases: a null, empty or letterless text is ``und`` with score 0 and no
languages; a null id is carried along; ties go to the language that sorts first;
repeated rows are judged row by row; an empty training table makes every text
``und``; texts of any length are read whole; other columns come along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.textbytes import LOWER, byte_class, mix, text_slices

BUCKETS = 1 << 12
FLUSHED = 256
PENALTY = 4.0
ROUNDS = 8
BLOCK = 256  # texts per matrix
UNKNOWN = "und"

LETTERS = byte_class((ord("a"), ord("z")), (0x80, 0xFF))
RESULTS = ("lang_pred", "score", "langs", "shares")


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every trigram of letters and single gaps between them.

    Bytes that are no letters all count as one and the same gap.
    """
    data = LOWER[data]
    data = np.where(LETTERS[data], data, np.uint8(32))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, np.arange(len(data) - 2), "right") - 1
    whole = np.arange(len(data) - 2) + 2 < offsets[row + 1]
    whole &= (data[1:-1] != 32) | ((data[:-2] != 32) & (data[2:] != 32))
    code = (data[:-2].astype(np.uint64) << np.uint64(16)) | (data[1:-1].astype(np.uint64) << np.uint64(8)) | data[2:]
    bucket = (mix(code[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return row[whole], bucket


def counted(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used].astype(np.int64))],
            names=["lang", "bucket", "n"],
        )


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by language and bucket; many languages in several goes."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, last, data, offsets in text_slices(batch.column("text")):
            names, index = np.unique(np.array(langs[first:last], dtype=object).astype(str), return_inverse=True)
            row, bucket = trigrams(data, offsets)
            for low in range(0, len(names), FLUSHED):
                own, chunk = index[row] - low, names[low : low + FLUSHED].tolist()
                inside = (own >= 0) & (own < len(chunk))
                counts = np.bincount(own[inside] * BUCKETS + bucket[inside], minlength=len(chunk) * BUCKETS)
                for name, line in zip(chunk, counts.reshape(len(chunk), BUCKETS), strict=True):
                    totals[name] = totals.get(name, 0) + line
                if len(totals) >= FLUSHED:
                    yield from counted(totals)
                    totals.clear()
    yield from counted(totals)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        smooth = counts.astype(np.float64) + 0.5
        self.likely = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def train(labelled: DataFrame) -> Model:
    """A model of the rows' ``text`` and ``lang``; rows without a lang are not used."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = (
        rows.mapInArrow(count_trigrams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("own"))
    found = table.orderBy("lang").collect()
    matrix = np.zeros((len(found), BUCKETS))
    for own, line in zip(found, matrix, strict=True):
        line[[x["bucket"] for x in own["own"]]] = [x["n"] for x in own["own"]]
    return Model([r["lang"] for r in found], matrix)


def fit(counts: np.ndarray, likely: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS):
    """Proportions (texts x languages) and log-likelihoods by EM."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        mixed = share @ likely
        share = share * ((counts / mixed) @ likely.T) / total
    mixed = share @ likely
    return share, (counts * np.log(mixed)).sum(axis=1)


def select_languages(counts: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Proportions of the selected sets, 0 for languages outside."""
    n, size = len(counts), len(likely)
    price = PENALTY * np.log(np.maximum(counts.sum(axis=1), 2))
    allowed = np.ones((n, size), np.float32)
    share, logs = fit(counts, likely, allowed)
    best, worth = share.copy(), logs - price * size
    for _ in range(size - 1):
        # the smallest proportion goes; of equal ones the last language
        order = np.where(allowed > 0, share, np.inf)
        drop = size - 1 - np.argmin(order[:, ::-1], axis=1)
        allowed[np.arange(n), drop] = 0
        share, logs = fit(counts, likely, allowed)
        now = logs - price * allowed.sum(axis=1)
        better = now >= worth
        best[better], worth[better] = share[better], now[better]
    return best


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter, of any script."""
    ascii_letter = byte_class((ord("a"), ord("z")), (ord("A"), ord("Z")))[data]
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = np.diff(upto[offsets]) > 0
    for row in np.flatnonzero(~out):
        own = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        out[row] = any(map(str.isalpha, own))
    return out


def predictor(model: Model, columns: list[str]):
    langs, likely = np.array(model.langs, dtype=object), model.likely

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                rows = last - first
                row, bucket = trigrams(data, offsets)
                known = has_letter(data, offsets) & (len(langs) > 0)
                shares = np.zeros((rows, len(langs)))
                for low in range(0, rows, BLOCK):
                    high = min(low + BLOCK, rows)
                    if not len(langs):
                        break
                    a, b = np.searchsorted(row, [low, high])
                    counts = np.bincount((row[a:b] - low) * BUCKETS + bucket[a:b], minlength=(high - low) * BUCKETS)
                    counts = counts.reshape(high - low, BUCKETS).astype(np.float32)
                    shares[low:high] = select_languages(counts, likely)
                # a text too short for a trigram leans to no language
                bare = known & (np.bincount(row, minlength=rows) == 0)
                shares[bare] = 1 / max(len(langs), 1)
                top = np.argmax(shares, axis=1) if len(langs) else np.zeros(rows, int)
                names = [langs[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
                score = np.where(known, shares.max(axis=1, initial=0), 0).clip(0, 1)
                order = np.argsort(-shares, axis=1, kind="stable")
                sets = [[k for k in o if s[k] > 0] if ok else [] for o, s, ok in zip(order, shares, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, rows) for c in columns],
                        pa.array(names, pa.string()),
                        pa.array(score),
                        pa.array([[langs[k] for k in x] for x in sets], pa.list_(pa.string())),
                        pa.array([s[x].tolist() for s, x in zip(shares, sets, strict=True)], pa.list_(pa.float64())),
                    ],
                    names=[*columns, *RESULTS],
                )

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs``, lang_pred, score (share of that language), langs and
    shares; given columns of these names are replaced."""
    columns = [c for c in docs.columns if c not in RESULTS]
    inner = [f"own_{i}" for i in range(len(columns))]
    own = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(columns, inner, strict=True)],
        F.col("text").cast("string").alias("text"),
    )
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType()))
    schema = T.StructType(
        [T.StructField(k, own.schema[k].dataType) for k in inner]
        + [T.StructField(c, kind) for c, kind in zip(RESULTS, kinds, strict=True)]
    )
    return own.mapInArrow(predictor(model, inner), schema).toDF(*columns, *RESULTS)


def held_out(doc_id: str = "doc_id"):
    """The fold that training never sees."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull())
