"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Learning. Of the labelled rows at most ``EXAMPLES`` of each label, chosen by a hash of the
doc_id, become examples: the bounded sample on which the classifier is fitted. The terms
whose presence depends on the label (likelihood-ratio test at ``LEAST_G``, and ``LEAST_LIFT``
times as frequent under one label) are dimensions of their own, ``MAX_TERMS`` at most; all other words of a text count as one more term, so a
vector still says how much of a text its telling words are. Weights are (1 + ln tf) * idf
with document frequencies over *all* documents, and vectors have length 1.

Search. Examples with equal vectors are one entry with a count per label. Entries lie in
blocks of ``BLOCK`` in an inverted index, and every term knows its largest weight in each
block. A document's bound for a block is its product with these maxima. The blocks with the
highest bounds are scored through their postings; this gives the similarity of the
``NEIGHBOURS``-th nearest example so far, and every further block whose bound reaches it is
scored as well. So the nearest are exactly those of a full scan. Examples as near as the last
one all count.

Score. Neighbours vote with 1 / (``SOFTEN`` + 1 - cosine), times the share of their label's
rows that the sample stands for. Each example is scored in the same way without itself and
the copies of its text; a monotone regression of the labels on these votes turns votes into
probabilities.

Scale: texts are read once for the example's terms (rows of the sample only) and once for the
vectors, which hold telling terms and a word count. Documents are scored where they lie;
nothing of them is shuffled but counts of at most ``MAX_TERMS`` + 1 terms. Broadcast: the
index, at most 2 * ``EXAMPLES`` entries of ``MAX_TERMS`` + 1 weights, however many documents.

Defined cases: a text that is null, empty or without words has no neighbours and scores the
share of label 1 among the labelled rows, as all texts do if no example is labelled 1 (0
without labels). Null labels and null doc_ids of labels are not learned from; a doc_id
labelled twice has the larger label; of several rows with a labelled doc_id the one whose
text has the smallest hash is the example. Every row is scored by itself, whatever its id;
a null doc_id is not held out. Texts of any length are read whole. Empty tables give an
empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.lexical import GUARDED
from panelcast.llm.textbytes import text_slices
from panelcast.session import materialize

#: Labelled rows of each label that become examples, at most.
EXAMPLES = 4096
MAX_TERMS = 512
#: A term tells labels apart from this likelihood ratio on, in so many different texts,
#: and if it is so many times as frequent under one label.
LEAST_G = 24.0
LEAST_ROWS = 3
LEAST_LIFT = 3.0
NEIGHBOURS = 64
SOFTEN = 0.05
#: Entries of a block of the index, and documents searched together.
BLOCK = 64
BATCH = 512
#: Similarities are compared after rounding.
DIGITS = 9
SLACK = 1e-8

VECTORS = "n_words long, terms array<int>, tfs array<int>"


def held_out(doc_id: str = "doc_id"):
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def word_counts(column: pa.Array) -> Iterator[Counter]:
    for first, last, data, offsets in text_slices(column):
        raw = data.tobytes().translate(GUARDED)
        for row in range(last - first):
            yield Counter(raw[offsets[row] : offsets[row + 1]].split())


def choose(labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of the sample, and the labelled rows by label."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out())
    known = materialize(known.groupBy("doc_id").agg(F.max("label").alias("label")))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = known.limit(0)
    for label, n in sorted(totals.items()):
        own = known.where(F.col("label") == label)
        chance = F.xxhash64("doc_id")
        if n > 2 * examples:  # leaves half as many again as are needed
            own = own.where(F.pmod(chance, F.lit(1 << 40)) < int((1 << 40) * 1.5 * examples / n))
        chosen = chosen.unionAll(own.orderBy(F.pmod(chance, F.lit(1 << 40)), "doc_id").limit(examples))
    return materialize(chosen), totals


def terms_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch that hold each term, by label."""
    for batch in batches:
        holding = Counter()
        for label, own in zip(batch.column("label").to_pylist(), word_counts(batch.column("text")), strict=True):
            holding.update((term, label) for term in own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([t for t, _ in holding], pa.binary()),
                pa.array([label for _, label in holding], pa.int32()),
                pa.array(list(holding.values()), pa.int64()),
            ],
            names=["term", "label", "n"],
        )


def telling_terms(texts: DataFrame, max_terms: int) -> list[bytes]:
    """Terms whose presence depends most on the label, by the likelihood ratio G over
    different texts. Words that are merely somewhat more frequent under one label, as all
    of a language's are, are not telling at any sample size."""
    texts = materialize(texts.select("text", "label").distinct())
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = (float(sizes.get(k, 0)) for k in (0, 1))
    if not clean or not toxic:
        return []
    held = texts.mapInArrow(terms_by_label, "term binary, label int, n long").groupBy("term")
    held = held.agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("clean"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("toxic"),
    ).where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
    share = (F.col("clean") + F.col("toxic")) / (clean + toxic)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = F.lit(0.0)
    for name, n in (("clean", clean), ("toxic", toxic)):
        ratio = ratio + part(F.col(name), n * share) + part(n - F.col(name), n * (1 - share))
    # half a row is added on each side, so that a term with rows of one label has a lift
    under = [(F.col(name) + 0.5) / (n + 1) for name, n in (("clean", clean), ("toxic", toxic))]
    lift = F.greatest(under[0], under[1]) / F.least(under[0], under[1])
    best = held.withColumn("g", F.round(2 * ratio, 6)).where((F.col("g") >= LEAST_G) & (lift >= LEAST_LIFT))
    return sorted(bytes(r["term"]) for r in best.orderBy(F.desc("g"), "term").limit(max_terms).collect())


def vectorizer(terms: list[bytes]):
    number = {term: i for i, term in enumerate(terms)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each text, and how often it has each telling term."""
        for batch in batches:
            words, own, times = [], [], []
            for found in word_counts(batch.column("text")):
                words.append(found.total())
                telling = sorted((number[t], found[t]) for t in found.keys() & number.keys())
                own.append([t for t, _ in telling])
                times.append([n for _, n in telling])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("h"), pa.array(words, pa.int64()), pa.array(own, kind), pa.array(times, kind)],
                names=["doc_id", "held_out", "h", "n_words", "terms", "tfs"],
            )

    return vectors


class Sparse(NamedTuple):
    """Vectors of length 1 (or 0): row r is term[first[r]:first[r + 1]] and weight[...]."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., begin[1], ... laid end to end."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def weighted(n_words: list[int], terms: list[list[int]], tfs: list[list[int]], idf: np.ndarray) -> Sparse:
    """TF-IDF vectors; the last dimension is of all words that are not telling."""
    rest = len(idf) - 1
    term, tf, size = [], [], []
    for n, own, times in zip(n_words, terms, tfs, strict=True):
        other = n - sum(times)
        term += own + [rest] * (other > 0)
        tf += times + [other] * (other > 0)
        size.append(len(own) + (other > 0))
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    term, weight = np.array(term, np.int64), 1 + np.log(np.array(tf, float))
    weight *= idf[term]
    row = np.repeat(np.arange(len(size)), size)
    length = np.sqrt(np.bincount(row, weight**2, minlength=len(size)))
    return Sparse(first, term, weight / length[row])


class Index(NamedTuple):
    """Entries by number, in blocks; postings by (term, block)."""

    counts: np.ndarray  # examples of label 0 and 1 of each entry
    maxima: np.ndarray  # terms x blocks
    begin: np.ndarray  # of the postings of term * blocks + block
    entry: np.ndarray
    weight: np.ndarray
    whose: list  # doc_ids of each entry's examples, the smallest of each label first


def build_index(vectors: Sparse, labels: np.ndarray, ids: list, dims: int) -> tuple[Index, np.ndarray]:
    """The index, and the entry of each example."""
    rows = [
        tuple(sorted(zip(-vectors.weight[a:b].round(DIGITS + 3), vectors.term[a:b].tolist(), strict=True)))
        for a, b in zip(vectors.first, vectors.first[1:], strict=False)
    ]
    # alike entries become neighbours, which keeps the maxima of a block low
    distinct = sorted({r for r in rows if r}, key=lambda r: [(t, w) for w, t in r])
    number = {r: i for i, r in enumerate(distinct)}
    entry_of = np.array([number.get(r, -1) for r in rows], np.int64)
    counts = np.zeros((len(distinct), 2), np.int64)
    whose: list[tuple[list, list]] = [([], []) for _ in distinct]
    for e, label, doc in zip(entry_of.tolist(), labels.tolist(), ids, strict=True):
        if e >= 0:
            counts[e, label] += 1
            whose[e][label].append(doc)
    whose = [[(doc, label) for label in (1, 0) for doc in sorted(own[label])] for own in whose]
    blocks = -(-len(distinct) // BLOCK)
    posts = sorted((t, i, -w) for i, r in enumerate(distinct) for w, t in r)
    term, entry = (np.array([p[k] for p in posts], np.int64) for k in (0, 1))
    weight = np.array([p[2] for p in posts], float)
    place = term * blocks + entry // BLOCK
    maxima = np.zeros(dims * blocks)
    np.maximum.at(maxima, place, weight)
    begin = np.searchsorted(place, np.arange(dims * blocks + 1))
    return Index(counts, maxima.reshape(dims, blocks), begin, entry, weight, whose), entry_of


def similarities(index: Index, queries: Sparse, q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Cosines of query q[i] with the entries of block[i], through the postings."""
    size = np.diff(queries.first)[q]
    pair = np.repeat(np.arange(len(q)), size)
    own = ranges(queries.first[q], size)
    place = queries.term[own] * index.maxima.shape[1] + block[pair]
    n = index.begin[place + 1] - index.begin[place]
    post = ranges(index.begin[place], n)
    pair, given = np.repeat(pair, n), np.repeat(queries.weight[own], n)
    to = pair * BLOCK + index.entry[post] % BLOCK
    found = np.bincount(to, given * index.weight[post], minlength=len(q) * BLOCK)
    return found.reshape(len(q), BLOCK).round(DIGITS)


def nearest(index: Index, queries: Sparse, k: int, without: list | None = None):
    """For each query its nearest entries, nearest first, their cosines and their
    examples by label: as many entries as hold ``k`` examples, and all as near as the
    last. ``without``: (entry, examples by label) that a query must not see."""
    blocks = index.maxima.shape[1]
    rows = len(queries.first) - 1
    if not blocks:
        return [(np.zeros(0, int), np.zeros(0), np.zeros((0, 2), int))] * rows
    dense = np.zeros((rows, len(index.maxima)))
    dense[np.repeat(np.arange(rows), np.diff(queries.first)), queries.term] = queries.weight
    bounds = dense @ index.maxima
    best = np.argsort(-bounds, axis=1, kind="stable")
    lead = min(blocks, 2 + k // BLOCK)
    q = np.repeat(np.arange(rows), lead)
    scored = [[] for _ in range(rows)]

    def score(q: np.ndarray, block: np.ndarray) -> None:
        for low in range(0, len(q), 4096):
            part = slice(low, low + 4096)
            for i, b, line in zip(q[part].tolist(), block[part].tolist(), similarities(index, queries, q[part], block[part]), strict=True):
                at = np.flatnonzero(line > 0)
                scored[i].append((b * BLOCK + at, line[at]))

    def ranked(i: int):
        entry = np.concatenate([e for e, _ in scored[i]])
        cosine = np.concatenate([c for _, c in scored[i]])
        counts = index.counts[entry]
        if without is not None and without[i][0] >= 0:
            counts = counts - np.where((entry == without[i][0])[:, None], without[i][1], 0)
        some = counts.sum(axis=1) > 0
        entry, cosine, counts = entry[some], cosine[some], counts[some]
        order = np.lexsort((entry, -cosine))
        entry, cosine, counts = entry[order], cosine[order], counts[order]
        enough = int(np.searchsorted(np.cumsum(counts.sum(axis=1)), k))
        if enough >= len(entry):
            return entry, cosine, counts, 0.0
        keep = cosine >= cosine[enough]
        return entry[keep], cosine[keep], counts[keep], cosine[enough]

    score(q, best[:, :lead].ravel())
    reach = np.array([ranked(i)[3] for i in range(rows)])
    more_q, rank = np.nonzero(np.take_along_axis(bounds, best, axis=1)[:, lead:] >= np.maximum(reach[:, None] - SLACK, SLACK))
    score(more_q, best[more_q, rank + lead])
    return [ranked(i)[:3] for i in range(rows)]


def vote(cosine: np.ndarray, counts: np.ndarray, stands_for: np.ndarray) -> float:
    votes = (counts * stands_for) / (SOFTEN + 1 - cosine)[:, None]
    return float(votes[:, 1].sum() / votes.sum())


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted isotonic regression of y on x."""
    pools: list[list[float]] = []  # sum of weights, of weight * x, of weight * y
    for value in np.unique(x):
        own = x == value
        w = weight[own]
        pools.append([w.sum(), w.sum() * value, (w * y[own]).sum()])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    return table[:, 1] / table[:, 0], table[:, 2] / table[:, 0]


class Classifier(NamedTuple):
    terms: list
    idf: np.ndarray
    index: Index
    stands_for: np.ndarray
    prior: float
    knots: tuple
    neighbours: int


def raw_votes(classifier: Classifier, n_words: list, terms: list, tfs: list, without: list | None = None):
    """(vote or None, entries, cosines) of each text."""
    queries = weighted(n_words, terms, tfs, classifier.idf)
    for low in range(0, len(n_words), BATCH):
        high = min(low + BATCH, len(n_words))
        a, b = queries.first[low], queries.first[high]
        part = Sparse(queries.first[low : high + 1] - a, queries.term[a:b], queries.weight[a:b])
        found = nearest(classifier.index, part, classifier.neighbours, None if without is None else without[low:high])
        for entry, cosine, counts in found:
            yield (vote(cosine, counts, classifier.stands_for) if len(entry) else None), entry, cosine


def calibrated(classifier: Classifier, raw: float | None) -> float:
    if raw is None or classifier.knots is None:
        return classifier.prior
    return float(np.clip(np.interp(raw, *classifier.knots), 0, 1))


def left_out(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes on examples, without themselves."""
        for batch in batches:
            own = batch.to_pydict()
            without = [(e, np.array(c)) for e, c in zip(own["entry"], own["copies"], strict=True)]
            votes = raw_votes(shared.value, own["n_words"], own["terms"], own["tfs"], without)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([v for v, _, _ in votes], pa.float64())], names=["label", "vote"]
            )

    return work


def scorer(shared, evidence: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        known: dict[tuple, tuple] = {}
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in ("n_words", "terms", "tfs")]
            # texts without a telling term all have one vector
            rows = [(n if t else min(n, 1), tuple(t), tuple(f)) for n, t, f in zip(*own, strict=True)]
            if len(known) > 1 << 16:
                known = {}
            new = list(dict.fromkeys(r for r in rows if r not in known))
            columns = [list(c) for c in zip(*new, strict=True)] if new else [[], [], []]
            columns[1:] = [[list(x) for x in c] for c in columns[1:]]
            for row, (raw, entry, cosine) in zip(new, raw_votes(classifier, *columns), strict=True):
                near = []
                for e, c in zip(entry.tolist(), cosine.tolist(), strict=True):
                    near += [{"doc_id": d, "label": label, "cosine": c} for d, label in classifier.index.whose[e][: evidence - len(near)]]
                    if len(near) >= evidence:
                        break
                known[row] = calibrated(classifier, raw), near
            scores = np.array([known[r][0] for r in rows])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
            words = [[classifier.terms[t].decode("utf-8", "replace") for t in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                    pa.array([known[r][1] for r in rows], kind),
                    pa.array(words, pa.list_(pa.string())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "nearest", "telling"],
            )

    return score


def learn(vectors: DataFrame, chosen: DataFrame, totals: dict[int, int], terms: list[bytes], neighbours: int) -> Classifier:
    """A classifier out of the texts' vectors and the chosen (doc_id, label)."""
    spark = vectors.sparkSession
    words = vectors.where("n_words > 0")
    rest = F.when(F.col("n_words") > F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x), F.array(F.lit(len(terms))))
    every = words.select(F.explode(F.concat("terms", F.coalesce(rest, F.array().cast("array<int>")))).alias("term"))
    holding = np.zeros(len(terms) + 1)
    for r in every.groupBy("term").agg(F.count("*").alias("n")).collect():
        holding[r["term"]] = r["n"]
    idf = np.log((1 + words.count()) / (1 + holding)) + 1
    own = vectors.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    rows = own.agg(F.min(F.struct("h", "n_words", "terms", "tfs")).alias("v")).orderBy("doc_id").collect()
    sample = {c: [r["v"][c] for r in rows] for c in ("h", "n_words", "terms", "tfs")}
    labels = np.array([r["label"] for r in rows], np.int64)
    packed = weighted(sample["n_words"], sample["terms"], sample["tfs"], idf)
    index, entry_of = build_index(packed, labels, [r["doc_id"] for r in rows], len(idf))
    sizes = np.bincount(labels, minlength=2)
    stands_for = np.array([totals.get(k, 0) for k in (0, 1)]) / np.maximum(sizes, 1)
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    classifier = Classifier(terms, idf, index, stands_for, prior, None, neighbours)
    if not sizes.all():
        return classifier
    copies: dict[int, np.ndarray] = {}
    for h, label in zip(sample["h"], labels.tolist(), strict=True):
        copies.setdefault(h, np.zeros(2, int))[label] += 1
    local = [
        (int(label), int(e), copies[h].tolist(), n, t, f)
        for label, e, h, n, t, f in zip(labels, entry_of, *[sample[c] for c in ("h", "n_words", "terms", "tfs")], strict=True)
    ]
    frame = spark.createDataFrame(local, f"label int, entry int, copies array<int>, {VECTORS}")
    found = frame.repartition(max(2, len(local) // 512))
    found = found.mapInArrow(left_out(_Shared(spark, classifier)), "label int, vote double")
    found = found.where("vote IS NOT NULL").toArrow()
    if not found.num_rows:
        return classifier
    label, votes = found.column("label").to_numpy(), found.column("vote").to_numpy().round(12)
    return classifier._replace(knots=monotone(votes, label.astype(float), stands_for[label]))


class _Shared:
    """A broadcast classifier; sent as plain parts, so that tasks need no class of ours to read it."""

    def __init__(self, spark: SparkSession, own: Classifier) -> None:
        self.parts, self.own = spark.sparkContext.broadcast(tuple(own._replace(index=tuple(own.index)))), None

    @property
    def value(self) -> Classifier:
        if self.own is None:
            parts = self.parts.value
            self.own = Classifier(*parts)._replace(index=Index(*parts[2]))
        return self.own


def score_texts(
    docs: DataFrame,
    labels: DataFrame,
    examples: int = EXAMPLES,
    max_terms: int = MAX_TERMS,
    neighbours: int = NEIGHBOURS,
    evidence: int = 5,
) -> DataFrame:
    """doc_id, held_out, score, predicted, the nearest labelled rows (doc_id, label,
    cosine), and the telling terms of the text."""
    chosen, totals = choose(labels, examples)
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = read.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    sample = sample.agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    terms = telling_terms(materialize(sample).select("text", "label"), max_terms)
    given = read.select("doc_id", held_out().alias("held_out"), F.xxhash64("text").alias("h"), "text")
    kind = T.StructType([docs.select("doc_id").schema[0], *T._parse_datatype_string(f"held_out boolean, h long, {VECTORS}").fields])
    vectors = materialize(given.mapInArrow(vectorizer(terms), kind))
    classifier = learn(vectors, chosen, totals, terms, neighbours)
    shared = _Shared(docs.sparkSession, classifier)
    near = "array<struct<doc_id: bigint, label: int, cosine: double>>"
    out = T.StructType(
        [kind[0], *T._parse_datatype_string(f"held_out boolean, score double, predicted int, nearest {near}, telling array<string>").fields]
    )
    return vectors.mapInArrow(scorer(shared, evidence), out)
