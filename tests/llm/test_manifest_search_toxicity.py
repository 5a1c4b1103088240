"""Merkle versions, automaton search and nearest labelled examples, on small tables with
every odd case, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelcast.llm import lexical, manifest, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, known int, leaf string, item string, label int"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeÉ", k=rng.randint(1, 5))) for _ in range(120)]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    texts = [prose(rng.randint(1, 80)) for _ in range(70)]
    texts += [None, "", " \n", "\n\n", "!", prose(30_000), "Aa aA AA", "ÀÉ é", "x\x00y", texts[3], texts[3]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else "hot", 5, 1, 2, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [(None, "a\nb", None, None, None, 1, 2, "x", "y", 1), (None, "a\nb", None, None, None, 1, 2, "x", "y", 1)]
    rows += [(None, None, None, "", None, 1, 2, "x", "y", 1), (4, "again", "en", "s1", 0, 1, 2, "x", "y", 1)]
    rows += [rows[4], (9, texts[9], None, "é", -1, 1, 2, "x", "y", 1)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    doc_id, _, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def around(rows, at):
    for row in rows[:-1]:
        low = at - at % 3
        yield "".join(row[low:at]), "".join(row[at + 1 : low + 3])
        at //= 3


def expected_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        members[s] = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in members[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(members[s]):
            path = [*around(trees[s], at), *around(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "") if changed else r[1])
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_matches_brute_force(docs, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "BLOCK", 3**height)
    got = manifest.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = expected_manifest(ROWS)
    assert Counter(map(tuple, got.collect())) == want
    assert 0 < sum(not r[-1] for r in want) < len(ROWS)


def test_manifest_of_nothing_one_row_and_one_source(spark, empty):
    assert manifest.manifest(empty).count() == 0
    for rows in (ROWS[:1], [r for r in ROWS if r[3] == "s1"]):
        got = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
        assert Counter(map(tuple, got)) == expected_manifest(rows)


def test_versions_share_all_but_their_path():
    for n in (1, 2, 3, 4, 9, 10, 26, 27):
        leaves = [sha(str(i)) for i in range(n)]
        own = manifest.PersistentTree(leaves, manifest.levels(n))
        before, size = list(own.digests), len(own.digests)
        for place in range(n):
            copied = own.version(place, sha("new"))
            assert len(copied) == manifest.levels(n) + 1 and len(own.digests) == size + len(copied)
            size = len(own.digests)
            changed = tree([*leaves[:place], sha("new"), *leaves[place + 1 :]])
            assert own.digests[copied[-1]] == changed[-1][0]
            for parent, child in zip(copied[1:], copied, strict=False):
                assert [c for c in own.children[parent] if c >= len(before)] == [child]
        assert own.digests[: len(before)] == before


def test_version_nodes(docs):
    got = manifest.manifest(docs, nodes=True).collect()
    for r in got:
        marked = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert (r.version is not None) == marked
        if marked:
            assert r.version[-1] == r.folded_root and (r.verified or r.version[0] != r.leaf)


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def expected_ranks(items, limit=10):
    counts = [(r[0], Counter(terms(r[1]))) for r in ROWS]
    counts = [(i, c, c.total()) for i, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in counts:
            m = 100 - 90 + (90 * n * total) // length
            score = 0
            for t in set(terms(text)) & set(tf):
                df = sum(t in c for _, c, _ in counts)
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:limit])]
    return Counter(out)


ITEMS = [(i, r[1]) for i, r in enumerate(ROWS[:25])] + [
    (None, "aa AA é"), (100, None), (101, ""), (102, "notthere"), (103, "ÀÉ x y"), (103, ROWS[5][1]), (5, ROWS[5][1]),
    (104, ROWS[75][1]),
]


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 600])
def test_search_matches_brute_force(spark, docs, block_bytes):
    items = spark.createDataFrame([(*x, "clash", 1) for x in ITEMS], "item_id long, text string, item string, doc_id long")
    got = lexical.search(docs, items, block_bytes=block_bytes)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(map(tuple, got.collect())) == expected_ranks(ITEMS)


def test_search_limits_and_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(map(tuple, lexical.search(docs, items, limit=3).collect())) == expected_ranks(ITEMS, 3)
    assert lexical.search(empty, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_items_are_dealt_to_bounded_blocks(spark):
    items = spark.range(500).selectExpr("uuid() AS item", "id AS item_id", "repeat('ab ', 20) AS text")
    blocks = lexical.item_blocks(items, 5000)
    sizes = [b.count() for b in blocks]
    assert sum(sizes) == 500 and max(sizes) * (60 + lexical.ITEM_BYTES) <= 5000


INSULTS = ["fool", "scoundrel", "knave", "wretch"]


def labelled(n=900, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(1 + len(text) // 25):
                text[rng.randrange(len(text))] = rng.choice(INSULTS)
        elif rng.random() < 0.03:
            text[rng.randrange(len(text))] = rng.choice(INSULTS)
        docs.append((i, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    truth = {i: int(sum(w in INSULTS for w in t.split()) * 40 > len(t.split())) for i, t in docs}
    return docs, labels, truth


def test_toxic_texts_are_found_on_held_out_rows(spark):
    docs, labels, truth = labelled()
    odd = [(None, "you fool"), (None, None), (5000, None), (5001, ""), (5002, "!?"), (3, "fool " * 30_000), (5003, "fool")]
    given = spark.createDataFrame([(*r, "x", 1) for r in docs + odd], "doc_id long, text string, label string, h int")
    given_labels = labels + [(None, 1), (7, None), (labels[0][0], 0), (99999, 1)]
    out = toxicity.score_texts(given.repartition(4), spark.createDataFrame(given_labels, "doc_id long, toxic int"))
    rows = out.collect()
    assert len(rows) == len(docs) + len(odd)
    prior = sum(t for i, t in {i: max(t for j, t in labels if j == i) for i, _ in labels}.items() if zlib.crc32(str(i).encode()) % 5)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (5000, 5001, 5002):
            assert not r.nearest and not r.telling and 0 < r.score < 0.5 and prior
        elif r.telling:
            assert r.nearest and all(zlib.crc32(str(n.doc_id).encode()) % 5 for n in r.nearest)
    assert [r.predicted for r in rows if r.doc_id == 3 and "fool" in r.telling and len(r.telling) == 1] == [1]
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id] for r in held]
    assert sum(right) / len(right) > 0.93
    found = [r.predicted for r in held if truth[r.doc_id]]
    assert len(found) > 10 and sum(found) / len(found) > 0.85


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = labelled(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    scores = [
        sorted((r.doc_id, r.score) for r in toxicity.score_texts(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
        for x in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_empty_and_one_sided_labels(spark):
    docs, labels, _ = labelled(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    schema = "doc_id long, toxic int"
    none = toxicity.score_texts(frame, spark.createDataFrame([], schema)).collect()
    assert len(none) == 60 and {r.score for r in none} == {0.0}
    clean = toxicity.score_texts(frame, spark.createDataFrame([(i, 0) for i, _ in labels], schema)).collect()
    assert {r.score for r in clean} == {0.0}
    assert toxicity.score_texts(frame.limit(0), spark.createDataFrame(labels, schema)).count() == 0


def test_the_sample_is_bounded(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS toxic")
    chosen, totals = toxicity.choose(labels, 50)
    kept = chosen.groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {0: 50, 1: 50}
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    assert totals == {1: sum(i % 4 == 0 for i in learned), 0: sum(i % 4 != 0 for i in learned)}


@pytest.mark.parametrize("k", [1, 5, 64])
def test_blocks_give_the_nearest_of_a_full_scan(k):
    rng = np.random.default_rng(k)
    dims = 12

    def texts(n):
        own = [sorted(rng.choice(dims - 1, rng.integers(0, 4), replace=False).tolist()) for _ in range(n)]
        tfs = [rng.integers(1, 3, len(x)).tolist() for x in own]
        return [sum(f) + int(rng.integers(0, 3)) for f in tfs], own, tfs

    idf = rng.uniform(1, 4, dims)
    given = toxicity.weighted(*texts(700), idf)
    label = rng.integers(0, 2, 700)
    index, entry_of = toxicity.build_index(given, label, list(range(700)), dims)
    queries = toxicity.weighted(*texts(200), idf)

    def dense(v):
        out = np.zeros((len(v.first) - 1, dims))
        out[np.repeat(np.arange(len(out)), np.diff(v.first)), v.term] = v.weight
        return out

    every = (dense(queries) @ dense(given).T).round(toxicity.DIGITS)
    for line, (entry, cosine, counts) in zip(every, toxicity.nearest(index, queries, k), strict=True):
        usable = np.sort(line[line > 0])[::-1]
        least = usable[min(k, len(usable)) - 1] if len(usable) else 1
        near = np.flatnonzero((line >= least - 1e-12) & (line > 0)) if len(usable) else []
        assert set(entry.tolist()) == {int(entry_of[i]) for i in near}
        assert counts.sum(axis=0).tolist() == [int((label[near] == x).sum()) if len(near) else 0 for x in (0, 1)]
        assert all(a >= b for a, b in zip(cosine, cosine[1:], strict=False))


def test_monotone_regression():
    x, y, w = np.array([1.0, 2, 2, 3, 4, 5]), np.array([0, 1, 0, 0, 1, 1.0]), np.array([1, 1, 1, 2, 1, 1.0])
    at, value = toxicity.monotone(x, y, w)
    assert all(np.diff(value) >= 0) and all(np.diff(at) > 0)
    assert value[0] == 0 and value[-1] == 1 and np.isclose((np.interp(x, at, value) * w).sum(), (y * w).sum(), atol=0.6)


def test_evidence_shares_telling_terms(spark):
    docs, labels, _ = labelled(400)
    out = toxicity.score_texts(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ).collect()
    own = defaultdict(set)
    for r in out:
        own[r.doc_id] = set(r.telling)
        assert set(r.telling) & set(INSULTS) == {w for w in dict(docs)[r.doc_id].split() if w in INSULTS}
    hits = [any(own[r.doc_id] & own[n.doc_id] for n in r.nearest) for r in out if len(r.telling) > 1]
    assert hits and sum(hits) / len(hits) > 0.9
