"""Operators on texts against brute force, on small tables with every odd case."""

import gc
import hashlib
import itertools
import math
import random
import re
import time
import weakref
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast import session
from panelcast.llm import (
    bpe,
    components,
    decontaminate,
    jaccard_join,
    language,
    licenses,
    paragraph_dedup,
    quality,
    suffix_dedup,
    textbytes,
)
from panelcast.llm.queries import tokenizer_path
from panelcast.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, kept string, id long, tag string, n long"


def corpus() -> list[tuple]:
    """Nulls, empties, ties, repeated rows, long texts, copies, near copies, passages."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(400)]

    def prose(n: int) -> str:
        words = [rng.choice(vocabulary) + (". " if rng.random() < 0.1 else "\n" if rng.random() < 0.03 else " ") for _ in range(n)]
        return "".join(words).strip()

    texts = [prose(rng.randint(1, 300)) for _ in range(60)]
    passage = prose(70)
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(6)]
    texts += [texts[3]] * 5 + [texts[8]] * 2
    for base in texts[10:18]:
        words = base.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \n\t ", "one", "two words", "a" * 5000, "ab " * 2000, prose(20_000), "é" * 60, "!?;" * 40]
    texts += ["GNU General Public License, CC BY. All rights reserved", "<|endoftext|>x <|startoftext|> It's 12%\x1cΣΑΣ İ"]
    rows = [(i, t, "en", "s", "clash", 5, "clash", None) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None, None, 1), (2, texts[2], "en", "s", None, 1, None, 2)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(row) -> int:
    return 2**63 - 1 if row[0] is None else row[0]


def by_text(rows) -> Counter:
    return Counter(map(tuple, rows))


def test_substrings_match_brute_force(docs, empty):
    windows: dict[bytes, int] = {}
    for row in ROWS:
        data = (row[1] or "").encode()
        for j in range(len(data) - 49):
            key = data[j : j + 50]
            windows[key] = min(order(row), windows.get(key, 2**63))
    expected = []
    for row in ROWS:
        data = (row[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - 49):
            if windows[data[j : j + 50]] < order(row):
                gone[j : j + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())
        expected.append((row[0], len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone])))
    out = suffix_dedup.remove_repeats(docs)
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_text((*r[:4], bytes(r[4])) for r in got) == by_text(expected)
    assert set(docs.columns) - {"kept"} < set(out.columns)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.permutation(2900)
    group = np.sort(rng.integers(0, 9, 2900))
    text = suffix_dedup.Suffixes(data, 50)
    begins = suffix_dedup.starts_of(group)
    out = text.sort(at, begins)
    for low, high in zip(begins, [*begins[1:], 2900], strict=True):
        cut = [data[j : j + 50].tobytes() for j in out[low:high]]
        assert cut == sorted(data[j : j + 50].tobytes() for j in at[low:high])


def test_whole_characters_stay(spark):
    a = "é" * 30
    rows = spark.createDataFrame([(1, a), (2, "x" + a)], "doc_id long, text string")
    got = dict(suffix_dedup.remove_repeats(rows, characters=True).select("doc_id", "kept").collect())
    assert got == {1: a, 2: "x"}


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[j : j + n]) for j in range(len(words) - n + 1))


def test_jaccard_components_match_brute_force(docs, empty):
    sets = [shingles(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ROWS)):
        for j in range(i):
            linked = sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
            if linked or ROWS[i][0] == ROWS[j][0]:
                root[find(i)] = find(j)
    smallest: dict[int, int] = {}
    for i in range(len(ROWS)):
        smallest[find(i)] = min(order(ROWS[i]), smallest.get(find(i), 2**63))
    expected = [(r[0], len(s), smallest[find(i)]) for i, (r, s) in enumerate(zip(ROWS, sets, strict=True))]
    rows, _ = jaccard_join.similar_documents(docs)
    assert by_text(rows.collect()) == by_text(expected)
    assert jaccard_join.similar_documents(empty)[0].count() == 0


def test_near_copies_of_the_pipeline_match_brute_force(spark):
    rows = [r[:2] for r in ROWS[:-2]]
    words = [f"w{i}" for i in range(200)]
    few = [f"x{i}" if i in (30, 80, 120, 170) else w for i, w in enumerate(words)]
    rows += [(900 + i, " ".join(t)) for i, t in enumerate((words, few, words + [f"y{i}" for i in range(40)]))]
    sets = [shingles(t, 5) for _, t in rows]
    group = {i: {i} for i, _ in rows}
    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if a and group[i] is not group[j] and 100 * len(a & b) >= 80 * len(a | b):
                group[i] |= group[j]
                group.update(dict.fromkeys(group[j], group[i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({min(g) for g in group.values()})
    assert not {r.doc_id for r in kept} & {901, 902}


def test_rows_without_an_id_of_their_own_are_judged_one_by_one(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    schema = "doc_id long, text string, source string"
    rows = [
        (5, text("a"), "s"), (None, text("a"), "s"), (None, text("b"), "s"), (6, text("b"), "s"), (7, text("c"), "s"),
        (None, text("d"), "t"), (None, text("d"), "s"), (None, text("e"), "s"), (8, text("f"), "s"), (8, text("a"), "s"),
        (9, text("g"), "s"), (9, text("g"), "s"), (None, None, "s"), (None, "", "s"), (None, "", "s"),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    want = [(5, "a"), (6, "b"), (7, "c"), (None, "d"), (None, "e"), (8, "f"), (9, "g")]
    got = by_text((r.doc_id, r.text) for r in kept.collect())
    assert got == by_text([(i, text(n)) for i, n in want] + [(None, None), (None, ""), (None, "")])
    benchmark = spark.createDataFrame([(1, text("e")), (2, text("f"))], "item_id long, text string")
    left = decontaminate.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert by_text(map(tuple, left.collect())) == by_text(r for r in rows if r[1] not in (text("e"), text("f")))


def test_many_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 2000)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, links = jaccard_join.similar_documents(rows)
    sets = [shingles(t) for t in texts]
    adjacent = {i: [j for j in range(60) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(60)}
    for i, component in found.select("doc_id", "component_id").collect():
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in adjacent[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        assert component == min(seen)


def test_sets_of_a_large_component_meet_by_their_edges(spark, monkeypatch):
    """A long chain of near copies: a set is sent as often as it has edges, not to every tile."""
    monkeypatch.setattr(jaccard_join, "TILE", 2000)
    sent, plain = [], jaccard_join.link_candidates
    copies = F.sum(F.greatest(F.col("tiles") - 1, F.lit(1)))
    monkeypatch.setattr(jaccard_join, "link_candidates", lambda sets, *a: sent.append(sets.agg(copies).first()[0]) or plain(sets, *a))
    words = [f"w{i}" for i in range(1200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(300)]
    rows += [(None, " ".join(words[500:620])), (None, " ".join(words[700:820])), (7, "a b c d")]
    found, _ = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}
    assert 300 < sent[0] < 2500


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (1, 1), *((100 + i, 101 + i) for i in range(30))]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 1: 1} | {100 + i: 100 for i in range(31)}


def test_paragraphs_go_once(docs, empty, spark):
    out = {(r.doc_id, r.text): r for r in paragraph_dedup.remove_similar(docs).collect()}
    by_id = {r[0]: r for r in ROWS}
    assert out[3, by_id[3][1]].n_removed == 0 and out[3, by_id[3][1]].kept == by_id[3][1]
    copies = [r for r in ROWS if r[1] == by_id[3][1] and r[0] != 3]
    assert copies and all(out[r[0], r[1]].n_removed > 0 for r in copies)
    assert out[60, by_id[60][1]].n_removed == 0 and all(out[i, by_id[i][1]].n_removed > 0 for i in range(61, 66))
    assert out[2, by_id[2][1]].n_removed == 0  # repeats of one row keep their first copy
    assert paragraph_dedup.remove_similar(empty).count() == 0
    similar = " ".join(f"w{i}" for i in range(80)) + "."
    rows = [(1, similar), (2, similar.replace("w20 ", "other ")), (3, similar.replace(" w3", " z3"))]
    near = paragraph_dedup.remove_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id: (r.n_removed, r.kept) for r in near.collect()}
    assert kept[1] == (0, similar) and kept[2] == (1, "") and kept[3][0] == 0


def test_passages_of_short_lines_and_whole_blocks_go(spark):
    rng = random.Random(11)
    word = iter(f"w{rng.randrange(10**9)}x{i}" for i in range(10**6))
    run = lambda n: " ".join(next(word) for _ in range(n))
    lines = "\n".join(run(5) for _ in range(12))
    speech = " ".join(run(6) + "." for _ in range(9))
    heading = run(3) + "\n" + run(30)
    block = [" ".join(run(8) + "." for _ in range(3)) for _ in range(8)]
    changed = [x.replace(x.split()[12], next(word)) if i < 3 else x for i, x in enumerate(block)]
    long = run(60) + "\n" + run(4)
    texts = [
        run(7) + "\n" + lines + "\n" + run(20),
        run(3) + "\n" + run(4) + "\n" + lines + "\n" + run(2) + "\n" + run(2),
        run(30) + "\n" + speech + "\n" + run(3) + "\n" + run(12),
        run(4) + "\n" + speech + "\n" + run(40),
        heading + "\n" + run(20),
        run(20) + "\n" + heading,
        run(15) + "\n\n" + "\n".join(block) + "\n\n" + run(15),
        run(16) + "\n\n" + "\n".join(changed) + "\n\n" + run(17),
        long,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in paragraph_dedup.remove_similar(rows).collect()}
    for i, text in enumerate(texts):
        gone = {1: lines, 3: speech, 5: heading, 7: "\n".join(changed)}.get(i, "")
        left = text.replace(gone, "").split()
        assert got[i].kept.split() == left and got[i].n_removed_words == len(gone.split()), i


def test_bpe_matches_the_library_and_round_trips(docs, empty):
    library = Tokenizer.from_file(tokenizer_path())
    expected, decoded = [], []
    for row in ROWS:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        shas = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        expected.append((row[0], len(ids), *shas))
        decoded.append((row[0], ids, back))
    assert by_text(bpe.encode(docs, tokenizer_path(), digests=True).collect()) == by_text(expected)
    coded = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).select("doc_id", "ids", "decoded").collect()
    assert by_text((i, tuple(x), d) for i, x, d in coded) == by_text((i, tuple(x), d) for i, x, d in decoded)
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [n] for n, w in enumerate(["tap", "taps", "top", "tops", "é", "stop"])}
    lexicon = bpe.Lexicon.compile(words)
    assert len(lexicon.final) < 12  # shared endings: a trie would have 16 states
    listed = sorted(words)
    found = lexicon.find([*listed, b"ta", b"tapsy", b"", b"x"])
    assert found[: len(listed)].tolist() == list(range(len(listed))) and (found[len(listed) :] == -1).all()
    assert [lexicon.ids[lexicon.first[k]] for k in range(len(listed))] == [words[w][0] for w in listed]


def test_quality_counts_match_brute_force(docs, empty):
    expected = []
    for row in ROWS:
        text = row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        runs = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        count, covered = Counter(runs), set()
        for j, run in enumerate(runs):
            if count[run] > 1:
                covered.update(range(j, j + 8))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        expected.append((row[0], len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    out = quality.judge(docs)
    assert by_text(out.select(names).collect()) == by_text(expected)
    assert out.where("kept AND base_failed").count() == 0
    assert quality.judge(empty).count() == 0


def test_quality_rejects_outliers_and_no_others(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(200)), "en", "a") for i in range(100)]
    rows += [(100 + i, " ".join(word() + "$%&" for _ in range(200)), "en", "a") for i in range(8)]
    out = dict(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect())
    assert all(out[i] for i in range(100)) and not any(out[i] for i in range(100, 108))


def test_quality_rejects_repeats_and_judges_small_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    verse = [prose(3) for _ in range(10)]
    bad = ["\n".join(rng.sample(verse * 6, 60)), prose(150) + " " + " ".join([prose(10)] * 2) + " " + " ".join([prose(15)] * 2)]
    symbols = " ".join(word() + "$%&" for _ in range(200))
    rows = [(i, prose(200), "en", "a") for i in range(100)]
    rows += [(100 + i, x, "en", "a") for i, x in enumerate(bad)]
    rows += [(200, symbols, "en", "small"), (201, prose(200), "en", "small"), (202, symbols, "xx", None), (203, prose(200), "xx", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert all(got[i].kept for i in range(100)) and got[201].kept and got[203].kept
    assert not any(got[i].kept for i in (100, 101, 200, 202))
    assert not any(got[i].base_failed for i in (100, 101, 200, 202))
    assert all(r.kept and r.d2 is None for r in quality.judge(table.where("doc_id IN (1, 200)")).collect())


def test_language_on_held_out_rows(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(language.training_rows(docs))
    told = language.identify(docs, model).where(language.held_out())
    right, n = told.selectExpr("avg(CAST(lang = lang_pred AS INT))", "count(*)").first()
    assert n > 100 and right > 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %", "x"), (None, "a", "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] in model.langs
    untrained = language.train(empty)
    assert {r.lang_pred for r in language.identify(odd, untrained).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_mixtures_have_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('en', 'fr') AND n_chars BETWEEN 3000 AND 6000")
    model = language.train(docs)
    one = {r.lang: r.text for r in docs.limit(60).collect()}
    mixed = spark.createDataFrame([(1, one["en"][:3000] + " " + one["fr"][:3000])], "doc_id long, text string")
    row = language.identify(mixed, model).first()
    assert sorted(row.langs) == ["en", "fr"] and 0.4 < row.score < 0.6


def test_leaks_with_substitutions(spark, empty):
    item = "the quick brown fox jumps over a lazy dog while seven tall birds watch from the old red barn roof".split()
    changed = list(item)
    changed[4], changed[13] = "leaps", "look"
    rows = [
        (1, "before it " + " ".join(item).upper() + " after it"),
        (2, "so " + ", ".join(changed) + "!"),
        (3, " ".join(reversed(item))),
        (4, None),
        (5, "short item whole here ok"),
        (6, "short item changed here ok"),
        (None, " ".join(item)),
        (7, ""),
    ]
    benchmark = spark.createDataFrame(
        [(10, " ".join(item)), (11, None), (12, "short item whole here ok"), (13, "too few"), (14, " ".join(item))],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(i, j) for i in (1, 2, None) for j in (10, 14)} | {(5, 12)}
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, benchmark).collect()} == {3, 4, 6, 7}
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_license_places_match_brute_force(docs, empty):
    expected = []
    for row in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or ""))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            parts = phrase.split()
            for j in range(len(words) - len(parts) + 1):
                if words[j : j + len(parts)] == parts:
                    places.append(j)
                    labels.add(label)
        ends = (min(places), max(places)) if places else (None, None)
        expected.append((row[0], len(words), len(places), *ends, ",".join(sorted(labels))))
    rows, _ = licenses.scan_licenses(docs)
    names = "doc_id n_words n_base first_word last_word base_labels".split()
    assert by_text(rows.select(names).collect()) == by_text(expected)
    assert licenses.scan_licenses(empty)[0].count() == 0


def test_license_notices_with_changes(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "x " * 500 + dict((l, t) for l, t in licenses.TEMPLATES)["bsd"].replace("source and binary", "source or binary")),
        (3, "licensed under the sun and the moon"),
    ]
    found, spans = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.labels, r.score) for r in found.collect()}
    assert got[1] == ("apache-2.0", 1.0) and got[2][0] == "bsd" and 0.85 <= got[2][1] < 1 and got[3] == ("", 0.0)
    assert {(r.doc_id, r.first_word) for r in spans.collect()} >= {(1, 0), (2, 500)}


def test_stages_keep_columns_of_any_name(spark):
    """Names that operators use inside come back as they were given."""
    names = ["row_key", "rest", "stays", "group", "found", "kept", "key", "own", "id", "tag", "lang_pred", "score", "n", "size"]
    text = lambda k: " ".join(f"{k}word{i % 97}x{i}" for i in range(80))
    rows = [(i, text(i % 3), "en" if i else None, "s", 5, *[f"{i}{n}" for n in names]) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == ({0, 1, 2} if name == "similar" else set(range(6))), name
        for r in got.values():
            assert [r[n] for n in names] == [f"{r.doc_id}{n}" for n in names]
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
    assert corpus_pipeline.to_tokens(spark, docs, folder).count() == 6


def test_unrelated_texts_make_no_candidates(spark, monkeypatch):
    """Short sets leave segments empty; these bring no two unrelated texts together."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(5, 120))) for _ in range(300)]
    seen = []
    plain = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: seen.append(edges.count()) or plain(edges))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, links = jaccard_join.similar_documents(docs, size=5, per_cent=80)
    assert seen[0] == 0 and links.count() == 0
    assert {r.component_id for r in rows.collect()} == set(range(300))


@pytest.mark.parametrize("per_cent", [80, 90])
def test_linked_sets_share_a_segment_whatever_is_frequent(per_cent):
    rng = np.random.default_rng(per_cent)
    share = jaccard_join.Fraction(per_cent, 100)
    linked = 0
    for _ in range(400):
        a = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        gone = int(rng.integers(0, len(a) * (100 - per_cent) // 100 + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, gone + 2), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < per_cent * (len(a) + len(b) - common):
            continue
        linked += 1
        frequent = np.zeros(jaccard_join.FILTER_BITS, bool)
        for bit in jaccard_join.probes(a[:: int(rng.integers(1, 4))]):
            frequent[bit] = True
        keys = [jaccard_join.segment_keys(np.zeros(len(x), np.int64), x, share, frequent)[1] for x in (a, b)]
        assert len(np.intersect1d(*keys))
    assert linked > 100


def test_bitmaps_rule_out_no_link():
    """The bound is at least the overlap, between bitmaps of any two sizes."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)]))
        rows = {}
        for side, x in (("a", a), ("b", b)):
            rows[f"n_{side}"] = pa.array([len(x)])
            rows[f"bits_{side}"] = jaccard_join.bitmaps(np.zeros(len(x), np.int64), x, np.array([len(x)]))
        batch = pa.RecordBatch.from_pydict({"a": pa.array([1]), "b": pa.array([2]), "star": pa.array([False]), **rows})
        kept = sum(out.num_rows for out in jaccard_join.may_link(80)([batch]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert kept


@pytest.mark.parametrize("window", range(9, 14))
def test_masks_meet_every_allowed_pattern(window):
    allowed = window - math.ceil(window * decontaminate.SIMILARITY)
    for count in range(allowed + 1):
        for changed in itertools.combinations(range(window), count):
            whole = [j not in changed for j in range(window)]
            assert any(
                all(whole[at + j] for j, bit in enumerate(mask) if bit == "1")
                for mask in decontaminate.MASKS
                for at in range(window - len(mask) + 1)
            ), changed


def test_items_of_ten_and_eleven_words_with_two_changes(spark):
    rng = random.Random(3)
    docs, items, want = [], [], set()
    for size in (10, 11):
        for number, changed in enumerate(itertools.combinations(range(size), 2)):
            key = 100 * size + number
            item = [f"w{key}x{j}" for j in range(size)]
            text = [f"o{key}" if j in changed else w for j, w in enumerate(item)]
            items.append((key, " ".join(item)))
            docs.append((key, " ".join(["before"] * rng.randint(0, 5) + text + ["after"])))
            want.add((key, key))
    rows = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id) for r in rows.collect()} == want


def test_any_number_of_languages(spark):
    rng = random.Random(8)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        syllables = ["".join(rng.choices(alphabet, k=3)) for _ in range(6)]
        for j in range(3):
            text = " ".join("".join(rng.choices(syllables, k=2)) for _ in range(60))
            rows.append((3 * k + j, text, f"l{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language.train(docs.where("doc_id % 3 <> 2"))
    assert len(model.langs) == 300
    asked = docs.where("doc_id % 3 = 2 AND doc_id % 30 = 2")
    told = language.identify(asked, model).collect()
    assert sum(r.lang == r.lang_pred for r in told) / len(told) > 0.9


def test_many_rows_without_an_id_keep_their_own_bytes(spark):
    """Rows that share an id (all null ones do) are told apart by 64 bits of their text."""
    shared = "".join(chr(97 + i % 26) for i in range(60))
    rows = [(None, f"{i:05d}" + shared if i % 1000 == 0 else f"{i:05d} text of its own") for i in range(20_000)]
    table = spark.createDataFrame([(1, shared), *rows], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(table).collect()
    kept = Counter(bytes(r.kept).decode() for r in got)
    want = Counter([shared] + [t[:5] if i % 1000 == 0 else t for i, (_, t) in enumerate(rows)])
    assert kept == want


def test_determinant_is_the_smallest_of_all_subsets(spark):
    """On small groups the search is held against every subset of three quarters of the rows."""
    rng = np.random.default_rng(12)
    rows, best = [], {}
    for group in range(6):
        x = rng.normal(size=(12, 4)) @ rng.normal(size=(4, 4)) + 3
        x[9:] += rng.normal(size=4) * 25
        rows += [(0, "en", f"s{group}", i % quality.SALT, *map(float, line)) for i, line in enumerate(x)]
        sizes = []
        for subset in itertools.combinations(range(12), 9):
            cov = np.cov(x[list(subset)].T, bias=True) * quality.CONSISTENCY
            sizes.append((np.linalg.slogdet(cov)[1], subset))
        best[f"s{group}"] = min(sizes)
    table = spark.createDataFrame(rows, "level int, lang string, source string, salt int, x0 double, x1 double, x2 double, x3 double")
    middle = quality.medians(table)
    found = quality.smallest(table, middle).withColumn("start", quality.F.lit(0))
    sizes = {r.source: r["size"] for r in quality.log_determinants(found).collect()}
    hits = 0
    for source, (size, subset) in best.items():
        assert subset == tuple(range(9))  # the planted rows stay out
        assert sizes[source] > size - 1e-6
        hits += abs(sizes[source] - size) < 1e-6
    assert hits >= 5
    far = quality.distances(table, found.drop("start")).where("d2 > 100").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in far} == dict.fromkeys(best, 3)


def test_band_recall_is_what_the_docstring_says(spark):
    """Of pairs with one changed word, a similarity of 55 / 65, nearly all meet."""
    rng = random.Random(17)
    rows = []
    for pair in range(400):
        words = [f"p{pair}w{j}" for j in range(64)]
        changed = list(words)
        changed[rng.randrange(8, 56)] = "other"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(changed))]
    got = {r.doc_id: r.n_removed for r in paragraph_dedup.remove_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(0, 800, 2))
    found = sum(got[i] > 0 for i in range(1, 800, 2))
    assert found >= 0.985 * 400


def test_merging_looks_up_only_pairs_beside_a_merge():
    class Counted(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    with open(tokenizer_path(), encoding="utf-8") as file:
        rules = bpe.Rules(file.read())
    rules.order = Counted(rules.order)
    rng = random.Random(4)
    for n in (1, 2, 9, 20, bpe.SHORT):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aeinst"):
            word = "".join(rng.choice(letters) for _ in range(n)).encode()
            rules.order.n = 0
            assert rules.merge(word) == rules.merge_long(rules.symbols(word))
            assert (n < 2 or rules.order.n) and rules.order.n <= 3 * n


def test_windows_of_a_leak_are_compared_once(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b c d e f g h i j")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(words[5:25]))], "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("zip_with" in line or "zipwith" in line or "lambda" in line)]
    assert [(r.doc_id, r.item_id, r.first_word, r.similarity) for r in found.collect()] == [(1, 7, 5, 1.0)]


def test_a_step_of_the_estimates_is_one_table(spark, monkeypatch):
    made, plain = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df: made.append(1) or plain(df))
    rng = np.random.default_rng(3)
    rows = [(0, "en", "s", i % quality.SALT, *map(float, line)) for i, line in enumerate(rng.normal(size=(60, 4)))]
    table = spark.createDataFrame(rows, "level int, lang string, source string, salt int, x0 double, x1 double, x2 double, x3 double")
    assert quality.smallest(table, quality.medians(table), steps=3).count() == 1
    assert 2 <= len(made) <= 4


def test_what_steps_leave_behind_goes(spark):
    """Checkpoints (and shuffle files) that nothing refers to go as further steps are done."""
    first = materialize(spark.range(100).repartition(3))
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    own = max(root.glob("rdd-*"), key=lambda p: p.stat().st_mtime_ns)
    del first
    for _ in range(40):
        materialize(spark.range(1))
        if not own.exists():
            break
        time.sleep(0.25)
    assert not own.exists()


def test_a_step_is_let_go_before_files_are_removed(spark, monkeypatch):
    """While something holds the step just done, its own shuffle files stay."""
    step, seen = [spark.range(9).groupBy("id").count()], []
    held = weakref.ref(step[0])
    monkeypatch.setattr(session, "release", lambda _: seen.append((gc.collect(), held())[1]))
    kept = materialize(step.pop())
    assert kept.count() == 9 and seen == [None]


def batch_of_texts(n, seed):
    """Texts of several slices, in two batches."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) + "." for _ in range(n)]
    none = pa.array([None] * n, pa.list_(pa.int64()))
    columns = {"id": np.arange(n), "tag": np.arange(n) * 7, "sent": np.zeros(n, np.int64), "text": texts, "gone": none}
    whole = pa.RecordBatch.from_pydict(columns)
    return [whole.slice(0, n // 2), whole.slice(n // 2)]


def test_entries_of_many_slices_go_in_one_row_of_a_bucket():
    batches = batch_of_texts(300, 3)
    assert sum(b.column("text").nbytes for b in batches) > 3 * textbytes.SLICE_BYTES
    sent = pa.Table.from_batches(suffix_dedup.announce(40, 50, 16)(iter(batches)))
    assert sorted(sent.column("bucket").to_pylist()) == list(range(40))
    got = [suffix_dedup.unpack_bucket(b.as_py()) for b in sent.column("blob")]
    found = sorted(x for g in got for x in zip(g["id"].tolist(), g["tag"].tolist(), g["first"].tolist(), g["low"].tolist(), strict=True))
    one = []
    for batch in batches:
        for low, _, data, offsets in textbytes.text_slices(batch.column("text")):
            p = suffix_dedup.Pieces(data, offsets, textbytes.Powers(), 50, 16)
            ids = batch.column("id").to_numpy()[low:][p.row]
            one += zip(ids.tolist(), (7 * ids).tolist(), (p.first - offsets[p.row]).tolist(), (p.print & np.uint64(0xFFFF)).tolist(), strict=True)
    assert found == sorted(one)


def test_only_windows_that_may_be_equal_are_sorted(monkeypatch):
    sizes, plain = [], suffix_dedup.Suffixes.sort
    monkeypatch.setattr(suffix_dedup.Suffixes, "sort", lambda self, at, groups: sizes.append(len(at)) or plain(self, at, groups))
    rng = np.random.default_rng(4)
    seed, shared = rng.bytes(16), rng.bytes(30)
    pieces = [rng.bytes(20) + seed + (shared if i in (7, 30) else rng.bytes(30)) for i in range(60)]
    table = pa.table({
        "bucket": pa.array([0] * 60, pa.int32()), "key": pa.array([5] * 60, pa.int64()), "id": pa.array(range(60), pa.int64()),
        "tag": pa.array(range(60), pa.int64()), "first": pa.array([100] * 60, pa.int64()),
        "owner": pa.array([20] * 60, pa.int32()), "bytes": pa.array(pieces, pa.binary()),
    })
    out = suffix_dedup.compare_windows(40)(table).to_pylist()
    # of 27 windows a piece, those from byte 20 on are whole copies
    assert out == [{"id": 30, "tag": 30, "start": 120, "stop": 166}]
    assert sizes == [14]


def test_entries_of_paragraphs_of_many_slices_go_in_one_row_of_a_bucket():
    batches = batch_of_texts(300, 3)
    for run, width in ((paragraph_dedup.announce(40, 10), 8), (paragraph_dedup.send_bands(40, 10, 2, 4), 5)):
        sent = pa.Table.from_batches(run(iter(batches)))
        assert sorted(sent.column("bucket").to_pylist()) == list(range(40))
        got = [x for b in range(40) for x in zip(*(c.tolist() for c in paragraph_dedup.unblob(sent.slice(b, 1), width)), strict=True)]
        assert {i for _, i, _, _ in got} == set(range(300))
        one = []
        for batch in batches:
            for row in range(batch.num_rows):
                alone = pa.Table.from_batches(run(iter([batch.slice(row, 1)])))
                one += [x for b in range(alone.num_rows) for x in zip(*(c.tolist() for c in paragraph_dedup.unblob(alone.slice(b, 1), width)), strict=True)]
        assert sorted(got) == sorted(one)


def test_paragraphs_of_a_large_component_meet_by_their_rarest_shingles(spark, monkeypatch):
    """Many fillings of one template, below the similarity, and some near copies of them."""
    monkeypatch.setattr(paragraph_dedup, "TILE_SETS", 10)
    sent, plain = [], paragraph_dedup.link_candidates
    copies = F.sum(F.greatest(F.col("tiles") - 1, F.lit(1)))
    monkeypatch.setattr(paragraph_dedup, "link_candidates", lambda sets, *a: sent.append(sets.agg(copies).first()[0]) or plain(sets, *a))
    rng = random.Random(9)
    fill = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    template = " ".join(f"t{i}" for i in range(24))
    texts = [f"{template} {fill(8)}." for _ in range(200)]
    texts += [texts[i][:-1] + " more." for i in (3, 50, 77, 120, 199)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r.doc_id for r in paragraph_dedup.remove_similar(docs).where("n_removed > 0").collect()}
    assert gone == set(range(200, 205))
    assert 0 < sent[0] < 400
    # near copies share their rarest shingles: they stay in tiles, fewer of them than shingles
    words = [f"n{i}" for i in range(120)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) + "." for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r.doc_id for r in paragraph_dedup.remove_similar(docs).where("n_removed > 0").collect()}
    assert gone == set(range(1, 40))
    assert sent[1] <= 40 * 4


def test_entries_of_bands_come_back_and_pack():
    """Ids, tags and places of any size come back; of usual ones little but the keys is left."""
    rng = np.random.default_rng(5)

    def packed_bytes(n, ids, tags, numbers):
        rows = np.sort(rng.integers(0, len(ids), n))
        keys = rng.integers(0, 2**64, n, np.uint64)
        sent = paragraph_dedup.blobs(keys, rows, numbers, ids, tags, 12, 5)
        kept, codec = [], pa.Codec("lz4_raw")
        for i in range(sent.num_rows):
            one = pa.Table.from_batches([sent.slice(i, 1)])
            kept.append(np.stack(paragraph_dedup.unblob(one, 5)[1:], axis=1))
            assert (sent.column("bucket")[i].as_py() == np.unique(keys % 12))[i]
        expected = np.stack([ids[rows], tags[rows], numbers], axis=1)
        assert sorted(map(tuple, np.concatenate(kept).tolist())) == sorted(map(tuple, expected.tolist()))
        return sum(len(codec.compress(x.as_py())) for c in sent.columns[1:] for x in c) / n

    top = 2**63 - 1
    odd = np.array([-(2**63), -1, 0, 1, top])
    packed_bytes(300, odd, odd[::-1].copy(), rng.integers(0, 2**30, 300) << 32 | rng.integers(0, 2**32, 300))
    numbers = rng.integers(0, 90, 40_000) << 32 | rng.integers(1, 6, 40_000)
    assert packed_bytes(40_000, np.arange(400) + 70_000, np.zeros(400, np.int64), numbers) < 8


def test_bands_of_ids_with_one_text_go_without_its_hash(spark):
    """And ids with several texts, null ones and repeated rows are told apart as before."""
    rng = random.Random(23)
    word = iter(f"w{rng.randrange(10**9)}x{i}" for i in range(10**6))
    base = [next(word) for _ in range(160)]

    def near(i):
        return " ".join([*base[:i], next(word), *base[i + 1 :]]) + "."

    other = " ".join(next(word) for _ in range(80)) + "."
    texts = [(1, near(30)), (1, near(40)), (2, near(50)), (None, near(33)), (None, near(44)), (3, other), (3, other), (4, None)]
    seen, plain = [], paragraph_dedup.send_bands

    def watched(*given):
        run = plain(*given)

        def kept(batches):
            for batch in batches:
                order = zip(batch.column("id").to_pylist(), batch.column("sent").to_pylist(), strict=True)
                assert all((sent == 0) == (i in (2, 3, 4)) for i, sent in order)
                yield from run(iter([batch]))

        seen.append(1)
        return kept

    paragraph_dedup.send_bands = watched
    try:
        out = paragraph_dedup.remove_similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    finally:
        paragraph_dedup.send_bands = plain
    assert seen and len(out) == len(texts)
    removed = {(r.doc_id, r.text): r.n_removed for r in out}
    # of the near ones one text of id 1 stays, of the equal rows both
    assert sorted(removed[t] for t in texts[:2]) == [0, 1] and removed[texts[5]] == 0
    assert all(removed[t] == 1 for t in texts[2:5])
