"""License scans by diagonal voting.

Every run of ``GRAM`` words of every text is hashed. Runs whose hash occurs in a
template are joined with the template's positions; each match votes for a
diagonal (position in the text minus position in the template). Neighbouring
diagonals are merged into bands, and a band is verified word by word: the share
of the template's words that stand in the text on the band's diagonals.

Only the handful of templates is broadcast (fixed text, a few thousand words).
Texts are read once and never shuffled; what is shuffled are matching runs.

Defined cases: a null or empty text has no words, no labels and score 0; nulls
in ``doc_id`` stay; repeated rows and ids are judged row by row; a word as long
as its text is one word; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.textbytes import ALNUM, LOWER, Powers, Words, list_array, text_slices
from panelcast.session import materialize

GRAM = 3
MIN_COVER = 0.85
#: Diagonals at most this far apart belong to one band: so many words may be
#: added or left out in a row.
DRIFT = 3

#: Phrases that count wherever they stand, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: License notices, and the labels of texts that hold them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
    "runs array<struct<at:long,hash:long>>, near array<struct<at:long,hash:long>>"
)


def text_words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Words(data, np.array([0, len(data)]), ALNUM, Powers()).hash


def pairs(at: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(at.astype(np.int64)), pa.array(hashes.view(np.int64))], ["at", "hash"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def scanner(phrases: dict[str, str], grams: np.ndarray, reach: int):
    wanted = [(label, text_words(phrase)) for phrase, label in sorted(phrases.items())]
    labels = sorted({label for label, _ in wanted})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                rows = last - first
                words = Words(LOWER[data], offsets, ALNUM, table)
                places, kinds = [], []
                for label, parts in wanted:
                    at = np.flatnonzero(words.hash[: max(0, len(words.hash) - len(parts) + 1)] == parts[0])
                    for j in range(1, len(parts)):
                        at = at[words.hash[at + j] == parts[j]]
                    at = at[words.doc[at] == words.doc[at + len(parts) - 1]]
                    places.append(at)
                    kinds.append(np.full(len(at), labels.index(label)))
                at, kind = np.concatenate(places), np.concatenate(kinds)
                row = words.doc[at]
                own = at - words.first[row]
                low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                np.minimum.at(low, row, own)
                np.maximum.at(high, row, own)
                n_base = np.bincount(row, minlength=rows)
                found = np.zeros((rows, len(labels)), bool)
                found[row, kind] = True
                run_at, run_hash = words.grams("1" * GRAM)
                hit = np.isin(run_hash, grams)
                run_at, run_hash = run_at[hit], run_hash[hit]
                run_row = words.doc[run_at]
                # words so near a matching run that its template may cover them
                cover = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(cover, np.maximum(run_at - reach, words.first[run_row]), 1)
                np.add.at(cover, np.minimum(run_at + reach, words.first[run_row + 1]), -1)
                near = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                near_row = words.doc[near]
                seen = n_base > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        pa.array(np.diff(words.first)),
                        pa.array(n_base.astype(np.int64)),
                        pa.array(low, mask=~seen),
                        pa.array(high.astype(np.int64), mask=~seen),
                        pa.array([[labels[k] for k in np.flatnonzero(x)] for x in found], pa.list_(pa.string())),
                        pairs(run_at - words.first[run_row], run_hash, np.bincount(run_row, minlength=rows)),
                        pairs(near - words.first[near_row], words.hash[near], np.bincount(near_row, minlength=rows)),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "runs", "near"],
                )

    return scan


def template_tables(spark, templates: list[tuple[str, str]]):
    runs, words = [], []
    for number, (label, text) in enumerate(templates):
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        own = Words(data, np.array([0, len(data)]), ALNUM, Powers())
        at, hashes = own.grams("1" * GRAM)
        runs += [(number, int(a), int(h)) for a, h in zip(at, hashes.view(np.int64), strict=True)]
        words += [(number, label, len(own.hash), j, int(h)) for j, h in enumerate(own.hash.view(np.int64))]
    return (
        spark.createDataFrame(runs, "template int, run_at int, hash long"),
        spark.createDataFrame(words, "template int, label string, size int, word_at int, hash long"),
        np.unique(np.array([h for _, _, h in runs], np.int64).view(np.uint64)),
        max(size for _, _, size, _, _ in words) + DRIFT,
    )


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_cover: float = MIN_COVER,
) -> tuple[DataFrame, DataFrame]:
    """(one row per document, verified spans).

    Spans: doc_id, label, template, first_word, last_word, votes, cover.
    """
    spark = docs.sparkSession
    run_table, word_table, grams, reach = template_tables(spark, templates or TEMPLATES)
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = scanned.mapInArrow(scanner(phrases or PHRASES, grams, reach), SCANNED)
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()))

    hits = scanned.select("row", F.inline("runs")).join(F.broadcast(run_table), "hash")
    votes = hits.groupBy("row", "template", (F.col("at") - F.col("run_at")).alias("diagonal")).agg(
        F.count("*").alias("votes")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT
    bands = (
        votes.withColumn("jump", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("band", F.sum("jump").over(along))
        .groupBy("row", "template", "band")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    )
    near = scanned.select("row", "doc_id", F.inline("near"))
    spans = (
        near.join(F.broadcast(word_table), "hash")
        .join(bands, ["row", "template"])
        .where((F.col("at") - F.col("word_at")).between(F.col("low"), F.col("high")))
        .groupBy("row", "doc_id", "template", "label", "size", "band", "votes")
        .agg(
            F.countDistinct("word_at").alias("matched"),
            F.min("at").alias("first_word"),
            F.max("at").alias("last_word"),
        )
        .withColumn("cover", F.col("matched") / F.col("size"))
        .where(F.col("cover") >= min_cover)
    )
    found = spans.groupBy("row").agg(F.collect_set("label").alias("verified"), F.max("cover").alias("best"))
    every = scanned.drop("runs", "near").join(found, "row", "left")
    verified = F.coalesce("verified", F.array().cast("array<string>"))
    rows = every.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", verified))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    return rows, spans.select("doc_id", "label", "template", "first_word", "last_word", "votes", "cover")
