"""Byte-pair encoding and decoding with a transducer lexicon.

The vocabulary's whole words, in which a tokenizer keeps the frequent words of a
language, and any further words of the caller, are compiled with their ids into
a minimal acyclic automaton: states with equal continuations are one, and each
transition carries the number of words it skips, so that a walk adds up to the
word's number and that to its ids. Tasks memory-map the compiled file. Words
outside of it are merged exactly, lowest rank first, leftmost first. The lexicon
changes the speed and no result.

Rules are read from a tokenizers JSON file: NFC, white space dropped, lower case
without context, words by the file's pattern, byte-level letters, end-of-word
suffix, special tokens found in the raw text. Decoding joins tokens by a space,
as a file without a decoder asks for.

Texts are read once and never shuffled. A task remembers up to ``REMEMBERED``
pieces of text between white space and words, then starts afresh: a bound on
memory that changes no result.

Defined cases: a null or empty text has no ids and decodes to an empty text;
null ids decode to an empty text; a null doc_id stays; repeated rows are encoded
row by row; one word may be as long as its text; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import scratch_path

LEXICON_WORDS = 50_000
REMEMBERED = 300_000
SHORT = 48
NO_MERGE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves,
    the rest for code points from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Rules:
    """A tokenizer file of the kind this module knows; others are refused."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("only NFC, white space, lower case, BPE without a decoder")
        if letters["type"] != "ByteLevel" or letters["use_regex"] or letters["add_prefix_space"]:
            raise ValueError("only byte-level letters without a pattern of their own")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.merges = {}
        #: the same, the rank above the id: the least of some is what merges first
        self.order: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
            self.order[self.vocab[left], self.vocab[right]] = rank << 32 | self.vocab[left + right]

    def symbols(self, word: bytes) -> list[int]:
        return [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged, of equals the first."""
        ids = self.symbols(word)
        if len(ids) > SHORT:
            return self.merge_long(ids)
        # only the pairs beside a merge are looked up again
        look = self.order.get
        pairs = [look(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NO_MERGE:
            j = pairs.index(best)
            ids[j : j + 2] = [best & 0xFFFFFFFF]
            del pairs[j]
            if j:
                pairs[j - 1] = look((ids[j - 1], ids[j]), NO_MERGE)
            if j < len(pairs):
                pairs[j] = look((ids[j], ids[j + 1]), NO_MERGE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for words of any length."""
        ids = list(ids)
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(j: int) -> None:
            if j >= 0 and after[j] >= 0:
                pair = (ids[j], ids[after[j]])
                if found := self.merges.get(pair):
                    heapq.heappush(heap, (found[0], j, found[1], *pair))

        for j in range(len(ids)):
            offer(j)
        while heap:
            _, j, made, left, right = heapq.heappop(heap)
            k = after[j]
            if ids[j] != left or k < 0 or ids[k] != right:
                continue
            ids[j], ids[k] = made, -1
            after[j] = after[k]
            if after[j] >= 0:
                before[after[j]] = j
            offer(before[j])
            offer(j)
        return [x for x in ids if x >= 0]


class Lexicon:
    """A minimal acyclic automaton over words, stored as a few flat arrays."""

    FIELDS = ("keys", "targets", "skips", "final", "first", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """States are numbered bottom up; equal ones are made once."""
        known: dict[tuple, int] = {((), False): 0}
        weights = [0]  # words that a state still accepts
        edges: list[tuple[tuple[int, int], ...]] = [()]
        ends = [False]

        def close(node: list) -> int:
            key = (tuple(node[0]), node[1])
            state = known.get(key)
            if state is None:
                state = known[key] = len(weights)
                weights.append(node[1] + sum(weights[t] for _, t in node[0]))
                edges.append(key[0])
                ends.append(node[1])
            return state

        words = sorted(entries)
        path: list[list] = [[[], False]]  # open states along the last word: edges, accepting
        last = b""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                    shared += 1
            for depth in range(len(last), shared, -1):
                path[depth - 1][0].append((last[depth - 1], close(path.pop())))
            if word is None:
                break
            path += [[[], False] for _ in word[shared:]]
            path[-1][1] = True
            last = word
        root = close(path[0])
        order = [root] + [s for s in range(len(weights)) if s != root]
        name = {s: k for k, s in enumerate(order)}
        keys, targets, skips = [], [], []
        for s in order:
            skip = int(ends[s])
            for label, target in edges[s]:
                keys.append(name[s] << 8 | label)
                targets.append(name[target])
                skips.append(skip)
                skip += weights[target]
        counts = [len(entries[w]) for w in words]
        return cls(
            keys=np.array(keys, np.int64),
            targets=np.array(targets, np.int64),
            skips=np.array(skips, np.int64),
            final=np.array([ends[s] for s in order], np.int64),
            first=np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
            ids=np.array([i for w in words for i in entries[w]], np.int64),
        )

    def dump(self) -> bytes:
        arrays = [getattr(self, f) for f in self.FIELDS]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            flat = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        bounds = len(cls.FIELDS) + np.concatenate([[0], np.cumsum(flat[: len(cls.FIELDS)])])
        return cls(**{f: flat[bounds[k] : bounds[k + 1]] for k, f in enumerate(cls.FIELDS)})

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words take a step at a time."""
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive, depth = np.arange(len(words)), 0
        if not len(self.keys):
            return np.full(len(words), -1)
        while len(alive := alive[(sizes[alive] > depth) & (state[alive] >= 0)]):
            key = state[alive] << 8 | data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[alive] = np.where(hit, self.targets[at], -1)
            number[alive] += self.skips[at]
            depth += 1
        accepted = (state >= 0) & (sizes > 0)
        accepted[accepted] = self.final[state[accepted]] == 1
        return np.where(accepted, number, -1)


def frequent_words(rules: Rules, limit: int = LEXICON_WORDS, more: Iterable[str] = ()) -> dict[bytes, list[int]]:
    """The vocabulary's whole words, most frequent (lowest id) first, and more."""
    back = {c: b for b, c in enumerate(byte_letters())}
    whole = sorted((i, t) for t, i in rules.vocab.items() if t.endswith(rules.suffix))
    words = [bytes(back[c] for c in t.removesuffix(rules.suffix)) for _, t in whole]
    words += [w.encode() for w in more]
    return {w: rules.merge(w) for w in words[:limit] if w}


def publish(spark: SparkSession, data: bytes) -> str:
    """Puts a file into the shared folder and has Spark hand it to executors."""
    place = scratch_path(spark, "lexicon")
    name = place.rpartition("/")[2]
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Encoder:
    """Encodes texts; remembers pieces it has met."""

    def __init__(self, rules: Rules, lexicon: Lexicon | None) -> None:
        self.rules, self.lexicon = rules, lexicon
        self.words: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.pattern = regex.compile(rules.pattern)
        self.gaps = regex.compile(r"\p{White_Space}+")
        self.unusual = regex.compile(r"[\x1c-\x1f]")
        self.marks = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None

    def known(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.rules.tokens.__getitem__, ids))

    def learn_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        numbers = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        for word, own, number in zip(words, raw, numbers.tolist(), strict=True):
            if number >= 0:
                first, last = self.lexicon.first[number : number + 2]
                self.words[word] = self.known(self.lexicon.ids[first:last].tolist())
            else:
                self.words[word] = self.known(self.rules.merge(own))

    def learn(self, pieces: Iterable[str]) -> None:
        split = {}
        for piece in pieces:
            lowered = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            split[piece] = self.pattern.findall(lowered)
        self.learn_words(list({w for words in split.values() for w in words if w not in self.words}))
        for piece, words in split.items():
            found = [self.words[w] for w in words]
            self.pieces[piece] = (b"".join(x[0] for x in found), " ".join(x[1] for x in found))

    def cut(self, text: str) -> list[str]:
        """Pieces between white space; python counts four controls as white space."""
        return self.gaps.split(text) if self.unusual.search(text) else text.split()

    def parts(self, text: str) -> list[str]:
        """Pieces, special tokens among them as pieces of their own."""
        if self.marks is None or "<" not in text or not self.marks.search(text):
            return self.cut(text)
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += [*self.cut(text[at : mark.start()]), mark.group()]
            at = mark.end()
        return out + self.cut(text[at:])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of every text."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if not self.pieces:
            self.pieces = {t: self.known([i]) for t, i in self.rules.special.items()}
            self.pieces[""] = (b"", "")
        cut = [self.parts(t) if t else [] for t in texts]
        self.learn({p for pieces in cut for p in pieces if p not in self.pieces})
        for pieces in cut:
            found = [self.pieces[p] for p in pieces if p]
            yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


def text_runs(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """The column's texts, about a megabyte at a time."""
    first, run, held = 0, [], 0
    for n, value in enumerate(column):
        run.append(text := value.as_py())
        held += len(text or "")
        if held >= size:
            yield first, run
            first, run, held = n + 1, [], 0
    if run:
        yield first, run


def encode(docs: DataFrame, tokenizer_path: str, digests: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (array of int); with ``digests`` instead of the
    ids ids_sha256 and, of the ids decoded again, decoded_sha256."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    rules = Rules(spec)
    name = publish(spark, Lexicon.compile(frequent_words(rules, lexicon_words)).dump())
    shared = spark.sparkContext.broadcast(spec)  # the size of the tokenizer's file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Rules(shared.value), Lexicon.open(SparkFiles.get(name)))
        for batch in batches:
            for first, texts in text_runs(batch.column("text")):
                coded = list(encoder.encode(texts))
                sizes = [len(x) // 4 for x, _ in coded]
                columns = [batch.column("doc_id").slice(first, len(texts)), pa.array(sizes, pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x, _ in coded]))
                    columns.append(pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in coded]))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    flat = np.frombuffer(b"".join(x for x, _ in coded), "<u4").astype(np.int32)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return own.mapInArrow(run, f"doc_id long, n_tokens long, {kept}")


def decode(coded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with a column ``decoded``: the ids' tokens joined by a space.
    Ids the tokenizer does not have are left out."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokens = Rules(file.read()).tokens
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(tokens)

    @F.pandas_udf("string")
    def join(lists):
        own = shared.value
        return lists.map(lambda x: " ".join(own[i] for i in x if i in own) if x is not None else "")

    return coded.withColumn("decoded", join(F.col(ids)))
