"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over token labels whose paths are exactly
the right tokenizations. It starts as one state with a loop for every byte; the gadget of the
merge (a, b) -> ab gives the a-arcs a target of their own, which is a copy without the b-arc, and
adds ab-arcs, beside the a-arcs, to where b led. All arcs of a label end in one state, so that a
state is kept as the state it was copied from, the time of the copy, and the arcs removed since;
an arc's presence is worked out at its first use and kept in the transition table.

A pre-split word is encoded by running the automaton over its bytes. All states accept and paths
are unique, so that every prefix of the word has one path: the last arc of a prefix is the one label
that ends there and leaves the state of the prefix before it. Many new words are run together, in
sorted order, so that what neighbours share is worked out once; nothing goes back. Decoding emits
the labels of the arcs.

Defined cases: a null text is the empty text, which has no tokens; added tokens in a text are
single tokens, found before the words are split; repeated rows are encoded each; an empty table
gives an empty result; other columns are ignored by encode_digests().
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import held, release_memory

#: How byte-level tokenizers split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts whose characters the two libraries' classes agree on, which is faster.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]")
FULL_WORDS = regex.compile(WORDS)
#: Words of more bytes aren't kept in a worker's table, which starts anew beyond so many words, with the one before at hand; slots of the transition table.
KEEP_BYTES, KEEP_WORDS, KEEP_SLOTS = 48, 100_000, 1 << 21
#: Characters whose words are looked up at once.
PART_CHARS = 1_000_000


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, other = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(other)] = b
            other += 1
    return out


def load(path: str) -> dict:
    """What the automaton needs of a byte-level tokenizer's JSON file: labels (bytes by id), merges (a, b, ab), added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"].get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take neighbours")
    as_byte, vocab = byte_chars(), spec["model"]["vocab"]
    labels = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    if len({ab for _, _, ab in merges}) < len(merges):
        raise ValueError(f"{path}: two merges make one token")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"labels": labels | {i: s.encode() for s, i in added.items()}, "merges": merges, "added": added, "bytes": {labels[i][0]: i for i in vocab.values() if len(labels[i]) == 1}}


class Automaton:
    def __init__(self, spec: dict) -> None:
        self.labels: dict[int, bytes] = spec["labels"]
        merges = spec["merges"]
        self.made = {b: -1 for b in spec["bytes"].values()}  # the time at which a label's arcs came
        self.left: dict[int, int] = {}
        self.target = dict.fromkeys(self.made, 0)  # of all arcs of a label
        users = {0: len(self.made) + 1}  # labels that lead to a state; the start counts as one
        self.origin: list[tuple[int, int]] = [(-1, 0)]  # of a state: copied from, at
        self.removed: list[dict[int, int]] = [{}]  # of a state: label and time
        for time, (a, b, ab) in enumerate(merges):
            if a not in self.made or b not in self.made or not self.has_arc(self.target[a], b):
                continue  # b never follows a by now
            state, after = self.target[a], self.target[b]
            if users[state] > 1:
                users[state] -= 1
                self.origin.append((state, time))
                self.removed.append({})
                state = self.target[a] = len(self.removed) - 1
                users[state] = 1
            elif a == b:  # aa leads to what a led to before its arc goes
                self.origin.append(self.origin[after])
                self.removed.append(dict(self.removed[after]))
                after = len(self.removed) - 1
                users[after] = 0
            self.removed[state].setdefault(b, time)
            self.made[ab], self.left[ab], self.target[ab] = time, a, after
            users[after] = users.get(after, 0) + 1
        self.arcs = Arcs(self.has_arc)
        nodes: dict[int, int] = {}  # of the labels read from their ends: node << 8 | byte -> node; the root is 0
        ends = [-1]  # of a node: the label that it spells
        self.longest: dict[bytes, int] = {}  # of the labels that end in two bytes
        for t in self.made:
            label, node = self.labels[t], 0
            self.longest[label[-2:]] = max(self.longest.get(label[-2:], 0), len(label))
            for c in reversed(label):
                node = nodes.setdefault(node << 8 | c, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = t
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = keys.argsort()
        self.keys, self.nodes, self.ends = keys[order], np.fromiter(nodes.values(), np.int32, len(nodes))[order], np.array(ends, np.int32)
        self.by_bytes = {self.labels[t]: t for t in self.made}
        self.targets, self.lengths = np.zeros(max(self.labels) + 1, np.int32), np.zeros(max(self.labels) + 1, np.int32)
        for t, state in self.target.items():
            self.targets[t], self.lengths[t] = state, len(self.labels[t])

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the label's arc leaves the state: it was made there, and not removed since."""
        past, until = [], 1 << 60
        while state >= 0:
            if self.removed[state]:
                past.append((self.removed[state], until))
            state, born = self.origin[state]
            until = min(until, born)
        by = 1 << 60
        while True:
            for gone, until in past:
                at = gone.get(label)
                if at is not None and at < until and at <= by:
                    return False
            if label not in self.left:
                return True
            by, label = self.made[label], self.left[label]

    def word(self, data: bytes) -> list[int]:
        """The labels of the one path that spells data. Every prefix has one path too, whose last arc is found from those before."""
        state, last = [0], [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - max(self.longest.get(data[max(0, i - 2) : i], 1), 1)), i):
                label = self.by_bytes.get(data[j:i])
                if label is not None and self.arcs.one(state[j], label):
                    break
            else:
                raise ValueError("no path: the merges don't cover every byte")
            state.append(self.target[label])
            last.append(label)
        path, at = [], len(data)
        while at:
            path.append(last[at])
            at -= len(self.labels[last[at]])
        return path[::-1]

    def words(self, batch: list[bytes]) -> list[list[int]]:
        """word() of each of a sorted batch, all at once: prefixes that neighbours share are worked out once."""
        n, size = len(batch), max(map(len, batch))
        text = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in batch), np.uint8).reshape(n, size).T
        lengths = np.fromiter(map(len, batch), np.int64, n)
        shared = np.zeros(n, np.int64)  # bytes that a word has in common with the one before it
        if n > 1:
            shared[1:] = np.minimum(np.logical_and.accumulate(text[:, 1:] == text[:, :-1], axis=0).sum(0), np.minimum(lengths[1:], lengths[:-1]))
        state, last, rows = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int32), np.arange(n)
        for i in range(1, size + 1):
            new = (lengths >= i) & (shared < i)
            own = np.flatnonzero(new)
            node, alive, found = np.zeros(len(own), np.int64), np.arange(len(own)), []
            for k in range(1, i + 1):  # labels of k bytes that end here
                key = node[alive] << 8 | text[i - k, own[alive]]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                alive = alive[known]
                if not len(alive):
                    break
                node[alive] = self.nodes[at[known]]
                label = self.ends[node[alive]]
                ends = label >= 0
                found.append((k, alive[ends], label[ends]))
            open_ = np.ones(len(own), bool)
            for k, some, label in reversed(found):
                left = open_[some]
                some, label = some[left], label[left]
                ok = self.arcs.all(state[i - k, own[some]], label)
                some, label = some[ok], label[ok]
                open_[some] = False
                state[i, own[some]], last[i, own[some]] = self.targets[label], label
            if open_.any():
                raise ValueError("no path: the merges don't cover every byte")
            owner = np.maximum.accumulate(np.where(new, rows, 0))
            state[i], last[i] = state[i, owner], last[i, owner]
        steps, at, left = [], lengths, rows
        while len(left):
            label = last[at, left]
            steps.append((left, label))
            at = at - self.lengths[label]
            left, at = left[at > 0], at[at > 0]
        row, label = np.concatenate([r for r, _ in steps][::-1]), np.concatenate([x for _, x in steps][::-1])
        order = row.argsort(kind="stable")
        flat, cuts = label[order].tolist(), np.cumsum(np.bincount(row, minlength=n)).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Arcs:
    """The transition table: presence of the arcs that were asked for, in open addressing; started anew when half full."""

    def __init__(self, has_arc: Callable[[int, int], bool], slots: int = KEEP_SLOTS) -> None:
        self.has_arc, self.table, self.used = has_arc, np.full(slots, -1, np.int64), 0
        self.few: dict[tuple[int, int], bool] = {}  # of words that are run by themselves

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (len(self.table) - 1)

    def one(self, state: int, label: int) -> bool:
        ok = self.few.get((state, label))
        if ok is None:
            if len(self.few) > KEEP_WORDS:
                self.few.clear()
            ok = self.few[state, label] = self.has_arc(state, label)
        return ok

    def all(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 20 | label
        out, todo, at, new = np.zeros(len(key), bool), np.arange(len(key)), self._slot(key), []
        while len(todo):
            entry = self.table[at]
            hit, none = entry >> 1 == key[todo], entry < 0
            out[todo[hit]] = entry[hit] & 1
            new.append(todo[none])
            more = ~(hit | none)
            todo, at = todo[more], (at[more] + 1) & (len(self.table) - 1)
        unknown = np.concatenate(new) if new else todo
        if len(unknown):
            keys, back = np.unique(key[unknown], return_inverse=True)
            there = np.array([self.has_arc(k >> 20, k & 0xFFFFF) for k in keys.tolist()], bool)
            out[unknown] = there[back]
            self._put(keys << 1 | there)
        return out

    def _put(self, entries: np.ndarray) -> None:
        if 2 * (self.used + len(entries)) > len(self.table):
            self.table[:], self.used = -1, 0
            entries = entries[: len(self.table) // 2]
        self.used += len(entries)
        at = self._slot(entries >> 1)
        while len(entries):
            free = self.table[at] < 0
            self.table[at[free]] = entries[free]
            left = self.table[at] != entries
            entries, at = entries[left], (at[left] + 1) & (len(self.table) - 1)


class Codec:
    """Encodes and decodes whole texts; keeps the words it has met, up to a bound."""

    def __init__(self, spec: dict) -> None:
        self.automaton = Automaton(spec)
        self.labels = {str(i): label for i, label in self.automaton.labels.items()}
        self.names = {i: str(i) for i in self.automaton.labels}
        self.added = {s: str(i) for s, i in spec["added"].items()}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known, self.older = dict(self.added), {}

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[str]:
        """encode() of each; words that aren't known yet are looked up for many texts at once."""
        out: list[list[str]] = [[] for _ in texts]
        part, chars = [], 0
        for i, text in enumerate(texts):
            for words, size in self._words(text):
                part.append((i, words))
                chars += size
                if chars >= PART_CHARS:
                    self._emit(part, out)
                    part, chars = [], 0
        self._emit(part, out)
        return [",".join(x) for x in out]

    def _words(self, text: str) -> Iterator[tuple[list[str], int]]:
        """The words of a text and their number of characters, in parts where it is long."""
        pieces = self.split.split(text) if self.split is not None and any(s in text for s in self.added) else [text]
        for piece in pieces:
            if piece in self.added:
                yield [piece], len(piece)
            elif piece:
                split = FULL_WORDS if NOT_PLAIN.search(piece) else PLAIN_WORDS
                if len(piece) <= PART_CHARS:
                    yield split.findall(piece), len(piece)
                else:
                    found = (m.group() for m in split.finditer(piece))
                    while words := list(islice(found, PART_CHARS // 8)):
                        yield words, sum(map(len, words))

    def _emit(self, part: list[tuple[int, list[str]]], out: list[list[str]]) -> None:
        here: set[str] = set()
        for _, words in part:
            here.update(words)
        if len(self.known) > KEEP_WORDS:
            self.known, self.older = dict(self.added), self.known
        known = self.known
        fresh = []
        for word in here.difference(known):
            ids = self.older.get(word)
            if ids is None:
                fresh.append(word)
            else:
                known[word] = ids
        raw = sorted((w.encode(), w) for w in fresh)
        name = self.names.__getitem__
        short = [(d, w) for d, w in raw if len(d) <= KEEP_BYTES]
        for k in range(0, len(short), 1 << 15):
            some = short[k : k + (1 << 15)]
            for (_, word), path in zip(some, self.automaton.words([d for d, _ in some]), strict=True):
                known[word] = ",".join(map(name, path))
        long = [(d, w) for d, w in raw if len(d) > KEEP_BYTES]
        for d, word in long:
            known[word] = ",".join(map(name, self.automaton.word(d)))
        for i, words in part:
            if words:
                out[i].append(",".join(map(known.__getitem__, words)))
        for _, word in long:
            del known[word]

    def decode(self, ids: str) -> str:
        """The labels of the ids, as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def codec(key: str, spec: dict) -> Codec:
    """One for each Python worker and vocabulary."""
    return held(f"bpe {key}", lambda: Codec(spec))


def _shipped(path: str) -> tuple[str, dict]:
    """The driver reads the file, whose size is that of a vocabulary; executors needn't see it. The key is a digest of its bytes."""
    with open(path, "rb") as f:
        key = hashlib.file_digest(f, "sha256").hexdigest()
    return key, load(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids: array<int>."""
    key, spec = _shipped(path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(key, spec)
        for batch in batches:
            yield pd.Series([[int(i) for i in s.split(",")] if s else [] for s in own.encode_all([t or "" for t in batch])])

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the column text, decoded from ids; null ids are none."""
    key, spec = _shipped(path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(key, spec)
        for batch in batches:
            yield pd.Series([own.decode(",".join(map(str, x)) if x is not None else "") for x in batch])

    return docs.withColumn(text, run(F.col(ids)))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text is encoded, and decoded from its ids, in one pass without a shuffle."""
    key, spec = _shipped(path)

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, sha = codec(key, spec), hashlib.sha256
        for batch in batches:
            rows, part, chars = [], [], 0
            for t in [*batch, ...]:
                if t is not ...:
                    part.append(t or "")
                    chars += len(part[-1])
                if t is ... or chars >= PART_CHARS:
                    for ids in own.encode_all(part):
                        rows.append((ids.count(",") + 1 if ids else 0, sha(ids.encode()).hexdigest(), sha(own.decode(ids).encode()).hexdigest()))
                    part, chars = [], 0
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            del batch, rows, part, t
        release_memory()

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*")
