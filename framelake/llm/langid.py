"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's emission scores come from hashed features: the whole word (a learned lexicon), its
prefixes and suffixes, and the character n-grams inside it. Transitions between the languages of
neighbouring words are learned with them, by the gradient of the conditional likelihood on
sequences in which the language changes (passages of labelled documents put one after another).
Whole texts are labelled by exact forward-backward. A text's language is the one with the greatest
mean posterior over its words, which is also its score.

Forward-backward runs over all texts of a batch at once: words are cut into blocks of BLOCK, the
transfer matrices of all blocks are multiplied out side by side, messages are passed from block to
block, and the posteriors inside the blocks follow. The result is that of the chain over the whole
text.

Defined cases: a null text or one without a letter has language `und` and score 0, as has every
text where there was nothing to learn from; equal posteriors give the language that is first by
code point; repeated rows are labelled each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import held, release_memory

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
BUCKETS, BLOCK = 1 << 16, 32
#: Words that a worker keeps the emission scores of.
KEEP_WORDS = 150_000


@dataclass(frozen=True)
class Sample:
    """The bound of what is learned from: rows of a language, passages of a row (from all over its text) and words of a passage."""

    rows: int = 300
    passages: int = 6
    words: int = 24
    seed: int = 7


def word_features(words: list[str]) -> np.ndarray:
    """(words, features): hashed, padded with BUCKETS. All words of about one length are hashed at once."""
    width = max(map(len, words)) + 2
    chars = np.zeros((len(words), width), np.uint64)
    raw = np.array(words, dtype=f"U{width - 2}").view(np.uint32).reshape(len(words), width - 2)
    n = np.array([len(w) for w in words])
    chars[:, 1:-1] = raw
    chars[:, 0] = 1
    chars[np.arange(len(words)), n + 1] = 2

    def mix(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, 0x9E3779B97F4A7C15 + kind * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return (h >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int32)

    out = []
    for size, kind in ((1, 1), (2, 2), (3, 3)):  # n-grams; the bounds of the word are characters too
        grams = mix(kind, *[chars[:, i : width - size + 1 + i] for i in range(size)])
        at = np.arange(grams.shape[1])
        out.append(np.where(at[None, :] + size <= n[:, None] + 2, grams, BUCKETS))
    rows = np.arange(len(words))
    whole = mix(4, *[chars[:, i] for i in range(min(width, 26))])
    tail = [chars[rows, np.maximum(n + 1 - i, 0)] for i in range(5)]
    out.append(np.stack([whole, mix(5, *[chars[:, i] for i in range(min(4, width))]), mix(6, *tail[:4]), mix(7, *[chars[:, min(i, width - 1)] for i in range(5)]), mix(8, *tail)], axis=1))
    return np.concatenate(out, axis=1)


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of about one length, so that a long one doesn't widen the rest."""
    n = np.array([len(w) for w in words])
    at = 8
    while len(n):
        got = np.flatnonzero((n > at // 2) & (n <= at) if at > 8 else n <= at)
        for i in range(0, len(got), 1 << 15):
            yield got[i : i + (1 << 15)]
        if at >= n.max():
            break
        at *= 2


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for idx in by_length(words):
        feats = word_features([words[i] for i in idx])
        total = np.zeros((len(idx), weights.shape[1]), np.float32)
        for c in range(feats.shape[1]):
            total += weights[feats[:, c]]
        out[idx] = total / np.sqrt((feats < BUCKETS).sum(1, keepdims=True))
    return out


def posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(label of each word | its text). scores: of all words, text after text; lengths: words of each text."""
    k = scores.shape[1]
    if not len(scores):
        return np.zeros((0, k))
    blocks = -(-lengths // BLOCK)
    n_blocks = int(blocks.sum())
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(scores)) - starts[text_of]
    cell = (first[text_of] + inside // BLOCK, inside % BLOCK)
    psi = np.ones((n_blocks, BLOCK, k))
    psi[cell] = np.exp(scores - scores.max(1, keepdims=True))
    real = np.zeros((n_blocks, BLOCK), bool)
    real[cell] = True
    step = np.exp(trans - trans.max())
    transfer = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for i in range(BLOCK):
        nxt = (transfer @ step) * psi[:, i, None, :]
        nxt /= nxt.max((1, 2), keepdims=True)
        transfer = np.where(real[:, i, None, None], nxt, transfer)
    enter, leave = np.full((n_blocks, k), 1.0 / k), np.full((n_blocks, k), 1.0 / k)
    most = int(blocks.max())
    order = np.argsort(-blocks, kind="stable")
    ends = np.searchsorted(-blocks[order], -np.arange(most), side="left")  # texts with more than i blocks
    for i in range(most - 1):
        at = first[order[: ends[i + 1]]] + i
        msg = np.einsum("bi,bij->bj", enter[at], transfer[at])
        enter[at + 1] = msg / msg.sum(1, keepdims=True)
    for i in range(most - 1, 0, -1):
        at = first[order[: ends[i]]] + i
        msg = np.einsum("bij,bj->bi", transfer[at], leave[at])
        leave[at - 1] = msg / msg.sum(1, keepdims=True)
    ahead = np.empty((n_blocks, BLOCK, k))
    alpha = enter
    for i in range(BLOCK):
        nxt = (alpha @ step) * psi[:, i]
        nxt /= nxt.sum(1, keepdims=True)
        alpha = np.where(real[:, i, None], nxt, alpha)
        ahead[:, i] = alpha
    beta = leave
    for i in range(BLOCK - 1, -1, -1):
        gamma = ahead[:, i] * beta
        nxt = (psi[:, i] * beta) @ step.T
        nxt /= nxt.sum(1, keepdims=True)
        beta = np.where(real[:, i, None], nxt, beta)
        ahead[:, i] = gamma / gamma.sum(1, keepdims=True)
    return ahead[cell]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    key: str


def pair_posteriors(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words and sums of marginals of neighbours, of sequences of one length: (sequences, words, labels)."""
    n, t, k = scores.shape
    step, psi = np.exp(trans), np.exp(scores - scores.max(2, keepdims=True))
    alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
    alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ step) * psi[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        right = psi[:, i + 1] * beta[:, i + 1]
        joint = alpha[:, i, :, None] * step[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = right @ step.T
        beta[:, i] = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), pairs


def train(passages: list[tuple[str, list[str]]], sample: Sample = Sample(), rounds: int = 40, rate: float = 0.3, decay: float = 1e-4) -> Model | None:
    """passages: (label, words). Two to four passages of any languages in a row make a sequence."""
    passages = sorted((label, words) for label, words in passages if words)
    labels = sorted({label for label, _ in passages})
    if not labels:
        return None
    rng, k = np.random.default_rng(sample.seed), len(labels)
    vocab: dict[str, int] = {}
    stream_w, stream_y = [], []
    for _ in range(2):
        for i in rng.permutation(len(passages)):
            label, words = passages[i]
            cut = int(rng.integers(max(1, len(words) // 4), len(words) + 1))  # so that runs have many lengths
            stream_w += [vocab.setdefault(w, len(vocab)) for w in words[:cut]]
            stream_y += [labels.index(label)] * cut
    t = 48
    n = max(1, -(-len(stream_w) // t))
    x, y = np.resize(np.array(stream_w), (n, t)), np.resize(np.array(stream_y), (n, t))
    words = list(vocab)
    parts = [(idx, word_features([words[i] for i in idx])) for idx in by_length(words)]
    scale = [1 / np.sqrt((f < BUCKETS).sum(1, keepdims=True)) for _, f in parts]
    weights, trans = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((k, k))
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    truth_pairs = np.zeros((k, k))
    np.add.at(truth_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    truth = np.zeros((len(words), k))
    np.add.at(truth, (x.ravel(), y.ravel()), 1)
    for _ in range(rounds):
        em = np.zeros((len(words), k))
        for (idx, f), s in zip(parts, scale, strict=True):
            em[idx] = sum(weights[f[:, c]] for c in range(f.shape[1])) * s
        gamma, pairs = pair_posteriors(em[x], trans)
        diff = truth.copy()
        for c in range(k):
            diff[:, c] -= np.bincount(x.ravel(), gamma[:, :, c].ravel(), len(words))
        grad = np.zeros((BUCKETS + 1, k))
        for (idx, f), s in zip(parts, scale, strict=True):
            d = diff[idx] * s
            for c in range(k):
                grad[:, c] += np.bincount(f.ravel(), np.repeat(d[:, c], f.shape[1]), BUCKETS + 1)
        grad = grad / len(x) - decay * weights
        grad[BUCKETS] = 0
        seen_w += grad**2
        weights += (rate * grad / np.sqrt(seen_w)).astype(np.float32)
        grad_t = (truth_pairs - pairs) / len(x) - decay * trans
        seen_t += grad_t**2
        trans += rate * grad_t / np.sqrt(seen_t)
    return Model(labels, weights, trans, hashlib.sha256(weights.tobytes() + trans.tobytes()).hexdigest())


def passages_of(labelled: DataFrame, sample: Sample = Sample()) -> list[tuple[str, list[str]]]:
    """Bounded: sample.rows rows of a language at most, chosen by a hash of their doc_id; passages from all over their texts."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    h = F.pmod(F.xxhash64("doc_id", F.lit(sample.seed)), F.lit(1 << 30))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        # on average; never more than twice that, see below
        keep = keep | ((F.col("lang") == lang) & (h < int(min(1.0, sample.rows / n) * (1 << 30))))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def some(text: str) -> list[str]:
            words = WORDS.findall(text.lower())
            step = max(sample.words, len(words) // sample.passages)
            return [" ".join(words[i : i + sample.words]) for i in range(0, len(words), step)][: sample.passages + 1]

        return texts.map(some)

    rows = labelled.filter(keep).select("lang", cut("text").alias("p"), h.alias("h"), "doc_id").orderBy("h", "doc_id").limit(2 * sample.rows * max(1, len(counts))).collect()
    return [(r["lang"], p.split(" ")) for r in rows for p in r["p"] if p]


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, sample: Sample = Sample(), held_out: int = 2) -> Model | None:
    """Learns from text and lang of the rows whose crc32(doc_id) modulo 4 isn't held_out; a null doc_id is never learned from."""
    return train(passages_of(docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != held_out)), sample), sample)


class Labeller:
    """Emission scores by word, kept up to a bound, and the posteriors of whole texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.labels)), np.float32)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """By text: the language of the greatest mean posterior, that mean, and the mean of each word's greatest posterior."""
        if len(self.index) > KEEP_WORDS:
            self._clear()
        index, known = self.index, len(self.index)
        flat, lengths = [], []
        for text in texts:
            words = WORDS.findall(text.lower()) if text else []
            if words and not text.isascii():
                words = [w for w in words if w.isascii() or any(map(str.isalpha, w))]
            flat += [index.setdefault(w, len(index)) for w in words]
            lengths.append(len(words))
        if len(index) > known:
            fresh = emissions(self.model.weights, list(index)[known:])
            if len(index) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((len(index), self.scores.shape[1]), np.float32)])
            self.scores[known : len(index)] = fresh
        n = np.array(lengths, np.int64)
        some = np.flatnonzero(n)
        post = posteriors(self.scores[np.array(flat, np.int64)], n[some], self.model.trans)
        langs, scores, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            means = np.add.reduceat(post, starts, axis=0) / n[some][:, None]
            means = np.round(means, 12)
            best = np.add.reduceat(post.max(1), starts) / n[some]
            for i, j, m, b in zip(some, means.argmax(1), means, best, strict=True):
                langs[i], scores[i], sure[i] = self.model.labels[j], float(min(1.0, max(0.0, m[j]))), float(min(1.0, b))
        return langs, scores, sure


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """struct<lang_pred: string, score: double, sure: double> of a text; sure is the mean of each word's greatest posterior, whatever its language. A batch of rows is worked on in parts of about a million characters."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("sure"))

    @F.pandas_udf("struct<lang_pred: string, score: double, sure: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held(f"langid {model.key}", lambda: Labeller(model))
        for batch in batches:
            langs, scores, sure, part, chars = [], [], [], [], 0
            for t in [*batch, ...]:
                if t is not ...:
                    part.append(t)
                    chars += len(t or "")
                if part and (t is ... or chars >= 1_000_000):
                    a, b, c = own.texts(part)
                    langs += a
                    scores += b
                    sure += c
                    part, chars = [], 0
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "sure": sure})
            del batch, t
        release_memory()

    return run(F.col(text))


def identify(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows that aren't held out."""
    model = fit(docs, sample)
    return docs.select("doc_id", (fold() == 2).alias("held_out"), predict(docs, model).alias("r")).select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "r.lang_pred", "r.score")
