"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 bytes with word ends) and of
itself, hashed into ``BUCKETS``; runs of over ``PIECE`` bytes, as in text without spaces, are read whole as overlapping
pieces, each a word of its own. Every word of a text counts, repeats too, in windows of ``WINDOW`` words; a window is
the mean of its words, and a linear softmax on it tells toxic from clean. A document is judged by its worst windows
(log-sum-exp pooling), so that a few words in a long text are not averaged away.

Embeddings and softmax learn together by Adagrad on minibatches of a bounded sample of labelled documents
(``labelled.sample``). N-grams of fewer than ``SEEN_IN`` training documents keep a zero vector, so words never met add
nothing but the n-grams that they share with known ones. The pooled logit is calibrated on scores that every sampled
document gets from a model trained without it (``FOLDS`` folds by class), under the constraints that more toxic windows
never lower a score and more windows never raise it; where these leave nothing, as with labels of one class or too few to
tell, every score is the share of toxic documents among the labels.

After training a word's logit is one number, so scoring is a dictionary lookup per word.
Null and empty texts have no words and get the score of a neutral window. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.labelled import platt, sample

BITS, DIM, WINDOW, LEAST = 17, 8, 2, 2
SEEN_IN, FOLDS, EPOCHS = 2, 3, 10
BUCKETS = 1 << BITS
PIECE, OVERLAP = 64, 16
_K = np.uint64(0x9E3779B97F4A7C15)
THRESHOLD = 0.3
_CLEAN = bytes(c + 32 if 65 <= c < 91 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """All words of a text in order, lower-cased; long ones in overlapping pieces."""
    found = (text or "").lower().encode("utf-8", "replace").translate(_CLEAN).split()
    if any(len(w) > PIECE for w in found):
        step = PIECE - OVERLAP
        found = [w[k : k + PIECE] for w in found for k in range(0, max(len(w) - OVERLAP, 1), step)]
    return found


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, word by word, and their number for each word."""
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    chars = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.repeat(np.cumsum(size), size)
    owner, place = np.repeat(np.arange(len(words)), size), np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    found, whose = [], []
    for n in (3, 4, 5):
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * _K + chars[k : len(chars) - n + 1 + k]
            ok = np.arange(len(h)) + n <= ends[: len(h)]
            found.append(h[ok])
            whose.append(owner[: len(h)][ok])
    powers = np.cumprod(np.full(size.max(), _K, np.uint64), dtype=np.uint64)
    found.append(np.add.reduceat(chars * powers[place], np.cumsum(size) - size))
    whose.append(np.arange(len(words)))
    whose_all = np.concatenate(whose)
    order = np.argsort(whose_all, kind="stable")
    h = np.concatenate(found)[order]
    h = (h ^ (h >> np.uint64(29))) * _K
    return (h >> np.uint64(64 - BITS)).astype(np.int32), np.bincount(whose_all, minlength=len(words))


@dataclass
class Model:
    """The words that a Python worker has seen stay in ``seen`` from task to task."""

    values: np.ndarray  # logit contribution of each bucket
    bias: float
    scale: float
    spread: float
    shift: float
    seen: dict[bytes, float] = field(default_factory=dict)

    def learn(self, words: list[bytes], known: dict[bytes, float]) -> None:
        """Put the logits of ``words`` into ``known``."""
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            flat, n = grams_of(some)
            total = np.add.reduceat(self.values[flat].astype(float), np.cumsum(n) - n)
            known.update(zip(some, (total / n).tolist(), strict=True))


def _pool(logits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp of each document's window logits, and each window's share in it."""
    top = np.maximum.reduceat(logits, first)
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(logits))))
    e = np.exp(np.clip(logits - top[own], -60, 0))
    total = np.add.reduceat(e, first)
    return top + np.log(total), e / total[own]


@dataclass
class Bags:
    """Texts as word numbers, and the n-gram buckets of those words end to end."""

    texts: list[np.ndarray]
    flat: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, texts: list) -> Bags:
        known: dict[bytes, int] = {}
        numbered = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int32) for t in texts]
        words = list(known) or [b""]
        parts = [grams_of(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
        return cls(numbered, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of ``words`` end to end, number of each)."""
        n = self.size[words]
        ends, first = np.cumsum(n), (np.cumsum(self.size) - self.size)[words]
        return self.flat[np.arange(n.sum()) + np.repeat(first - ends + n, n)], n

    def seen_in(self, rows: np.ndarray) -> np.ndarray:
        """Number of texts among ``rows`` that hold each bucket."""
        out = np.zeros(BUCKETS, np.int32)
        for r in rows:
            out[np.unique(self.grams(np.unique(self.texts[r]))[0])] += 1
        return out


def learn(bags: Bags, y: np.ndarray, rows: np.ndarray, batch: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """(logit contribution of each bucket, bias) after joint training on ``rows``."""
    rng, ok = np.random.default_rng(seed), bags.seen_in(rows) >= SEEN_IN
    # gradients of all vectors point along the difference of the softmax's two columns, so one number a bucket carries them
    half = rng.normal(0, 0.5, DIM).astype(np.float32)
    table, soft, bias = np.zeros((BUCKETS, DIM), np.float32), np.column_stack([-half, half]), np.zeros(2, np.float32)
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    rows = np.array([r for r in rows if len(bags.texts[r])], np.int64)
    for epoch in range(EPOCHS):
        rate = np.float32(0.25 * (1 - epoch / EPOCHS) + 0.01)
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            some = rows[k : k + batch]
            count = np.array([len(bags.texts[r]) for r in some])
            words, which = np.unique(np.concatenate([bags.texts[r] for r in some]), return_inverse=True)
            grams, n = bags.grams(words)
            apart = soft[:, 1] - soft[:, 0]
            word_logit = np.add.reduceat((table @ apart)[grams].astype(float), np.cumsum(n) - n) / n
            window, first = _window_of(count)
            weight = 1 / np.maximum(np.bincount(window), LEAST)
            logit = np.bincount(window, word_logit[which]) * weight + bias[1] - bias[0]
            pooled, share = _pool(logit, first)
            g = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y[some]) / len(some)
            gl = np.repeat(g, np.diff(np.append(first, len(logit)))) * share
            gw = np.bincount(which, (gl * weight)[window], len(words)) / n
            gt = np.where(ok, np.bincount(grams, np.repeat(gw, n), BUCKETS), 0).astype(np.float32)
            gd, gb = table.T @ gt, gl.sum()
            seen_table += gt * gt * (apart * apart).mean()
            table -= np.outer(rate * gt / np.sqrt(seen_table), apart)
            for p, grad, seen in ((soft, np.column_stack([-gd, gd]), seen_soft), (bias, np.array([-gb, gb]), seen_bias)):
                seen += grad * grad
                p -= rate * grad / np.sqrt(seen)
    return table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(scale, spread, shift) of a logistic fit on (pooled logit, log of windows), scale >= 0 and spread <= 0:
    a weight that would break its bound is left out and the rest fitted again."""
    for columns in ((0, 1), (0,)):
        weights = platt(x[:, columns], y)
        fitted = dict(zip(columns, weights[:-1].tolist(), strict=True))
        if fitted[0] >= 0 and fitted.get(1, 0.0) <= 0:
            return fitted[0], fitted.get(1, 0.0), float(weights[-1])
    return 0.0, 0.0, _odds(float(y.mean()))


def train(data: pd.DataFrame, prior: float | None = None) -> Model:
    """``prior``: share of toxic documents among all labelled ones, to which the calibration is moved."""
    y = data["y"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.0
    moved = 0.0 if prior is None else _odds(prior) - _odds(share)
    constant = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0, _odds(share) + moved)
    if min(y.sum(), len(y) - y.sum()) < 2:
        return constant
    bags = Bags.of(data["text"].tolist())
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    x = np.empty((len(y), 2))
    for k in np.unique(fold):
        values, bias = learn(bags, y, np.flatnonzero(fold != k))
        checked = np.flatnonzero(fold == k)
        x[checked] = worst(Model(values, bias, 1.0, 0.0, 0.0), data["text"].iloc[checked].tolist(), {})
    scale, spread, shift = calibrate(x, y)
    return Model(*learn(bags, y, np.arange(len(y))), scale, spread, shift + moved)


def _odds(share: float) -> float:
    return float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))


def _window_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window number of each word of texts laid end to end, and each text's first window."""
    windows = -(-count // WINDOW)
    first = np.cumsum(windows) - windows
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + place // WINDOW, first


def worst(model: Model, texts: list, known: dict[bytes, float]) -> np.ndarray:
    """(pooled window logit, log of the number of windows) of each text."""
    out = np.empty((len(texts), 2))
    for some in range(0, len(texts), 100):
        lists = [words_of(t) for t in texts[some : some + 100]]
        if len(known) > 150_000:
            known.clear()
        model.learn(list({w for words in lists for w in words}.difference(known)), known)
        for k, words in enumerate(lists, start=some):
            n = len(words)
            if n == 0:
                out[k] = model.bias, 0.0
                continue
            first = np.arange(0, n, WINDOW)
            means = np.add.reduceat(np.fromiter(map(known.__getitem__, words), float, n), first) / np.maximum(np.diff(np.append(first, n)), LEAST) + model.bias
            top = means.max()
            out[k] = top + np.log(np.exp(means - top).sum()), np.log(len(first))
    return out


def scores(model: Model, texts: list, known: dict[bytes, float]) -> np.ndarray:
    """One score per text; ``known`` keeps words' logits and is emptied when it grows large."""
    x = worst(model, texts, known)
    return 1 / (1 + np.exp(-np.clip(model.scale * x[:, 0] + model.spread * x[:, 1] + model.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    marks = labels.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
    return train(sample(docs, labels, "toxic", modulus, held_out), marks.agg(F.avg("toxic")).first()[0])


def score_column(spark, model: Model):
    held = spark.sparkContext.broadcast(model)  # 2**17 floats

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        for texts in batches:
            yield pd.Series(scores(model, texts.tolist(), model.seen))

    return score


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored under ``THRESHOLD``, columns as they are."""
    score = score_column(docs.sparkSession, fit(docs, labels))
    return docs.where(score(F.col("text")) < THRESHOLD)
