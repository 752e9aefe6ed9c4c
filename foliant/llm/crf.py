"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are its own shares of symbols, capitals, repeated words and
so on, and the same of the lines before and after it. Training lines first take their document's label;
from then on, the lines of bad documents are told apart: at every step of ``RELABEL`` those that the model so far
finds good become good, but for the document's worst line, so that transitions between good and bad are learnt too.
Weights and transitions are fitted by gradient ascent on the chains' likelihood, with expectations
from forward-backward. A document's raw quality is the mean of its lines' marginals of good, weighted
by their length, then calibrated on a fifth of the sample that did not train.

Null and empty texts are one empty line. With labels of one class only, every score is that class's
share. Repeated rows score alike; lines are split at \\n only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.labelled import platt, sample
from foliant.llm.textblocks import blocks, word_hashes

THRESHOLD = 0.3
RELABEL = (40, 55, 70)
_SYMBOL, _UPPER, _DIGIT, _LETTER, _BANG = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.int64)
_KIND[list(b"#*$%&|<>{}[]\\^~=_@")] = _SYMBOL
_KIND[65:91] = _UPPER
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_KIND[list(b"!?")] = _BANG
OWN = 10


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes + 1, first line of each text with the end)."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    per_text = 1 + np.bincount(owner, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(per_text)])
    start = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    start[is_first] = offsets[:-1]
    start[~is_first] = breaks + 1
    end = np.empty_like(start)
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    end[is_last] = offsets[1:]
    end[~is_last] = breaks
    lines = len(start)
    edges = np.append(start, offsets[-1])
    line_of = np.repeat(np.arange(lines), np.diff(edges))
    kinds = np.bincount(line_of * 6 + _KIND[data], minlength=lines * 6).reshape(lines, 6).astype(float)
    words, word_first = word_hashes(data, edges)
    count = np.diff(word_first).astype(float)
    word_line = np.repeat(np.arange(lines), np.diff(word_first))
    again = np.zeros(len(words))
    for gap in (1, 2, 3):
        same = np.zeros(len(words), bool)
        same[gap:] = (words[gap:] == words[:-gap]) & (word_line[gap:] == word_line[:-gap])
        again = np.maximum(again, same)
    repeats = np.bincount(word_line, weights=again, minlength=lines)
    place = np.arange(len(words)) - word_first[word_line]
    whole = np.zeros(lines, np.uint64)
    np.add.at(whole, word_line, words * (2 * place.astype(np.uint64) + np.uint64(1)))
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    rank = np.lexsort((np.arange(lines), whole, text_of))
    seen = np.zeros(lines)
    seen[rank[1:]] = (whole[rank[1:]] == whole[rank[:-1]]) & (text_of[rank[1:]] == text_of[rank[:-1]]) & (count[rank[1:]] > 0)
    size = np.maximum(kinds.sum(1) - kinds[:, 0], 1)
    letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LETTER], 1)
    own = np.column_stack([
        np.log1p(count) / 4, kinds[:, _SYMBOL] / size, kinds[:, _UPPER] / letters, kinds[:, _BANG] / size, kinds[:, _DIGIT] / size,
        repeats / np.maximum(count, 1), seen, np.minimum(size / np.maximum(count, 1), 40) / 10, count == 0, kinds[:, 0] / np.maximum(end - start, 1),
    ])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[is_first] = 0
    after[is_last] = 0
    return np.column_stack([own, before[:, 1:7], after[:, 1:7], is_first, is_last, np.ones(lines)]), (end - start + 1).astype(float), first


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray  # log-potentials from line to line, [from, to], 1 is good
    scale: float
    shift: float


def _grid(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from most lines to fewest, and how many have more than t lines for each t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(n.max()) - 1, "right")


def marginals(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each move, by forward-backward in log-odds
    scaled form over all chains at once."""
    order, active = _grid(first)
    base = first[:-1][order]
    step = np.exp(moves)
    score = np.empty((len(emit), 2))
    score[:, 0], score[:, 1] = np.exp(-np.maximum(emit, 0)), np.exp(np.minimum(emit, 0))
    ahead = np.empty_like(score)
    back = np.ones_like(score)
    for t, k in enumerate(active):
        at = base[:k] + t
        a = score[at] if t == 0 else (ahead[at - 1] @ step) * score[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        at = base[: active[t]] + t
        b = (back[at] * score[at]) @ step.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p = p[:, 1] / p.sum(1)
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] * step[None] * (score[at] * back[at])[:, None, :]
    return p, (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(at) else np.zeros((2, 2))


def features_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of many texts, block by block."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    parts = [line_features(data, at) for _, _, data, at in blocks(batch, "text")]
    before = np.cumsum([0, *[p[2][-1] for p in parts]])
    first = np.concatenate([p[2][:-1] + n for p, n in zip(parts, before[:-1], strict=True)] + [before[-1:]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), first


def raw_quality(weights: np.ndarray, moves: np.ndarray, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    p, _ = marginals(np.clip(x @ weights, -30, 30), moves, first)
    return np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1])


def line_marks(y: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label of every line from its document's label and its own P(good): lines of good documents are good,
    those of bad documents are as the model finds them, and the worst of each is bad."""
    n = np.diff(first)
    of = np.repeat(np.arange(len(y)), n)
    worst = np.lexsort((p, of))[first[:-1]]
    mark = np.where(y[of] == 1, 1.0, (p > 0.5).astype(float))
    mark[worst[y == 0]] = 0
    return mark


def moves_of(mark: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each label follows each, within documents."""
    at = np.ones(len(mark), bool)
    at[first[:-1]] = False
    to = np.flatnonzero(at)
    return np.bincount((2 * mark[to - 1] + mark[to]).astype(np.int64), minlength=4).reshape(2, 2).astype(float)


def train(data: pd.DataFrame, epochs: int = 80) -> Model:
    y = data["y"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(OWN + 15), np.zeros((2, 2)), 0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False

    x, _, first = features_of(data["text"][~held].tolist())
    mark = np.repeat(y[~held], np.diff(first)).astype(float)
    # a chain weighs alike however many lines it has
    chain = np.repeat(1 / np.diff(first), np.diff(first))
    chain *= len(chain) / chain.sum()
    seen = moves_of(mark, first)
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    flat = np.zeros(len(w) + 4)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, epochs + 1):
        p, expected = marginals(np.clip(x @ w, -30, 30), moves, first)
        if step in RELABEL:
            mark = line_marks(y[~held], p, first)
            seen = moves_of(mark, first)
        g = np.concatenate([(x * (chain * (mark - p))[:, None]).sum(0) / len(mark) - 1e-4 * w, (seen - expected).reshape(-1) / len(mark) - 1e-2 * moves.reshape(-1)])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        flat += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, moves = flat[:-4].copy(), flat[-4:].reshape(2, 2).copy()
    check = held if held.any() else np.ones(len(y), bool)
    scale, shift = platt(raw_quality(w, moves, *features_of(data["text"][check].tolist())), y[check])
    return Model(w, moves, float(scale), float(shift))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    return train(sample(docs, labels, "quality", modulus, held_out))


def score_column(spark, model: Model):
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts.tolist(), pa.large_string())], ["text"])
            raw = [raw_quality(m.weights, m.moves, *line_features(data, at)) for _, _, data, at in blocks(batch, "text")]
            yield pd.Series(1 / (1 + np.exp(-np.clip(m.scale * np.concatenate(raw or [np.zeros(0)]) + m.shift, -40, 40))))

    return score


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored at ``THRESHOLD`` or more, columns as they are."""
    score = score_column(docs.sparkSession, fit(docs, labels))
    return docs.where(score(F.col("text")) >= THRESHOLD)
