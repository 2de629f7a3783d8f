"""Quality classifier with supervised subword embeddings.

Features are hashed: words, pairs of neighbouring words, character n-grams of words with their
borders, and a mark for a word that repeats the one before. Each feature has a learned vector; a document is the average of its features'
vectors, and a softmax over two outputs gives the probability of label 1. Vectors and output
weights are trained together by stochastic gradient descent in numpy.

For scoring, a feature's vector is folded with the output weights into one number, so a whole
text costs one table look-up per feature and constant memory per chunk.

Null, empty and blank texts have no feature and get the share of label 1 in training. Repeated
rows and ties get equal scores, an empty table an empty result; texts of any length are scored whole. The score's column gets
another name if the table has one of that name. Without training rows of both labels the score is that constant share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh, label_share, labelled_sample, prior_shift, sigmoid, text_chunks

_BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
#: Bucket of a word that repeats the one before; no other feature is put there.
_REPEAT = 1


@dataclass(frozen=True)
class QualityConfig:
    dim: int = 8
    log2_buckets: int = 18
    char_ngrams: tuple[int, ...] = (3, 4)
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7
    train_per_class: int = 1500  # bound of the training sample
    train_max_chars: int = 40_000


@dataclass(frozen=True)
class QualityModel:
    table: np.ndarray = field(repr=False)  # one logit contribution for each bucket
    bias: float
    prior: float
    config: QualityConfig


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    out = (h >> np.uint32(32 - bits)).astype(np.int32)
    out[out == _REPEAT] = 0
    return out


def features(texts: list[str], cfg: QualityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: its buckets, and the document of each, in document order."""
    parts = [f" {x} ".encode("utf-8", "replace").translate(_BLANK) for x in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    if not len(raw):
        return
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
    blank = raw == 32
    code = raw.astype(np.uint32) + np.uint32(1)
    prime = np.uint32(16777619)
    # character n-grams that have blanks at their ends at most
    h = code.copy()
    inner = np.zeros(len(raw), bool)
    for n in range(2, max(cfg.char_ngrams) + 1):
        h = h[:-1] * prime + code[n - 1 :]
        inner = np.zeros(len(h), bool) if n == 2 else inner[: len(h)] | blank[n - 2 : n - 2 + len(h)]
        if n in cfg.char_ngrams:
            at = np.flatnonzero(~inner)
            yield _slots(h[at] + np.uint32(n * 7919), cfg.log2_buckets), doc[at]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(starts):
        stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        power = np.cumprod(np.r_[np.uint32(1), np.full(63, prime, np.uint32)], dtype=np.uint32)
        place = np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))
        word = np.add.reduceat(np.where(blank, np.uint32(0), code * power[place & 63]), starts, dtype=np.uint32)
        word ^= (stops - starts).astype(np.uint32) << np.uint32(20)
        of = np.searchsorted(ends, starts, side="right").astype(np.int32)
        yield _slots(word + np.uint32(101), cfg.log2_buckets), of
        pair = np.flatnonzero(of[:-1] == of[1:])
        yield _slots(word[pair] * np.uint32(31) + word[pair + 1] + np.uint32(977), cfg.log2_buckets), of[pair]
        # pairs of the same word, whatever the word: one feature
        same = pair[word[pair] == word[pair + 1]]
        yield np.full(len(same), _REPEAT, np.int32), of[same]


def train(rows: list[tuple[str, int]], config: QualityConfig = QualityConfig(), share: float | None = None) -> QualityModel:
    """Vectors and output weights from (text, label) rows, by stochastic gradient descent.
    ``share``: that of label 1 where the model is used, if the rows were chosen with another."""
    cfg, size = config, 1 << config.log2_buckets
    y = np.array([v for _, v in rows], float)
    prior, natural = float((y.sum() + 0.5) / (len(y) + 1)), share
    bias0 = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(size, np.float32), bias0, prior, cfg)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(rows), 64):
        texts = [x for x, _ in rows[i : i + 64]]
        kinds = list(features(texts, cfg))
        slots, docs = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
        key, n = np.unique(docs.astype(np.int64) * size + slots, return_counts=True)
        cut = np.searchsorted(key // size, np.arange(len(texts) + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            c = n[a:b].astype(np.float32)
            bags.append(((key[a:b] % size).astype(np.int32), c / max(c.sum(), 1)))
    rng = np.random.default_rng(cfg.seed)
    vec = rng.uniform(-1, 1, (size, cfg.dim)).astype(np.float32) / cfg.dim
    out = np.zeros((cfg.dim, 2), np.float32)
    bias = np.array([0.0, bias0], np.float32)
    steps, done = cfg.epochs * len(bags), 0
    # an average of a thousand features moves slowly: rates of vectors grow with their number
    for _ in range(cfg.epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            lr = cfg.rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            mean = share @ vec[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            vec[ids] -= lr * min(len(ids), 400) * share[:, None] * back[None, :]
    table = vec @ (out[:, 1] - out[:, 0])
    shift = prior_shift(natural, int(y.sum()), int(len(y) - y.sum()))
    return QualityModel(table.astype(np.float32), float(bias[1] - bias[0]) + shift, prior if natural is None else natural, cfg)


def score_texts(model: QualityModel, texts: list[str]) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for slots, docs in features(texts, model.config):
        total += np.bincount(docs, weights=model.table[slots], minlength=len(texts))
        n += np.bincount(docs, minlength=len(texts))
    return np.where(n > 0, sigmoid(total / np.maximum(n, 1) + model.bias), model.prior)


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Train on labelled rows whose id is not held out (crc32 modulo 4 is not 2); the sample is
    bounded by ``train_per_class`` rows a class and ``train_max_chars`` characters a row."""
    own = fold(F.col("_id"), 4) != 2
    rows = labelled_sample(docs, labels, "quality", own, config.train_per_class, config.train_max_chars)
    return train(rows, config, label_share(labels, "quality", own))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with the score (double, 0 to 1) of each whole text as another column."""
    out_col = fresh(out_col, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                s = pa.array(score_texts(model, texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, s], [*part.schema.names, out_col])

    return docs.mapInArrow(run, schema)
