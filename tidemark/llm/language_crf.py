"""Language identification with a linear-chain conditional random field.

Every word gets a label (a language). A word's emission scores are sums of learned weights of
hashed features: prefixes and suffixes of 1 to 3 bytes, inner n-grams of 2 and 3 bytes, and
whether it stands in a language's learned lexicon. Transitions between the labels of neighbouring
words are learned too. Training sequences are spliced from pieces of documents of different
languages, so switches inside a text are seen; weights maximise the conditional likelihood
(AdaGrad on exact gradients by forward-backward).

Forward-backward runs over whole texts, in blocks: transfer matrices of all blocks of 64 words are
multiplied in step, block borders are carried along each text, and marginals are filled in
inside the blocks. So a text of any length is exact, and the number of numpy calls depends on the
longest text in blocks, not in words.

A document's language is the label with the largest mean marginal over words with a letter; its
score is that mean. A letter is a code point of a Unicode category L. Null texts and texts without a letter
are ``und`` with score 0. Repeated rows get equal results, ties the first language in order. Without
training rows everything is ``und``; an empty table gives an empty result. New columns get other names
if the table has them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, fresh, passage, text_chunks

_BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_BLOCK = 64


@dataclass(frozen=True)
class CrfConfig:
    log2_buckets: int = 16
    per_language: int = 300  # bound of the training sample: documents of each language
    max_chars: int = 40_000  # of a training document; a passage of a longer one is taken
    piece_words: int = 100  # of a training document's piece
    lexicon: int = 400  # words of each language
    epochs: int = 6
    rate: float = 0.2
    seed: int = 11


@dataclass(frozen=True)
class CrfModel:
    labels: tuple[str, ...]
    weights: np.ndarray = field(repr=False)  # buckets x labels
    transitions: np.ndarray = field(repr=False)  # labels x labels
    lexicon: tuple[np.ndarray, np.ndarray] = field(repr=False)  # sorted word hashes, their labels
    config: CrfConfig = CrfConfig()


def _slots(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h + np.uint32(salt)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


class Words:
    """The words of some texts as borders in one buffer of lower-case bytes."""

    def __init__(self, texts: list[str]):
        parts = [f" {x.lower()} ".encode("utf-8", "replace").translate(_BLANK) for x in texts]
        self.raw = np.frombuffer(b"".join(parts) or b" ", np.uint8)
        blank = self.raw == 32
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(ends, self.starts, side="right")
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        code = self.raw.astype(np.uint32) + np.uint32(1)
        p = np.uint32(16777619)
        two = np.append(code[:-1] * p + code[1:], np.uint32(0))
        three = np.append(two[:-1] * p + np.append(code[2:], np.uint32(0)), np.uint32(0))
        self.hashes = {1: code, 2: two, 3: three}
        power = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x100000001B3, np.uint64)], dtype=np.uint64)
        if len(self.starts):
            place = np.arange(len(self.raw)) - np.repeat(np.r_[0, self.starts], np.diff(np.r_[0, self.starts, len(self.raw)]))
            value = np.where(blank, np.uint64(0), (self.raw.astype(np.uint64) + np.uint64(1)) * power[place & 63])
            self.ids = np.add.reduceat(value, self.starts, dtype=np.uint64)
            # ASCII letters by bytes (lower case); words of other code points only are looked at
            inside = ~blank
            self.has_letter = np.logical_or.reduceat((self.raw >= 97) & (self.raw <= 122) & inside, self.starts)
            rest = np.flatnonzero(~self.has_letter & np.logical_or.reduceat(self.raw >= 0x80, self.starts))
            data, known = self.raw.tobytes(), {}
            for i, a, b in zip(rest.tolist(), self.starts[rest].tolist(), self.stops[rest].tolist(), strict=True):
                word = data[a:b]
                if word not in known:
                    known[word] = any(map(str.isalpha, word.decode()))
                self.has_letter[i] = known[word]
        else:
            self.ids, self.has_letter = np.empty(0, np.uint64), np.empty(0, bool)

    def features(self, bits: int, lexicon: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets, words) of each kind of feature, words ascending."""
        size, index = self.stops - self.starts, np.arange(len(self.starts))
        for n in (1, 2, 3):
            at = index[size >= n]
            yield _slots(self.hashes[n][self.starts[at]], 101 * n, bits), at
            yield _slots(self.hashes[n][self.stops[at] - n], 7001 * n, bits), at
        word_of = np.repeat(np.r_[-1, index], np.diff(np.r_[0, self.starts, len(self.raw)]))
        room = np.zeros(len(self.raw), np.int64)
        inside = word_of >= 0
        room[inside] = self.stops[word_of[inside]] - np.flatnonzero(inside)
        for n in (2, 3):
            at = np.flatnonzero(room >= n)
            yield _slots(self.hashes[n][at], 90001 * n, bits), word_of[at]
        if len(lexicon[0]):
            k = np.minimum(np.searchsorted(lexicon[0], self.ids), len(lexicon[0]) - 1)
            at = np.flatnonzero(lexicon[0][k] == self.ids)
            yield _slots(lexicon[1][k[at]].astype(np.uint32), 555_557, bits), at


def emissions(words: Words, weights: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores, words x labels; zero for words without a letter."""
    n, labels = len(words.starts), weights.shape[1]
    out = np.zeros((n, labels), np.float32)
    bits = int(np.log2(len(weights)))
    for slots, at in words.features(bits, lexicon):
        if len(at):
            for y in range(labels):
                out[:, y] += np.bincount(at, weights=weights[:, y][slots], minlength=n)
    out[~words.has_letter] = 0
    return out


def marginals(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word's label and expected transitions, for texts of ``counts`` words laid
    end to end. Before a text's first word stands a label with equal chances."""
    n, labels = scores.shape
    a = np.exp(transitions.astype(np.float64))
    x = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0)).astype(np.float64) if n else np.zeros((0, labels))
    out, pairs = np.zeros((n, labels)), np.zeros((labels, labels))
    blocks = -(-counts // _BLOCK)
    total = int(blocks.sum())
    if not total:
        return out, pairs
    doc_first = np.r_[0, np.cumsum(blocks)[:-1]]
    word_first = np.r_[0, np.cumsum(counts)[:-1]]
    doc = np.repeat(np.arange(len(counts)), blocks)
    rank = np.arange(total) - doc_first[doc]
    start = word_first[doc] + rank * _BLOCK
    size = np.minimum(_BLOCK, counts[doc] - rank * _BLOCK)
    by_size = np.argsort(-size, kind="stable")
    start_s, size_s = start[by_size], size[by_size]
    active = [int(np.searchsorted(-size_s, -k, side="left")) for k in range(_BLOCK)]  # blocks longer than k
    # 1. transfer matrices
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for k in range(_BLOCK):
        m = active[k]
        if not m:
            break
        step = (product[:m].reshape(-1, labels) @ a).reshape(m, labels, labels) * x[start_s[:m] + k][:, None, :]
        product[:m] = step / step.max(axis=(1, 2), keepdims=True)
    ordered = np.empty_like(product)
    ordered[by_size] = product
    # 2. borders of blocks along the texts
    left, right = np.full((total, labels), 1.0 / labels), np.ones((total, labels))
    longest = np.argsort(-blocks, kind="stable")
    many = blocks[longest]
    for b in range(1, int(many[0])):
        d = longest[: int(np.searchsorted(-many, -b, side="left"))]  # texts with more than b blocks
        at = doc_first[d] + b
        v = np.einsum("ni,nij->nj", left[at - 1], ordered[at - 1])
        left[at] = v / v.sum(axis=1, keepdims=True)
    for b in range(int(many[0]) - 1, 0, -1):
        d = longest[: int(np.searchsorted(-many, -b, side="left"))]
        at = doc_first[d] + b
        v = np.einsum("nij,nj->ni", ordered[at], right[at])
        right[at - 1] = v / v.max(axis=1, keepdims=True)
    # 3. inside the blocks
    alpha = left[by_size]
    before = np.empty((n, labels))
    for k in range(_BLOCK):
        m = active[k]
        if not m:
            break
        w = start_s[:m] + k
        before[w] = alpha[:m]
        step = (alpha[:m] @ a) * x[w]
        alpha[:m] = step / step.sum(axis=1, keepdims=True)
        out[w] = alpha[:m]
    beta = right[by_size]
    for k in range(_BLOCK - 1, -1, -1):
        m = active[k]
        if not m:
            continue
        w = start_s[:m] + k
        g = out[w] * beta[:m]
        out[w] = g / g.sum(axis=1, keepdims=True)
        push = x[w] * beta[:m]
        joint_norm = np.einsum("ni,ij,nj->n", before[w], a, push)
        pairs += a * ((before[w] / joint_norm[:, None]).T @ push)
        back = push @ a.T
        beta[:m] = back / back.max(axis=1, keepdims=True)
    return out, pairs


def train(rows: list[tuple[str, str]], config: CrfConfig = CrfConfig()) -> CrfModel:
    """Weights, transitions and lexicon from (text, language) rows."""
    cfg = config
    labels = tuple(sorted({y for _, y in rows}))
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    if len(labels) < 2:
        return CrfModel(labels, np.zeros((1 << cfg.log2_buckets, max(1, len(labels)))), np.zeros((max(1, len(labels)),) * 2), none, cfg)
    rng = np.random.default_rng(cfg.seed)
    pieces: list[tuple[str, int]] = []
    in_docs: list[Counter] = [Counter() for _ in labels]
    for text, lang in rows:
        y, split = labels.index(lang), text.lower().split()
        in_docs[y].update(set(split))
        if split:
            at = int(rng.integers(0, max(1, len(split) - cfg.piece_words + 1)))
            pieces.append((" ".join(split[at : at + cfg.piece_words]), y))
    words: dict[str, int] = {}
    for y, c in enumerate(in_docs):
        for w, n in sorted(c.items(), key=lambda p: (-p[1], p[0]))[: 2 * cfg.lexicon]:
            if n >= 3 and n >= 0.6 * sum(o[w] for o in in_docs):
                words.setdefault(w, y)
    if words:
        ids = Words(list(words)).ids
        order = np.argsort(ids)
        lexicon = (ids[order], np.array(list(words.values()), np.int64)[order])
    else:
        lexicon = none
    # spliced sequences: one to three pieces each, parts of them cut short
    order = rng.permutation(len(pieces)).tolist()
    batches = []
    while order:
        texts, gold = [], []
        while order and len(texts) < 32:
            parts = [pieces[order.pop()] for _ in range(min(len(order), int(rng.integers(1, 4))))]
            split = [(p.split()[: int(rng.integers(3, cfg.piece_words + 1))], y) for p, y in parts]
            texts.append(" ".join(w for ws, _ in split for w in ws))
            gold += [y for ws, y in split for _ in ws]
        w = Words(texts)
        batches.append((w, list(w.features(cfg.log2_buckets, lexicon)), np.array(gold)))
    size, n_labels = 1 << cfg.log2_buckets, len(labels)
    weights, trans = np.zeros((size, n_labels)), np.zeros((n_labels, n_labels))
    gw, gt = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(cfg.epochs):
        for i in rng.permutation(len(batches)):
            w, feats, gold = batches[i]
            n = len(gold)
            s = np.zeros((n, n_labels))
            for slots, at in feats:
                for y in range(n_labels):
                    s[:, y] += np.bincount(at, weights=weights[slots, y], minlength=n)
            s[~w.has_letter] = 0
            p, pairs = marginals(s, w.counts, trans)
            p[np.arange(n), gold] -= 1
            p[~w.has_letter] = 0
            grad = 1e-4 * weights
            for slots, at in feats:
                for y in range(n_labels):
                    grad[:, y] += np.bincount(slots, weights=p[at, y], minlength=size) / len(w.counts)
            gw += grad**2
            weights -= cfg.rate * grad / np.sqrt(gw)
            seen = np.zeros_like(trans)
            first = np.r_[0, np.cumsum(w.counts)[:-1]]
            inner = np.setdiff1d(np.arange(n), first)
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            np.add.at(seen, (slice(None), gold[first]), 1.0 / n_labels)
            dt = (pairs - seen) / len(w.counts) + 1e-3 * trans
            gt += dt**2
            trans -= cfg.rate * dt / np.sqrt(gt)
    return CrfModel(labels, weights.astype(np.float32), trans, lexicon, cfg)


def label_words(model: CrfModel, texts: list[str]) -> tuple[Words, np.ndarray]:
    """The words of the texts and their label marginals."""
    w = Words(texts)
    return w, marginals(emissions(w, model.weights, model.lexicon), w.counts, model.transitions)[0]


def predict_texts(model: CrfModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    if not model.labels:
        return ["und"] * len(texts), np.zeros(len(texts))
    w, p = label_words(model, texts)
    n = np.bincount(w.doc, weights=w.has_letter, minlength=len(texts))
    mean = np.stack([np.bincount(w.doc, weights=p[:, y] * w.has_letter, minlength=len(texts)) for y in range(len(model.labels))], 1)
    mean = np.where(n[:, None] > 0, mean / np.maximum(n, 1)[:, None], 1.0 / len(model.labels))
    best = mean.argmax(axis=1)
    known = n > 0
    return [model.labels[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, mean.max(axis=1), 0.0)


def fit(docs: DataFrame, config: CrfConfig = CrfConfig()) -> CrfModel:
    """Train on text and non-null lang of documents whose id is not held out (crc32 modulo 4 is not
    2): ``per_language`` documents of every language, chosen by a hash of the id; of a text over ``max_chars``
    characters a passage of that length, which begins where a hash of the text says. With over 64 languages
    passages are shorter in proportion, so that the driver's memory is bounded."""
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    d = d.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (fold(F.col("_id"), 4) != 2))
    counts = [(r["_lang"], r["n"]) for r in d.groupBy("_lang").agg(F.approx_count_distinct(F.coalesce(F.col("_id").cast("string"), F.lit(""))).alias("n")).collect()]
    if not counts:
        return train([], config)
    # a share of the hashes that holds somewhat more than is wanted of each language; a part of it is taken
    share = [(lang, min(1.0, 1.5 * config.per_language / n + 1e-9)) for lang, n in sorted(counts)]
    shares = F.broadcast(docs.sparkSession.createDataFrame(share, "_lang string, _share double"))
    place = (F.xxhash64("_id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    chosen = d.withColumn("_place", place).join(shares, "_lang").where(F.col("_place") < F.col("_share"))
    room = max(1, config.max_chars * 64 // max(64, len(share)))
    # one text for each id and language (the smallest passage), so the rows are bounded by the share and reruns agree
    texts = chosen.groupBy("_id", "_lang", "_place").agg(F.min(passage(F.col("_text"), room)).alias("_text"))
    found = texts.collect()
    found.sort(key=lambda r: (r["_place"], str(r["_id"]), r["_text"]))
    rows, taken = [], Counter()
    for r in found:
        if taken[r["_lang"]] < config.per_language:
            taken[r["_lang"]] += 1
            rows.append(r)
    return train([(r["_text"], r["_lang"]) for r in rows], config)


def predict(docs: DataFrame, model: CrfModel, text_col: str = "text", out_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its score."""
    out_col, score_col = fresh(out_col, docs.columns), fresh(score_col, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # marginals take memory by languages: fewer characters at a time where there are many
            for part, texts in text_chunks(batch, text_col, (2 << 20) * 16 // max(16, len(model.labels))):
                lang, score = predict_texts(model, texts)
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, out_col, score_col])

    return docs.mapInArrow(run, schema)
