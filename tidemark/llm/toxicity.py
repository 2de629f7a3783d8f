"""Toxicity by compression distance.

Two zstandard dictionaries are trained with zstandard's own trainer, one on toxic and one on
ordinary text. A text is cut into windows of a few words, and long windows (text with few blanks)
into overlapping shorter ones, so that every byte is compared; each window is compressed with
either dictionary, and the difference of the two lengths (the gain) says which text it resembles.
Gains are compared with several margins; a logistic regression over a text's counts of windows
beyond them gives the score. It is calibrated on texts that its dictionaries have not seen
(``folds`` parts of the training rows, each scored with dictionaries of the others) and shifted
half-way to the natural share of toxic rows.

What the dictionaries are trained on decides how well they separate: labelled texts are ordinary
for the most part, whatever their label. So both begin with the same part, trained on ordinary text
of both classes, which costs nothing in the difference; behind it stands a part trained on the
class's own text: for the toxic class all occurrences of the words whose document frequency is
higher by some standard errors than in ordinary text (how many, the calibration decides), for the ordinary class other windows of
ordinary text. Without such words the part is trained on the whole class.

Null, empty and blank texts have no window; they get the score of "no evidence" for length
zero. Texts of any length are compared whole, in batches of windows. Repeated rows and ties get
equal scores, an empty table an empty result; the score's column gets another name if the table
has one of that name. Any number of labelled rows works; without a row of both classes every score is
the constant share of toxic rows (0 without rows).
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fit_logistic, fold, fresh, label_share, labelled_sample, prior_shift, sigmoid, text_chunks

_BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))


@dataclass(frozen=True)
class ToxicityConfig:
    window_words: int = 3
    window_bytes: int = 48  # longer windows are cut; zstandard stores up to 63 literals as they are, so gains compare
    overlap_bytes: int = 20  # of the parts of a long window
    search_log: int = 4  # of the compressor: the search's depth as a power of two
    shared_bytes: int = 16384  # of both dictionaries
    own_bytes: int = 1024  # of either dictionary
    min_z: tuple[float, ...] = (5.0, 5.5, 6.0, 7.0)  # standard errors by which a word's document frequency differs; the best is chosen
    min_texts: int = 3  # that have such a word
    piece_chars: int = 5  # words over 24 characters count by their pieces
    margins: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 8)  # bytes by which a window compresses better
    folds: int = 4  # of the calibration
    l2: float = 0.1  # of the calibration
    train_per_class: int = 1500  # bound of the training sample
    train_max_chars: int = 40_000  # of a training text; of a longer one a passage is taken


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    config: ToxicityConfig


#: Stands behind every window and ends both dictionaries. So a window has one match at least, the fixed
#: cost of a block with matches is the same on both sides, and matches are searched for up to the
#: window's end (zstandard does not begin any in the last eight bytes).
_TRAILER = bytes(range(128, 168))
#: Ends the header of a trained dictionary: the three offsets that zstandard starts from.
_HEADER_END = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))
_LONG_WORD = 24


def _words(text: str, cfg: ToxicityConfig) -> list[str]:
    """Lower-case words; of a long one (text without blanks) all its pieces."""
    out = []
    for w in text.lower().split():
        out += [w] if len(w) <= _LONG_WORD else [w[i : i + cfg.piece_chars] for i in range(len(w) - cfg.piece_chars + 1)]
    return out


def _bare(word: str) -> str:
    """The word without marks at its ends."""
    while word and not word[-1].isalnum():
        word = word[:-1]
    while word and not word[0].isalnum():
        word = word[1:]
    return word


def _texts_with(texts: list[list[str]]) -> Counter:
    """How many of the texts have each word."""
    return Counter(w for x in texts for w in {_bare(w) for w in x})


def _contrast(mine: Counter, other: Counter, n_mine: int, n_other: int, cfg: ToxicityConfig) -> dict[str, float]:
    """Standard errors by which words are in more texts of ``mine``: all words, however many."""
    out = {}
    for w, n in mine.items():
        if w and n >= cfg.min_texts:
            p = (n + other[w]) / (n_mine + n_other)
            out[w] = (n / n_mine - other[w] / n_other) / (p * (1 - p) * (1 / n_mine + 1 / n_other) + 1e-9) ** 0.5
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content that zstandard's trainer chooses from the samples, the most frequent last. Where it chooses
    less than ``size`` (samples that repeat), the samples themselves stand before it, the most frequent last."""
    try:
        raw = zstd.train_dictionary(size + 512, samples, k=16, d=6, f=20, accel=1, steps=1).as_bytes()
        at = raw.find(_HEADER_END)
        content = raw[at + len(_HEADER_END) :] if at >= 0 else b""
    except zstd.ZstdError:  # too few samples
        content = b""
    if len(content) < size:
        content = b"".join(x for x, _ in reversed(Counter(samples).most_common())) + content
    return content[-size:]


def _dictionaries(bad: list[list[str]], good: list[list[str]], counts: tuple[Counter, Counter], zs: tuple[float, ...], cfg: ToxicityConfig) -> Iterator[tuple[bytes, bytes]]:
    """For each bound in ``zs`` the toxic and the ordinary dictionary, from the words of texts of either class
    and the numbers of texts with each word."""
    k = 1 + cfg.window_words
    cut = lambda x: [f" {' '.join(x[i : i + k])} ".encode("utf-8", "replace") for i in range(0, len(x), k)]
    windows = [w for x in good for w in cut(x)]
    random.Random(1).shuffle(windows)
    half = len(windows) // 2
    shared, plain = _trained(windows[:half], cfg.shared_bytes), _trained(windows[half:], cfg.own_bytes)
    z = _contrast(*counts, len(bad), len(good), cfg)
    for bound in zs:
        wanted = {w for w, v in z.items() if v >= bound}
        found = [f" {w} ".encode("utf-8", "replace") for x in bad for w in x if _bare(w) in wanted] if wanted else [w for x in bad for w in cut(x)]
        random.Random(2).shuffle(found)
        yield shared + _trained(found, cfg.own_bytes), shared + plain


def _compressor(content: bytes, search_log: int) -> zstd.ZstdCompressor:
    # a binary-tree search finds matches at every place of a dictionary; faster strategies skip some. The window
    # covers the dictionary and the text's window.
    log = max(10, (len(content) + len(_TRAILER) + 256).bit_length())
    params = zstd.ZstdCompressionParameters(
        window_log=log, hash_log=log, chain_log=log, search_log=search_log, min_match=5, strategy=zstd.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    d = zstd.ZstdCompressionDict(content + _TRAILER, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=d, compression_params=params)


def _lengths(c: zstd.ZstdCompressor, buffer: bytes, segments: bytes, n: int) -> np.ndarray:
    out = c.multi_compress_to_buffer(zstd.BufferWithSegments(buffer, segments))
    return np.fromiter((len(out[i]) for i in range(n)), dtype=np.int32, count=n)


def _gains(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, toxic: zstd.ZstdCompressor, ordinary: zstd.ZstdCompressor) -> np.ndarray:
    """Bytes that each window, with its trailer, is shorter with the toxic dictionary."""
    trailer = np.frombuffer(_TRAILER, np.uint8)
    segments = np.empty((len(begin), 2), "<u8")
    segments[:, 1] = size + len(trailer)
    segments[:, 0] = np.cumsum(segments[:, 1]) - segments[:, 1]
    whole = np.empty(int(segments[:, 1].sum()), np.uint8)
    at = segments[:, 0].astype(np.int64)
    for k in range(len(trailer)):
        whole[at + size + k] = trailer[k]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    whole[np.repeat(at, size) + inner] = raw[np.repeat(begin, size) + inner]
    buffer, packed = whole.tobytes(), segments.tobytes()
    return _lengths(ordinary, buffer, packed, len(begin)) - _lengths(toxic, buffer, packed, len(begin))


def window_statistics(texts: list[str], toxic: zstd.ZstdCompressor, ordinary: zstd.ZstdCompressor, cfg: ToxicityConfig) -> np.ndarray:
    """Per text: windows, windows better by each margin, the largest gain."""
    out = np.zeros((len(texts), 2 + len(cfg.margins)))
    parts = [f" {x.lower()} ".encode("utf-8", "replace").translate(_BLANK) for x in texts]
    buffer = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    raw = np.frombuffer(buffer, np.uint8)
    blank = raw == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
    if not len(starts):
        return out
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 2  # after the blank behind each word
    doc = np.searchsorted(ends, starts, side="right")
    first = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    head = np.flatnonzero(rank % cfg.window_words == 0)
    tail = np.r_[head[1:], len(doc)] - 1  # a window ends before the next one or with its text
    begin, size, d = starts[head], stops[tail] - starts[head], doc[head]
    # a long window becomes several that share some bytes: a word is not cut in all of them
    step = cfg.window_bytes - cfg.overlap_bytes
    cuts = 1 + np.maximum(0, -(-(size - cfg.window_bytes) // step))
    shift = (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * step
    begin, d = np.repeat(begin, cuts) + shift, np.repeat(d, cuts)
    size = np.minimum(np.repeat(size, cuts) - shift, cfg.window_bytes)
    gain = np.empty(len(begin), np.int32)
    for i in range(0, len(begin), 50_000):  # bounded memory in a long text
        gain[i : i + 50_000] = _gains(raw, begin[i : i + 50_000], size[i : i + 50_000], toxic, ordinary)
    out[:, 0] = np.bincount(d, minlength=len(texts))
    for k, margin in enumerate(cfg.margins):
        out[:, 1 + k] = np.bincount(d, weights=gain >= margin, minlength=len(texts))
    np.maximum.at(out[:, -1], d, gain)
    return out


def _features(stats: np.ndarray) -> np.ndarray:
    n, counts, top = stats[:, :1], stats[:, 1:-1], stats[:, -1:]
    return np.c_[counts > 0, np.log1p(counts), np.sqrt(counts / np.maximum(n, 1)), np.minimum(top, 12) / 4, np.log1p(n) / 4]


def train(rows: list[tuple[str, int]], config: ToxicityConfig = ToxicityConfig(), share: float | None = None) -> ToxicityModel:
    """Dictionaries and calibration from (text, label) rows. ``share``: that of toxic rows where the
    model is used, if the rows were chosen with another."""
    rows = [(x, v) for x, v in rows if v in (0, 1)]
    y = np.array([v for _, v in rows], int)
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not zeros:
        share = (ones + 1e-6) / (len(rows) + 2e-6) if rows else 1e-6
        inputs = _features(np.zeros((1, 2 + len(config.margins)))).shape[1]
        return ToxicityModel(b"", b"", (0.0,) * inputs + (float(np.log(share / (1 - share))),), config)
    texts, words = [x for x, _ in rows], [_words(x, config) for x, _ in rows]
    part = np.zeros(len(rows), int)  # both classes in every part
    for v in (0, 1):
        part[y == v] = np.arange((y == v).sum()) % config.folds
    counts = {(k, v): _texts_with([words[i] for i in np.flatnonzero((part == k) & (y == v))]) for k in range(config.folds) for v in (0, 1)}

    def learned(parts: list[int], zs: tuple[float, ...]) -> Iterator[tuple[bytes, bytes]]:
        of = [[words[i] for i in np.flatnonzero(np.isin(part, parts) & (y == v))] for v in (1, 0)]
        # differences grow with the root of the number of texts: the same words should pass with some of them left out
        zs = tuple(z * (len(parts) / config.folds) ** 0.5 for z in zs)
        return _dictionaries(*of, tuple(sum((counts[k, v] for k in parts), Counter()) for v in (1, 0)), zs, config)

    stats = np.zeros((len(config.min_z), len(rows), 2 + len(config.margins)))
    every = list(range(config.folds))
    for k in every:
        unseen = np.flatnonzero(part == k)
        rest = [p for p in every if p != k]
        if not np.bincount(y[np.isin(part, rest)], minlength=2).all():
            rest = every  # one text of a class: nothing to hold out
        for n, pair in enumerate(learned(rest, config.min_z)):
            stats[n, unseen] = window_statistics([texts[i] for i in unseen], *(_compressor(d, config.search_log) for d in pair), config)
    best = None
    for n, z in enumerate(config.min_z):
        x = _features(stats[n])
        w = fit_logistic(x, y.astype(float), l2=config.l2)
        p = np.clip(sigmoid(x @ w[:-1] + w[-1]), 1e-9, 1 - 1e-9)
        loss = -np.log(np.where(y == 1, p, 1 - p)).sum()
        if best is None or loss < best[0]:
            best = (loss, z, w)
    _, z, w = best
    # half-way to the natural share: missed toxic texts weigh more than flagged ordinary ones
    w[-1] += prior_shift(share, ones, zeros) / 2
    toxic, ordinary = next(learned(every, (z,)))
    return ToxicityModel(toxic, ordinary, tuple(map(float, w)), config)


def score_texts(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    cfg = model.config
    stats = window_statistics(texts, _compressor(model.toxic, cfg.search_log), _compressor(model.ordinary, cfg.search_log), cfg)
    w = np.asarray(model.weights)
    return sigmoid(_features(stats) @ w[:-1] + w[-1])


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on labelled rows whose id is not held out (crc32 modulo 5 is not 0); the sample is
    bounded by ``train_per_class`` rows a class and ``train_max_chars`` characters of each."""
    own = fold(F.col("_id"), 5) != 0
    rows = labelled_sample(docs, labels, "toxic", own, config.train_per_class, config.train_max_chars)
    return train(rows, config, label_share(labels, "toxic", own))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score (double, 0 to 1) of each whole text as another column."""
    out_col = fresh(out_col, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                s = pa.array(score_texts(model, texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, s], [*part.schema.names, out_col])

    return docs.mapInArrow(run, schema)
