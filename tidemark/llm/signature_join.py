"""N-gram Jaccard join with signature trees.

A document's set holds its distinct five-word shingles as 64-bit hashes; equal sets collapse
into one class (128-bit digest) first. Two classes are linked when
``100 * |intersection| >= threshold * |union|``.

A *signature* is a bitmap of hashed shingles, the set's size, and the number of shingles that
share a bit with another (the excess). A tree node holds the OR of its members' bitmaps, the
range of their sizes and the largest excess. Two sets below nodes A and B overlap in at most
``popcount(A & B) + min(excess)`` shingles and in no more than the smaller largest size, while a
link needs ``threshold / (100 + threshold)`` of the summed sizes: node pairs that cannot reach that
are pruned with everything below them (dual traversal).

A bitmap has four to eight bits a shingle, whatever the set's size, so that long texts are pruned
as short ones are; sets whose bitmaps have different lengths are compared after folding the longer
one (linked sets differ by one doubling at most).

One tree over all documents would not distribute, so the forest is planted on groups: every
class goes to 48 groups by the minimum hashes of its shingles (three of them make a key). A pair
at similarity s misses all groups with probability ``(1 - s^3)^48``: 3.7e-12 at 0.75. With ``exact``
the groups are the smallest quarter of a set's hashes (and one more), which no linked pair can miss: more groups,
and no link is lost by construction. No group is capped. Then
 1. groups with the same members become one; in each group a tree is built and traversed for all pairs of classes
    that signatures cannot exclude; a pair that shares several groups is taken in the one with the smallest key;
 2. the sets of these classes are brought to their group, and every pair is verified exactly;
 3. the verified pairs give each class's number of links and, through a forest of each group, the components.
Large groups are dealt out as pairs of blocks to separate tasks: blocks have ``block`` members, or a sixteenth of
the group, up to ``largest_block``, so that a member is copied sixteen times at most in groups of up to 131,072 classes. Pairs
are held as one row of a class and its partners, so rows grow with members; the links themselves are all there.

Null, empty and blank texts have an empty set and are linked with nothing (component: their own
doc_id). Texts with fewer than five words are one shingle. Repeated rows, repeated and null ids fall
into the class of their set; a component whose ids are all null has the null id. Texts of any length are
taken whole, one at a time. Only the columns doc_id and text are read, whatever others are called.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize
from .components import components


@dataclass(frozen=True)
class JoinConfig:
    width: int = 5
    threshold: int = 75  # percent
    groups: int = 48
    rows: int = 3
    exact: bool = False  # groups that no linked pair can miss
    least_bits: int = 512  # of a bitmap
    leaf: int = 32
    block: int = 2048  # members of a block; a group that is no larger is one task
    largest_block: int = 8_192
    block_shingles: int = 4_000_000  # of the sets of a block's members altogether
    hot_members: int = 5_000  # groups above it are joined by themselves
    max_hot_groups: int = 100_000  # that are broadcast for it
    max_broadcast_ids: int = 2_000_000  # of documents whose sets are verified
    seed: int = 0x5EED


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, cfg: JoinConfig = JoinConfig(), cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    # on bytes, lower() touches A-Z only and split() cuts at space and bytes 9 to 13 only
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if cache is None:
        cache = {}
    ids = np.fromiter((cache.get(w) or cache.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    k = min(cfg.width, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
    return np.unique(h)


def _prefix(n: int, cfg: JoinConfig) -> int:
    """How many of the smallest hashes of n two linked sets cannot differ in altogether."""
    return n - -(-cfg.threshold * n // 100) + 1


def sketch(s: np.ndarray, cfg: JoinConfig) -> tuple[bytes, list[int]]:
    """Bitmap and group keys of a set of shingles."""
    size = max(cfg.least_bits, 1 << (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[_mix(s ^ np.uint64(0xB17)) & np.uint64(size - 1)] = 1
    bitmap = np.packbits(bits, bitorder="little").tobytes()
    if cfg.exact:
        return bitmap, s[: _prefix(len(s), cfg)].view(np.int64).tolist()
    n = cfg.groups * cfg.rows
    salts = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(cfg.seed))
    mins = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):  # bounded memory for long texts
        part = s[i : i + 4096]
        x = (part[None, :] ^ salts[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        mins = np.minimum(mins, x.min(axis=1))
    band = mins.reshape(cfg.groups, cfg.rows)
    h = np.arange(1, cfg.groups + 1, dtype=np.uint64)
    for r in range(cfg.rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + band[:, r])
    return bitmap, h.view(np.int64).tolist()


def sketches(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, n_shingles, digest, bitmap, keys) of each row; digest and keys null for empty sets.
    A task makes keys only at the first row of a set; others are copies, found again by digest."""
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bitmap", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        seen: set[bytes] = set()
        for batch in batches:
            n, digests, maps, keys = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), cfg, cache)
                if len(cache) > 50_000:  # hashing a word again costs little
                    cache.clear()
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                m, k = sketch(s, cfg) if d is not None and d not in seen else (None, None)
                if d is not None and len(seen) < 1_000_000:
                    seen.add(d)
                n.append(len(s))
                digests.append(d)
                maps.append(m)
                keys.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(maps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bitmap", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)


# --- the tree ---------------------------------------------------------------------------------


def _needed(total: np.ndarray | int, threshold: int):
    """Least overlap of two sets whose sizes sum to ``total``."""
    return -(-(threshold * total) // (100 + threshold))


class SignatureTree:
    """Members sorted by size and bitmap, packed into leaves; each level ORs ``fan`` nodes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, leaf: int, fan: int = 8):
        self.order = np.lexsort((*bits.T, sizes))
        self.bits, self.sizes = bits[self.order], sizes[self.order]
        self.excess = self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.levels = []
        starts = np.arange(0, len(sizes), leaf)
        if not len(starts):
            return
        level = (
            np.bitwise_or.reduceat(self.bits, starts),
            np.minimum.reduceat(self.sizes, starts),
            np.maximum.reduceat(self.sizes, starts),
            np.maximum.reduceat(self.excess, starts),
        )
        self.levels.append(level)
        ops = (np.bitwise_or, np.minimum, np.maximum, np.maximum)
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), fan)
            self.levels.append(tuple(op.reduceat(x, at) for op, x in zip(ops, self.levels[-1], strict=True)))
        self.leaf, self.fan = leaf, fan


def _alive(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, threshold: int) -> np.ndarray:
    """Which node pairs may hold a linked pair."""
    out = np.empty(len(i), bool)
    step = max(64, (1 << 21) // a[0].shape[1])  # bounded memory for long bitmaps
    for s in range(0, len(i), step):
        p, q = i[s : s + step], j[s : s + step]
        most = np.bitwise_count(a[0][p] & b[0][q]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][p], b[3][q])
        most = np.minimum(most, np.minimum(a[2][p], b[2][q]))
        near = (100 * a[2][p] >= threshold * b[1][q]) & (100 * b[2][q] >= threshold * a[1][p])
        out[s : s + step] = (most >= _needed(a[1][p] + b[1][q], threshold)) & near
    return out


def traverse(a: SignatureTree, b: SignatureTree, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of members (their original numbers) that signatures cannot exclude.
    With ``a is b`` each unordered pair comes once."""
    if not a.levels or not b.levels:
        return
    same = a is b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    stack = [(la, lb, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    chunk = 1 << 15
    while stack:
        la, lb, i, j = stack.pop()
        if la < 0:  # members
            m = (a.bits, a.sizes, a.sizes, a.excess)
            n = (b.bits, b.sizes, b.sizes, b.excess)
            ok = _alive(m, i, n, j, threshold)
            if ok.any():
                yield a.order[i[ok]], b.order[j[ok]]
            continue
        ok = _alive(a.levels[la], i, b.levels[lb], j, threshold)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if len(i) > chunk:
            stack += [(la, lb, i[s : s + chunk], j[s : s + chunk]) for s in range(0, len(i), chunk)]
            continue
        down_a, down_b = (la >= lb), (lb >= la)

        def children(tree: SignatureTree, level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            width = tree.fan if level else tree.leaf
            n = len(tree.levels[level - 1][0]) if level else len(tree.sizes)
            c = x[:, None] * width + np.arange(width)[None, :]
            return c, c < n

        ca, va = children(a, la, i) if down_a else (i[:, None], np.ones((len(i), 1), bool))
        cb, vb = children(b, lb, j) if down_b else (j[:, None], np.ones((len(j), 1), bool))
        step = max(1, (1 << 20) // (ca.shape[1] * cb.shape[1]))
        for s in range(0, len(i), step):
            p = np.broadcast_to(ca[s : s + step, :, None], (len(ca[s : s + step]), ca.shape[1], cb.shape[1]))
            q = np.broadcast_to(cb[s : s + step, None, :], p.shape)
            ok = va[s : s + step, :, None] & vb[s : s + step, None, :]
            na, nb = la - down_a, lb - down_b
            if same:
                ok = ok & ((p < q) if na < 0 else (p <= q))
            if ok.any():
                stack.append((na, nb, p[ok], q[ok]))


# --- the distributed join -----------------------------------------------------------------------


def _bits(bitmaps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps), "<u8").reshape(len(bitmaps), -1)


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the length: bit numbers are the low bits of hashes, so halves are joined by OR."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def survivors(bitmaps: list[bytes], sizes: np.ndarray, side: np.ndarray | None, cfg: JoinConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that their signatures cannot exclude, each once; with ``side`` (bool) pairs across sides only."""
    length = np.array([len(x) for x in bitmaps], np.int64)
    parts = [np.ones(len(sizes), bool)] if side is None else [~side, side]
    members = [{n: np.flatnonzero(p & (length == n)) for n in np.unique(length[p]).tolist()} for p in parts]
    bits = [{n: _bits([bitmaps[k] for k in at.tolist()]) for n, at in m.items()} for m in members]
    trees = [{n: SignatureTree(bits[s][n], sizes[at], cfg.leaf) for n, at in m.items()} for s, m in enumerate(members)]
    ways = [(0, 0)] if side is None else [(0, 1), (1, 0)]
    for s, t in ways:
        for n, at in members[s].items():
            if s == 0 and n in members[t]:  # equal lengths
                for x, y in traverse(trees[s][n], trees[t][n], cfg.threshold):
                    yield at[x], members[t][n][y]
            if 2 * n in members[t]:  # the other side's bitmaps are twice as long
                longer = members[t][2 * n]
                folded = SignatureTree(_folded(bits[t][2 * n]), sizes[longer], cfg.leaf)
                for x, y in traverse(trees[s][n], folded, cfg.threshold):
                    yield at[x], longer[y]


def _sets(docs: DataFrame, members: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(digest, shingles) of the classes in ``members`` (digest, first_id), from the texts. Rows without an id are
    all read, if a class has no other."""
    rows = docs.select("doc_id", "text")
    wanted = materialize(members.where(F.col("first_id").isNotNull()).select(F.col("first_id").alias("doc_id")).distinct(), "wanted")
    if wanted.count() <= cfg.max_broadcast_ids:
        wanted = F.broadcast(wanted)  # counted; the texts stay where they are
    found = rows.join(wanted, "doc_id", "left_semi")
    if not members.where(F.col("first_id").isNull()).isEmpty():
        found = found.unionByName(rows.where(F.col("doc_id").isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(text.as_py(), cfg).tobytes() for text in batch.column(0).slice(at, 512)]
                digests = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    # an id may stand on several texts: those of other classes go again
    made = found.select("text").mapInArrow(run, "digest binary, shingles binary")
    return made.join(members.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _with_keys(records: DataFrame, keys: DataFrame, cfg: JoinConfig) -> DataFrame:
    """The rows of ``records`` whose key is in ``keys`` (key, members), with members. Rows of hot keys
    stay where they are; the others are moved to their keys, at every size alike."""
    hot = keys.where(F.col("members") > cfg.hot_members)
    if not 0 < hot.count() <= cfg.max_hot_groups:
        return records.join(keys.hint("merge"), "key")
    hot = F.broadcast(hot)  # counted
    others = records.join(hot, "key", "left_anti").join(keys.where(F.col("members") <= cfg.hot_members).hint("merge"), "key")
    return records.join(hot, "key").unionByName(others)


def _groups(records: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(key, digest, members, total) of the groups with two classes or more, from (key, digest, n) rows with repeats;
    of groups with the same members one. ``total``: the shingles of all members."""
    h = F.xxhash64("digest")
    # most keys are in one class only: two numbers a key tell, summed up before they are moved
    seen = records.groupBy("key").agg(F.min(h).alias("x"), F.max(h).alias("y"), F.count(F.lit(1)).alias("members"))
    seen = materialize(seen.where("x <> y").select("key", "members"), "shared-keys")
    records = _with_keys(records, seen, cfg).groupBy("key", "digest").agg(F.max("n").alias("n"))
    records = materialize(records, "records")
    marks = (F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    sized = records.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"), *marks)
    kept = sized.groupBy("members", "x", "y").agg(F.min("key").alias("key"), F.max("total").alias("total"))
    return _with_keys(records, materialize(kept.select("key", "members", "total"), "group-sizes"), cfg).drop("n")


def _cells(grouped: DataFrame, signatures: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Members (key, digest, members, total) of groups with their signatures, dealt to cells (key, i, j):
    a group of one block is one cell, a larger one a cell for each pair of its blocks. Blocks are bounded by members
    and, so that long sets fit, by shingles (about: members are dealt by hash)."""
    size = F.greatest(F.lit(cfg.block), F.least(F.lit(cfg.largest_block), F.ceil(F.col("members") / 16)))
    by_shingles = F.least(F.col("members"), F.ceil(F.col("total") / cfg.block_shingles))
    blocks = F.greatest(F.ceil(F.col("members") / size), by_shingles).cast("int")
    return (
        grouped.join(signatures, "digest")
        .withColumn("block", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "n", "bitmap", "keys")
    )


def _by_cell(cells: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each cell (key, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last cell so far; cells are bounded by two blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            ids = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            begin = 0
            for end in (np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1).tolist():
                yield from work(table.slice(begin, end - begin))
                begin = end
            held = table.slice(begin).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _earlier(keys: pa.ChunkedArray, key: int) -> np.ndarray:
    """For each member a bitmap of its keys below ``key``, over those that several members have."""
    lists = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    flat = lists.flatten().to_numpy()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    below = flat < key
    values, number, count = np.unique(flat[below], return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = (count > 1)[number]
    width = max(1, -(-int((count > 1).sum()) // 64))
    out = np.zeros((len(lists), width), np.uint64)
    at = shared[number[use]]
    np.bitwise_or.at(out, (of[below][use], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _slices(sizes: np.ndarray, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` bytes each (or one row), for record batches of bounded size."""
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def _candidates(cells: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(key, i, j, place, digest, partners) of each member of a cell with a candidate: all pairs that survive the dual
    traversal of the trees of blocks i and j and share no group with a smaller key, each in one member's partners
    (a bitmap of places in the cell, without the zero bytes at its end). So a cell's pairs take a bit each."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, sizes = t.column("block").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        before = _earlier(t.column("keys"), key)
        width = -(-len(sizes) // 8)
        near, some = np.zeros(len(sizes) * width, np.uint8), np.zeros(len(sizes), bool)
        for x, y in survivors(t.column("bitmap").to_pylist(), sizes, None if i == j else side == j, cfg):
            for s in range(0, len(x), 1 << 16):
                p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                here = ~(before[p] & before[q]).any(axis=1)
                p, q = p[here], q[here]
                np.bitwise_or.at(near, p * width + (q >> 3), np.uint8(1) << (q & 7).astype(np.uint8))
                some[p] = some[q] = True
        at = np.flatnonzero(some)
        digests = t.column("digest").combine_chunks()
        for begin, end in _slices(np.full(len(at), width)):
            places = at[begin:end]
            partners = [near[x * width : (x + 1) * width].tobytes().rstrip(b"\0") for x in places.tolist()]
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(places, pa.int32())]
                + [digests.take(pa.array(places)), pa.array(partners, pa.binary())],
                ["key", "i", "j", "place", "digest", "partners"],
            )

    return _by_cell(cells, work, "key long, i int, j int, place int, digest binary, partners binary")


def _verified(candidates: DataFrame, sets: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(digest, partners, links, root) of each member of a cell with a link by whole sets: its partners (each pair
    at one member, their digests end to end), its number of links in the cell, and
    one member of its component in the cell."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        digests, place = t.column("digest").to_pylist(), t.column("place").to_numpy()
        row = np.zeros(int(place.max()) + 1, np.int64)
        row[place] = np.arange(len(place))
        raw = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in raw], np.int64)
        ids = np.unique(np.concatenate(raw), return_inverse=True)[1].astype(np.int32)
        mark = np.zeros(1 + int(ids.max()), bool)
        ids = np.split(ids, np.cumsum(size)[:-1])
        label, links = np.arange(len(digests)), np.zeros(len(digests), np.int64)
        kept = []
        for x, bits in enumerate(t.column("partners").to_pylist()):
            near = row[np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))]
            mark[ids[x]] = True
            mine = []
            for begin, end in _slices(4 * size[near]):  # bounded memory
                y = near[begin:end]
                starts = np.cumsum(size[y]) - size[y]
                common = np.add.reduceat(mark[np.concatenate([ids[k] for k in y.tolist()])], starts, dtype=np.int64)
                mine.append(y[100 * common >= cfg.threshold * (size[x] + size[y] - common)])
            mark[ids[x]] = False
            mine = np.concatenate(mine) if mine else near
            kept.append(mine)
            if len(mine):
                links[x] += len(mine)
                links[mine] += 1
                roots = np.unique(label[[x, *mine.tolist()]])
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
        some = np.flatnonzero(links)
        for begin, end in _slices(np.array([16 * len(kept[x]) for x in some.tolist()], np.int64)):
            part = some[begin:end].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[x] for x in part], pa.binary()), pa.array([b"".join([digests[y] for y in kept[x].tolist()]) for x in part], pa.binary())]
                + [pa.array(links[part], pa.int64()), pa.array([digests[label[x]] for x in part], pa.binary())],
                ["digest", "partners", "links", "root"],
            )

    return _by_cell(candidates.join(sets, "digest"), work, "digest binary, partners binary, links long, root binary")


@dataclass(frozen=True)
class Links:
    documents: DataFrame  # doc_id, n_shingles, digest (of its class), n_links (linked classes), component_id, component (a digest)
    adjacency: DataFrame  # digest, partners: every link of two classes once, partners end to end

    def pairs(self) -> DataFrame:
        """(a, b) of every two linked classes, by their digests, a < b; each pair once."""
        each = F.expr("transform(sequence(0, length(partners) div 16 - 1), k -> substring(partners, 16 * k + 1, 16))")
        one = self.adjacency.where(F.length("partners") > 0).select("digest", F.explode(each).alias("other"))
        return one.select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b"))


def links(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> Links:
    """All links between classes, and each document's class, number of linked classes and component."""
    all_docs = materialize(sketches(docs, cfg), "sketch")
    # classes of equal sets, each with its smallest id; bitmap and keys follow from the set and stand at its
    # first row in each task, so copies weigh little in what follows
    classes = materialize(all_docs.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id")), "classes")
    records = all_docs.select("digest", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    grouped = materialize(_groups(records, cfg), "groups")
    keys = grouped.groupBy("digest").agg(F.collect_list("key").alias("keys"))
    firsts = all_docs.where(F.col("bitmap").isNotNull()).select("digest", F.col("n_shingles").alias("n"), "bitmap")
    facts = firsts.join(keys, "digest").dropDuplicates(["digest"])
    facts = materialize(facts.select("digest", "n", "bitmap", "keys"), "facts")

    near = materialize(_candidates(_cells(grouped, facts, cfg), cfg), "candidates")
    sets = materialize(_sets(docs, classes.join(near.select("digest").distinct(), "digest", "left_semi"), cfg), "sets")
    found = materialize(_verified(near, sets, cfg), "links")

    whole = components(found.where("digest != root"), "digest", "root").select(F.col("vertex").alias("digest"), F.col("component").alias("comp"))
    degree = found.groupBy("digest").agg(F.sum("links").alias("n_links"))
    ids = classes.join(whole, "digest", "left").select("digest", "first_id", F.coalesce("comp", "digest").alias("comp"))
    least = ids.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    final = ids.join(least, "comp").join(degree, "digest", "left").select("digest", "n_links", "component_id", F.col("comp").alias("component"))
    documents = (
        all_docs.select("doc_id", "n_shingles", "digest")
        .join(final, "digest", "left")
        .select(
            "doc_id", "n_shingles", "digest", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), "component"
        )
    )
    return Links(documents, found.select("digest", "partners"))


def linked_components(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest reachable doc_id)."""
    return links(docs, cfg).documents.select("doc_id", "n_shingles", "component_id")


def _with_digest(docs: DataFrame, name: str, cfg: JoinConfig) -> DataFrame:
    """``docs`` with the digest of each row's set (null if it is empty)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for text in batch.column(at):
                s = shingles(text.as_py(), cfg)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def representatives(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id (null last), then the smallest
    digest of its set; all rows without words. Rows are told apart by their ids, and where an id is null or
    repeated by their own sets, so different texts of one id do not stand for each other."""
    docs_of = materialize(links(docs, cfg).documents, "linked")
    heads = docs_of.where(F.col("component").isNotNull()).groupBy("component")
    heads = materialize(heads.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("h")).select("h.doc_id", "h.digest"), "heads")
    repeated = docs_of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc_id").isNotNull() & (F.col("n") > 1)).select("doc_id")
    repeated = materialize(repeated, "repeated-ids")
    least = heads.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    gone = docs_of.where(F.col("component").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").join(least, "doc_id", "left_anti")
    gone = materialize(gone.unionByName(repeated).distinct(), "dropped-ids")
    small = lambda df: F.broadcast(df) if df.count() <= cfg.max_broadcast_ids else df
    kept = docs.where(F.col("doc_id").isNotNull()).join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty() and docs_of.where(F.col("doc_id").isNull()).isEmpty():
        return kept
    some = docs.join(small(repeated), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
    name, one = fresh("digest", docs.columns), fresh("one", docs.columns)
    some = _with_digest(some, name, cfg)
    # of rows with the same id and set the first by a hash of all columns
    each = F.struct(*docs.columns)
    first = some.where(F.col(name).isNotNull()).groupBy("doc_id", name).agg(F.min_by(each, F.xxhash64(*docs.columns)).alias(one))
    head_id, head_digest = fresh("head_id", [*docs.columns, name]), fresh("head_digest", [*docs.columns, name])
    heads = heads.select(F.col("doc_id").alias(head_id), F.col("digest").alias(head_digest))
    chosen = first.join(heads, F.col("doc_id").eqNullSafe(F.col(head_id)) & (F.col(name) == F.col(head_digest)), "left_semi")
    return kept.unionByName(chosen.select(f"{one}.*")).unionByName(some.where(F.col(name).isNull()).select(*docs.columns))
