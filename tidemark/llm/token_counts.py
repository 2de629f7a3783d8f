"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest piece of the vocabulary at each place of a
word; the first piece from the word-initial pieces, later ones from the continuing pieces. Here the
two sets form tries joined by failure links: where a node has no edge for the next byte, its
link leads to the node of the text left over after popping whole pieces, and the number of pieces
popped on the way is stored with the link. So a word is scanned once, links add work linear in
its length, and lengths come out without building pieces.

A word that cannot be segmented to its end counts as one unknown token. Words are runs of bytes
other than space and 9 to 13. Null, empty and blank texts have no tokens. Any word length is
handled (no cap). Repeated rows get equal counts.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuing pieces of a public rank file (base64 piece, rank): a piece
    that begins with a space is initial, one without white space continues."""
    first, later = [], []
    with open(path, "rb") as f:
        for line in f:
            if not line.strip():
                continue
            piece = base64.b64decode(line.split()[0])
            body = piece[1:] if piece[:1] == b" " else piece
            if body and not any(c in b" \t\n\x0b\x0c\r" for c in body):
                (first if piece[:1] == b" " else later).append(body)
    return first, later


class LongestMatch:
    """Tries of initial and continuing pieces with failure links and popped-piece counts."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        edges: dict[int, int] = {}
        whole, children = [False, False], [[], []]  # nodes 0 and 1 are the roots
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                s = root
                for b in piece:
                    t = edges.get(s << 8 | b)
                    if t is None:
                        t = edges[s << 8 | b] = len(whole)
                        whole.append(False)
                        children.append([])
                        children[s].append((b, t))
                    s = t
                if s > 1:
                    whole[s] = True
        link, popped = [-1] * len(whole), [0] * len(whole)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for b, v in children[u]:
                queue.append(v)
                if whole[v]:
                    link[v], popped[v] = 1, 1
                    continue
                z, extra = link[u], popped[u]
                while z >= 0 and (z << 8 | b) not in edges:
                    extra += popped[z]
                    z = link[z]
                if z >= 0:
                    link[v], popped[v] = edges[z << 8 | b], extra
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word, 0 if it cannot be segmented."""
        edges, link, popped = self.edges, self.link, self.popped
        s = n = 0
        for b in word:
            t = edges.get(s << 8 | b)
            while t is None:
                n += popped[s]
                s = link[s]
                if s < 0:
                    return 0
                t = edges.get(s << 8 | b)
            s = t
        while s != 1:
            n += popped[s]
            s = link[s]
            if s < 0:
                return 0
        return n


def count_tokens(docs: DataFrame, matcher: LongestMatch, text_col: str = "text", names: tuple[str, str, str] = ("n_words", "n_tokens", "n_unknown")) -> DataFrame:
    """``docs`` with the words, tokens (an unknown word is one) and unknown words of each text."""
    taken = list(docs.columns)
    out = []
    for n in names:
        out.append(fresh(n, taken))
        taken.append(out[-1])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in out]])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for x in batch.column(at):
                parts = (x.as_py() or "").encode().split()
                total = missed = 0
                for w in parts:
                    c = known.get(w)
                    if c is None:
                        c = known[w] = matcher.count(w)
                    total += c
                    missed += not c
                words.append(len(parts))
                tokens.append(total + missed)
                unknown.append(missed)
                if len(known) > 300_000:  # memory only: counts do not change
                    known.clear()
            new = [pa.array(v, pa.int64()) for v in (words, tokens, unknown)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)
