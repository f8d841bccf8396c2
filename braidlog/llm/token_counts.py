"""Token counts under a longest-match vocabulary, by a linear-time automaton over its trie.

Greedy longest match takes from each word the longest piece that begins it, then the longest
continuation piece, and so on. A trie of the pieces with failure links does it in one pass
over the bytes (LinMaxMatch): each node knows how many pieces are popped when matching fails
there and the node at which it goes on, so lengths come out without building any piece. Here
all words of a slice step through their bytes together, on arrays; transitions lie in an
open-addressing table.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidlog.llm.words import NOT_BLANK, joined, over_slices, spans
from braidlog.session import ship

#: So many words are followed byte by byte while they have more than LONG bytes left: array calls on few elements cost more.
FEW, LONG = 4, 256

_automata: dict[int, Automaton] = {}


class Automaton:
    """Nodes 0 (a word's beginning) and 1 (a continuation's) are the roots of one trie each.

    pieces: byte strings; those in `firsts` can begin a word, those in `rests` continue one.
    Every single byte is taken to be a piece of either kind, so each word can be cut.
    """

    def __init__(self, firsts: list[bytes], rests: list[bytes]):
        every = [bytes([b]) for b in range(256)]
        children: list[dict[int, int]] = [{}, {}]
        is_piece, parent = [False, False], [(0, 0), (1, 0)]
        for root, pieces in ((0, firsts), (1, rests)):
            for piece in sorted({*pieces, *every} - {b""}):
                at = root
                for b in piece:
                    if b not in children[at]:
                        children[at][b] = len(children)
                        children.append({})
                        is_piece.append(False)
                        parent.append((at, b))
                    at = children[at][b]
                is_piece[at] = True
        # breadth first: a node's link goes to where matching its path, less the pieces popped, ends
        fail, pops = [1] * len(children), [0] * len(children)
        level = [0, 1]
        while level:
            level = [c for at in level for c in children[at].values()]
            for at in level:
                up, b = parent[at]
                if is_piece[at]:
                    pops[at] = 1
                    continue
                go, n = fail[up], pops[up]
                while b not in children[go]:
                    n += pops[go]
                    go = fail[go]
                fail[at], pops[at] = children[go][b], n
        self.fail, self.pops = np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32)
        keys = np.array([at << 8 | b for at, c in enumerate(children) for b in c], dtype=np.int64)
        values = np.array([to for c in children for to in c.values()], dtype=np.int32)
        self.child: dict[int, int] | None = None  # made where a word is long
        self.bits = int(len(keys) * 3).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            self.values[slot[free]] = values[left[free]]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The node after byte b, or -1."""
        keys = nodes.astype(np.int64) << 8 | b
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        out[found != keys] = -1
        look = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[look]
        while len(look):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[look]
            out[look[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            look, slot = look[on], slot[on]
        return out

    def _along(self, word: bytes, node: int, total: int) -> tuple[int, int]:
        """Node and count after the rest of one word, a byte at a time."""
        if self.child is None:
            used = self.keys >= 0
            self.child = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
            self.links = self.fail.tolist(), self.pops.tolist()
        child, (fail, pops) = self.child.get, self.links
        for b in word:
            to = child(node << 8 | b)
            while to is None:
                total += pops[node]
                node = fail[node]
                to = child(node << 8 | b)
            node = to
        return node, total

    def counts(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many pieces each word is cut into."""
        order = np.argsort(begins - ends, kind="stable")  # longest first: those still running are a prefix
        at, sizes = begins[order], (ends - begins)[order]
        nodes, total = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        running = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for i, n in enumerate(running.tolist()):
            if n <= FEW and len(running) - i > LONG:
                for k in range(n):
                    nodes[k], total[k] = self._along(data[at[k] + i : at[k] + sizes[k]].tobytes(), int(nodes[k]), int(total[k]))
                break
            b = data[at[:n] + i]
            new = self.step(nodes[:n], b)
            stuck = np.flatnonzero(new < 0)
            while len(stuck):
                old = nodes[stuck]
                total[stuck] += self.pops[old]
                nodes[stuck] = self.fail[old]
                new[stuck] = self.step(nodes[stuck], b[stuck])
                stuck = stuck[new[stuck] < 0]
            nodes[:n] = new
        rest = np.flatnonzero(nodes > 1)
        while len(rest):
            total[rest] += self.pops[nodes[rest]]
            nodes[rest] = self.fail[nodes[rest]]
            rest = rest[nodes[rest] > 1]
        out = np.empty_like(total)
        out[order] = total
        return out


def pieces_of(vocabulary: bytes) -> tuple[list[bytes], list[bytes]]:
    """From a file of `base64 rank` lines: pieces with a leading space begin words (it is taken off), others continue them."""
    pieces = [base64.b64decode(line.split()[0]) for line in vocabulary.splitlines() if line.strip()]
    return [p[1:] for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def automaton(vocabulary: bytes) -> Automaton:
    """The automaton of a file's content, built once in a worker."""
    key = zlib.crc32(vocabulary)
    if key not in _automata:
        _automata[key] = Automaton(*pieces_of(vocabulary))
    return _automata[key]


def token_counts(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_words, n_tokens, longest_word (the most pieces of one word).

    Words are runs of anything but ASCII blanks, as UTF-8 bytes. vocabulary is the content of a
    file as in pieces_of. Null, empty and blank texts count 0; repeated rows and rows without a
    doc_id are counted like any other; an empty table gives no rows; other columns are ignored. Texts and words of
    any length are taken whole, in memory of a few times the longest text. No rows are moved.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, text_begins = joined(batch.column("text"))
        begins, ends = spans(data, NOT_BLANK)
        each = automaton(shared.value).counts(data, begins, ends)
        bounds = np.searchsorted(begins, text_begins)
        up = np.concatenate(([0], np.cumsum(each)))
        most = np.zeros(batch.num_rows, dtype=np.int64)
        np.maximum.at(most, np.repeat(np.arange(batch.num_rows), np.diff(bounds)), each)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(up[bounds[1:]] - up[bounds[:-1]]), pa.array(most)],
            names=["doc_id", "n_words", "n_tokens", "longest_word"],
        )

    return docs.select("doc_id", "text").mapInArrow(over_slices(kernel), "doc_id bigint, n_words bigint, n_tokens bigint, longest_word bigint")
