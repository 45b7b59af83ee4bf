"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can be the last of its encoding. It is
stored; the encoding of the whole is read off by stepping back from the end. The last
token of a prefix is the token ``t`` ending there that fits behind the last token ``p``
of the prefix before it, where "fits" means that the merges would never join bytes
across the border of ``p`` and ``t`` before both are complete. Whether they would is
found by undoing the merges of the two tokens at the border, latest merge first.

A stored prefix never changes when bytes are appended, so ``PrefixEncoder`` appends
exactly, and after an edit it encodes only from the edit to the place where the stored
tokens of as many prefixes as the longest token has bytes are the old ones again.

Over tables the pre-tokens of many documents are encoded together, position by position,
with arrays; texts are cut into pieces first and known pieces are looked up (see
``chunk_cache``). Null text is empty. Repeated ids and rows, null ids and further columns
are allowed. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.chunk_cache import PieceCache
from stationlens.llm.common import ragged_take, slices, utf8_buffers, worker_memo

#: Pre-tokens of more bytes are encoded one by one.
TOGETHER_BYTES = 40


def read_ranks(text: str) -> dict[bytes, int]:
    """Tokens and their ranks from the lines of a rank file."""
    pairs = (line.split() for line in text.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Tokens, the two parts each one is merged from, and a trie of their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.width = np.array([len(t) for t in self.tokens], np.int64)
        self.longest = int(self.width.max())
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        for rank, token in enumerate(self.tokens):
            if len(token) > 1:
                self.left[rank], self.right[rank] = self._parts(token, rank)
        merged = np.flatnonzero(self.left != np.arange(self.size))
        keys = self.left[merged] * self.size + self.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], merged[order]
        self._trie()
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pool_start = np.cumsum(self.width) - self.width

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        """The last two parts when the merges below ``rank`` are applied to ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            found, at = min(options)
            if found >= rank:
                raise ValueError(f"token {rank} cannot be merged from two parts")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _trie(self) -> None:
        nodes = {b"": 0}
        edges: list[tuple[int, int]] = []
        for token in self.tokens:
            for n in range(1, len(token) + 1):
                if token[:n] not in nodes:
                    nodes[token[:n]] = len(nodes)
                    edges.append((nodes[token[: n - 1]] * 256 + token[n - 1], nodes[token[:n]]))
        edges.sort()
        self.edge_keys = np.array([e[0] for e in edges], np.int64)
        self.edge_nodes = np.array([e[1] for e in edges], np.int64)
        self.node_token = np.full(len(nodes), -1, np.int64)
        for token, node in nodes.items():
            self.node_token[node] = self.ranks.get(token, -1)

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie nodes one byte further, -1 where there is none."""
        return _find(self.edge_keys, self.edge_nodes, nodes * 256 + byte)

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether encoding the joined bytes of each pair of tokens gives just that pair.

        The border is looked at as it was in time: of the two tokens at the border the one
        merged later is undone. If at some time a merge of the two was due before the later
        of the merges already undone, the pair would not have come about.
        """
        ok = np.ones(len(first), bool)
        live = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        due = np.full(len(first), np.iinfo(np.int64).max)  # merges from here on have been undone
        while len(live):
            joined = _find(self.pair_keys, self.pair_ids, a * self.size + b)
            # Of equal merges the left one comes first; it is the earlier token's side.
            bad = (joined >= 0) & (joined < due)
            ok[live[bad]] = False
            undo_first = a > b
            next_a = np.where(undo_first, self.right[a], a)
            next_b = np.where(undo_first, b, self.left[b])
            stuck = np.where(undo_first, next_a == a, next_b == b)
            # A single byte is never merged: go on with the other side.
            other = stuck & np.where(undo_first, self.left[b] != b, self.right[a] != a)
            due_next = np.where(undo_first, a, b + 1)
            due_other = np.where(undo_first, b + 1, a)
            next_a = np.where(other & ~undo_first, self.right[a], next_a)
            next_b = np.where(other & undo_first, self.left[b], next_b)
            due_next = np.where(other, due_other, due_next)
            go = ~bad & (~stuck | other)
            live, a, b, due = live[go], next_a[go], next_b[go], due_next[go]
        return ok


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], -1)


class PrefixEncoder:
    """The encoding of one growing, editable pre-token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []  # last[i]: the last token of the first i + 1 bytes
        self.computed = 0  # prefixes computed so far, to see what an edit costs
        self._known: dict[tuple[int, int], bool] = {}
        self.append(data)

    def _fits(self, a: int, b: int) -> bool:
        if (a, b) not in self._known:
            self._known[a, b] = bool(self.vocabulary.fits(np.array([a]), np.array([b]))[0])
        return self._known[a, b]

    def _token_ending(self, end: int) -> int:
        self.computed += 1
        ranks, longest = self.vocabulary.ranks, self.vocabulary.longest
        for begin in range(max(0, end - longest), end):
            token = ranks.get(bytes(self.data[begin:end]))
            if token is not None and (begin == 0 or self._fits(self.last[begin - 1], token)):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._token_ending(end))

    def replace(self, begin: int, end: int, data: bytes) -> None:
        """Replace ``data[begin:end]``; tokens are computed anew only near the edit."""
        after = self.last[end:]
        self.data[begin:end] = data
        self.last = self.last[:begin]
        same = 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.last.append(self._token_ending(at + 1))
            old = at - begin - len(data)
            same = same + 1 if old >= 0 and after[old] == self.last[at] else 0
            if same >= self.vocabulary.longest:
                self.last += after[old + 1 :]
                return

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= int(self.vocabulary.width[out[-1]])
        return out[::-1]


def encode_together(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``words`` one after the other, and the number of ids of each; short words at once."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    top = int(size.max())
    # All tokens that lie somewhere in a word, by trie walks from every byte.
    word = np.repeat(np.arange(len(words)), size)
    begin = np.arange(len(data)) - start[word]
    nodes, place, length = np.zeros(len(data), np.int64), np.arange(len(data)), 0
    found = []
    while len(place):
        nodes = v.step(nodes, data[place + length].astype(np.int64))
        length += 1
        alive = nodes >= 0
        nodes, place = nodes[alive], place[alive]
        token = v.node_token[nodes]
        hit = token >= 0
        found.append((place[hit], token[hit], np.full(int(hit.sum()), length)))
        inside = begin[place] + length < size[word[place]]
        nodes, place = nodes[inside], place[inside]
    place, token, length = (np.concatenate(c) for c in zip(*found))
    end = begin[place] + length
    order = np.argsort(end, kind="stable")
    place, token, end = place[order], token[order], end[order]
    cut = np.searchsorted(end, np.arange(1, top + 2))
    last = np.full((top + 1, len(words)), -1, np.int64)
    for e in range(1, top + 1):
        p, t = place[cut[e - 1] : cut[e]], token[cut[e - 1] : cut[e]]
        w, b = word[p], begin[p]
        good = b == 0
        check = np.flatnonzero(~good)
        good[check] = v.fits(last[b[check], w[check]], t[check])
        last[e, w[good]] = t[good]
    # Step back from the end of each word.
    at, live, columns = size.copy(), np.arange(len(words)), []
    while len(live):
        t = last[at[live], live]
        columns.append((live, t))
        at[live] -= v.width[t]
        live = live[at[live] > 0]
    counts = np.zeros(len(words), np.int64)
    for rows, _ in columns:
        counts[rows] += 1
    out = np.empty(int(counts.sum()), np.int64)
    upto = np.cumsum(counts)
    for back, (rows, t) in enumerate(columns):
        out[upto[rows] - 1 - back] = t
    return out, counts


class PieceEncoder:
    """Pieces by the splitting pattern and the prefix tables; see ``chunk_cache.Encode``."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        words: dict[bytes, int] = {}
        pieces: list[list[int]] = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            pieces.append([words.setdefault(w.encode(), len(words)) for w in self.split(raw[s:e].decode())])
        listed = list(words)
        short = [w for w in listed if len(w) <= TOGETHER_BYTES]
        flat, counts = encode_together(self.vocabulary, short)
        long_ids = [PrefixEncoder(self.vocabulary, w).ids() for w in listed if len(w) > TOGETHER_BYTES]
        flat = np.concatenate([flat, *[np.array(x, np.int64) for x in long_ids]])
        counts = np.concatenate([counts, np.array([len(x) for x in long_ids], np.int64)])
        number = {w: i for i, w in enumerate(short + [w for w in listed if len(w) > TOGETHER_BYTES])}
        place = np.array([number[w] for w in listed], np.int64)
        per_piece = np.array([len(p) for p in pieces], np.int64)
        use = place[np.array([w for p in pieces for w in p], np.int64)]
        begin = np.cumsum(counts) - counts
        ids = flat[ragged_take(begin[use], counts[use])]
        piece = np.repeat(np.arange(len(pieces)), per_piece)
        return ids, np.bincount(piece, counts[use], len(pieces)).astype(np.int64)


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of ``ids``."""
    return vocabulary.pool[ragged_take(vocabulary.pool_start[ids], vocabulary.width[ids])]


def prefix_cache(ranks_text: str, pattern: str) -> tuple[Vocabulary, PieceCache]:
    v = Vocabulary(read_ranks(ranks_text))
    return v, PieceCache(PieceEncoder(v, pattern), dtype=np.uint16 if v.size <= 1 << 16 else np.uint32)


def encode_documents(
    docs: DataFrame, ranks_text: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and (on request) ids, 32 bits each.

    The ids are decoded again and must give the bytes of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks_text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encode = worker_memo("prefix_cache", lambda: prefix_cache(shared.value, pattern))
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            counts_of, hashes, decoded_hashes, kept = [], [], [], []
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                ids, counts = encode(data[part[0] : part[-1]], part - part[0])
                wide = ids.astype("<u4")
                raw, back = memoryview(wide).cast("B"), memoryview(np.ascontiguousarray(decode(v, ids)))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                byte_bounds = np.concatenate([[0], np.cumsum(v.width[ids])])[bounds].tolist()
                bounds = (bounds * 4).tolist()
                counts_of += counts.tolist()
                hashes += [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(bounds, bounds[1:])]
                decoded_hashes += [hashlib.sha256(back[s:e]).hexdigest() for s, e in zip(byte_bounds, byte_bounds[1:])]
                kept += [bytes(raw[s:e]) for s, e in zip(bounds, bounds[1:])] if with_ids else [None] * len(counts)
            arrays = [batch.column(0), pa.array(counts_of, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = source.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return encoded if with_ids else encoded.drop("ids")
