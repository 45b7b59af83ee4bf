"""Byte-level BPE over many texts with an exact cache of encoded chunks.

The splitting pattern of the tokenizer never lets a pre-token run from a visible
character into a following space or line feed, and looks at nothing to its left.
A text cut before such a blank therefore encodes piece by piece. Pieces repeat
often, so their ids are kept in a direct-mapped table whose keys are the bytes
themselves: a clash only costs another encoding, never a wrong id.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from stationlens.llm.common import ragged_take

#: Longest piece the table keeps, and most ids of one piece.
KEY_BYTES = 24
KEY_IDS = 16

#: encode(buffer, starts, ends) -> (ids of all pieces in order, ids per piece)
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_MASKS = np.array([[(1 << 8 * min(max(n - 8 * w, 0), 8)) - 1 for n in range(KEY_BYTES + 1)] for w in range(3)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def cut_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a text may be cut before the blanks at ``at``: the character before is surely visible.

    Characters that may be Unicode blanks (lead bytes C2, E1, E2, E3) are never cut behind.
    """
    before, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    ascii_visible = (before > 0x20) & (before < 0x7F)
    wide = (before >= 0x80) & (second != 0xC2) & ~((third >= 0xE1) & (third <= 0xE3))
    return ascii_visible | wide


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece of every row, ascending."""
    blank = (data == 0x20) | (data == 0x0A)
    at = np.flatnonzero(blank[1:]) + 1
    start = np.zeros(len(data), bool)
    start[at[cut_points(data, at)]] = True
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


class PieceCache:
    """Encodes rows of text; ``encode`` is asked only for pieces the table does not hold."""

    def __init__(self, encode: Encode, slot_bits: int = 20, dtype: type = np.uint16):
        self.encode_pieces, self.bits, self.dtype = encode, slot_bits, dtype
        self.words = np.zeros((3, 1 << slot_bits), np.uint64)
        self.lengths = np.zeros(1 << slot_bits, np.uint8)
        self.counts = np.zeros(1 << slot_bits, np.uint8)
        self.ids = np.zeros((1 << slot_bits, KEY_IDS), dtype)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the number of ids of each row."""
        size = len(data)
        if size == 0:
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        starts = split_pieces(data, offsets)
        ends = np.append(starts[1:], size)
        length = ends - starts
        padded = np.zeros(size + KEY_BYTES + 8, np.uint8)
        padded[:size] = data
        word_at = np.ndarray((size + KEY_BYTES,), np.uint64, padded, strides=(1,))
        short = length <= KEY_BYTES
        masks = np.minimum(length, KEY_BYTES)
        keys = [word_at[starts + 8 * w] & _MASKS[w][masks] for w in range(3)]
        mixed = (keys[0] * _ODD[0]) ^ (keys[1] * _ODD[1] + (keys[0] >> np.uint64(31))) ^ (keys[2] * _ODD[2])
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ length.astype(np.uint64)) * _ODD[3]
        mixed ^= mixed >> np.uint64(32)
        slot = ((mixed * _ODD[0]) >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = short & (self.lengths[slot] == length)
        for w in range(3):
            hit &= self.words[w][slot] == keys[w]
        counts = np.where(hit, self.counts[slot], 0).astype(np.int64)
        inside = np.arange(KEY_IDS) < counts[hit][:, None]
        held = self.ids[slot[hit]][inside]  # taken before new pieces replace old ones
        lost = np.flatnonzero(~hit)
        if len(lost):
            flat, begin, counts[lost] = self._missing(padded, starts, ends, keys, mixed, slot, lost, short)
            out = np.empty(int(counts.sum()), self.dtype)
            from_table = np.repeat(hit, counts)
            out[from_table] = held
            out[~from_table] = flat[ragged_take(begin, counts[lost])]
        else:
            out = held
        total = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(total[np.searchsorted(starts, offsets)])

    def _missing(self, padded, starts, ends, keys, mixed, slot, lost, short):
        """Ids of the pieces ``lost``: where each one begins in a flat array, and how many it has."""
        _, first, group = np.unique(mixed[lost], return_index=True, return_inverse=True)
        chosen = lost[first]
        same = short[lost] & ((ends - starts)[lost] == (ends - starts)[chosen][group])
        for key in keys:
            same &= key[lost] == key[chosen][group]
        alone = np.flatnonzero(~same)  # long pieces, and pieces whose hash met another piece's
        ask = np.concatenate([chosen, lost[alone]])
        flat, count = self.encode_pieces(padded, starts[ask], ends[ask])
        begin = np.cumsum(count) - count
        where = group.copy()
        where[alone] = len(chosen) + np.arange(len(alone))
        fits = np.flatnonzero(short[chosen] & (count[: len(chosen)] <= KEY_IDS))
        held, put = chosen[fits], slot[chosen[fits]]
        _, last = np.unique(put[::-1], return_index=True)  # one piece per slot
        pick = len(put) - 1 - last
        held, put, source = held[pick], put[pick], fits[pick]
        for w in range(3):
            self.words[w][put] = keys[w][held]
        self.lengths[put] = (ends - starts)[held]
        self.counts[put] = count[source]
        rows = np.repeat(put, count[source])
        cols = ragged_take(np.zeros(len(source), np.int64), count[source])
        self.ids[rows, cols] = flat[ragged_take(begin[source], count[source])]
        return flat, begin[where], count[where]


class LibraryEncoder:
    """Pieces by the tokenizers library. Neighbours that start with a blank are sent as one text."""

    #: Bytes sent as one text; the library takes longer for a byte of a long text.
    JOINED = 256

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]  # a character stands for a byte

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = data[starts]
        joinable = ((lead == 0x20) | (lead == 0x0A)) & (ends - starts > 1) & cut_points(data, ends)
        raw = data.tobytes()
        apart, together = np.flatnonzero(~joinable), np.flatnonzero(joinable)
        texts = [raw[s:e].decode() for s, e in zip(starts[apart].tolist(), ends[apart].tolist())]
        size = np.cumsum((ends - starts)[together])
        parts = np.split(together, np.searchsorted(size, np.arange(self.JOINED, size[-1], self.JOINED))) if len(size) else []
        texts += [b"".join([raw[s:e] for s, e in zip(starts[p].tolist(), ends[p].tolist())]).decode() for p in parts]
        found = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.zeros(len(starts), np.int64)
        counts[apart] = [len(ids) for ids in found[: len(apart)]]
        for part, ids in zip(parts, found[len(apart) :]):
            bytes_done = np.cumsum(self.width[ids])
            upto = np.searchsorted(bytes_done, np.cumsum((ends - starts)[part])) + 1
            counts[part] = np.diff(upto, prepend=0)
        order = np.concatenate([apart, *parts]).astype(np.int64) if len(parts) else apart
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        begin = np.zeros(len(starts), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged_take(begin, counts)], counts


def library_cache(tokenizer_json: str) -> PieceCache:
    encoder = LibraryEncoder(tokenizer_json)
    return PieceCache(encoder, dtype=np.uint16 if len(encoder.width) <= 1 << 16 else np.uint32)
