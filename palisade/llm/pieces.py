"""Sampled segmentation into vocabulary pieces, and lossless decoding.

A segmentation is drawn with probability proportional to the product of its
pieces' weights: forward sums over the lattice of all pieces that stand in the
text, then pieces are drawn backwards from its end. Random numbers are hashes of
the row key, the place and the step, so a rerun draws the same pieces.

The vocabulary only has ranks, no probabilities; the piece of rank r weighs
``1 / (r + 10) ** sharpness``. White space is marked as in the vocabulary: a
space goes before the text, and a space begins a piece. No piece has a space
after another character, so the lattice falls apart into units (spaces and the
characters up to the next space), and a unit's forward sums are computed once
for all its places. Characters outside the vocabulary, among them the white
space mark itself, become byte pieces, so decoding gives back every text.

Units of a slice of texts are handled together, by their end; units of more than
``LONG`` bytes one by one and block by block, so that a line of many megabytes
without a space needs little memory.

Defined cases: null gives null pieces; an empty text has no pieces; equal rows
(key and text) get equal pieces; a null key counts as a key of its own; very
long texts are one sequence of units; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from palisade.llm import words as W
from palisade.llm.language_model import Table
from palisade.llm.workers import released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64
SLICE = 1 << 20
BLOCK = 1 << 15  # bytes of a long unit whose sums are held at once
_STEP = np.uint64(0x100000001B3)
_MARK = "▁"


class Vocabulary:
    """Pieces as bytes (a space for the mark), weights, and tables to find them."""

    def __init__(self, pieces: list[tuple[str, int]], specials: int, sharpness: float):
        """pieces: text and id, in order of rank; byte pieces follow the ``specials`` first ids."""
        self.byte = specials + np.arange(256)
        size = max(i for _, i in pieces) + 1
        self.text = [bytes([i - specials]) if specials <= i < specials + 256 else b"" for i in range(size)]
        self.log = np.full(size, -np.inf)
        for rank, (text, i) in enumerate(pieces):
            self.text[i] = text.replace(_MARK, " ").encode()
            self.log[i] = -sharpness * math.log(rank + 10)
        ids = np.array([i for _, i in pieces])
        self.most = max(len(self.text[i]) for i in ids)
        self.ids = ids.astype(np.int32)
        self.found = {self.text[i]: int(i) for i in ids}
        keys = np.array([self._key(self.text[i]) for i in ids], np.uint64)
        self.table = Table(W.mix(keys))
        # a constant for each byte leaves the proportions as they are and keeps the sums far from underflow
        self.weight = np.where(np.isfinite(self.log), np.exp(self.log + [1.2 * len(x) for x in self.text]), 0.0)
        self.single = np.zeros(128, bool)
        self.wide = np.sort(np.array([ord(t) for t, _ in pieces if len(t) == 1 and ord(t) >= 128 and t != _MARK], np.int64))
        for t, _ in pieces:
            if len(t) == 1 and ord(t) < 128:
                self.single[ord(t)] = True
        self.single[32] = _MARK in {t for t, _ in pieces}
        lengths = np.array([len(x) for x in self.text])
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)

    @staticmethod
    def _key(raw: bytes) -> int:
        k = 0
        for b in raw:
            k = (k * int(_STEP) + b + 7) % (1 << 64)
        return k

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' bytes one after the other, and the number of bytes of each."""
        size = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def vocabulary(path: str = MODEL, sharpness: float = 1.0) -> Vocabulary:
    """Read on the driver; executors get the tables."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    first = next(i for i in ids if model.is_byte(i))
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    rank = sorted(normal, key=lambda i: (-model.get_score(i), i))
    return Vocabulary([(model.id_to_piece(i), i) for i in rank], first, sharpness)


class Units(NamedTuple):
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # offsets of the texts


def units(texts: pa.Array, v: Vocabulary) -> Units:
    """Each non-empty text gets a space in front; bytes of characters outside the vocabulary are units of their own."""
    raw, at = W.raw(texts)
    full = np.diff(at) > 0
    offsets = at + np.concatenate([[0], np.cumsum(full)])
    data = np.full(offsets[-1], 32, np.uint8)
    inner = np.ones(len(data), bool)
    inner[offsets[:-1][full]] = False
    data[inner] = raw
    known = np.zeros(len(data), bool)
    ascii_ = data < 128
    known[ascii_] = v.single[data[ascii_]]
    lead = np.flatnonzero(data >= 0xC0)
    size = np.where(data[lead] >= 0xF0, 4, np.where(data[lead] >= 0xE0, 3, 2))
    stop = np.repeat(offsets[1:], np.diff(offsets))[lead] if len(lead) else lead
    point = np.where(size == 2, data[lead] & 0x1F, np.where(size == 3, data[lead] & 0x0F, data[lead] & 0x07)).astype(np.int64)
    good = lead + size <= stop
    for k in (1, 2, 3):
        more = size > k
        byte = data[np.minimum(lead + k, len(data) - 1)]
        good &= ~more | (byte >> 6 == 2)
        point = np.where(more, point << 6 | (byte & 0x3F), point)
    if len(v.wide) and len(lead):
        good &= v.wide[np.minimum(np.searchsorted(v.wide, point), len(v.wide) - 1)] == point
        for k in range(4):
            known[lead[good & (size > k)] + k] = True
    begin = ~known
    begin[offsets[:-1][full]] = True
    begin[1:] |= ~known[:-1] | ((data[1:] == 32) & (data[:-1] != 32))
    start = np.flatnonzero(begin)
    return Units(data, start, np.append(start[1:], len(data)), np.searchsorted(start, offsets))


class Lattice(NamedTuple):
    """Edges by their end: those of node n are first[n]:first[n + 1]; byte e of unit u is node base[e] + u."""

    first: np.ndarray
    share: np.ndarray  # running shares of the node's forward sum
    piece: np.ndarray
    size: np.ndarray
    base: np.ndarray


def lattice(data: np.ndarray, start: np.ndarray, length: np.ndarray, v: Vocabulary) -> Lattice:
    """Forward sums of units sorted by falling length."""
    most = int(length[0])
    live = np.searchsorted(-length, -np.arange(most + 1), "right")  # live[e]: units with at least e bytes
    live[0] = len(length)
    base = np.concatenate([[0], np.cumsum(live)])
    total = np.zeros(base[-1])
    total[: live[0]] = 1
    ends, pieces, sizes, parts = [], [], [], []
    for j in range(most):
        key = np.zeros(live[j + 1], np.uint64)
        for n in range(1, min(v.most, most - j) + 1):
            c = live[j + n]
            key = key[:c] * _STEP + data[start[:c] + j + n - 1].astype(np.uint64) + np.uint64(7)
            place = v.table.find(W.mix(key))
            hit = np.flatnonzero(place >= 0)
            ids = v.ids[place[hit]]
            if j == 0 and n == 1:  # bytes outside the vocabulary
                alone = np.flatnonzero((place < 0) & (length[:c] == 1))
                hit, ids = np.append(hit, alone), np.append(ids, v.byte[data[start[alone]]])
            weight = np.where(v.weight[ids] > 0, v.weight[ids], 1.0)
            weight = weight * total[base[j] + hit]
            use = weight > 0
            end = base[j + n] + hit[use]
            total[end] += weight[use]
            ends.append(end)
            pieces.append(ids[use].astype(np.int32))
            sizes.append(np.full(int(use.sum()), n, np.int8))
            parts.append(total[end].copy())
    count = np.zeros(base[-1], np.int64)
    for end in ends:
        count[end] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    fill = first[:-1].copy()
    piece, size, share = np.empty(first[-1], np.int32), np.empty(first[-1], np.int8), np.empty(first[-1])
    for end, p, s, part in zip(ends, pieces, sizes, parts, strict=True):
        at = fill[end]
        piece[at], size[at], share[at] = p, s, part / total[end]
        fill[end] += 1
    return Lattice(first, share, piece, size, base)


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (W.mix(key + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def draw(lat: Lattice, unit: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each place of a unit, drawn from its end: flat ids, in order, and their number for each place."""
    n = len(unit)
    at, place = length.astype(np.int64).copy(), np.arange(n)
    count = np.zeros(n, np.int64)
    steps = []
    step = 0
    while len(place):
        node = lat.base[at[place]] + unit[place]
        u = _uniform(key[place], step)
        edge = lat.first[node]
        last = lat.first[node + 1] - 1
        move = np.flatnonzero((u >= lat.share[edge]) & (edge < last))
        while len(move):
            edge[move] += 1
            move = move[(u[move] >= lat.share[edge[move]]) & (edge[move] < last[move])]
        steps.append((place, lat.piece[edge]))
        count[place] += 1
        at[place] -= lat.size[edge]
        place = place[at[place] > 0]
        step += 1
    stop = np.cumsum(count)
    out = np.empty(stop[-1] if n else 0, np.int32)
    for k, (places, ids) in enumerate(steps):
        out[stop[places] - 1 - k] = ids
    return out, count


def _edges(data: np.ndarray, begin: int, end: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that end after byte ``begin`` and up to ``end``, by their end, longest first: offsets of the ends, sizes and ids."""
    low = max(0, begin - v.most)
    ends, sizes, ids = [], [], []
    key = np.zeros(end - low, np.uint64)
    for n in range(1, min(v.most, end - low) + 1):
        key = key[: end - low - n + 1] * _STEP + data[low + n - 1 : end].astype(np.uint64) + np.uint64(7)
        skip = max(0, begin - low - n + 1)
        place = v.table.find(W.mix(key[skip:]))
        hit = np.flatnonzero(place >= 0)
        ends.append(low + skip + hit + n)
        sizes.append(np.full(len(hit), n, np.int64))
        ids.append(v.ids[place[hit]])
    end_of, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(ids)
    order = np.lexsort((-size, end_of))
    return np.searchsorted(end_of[order], np.arange(begin + 1, end + 2)), size[order], piece[order]


def _sums(data: np.ndarray, begin: int, end: int, tail: list[float], v: Vocabulary, keep: bool):
    """Forward sums of the ends of a block; ``tail``: those of the ``v.most`` + 1 places up to ``begin``, on any common scale.

    Returns the tail after the block and, with ``keep``, for each edge the running share of its end's sum.
    """
    first, size, piece = _edges(data, begin, end, v)
    weight, sizes, at = v.weight[piece].tolist(), size.tolist(), first.tolist()
    total, shares = list(tail), []
    for e in range(end - begin):
        here, run = len(total), 0.0
        parts = []
        for i in range(at[e], at[e + 1]):
            run += weight[i] * total[here - sizes[i]]
            parts.append(run)
        if keep:
            shares += [x / run for x in parts] if run else parts
        total.append(run)
        if run > 1e100 or 0.0 < run < 1e-100:  # only proportions within the last places matter
            total[-v.most - 1 :] = [x / run for x in total[-v.most - 1 :]]
    return total[-v.most - 1 :], (at, sizes, piece, shares)


def draw_long(data: np.ndarray, key: int, v: Vocabulary) -> np.ndarray:
    """One long unit, block by block: forward with the sums of the last places only, then backward, where each block's sums are computed again."""
    n, most = len(data), v.most
    begins = list(range(0, n, BLOCK))
    tails = [[0.0] * most + [1.0]]
    for begin in begins[:-1]:
        tails.append(_sums(data, begin, begin + BLOCK, tails[-1], v, keep=False)[0])
    keys, drawn, at, step, random, known = np.full(BLOCK, key, np.uint64), [], n, 0, [], 0
    for begin, tail in zip(reversed(begins), reversed(tails), strict=True):
        _, (first, sizes, piece, shares) = _sums(data, begin, min(n, begin + BLOCK), tail, v, keep=True)
        chosen = []
        while at > begin:
            if step >= known:
                steps = np.arange(known, known + BLOCK, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                random, known = (W.mix(keys + steps) >> np.uint64(11)).astype(np.float64) * 2.0**-53, known + BLOCK
            u, low, high = random[step % BLOCK], first[at - begin - 1], first[at - begin]
            edge = next((i for i in range(low, high) if u < shares[i]), high - 1)
            chosen.append(edge)
            at -= sizes[edge]
            step += 1
        drawn.append(piece[chosen])
    return np.concatenate(drawn)[::-1]


def encode(texts: pa.Array, keys: np.ndarray, v: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and the texts' offsets."""
    u = units(texts, v)
    length = u.end - u.start
    span = W.Words(u.data, np.zeros(1, np.int64), u.start, u.end, u.first)
    text = span.text_of()
    place = np.arange(len(text)) - u.first[text]
    row = W.mix(keys.astype(np.uint64) + np.uint64(seed))
    key = W.mix(row[text] ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    count = np.zeros(len(length), np.int64)
    short = length <= LONG
    flat = np.zeros(0, np.int32)
    if short.any():
        _, index, inverse = np.unique(W.hashes(span)[short], return_index=True, return_inverse=True)
        start, size = u.start[short][index], length[short][index]
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flat, count[short] = draw(lattice(u.data, start[order], size[order], v), rank[inverse], length[short], key[short])
    extra = {i: draw_long(u.data[u.start[i] : u.end[i]], int(key[i]), v) for i in np.flatnonzero(~short)}
    for i, ids in extra.items():
        count[i] = len(ids)
    at = np.concatenate([[0], np.cumsum(count)])
    if extra:
        whole = np.empty(at[-1], np.int32)
        whole[np.repeat(short, count)] = flat
        for i, ids in extra.items():
            whole[at[i] : at[i + 1]] = ids
        flat = whole
    return flat, at[u.first]


def decode(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and their offsets; the space in front is taken off again."""
    data, size = v.spell(ids)
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    full = np.diff(ends) > 0
    use = np.ones(len(data), bool)
    use[ends[:-1][full]] = False
    return data[use], ends - np.concatenate([[0], np.cumsum(full)])


def _ids(flat: np.ndarray, at: np.ndarray, null: np.ndarray) -> pa.Array:
    if null.any():
        offsets = pa.array(np.append(at[:-1], at[-1]).astype(np.int32), mask=np.append(null, False))
        return pa.ListArray.from_arrays(offsets, pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))


def encoded(docs: DataFrame, path: str = MODEL, seed: int = 29, sharpness: float = 1.0) -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces and lossless for each row of ``docs``; lossless tells that decoding gave the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, sharpness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            for b in W.pieces(whole, most=SLICE):
                texts = b.column(1)
                keys = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).view(np.uint64)
                flat, at = encode(texts, keys, v, seed)
                raw, offsets = W.raw(texts)
                data, back = decode(flat, at, v)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                if np.array_equal(raw, data) and np.array_equal(offsets, back):
                    same = np.ones(len(b), bool)
                else:
                    same = np.array([np.array_equal(raw[offsets[i] : offsets[i + 1]], data[back[i] : back[i + 1]]) for i in range(len(b))])
                columns = [pa.array(np.diff(offsets)), pa.array(np.diff(at)), _ids(flat, at, null), pa.array(same)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_pieces", "pieces", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_bytes long, n_pieces long, pieces array<int>, lossless boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text for each row with doc_id and pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 500):
                b = whole.slice(i, 500)
                lists = b.column(1)
                size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, at = decode(ids, np.concatenate([[0], np.cumsum(size)]), shared.value)
                whole_text = data.tobytes()
                texts = [whole_text[x:y] if ok else None for x, y, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "pieces").mapInArrow(released(run), "doc_id long, text string")
