"""Hidden Markov language model over word classes, with exact sequence likelihoods.

A token is a word (lower-case A-Z, no white space) or the end of its text.
Counts over all training texts give the base model,
``u(w) = (c + 0.5) / (N + 0.5 * (V + 1))``. The most frequent words are classes of
their own; every other word, known or not, falls by a hash of its last bytes into one of
the other classes, whose number grows with the vocabulary. Hidden states emit classes, and inside a class
words keep their base proportions:

    P(w | state) = P(class(w) | state) * u(w) / U(class(w)),  U: the class's sum of u

so that the probability of a text is the forward probability of its class
sequence times a product that only depends on its tokens. An unknown word counts
as its bucket's unknown word, with the base model's half a count; the model's
outcomes are the known words and one unknown word for each bucket, and their
probabilities add up to 1 in every state.

Training is Baum-Welch from seeded emissions around the base model. The classes
of all training texts are written once; each round reads them, every partition
sums its expected counts, and these are added up by class; rounds go on until the summed likelihood of the training
texts rises by no more than ``RISE`` of itself, all over whole texts. Words are
counted, and words outside the frequent classes joined, by shuffles that grow
with the corpus; only the frequent words (a bounded number) are broadcast.

Defined cases: null and empty texts have one token, the end; repeated rows each
count; a null doc_id is in the fold of the empty text; without training texts all
tokens are unknown; words of equal counts at the cut of the frequent ones go by their
hash; a very long text is read whole, its segments side by side; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import words as W
from palisade.llm.frequent import most_frequent
from palisade.llm.store import Stages

STATES = 8
FREQUENT = 20_000  # words that are classes of their own
LISTED = 200_000  # words whose counts are broadcast; the counts of all others are joined
BUCKETS, MOST_BUCKETS, WORDS = 64, 4096, 4000  # classes of all other words: one for so many known words, a power of two, at least and at most
RISE = 1e-4  # training ends when a round raises the summed log likelihood by no more than this share
LONG, SEGMENT = 8192, 2048  # tokens from which on a text is cut, and of its segments
LANES = 8192  # texts or segments that go step by step together
SLICE = 4 << 20  # bytes of text read at once
TOKENS = 2_500_000  # tokens whose expected counts are computed at once
ROWS = 500_000  # forward states held at once; longer runs of texts go by blocks, whose states are computed twice
END = np.uint64(0xE7037ED1A0B428DB)  # the end token's hash


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, a hash of each one's last bytes, and the offsets of the texts."""
    w = W.words(texts)
    at = w.first + np.arange(len(w.first))
    h = np.full(at[-1], END, np.uint64)
    tail = np.zeros(at[-1], np.uint64)
    word = np.arange(len(w.start)) + w.text_of()
    h[word] = W.hashes(w)
    size = w.end - w.start
    for k in (1, 2, 3):
        byte = w.data[np.maximum(w.end - k, w.start)].astype(np.uint64)
        tail[word] = tail[word] * np.uint64(257) + np.where(size >= k, byte + np.uint64(1), np.uint64(0))
    return h, W.mix(tail), at


class Table:
    """Places of known 64-bit keys, by open addressing; -1 for all others."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(10, int(4 * len(keys)).bit_length())
        self.mask, self.probes = np.uint64(size - 1), 0
        self.keys, self.place = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            slot = ((keys[left] + np.uint64(self.probes)) & self.mask).astype(np.int64)
            free = np.flatnonzero(self.place[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.place[slot[won]] = keys[left[won]], left[won]
            left = np.delete(left, won)
            self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & self.mask).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.place[slot], -1)
        left = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        for p in range(1, self.probes):
            slot = ((h[left] + np.uint64(p)) & self.mask).astype(np.int64)
            hit = self.keys[slot] == h[left]
            out[left[hit]] = self.place[slot[hit]]
            left = left[~hit & (self.place[slot] >= 0)]
        return out


class Classes:
    """The class of each token: a frequent word's place, or its bucket after them."""

    def __init__(self, frequent: np.ndarray, buckets: int = BUCKETS):
        self.table, self.top, self.buckets, self.size = Table(frequent), len(frequent), buckets, len(frequent) + buckets

    def of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return self.among(self.table.find(h), tail)

    def among(self, place: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The classes from the tokens' places in a list that begins with the frequent words; -1: not in it."""
        return np.where((place >= 0) & (place < self.top), place, self.top + (tail % np.uint64(self.buckets)).astype(np.int32))


def buckets_for(words: int) -> int:
    """A power of two that grows with the number of known words."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (max(1, words // WORDS) - 1).bit_length()))


def _lots_of(length: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes in lots of similar length, longest first within a lot."""
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), LANES):
        yield order[i : i + LANES]


class Lanes(NamedTuple):
    """Runs of tokens that go step by step side by side: whole texts, and the segments of long ones.

    ``prior``: the states' probabilities at the first token, before it is seen; ``after``: how likely what follows the
    run is from each state; ``before``: the states at the token before a segment, 0 at a text's begin.
    """

    text: np.ndarray
    at: np.ndarray
    length: np.ndarray
    prior: np.ndarray
    after: np.ndarray
    before: np.ndarray


def _through(classes: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray, move: np.ndarray, emit: np.ndarray, moves_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of states (segments, rows, states) taken through segments sorted by falling length; each row adds up to 1, its scale is the second result."""
    scale, k = np.zeros(state.shape[:2]), state.shape[2]
    state = state.astype(emit.dtype)
    for t in range(int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))
        now = state[:live]
        if t or moves_first:
            now = (now.reshape(-1, k) @ move).reshape(now.shape)
        now = now * emit[classes[at[:live] + t]][:, None]
        total = now.sum(2)
        state[:live] = now / total[..., None]
        scale[:live] += np.log(total)
    return state.astype(np.float64), scale


def lanes(classes: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Lanes:
    """Whole texts, those over ``LONG`` tokens as segments of ``SEGMENT``.

    What a segment does to the states is a product of matrices, which is computed for all segments side by side; from these
    products follow, segment by segment, the states before each and the likelihood after it.
    """
    length, k = np.diff(first), len(start)
    long = np.flatnonzero(length > LONG)
    short = np.flatnonzero(length <= LONG)
    whole = Lanes(short, first[short], length[short], np.tile(start, (len(short), 1)), np.ones((len(short), k)), np.zeros((len(short), k)))
    if not len(long):
        return whole
    count = -(-length[long] // SEGMENT)
    text, head = np.repeat(long, count), np.cumsum(count) - count
    nth = np.arange(len(text)) - np.repeat(head, count)
    at = first[text] + nth * SEGMENT
    size = np.minimum(SEGMENT, first[text + 1] - at)
    later = np.flatnonzero(nth > 0)
    later = later[np.argsort(-size[later], kind="stable")]
    product, scale = np.empty((len(text), k, k)), np.empty((len(text), k))
    if len(later):
        product[later], scale[later] = _through(classes, at[later], size[later], np.tile(np.eye(k), (len(later), 1, 1)), move, emit, True)
    begun, _ = _through(classes, at[head], size[head], np.tile(start, (len(head), 1, 1)), move, emit, False)
    before, after = np.zeros((len(text), k)), np.ones((len(text), k))
    for one, begin, end in zip(begun[:, 0], head, head + count, strict=True):
        for i in range(begin + 1, end):
            before[i] = one
            weight = one * np.exp(scale[i] - scale[i].max())
            one = weight @ product[i]
            one = one / one.sum()
        for i in range(end - 2, begin - 1, -1):
            ahead = np.exp(scale[i + 1] - scale[i + 1].max()) * (product[i + 1] @ after[i + 1])
            after[i] = ahead / (before[i + 1] @ ahead)
    prior = before @ move.astype(np.float64)
    prior[head] = start
    cut = Lanes(text, at, size, prior, after, before)
    return Lanes(*(np.concatenate(x) for x in zip(whole, cut, strict=True)))


def forward(classes: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 of the forward probability of each text's classes, by the scaled recursion. ``emit`` is (classes, states)."""
    out, every, ones = np.zeros(len(first) - 1), lanes(classes, first, start, move, emit), np.ones(len(start))
    for lot in _lots_of(every.length):
        length, at = every.length[lot], every.at[lot]
        total = np.zeros(len(lot))
        state = every.prior[lot]
        for t, live in enumerate(np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()):
            now = state[:live] @ move if t else state[:live]
            now *= np.take(emit, classes[at[:live] + t], axis=0)
            scale = now @ ones
            now /= scale[:, None]
            state = now
            total[:live] += np.log10(scale)
        np.add.at(out, every.text[lot], total)
    return out


def expected(classes: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over whole texts (forward-backward)."""
    return gathered(classes, first, start, move, emit)[:3]


def gathered(classes: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The expected counts and the summed log10 likelihood.

    Steps go by blocks: only the forward states at their begins are kept, and the backward pass computes each
    block's states again from there, so a very long text needs no more memory than many short ones. States have the
    parameters' precision, which is single in training; all sums are double.
    """
    k, likelihood = len(start), 0.0
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k))
    every = lanes(classes, first, start, move, emit)
    for lot in _lots_of(every.length):
        length, at = every.length[lot], every.at[lot]
        live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        _, found = np.unique((np.cumsum(live) - 1) // ROWS, return_index=True)
        begins = found.tolist()
        ends = [*begins[1:], len(live)]
        entry = [every.prior[lot].astype(emit.dtype)]  # forward states at the begin of each block
        for begin, end in zip(begins[:-1], ends, strict=False):
            entry.append(_block(classes, at, live[begin:end], begin, entry[-1], move, emit)[3])
        beta, ahead = every.after[lot].astype(emit.dtype), None
        for begin, end, state in zip(reversed(begins), reversed(ends), reversed(entry), strict=True):
            here = live[begin:end]
            place = np.concatenate([[0], np.cumsum(here)])
            alpha, seen, scale, _, given = _block(classes, at, here, begin, state, move, emit)
            likelihood += float(np.log10(scale).sum(dtype=np.float64))
            gamma = np.empty_like(alpha)
            for t in range(len(here) - 1, -1, -1):
                n, rows = here[t], slice(place[t], place[t + 1])
                if ahead is not None:
                    m = len(ahead)
                    moves += alpha[place[t] : place[t] + m].T @ ahead
                    beta[:m] = ahead @ move.T
                np.multiply(alpha[rows], beta[:n], out=gamma[rows])
                ahead = given[rows]  # each step's emissions are used once more, and then hold its part of the sums
                ahead *= beta[:n]
                ahead /= scale[rows, None]
            gamma /= (gamma @ np.ones(k, emit.dtype))[:, None]
            gamma = np.ascontiguousarray(gamma.T)
            if begin == 0:
                before = every.before[lot]
                moves += before.T @ ahead  # from the segments before these
                starts += gamma[:, : here[0]][:, ~before.any(1)].sum(1, dtype=np.float64)
            for s in range(k):
                emits[:, s] += np.bincount(seen, gamma[s], len(emit))
    return starts, moves * move, emits, likelihood


def _block(classes: np.ndarray, at: np.ndarray, live: np.ndarray, begin: int, state: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scaled forward states, classes and scales of some steps from ``begin`` on, step by step, the state after them, and each place's emissions."""
    place = np.concatenate([[0], np.cumsum(live)])
    step = np.repeat(np.arange(len(live)), live)
    seen = classes[at[np.arange(place[-1]) - place[step]] + begin + step].astype(np.int64)
    given, ones = np.take(emit, seen, axis=0), np.ones(state.shape[1], emit.dtype)
    alpha, scale = np.empty_like(given), np.empty(place[-1], emit.dtype)
    for t, n in enumerate(live.tolist()):
        rows = slice(place[t], place[t + 1])
        now = alpha[rows]
        if begin + t:
            np.matmul(state[:n], move, out=now)
            now *= given[rows]
        else:
            np.multiply(state[:n], given[rows], out=now)
        np.matmul(now, ones, out=scale[rows])
        now /= scale[rows, None]
        state = now
    return alpha, seen, scale, state.copy(), given


class Model:
    """Parameters of the class model; ``mass`` has U of each class."""

    def __init__(self, classes: Classes, mass: np.ndarray, seed: int):
        self.classes, self.mass = classes, mass
        rng = np.random.default_rng(seed)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
        self.emit = mass[:, None] * rng.gamma(2.0, 0.5, (len(mass), STATES))
        self.emit /= self.emit.sum(0)

    def learn(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        """One maximisation; classes are smoothed towards the base model, so nothing gets probability 0."""
        self.start = (starts + 1) / (starts + 1).sum()
        self.move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        emits = emits + self.mass[:, None] * max(1.0, 0.02 * emits.sum() / STATES)
        self.emit = emits / emits.sum(0)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.start, self.move, self.emit


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of the training texts of each few MB, with the tail hash that gives a token's bucket."""
    found, size = [], 0

    def flush() -> pa.RecordBatch:
        h, tail = (np.concatenate(x) for x in zip(*found, strict=True))
        token, at, count = np.unique(h, return_index=True, return_counts=True)
        columns = [token.view(np.int64), (tail[at] % np.uint64(MOST_BUCKETS)).astype(np.int32), count.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "bucket", "c"])

    for whole in batches:
        for b in W.pieces(whole, most=SLICE):
            h, tail, _ = _tokens(b.column(0))
            found.append((h, tail))
            size += len(h)
            if size > 2_000_000:
                yield flush()
                found, size = [], 0
    if found:
        yield flush()


def _sequences(shared):
    """The classes of some texts' tokens, one after the other, and the texts' offsets: written once, read in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.pieces(whole, most=SLICE):
                h, tail, first = _tokens(b.column(0))
                rows = [[shared.value.of(h, tail).astype(np.int32).tobytes()], [first.astype(np.int64).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in rows], ["classes", "first"])

    return run


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and offsets of ``TOKENS`` tokens or more at a time: the more texts go together, the less each step costs, so the rest goes with the last of them."""
    full, held, size = [], [], 0
    for b in batches:
        for classes, first in zip(b.column(0), b.column(1), strict=True):
            held.append((np.frombuffer(classes.as_buffer(), np.int32), np.frombuffer(first.as_buffer(), np.int64)))
            size += len(held[-1][0])
            if size >= TOKENS:
                if full:
                    yield _together(full)
                full, held, size = held, [], 0
    if full or held:
        yield _together(full + held)


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    begin = np.cumsum([0, *[len(c) for c, _ in held]])
    return np.concatenate([c for c, _ in held]), np.append(np.concatenate([f[:-1] + n for (_, f), n in zip(held, begin, strict=False)]), begin[-1])


def _expected(shared):
    """Rows (class, state, count) of a partition's expected counts; class -1 - s has the moves from state s, -1000 the starts, -1001 the likelihood in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for classes, first in _lots(batches):
            made = gathered(classes, first, *shared.value)
            total = made if total is None else tuple(x + y for x, y in zip(total, made, strict=True))
        if total is not None:
            rows = np.concatenate([np.full((1, STATES), total[3]), total[0][None], total[1], total[2]])
            label = np.concatenate([[-1001, -1000], -1 - np.arange(STATES), np.arange(len(total[2]))])
            used = rows.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(label[used], pa.int32()), *[pa.array(rows[used, s]) for s in range(STATES)]], ["class", *[f"s{s}" for s in range(STATES)]])

    return run


def _scores(shared):
    """Per text its forward score and sums over listed words; per unlisted word of a text a row to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model, log_mass, listed, log_base = shared.value
        names = ["row", "doc_id", "token", "times", "n_tokens", "listed", "partial", "inside"]
        for whole in batches:
            for b in W.pieces(whole, most=SLICE):
                h, tail, first = _tokens(b.column(2))
                n, length = len(b), np.diff(first)
                text = np.repeat(np.arange(n), length)
                place = listed.find(h)
                c = classes.among(place, tail)
                known = place >= 0
                partial = np.bincount(text[known], log_base[place[known]], n)
                inside = forward(c, first, *model) - np.bincount(text, log_mass[c], n)
                row, zero = b.column(0).to_numpy(zero_copy_only=False), np.zeros(n, np.int64)
                columns = [zero, zero, length, np.bincount(text[known], minlength=n), partial, inside]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, columns)], names)
                text, token = text[~known], h[~known]
                order = np.argsort(token)
                order = order[np.argsort(text[order], kind="stable")]
                text, token = text[order], token[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
                at = np.flatnonzero(new)
                zero, none = np.zeros(len(at), np.int64), np.zeros(len(at))
                columns = [row[text[at]], zero, token[at].view(np.int64), np.diff(np.append(at, len(text))), zero, zero, none, none]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return run


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of doc_id as text, modulo 5; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def scored(docs: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``."""
    spark = docs.sparkSession
    stages = Stages(spark, "language-model")
    train = docs.where(fold(docs["doc_id"]) != 1).select("text")
    counted = train.mapInArrow(_counts, "token long, bucket int, c long")
    vocabulary = stages.keep(counted.groupBy("token", "bucket").agg(F.sum("c").alias("c")))
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    whole, extra = float(total["n"]) + 0.5 * (total["v"] + 1), 0.5
    often = most_frequent(vocabulary, "c", LISTED).toPandas().sort_values(["c", "token"], ascending=[False, True])
    token = often["token"].to_numpy(np.int64).view(np.uint64)
    log_base = np.log10((often["c"].to_numpy(np.int64) + extra) / whole)
    buckets = buckets_for(total["v"])
    classes = Classes(token[:FREQUENT], buckets)
    share = 10.0 ** log_base[:FREQUENT]
    by_bucket = vocabulary.groupBy((F.col("bucket") % buckets).alias("bucket")).agg((F.sum("c") + extra * F.count("*")).alias("mass")).toPandas()
    mass = np.zeros(buckets)
    mass[by_bucket["bucket"]] = by_bucket["mass"].to_numpy(np.float64) / whole
    np.subtract.at(mass, often["bucket"].to_numpy()[:FREQUENT] % buckets, share)
    mass = np.concatenate([share, np.maximum(mass, 0) + extra / whole])
    model = Model(classes, mass, seed)
    names = [f"s{s}" for s in range(STATES)]
    reached = -np.inf
    sequences = stages.keep(train.mapInArrow(_sequences(spark.sparkContext.broadcast(classes)), "classes binary, first binary"))
    while True:
        shared = spark.sparkContext.broadcast(tuple(x.astype(np.float32) for x in model.parts()))
        rows = sequences.mapInArrow(_expected(shared), "class int, " + ", ".join(f"{x} double" for x in names))
        sums = rows.groupBy("class").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
        shared.unpersist()
        if not len(sums):
            break
        label, value = sums["class"].to_numpy(), sums[names].to_numpy()
        moves, emits = np.zeros((STATES, STATES)), np.zeros((classes.size, STATES))
        moves[-1 - label[(label < 0) & (label > -1000)]] = value[(label < 0) & (label > -1000)]
        emits[label[label >= 0]] = value[label >= 0]
        likelihood = float(value[label == -1001, 0].sum())
        if likelihood - reached <= RISE * abs(likelihood):
            break
        reached = likelihood
        model.learn(value[label == -1000].sum(0), moves, emits)
    stages.drop(sequences)
    shared = spark.sparkContext.broadcast((classes, model.parts(), np.log10(mass), Table(token), log_base))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kinds = "row long, doc_id long, token long, times long, n_tokens long, listed long, partial double, inside double"
    made = stages.keep(numbered.mapInArrow(_scores(shared), kinds))
    others = made.where("times > 0").select("row", "token", "times").join(vocabulary.select("token", "c"), "token", "left")
    unknown = F.col("c").isNull()
    value = F.log10((F.coalesce("c", F.lit(0)) + F.lit(extra)) / F.lit(whole))
    others = others.groupBy("row").agg(
        F.sum(F.col("times") * value).alias("other"),
        F.sum(F.when(unknown, 0).otherwise(F.col("times"))).alias("found"),
    )
    out = made.where("times = 0").join(others, "row", "left")
    base_score = F.col("partial") + F.coalesce("other", F.lit(0.0))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        (F.col("listed") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        (F.col("inside") + base_score).alias("score"),
    )
