"""Toxicity by a bidirectional gated recurrent network over windows of words.

Each word has a word input and character inputs. Both hold learned vectors, one
of the word's hash and the mean of those of its character n-grams with the word's
borders, trained together with the network; beside them stand weights of
evidence, log odds of toxic against clean training documents of the word and its
n-grams. Two gated recurrent layers read a window of words in both directions,
attention pools their states, and a logit comes out. All windows of every text
are scored, each overlapping the next by half; a text's logit is its largest,
calibrated on training documents.

Weak labels: a label belongs to a document, so a toxic training document stands
for its window with most evidence, a clean one for the two with most evidence
and a random one. Tables and network learn from different training documents,
so the network sees evidence as it is on new texts. All training is numpy, on a
bounded sample (``MOST`` labelled rows of each class).

Defined cases: null texts and texts without words score 0; repeated rows score
alike; without both labels, or words under them, every text scores 0; very long texts are read in
whole, window by window; an empty table gives an empty result; where labels of
one doc_id contradict each other, 1 counts; extra columns are ignored by
``scored`` and kept by ``kept``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import words as W
from palisade.llm.labelled import fold, sample
from palisade.llm.workers import released

MOST = 3000  # labelled rows of each class
BITS = 18  # of the hashed tables
GRAMS = (4, 5, 6)  # bytes, with the word's borders
WINDOW, STRIDE = 32, 16
HIDDEN = 8
EPOCHS, BATCH = 6, 128
CHUNK = 250  # training texts spelt out at once
SLICE = 1 << 19  # bytes of text scored at once
EVIDENCE = 6  # inputs that are weights of evidence
VECTOR = 8  # inputs of each learned vector
START = 0.01  # deviation of learned vectors before training; words that no training text has stay near 0
RATE = 0.0003  # of their steps
HIDE = 0.8  # share of words whose learned vectors a training step leaves out, so that the network does not lean on words it has learned by heart
VECTOR_BITS = 14  # of the learned vectors' hashed tables
INPUTS = EVIDENCE + 2 * VECTOR


class Lexicon(NamedTuple):
    """Distinct words of some texts, spelt out one after the other, each between two border bytes."""

    word: np.ndarray  # hashes
    first: np.ndarray  # offsets of the spelling
    grams: list[np.ndarray]  # for each n-gram size the table's slot at each byte; _NONE where the word is over
    index: np.ndarray  # the place here of each word of the texts
    at: np.ndarray  # offsets of the texts into index


_NONE = 1 << BITS


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def lexicon(texts: pa.Array) -> Lexicon:
    w = W.words(texts)
    h, index, inverse = np.unique(W.hashes(w), return_index=True, return_inverse=True)
    start, size = w.start[index], (w.end - w.start)[index]
    first = np.concatenate([[0], np.cumsum(size + 2)])
    data = np.full(first[-1], 1, np.uint8)
    inner = np.ones(len(data), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    data[inner] = w.data[np.repeat(start - first[:-1] + 2 * np.arange(len(size)), size) + np.arange(size.sum())]
    left = np.repeat(first[1:], size + 2) - np.arange(len(data))
    value = data.astype(np.uint64) + np.uint64(7)
    rolling, grams = np.zeros(len(data), np.uint64), []
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling * np.uint64(0x100000001B3)
        rolling[: max(0, len(data) - n + 1)] += value[n - 1 :]
        if n in GRAMS:
            grams.append(np.where(left >= n, _slots(W.mix(rolling + np.uint64(n << 40))), _NONE))
    return Lexicon(h, first, grams, inverse, w.first)


def evidence(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of log odds of words and of n-grams, from the documents that have them, shrunk where these are few."""
    counts = np.zeros((2, 2, _NONE + 1))
    for begin in range(0, len(texts), CHUNK):
        lex = lexicon(pa.array(texts[begin : begin + CHUNK], pa.string()))
        for i, y in enumerate(labels[begin : begin + CHUNK]):  # documents of the bounded sample
            used = np.unique(lex.index[lex.at[i] : lex.at[i + 1]])
            counts[0, y, np.unique(_slots(lex.word[used]))] += 1
            size = np.diff(lex.first)[used]
            inside = np.repeat(lex.first[used] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
            counts[1, y, np.unique(np.concatenate([g[inside] for g in lex.grams]))] += 1
    total = np.bincount(labels, minlength=2)
    tables = []
    for clean, toxic in counts:
        odds = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1))
        tables.append((odds * (toxic + clean) / (toxic + clean + 4)).astype(np.float32))
    tables[1][_NONE] = -3
    return tables[0], tables[1]


def weights(lex: Lexicon, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Evidence of the distinct words, as columns, with one more, all 0, for the padding."""
    n = len(lex.word)
    out = np.zeros((EVIDENCE, n + 1), np.float32)
    if n:
        found = [tables[1][g] for g in lex.grams]
        best = found[0]
        for f in found[1:]:
            best = np.maximum(best, f)
        size = np.diff(lex.first)
        out[0, :n] = tables[0][_slots(lex.word)]
        out[1, :n] = np.maximum.reduceat(best, lex.first[:-1])
        out[2, :n] = np.add.reduceat(best, lex.first[:-1]) / size
        out[3, :n] = best[lex.first[:-1]]
        out[4, :n] = np.log(size) / 2
        out[5, :n] = 1
    return out


class Spelled(NamedTuple):
    """Places of words' vectors: one for each word, and those of its shortest n-grams, one word after the other."""

    word: np.ndarray
    gram: np.ndarray
    at: np.ndarray  # offsets of the words into gram; each has one place at least


def spelled(lex: Lexicon) -> Spelled:
    shift = BITS - VECTOR_BITS
    return Spelled(_slots(lex.word) >> shift, lex.grams[0] >> shift, lex.first)


class Vectors:
    """Learned vectors of words and of n-grams, by hash; the last n-gram's stays 0, for places past a word's last one."""

    def __init__(self, rng: np.random.Generator):
        size = 1 << VECTOR_BITS
        self.p = {"word": rng.normal(0, START, (size, VECTOR)).astype(np.float32), "gram": rng.normal(0, START, (size + 1, VECTOR)).astype(np.float32)}
        self.p["gram"][-1] = 0

    def of(self, s: Spelled) -> np.ndarray:
        """(2 * VECTOR, words); a few words at a time, as n-grams are many."""
        n = len(s.word)
        out = np.empty((2 * VECTOR, n), np.float32)
        out[:VECTOR] = self.p["word"][s.word].T
        for i in range(0, n, 20_000):
            at = s.at[i : i + 20_001]
            slots = s.gram[at[0] : at[-1]]
            known = np.add.reduceat((slots < 1 << VECTOR_BITS).astype(np.float32), at[:-1] - at[0])
            out[VECTOR:, i : i + 20_000] = (np.add.reduceat(self.p["gram"][slots], at[:-1] - at[0]) / np.maximum(known, 1)[:, None]).T
        return out

    def gradients(self, s: Spelled, d: np.ndarray) -> dict[str, np.ndarray]:
        """From the derivatives by what ``of`` gave."""
        size = np.diff(s.at)
        inside = s.gram < 1 << VECTOR_BITS
        known = np.maximum(np.add.reduceat(inside.astype(np.float32), s.at[:-1]), 1)
        of = np.repeat(np.arange(len(size)), size)[inside]
        slots, each = s.gram[inside], d[VECTOR:] / known
        total = lambda at, values, n: np.column_stack([np.bincount(at, v, n) for v in values]).astype(np.float32)
        return {"word": total(s.word, d[:VECTOR], 1 << VECTOR_BITS), "gram": total(slots, each[:, of], (1 << VECTOR_BITS) + 1)}


class Adam:
    """Steps with moments for parameters by name, in place."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = p, rate, 0
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}

    def move(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            a, b = self.moment[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            self.p[k] -= (self.rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.99**self.step)) + 1e-8) + 1e-5 * self.p[k]).astype(np.float32)


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and the offsets of the texts: windows cover every word, each word but at the ends twice."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    step = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return np.repeat(at[:-1], count) + step * STRIDE, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, attention pooling and a logit; ``p`` has all parameters by name. Windows are columns."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        k = HIDDEN
        draw = lambda *s: (rng.normal(0, 1 / np.sqrt(s[1]), s)).astype(np.float32)
        self.p = {f"{name}{d}": draw(*shape) for d in "fb" for name, shape in (("x", (3 * k, INPUTS)), ("zr", (2 * k, k)), ("n", (k, k)))}
        self.p |= {"a": draw(k, 2 * k), "v": draw(1, k), "u": draw(1, 2 * k), "c": np.zeros(1, np.float32)}

    def layer(self, gates, d: str, keep: bool):
        """States of one direction; gates(t) has the inputs' part of the gates at step t, (3 * HIDDEN, windows)."""
        zr, n, k = self.p[f"zr{d}"], self.p[f"n{d}"], HIDDEN
        out, saved, h = [None] * WINDOW, [], None
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            g = gates(t)
            if h is None:
                h = np.zeros((k, g.shape[1]), np.float32)
            s = zr @ h
            s += g[: 2 * k]
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            z, r = s[:k], s[k:]
            new = n @ (r * h)
            new += g[2 * k :]
            np.tanh(new, out=new)
            if keep:
                saved.append((t, h, z, r, new))
            h = h + z * (new - h)
            out[t] = h
        return out, saved

    def logits(self, gates: dict, pad: np.ndarray, keep: bool = False):
        """Logit of each window. gates: by direction, see ``layer``; pad: (steps, windows), what is no word."""
        (f, sf), (b, sb) = (self.layer(gates[d], d, keep) for d in "fb")
        p, k = self.p, HIDDEN
        m = [np.tanh(p["a"][:, :k] @ x + p["a"][:, k:] @ y) for x, y in zip(f, b, strict=True)]
        e = np.concatenate([p["v"] @ x for x in m])
        e[pad] = -30
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        c = np.concatenate([sum(w[t] * x[t] for t in range(WINDOW)) for x in (f, b)])
        y = (p["u"] @ c)[0] + p["c"]
        return (y, (f, b, m, w, c, sf, sb)) if keep else y

    def gradients(self, dy: np.ndarray, x: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Back-propagation through time of the loss's derivatives by the logits; x: (steps, INPUTS, windows), as is ``inputs`` of the result."""
        f, b, m, w, c, sf, sb = kept
        h, m = np.concatenate([np.stack(f), np.stack(b)], 1), np.stack(m)
        k, p = HIDDEN, self.p
        out = {"u": dy[None] @ c.T, "c": dy.sum(keepdims=True), "inputs": np.zeros_like(x)}
        dc = p["u"].T * dy
        dw = (h * dc).sum(1)
        de = w * (dw - (w * dw).sum(0))
        dm = de[:, None] * p["v"].T * (1 - m * m)
        out["v"] = (m * de[:, None]).sum((0, 2))[None]
        out["a"] = np.einsum("tkn,tjn->kj", dm, h)
        dh = w[:, None] * dc + p["a"].T @ dm
        for d, saved, part in (("f", sf, dh[:, :k]), ("b", sb, dh[:, k:])):
            dx, dzr, dn = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"zr{d}"]), np.zeros_like(p[f"n{d}"])
            back = np.zeros_like(part[0])
            for t, before, z, r, new in reversed(saved):
                g = part[t] + back
                da = g * z * (1 - new * new)
                drh = p[f"n{d}"].T @ da
                s = np.concatenate([g * (new - before) * z * (1 - z), drh * before * r * (1 - r)])
                dn += da @ (r * before).T
                dzr += s @ before.T
                gates = np.concatenate([s, da])
                dx += gates @ x[t].T
                out["inputs"][t] += p[f"x{d}"].T @ gates
                back = g * (1 - z) + drh * r + p[f"zr{d}"].T @ s
            out |= {f"x{d}": dx, f"zr{d}": dzr, f"n{d}": dn}
        return out


class Model:
    """Tables, network and calibration."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 11):
        y = np.array(labels, np.int64)
        self.ready = len(set(labels)) == 2
        if not self.ready:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        learn = np.zeros(len(y), bool)
        for value in (0, 1):
            of = order[y[order] == value]
            learn[of[: max(1, int(0.6 * len(of)))]] = True
        pick = lambda mask: [t for t, m in zip(texts, mask, strict=True) if m]
        self.tables = evidence(pick(learn), y[learn])
        rest = ~learn if len(set(y[~learn].tolist())) == 2 else learn
        texts, y = pick(rest), y[rest]
        found = [self._windows(texts[i : i + CHUNK], y[i : i + CHUNK], rng) for i in range(0, len(texts), CHUNK)]
        target = np.concatenate([t for *_, t in found])
        self.ready = len(target) > 0
        if not self.ready:
            return
        self.net, self.vectors = Network(seed), Vectors(rng)
        self._train(found, target, rng)
        # calibration: logistic regression of the labels on the documents' largest logits
        z = np.concatenate([self._logits(pa.array(texts[i : i + CHUNK], pa.string())) for i in range(0, len(texts), CHUNK)])
        use = np.isfinite(z)
        z, y = z[use], y[use]
        mean, spread = z.mean(), max(1e-6, z.std())
        z = (z - mean) / spread
        a, b = 1.0, 0.0
        balance = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0) ** 0.5
        for _ in range(300):
            q = _sigmoid(a * z + b)
            a, b = a - 0.5 * np.average((q - y) * z, weights=balance) - 1e-4 * a, b - 0.5 * np.average(q - y, weights=balance)
        self.scale, self.shift = a / spread, b - a * mean / spread

    def _train(self, found: list[tuple], target: np.ndarray, rng: np.random.Generator) -> None:
        """Network and vectors from the windows of ``_windows``: words of all chunks are numbered on."""
        size = np.cumsum([0] + [len(words.word) for _, words, _, _ in found])
        known = np.concatenate([x for x, *_ in found], 1)
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(words.at) for _, words, _, _ in found]))])
        every = Spelled(np.concatenate([w.word for _, w, _, _ in found]), np.concatenate([w.gram for _, w, _, _ in found]), at)
        ids = np.concatenate([np.where(i < 0, -1, i + n) for (_, _, i, _), n in zip(found, size, strict=False)], 1)
        weight = np.where(target == 1, np.sqrt((target == 0).sum() / max(1, target.sum())), 1).astype(np.float32)
        net, vectors = Adam(self.net.p, 0.01), Adam(self.vectors.p, RATE)
        for _ in range(max(EPOCHS, min(60, 40_000 // max(1, len(target))))):
            for part in np.array_split(rng.permutation(len(target)), max(1, len(target) // BATCH)):
                pad = ids[:, part] < 0
                used, place = np.unique(ids[:, part], return_inverse=True)
                place, used = place.reshape(pad.shape) - int(used[0] < 0), used[used >= 0]
                span = np.diff(every.at)[used]
                grams = np.repeat(every.at[used] - np.concatenate([[0], np.cumsum(span)])[:-1], span) + np.arange(span.sum())
                words = Spelled(every.word[used], every.gram[grams], np.concatenate([[0], np.cumsum(span)]))
                full = np.zeros((INPUTS, len(used) + 1), np.float32)  # the last column is the padding's
                full[:EVIDENCE, :-1] = known[:, used]
                shown = (rng.random(len(used)) >= HIDE).astype(np.float32)
                full[EVIDENCE:, :-1] = self.vectors.of(words) * shown
                x = np.ascontiguousarray(full[:, place].transpose(1, 0, 2))
                gates = {d: lambda t, d=d, x=x: self.net.p[f"x{d}"] @ x[t] for d in "fb"}
                out, kept = self.net.logits(gates, pad, keep=True)
                dy = (_sigmoid(out) - target[part]) * weight[part] / weight[part].sum()
                slopes = self.net.gradients(dy.astype(np.float32), x, kept)
                dx = slopes.pop("inputs").transpose(1, 0, 2)[EVIDENCE:][:, ~pad]
                net.move(slopes)
                vectors.move(self.vectors.gradients(words, np.stack([np.bincount(place[~pad], row, len(used)) for row in dx]) * shown))

    def _windows(self, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, Spelled, np.ndarray, np.ndarray]:
        """The words of the windows that stand for some training texts: evidence and spelling, their places in these windows (-1: none), and the labels."""
        lex = lexicon(pa.array(texts, pa.string()))
        x = weights(lex, self.tables)
        start, first = windows(lex.at)
        ids = self._ids(lex, start, first)
        strength = x[:4].sum(0)[ids].max(1)
        chosen, target = [], []
        for i in range(len(y)):
            span = np.arange(first[i], first[i + 1])
            if len(span):
                best = span[np.argsort(-strength[span], kind="stable")]
                these = best[:1] if y[i] else np.append(best[:2], rng.choice(span))
                chosen += these.tolist()
                target += [y[i]] * len(these)
        ids = ids[np.array(chosen, np.int64)].T
        used, place = np.unique(ids[ids < len(lex.word)], return_inverse=True)
        out = np.full(ids.shape, -1, np.int64)
        out[ids < len(lex.word)] = place
        whole = spelled(lex)
        grams = [whole.gram[whole.at[i] : whole.at[i + 1]] for i in used.tolist()]
        at = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
        words = Spelled(whole.word[used], np.concatenate([np.zeros(0, np.int32), *grams]), at)
        return x[:, used], words, out, np.array(target, np.float32)

    def inputs(self, lex: Lexicon) -> np.ndarray:
        """Input vectors of the distinct words, as columns, with one more, all 0, for the padding."""
        n = len(lex.word)
        out = np.zeros((INPUTS, n + 1), np.float32)
        out[:EVIDENCE] = weights(lex, self.tables)
        out[EVIDENCE:, :n] = self.vectors.of(spelled(lex))
        return out

    def _logits(self, texts: pa.Array) -> np.ndarray:
        """Largest logit of each text; -inf without words."""
        lex = lexicon(texts)
        return self._largest(lex, self.inputs(lex))

    @staticmethod
    def _ids(lex: Lexicon, start: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the words of each window in the lexicon; its length where there is no word."""
        place = start[:, None] + np.arange(WINDOW)
        stop = np.repeat(lex.at[1:], np.diff(first))
        full = np.append(lex.index, 0)
        return np.where(place < stop[:, None], full[np.minimum(place, len(lex.index))], len(lex.word))

    def _largest(self, lex: Lexicon, x: np.ndarray) -> np.ndarray:
        """Largest logit over the windows of each text; -inf without words."""
        start, first = windows(lex.at)
        table = {d: self.net.p[f"x{d}"] @ x for d in "fb"}
        out = np.empty(len(start), np.float32)
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for i in range(0, len(start), 1024):
            lot = slice(i, i + 1024)
            place = start[lot, None] + np.arange(WINDOW)
            ids = np.where(place < lex.at[1:][of[lot], None], lex.index[np.minimum(place, len(lex.index) - 1)], len(lex.word)).T
            gates = {d: lambda t, d=d: np.take(table[d], ids[t], axis=1) for d in "fb"}
            out[lot] = self.net.logits(gates, ids == len(lex.word))
        best = np.full(len(first) - 1, -np.inf)
        some = np.diff(first) > 0
        if some.any():
            best[some] = np.maximum.reduceat(out, first[:-1][some])
        return best

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(texts))
        best = self._logits(texts)
        return np.where(np.isfinite(best), _sigmoid(self.scale * np.where(np.isfinite(best), best, 0) + self.shift), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "toxic", MOST))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.pieces(whole, most=SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; their texts are read once and not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.pieces(whole, most=SLICE):
                score = shared.value.scores(b.column(b.schema.get_field_index("text")))
                yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(released(run), docs.schema)
