"""URL rules as one bit-parallel wildcard automaton.

All glob rules are packed into the bits of a few 64-bit words. Bit i of a rule
says that its first i characters have been matched; ``*`` lets a bit stay set on
any character but ``/``, ``**`` on any character. One step of the extended
Shift-And automaton moves every rule over one character, for all URLs of a batch
at once.

A base rule such as ``example.com/en/`` becomes the two globs ``example.com/en/**``
and ``*.example.com/en/**`` over the canonical URL host + path; the longest rule
that fits decides. Where none fits, the method's own globs (``EXTRA``) block,
and everything else is allowed.

Defined cases: null urls and urls without ``://`` have an empty host and path,
fit no base rule and are allowed; urls of any length are read to their end;
repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base rules: verdict and rule, in no order.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The method's own globs for URLs that no base rule covers: executables, trackers and login or cart pages are blocked.
EXTRA = ("**.exe", "**/wp-login.php", "**/cart/**", "ads.**", "*.ads.**", "**/track/**", "**/login/**")


class Automaton:
    """Globs packed into Shift-And masks; ``fits`` tells for each text and glob whether the glob covers the whole text."""

    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g) for g in globs]
        bits = sum(len(t) for t, _ in tokens) + len(tokens)
        self.words = -(-bits // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.ends = []
        at = 0
        for literals, loops in tokens:
            self._set(self.begin, at)
            for i, byte in enumerate(literals):
                self._set(self.step[byte], at + i)
            for i, wide in loops.items():
                for byte in range(256):
                    if wide or byte != ord("/"):
                        self._set(self.stay[byte], at + i)
            at += len(literals)
            self.ends.append(at)
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    @staticmethod
    def _tokens(glob: str) -> tuple[bytes, dict[int, bool]]:
        """Literal bytes, and by the number of literals before it whether a wildcard is wide."""
        literals, loops, i, raw = bytearray(), {}, 0, glob.encode()
        while i < len(raw):
            if raw[i : i + 1] == b"*":
                wide = raw[i : i + 2] == b"**"
                loops[len(literals)] = wide or loops.get(len(literals), False)
                i += 1 + wide
            else:
                literals.append(raw[i])
                i += 1
        return bytes(literals), loops

    def fits(self, texts: list[bytes]) -> np.ndarray:
        order = np.argsort([-len(x) for x in texts], kind="stable")
        length = np.array([len(texts[i]) for i in order], np.int64)
        joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(length, out=first[1:])
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(length[0]) if len(texts) else 0):
            live = int(np.searchsorted(-length, -j, "left"))  # those longer than j
            c = joined[first[:live] + j]
            moved = state[:live] & self.step[c]
            shifted = moved << one
            shifted[:, 1:] |= moved[:, :-1] >> top
            state[:live] = shifted | (state[:live] & self.stay[c])
        out = np.empty((len(texts), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return out


def _judge(rules: tuple, extra: tuple):
    longest = sorted(rules, key=lambda r: (-len(r[1].encode()), r[1]))
    globs = [g for _, r in longest for g in (f"{r}**", f"*.{r}**")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([*globs, *extra])
        for whole in batches:
            for i in range(0, len(whole), 4096):
                b = whole.slice(i, 4096)
                pages, host, path = b.columns
                texts = [(h + p).encode() for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
                fit = machine.fits(texts)
                base = fit[:, : 2 * len(longest) : 2] | fit[:, 1 : 2 * len(longest) : 2]
                best = np.where(base.any(1), base.argmax(1), -1)
                method = fit[:, 2 * len(longest) :].any(1)
                rule = [longest[k][1] if k >= 0 else None for k in best]
                verdict = [longest[k][0] if k >= 0 else "block" if m else "allow" for k, m in zip(best, method, strict=True)]
                yield pa.RecordBatch.from_arrays([pages, host, path, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path as the contract cuts them; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: tuple = RULES, extra: tuple = EXTRA) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of ``pages``."""
    host, path = parts(F.coalesce("url", F.lit("")))
    cut = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    return cut.mapInArrow(_judge(rules, extra), "page_id long, host string, path string, rule string, verdict string")
