"""Runs of repeated word patterns by internal pattern matching.

The words of a batch of texts become one array of symbols, equal only for
equal words of the same text.  Doubling ranks (rank k: the 2^k words from a
position on) give the suffix array and, by comparing ranks, longest common
extensions.  A run of period q and four periods or more holds, for the block
length b = 2^k nearest to it (2b/3 <= q < 4b/3), an aligned block that occurs
again q words later.  So each aligned block is looked up in its neighbouring
windows: its occurrences are an interval of the suffix array, and a wavelet
tree over the array answers which of them comes next (range successor) or
last.  Several occurrences in one window form an arithmetic progression, whose
difference is a period of the block; then only two distances are left, those
that bring the two stretches of that period onto each other by their starts or
their ends.  Every candidate distance is extended both ways as far as the
words agree, which verifies it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import text_blocks
from .common import on_workers, text_or_empty

LEAST, TIMES = 6, 4          # a run has max(LEAST, TIMES * period) words or more
BLOCK_CHARS = 1_000_000      # texts handled together; a longer text alone


class Ranks:
    """Doubling ranks of a symbol array in which no symbol is shared by two
    texts.  ``at[k][i] == at[k][j]`` (i ≠ j) says that the 2^k words from i and
    from j on are equal; level k is kept while such pairs exist."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]]) if n else np.zeros(0, bool)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.order, self.at, self.alone = order, [], []
        alone = self._alone(head)
        step = 1
        while n:
            lonely = np.empty(n, dtype=bool)
            lonely[order] = alone
            if lonely.all():
                break
            self.at.append(rank)
            self.alone.append(lonely)
            # split the groups of equal starts by what follows; a text's end comes first
            slots = np.flatnonzero(~alone)
            members = order[slots]
            follow = members + step
            after = np.where(follow < ends[members], rank[np.minimum(follow, n - 1)], -1)
            new = np.lexsort((after, rank[members]))
            order = order.copy()
            order[slots] = members[new]
            group, after = rank[members][new], after[new]
            first = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
            rank = rank.copy()
            rank[order[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
            head = np.ones(n, dtype=bool)
            head[slots] = first
            alone = self._alone(head)
            step *= 2
        self.order, self.ends = order, ends

    @staticmethod
    def _alone(head: np.ndarray) -> np.ndarray:
        return head & np.append(head[1:], True)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j (i < j, same text) on."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.at) - 1, -1, -1):                # no pair agrees on 2 · 2^k words at the top level
            live = np.flatnonzero(j + got + (1 << k) <= self.ends[i])
            rank = self.at[k]
            got[live[rank[(i + got)[live]] == rank[(j + got)[live]]]] += 1 << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many words agree just before i and j (i < j, same text)."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.at) - 1, -1, -1):
            live = np.flatnonzero(i - got - (1 << k) >= starts[i])
            rank = self.at[k]
            got[live[rank[(i - got)[live] - (1 << k)] == rank[(j - got)[live] - (1 << k)]]] += 1 << k
        return got


class WaveletTree:
    """Values 0 … m-1 in some order, by bits from the highest: counts and
    order statistics of value ranges in slices, for arrays of queries."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def smaller(self, lo, hi, x):
        """How many values of slots lo … hi-1 are below x (x <= 2^bits)."""
        count = np.where(x >> self.bits > 0, hi - lo, 0)
        for ones, zeros, b in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            up = (x >> b) & 1 == 1
            lo1, hi1 = ones[lo], ones[hi]
            count = count + np.where(up & (x >> self.bits == 0), (hi - hi1) - (lo - lo1), 0)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return count

    def smallest(self, lo, hi, nth):
        """The nth smallest value (from 0) of slots lo … hi-1."""
        value = np.zeros(len(lo), dtype=np.int64)
        for ones, zeros, b in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            lo1, hi1 = ones[lo], ones[hi]
            low = (hi - hi1) - (lo - lo1)
            up = nth >= low
            nth = np.where(up, nth - low, nth)
            value += np.where(up, 1 << b, 0)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return value


def find_runs(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs as (start, length, smallest period), sorted by start and
    period.  ``starts`` and ``ends`` hold, per word, the bounds of its text."""
    none = np.zeros(0, dtype=np.int64)
    ranks = Ranks(symbols, ends)
    if len(ranks.at) < 2:
        return none, none, none
    # word pairs that do not occur twice are in no run of two periods: they are left out of the tree
    kept = ~ranks.alone[1]
    places = np.flatnonzero(kept)
    number = np.concatenate([[0], np.cumsum(kept)])              # position → how many kept positions lie before it
    in_order = ranks.order[kept[ranks.order]]
    slot = np.concatenate([[0], np.cumsum(kept[ranks.order])])   # suffix array slot → slot among the kept
    tree = WaveletTree(number[in_order])
    runs = []
    for k in range(1, len(ranks.at)):
        b, rank = 1 << k, ranks.at[k]
        local = np.arange(len(symbols)) - starts
        s = np.flatnonzero((local & (b - 1) == 0) & ~ranks.alone[k])
        if not len(s):
            continue
        # a group's slots: from its rank to the next group's head
        sizes = np.bincount(rank, minlength=len(symbols))
        lo, hi = slot[rank[s]], slot[rank[s] + sizes[rank[s]]]
        nearest = 1 if k == 1 else -(-2 * b // 3)
        for begin, end in ((nearest, b), (b, -(-4 * b // 3))):
            x, y = number[np.minimum(s + begin, ranks.ends[s])], number[np.minimum(s + end, ranks.ends[s])]
            before, upto = tree.smaller(lo, hi, x), tree.smaller(lo, hi, y)
            hit = np.flatnonzero(upto > before)
            if not len(hit):
                continue
            at, l, h, n0, n1 = s[hit], lo[hit], hi[hit], before[hit], upto[hit]
            first = places[tree.smallest(l, h, n0)]
            single = n1 - n0 == 1
            runs.append(np.stack([at[single], first[single] - at[single]]))
            many = np.flatnonzero(~single)
            if len(many):
                at, first = at[many], first[many]
                second = places[tree.smallest(l[many], h[many], n0[many] + 1)]
                p = second - first
                from_start = first - at - ranks.backward(first, first + p, starts) + ranks.backward(at, at + p, starts)
                from_end = first - at + ranks.forward(first, first + p) - ranks.forward(at, at + p)
                for distance in (from_start, from_end):
                    fits = (distance >= begin) & (distance < end)
                    runs.append(np.stack([at[fits], distance[fits]]))
    if not runs:
        return none, none, none
    at, period = np.unique(np.concatenate(runs, axis=1), axis=1)
    ok = at + period < ranks.ends[at]
    at, period = at[ok], period[ok]
    back = ranks.backward(at, at + period, starts)
    length = back + period + ranks.forward(at, at + period)
    start = at - back
    long = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch found with a multiple of its period is found with the period too
    least = np.ones(len(start), dtype=bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def damaged_words(words: list[bytes], key: bytes) -> list[bytes]:
    """The words with the tail that the key plants: of one key in ten, the
    words from a on repeat the first p of them."""
    h = zlib.crc32(key)
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _digest_texts(texts: list[str], keys: list[bytes]):
    """One result row per text."""
    words = [damaged_words(t.encode("utf-8").split(), k) for t, k in zip(texts, keys)]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(counts)])
    flat = [w for ws in words for w in ws]
    codes = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, dtype=np.int64)
    starts, ends = np.repeat(base[:-1], counts), np.repeat(base[1:], counts)
    # a symbol is a word of one text
    symbols = np.repeat(np.arange(len(words)), counts) * (int(codes.max()) + 1 if len(codes) else 1) + codes
    start, length, period = find_runs(symbols, starts, ends)
    # words after a run's first period are dropped: +1 where such a stretch begins, -1 where it ends
    change = np.bincount(start + period, minlength=len(flat) + 1) - np.bincount(start + length, minlength=len(flat) + 1)
    kept = np.cumsum(change)[:-1] == 0
    of_text = np.searchsorted(start, base)
    for i, ws in enumerate(words):
        lo, hi = of_text[i], of_text[i + 1]
        if lo == hi:
            collapsed, best, report = b" ".join(ws), None, b""
        else:
            s, l, q = start[lo:hi] - base[i], length[lo:hi], period[lo:hi]
            report = "".join([f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), l.tolist(), q.tolist())]).encode()
            best = int(np.lexsort((q, s, -l))[0])
            best = int(s[best]), int(l[best]), int(q[best])
            collapsed = b" ".join([w for w, k in zip(ws, kept[base[i]:base[i + 1]].tolist()) if k])
        yield (int(hi - lo), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
               hashlib.sha256(report).hexdigest(), hashlib.sha256(collapsed).hexdigest())


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
           ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key").to_pylist()
        texts = batch.column("text").to_pylist()
        for lo, hi in text_blocks(texts, BLOCK_CHARS):
            rows = list(_digest_texts(texts[lo:hi], [k.encode() for k in keys[lo:hi]]))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)]],
                                             names=["doc_id", *[n for n, _ in _FIELDS]])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_runs``, the longest run (``start,
    length, period, exponent_milli``; ties to the smallest start, then period;
    NULL without a run) and SHA-256 digests of all runs (``start,length,period``
    lines) and of the text in which each run keeps its first period.

    The text is first given the tail that the CRC-32 of its decimal id plants
    (see ``damaged_words``).  Words are what stands between blanks, tabs and
    line ends.  A NULL text counts as empty, a NULL id as the empty string;
    texts without words have no run and an empty collapsed text.  Repeated
    rows are rows like others; other columns are ignored; an empty table gives
    an empty result.  A very long text is handled whole, in memory that grows
    with its words times the logarithm of its longest repeat."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                       text_or_empty(text_col).alias("text"))
    return on_workers(rows).mapInArrow(_report_batches, f"doc_id {kind}, n_runs long, start long, length long, period long, "
                                       "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
