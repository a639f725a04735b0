"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

A pattern of m characters that occurs with at most e edits shares at least
m + 1 - q - e·q of its q-grams with the place of occurrence, all within e + 1
neighbouring diagonals (text position minus pattern position).  Shared q-grams
are counted in bands of 2(e + 1) diagonals that overlap by half, so one band
holds all of them; bands below the bound are dropped, the rest are verified by
an edit-distance alignment limited to the band.

A quote may begin and end anywhere in an item, so besides abutting patterns an
item has short ones that overlap: a quote of ``WINDOW + STEP`` characters holds
one of them whole, wherever it lies.  Occurrences of an item's patterns that
continue each other are one place.  An item too short to be told from ordinary
words (under ``MIN_ITEM_CHARS``) counts where it is a whole line of a document.

Benchmark items are cut into patterns and indexed in blocks of at most
``BLOCK_CHARS`` characters.  Each block is one pass over the documents with
the block's index broadcast, so its size is bounded however large the
benchmark is.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import SPACE, code_points, lowered, text_blocks
from .common import on_workers, text_or_empty

Q = 8                    # a power of two
EDIT_RATE = 0.1
PATTERN_CHARS = 100      # abutting patterns have this many to twice as many characters
WINDOW, STEP = 59, 20    # length of the overlapping patterns and of the steps between them
MIN_ITEM_CHARS = 30      # shorter items would match anywhere: they must be a whole line
BLOCK_CHARS = 1_000_000
SLICE_CHARS = 1_000_000
_TABLE_BITS = 22


def normalised(text: str) -> np.ndarray:
    """Lower-case code points, one per character; white space becomes a blank."""
    low, kind = lowered(code_points(text))
    return np.where(kind == SPACE, np.uint32(32), low)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters at every position, by doubling."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width, base = 1, 0xBF58476D1CE4E5B9
    while width < Q:
        n = max(len(h) - width, 0)
        h = h[:n] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    return h ^ (h >> np.uint64(29))


def line_key(line: str) -> str:
    """A line as short items are compared: lower case, one blank for white space."""
    return " ".join(line.lower().split())


class Index:
    """Q-gram index of the patterns of some benchmark items; short items by
    their line (``lines``: key → items)."""

    def __init__(self, items: list[tuple], edit_rate: float = EDIT_RATE):
        self.patterns, self.item, self.text, self.offset = [], [], [], []
        self.texts = []
        self.lines: dict[str, list] = {}
        for item, text in items:
            codes = normalised(text)
            if len(codes) < MIN_ITEM_CHARS:
                if key := line_key(text):
                    self.lines.setdefault(key, []).append(item)
                continue
            parts = np.array_split(np.arange(len(codes)), max(1, len(codes) // PATTERN_CHARS))
            spans = {(int(p[0]), int(p[-1]) + 1) for p in parts}
            last = len(codes) - WINDOW
            if last > 0:
                spans |= {(at, at + WINDOW) for at in [*range(0, last, STEP), last]}
            for lo, hi in sorted(spans):
                self.patterns.append(codes[lo:hi])
                self.item.append(item)
                self.text.append(len(self.texts))
                self.offset.append(lo)
            self.texts.append(codes)
        size = np.array([len(p) for p in self.patterns], np.int64)
        # an edit budget at which the lemma still asks for a shared q-gram
        self.edits = np.minimum((size * edit_rate).astype(np.int64), (size - Q) // Q) if len(size) else size
        self.need = size + 1 - Q - self.edits * Q
        self.size = size
        if not len(size):
            return
        grams = [_grams(p) for p in self.patterns]
        owner = np.repeat(np.arange(len(size)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.at = np.unique(flat[order], return_index=True)
        self.at = np.append(self.at, len(flat))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.gram >> np.uint64(64 - _TABLE_BITS)] = True

    def __len__(self):
        return len(self.patterns) + len(self.lines)

    def line_hits(self, text: str) -> list[tuple]:
        """(item, start, end) of the text's lines that are short items."""
        out, at = [], 0
        for line in text.split("\n") if self.lines else ():
            # white space around a line and in it is free, so its length bounds nothing
            for item in self.lines.get(line_key(line), ()):
                start = at + len(line) - len(line.lstrip())
                out.append((item, start, at + len(line.rstrip())))
            at += len(line) + 1
        return out


def align(region: np.ndarray, pattern: np.ndarray, edits: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits between ``pattern`` and a part of ``region``, and that
    part's end.  ``anchored``: the part starts at the region's start.  Only
    diagonals that ``edits`` can reach are computed, and none once all of them
    cost more."""
    m, pad = len(pattern), edits
    width = (2 * edits if anchored else max(len(region) - m, 0) + 2 * edits) + 1
    far = np.uint32(0xFFFFFFFF)
    text = np.full(width + m + pad, far, np.uint32)
    text[pad:pad + len(region)] = region[:len(text) - pad]
    ramp = np.arange(width)
    row = np.abs(ramp - pad) if anchored else np.zeros(width, np.int64)
    if anchored:
        row[:pad] = m + edits
    for i in range(m):
        step = row + (text[i:i + width] != pattern[i])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
        if i % 8 == 7 and row.min() > edits:
            return edits + 1, 0
    k = int(row.argmin())
    return int(row[k]), min(max(k + m - pad, 0), len(region))


def search(codes: np.ndarray, bounds: np.ndarray, index: Index) -> list[tuple]:
    """All (text number, pattern, start, end, edits) of indexed patterns in the
    concatenated texts ``codes``; text i is codes[bounds[i]:bounds[i + 1]]."""
    if not index.patterns or len(codes) < Q:
        return []
    grams = _grams(codes)
    hit = np.flatnonzero(index.table[grams >> np.uint64(64 - _TABLE_BITS)])
    slot = np.minimum(np.searchsorted(index.gram, grams[hit]), len(index.gram) - 1)
    real = index.gram[slot] == grams[hit]
    hit, slot = hit[real], slot[real]
    times = index.at[slot + 1] - index.at[slot]
    post = np.repeat(index.at[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner = index.owner[post]
    step = index.edits[owner] + 1
    start = np.repeat(hit, times) - index.place[post] + (1 << 20) * step     # diagonal, kept positive
    band = start // step
    key = np.concatenate([band, band - 1]) + (owner[None, :].repeat(2, 0).ravel() << 40)
    # counts by slot first: a band below the bound in its slot is below it alone
    bucket = ((key * -7046029254386353131) >> 44) & ((1 << 20) - 1)
    enough = np.bincount(bucket, minlength=1 << 20)[bucket] >= index.need[key >> 40]
    # a place of the pattern counts once, however often the text repeats its q-gram
    pair = np.unique(np.stack([key[enough], index.place[np.concatenate([post, post])[enough]]]), axis=1)[0]
    key, count = np.unique(pair, return_counts=True)
    key = key[count >= index.need[key >> 40]]
    found: dict[tuple, tuple] = {}
    for k in key.tolist():
        p, b = k >> 40, k & ((1 << 40) - 1)
        e, m, pattern = int(index.edits[p]), int(index.size[p]), index.patterns[p]
        low = (b - (1 << 20)) * (e + 1) - e
        high = low + 2 * (e + 1) + m + 3 * e
        first = max(int(np.searchsorted(bounds, max(low, 0), "right")) - 1, 0)
        for t in range(first, len(bounds) - 1):
            if bounds[t] >= high:
                break
            lo, hi = max(low, int(bounds[t])), min(high, int(bounds[t + 1]))
            if hi - lo < m - e:
                continue
            region = codes[lo:hi]
            same = region.tobytes().find(pattern.tobytes())
            if same >= 0 and same % 4 == 0:
                cost, end, length = 0, same // 4 + m, m
            else:
                cost, end = align(region, pattern, e)
                if cost > e:
                    continue
                back = region[max(end - m - e, 0):end][::-1]
                length = align(back, pattern[::-1], e, anchored=True)[1]
            place = (t, p, lo + end - length - int(bounds[t]), lo + end - int(bounds[t]))
            found.setdefault(place, (*place, cost))
    return list(found.values())


def _hits(texts: list[str], index: Index) -> list[tuple]:
    """``search`` over a list of texts in blocks of bounded size; a longer
    text is searched in slices that overlap by more than a pattern."""
    out = []
    overlap = 4 * PATTERN_CHARS
    for lo, hi in text_blocks(texts):
        if len(texts[hi - 1]) > SLICE_CHARS:
            out += [(lo + t, *rest) for t, *rest in _hits(texts[lo:hi - 1], index)]
            seen = set()
            for at in range(0, len(texts[hi - 1]), SLICE_CHARS):
                part = normalised(texts[hi - 1][at:at + SLICE_CHARS + overlap])
                seen.update((hi - 1, p, at + a, at + b, cost)
                            for _, p, a, b, cost in search(part, np.array([0, len(part)]), index))
            out += sorted(seen)
            continue
        codes = normalised("\n".join(texts[lo:hi]))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        out += [(lo + t, *rest) for t, *rest in search(codes, bounds, index)]
    return out


def search_texts(texts: list[str], index: Index) -> list[tuple]:
    """All (text number, item, start, end, edits): places that hold a pattern
    of an item.  Occurrences of its patterns that overlap and lie alike in
    text and item are one place; its edits are those between the place and
    the part of the item that the patterns span."""
    places: dict[tuple, list] = {}
    for t, p, start, end, cost in sorted(_hits(texts, index), key=lambda x: (x[0], x[2], x[3], x[1])):
        e, lo, hi = int(index.edits[p]), index.offset[p], index.offset[p] + len(index.patterns[p])
        known = places.setdefault((t, index.text[p]), [])
        for x in known:
            if start <= x["end"] and abs(start - lo - x["shift"]) <= e + x["e"]:
                break
        else:
            known.append(x := {"start": start, "end": end, "lo": lo, "hi": hi, "costs": [], "item": index.item[p]})
        x.update(end=max(end, x["end"]), lo=min(lo, x["lo"]), hi=max(hi, x["hi"]), shift=start - lo, e=e)
        x["costs"].append(cost)
    out = []
    for (t, k), known in places.items():
        for x in known:
            cost = x["costs"][0]
            if len(x["costs"]) > 1:
                most = sum(x["costs"])
                cost = min(align(normalised(texts[t][x["start"]:x["end"]]), index.texts[k][x["lo"]:x["hi"]], most)[0], most)
            out.append((t, x["item"], x["start"], x["end"], cost))
    return out + [(t, *hit, 0) for t, text in enumerate(texts) for hit in index.line_hits(text)]


def indexes(benchmark: DataFrame, item_col: str, text_col: str, edit_rate: float) -> Iterator[Index]:
    """Indexes of the benchmark, each of at most ``BLOCK_CHARS`` characters
    plus one item; rows are streamed, one block is held at a time."""
    rows = benchmark.select(F.col(item_col).cast("long"), text_or_empty(text_col)).distinct()
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield Index(block, edit_rate)
            block, size = [], 0
    if block:
        yield Index(block, edit_rate)


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE) -> DataFrame:
    """One row per occurrence: ``doc_id, item_id, start, end`` (characters of
    the text) and ``edits``.

    Letter case and the kind of white space do not count.  An occurrence is a
    part of an item of at least ``WINDOW`` characters, or the whole of a
    shorter one, see ``Index`` and ``search_texts``; an item of under
    ``MIN_ITEM_CHARS`` characters occurs where it is a whole line.

    * NULL and blank items are not searched; NULL and empty documents contain
      nothing.
    * Rows that repeat a document give their occurrences again; NULL ids stay.
    * Other columns are ignored; an empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, start long, end long, edits int"
    rows = on_workers(docs).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    context = docs.sparkSession.sparkContext

    def run(shared):
        def occurrences(batches):
            for pdf in batches:
                got = search_texts(pdf["text"].tolist(), shared.value)
                ids = pdf["id"].to_numpy()
                yield pd.DataFrame([(ids[t], *rest) for t, *rest in got],
                                   columns=["doc_id", "item_id", "start", "end", "edits"], dtype=object)
        return occurrences
    parts = [rows.mapInPandas(run(context.broadcast(x)), schema)
             for x in indexes(benchmark, item_col, item_text_col, edit_rate) if len(x)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def contaminated(df: DataFrame, index: Index, text_col: str = "text") -> Column:
    """Whether the text holds a pattern of ``index``."""
    shared = on_workers(df).sparkSession.sparkContext.broadcast(index)

    def test(texts):
        out = np.zeros(len(texts), bool)
        whole = texts.tolist()
        out[[t for t, *_ in _hits(whole, shared.value)]] = True
        out |= np.array([bool(shared.value.line_hits(t)) for t in whole], dtype=bool)
        return pd.Series(out)
    test.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(test, "boolean")(text_or_empty(text_col))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", edit_rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the rows that hold a passage of ``benchmark`` (see
    ``find_passages``); all columns stay."""
    for index in indexes(benchmark, item_col, item_text_col, edit_rate):
        if len(index):
            docs = docs.filter(~contaminated(docs, index, text_col))
    return docs
