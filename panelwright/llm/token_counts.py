"""Token counts by trie-shared dynamic programming.

Pre-tokens (words with a leading "▁") are segmented into the vocabulary's
pieces so that the sum of unigram scores is greatest.  The distinct pre-tokens
of a block are visited in the depth-first order of their trie (sorted order):
the forward scores of a prefix are computed once, when the path enters it, and
shared by all words below.  A word's count is stored at its end.  Texts are
counted as sums over their words; nothing is shuffled.

Scores: the vocabulary file gives pieces in order of frequency, so a piece of
rank r gets Zipf's log-probability -ln((r + 2.7) · H), in units of 1/10,000
and rounded, which makes sums exact.  A character without a piece costs its
UTF-8 bytes as byte pieces.  Of equal scores the segmentation with fewer
tokens counts.
"""

from __future__ import annotations

import math
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import text_blocks
from .common import on_workers, text_or_empty

SPACE_MARK = "▁"
MAX_WORDS, LONG_WORD = 700_000, 64
BYTE_SCORE = -200_000


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str) -> dict[str, int]:
    """Piece → score in 1/10,000 nats."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    h = sum(1 / (r + 2.7) for r in range(len(plain)))
    return {sp.id_to_piece(i): round(-10_000 * math.log((r + 2.7) * h)) for r, i in enumerate(plain)}


class Counter:
    """Counts of pre-tokens; remembers those met, up to ``MAX_WORDS``."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.known: dict[str, int] = {}

    def _visit(self, words: list[str]) -> list[int]:
        """Token counts of ``words``, which are sorted: the trie's depth-first order.  best[d], used[d]:
        score and tokens of the best segmentation of the current path's first
        d characters."""
        get, longest = self.scores.get, self.longest
        best, used, path, out = [0], [0], "", []
        for word in words:
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], used[shared + 1:]
            for d in range(shared + 1, len(word) + 1):
                top, count = None, 0
                for start in range(max(0, d - longest), d):
                    s, n = get(word[start:d]), 1
                    if s is None:
                        if start < d - 1:
                            continue
                        n = len(word[start].encode("utf-8", "surrogatepass"))
                        s = n * BYTE_SCORE
                    s += best[start]
                    n += used[start]
                    if top is None or s > top or s == top and n < count:
                        top, count = s, n
                best.append(top)
                used.append(count)
            out.append(used[-1])
            path = word
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        split = [t.split() for t in texts]
        distinct = set(chain.from_iterable(split))
        known = self.known
        fresh = [w for w in distinct if w not in known]
        if len(known) + len(fresh) > MAX_WORDS:
            known.clear()
            fresh = list(distinct)
        fresh.sort()
        known.update(zip(fresh, self._visit([SPACE_MARK + w for w in fresh])))
        out = [(len(words), sum(map(known.__getitem__, words))) for words in split]
        for w in fresh:
            if len(w) > LONG_WORD:
                del known[w]
        return out


def _counts(vocabulary: str, schema: pa.Schema):
    def run(batches):
        counter = Counter(load_scores(vocabulary))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            got = list(chain.from_iterable(counter.count(texts[lo:hi]) for lo, hi in text_blocks(texts)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([w for w, _ in got], pa.int64()),
                 pa.array([n for _, n in got], pa.int64())], schema=schema)
    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, n_pretokens, n_tokens``.

    NULL and empty texts have no tokens.  NULL and repeated ids are rows like
    others; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_chars", "n_pretokens", "n_tokens")])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return on_workers(rows).mapInArrow(_counts(vocabulary or default_vocabulary(), schema),
                                       "doc_id long, n_chars long, n_pretokens long, n_tokens long")
