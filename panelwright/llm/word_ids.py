"""Token ids of texts by a word-level vocabulary, with words encoded once.

The vocabulary's tokenizer lower-cases, drops white space and cuts the rest
into runs of letters, single digits and runs of signs, each encoded on its
own.  A text's ids are therefore its words' ids in a row, and a word's ids
those of its runs.  Words and runs met before come from tables of bounded
size.  Words of Latin letters are cut by the tokenizer file's own pattern and
their runs go straight to its model; other words take the whole tokenizer.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex

MAX_WORDS, LONG_WORD = 600_000, 64
# separators that str.split() knows but the tokenizer takes for characters
_ODD = "\x1c\x1d\x1e\x1f"
# below this character, composed form is the only form
_LATIN_END = "ɐ"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the
    next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class _Table(dict):
    """Word → ids as bytes; computes what is missing, remembers short words,
    starts anew when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        ids = self.encode(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """Encoder for one vocabulary file; ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.words, self.runs = _Table(self._word), _Table(self._run)
        self.pattern = self._pattern()

    def _pattern(self):
        """The cutting pattern, if the file cuts words as described above."""
        parts = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        cut = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"]:
            return regex.compile(cut[0]["pattern"]["Regex"])
        return None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if not (run.isascii() and run.isprintable()):
            run = "".join([self.letters[b] for b in run.encode("utf-8")])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(run)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.pattern is None or "<|" in word or not (word.isascii() or max(word) < _LATIN_END):
            return self._whole(word)
        return b"".join(map(self.runs.__getitem__, self.pattern.findall(word.lower())))

    def encode(self, texts: list[str]) -> list[bytes]:
        find = self.words.__getitem__
        return [self._whole(t) if any([c in t for c in _ODD]) else b"".join(map(find, t.split())) for t in texts]
