"""Token ids of whole texts, by a public tokenizer with caches of words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Bytes each of the two caches may take in a worker, and what an entry takes besides its
#: letters and ids; a full cache starts anew, and a task that ends leaves none behind.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Where these occur, normalisation or splitting may reach beyond a word.
_SPECIAL = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-˿]|<\\|(?:start|end)oftext\\|>")


def _of_kind(kind: str) -> str:
    """A regular-expression class of the plain characters of one Unicode category."""
    return "".join(re.escape(c) for c in map(chr, range(0x300))
                   if unicodedata.category(c)[0] == kind)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters
    from U+0100 on, in order."""
    plain = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    table = {b: chr(b) for b in plain}
    return table | {b: chr(0x100 + i) for i, b in enumerate(
        b for b in range(256) if b not in table)}


class WordTokenizer:
    """Ids as little-endian 32-bit numbers, the same as the tokenizer's for the whole text.

    The tokenizer never looks beyond white space, so words are encoded on their own, and
    within a word the runs its pattern splits off. Texts with characters whose
    normalisation could cross these bounds go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.forget()
        letters, numbers = _of_kind("L"), _of_kind("N")
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]"
                                  f"|[^\\s{letters}{numbers}]+")
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def forget(self) -> None:
        """Empty the caches."""
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.word_bytes = self.run_bytes = 0

    def encode_whole(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1")
        spelled = run.translate(self.alphabet) if not run.isalnum() or (
            not run.isascii()) else run
        return b"".join([t.id.to_bytes(4, "little") for t in self.whole.model.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        runs, out = self.runs, []
        for run in self.pattern.findall(word):
            ids = runs.get(run)
            if ids is None:
                if self.run_bytes > CACHE_BYTES:
                    runs.clear()
                    self.run_bytes = 0
                ids = runs[run] = self._run(run)
                self.run_bytes += ENTRY_BYTES + len(run) + len(ids)
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if _SPECIAL.search(text):
            return self.encode_whole(text)
        words, found = self.words, text.lower().split()
        try:
            return b"".join([words[w] for w in found])
        except KeyError:
            pass
        if self.word_bytes > CACHE_BYTES:
            words.clear()
            self.word_bytes = 0
        for w in set(found).difference(words):
            # A word of letters alone is one run.
            ids = words[w] = self._run(w) if w.isalpha() else self._word(w)
            self.word_bytes += ENTRY_BYTES + len(w) + len(ids)
        return b"".join([words[w] for w in found])


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    return WordTokenizer(path)
