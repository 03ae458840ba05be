"""Token ids of texts by the public word BPE, one memo lookup per word.

The tokenizer's own steps never look across white space: its normalizer maps runs of it to one
space, its pattern matches none, and merges stay inside a match.  So a text's ids are those of
its white-space separated words in order, and a bounded memo of words replaces most of the work.
"""

from __future__ import annotations

import re
import sys

import numpy as np

#: Bytes that the words remembered in each Python worker take; beyond it the memo starts anew.
MEMO_BYTES = 32 << 20
#: Bytes of a dict entry beside its key and value.
_ENTRY = 104
#: Fixed: white space of the normalizer's pattern, which str.split() covers except for these four, which it adds.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Fixed: ASCII marks that the pattern keeps apart from letters and digits; the apostrophe starts matches of its own.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    @staticmethod
    def of(path: str) -> WordEncoder:
        """The encoder of this process; its memo lives as long as the worker."""
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if "<|" not in word and core != word and core.isalnum():
            # letters or digits before marks: the pattern always parts them there
            out = self[core] + self[word[len(core):]]
        else:
            out = np.array(self._ids(word), "<u4").tobytes()
        size = sys.getsizeof(word) + sys.getsizeof(out) + _ENTRY
        if self.held + size > MEMO_BYTES:
            self.clear()
            self.held = 0
        self.held += size
        self[word] = out
        return out

    def _ids(self, word: str) -> list[int]:
        if word.isalpha() and word.islower() and not word.isascii() and max(word) < "\u0100":
            word = word.encode().decode("latin-1").translate(self.letters)
        elif not (word.isascii() and word.isalpha() and word.islower()):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(word)]  # one match of letters, nothing to normalize

    def words(self, text: str) -> list[str]:
        """The text's words, lower-cased where that cannot change their ids.

        In Latin-1 a letter's lower case is one letter and nothing composes; a special token's
        marker keeps its case.
        """
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return _WORD.findall(text) if any(c in text for c in _NOT_SPACE) else text.split()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text)))
