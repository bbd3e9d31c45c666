"""Word-by-word use of the tokenizers library, with a bounded memory of words already met."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

#: Words, and pre-tokens of words with capitals or signs, that are remembered, about; longer ones than this aren't.
KEPT_WORDS, KEPT_PARTS, KEPT_LENGTH = 800_000, 200_000, 64
#: Splitting at Unicode's white space also cuts at these, the tokenizer's white space doesn't.
_OTHER_SPACE = "[\x1c-\x1f]"
#: A pre-token always ends between a letter and an ASCII sign, but not always between a sign and a letter.
_SIGN_BEHIND = r"([A-Za-z])([!-/:-@\[-`{-~])"
#: Letters that Unicode neither composes nor lower-cases further, then ASCII signs.
_PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-ɏ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of a character beyond ASCII: a printable
    Latin-1 byte as itself, the others as the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}


class _Kept(dict):
    """Values of a function by word; it starts anew at the limit. Long words aren't kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> bytes:
        value = self.make(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


class WordEncoder:
    """Ids of whole texts as bytes of a little-endian unsigned type.

    For a byte-level tokenizer that lower-cases, cuts at white space and drops it, and cuts between
    letters and signs behind them, so that a text's ids are those of its words one after another. A
    word of plain letters, with ASCII signs after it, is two pre-tokens; the library's model gets
    those directly. All other words, and texts that hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = ("<u2", "H") if small else ("<u4", "I")
        self.packed = [array(self.code, [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.letters = _byte_letters()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_OTHER_SPACE, *special])
        self.words, self.parts = _Kept(self._word, KEPT_WORDS), _Kept(self._part, KEPT_PARTS)

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return self._part(word)
        plain = _PLAIN.fullmatch(word.lower())
        if not plain:
            return self._ids(word)
        letters, signs = plain.groups()
        if letters == word:
            return self._part(word)
        return self.parts[letters] + self.parts[signs] if signs else self.parts[letters]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Every distinct word of the texts is looked up once; NULL is an empty text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
        whole = pa.compute.match_substring_regex(column, self.whole)
        apart = pa.compute.replace_substring_regex(pa.compute.if_else(whole, "", column), _SIGN_BEHIND, r"\1 \2")
        split = pa.compute.utf8_split_whitespace(apart)
        words = split.values.dictionary_encode()
        every = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        lines = pa.compute.binary_join(every, pa.scalar("\n", pa.large_string()))[0].as_py()
        found = list(map(self.words.__getitem__, lines.split("\n")))
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        shift = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        ids = np.frombuffer(b"".join(found), self.dtype)[np.arange(ends[-1]) + np.repeat(shift, n)].tobytes()
        cuts = (ends[split.offsets.to_numpy()] * width).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._ids(column[i].as_py())
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
