"""Token ids of whole texts by the tokenizers library, with the ids of words that come again kept.

The byte-level vocabulary first cuts a text into pieces and then merges bytes within each piece. A
single space between two visible characters always begins a piece, and so does a line feed between
two visible characters; the ids of a text are therefore the ids of its words in a row. Words that
were seen before are looked up; new ones go to the library, as a whole or, if they are letters, to
its merge model.
"""

import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Words kept at most. Of a full table the older half goes, but for what was used since.
KEPT_WORDS = 900_000

BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
CLOSING = ".,!?;:"
#: Letters below this character have been letters in every version of Unicode in use.
STABLE = "\u0530"


class _Edge(Exception):
    """A word that isn't bounded by visible characters."""


class Encoder(dict):
    """`encoder.ids(text)`: the text's token ids as little-endian bytes, `width` bytes an id.

    The entries are word -> ids of a space and the word.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True    # a special token's name is ordinary text
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.type = np.dtype("<u2" if self.code == "H" else "<u4")
        self.width = self.type.itemsize
        self.model, self.closing, self.older = self.tokenizer.model, {"": b""}, {}
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.line_feed = self.by_library("\n")
        # The rule above holds for this kind of vocabulary only.
        cut = self.tokenizer.pre_tokenizer
        self.by_words = isinstance(cut, ByteLevel) and self.tokenizer.normalizer is None \
            and not cut.add_prefix_space and getattr(cut, "use_regex", True)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def by_library(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def by_model(self, piece: str) -> bytes:
        """Ids of what the vocabulary takes as one piece."""
        if not piece.isascii():
            piece = self.level.pre_tokenize_str(piece)[0][0]
        elif piece[0] == " ":
            piece = "\u0120" + piece[1:]        # as the vocabulary writes a space
        return self.packed([t.id for t in self.model.tokenize(piece)])

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        core = word.rstrip(CLOSING)
        if core.isalpha() and (core.isascii() or max(core) < STABLE):
            if len(core) == len(word):
                ids = self.by_model(" " + word)
            else:
                end = word[len(core):]
                if end not in self.closing:
                    self.closing[end] = self.by_model(end)
                ids = self[core] + self.closing[end]
        elif not word or word[0].isspace() or word[-1].isspace():
            raise _Edge
        elif "\n" in word and all(
                x and not x[0].isspace() and not x[-1].isspace() for x in word.split("\n")):
            # Seldom the same again, so it isn't kept.
            lines = word.split("\n")
            return self[lines[0]] + b"".join([self.line_feed + self.first(x) for x in lines[1:]])
        else:
            ids = self.by_library(" " + word)
        if len(word) < 64:
            if len(self) >= KEPT_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def first(self, word: str) -> bytes:
        """Ids of a word that begins a line."""
        core = word.rstrip(CLOSING)
        if core.isalpha() and (core.isascii() or max(core) < STABLE):
            end = word[len(core):]
            if end not in self.closing:
                self.closing[end] = self.by_model(end)
            return self.by_model(core) + self.closing[end]
        return self.by_library(word)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self.by_library(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Edge
            return self.by_library(first) + b"".join(map(self.__getitem__, rest))
        except _Edge:
            first, *rest = BETWEEN_WORDS.split(text)
            return self.by_library(first) + b"".join(
                [self[x] if x.strip() == x else self.by_library(" " + x) for x in rest])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    return Encoder(path)
