"""Token ids of whole texts by the tokenizers library, through a bounded cache of words.

Byte-level BPE cuts a text by a fixed pattern before it merges, and a blank
before a word always starts a new cut unless white space follows the blank. So
the ids of a text are those of its parts at single blanks. Texts that do not
hold this (a blank before white space, or an added token such as the end mark)
go to the library whole.
"""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

PATH = "byte_bpe_50k.json"
#: Marks that make one cut of their own after letters, whatever their number and mix.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def public_path(name: str = PATH) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: printable Latin-1 stays, others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """encode(text) -> little-endian ids of the whole text as bytes.

    limit: words in either generation of the cache; ids do not depend on it.
    """

    def __init__(self, path: str | None = None, dtype: str = "<u4", limit: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_path())
        # strings that the vocabulary adds beside its merges cut a text anywhere: such texts go to the library whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if sys.byteorder != "little":
            raise RuntimeError("ids are written in native order, which has to be little-endian")
        self.dtype = dtype
        self.size = self.tokenizer.get_vocab_size()
        letters = _byte_letters()
        self._letters = {b: x for b, x in enumerate(letters)}
        model = self.tokenizer.model

        code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        tails: dict[str, bytes] = {"": b""}

        def merge(part: str) -> bytes:
            if not part.isascii():
                part = part.encode("utf-8", "surrogatepass").decode("latin-1")
            return array(code, [t.id for t in model.tokenize(part.translate(self._letters))]).tobytes()

        def tail_ids(tail: str) -> bytes:
            if len(tails) > 10_000:
                tails.clear()
            found = tails[tail] = merge(tail)
            return found

        class Words(dict):
            """Ids by word. Full, it becomes the old generation, whose words come back as they are met."""

            old: dict[str, bytes | None] = {}

            def __missing__(words, word):
                if (ids := words.old.get(word, 0)) == 0:
                    core = word.rstrip(MARKS)
                    if core.isalpha():
                        tail = word[len(core) :]
                        ids = merge(" " + core) + ((tails.get(tail) or tail_ids(tail)) if tail else b"")
                    elif not word or word[0].isspace():
                        ids = None  # joining fails, and the text is encoded whole
                    else:
                        ids = array(code, self.tokenizer.encode(" " + word, add_special_tokens=False).ids).tobytes()
                if len(words) >= limit:
                    words.old = dict(words)
                    words.clear()
                if len(word) <= 100:
                    words[word] = ids
                return ids

        self._words = Words()
        self._get = self._words.__getitem__

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.whole(text)
        parts = text.split(" ")
        first = parts[0]
        try:
            rest = b"".join(map(self._get, parts[1:]))
        except TypeError:
            return self.whole(text)
        return (self.whole(first) if first else b"") + rest


_open: dict[tuple[str | None, str], Encoder] = {}


def encoder(path: str | None = None, dtype: str = "<u4") -> Encoder:
    """The Encoder of this Python worker: its words and the vocabulary serve all tasks that the worker runs."""
    if (path, dtype) not in _open:
        _open.clear()  # one at a time, so that a worker holds one cache
        _open[path, dtype] = Encoder(path, dtype)
    return _open[path, dtype]
