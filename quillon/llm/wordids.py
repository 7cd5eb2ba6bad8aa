"""Fast exact encoding with a word-level BPE file of the ``tokenizers`` library.

Pre-tokens never cross ASCII white space, so a text's ids are those of its words in a row.  A batch of texts is split
and its distinct words are found in Arrow; their ids are cached, only new words reach the library, and Arrow
lays the ids out again.  Plain words (printable ASCII and Latin-1, which the file's normaliser only lower-cases) go
straight to its BPE model; any other word, and any text with a special token's string, takes the library's whole path.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-tokeniser's pattern and the printable characters that its normaliser leaves alone but for case (fixed values).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[!-~¡-ÿ]+")
#: Words of a cache generation: beyond, the younger one becomes the older one, whose words come back as they are met again.
CACHE = 300_000


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = byte_alphabet()
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        mapped = p if p.isascii() else "".join([self.letters[c] for c in p.encode()])  # printable ASCII stands for itself
        ids = self.pieces[p] = array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids

    def word(self, text: str) -> bytes:
        """Ids of one word as little-endian 16-bit integers."""
        if not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        text, known = text.lower(), self.pieces
        if text.isalpha():  # what the pattern finds here, without running it
            return known.get(text) or self.piece(text)
        parts = [text[:-1], text[-1]] if text[:-1].isalpha() else PIECES.findall(text)
        return b"".join([known.get(p) or self.piece(p) for p in parts])

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache or anew."""
        known, older, pieces, tokenize = self.words, self.older, self.pieces, self.model.tokenize
        out = list(map(known.get, words))
        for w in [w for w, x in zip(words, out, strict=True) if x is None]:
            x = older.get(w)
            if x is None:
                if w.isalpha() and w.isascii():  # most words: the steps of word() in place
                    low = w.lower()
                    x = pieces.get(low)
                    if x is None:
                        x = pieces[low] = array("H", [t.id for t in tokenize(low)]).tobytes()
                else:
                    x = self.word(w)
            known[w] = x
        out = list(map(known.__getitem__, words))
        if len(known) > CACHE:
            self.words, self.older = {"": b""}, known
            self.pieces = {}
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text (null: none) as little-endian 16-bit integers."""
        texts = texts.fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.values.dictionary_encode()
        laid = pa.array(self.ids_of(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        at = np.frombuffer(laid.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist() if len(laid) else [0] * (len(texts) + 1)
        data = memoryview(laid.buffers()[2] or b"")
        out = [data[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)]
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u2").tobytes()
        return out


_coders: dict[str, Words] = {}


def coder(path: str) -> Words:
    """The coder of a file, loaded once per Python worker; it depends on nothing but the file."""
    if path not in _coders:
        _coders[path] = Words(path)
    return _coders[path]
