"""Token ids of whole texts with a public word-level BPE, and the cache of chunk ids behind it."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import public_tokenizers

WORD_BPE = "word_bpe_49k.json"


def word_bpe_path() -> str:
    return public_tokenizers.path(WORD_BPE)


#: A line of a word of Latin letters whose composed form is normal, and a run of ASCII punctuation without apostrophes; or any other line.
_PLAIN = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)|.*)$", re.M)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkIds(dict):
    """Ids (little-endian uint32 bytes) by chunk of text between ASCII white space.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its
    chunks in turn; each distinct chunk is encoded once. A chunk that is a plain word and punctuation is split as
    the tokenizer would split it, and its lower-case word and its punctuation go straight to the merge model; any other
    chunk takes the tokenizer's whole way. There are two generations: when this one has grown to ``most`` chunks it
    becomes the older one, from which chunks that still occur come back.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[str, bytes] = {"": b""}
        self.bytes = byte_characters()

    def _merged(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return ids

    def learn(self, chunks: set[bytes]) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        if len(self.words) > self.most:
            self.words = {"": b""}
        missing = chunks - self.keys()
        known = missing & self.older.keys()
        self.update((c, self.older[c]) for c in known)
        other, words, merged, new = [], self.words, self._merged, list(missing - known)
        # one pass over all new chunks, a line each
        lines = _PLAIN.findall(b"\n".join(new).decode("utf-8", "replace")) if new else []
        for c, (word, marks) in zip(new, lines, strict=True):
            if word:
                word = word.lower()
                ids = words.get(word) or merged(word)
                self[c] = ids + (words.get(marks) or merged(marks)) if marks else ids
            else:
                other.append(c)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            made = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
            self.update((c, array("I", e.ids).tobytes()) for c, e in zip(part, made, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        split = [t.encode("utf-8", "replace").split() for t in texts]
        self.learn(set().union(*split))
        ids = self.__getitem__
        return [b"".join(map(ids, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)
