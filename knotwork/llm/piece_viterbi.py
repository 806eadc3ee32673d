"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is normalised as the model says and cut into words, each with the spaces before it; no piece reaches across such a
cut (this is checked when a model is loaded). Distinct words of equal length advance together: hashes of all their
substrings probe the sorted keys of the pieces, and at each end position a vectorised maximum over the last piece's
length stores score and backpointer. Words are remembered in a cache of bounded size.

What a path maximises depends on the model's type, which the caller names.

* ``unigram``: the sum of piece scores; of equal paths, the one whose last piece is longest, at every position. A character
  that no piece covers costs ten more than the worst piece.
* ``bpe``: whether each two neighbouring pieces stand when the merges are applied to both of them alone. Exactly one path has
  only such neighbours, and it is what merging the whole word gives; so at each end position one last piece is
  admissible after the piece stored at its start. Which pairs stand follows from undoing their merges, latest
  first, and asking whether a merge across their border would have come before. Answers are cached by pair. Words after two or more
  spaces have pieces of equal rank; they are left to the library's own merging.

With byte fallback a character without a piece becomes its bytes' pieces, else the unknown piece.

Cases. Null or empty text: no ids, decoded as empty. Characters that the model maps to a space (and the space mark itself)
decode as spaces. Very long words are batches of their own. Repeated rows get equal ids. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames, mix64

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Cells (words x positions x lengths) scored at once, and words kept.
CELLS, CACHED = 1 << 21, 400_000
#: Bytes and rows of texts whose words are searched together; more words of a length share the steps.
TOGETHER, TOGETHER_ROWS = 6 << 20, 4_000
#: Characters of the longest word that is remembered; the cache is bounded in bytes, too.
REMEMBERED = 64


def model_path() -> str:
    return public_tokenizers.path(MODEL)


class Merges:
    """Which pairs of pieces stand next to each other after all merges of a BPE model.

    A piece's rank is its place in the order of merges, -1 for a single character. ``halves`` are the two pieces that its last
    merge joins; a piece that merging its own characters doesn't give can't occur and has none.
    """

    def __init__(self, texts: dict[int, str], scores: dict[int, float], slots: int = 1 << 21):
        ids = {t: i for i, t in texts.items()}
        merged = sorted((i for i, t in texts.items() if len(t) > 1), key=lambda i: (-scores[i], i))
        n = max(texts) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank[merged] = np.arange(len(merged))
        rank_of = {texts[i]: k for k, i in enumerate(merged)}
        self.occurs = np.zeros(n, bool)
        pairs = []
        for i, t in texts.items():
            parts = self._merge(t, rank_of) if len(t) > 1 else None
            self.occurs[i] = len(t) == 1 or parts is not None
            if parts:
                self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
            pairs += [(ids[t[:c]] << 32 | ids[t[c:]], rank_of[t]) for c in range(1, len(t)) if t[:c] in ids and t[c:] in ids]
        pairs.sort()
        self.pair_keys, self.pair_ranks = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        self.asked, self.answers = np.full(slots, -1, np.int64), np.zeros(slots, bool)

    @staticmethod
    def _merge(text: str, rank_of: dict[str, int]) -> tuple[str, str] | None:
        """The two symbols whose merge completes ``text``; None if merging ends otherwise."""
        symbols = list(text)
        while len(symbols) > 1:
            found = [(rank_of[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in rank_of]
            if not found:
                return None
            _, k = min(found)
            if len(symbols) == 2:
                return symbols[0], symbols[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return None

    def _rank_across(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the merge of two symbols; very large if there is none."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 40)

    def _resolve(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        stands, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), 1 << 39), np.full(len(a), 1 << 39)
        while len(live):
            across = self._rank_across(x, y)
            crossed = (across < until_x) & (across <= until_y)
            stands[live[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y, until_x, until_y = live[go], x[go], y[go], until_x[go], until_y[go]
            later_x = self.rank[x] > self.rank[y]
            until_x, until_y = np.where(later_x, self.rank[x], until_x), np.where(later_x, until_y, self.rank[y])
            x, y = np.where(later_x, self.right[x], x), np.where(later_x, y, self.left[y])
        return stands

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces (a, b) stays apart; from the cache where it was asked before."""
        key = a.astype(np.int64) << 32 | b
        slot = (mix64(key.view(np.uint64)) % _U(len(self.asked))).astype(np.int64)
        known = self.asked[slot] == key
        out = self.answers[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            answer = self._resolve(new >> 32, new & 0xFFFFFFFF)
            out[~known] = answer[back]
            at = (mix64(new.view(np.uint64)) % _U(len(self.asked))).astype(np.int64)
            self.asked[at], self.answers[at] = new, answer
            lost = self.asked[at] != new  # two new pairs of one slot: the answer must be the stored pair's
            if lost.any():
                order = {int(k): bool(v) for k, v in zip(new, answer, strict=True)}
                self.answers[at[lost]] = [order[int(k)] for k in self.asked[at[lost]]]
        return out


class Pieces:
    """The pieces of a model, sorted by the hash of their characters, and the search over them."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        if kind not in ("bpe", "unigram"):
            raise ValueError("kind must be bpe or unigram")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.processor, self.processor.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in texts[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece of this model holds a space after another character")
        self.merges = Merges({i: texts[i] for i in plain}, {i: sp.get_score(i) for i in plain}) if kind == "bpe" else None
        if self.merges:
            plain = [i for i in plain if self.merges.occurs[i]]
        self.sizes = np.array([len(t) for t in texts])
        self.longest = max(len(texts[i]) for i in plain)
        keys = np.array([self._key(texts[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int32)[order]
        self.scores = np.array([sp.get_score(i) for i in plain])[order]
        self.unknown_score = self.scores.min() - 10.0
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> _U(44)).astype(np.int64)] = True
        bytes_of = {i: int(texts[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in bytes_of.items()}
        self.shown = [b"" if sp.is_control(i) else bytes([bytes_of[i]]) if i in bytes_of else " ⁇ ".encode() if sp.is_unknown(i) else texts[i].replace(SPACE, " ").encode() for i in range(n)]
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _key(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _P + _U(ord(c) + 1)
        return int(mix64(h + _U(len(piece)))[0])

    def _probe(self, key: np.ndarray) -> np.ndarray:
        """Where each key is among the sorted keys; -1 where no piece has it."""
        place = np.full(key.shape, -1, np.int32)
        likely = np.nonzero(self.maybe[(key >> _U(44)).astype(np.int64)])
        wanted = key[likely]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        place[tuple(x[hit] for x in likely)] = at[hit]
        return place

    def _values(self, place: np.ndarray, end: int, sizes: range, best: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The worth (sizes x words) of ending at ``end`` with the piece of each size, placed in ``place``; -inf if it can't be."""
        if not self.merges:
            own = np.where(place >= 0, self.scores[place], -np.inf)
            if sizes[-1] == 1:
                own[-1][place[-1] < 0] = self.unknown_score
            return own + best[end - np.array(sizes)]
        before = piece[end - np.array(sizes)]
        fits = best[end - np.array(sizes)] == 0
        size, word = np.nonzero(fits & (place >= 0) & (before >= 0))
        fits[size, word] = self.merges.stand(before[size, word], self.ids[place[size, word]])
        fits &= place >= 0
        if sizes[-1] == 1:
            fits[-1] |= (place[-1] < 0) & (best[end - 1] == 0)
        return np.where(fits, 0.0, -np.inf)

    def search(self, words: list[str]) -> list[list[int]]:
        """The piece ids of words of one length; -1 for a character without a piece."""
        k, n = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(k, n).astype(np.uint64) + _U(1)
        most = min(n, self.longest)
        places, h = [], np.zeros((k, n), np.uint64)
        for size in range(1, most + 1):
            h = h[:, : n - size + 1] * _P + chars[:, size - 1 :]
            places.append(self._probe(mix64(h + _U(size))))
        best, back, piece = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k), np.int64), np.full((n + 1, k), -1, np.int32)
        best[0] = 0
        rows = np.arange(k)
        for end in range(1, n + 1):
            sizes = range(min(end, most), 0, -1)
            place = np.stack([places[size - 1][:, end - size] for size in sizes])
            options = self._values(place, end, sizes, best, piece)
            pick = options.argmax(axis=0)
            best[end], back[end] = options[pick, rows], sizes[0] - pick
            chosen = place[pick, rows]
            piece[end] = np.where(chosen >= 0, self.ids[chosen], -1)
        found: list[list[int]] = [[] for _ in words]
        at, live = np.full(k, n), rows
        while len(live):
            for row, one in zip(live.tolist(), piece[at[live], live].tolist(), strict=True):
                found[row].append(one)
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        return [x[::-1] for x in found]

    def _expand(self, word: str, ids: list[int]) -> list[int]:
        """Unknown characters as bytes' pieces, or one unknown piece a run."""
        if -1 not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            size = 1 if i < 0 else int(self.sizes[i])
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in word[at].encode("utf-8", "replace")]
            elif not out or out[-1] != self.processor.unk_id():
                out.append(self.processor.unk_id())
            at += size
        return out

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            if self.merges and w.startswith(SPACE * 2):
                self.cache[w] = np.array(self.processor.encode(w[1:].replace(SPACE, " ")), "<u4").tobytes()
            else:
                by_length[len(w)].append(w)
        for n, own in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest)))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                for w, ids in zip(part, self.search(part), strict=True):
                    self.cache[w] = np.array(self._expand(w, ids), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        split = [_WORDS.findall(t) for t in self.processor.normalize(texts)]
        needed = set().union(*split)
        if len(self.cache) > CACHED:
            self.cache = {w: self.cache[w] for w in needed if w in self.cache}
        self.learn(needed - self.cache.keys())
        out = [b"".join([self.cache[w] for w in words]) for words in split]
        for w in needed:
            if len(w) > REMEMBERED:
                del self.cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that normalising put in front is taken off."""
        return b"".join([self.shown[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def pieces(path: str, kind: str = "bpe") -> Pieces:
    return Pieces(path, kind)


def _each(df: DataFrame, id_col: str, column: str, made: str, kind: str, step: object) -> DataFrame:
    """(doc_id, made) with ``step`` applied to lists of values of a column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["doc_id"]].assign(**{made: step(pdf["x"].tolist())})

    id_type = df.schema[id_col].dataType.simpleString()
    return map_frames(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{column}`").alias("x")), run, f"doc_id {id_type}, {made} {kind}", "x", TOGETHER, TOGETHER_ROWS)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids): the piece ids of each text as little-endian uint32 bytes."""
    path = path or model_path()
    return _each(docs, id_col, text_col, "ids", "binary", lambda texts: pieces(path, kind).encode([t or "" for t in texts]))


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of piece ids."""
    path = path or model_path()
    return _each(coded, id_col, ids_col, "text", "string", lambda rows: [pieces(path).decode(r or b"") for r in rows])


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kind: str = "bpe") -> DataFrame:
    """Per text: how many pieces and byte pieces, the ids' checksum, the decoded text's digest, and whether it is the text."""
    path = path or model_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(path, kind)
        in_bytes = np.isin(np.arange(own.processor.get_piece_size()), list(own.byte_ids.values()))
        for pdf in frames:
            texts = [t or "" for t in pdf["text"]]
            coded = own.encode(texts)
            back = [own.decode(c) for c in coded]
            yield pdf[["doc_id"]].assign(
                n_pieces=[len(c) // 4 for c in coded], n_byte_pieces=[int(in_bytes[np.frombuffer(c, "<u4")].sum()) for c in coded], ids_crc32=[zlib.crc32(c) for c in coded],
                decoded_sha256=[hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back], round_trip=[b == t for b, t in zip(back, texts, strict=True)],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_frames(slim, run, f"doc_id {id_type}, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean", "text", TOGETHER, TOGETHER_ROWS)
