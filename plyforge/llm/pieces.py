"""SentencePiece encoding and decoding with N-best segmentation.

A text, normalised by the model, is a lattice of vocabulary pieces; a segmentation's score is
the sum of its pieces' scores. Forward Viterbi scores are the exact best completion of every
suffix, so an A-star search from the end backwards with them as heuristic yields
segmentations strictly from the best on.

No piece of the vocabularies at hand goes on over a word boundary (a space mark after another
character), so the lattice falls apart at those. The forward pass runs over all new words of a
batch at once, as arrays, and gives each word's best path and the distance to its second
best. Only the n - 1 words with the smallest distances can differ from their best in the n
best segmentations of a text, so the backward search runs for those alone. For a vocabulary
with pieces across boundaries the text is one word.

Order: larger score first; of equal scores, in a word, the one whose ids, compared from the
last, are smaller; in a text, the one whose words, compared from the last, take better ranks.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plyforge.llm.common import table

MODEL = "piece_bpe_32k.model"
N_BEST = 3
MARK = "▁"
#: Below the worst piece; what a character costs that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Longer words go through the forward pass one by one.
_ARRAY_LENGTH = 40
#: Words in each of the two generations that a worker remembers.
_REMEMBERED = 250_000
#: Rows whose words are learnt at once.
_ROWS = 2000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.int32(-1)
_SEEN_SHIFT = np.uint64(42)


class PieceModel:
    """The vocabulary of a SentencePiece model file and searches over its lattice."""

    def __init__(self, model_file: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m = self._model
        size = m.vocab_size()
        self.ids: dict[str, int] = {}
        self.scores = np.zeros(size)
        self._bytes = [-1] * 256
        self._raw: list[bytes] = []
        for i in range(size):
            piece = m.id_to_piece(i)
            self.scores[i] = m.get_score(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                self._bytes[value] = i
                self._raw.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self._raw.append(b"")
            else:
                self.ids[piece] = i
                self._raw.append(piece.replace(MARK, " ").encode())
        self._unk = m.unk_id()
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        crosses = any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.ids)
        self._words = re.compile(r".+", re.S) if crosses else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        keys = [self._key(piece) for piece in self.ids]
        order = np.argsort(np.array(keys, dtype=np.uint64))
        self._keys = np.array(keys, dtype=np.uint64)[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self._key_ids = np.array(list(self.ids.values()), dtype=np.int32)[order]
        self._seen = np.zeros(1 << 22, dtype=bool)
        self._seen[self._keys >> _SEEN_SHIFT] = True
        self._known: dict[str, tuple[bytes, float, float]] = {}
        self._older: dict[str, tuple[bytes, float, float]] = {}
        self._ranked: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_BASE) & (1 << 64) - 1
        return h

    def words(self, text: str) -> list[str]:
        """The normalised text cut where no piece goes on."""
        return self._words.findall(self._model.normalize(text)) if text else []

    def _emitted(self, piece: str, i: int) -> tuple[int, ...]:
        """The ids that an edge of the lattice stands for: its own, or bytes for an unknown character."""
        if i >= 0:
            return (i,)
        return tuple(self._unk if self._bytes[b] < 0 else self._bytes[b] for b in piece.encode("utf-8", "surrogatepass"))

    def _edges(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each position, the edges that end there: start, id or -1 for an unknown character, score."""
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(word) + 1)]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                if (i := self.ids.get(word[start:end])) is not None:
                    into[end].append((start, i, float(self.scores[i])))
            if word[end - 1] not in self.ids:
                into[end].append((end - 1, -1, self.unknown_score))
        return into

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one lattice, (score, ids), by backward A-star search."""
        into = self._edges(word)
        forward = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            forward[end] = max(forward[start] + score for start, _, score in into[end])
        agenda = [(-forward[-1], (), len(word), 0.0, ())]
        found = []
        while agenda and len(found) < n:
            _, path, at, behind, emitted = heapq.heappop(agenda)
            if at == 0:
                found.append((behind, tuple(reversed(emitted))))
                continue
            for start, i, score in into[at]:
                own = self._emitted(word[start:at], i)
                total = behind + score
                heapq.heappush(agenda, (-(total + forward[start]), (*path, i), start, total, (*emitted, *reversed(own))))
        return found

    def _forward(self, words: list[str]) -> Iterator[tuple[bytes, float, float]]:
        """For each of several words of one length: its best path's ids, score, and the distance to the second best."""
        n, m = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(m, n).astype(np.uint64)
        best = np.full((n + 1, m), -np.inf)
        second = np.full((n + 1, m), -np.inf)
        back, back_id = np.zeros((n + 1, m), dtype=np.int32), np.zeros((n + 1, m), dtype=np.int32)
        best[0] = 0
        hashes = np.zeros((n, m), dtype=np.uint64)  # of the substrings of one length, by start
        found, worth, some = {}, {}, {}
        for length in range(1, min(n, self.longest) + 1):
            starts = n - length + 1
            hashes[:starts] = (hashes[:starts] + codes.T[length - 1 :] + np.uint64(1)) * _BASE
            flat = hashes[:starts].reshape(-1)
            i = np.full(len(flat), _NONE, dtype=np.int32)
            maybe = np.flatnonzero(self._seen[flat >> _SEEN_SHIFT])
            keys = flat[maybe]
            at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            i[maybe] = np.where(self._keys[at] == keys, self._key_ids[at], _NONE)
            i = i.reshape(starts, m)
            score = np.where(i >= 0, self.scores[i], self.unknown_score if length == 1 else -np.inf)
            found[length], worth[length] = i, score
            some[length] = np.ones(starts, dtype=bool) if length == 1 else (i >= 0).any(axis=1)
        for end in range(1, n + 1):
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                if not some[length][start]:
                    continue
                score, i = worth[length][start], found[length][start]
                one, two = best[start] + score, second[start] + score
                ahead = (one > best[end]) | ((one == best[end]) & (i < back_id[end]) & (one > -np.inf))
                second[end] = np.maximum(np.maximum(second[end], two), np.where(ahead, best[end], one))
                best[end] = np.where(ahead, one, best[end])
                back[end] = np.where(ahead, length, back[end])
                back_id[end] = np.where(ahead, i, back_id[end])
        # All best paths are followed at once, from the end; ids fill each row from the right.
        every, at, left = np.arange(m), np.full(m, n), np.full(m, n)
        ids = np.zeros((m, n), dtype="<u4")
        unknown = np.zeros(m, dtype=bool)
        live = every
        while len(live):
            here = at[live]
            i = back_id[here, live]
            left[live] -= 1
            ids[live, left[live]] = i.astype(np.uint32)
            unknown[live] |= i < 0
            at[live] = here - back[here, live]
            live = live[at[live] > 0]
        flat, starts = ids.tobytes(), ((every * n + left) * 4).tolist()
        bodies = [flat[start : end * n * 4] for end, start in enumerate(starts, 1)]
        for k in np.flatnonzero(unknown).tolist():
            path, end = [], n
            while end:
                start = end - int(back[end, k])
                path[:0] = self._emitted(words[k][start:end], int(back_id[end, k]))
                end = start
            bodies[k] = struct.pack(f"<{len(path)}I", *path)
        return zip(bodies, best[n].tolist(), (best[n] - second[n]).tolist(), strict=True)

    def learn(self, words: set[str]) -> None:
        """Run the forward pass for the words that are not remembered."""
        if len(self._known) > _REMEMBERED:
            self._older, self._known = self._known, {}
            self._ranked.clear()
        known, older = self._known, self._older
        groups: dict[int, list[str]] = {}
        for word in words:
            if word not in known:
                if word in older:
                    known[word] = older[word]
                else:
                    groups.setdefault(len(word), []).append(word)
        for n, group in groups.items():
            if n > _ARRAY_LENGTH or len(group) < 4:
                for word in group:
                    top = self.n_best(word, 2)
                    gap = top[0][0] - top[1][0] if len(top) > 1 else np.inf
                    known[word] = np.array(top[0][1], dtype="<u4").tobytes(), top[0][0], gap
                continue
            known.update(zip(group, self._forward(group), strict=True))

    def _alternatives(self, word: str, n: int) -> list[tuple[float, bytes]]:
        if (word, n) not in self._ranked:
            self._ranked[word, n] = [(score, np.array(ids, dtype="<u4").tobytes()) for score, ids in self.n_best(word, n)]
        return self._ranked[word, n]

    def encode(self, words: list[str], n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text's words, all learnt: (score, ids as 32-bit little-endian)."""
        if not words:
            return [(0.0, b"")]
        known = self._known
        parts, scores, gaps = zip(*[known[word] for word in words], strict=True)
        score = sum(scores)
        out = [(score, b"".join(parts))]
        if n == 1:
            return out
        gaps = np.array(gaps)
        few = min(n - 1, len(gaps))
        limit = np.partition(gaps, few - 1)[few - 1]
        near = np.flatnonzero(gaps <= limit)
        near = near[np.lexsort((near, gaps[near]))][:few]
        near = sorted((int(i) for i in near if np.isfinite(gaps[i])), reverse=True)  # from the last word
        ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for i in near:
            ranks = self._alternatives(words[i], n)
            ways = sorted((lost + ranks[0][0] - s, (*way, r)) for lost, way in ways for r, (s, _) in enumerate(ranks))[:n]
        for lost, way in ways[1:]:
            own = list(parts)
            for i, r in zip(near, way, strict=True):
                own[i] = self._alternatives(words[i], n)[r][1]
            out.append((score - lost, b"".join(own)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that normalisation puts before it is taken off, broken bytes become U+FFFD."""
        return self._body(ids).decode("utf-8", "replace")

    def _body(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._raw.__getitem__, ids.tolist()))[1:]

    def gives(self, ids: bytes, text: str) -> bool:
        """Whether ids decode to the text; a space mark in it counts as a blank."""
        return self._body(np.frombuffer(ids, dtype="<u4")) == text.replace(MARK, " ").encode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def load(model: str) -> PieceModel:
    """The model of the public file of that name, once a worker."""
    import public_tokenizers

    return PieceModel(public_tokenizers.path(model))


_SCHEMA = "doc_id long, rank int, score double, ids array<int>, text string"


def encode_texts(documents: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id, rank (from 0), score, ids, and text decoded from the ids, for each of a text's n best segmentations.

    A text has fewer rows if it has fewer segmentations; null and empty texts have one of no
    ids with score 0. Texts are segmented whole. Repeated rows are encoded each.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for doc_ids, texts in _encoded(batches, m, n):
            rows = []
            for doc_id, (_, ways) in zip(doc_ids, texts, strict=True):
                for rank, (score, ids) in enumerate(ways):
                    own = np.frombuffer(ids, dtype="<u4")
                    rows.append((doc_id, rank, score, own.astype(np.int32), m.decode(own)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "rank", "score", "ids", "text"])

    return documents.select("doc_id", "text").mapInArrow(made, _SCHEMA)


def _encoded(batches: Iterator[pa.RecordBatch], m: PieceModel, n: int):
    """(doc_ids, [(text, segmentations)]) of _ROWS rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            texts = [text or "" for text in part.column("text").to_pylist()]
            worded = [m.words(text) for text in texts]
            m.learn(set().union(*worded))
            yield part.column("doc_id").to_pylist(), [(t, m.encode(w, n)) for t, w in zip(texts, worded, strict=True)]


def digests(documents: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """For each row: doc_id, n_pieces and ids_crc32 of the best segmentation, all scores and checksums, and round_trip.

    round_trip says that every segmentation decodes to the text; a space mark in the text
    itself decodes to a blank and counts as one.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for doc_ids, texts in _encoded(batches, m, n):
            whole = [all(m.gives(ids, text) for _, ids in ways) for text, ways in texts]
            sums = [[zlib.crc32(ids) for _, ids in ways] for _, ways in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([len(ways[0][1]) // 4 for _, ways in texts], pa.int64()),
                    pa.array([s[0] for s in sums], pa.int64()),
                    pa.array([[score for score, _ in ways] for _, ways in texts], pa.list_(pa.float64())),
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(whole, pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "scores", "crc32s", "round_trip"],
            )

    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, crc32s array<long>, round_trip boolean"
    return documents.select("doc_id", "text").mapInArrow(made, schema)


NAME = "op3_pieces"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
