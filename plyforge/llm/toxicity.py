"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are built from a bounded sample of labelled texts:
one ends in segments that stand in a larger share of toxic texts than of ordinary ones, words
and stems of any language, the other in segments chosen in the same way from ordinary texts.
Both start with the same dictionary trained on ordinary texts, so that a window's two
compressed lengths differ only by what the segments explain. A text is cut into windows at white space, every window is compressed under both dictionaries,
and the length differences give features, counts of strong and weak windows among them, that
a logistic model turns into a score. The levels that make a window strong or weak and the
weights are fitted on part of the sample that the dictionaries have not seen.

Only the fit is bounded (``max_labelled``); scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import crc32_of_id, table

WINDOW = 48
BASE_BYTES = 8192
#: The second bound of the fit besides max_labelled: windows that the common part of the dictionaries is trained on.
BASE_WINDOWS = 20_000
SEGMENT_BYTES = (48, 80, 160, 320, 640)
CLIP = np.array([64.0, 8.0, 12.0, 12.0, 0.5, 0.5, 64.0, 8.0])
THRESHOLD = 0.3
#: What a window must gain to be weak, and to be strong: the pairs that the fit compares.
LEVELS = tuple((weak, strong) for strong in range(2, 8) for weak in range(1, min(strong, 4)))
MARK_BYTES = (5, 6, 7, 8)
#: A substring stands in so many toxic texts at least, copies counted once.
MIN_TEXTS = 3
MAX_SEGMENTS = 200
#: Bytes in a row that a window of the base must not share with a segment.
PIECE = 7
MARKS_AT_ONCE = 1 << 20
#: The bounds of what is fitted: labelled texts, and characters of each; of a longer one, PARTS evenly spaced parts.
MAX_LABELLED = 8_000
MAX_CHARS = 1 << 16
PARTS = 64


def windows_of(text: str, size: int = WINDOW) -> list[bytes]:
    """The lower-cased UTF-8 bytes in pieces of at most size, cut at white space where there is any."""
    pattern = re.compile(rb".{1,%d}(?=\s|\Z)\s*|\S{%d}|.{1,%d}" % (size, size, size), re.S)
    return pattern.findall(text.lower().encode("utf-8", "surrogatepass"))


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=15,
        hash_log=12,
        chain_log=12,
        search_log=6,
        min_match=5,
        target_length=64,
        strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    loaded = zstandard.ZstdCompressionDict(dictionary)
    loaded.precompute_compress(compression_params=_parameters())
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=_parameters())


def _spaced(text: str) -> str:
    """The text with one blank for every run of white space."""
    return " ".join(text.split())


def _windows(text: str) -> list[bytes]:
    """The text's windows, each after a blank, so that a word's start looks the same everywhere."""
    return [b" " + window for window in windows_of(_spaced(text))]


class Distance:
    """Lengths of a text's windows under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._toxic, self._ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def gains(self, text: str) -> np.ndarray:
        """The bytes that the toxic dictionary saves in each window against the ordinary one."""
        toxic, ordinary = self._toxic, self._ordinary
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in _windows(text)], dtype=np.float64)


def features(gain: np.ndarray, levels: tuple[int, int]) -> np.ndarray:
    """Features of a text from its windows' gains; zeros without windows."""
    if not len(gain):
        return np.zeros(len(CLIP))
    n, top = len(gain), np.sort(gain)[-3:]
    weak, strong = ((gain >= level).sum() for level in levels)
    return np.array([top[-1], gain.mean(), strong, weak, strong / n, weak / n, top.sum(), math.log(n)])


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.clip(features, -CLIP, CLIP) / CLIP


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    levels: tuple[int, int] = LEVELS[0]
    threshold: float = THRESHOLD

    def scorer(self):
        distance, weights = Distance(self.toxic, self.ordinary), np.array(self.weights)

        def score(text: str | None) -> float:
            z = weights[0] + _scaled(features(distance.gains(text or ""), self.levels)) @ weights[1:]
            return float(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))

        return score


def _marks_of(raw: np.ndarray, size: int) -> np.ndarray:
    """The distinct substrings of size bytes, 8 at most, without a blank but as first byte; as sorted integers."""
    n = max(0, len(raw) - size + 1)
    keys, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        keys |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * (7 - k))
        if k:
            whole &= raw[k : k + n] != 32
    return np.unique(keys[whole])


def _counted_marks(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct _marks_of all the texts, sorted, and in how many texts each stands; merged a portion at a time."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    held, n = [], 0
    for k, raw in enumerate(texts):
        held.append(_marks_of(raw, size))
        n += len(held[-1])
        if n >= MARKS_AT_ONCE or k == len(texts) - 1:
            new, times = np.unique(np.concatenate(held), return_counts=True)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, place, np.concatenate([counts, times]))
            keys, counts, held, n = both, total, [], 0
    return keys, counts


def _marks(rows: list[tuple[str, int]], wanted: int = 1) -> dict[bytes, float]:
    """Substrings of words that at least three times the share of the wanted label's texts has, with their worth.

    Every text counts once for a substring, whatever its length or language. The worth is the
    count in the wanted label's texts times the log odds times the bytes that a match can save.
    """
    texts = ([], [])
    for text, label in rows:
        raw = b" " + _spaced(text).lower().encode("utf-8", "surrogatepass")
        texts[label == wanted].append(np.frombuffer(raw, np.uint8))
    found = {}
    for size in MARK_BYTES:
        keys, own = _counted_marks(texts[1], size)
        keys, own = keys[own >= MIN_TEXTS], own[own >= MIN_TEXTS]
        if not len(keys):
            continue
        other = np.zeros(len(keys), np.int64)
        for raw in texts[0]:
            seen = _marks_of(raw, size)
            at = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
            other[at[keys[at] == seen]] += 1
        excess = np.log((own + 0.5) / (len(texts[1]) + 1)) - np.log((other + 0.5) / (len(texts[0]) + 1))
        for k in np.flatnonzero(excess > math.log(3)):
            found[int(keys[k]).to_bytes(8, "big")[:size]] = float(own[k] * excess[k] * (size - 3))
    return found


def _segments(marks: dict[bytes, float]) -> list[bytes]:
    """The marks of most worth first, overlapping ones fused into words and stems.

    A mark that overlaps a segment at its end is added to it if it has half its worth; any
    other mark that shares five bytes with a segment is left out as a variant of it.
    """
    segments, worths = [], []
    for mark in sorted(marks, key=lambda m: (-marks[m], m)):
        fives = [mark[k : k + 5] for k in range(len(mark) - 4)]
        at = next((k for k, own in enumerate(segments) if any(five in own for five in fives)), None)
        if at is None:
            if len(segments) == MAX_SEGMENTS:
                break
            segments.append(mark)
            worths.append(marks[mark])
        elif mark not in (own := segments[at]) and marks[mark] >= worths[at] / 2 and len(own) < WINDOW // 2:
            for k in range(len(mark) - 1, 4, -1):
                if own.startswith(mark[-k:]):
                    segments[at] = mark[:-k] + own
                    break
                if own.endswith(mark[:k]):
                    segments[at] = own + mark[k:]
                    break
    return segments


def _fitting(segments: list[bytes], size: int) -> list[bytes]:
    """The best segments that fit into size bytes with a byte between them."""
    ends = np.cumsum([len(segment) + 1 for segment in segments])
    return segments[: int(np.searchsorted(ends, size - 1, "right"))]


def _tail(segments: list[bytes], size: int) -> bytes:
    """The segments separated by line ends; the best stand last, nearest to the data."""
    return (b"".join(segment + b"\n" for segment in reversed(segments)) + b" ").rjust(size)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant first, by Newton's method on the penalised likelihood."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _dictionaries(rows: list[tuple[str, int]]):
    """size -> (toxic dictionary, ordinary dictionary) built from rows, for any size of the segments of either class."""
    segments = [_segments(_marks(rows, label)) for label in (0, 1)]
    windows = [w for text, label in rows if not label for w in _windows(text)]
    windows = [windows[i] for i in np.random.default_rng(7).permutation(len(windows))[:BASE_WINDOWS]]

    def built(size: int) -> tuple[bytes, bytes]:
        ordinary, toxic = (_fitting(own, size) for own in segments)
        # Windows that share much with a segment stay out of the base, or it would explain the segment under both dictionaries.
        pieces = {own[k : k + PIECE] for own in toxic for k in range(max(1, len(own) - PIECE + 1))}
        told = re.compile(b"|".join(map(re.escape, sorted(pieces))) or b"(?!)")
        samples = [w for w in windows if not told.search(w)]
        try:
            base = zstandard.train_dictionary(BASE_BYTES, samples, k=64, d=6, level=3).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            base = b" ".join(samples)[-BASE_BYTES:]
        return base + _tail(toxic, size), base + _tail(ordinary, size)

    return built


def fit(rows: list[tuple[str | None, int]]) -> ToxicityModel:
    """Fit dictionaries and calibration on labelled texts (text, 0 or 1).

    Repeated rows count once. The rows of each class are dealt to two halves. Each half's
    dictionaries measure the other half, and over all those features the size of the
    segments and the levels of weak and strong windows are chosen and the logistic weights are
    fitted; the model's own dictionaries are built from all rows. Without rows of both classes in either half the model gives every text the share of label 1 among
    the rows, or next to 0 without rows.
    """
    rows = list(dict.fromkeys((text or "", int(label)) for text, label in rows))
    by_class = [[row for row in rows if row[1] == label] for label in (0, 1)]
    halves = [[row for own in by_class for row in own[k::2]] for k in (0, 1)]
    if any(len({label for _, label in half}) < 2 for half in halves):
        share = sum(label for _, label in rows) / len(rows) if rows else 0.0
        constant = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return ToxicityModel(b" ", b" ", (constant, *[0.0] * len(CLIP)))
    folds = [(_dictionaries(halves[k]), halves[1 - k]) for k in (0, 1)]
    y = np.array([label for _, tune in folds for _, label in tune], dtype=np.float64)
    best = None
    for size in SEGMENT_BYTES:
        measured = []
        for built, tune in folds:
            distance = Distance(*built(size))
            measured += [distance.gains(text) for text, _ in tune]
        for levels in LEVELS:
            x = _scaled(np.array([features(gain, levels) for gain in measured]))
            w = _logistic(x, y)
            loss = _log_loss(x, y, w)
            if best is None or loss < best[0] - 1e-4:
                best = loss, size, levels, w
    _, size, levels, w = best
    return ToxicityModel(*_dictionaries(rows)(size), tuple(float(v) for v in w), levels)


def _bounded(text: Column) -> Column:
    """The whole text, or of one of more than MAX_CHARS characters PARTS evenly spaced parts, a blank between them."""
    part, length = MAX_CHARS // PARTS, F.length(text)
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring(text, (F.floor(i * (length - part) / (PARTS - 1)) + 1).cast("int"), F.lit(part)))
    return F.when(length > MAX_CHARS, F.array_join(parts, " ")).otherwise(text)


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """At most max_labelled labelled texts, in an order by hash that does not depend on partitions.

    Rows whose crc32(doc_id) mod 4 is 2 are held out, as are labels that are null. Of rows with
    one doc_id the smallest text serves. What is collected is bounded in rows and in the
    characters of each (_bounded), on the executors.
    """
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (crc32_of_id("doc_id") % 4 != 2))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_labelled)
    )
    rows = documents.select("doc_id", _bounded(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.toxic))]


def score_documents(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents' doc_id with score (0 to 1) and predicted (score at the model's threshold or above).

    Null and empty texts have no window and get the score of no evidence; a null doc_id stays
    null. Repeated rows are scored each. Texts of any length are read whole, window by window.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            values = np.array([score(text.as_py()) for text in batch.column("text")], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array((values >= model.threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, predicted int")


def reject_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, all their columns, without those that the model predicts to be toxic."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(text.as_py()) < model.threshold for text in batch.column("text")], pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)


NAME = "op1_toxicity"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc32_of_id("doc_id") % 4 == 2, F.lit(False))
    return score_documents(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
