"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated thresholds.

Both dictionaries share content trained on windows of ordinary text. The toxic one adds, in
front, the words and parts of words that toxic texts hold far more often than ordinary ones. A window of a few
words is compressed with each; it is marked when the toxic dictionary saves at least a
calibrated number of bytes. Bytes are written as fixed pairs of random bytes before
compression: a literal then costs two bytes and a match little, so lengths show coverage.
A logistic curve over a text's marked windows gives the score.

The fit uses a bounded sample of labelled rows (`SAMPLE` texts per class, each of at most
`FIT_CHARS` characters); half of it makes the dictionaries, half sets thresholds and curve.
Class frequencies are counted over all labelled training rows. Scoring reads whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.rows import own_names, table
from verdictlake.scale import write_through

SAMPLE = 1500
FIT_CHARS = 20_000
WINDOW = 4
SHARED_BYTES = 12_288
TOXIC_BYTES = 4096
#: Bytes of the grams that telling parts of words are found by.
GRAMS = (5, 6)
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8, 10, 12)
_PAIRS = np.random.default_rng(42).integers(0, 1 << 16, 256, dtype=np.uint16)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]


def spread(data: bytes) -> bytes:
    return _PAIRS[np.frombuffer(data, np.uint8)].tobytes()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of `size` words, A-Z lower-cased; no words make no window."""
    words = text.lower().split()
    return [b" " + b" ".join(words[k:k + size]) + b" " for k in range(0, len(words), size)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=5, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


class Gains:
    """Bytes that the toxic dictionary saves over the ordinary one, per window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.coders = _compressor(ordinary), _compressor(toxic)

    def __call__(self, pieces: list[bytes], chunk: int = 20_000) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), chunk):
            part = pieces[at:at + chunk]
            wide = 2 * np.fromiter(map(len, part), np.uint64, len(part))
            places = np.stack([np.cumsum(wide) - wide, wide], 1).tobytes()
            data = spread(b"".join(part))
            lengths = [
                np.fromiter(map(len, coder.multi_compress_to_buffer(zstandard.BufferWithSegments(data, places), threads=1)), np.int64, len(part))
                for coder in self.coders]
            out.append(lengths[0] - lengths[1])
        return np.concatenate(out)


def marks(texts: list[bytes], gains: Gains) -> np.ndarray:
    """Per text: number of windows, then of windows that gain at least each threshold."""
    cut = [windows(t) for t in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    gained = gains([w for one in cut for w in one])
    owner = np.repeat(np.arange(len(cut)), sizes)
    counts = [np.bincount(owner[gained >= t], minlength=len(cut)) for t in THRESHOLDS]
    return np.stack([sizes, *counts], 1)


def _features(size: np.ndarray, marked: np.ndarray) -> np.ndarray:
    share = marked / np.maximum(size, 1)
    return np.stack([np.ones(len(size)), (marked > 0) * 1.0, np.log1p(marked), 10 * np.minimum(share, 0.1)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge-penalised weights by Newton steps, and the mean loss."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def _grams(text: bytes) -> tuple[bytes, list[tuple[np.ndarray, np.ndarray, int]]]:
    """The text's words with single spaces around, and per size of gram: hashes, begins, size; a gram lies in a word and the space at either side."""
    words = b" " + b" ".join(text.lower().split()) + b" "
    data = np.frombuffer(words, np.uint8)
    blanks = np.concatenate([[0], np.cumsum(data == 32)])
    found = []
    for size in GRAMS:
        n = max(0, len(data) - size + 1)
        code = np.full(n, size, np.uint64)
        for k in range(size):
            code = code * np.uint64(0x100000001B3) + data[k:k + n]
        inner = np.flatnonzero(blanks[size - 1:size - 1 + n] == blanks[1:1 + n])
        found.append((code[inner], inner, size))
    return words, found


def _telling(toxic: list[bytes], ordinary: list[bytes], least: float, lift: float, texts: int) -> np.ndarray:
    """Hashes of the grams that far more toxic texts hold than ordinary ones, rising."""
    (codes, a), (other, n) = (np.unique(np.concatenate([np.zeros(0, np.uint64), *(
        np.unique(np.concatenate([c for c, _, _ in _grams(t)[1]])) for t in group)]), return_counts=True) for group in (toxic, ordinary))
    b = np.zeros(len(codes))
    _, at, of = np.intersect1d(codes, other, assume_unique=True, return_indices=True)
    b[at] = n[of]
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))
    p = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    return codes[(a >= texts) & (z >= least) & (a / n1 >= lift * b / n0)]


def _toxic_forms(toxic: list[bytes], ordinary: list[bytes], least: float = 6.0, lift: float = 5.0, texts: int = 3) -> list[bytes]:
    """Words and parts of words that telling grams cover, the most frequent last; none holds another.

    Parts matter where a telling stem has many endings, each of them rare.
    """
    codes, held = _telling(toxic, ordinary, least, lift, texts), Counter()
    for text in toxic:
        words, found = _grams(text)
        edge = np.zeros(len(words) + 1, np.int64)
        for code, at, size in found:
            at = at[np.isin(code, codes)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
        bounds = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])))
        parts = set()
        for begin, end in zip(bounds[::2], bounds[1::2]):
            pieces = words[begin:end].split(b" ")
            parts.update(b" " * (k > 0) + x + b" " * (k < len(pieces) - 1) for k, x in enumerate(pieces))
        held.update(x for x in parts if len(x) >= min(GRAMS))
    forms: list[bytes] = []
    for form, n in sorted(held.items(), key=lambda x: (-x[1], x[0])):
        if n >= texts and not any(form in kept or kept in form for kept in forms):
            forms.append(form)
    return forms[::-1]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Content of the ordinary and the toxic dictionary."""
    samples = [spread(w) for t in ordinary for w in windows(t)]
    stride = max(1, len(samples) // 20_000)
    try:
        shared = zstandard.train_dictionary(SHARED_BYTES, samples[::stride]).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        shared = b"".join(samples)[-SHARED_BYTES:] or spread(b" " * 8)
    forms = spread(b"".join(_toxic_forms(toxic, ordinary)))[-TOXIC_BYTES:]
    return shared, forms + shared


def training(doc_id: str, folds: int = 5) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text is not divisible by `folds`."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows of the training folds. Rows without an id, a text or a label take no part."""
    known = labels.filter(training(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("_y"))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitting = training(id_col) & F.length(text_col).between(1, FIT_CHARS)
    # Ids and labels are joined first; texts are fetched for the bounded sample only.
    labelled = write_through(docs.filter(fitting).select(F.col(id_col).alias("_id")).distinct().join(known, "_id").withColumn(
        "_order", F.md5(F.concat(F.lit("toxicity:"), F.col("_id").cast("string")))))
    taken = [labelled.filter(F.col("_y") == y).orderBy("_order", "_id").limit(SAMPLE) for y in (0, 1)]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))
    texts = docs.filter(fitting).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")
    rows = [(r["_y"], r["_text"].encode()) for r in texts.orderBy("_y", "_order", "_text").select("_y", "_text").collect()]
    rows = list(dict.fromkeys(rows))
    build, check = rows[::2], rows[1::2]
    ordinary, toxic = dictionaries([t for y, t in build if y], [t for y, t in build if not y])
    if not check or len({y for y, _ in check}) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return Model(ordinary, toxic, THRESHOLDS[-1], (base, 0.0, 0.0, 0.0))
    y = np.array([y for y, _ in check], float)
    counts = marks([t for _, t in check], Gains(ordinary, toxic))
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    weight *= len(y) / weight.sum()
    curves = [(*_logistic(_features(counts[:, 0], counts[:, 1 + k]), y, weight), t) for k, t in enumerate(THRESHOLDS)]
    weights, _, threshold = min(curves, key=lambda c: c[1])
    return Model(ordinary, toxic, threshold, tuple(float(w) for w in weights))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` plus `out`, a score from 0 to 1 over the whole text; a null text scores as an empty one."""
    names = [c for c in docs.columns if c != out]
    source = docs.select(*names, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_bytes"))
    schema = source.drop("_bytes").withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, at, w = Gains(model.ordinary, model.toxic), 1 + THRESHOLDS.index(model.threshold), np.array(model.weights)
        for batch in batches:
            found = []
            for begin in range(0, batch.num_rows, 500):
                counts = marks([t.as_py() for t in batch.column("_bytes").slice(begin, 500)], gains)
                found.append(1 / (1 + np.exp(-np.clip(_features(counts[:, 0], counts[:, at]) @ w, -30, 30))))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, out])

    return source.mapInArrow(run, schema)


@own_names
def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of `docs` that score below one half, with their columns."""
    model = fit(docs, labels, text_col=text_col)
    return score(docs, model, text_col, "_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(~training("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
