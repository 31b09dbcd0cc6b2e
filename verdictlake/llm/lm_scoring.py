"""Language-model scores of whole documents by a gated recurrent network over corpus counts.

Word counts, vocabulary size and the counts of each ending class cover all training
documents. The network's first weights come from a bounded set (`WARM` documents of at most
`FIT_CHARS` characters); then every partition trains on all training documents it holds, in
runs of bounded bytes, and the weights are averaged by tokens. Scoring
reads whole texts, block by block: a block is a run of rows of bounded bytes and gets just
the counts of the words it holds, joined by word, so no vocabulary is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.recurrent import END, Head, Network, ending_class, make_head
from verdictlake.llm.rows import RID, identified, split_words, table
from verdictlake.scale import write_through

HEAD_WORDS, CLASSES, ENDINGS, HIDDEN = 1500, 32, 64, 24
WARM, FIT_CHARS = 1500, 20_000
LANES, TRAIN_BYTES = 256, 4 << 20
RATES = (0.1, 0.05)
BLOCK_BYTES = 12 << 20
ALPHA = 0.1
CHUNK = 4096


def held_out(doc_id: str) -> Column:
    """Rows not learnt from: crc32 of the id as text divisible by 10, or no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _order(doc_id: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), F.col(doc_id).cast("string")))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the column `text`; A-Z lower-cased, null texts hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, forms, _ = split_words(batch.column("text"), lower=True)
            n = np.bincount(index, minlength=len(forms))
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([forms.filter(some), pa.array(n).filter(some)], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """The head, the corpus numbers and the network's weights; of bounded size whatever the corpus."""

    def __init__(self, head: Head, documents: int, tokens: int, types: int, class_tokens: np.ndarray, class_types: np.ndarray, weights: np.ndarray):
        self.head, self.documents, self.tokens, self.types = head, documents, tokens, types
        self.class_tokens, self.class_types, self.weights = class_tokens, class_types, weights

    def network(self) -> Network:
        return Network(self.head, HIDDEN).load(self.weights)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.types + 1)))

    def score(self, texts: pa.Array, known: pa.Table) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of whole texts; `known` has the counts `n` of each `word` of theirs."""
        index, forms, offsets = split_words(texts, lower=True)
        held = pc.index_in(forms, value_set=known["word"].combine_chunks())
        counts = pc.fill_null(pc.take(known["n"].combine_chunks(), held), 0).to_numpy(zero_copy_only=False)
        token = self.tokens_of(forms)
        ending = np.maximum(token - self.head.size, 0)
        share = np.log10((counts + ALPHA) / (self.class_tokens[ending] + ALPHA * (self.class_types[ending] + 1)))
        share[token < self.head.size] = 0
        n = len(texts)
        words = np.diff(offsets)
        owner = np.repeat(np.arange(n), words)
        total = lambda per_form: np.bincount(owner, per_form[index], n)
        flat = token[index].astype(np.int32)
        documents = [np.append(flat[a:b], np.int32(END)) for a, b in zip(offsets, offsets[1:])]
        modelled = np.array([p.sum() for p in self.network().score(documents)]) / np.log(10) if n else np.zeros(0)
        return {
            "n_tokens": words + 1,
            "n_known": total((counts > 0) * 1.0).astype(np.int64) + (self.documents > 0),
            "base_score": total(self.base(counts)) + self.base(np.array(self.documents)),
            "score": modelled + total(share)}

    def tokens_of(self, forms: pa.Array) -> np.ndarray:
        """The network's token of each word: its place in the head, or its ending class behind the head."""
        place = pc.index_in(forms, value_set=pa.array(self.head.words, forms.type))
        ends = pc.utf8_slice_codeunits(forms, -2).dictionary_encode()
        classes = np.array([ending_class(w, self.head.endings) for w in ends.dictionary.to_pylist()], np.int64)
        ending = classes[ends.indices.to_numpy(zero_copy_only=False)]
        return np.where(place.is_valid().to_numpy(zero_copy_only=False), 1 + place.fill_null(0).to_numpy(zero_copy_only=False), self.head.size + ending)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        index, forms, offsets = split_words(texts, lower=True)
        flat = self.tokens_of(forms).astype(np.int32)[index]
        return [np.append(flat[a:b], np.int32(END)) for a, b in zip(offsets, offsets[1:])]


def runs_of(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts in runs of about `most` bytes, each text whole."""
    run = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    edges = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]])
    for begin, end in zip(edges, edges[1:]):
        if end > begin:
            yield texts.slice(begin, end - begin)


def _averaged(model: Model, sums: dict, texts: DataFrame) -> np.ndarray:
    """One pass over `texts` in every partition from the model's weights; the mean weights by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tokens = model.network(), 0
        net.sums = {k: v.copy() for k, v in sums.items()}
        for batch in batches:
            for part in runs_of(batch.column("text"), TRAIN_BYTES):
                # Several documents a lane: a run whose lanes end far apart would close on its longest texts alone.
                tokens += net.train(model.encode(part), RATES[-1], width=max(1, min(LANES, len(part) // 8)))
        if not tokens:
            return
        flat = net.flat()
        parts = [flat[a:a + CHUNK] for a in range(0, len(flat), CHUNK)]
        salt = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int64()), pa.array([salt % 64] * len(parts), pa.int64()),
             pa.array([tokens] * len(parts), pa.float64()), pa.array(parts, pa.list_(pa.float32()))], names=["chunk", "salt", "tokens", "weights"])

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        weights = np.average(np.stack(part.weights).astype(float), axis=0, weights=part.tokens)
        return pd.DataFrame({"chunk": part.chunk.iloc[:1].to_numpy(), "tokens": [part.tokens.sum()], "weights": [weights.astype(np.float32)]})

    shape = "chunk bigint, tokens double, weights array<float>"
    trained = texts.mapInArrow(run, "chunk bigint, salt bigint, tokens double, weights array<float>")
    salted = trained.groupBy("chunk", "salt").applyInPandas(mean, shape)
    rows = salted.groupBy("chunk").applyInPandas(mean, shape).orderBy("chunk").collect()
    return np.concatenate([np.array(r["weights"], np.float32) for r in rows]) if rows else model.weights


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the (word, n) counts, from training rows. Rows without an id are not learnt from."""
    training = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    counts = write_through(count_words(training))
    documents = training.count()
    ending = F.crc32(F.encode(F.right("word", F.lit(2)), "UTF-8")) % ENDINGS
    classes = {r["c"]: (r["n"], r["v"]) for r in counts.groupBy(ending.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    frequent = [(r["word"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(HEAD_WORDS).collect()]
    tokens = sum(n for n, _ in classes.values()) + documents
    types = sum(v for _, v in classes.values()) + (documents > 0)
    class_tokens, class_types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for c, (n, v) in classes.items():
        class_tokens[c], class_types[c] = n, v
    for word, n in frequent:
        class_tokens[ending_class(word, ENDINGS)] -= n
        class_types[ending_class(word, ENDINGS)] -= 1
    head = make_head(frequent, documents, ENDINGS, CLASSES)
    net = Network(head, HIDDEN)
    model = Model(head, documents, tokens, types, class_tokens, class_types, net.flat())
    first = training.filter(F.length("text") <= FIT_CHARS).orderBy(_order("_id", "warm"), "text").limit(WARM).select("text").collect()
    if first:
        encoded = model.encode(pa.array([r["text"] for r in first], pa.string()))
        for rate in RATES:
            net.train(encoded, rate, width=32)
        model.weights = net.flat()
    model.weights = _averaged(model, net.sums, training.select("text"))
    return model, counts


def rows_per_block(rows: DataFrame, text_col: str, most: int = BLOCK_BYTES) -> int:
    """The largest power of two times 64 for which every run of so many rows holds at most `most` bytes of text."""
    runs = write_through(rows.groupBy(F.col(f"{RID}.f").alias("f"), F.floor(F.col(f"{RID}.i") / 64).alias("run")).agg(
        F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("bytes")))
    size = 64
    while size < 1 << 16:
        wider = runs.groupBy("f", F.floor(F.col("run") / (size // 32)).alias("run")).agg(F.sum("bytes").alias("bytes"))
        if (wider.agg(F.max("bytes")).first()[0] or 0) > most:
            break
        size *= 2
    return size


def score(rows: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per `identified` row: doc_id, n_tokens, n_known, base_score, score.

    The scores are log10 probabilities of the whole text and its end; a null text is empty and
    consists of its end. Repeated rows score alike.
    """
    size = rows_per_block(rows, text_col)
    texts = rows.select(
        F.col(f"{RID}.f").alias("f"), F.floor(F.col(f"{RID}.i") / size).alias("b"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, b = batch.column("f").to_numpy(), batch.column("b").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (b[1:] != b[:-1]), [True]])) if len(b) else []
            for begin, end in zip(edges, edges[1:]):
                _, forms, _ = split_words(batch.column("text").slice(begin, end - begin), lower=True)
                n = len(forms)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f[begin])), pa.array(np.full(n, b[begin])), forms], names=["f", "b", "word"])

    needed = texts.mapInArrow(words, "f bigint, b bigint, word string")
    own = needed.join(counts, "word").select("f", "b", "word", "n")
    kind = dict(texts.dtypes)["doc_id"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = model.score(left["text"].combine_chunks(), right)
        return pa.table({"doc_id": left["doc_id"], **{k: pa.array(v) for k, v in found.items()}})

    return texts.groupBy("f", "b").cogroup(own.groupBy("f", "b")).applyInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, folder, "documents")
    model, counts = fit(docs)
    return score(identified(docs), model, counts).select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score")
