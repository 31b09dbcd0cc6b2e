"""Removal of repeated word spans with suffix automata of reference shards.

A window is `SPAN` consecutive words. Winnowing picks anchors, short word runs, so that every
window holds one and equal windows hold the same one at the same place. Only anchors that
occur again anywhere can lie in a repeated window; the words around the first occurrence of
each of their different surroundings are the references. References are dealt into shards by
anchor, so an automaton meets only texts that share its anchors and every text meets all
that could match it, at a cost in proportion to the repeated words. In a shard the
surroundings are streamed, in order, through the automaton of those before them: matching
statistics of `SPAN` or more are windows that start earlier, and together make the maximal
spans to remove. Anchors with very many different surroundings (a line that a third of all
documents hold) are settled window by window in a grouped minimum, so no shard grows with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.rows import RID, identified, join_narrow, split_words, table
from verdictlake.scale import write_through

SPAN = 20
ANCHOR = 5
HOT = 500
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHashes:
    """64-bit hash of any run of a word sequence from two table look-ups."""

    def __init__(self, words: np.ndarray):
        power = np.concatenate([[np.uint64(1)], np.full(len(words), _BASE)]).cumprod(dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], (words * power[:-1]).cumsum(dtype=np.uint64)])
        self.back = np.concatenate([[np.uint64(1)], np.full(len(words), _BACK)]).cumprod(dtype=np.uint64)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def find_anchors(texts: pa.Array, span: int = SPAN, size: int = ANCHOR) -> dict[str, np.ndarray]:
    """Anchors of whole texts: text, pos, anchor (hash), around (hash of the surroundings)."""
    index, forms, offsets = split_words(texts)
    codes = np.fromiter((xxhash.xxh64_intdigest(f.as_py()) for f in forms), np.uint64, len(forms))
    total = len(index)
    if total < span:
        return {k: np.zeros(0, np.int64) for k in ("text", "pos", "anchor", "around")}
    run = RunHashes(codes[index])
    at = np.arange(total - size + 1)
    hashes = run(at, at + size)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    first = np.flatnonzero(np.arange(total - span + 1) + span <= offsets[1:][text[: total - span + 1]])
    best = np.lib.stride_tricks.sliding_window_view(hashes, span - size + 1).argmin(1)
    pos = np.unique(first + best[first])
    owner = text[pos]
    begin = np.maximum(pos - (span - size), offsets[owner])
    end = np.minimum(pos + span, offsets[owner + 1])
    around = _mixed(run(begin, end) + (pos - begin).astype(np.uint64))
    return {"text": owner, "pos": pos - offsets[owner], "anchor": hashes[pos].view(np.int64), "around": around.view(np.int64)}


class SuffixAutomaton:
    """All runs of the sequences added so far; every state knows where its runs first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def _state(self, size: int, first, link: int = 0, onward: dict | None = None) -> int:
        self.next.append(onward or {})
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        copy = self._state(self.size[p] + 1, self.first[q], self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: Iterable, owner) -> None:
        last = 0
        for k, word in enumerate(words):
            q = self.next[last].get(word)
            if q is not None:  # this run is known from another sequence
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.size[last] + 1, (owner, k)), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = new

    def matches(self, words: Iterable, least: int) -> Iterator[tuple[int, tuple]]:
        """(end, first) of each run of `least` words that the automaton holds, by matching statistics."""
        state = length = 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= least:
                at = state
                while self.size[self.link[at]] >= least:
                    at = self.link[at]
                yield k, self.first[at]


def judge(surroundings: Iterable[tuple], span: int = SPAN) -> Iterator[tuple]:
    """Surroundings of one anchor in order, as (document, begin, words): each with its mask of earlier-known windows.

    Bit o is set when the window at `begin` + o also starts earlier, in a smaller document or
    the same one.
    """
    automaton = SuffixAutomaton()
    for document, begin, words in surroundings:
        mask = 0
        for end, ((other, base), where) in automaton.matches(words, span):
            if (other, base + where) < (document, begin + end):
                mask |= 1 << (end - span + 1)
        yield mask
        if mask != (1 << max(0, len(words) - span + 1)) - 1:
            automaton.add(words, (document, begin))


_ORDER = ("late", "id", "f", "i")


def _surroundings(source: DataFrame, id_type: str, span: int, size: int, hot: bool) -> DataFrame:
    """Words around the listed positions of each text; per window with its digest when `hot`."""
    schema = "key bigint, late boolean, id " + id_type + ", f bigint, i bigint, pos bigint, begin bigint, " + (
        "bit int, digest binary" if hot else "words binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("key", "row", "pos", "begin", *(("bit", "digest") if hot else ("words",)))}
            for k in range(batch.num_rows):
                places = batch.column("places")[k].as_py()
                if not places:
                    continue
                words = batch.column("text")[k].as_py().split()
                for pos in places:
                    begin = max(0, pos - span + size)
                    part = words[begin:pos + span]
                    key = xxhash.xxh64_intdigest(b" ".join(words[pos:pos + size])) - (1 << 63)
                    found = [(b" ".join(part),)] if not hot else [
                        (o, hashlib.md5(b" ".join(part[o:o + span])).digest()) for o in range(len(part) - span + 1)]
                    for values in found:
                        for name, value in zip(rows, (key, k, pos, begin, *values)):
                            rows[name].append(value)
            taken = pa.array(rows["row"], pa.int64())
            rest = [(rows[n], pa.int32() if n == "bit" else pa.binary()) for n in list(rows)[4:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["key"], pa.int64()), *(batch.column(n).take(taken) for n in _ORDER),
                 pa.array(rows["pos"], pa.int64()), pa.array(rows["begin"], pa.int64()), *(pa.array(v, t) for v, t in rest)],
                names=["key", *_ORDER, "pos", "begin", *list(rows)[4:]])

    return source.mapInArrow(run, schema)


def _judge_shards(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Judge the surroundings of a shard, which come sorted by anchor and order."""
    held: list[tuple] = []

    def settle() -> pa.RecordBatch:
        # Documents in their order are numbered; only the order matters to the automaton.
        number = {d: n for n, d in enumerate(dict.fromkeys(d for d, *_ in held))}
        masks = list(judge(((number[d], begin, words.split()) for d, _, begin, words in held), span))
        return pa.RecordBatch.from_arrays([
            pa.array([d[2] for d, *_ in held], pa.int64()), pa.array([d[3] for d, *_ in held], pa.int64()),
            pa.array([pos for _, pos, *_ in held], pa.int64()), pa.array(masks, pa.int64())], names=["f", "i", "pos", "mask"])

    done, key = [], None
    for batch in batches:
        for row_key, late, id_, f, i, pos, begin, words in zip(*(c.to_pylist() for c in batch.columns)):
            if row_key != key and held:
                done.append(settle())
                held.clear()
            key = row_key
            held.append(((late, id_, f, i), pos, begin, words))
        if len(done) > 200:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done.clear()
    if held:
        done.append(settle())
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def repeated_windows(rows: DataFrame, span: int = SPAN, size: int = ANCHOR, id_col: str = "doc_id",
                     text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(_rid, places): per row that has any, its anchors with repeated windows.

    A place is anchor position * 65536 + mask; bit o of the mask is the window that starts o
    words after the surroundings begin, and a full mask (65535) means all of them.
    `rows` come from `identified`. Words are cut at space and \\t to \\r and compared
    unchanged. Windows are ordered by id (null last), row identity, and start, so of repeated
    rows the first counts as the original. Null, empty and short texts have no windows.
    """
    if span - size > 15:
        raise ValueError("masks hold up to 16 windows around an anchor")
    id_type = dict(rows.dtypes)[id_col]
    texts = rows.select(
        F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col(f"{RID}.f").alias("f"), F.col(f"{RID}.i").alias("i"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"late boolean, id {id_type}, f bigint, i bigint, anchor bigint, around bigint, pos bigint"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = find_anchors(batch.column("text"), span, size)
                taken = pa.array(found["text"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(taken) for n in _ORDER), *(pa.array(found[n], pa.int64()) for n in ("anchor", "around", "pos"))],
                    names=[*_ORDER, "anchor", "around", "pos"])

    anchors = write_through(texts.mapInArrow(mark, schema))
    again = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    met = write_through(anchors.join(again, "anchor", "left_semi"))
    first = met.groupBy("anchor", "around").agg(F.min(F.struct(*_ORDER, "pos")).alias("first"))
    references = write_through(first)
    crowded = references.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("anchor", F.lit(True).alias("hot"))
    chosen = references.join(crowded, "anchor", "left").select("first.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    listed = write_through(chosen.groupBy("f", "i").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("pos").cast("int"))).alias("calm"),
        F.collect_list(F.when(F.col("hot"), F.col("pos").cast("int"))).alias("crowd")))
    width = F.size("calm") * 4 + F.size("crowd") * 4 + 32
    around = join_narrow(texts.withColumn("text", F.col("text").cast("binary")), listed, ["f", "i"], "inner", width)
    calm = _surroundings(around.select(*_ORDER, "text", F.col("calm").alias("places")), id_type, span, size, False)
    shards = calm.repartition("key").sortWithinPartitions("key", *_ORDER, "pos")
    masks = shards.mapInArrow(lambda batches: _judge_shards(batches, span), "f bigint, i bigint, pos bigint, mask bigint")

    crowd = write_through(_surroundings(
        around.filter(F.size("crowd") > 0).select(*_ORDER, "text", F.col("crowd").alias("places")), id_type, span, size, True))
    own = F.struct(*_ORDER, (F.col("begin") + F.col("bit")).alias("start"))
    earliest = crowd.groupBy("digest").agg(F.min(own).alias("earliest"))
    crowd_masks = crowd.join(earliest, "digest").groupBy("f", "i", "pos").agg(
        F.sum(F.when(F.col("earliest") < own, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).otherwise(F.lit(0)))
        .cast("bigint").alias("mask"))
    # A position may be listed twice when two of its surroundings collapse to one row.
    judged = masks.unionByName(crowd_masks)
    places = met.select("f", "i", "pos").join(judged, ["f", "i", "pos"], "left").withColumn("mask", F.coalesce("mask", F.lit(65535)))
    return places.filter("mask <> 0").groupBy("f", "i").agg(
        F.collect_list(F.col("pos") * 65536 + F.col("mask")).alias("places")).select(F.struct("f", "i").alias(RID), "places")


def kept_words(words: list[bytes], places: list[int], span: int = SPAN, size: int = ANCHOR) -> list[bytes]:
    """The words outside all windows that the places mark."""
    edge = np.zeros(len(words) + 1, np.int64)
    for place in places:
        pos, mask = divmod(place, 65536)
        begin = max(0, pos - span + size)
        for o in range(min(len(words), pos + span) - begin - span + 1):
            if mask >> o & 1:
                edge[begin + o] += 1
                edge[begin + o + span] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    return [w for w, gone in zip(words, covered) if not gone]


def remove_repeats(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per `identified` row: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    places = write_through(repeated_windows(rows, id_col=id_col, text_col=text_col, **options))
    texts = rows.select(RID, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    joined = join_narrow(texts, places, [RID], "left", F.size("places") * 8 + 32).select("doc_id", "text", "places")
    kind = dict(joined.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                words = text.as_py().split()
                left = kept_words(words, places.as_py()) if places.is_valid else words
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(identified(table(spark, folder, "documents"))).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
