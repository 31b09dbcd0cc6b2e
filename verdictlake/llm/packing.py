"""Packing token sequences by minimum bin slack over a histogram of lengths.

Documents are tokenized once and cut into full windows and a remainder. Only the number of
remainders of each length matters to packing, at most one count per length below the window,
so the fill patterns are found on that bounded histogram: the longest remaining length opens
a window, a bitset subset-sum program finds how closely the remaining multiset can fill it,
backtracking gives the counts, and the pattern is used as often as the counts allow.
Pieces are then numbered within their length, in chunks, and look up their place.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.ngram_join import slices
from verdictlake.llm.rows import split_words, table, without_own_names
from verdictlake.scale import position_in_group, write_through

WINDOW = 2048
END = 1
CACHED = 250_000
ENCODE_BYTES = 2 << 20
_STOPS = ".,!?;:"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts from a tokenizer that never joins across white space, each form encoded once.

    Words of letters with trailing stops are the word's ids followed by the stops' ids. A text
    that may hold a special token is encoded as it is.
    """

    def __init__(self, path: str):
        # A task has one core: threads of their own would cost it memory and time. Read when tokenizers first runs.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(tokens.values()) + 1, bool)
        self.closes[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.slots: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _prune(self) -> None:
        """Forget forms that were met once; all of them if that is not enough."""
        kept = [(form, self._ids(slot)) for form, slot in self.slots.items() if self.hits[slot] > 1]
        self.slots, self.used = {}, 0
        self.hits[:] = 0
        if kept and len(kept) <= CACHED // 2:
            self._add([form for form, _ in kept], np.concatenate([ids for _, ids in kept]), np.array([len(ids) for _, ids in kept]))

    def _add(self, forms: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        slot = len(self.slots)
        if slot + len(forms) > len(self.begin):
            more = max(len(self.begin), len(forms))
            self.begin, self.size, self.hits = (np.concatenate([v, np.zeros(more, np.int64)]) for v in (self.begin, self.size, self.hits))
        self.pool[self.used:self.used + len(ids)] = ids
        ends = np.cumsum(sizes)
        self.begin[slot:slot + len(forms)] = self.used + ends - sizes
        self.size[slot:slot + len(forms)] = sizes
        self.slots.update(zip(forms, range(slot, slot + len(forms))))
        self.used += len(ids)

    def _ids(self, slot: int) -> np.ndarray:
        return self.pool[self.begin[slot]:self.begin[slot] + self.size[slot]]

    def _encode(self, forms: list[str], letters: bool) -> None:
        """Encode new forms; those of letters only are one token run each, so many go in one text."""
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join(forms), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(forms) and ends[-1] == len(ids):
                return self._add(forms, ids, np.diff(ends, prepend=0))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(forms, add_special_tokens=False)]
        self._add(forms, np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64))

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the slots one after another."""
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(sizes.sum()) + np.repeat(self.begin[slots] - ends + sizes, sizes)]

    def _learn(self, forms: list[str]) -> None:
        slots = self.slots
        new = [form for form in forms if form not in slots]
        stems = [form.rstrip(_STOPS) for form in new]
        split = [k for k, (form, stem) in enumerate(zip(new, stems)) if stem != form and stem and stem[-1].isalpha()]
        whole, stems = [new[k] for k in split], [stems[k] for k in split]
        stops = [form[len(stem):] for form, stem in zip(whole, stems)]
        plain = dict.fromkeys(new)
        for form in whole:
            del plain[form]
        plain.update(dict.fromkeys(part for parts in (stems, stops) for part in parts if part not in slots))
        for letters in (True, False):
            part = [form for form in plain if form.isalpha() == letters]
            for at in range(0, len(part), 4000):
                self._encode(part[at:at + 4000], letters)
        if whole:
            both = np.empty(2 * len(whole), np.int64)
            for k, parts in enumerate((stems, stops)):
                both[k::2] = np.fromiter(map(slots.__getitem__, parts), np.int64, len(whole))
            self._add(whole, self._gather(both), self.size[both].reshape(-1, 2).sum(1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text begins (one more at the end)."""
        if len(self.slots) > CACHED:
            self._prune()
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        index, forms, offsets = split_words(pc.if_else(pa.array(special), "", texts), lower=True)
        names = forms.to_pylist()
        self._learn(names)
        slots = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))
        self.hits[slots] += 1
        of = slots[index]
        ids = self._gather(of)
        starts = np.concatenate([[0], np.cumsum(self.size[of])])[offsets]
        if not special.any():
            return ids, starts
        parts = [ids[starts[k]:starts[k + 1]] for k in range(len(texts))]
        for k in np.flatnonzero(special):
            found = self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False)
            parts[k] = np.array(found.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=1)
def _coder(path: str) -> WordIds:
    """One coder for all tasks of a worker process."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: doc_id, start, length, ids_crc32, doc_tokens, and ids on request.

    Every document ends with `end`, so a null or empty text is one piece of one token. All
    pieces but a document's last are full windows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in slices(batches, "text", ENCODE_BYTES, 1000):
            ids, starts = coder.encode(batch.column("text"))
            owner, start, length, crc, total, held = [], [], [], [], [], []
            for k in range(batch.num_rows):
                one = np.append(ids[starts[k]:starts[k + 1]], np.uint32(end)).astype("<u4")
                for s in range(0, len(one), window):
                    part = one[s:s + window]
                    owner.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(one))
                    if with_ids:
                        held.append(part.astype(np.int64))
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.list_(pa.int64()))] * with_ids, names=names)

    return source.mapInArrow(run, schema)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of the counted lengths whose sum is the largest up to `room`; longer lengths are preferred.

    Bit s of the set is on when sum s can be reached. Counts enter in doubling bundles, the
    set after each is kept, and walking them back gives the numbers used.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((v for v in counts if v <= room and counts[v]), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths with their counts) that use up all counted lengths."""
    left, found = {v: n for v, n in counts.items() if n}, []
    while left:
        first = max(left)
        left[first] -= 1
        fill = closest_fill(left, window - first)
        left[first] += 1
        fill[first] = fill.get(first, 0) + 1
        times = min(left[v] // n for v, n in fill.items())
        found.append((times, fill))
        for v, n in fill.items():
            left[v] -= n * times
            if not left[v]:
                del left[v]
    return found


def places(found: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Lookup rows sorted by (length, first): which sequences take which numbers of a length, and where."""
    rows, taken, sequence = [], {}, 0
    for times, fill in found:
        offset = 0
        for length, need in sorted(fill.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, sequence, need, offset))
            taken[length] = first + need * times
            offset += length * need
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "sequence", "need", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (any columns, among them `length` from 1 to `window`) plus sequence_id and offset."""
    held = write_through(cut.withColumn("_mid", F.monotonically_increasing_id()))
    # At most one row per length up to the window.
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    look = places(patterns(counts, window))
    numbered = position_in_group(held, ["length"], "_mid", "_nth", span=1 << 33)
    names = list(cut.columns)
    kept = numbered.select(*names, F.col("length").alias("_length"), (F.col("_nth") - 1).alias("_nth"))
    schema = cut.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (look["length"].astype(np.uint64) << np.uint64(48)) + look["first"].astype(np.uint64)
        for batch in batches:
            length, nth = batch.column("_length").to_numpy(), batch.column("_nth").to_numpy()
            at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(48)) + nth.astype(np.uint64), "right") - 1
            past = nth - look["first"][at]
            sequence = look["sequence"][at] + past // look["need"][at]
            offset = look["offset"][at] + past % look["need"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return kept.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack whole documents; an empty table packs to nothing."""
    return pack(pieces(without_own_names(docs), path or vocabulary()))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed_documents(table(spark, folder, "documents"))
