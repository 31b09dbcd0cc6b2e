"""SimHash near-duplicates: fingerprints, a binary-trie self-join, connected components.

Fingerprints that differ in at most three of 64 bits agree on at least one of their four
16-bit quarters. Each quarter in turn is the top of a trie, and its value picks one of many
sub-tries, which tasks join with themselves: node pairs are walked down together, differing
bits are added up, and a pair is left as soon as they exceed the budget. A sub-trie with too
many fingerprints is cut again by quarters of its remaining bits, by the same argument, so
no near-copy group is gathered whole. Tasks emit spanning links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.components import components
from verdictlake.llm.rows import RID, identified, join_narrow, own_names, table
from verdictlake.scale import write_through

BUDGET = 3
SHINGLE = 3
HOT = 1000
#: Bits left below the shared top, and the widths of the four parts they are cut into next.
LEVELS = ((48, (12, 12, 12, 12)), (36, (9, 9, 9, 9)), (27, (7, 7, 7, 6)))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of all word shingles, repeats included; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return fingerprint_of(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of `rows` plus `fp`, the fingerprint as a signed 64-bit integer."""
    source = rows.select(*keep, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    schema = source.drop("_text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), np.uint64, batch.num_rows)
            kept = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=[*keep, "fp"])

    return source.mapInArrow(run, schema)


class Trie:
    """Sorted codes as an implicit binary trie: a node is a range of codes with equal leading bits."""

    def __init__(self, codes: np.ndarray, budget: int):
        self.codes, self.budget = codes, budget

    def join(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs within the budget, inside each of the given nodes at `depth`."""
        a = b = np.stack([lo, hi], 1).astype(np.int64)
        diff = np.zeros(len(a), np.int64)
        left, right = [], []
        for bit in range(depth, 65):
            few = (a[:, 1] - a[:, 0]) * (b[:, 1] - b[:, 0]) <= 16
            for x, y in self._pairs(a[few], b[few]):
                left.append(x)
                right.append(y)
            a, b, diff = a[~few], b[~few], diff[~few]
            if not len(a):
                break
            ones = np.concatenate([[0], np.cumsum((self.codes >> np.uint64(63 - bit)) & np.uint64(1))]).astype(np.int64)
            a, b, diff = self._step(a, b, diff, ones)
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        wide_a, wide_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        count = wide_a * wide_b
        if not count.sum():
            return
        node = np.repeat(np.arange(len(a)), count)
        at = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
        x, y = a[node, 0] + at // wide_b[node], b[node, 0] + at % wide_b[node]
        near = (x < y) & (np.bitwise_count(self.codes[x] ^ self.codes[y]) <= self.budget)
        yield x[near], y[near]

    def _step(self, a, b, diff, ones):
        def halves(n):
            mid = n[:, 1] - (ones[n[:, 1]] - ones[n[:, 0]])
            return np.stack([n[:, 0], mid], 1), np.stack([mid, n[:, 1]], 1)

        same = a[:, 0] == b[:, 0]
        a0, a1 = halves(a)
        b0, b1 = halves(b)
        cross = ~same  # the mirror image of a node with itself is not walked
        out = [(a0, b0, diff), (a1, b1, diff), (a0, b1, diff + 1), (a1[cross], b0[cross], diff[cross] + 1)]
        a, b, diff = (np.concatenate(part) for part in zip(*out))
        alive = (a[:, 1] > a[:, 0]) & (b[:, 1] > b[:, 0]) & (diff <= self.budget)
        alive &= (a[:, 0] != b[:, 0]) | (a[:, 1] - a[:, 0] > 1)
        return a[alive], b[alive], diff[alive]


def spanning(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _join_tasks(batches: Iterator[pa.RecordBatch], budget: int, chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.concat_tables(parts)
    t, rest, code, fp = (whole[c].to_numpy() for c in ("t", "rest", "code", "fp"))
    code = code.view(np.uint64)
    order = np.lexsort((code, t))
    t, rest, code, fp = t[order], rest[order], code[order], fp[order]
    top = code >> rest.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (top[1:] != top[:-1])]))
    last = np.concatenate([first[1:], [len(t)]])
    several = last - first > 1
    first, last = first[several], last[several]
    begin = 0
    while begin < len(first):  # sub-tries of one depth, some thousands of fingerprints at a time
        end = begin + 1
        while end < len(first) and rest[first[end]] == rest[first[begin]] and last[end] - first[begin] <= chunk:
            end += 1
        lo, hi = first[begin], last[end - 1]
        x, y = Trie(code[lo:hi], budget).join(first[begin:end] - lo, last[begin:end] - lo, 64 - int(rest[lo]))
        if len(x):
            label = spanning(hi - lo, x, y)
            linked = np.flatnonzero(label != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(fp[lo:hi][linked]), pa.array(fp[lo:hi][label[linked]])], names=["a", "b"])
        begin = end


def _top():
    return F.expr("shiftrightunsigned(code, rest)")


def links(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all fingerprints within `budget` differing bits; `prints` has distinct `fp`.

    The quarters prove completeness for budgets up to 3. Sub-tries of more than `hot`
    fingerprints are cut finer up to three times.
    """
    if budget > 3:
        raise ValueError("four parts find all pairs only up to three differing bits")
    turned = F.array(*[
        F.struct(F.lit(k).alias("t"), (F.shiftleft("fp", 16 * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * k)) if k else F.col("fp")).alias("code"))
        for k in range(4)])
    level = prints.select("fp", F.explode(turned).alias("x")).select("fp", "x.t", "x.code")
    done = []
    for rest, widths in LEVELS:
        level = level.withColumn("rest", F.lit(rest)).withColumn("top", _top())
        many = write_through(level.groupBy("t", "top").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("t", "top"))
        if many.isEmpty():
            done.append(level)
            level = None
            break
        done.append(join_narrow(level, many, ["t", "top"], "left_anti", 16))
        large = join_narrow(level, many, ["t", "top"], "left_semi", 16)
        parts, below = [], rest
        for k, width in enumerate(widths):
            below -= width
            # Move this part of the remaining bits right under the shared top.
            part = F.shiftrightunsigned("code", below).bitwiseAND(F.lit((1 << width) - 1))
            upper = F.shiftrightunsigned(F.col("code"), below + width).bitwiseAND(F.lit((1 << (rest - below - width)) - 1))
            lower = F.col("code").bitwiseAND(F.lit((1 << below) - 1))
            code = F.shiftleft("top", rest).bitwiseOR(F.shiftleft(part, rest - width)).bitwiseOR(F.shiftleft(upper, below)).bitwiseOR(lower)
            # Parts may differ in width, so each has its own number of bits left.
            parts.append(F.struct((F.col("t") * 4 + 4 + k).alias("t"), code.alias("code"), F.lit(rest - width).alias("rest")))
        level = large.select("fp", F.explode(F.array(*parts)).alias("x")).select("fp", "x.t", "x.code", "x.rest")
    if level is not None:
        done.append(level.withColumn("top", _top()))
    tries = done[0]
    for more in done[1:]:
        tries = tries.unionByName(more)
    dealt = tries.repartition("t", "top").select("t", "rest", "code", "fp")
    return dealt.mapInArrow(lambda batches: _join_tasks(batches, budget), "a bigint, b bigint")


def groups(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(fp, root) of every fingerprint of a group of two or more; `prints` has distinct `fp`."""
    return components(links(prints, budget, hot)).select(F.col("node").alias("fp"), "root")


def near_groups(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of `identified` rows (_rid, id, fp), and per fingerprint its group's first row.

    The second table has fp and first, a struct of the group's smallest id and that row's
    _rid; null ids come after all others. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows have equal fingerprints. Both are empty for an empty table.
    """
    marked = write_through(fingerprints(rows.select(RID, F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), [RID, "_id"], "_t"))
    order = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col(RID).alias("rid"))
    prints = write_through(marked.groupBy("fp").agg(F.min(order).alias("first")))
    grouped = groups(prints.select("fp"), **options)
    rooted = write_through(prints.join(grouped, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return marked, rooted.join(heads, "root").select("fp", "head")


@own_names
def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of `docs` without all but the first of each near-duplicate group; see `near_groups`."""
    rows = identified(docs)
    marked, heads = near_groups(rows, id_col, text_col, **options)
    kept = write_through(marked.join(heads, "fp").filter(F.col("head.rid") != F.col(RID)).select(RID))
    return join_narrow(rows, kept, [RID], "left_anti", 24).select(*docs.columns)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marked, heads = near_groups(identified(table(spark, folder, "documents")))
    return marked.join(heads, "fp").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.id").alias("component_id"))
