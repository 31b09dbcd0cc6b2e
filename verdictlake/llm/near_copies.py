"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash finds them first: sets whose 64-bit fingerprints meet in the trie self-join of `simhash`
are candidates and are compared exactly, set against set. Fingerprints of such documents may
differ in more bits than any trie join of 64 bits can afford, so an exact way follows for the rest,
and every pair is found or connected through others. Under any common order of shingles, two
sets of that similarity share one of their first n - ceil(0.8 n) + 1 shingles (their prefixes);
rare shingles come first, by a count over hashed cells of bounded number, so common passages
are seldom in a prefix. Documents not connected yet meet by the shingles of their prefixes. The
first shingle that two sets share bounds what they share by what each has from there on, so two
sets that share a shingle late in their prefixes are no candidates by it, and a row of a shingle
without any candidate there goes before it is joined to anything. First
each shingle links its documents to one of them, drawn anew for each shingle, which connects large
groups at a cost that follows their size; then each document of a shingle meets the one of another
group whose sketch is closest; at last all pairs of documents that share a prefix shingle, are not
connected yet and may be similar by their sketches are compared.

Before whole sets are fetched for a comparison, pairs go whose sketches already rule it out: a
sketch holds a bit per cell of the hashes' lowest bits, set where a cell has an odd number of the
set's hashes. Each hash that only one of two sets has turns one bit, so two sketches never differ
in more bits than the sets differ by, and with some bits a hash hardly in fewer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm import simhash
from verdictlake.llm.components import components
from verdictlake.llm.rows import RID, identified, join_narrow, own_names
from verdictlake.scale import write_through

SHINGLE = 5
CELLS = 1 << 18
#: Bytes of a sketch: a power of two of about half the set's size, within these bounds.
SKETCH = (64, 2048)
CHUNK = 20_000


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 (seed 42) of all word shingles, rising; fewer words than `size` are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = {b" ".join(words)} if len(words) < size else set(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)))


def prefix_length(n: int) -> int:
    """First shingles of which two sets of similarity 0.8, one of size n, must share one."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.withColumn("_text", F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def sketch(found: np.ndarray) -> np.ndarray:
    """Whether the number of hashes is odd, a bit per cell of their lowest bits."""
    size = SKETCH[0]
    while size < min(len(found) // 2, SKETCH[1]):
        size *= 2
    return np.packbits(np.bincount((found % np.uint64(8 * size)).astype(np.int64), minlength=8 * size) & 1)


def folded(sketches: np.ndarray, to: int) -> np.ndarray:
    """Sketches, one a row, as they are at `to` bytes: cells of equal lower bits add up."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, to), 1)


def may_be_similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether the sketches of sets of n and m hashes allow the similarity; the finer one is folded, which bounds less, never more."""
    size = min(len(x), len(y))
    p, q = (folded(np.frombuffer(s, np.uint8)[None], size) for s in (x, y))
    # Similar sets differ in at most a ninth of both sizes.
    return 9 * int(np.bitwise_count(p ^ q).sum()) <= n + m


def keyed(rows: DataFrame, text_col: str) -> DataFrame:
    """(_rid, _id, key, fp, n, sketch): rows of equal shingle sets have equal keys; the set's fingerprint, size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("_text")]
            keys, prints = (np.fromiter(map(f, sets), np.uint64, len(sets)) for f in (_key, simhash.fingerprint_of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(RID), batch.column("_id"), pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64)),
                 pa.array([len(found) for found in sets], pa.int32()), pa.array([sketch(found).tobytes() for found in sets], pa.binary())],
                names=[RID, "_id", "key", "fp", "n", "sketch"])

    source = _texts(rows, text_col).select(RID, "_id", "_text")
    shape = source.drop("_text").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("key", "bigint"), ("fp", "bigint"), ("n", "int"), ("sketch", "binary"))]).schema
    return source.mapInArrow(run, shape)


def cell_counts(rows: DataFrame, text_col: str) -> np.ndarray:
    """Documents' shingles per cell of their hashes, CELLS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for batch in batches:
            for t in batch.column("_text"):
                np.add.at(sums, (shingle_set(t.as_py()) % np.uint64(CELLS)).astype(np.int64), 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    cells = _texts(rows, text_col).select("_text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out


def prefixes(rows: DataFrame, counts: np.ndarray, text_col: str) -> DataFrame:
    """(h, key, n, rest): the prefix shingles of every row with its key, the size of its set and how many of it come from this one on."""
    counts = counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, keys, sizes, rests = [], [], [], []
            for t in batch.column("_text"):
                found = shingle_set(t.as_py())
                n = len(found)
                # A stable sort: equal counts stay in order of the hashes.
                order = np.argsort(counts[(found % np.uint64(CELLS)).astype(np.int64)], kind="stable")
                hashes.append(found[order[:prefix_length(n)]])
                keys.append(_key(found))
                sizes.append(n)
                rests.append(np.arange(n, n - len(hashes[-1]), -1, dtype=np.int32))
            long = [len(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(hashes or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(np.array(keys, np.uint64), long).view(np.int64)),
                pa.array(np.repeat(np.array(sizes, np.int32), long)), pa.array(np.concatenate(rests or [np.zeros(0, np.int32)]))], names=["h", "key", "n", "rest"])

    return _texts(rows, text_col).select("_text").mapInArrow(run, "h bigint, key bigint, n int, rest int")


def _buckets(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of a task's distinct rows ordered by h and key, first and end of each h of two or more keys."""
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return [np.zeros(0, np.int64)] * len(columns), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = pa.concat_tables(parts)
    found = [whole[c].to_numpy() for c in columns]
    h, key = found[:2]
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
    found = [c[order][new] for c in found]
    h = found[0]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    end = np.append(first[1:], len(h))
    several = end - first > 1
    return found, first[several], end[several]


def _fits(n, m, rest, other):
    """Whether sets of n and m shingles that first share one with `rest` and `other` of them from there on may be similar."""
    # They share at least four ninths of both sizes. Whole sets from there on fit if 5 * min(n, m) >= 4 * max(n, m).
    return 9 * np.minimum(rest, other) >= 4 * (n + m)


def _with_partner(bucket: np.ndarray, n: np.ndarray, rest: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether each row has one of another root in its bucket that `_fits` it. Buckets are numbered and rising.

    Row i needs a j whose size lies in a range, by i alone, and whose 9 rest - 4 n is 4 n_i or more. Rows are
    ordered by size; the two largest such numbers of different roots are kept for all runs of 2 ** k rows,
    two of which cover any range, so the cost is rows times the logarithm of the largest bucket.
    """
    if not len(n):
        return np.zeros(0, bool)
    order = np.lexsort((n, bucket))
    bucket, n, rest, root = bucket[order].astype(np.int64), n[order].astype(np.int64), rest[order].astype(np.int64), root[order]
    _, bucket = np.unique(bucket, return_inverse=True)
    wide = int(n.max()) + 2
    at = bucket * wide + n
    low = np.searchsorted(at, bucket * wide + (4 * n + 4) // 5, "left")
    high = np.searchsorted(at, bucket * wide + np.clip(np.minimum(5 * n // 4, (9 * rest - 4 * n) // 4), 0, wide - 1), "right")
    level = np.frexp(np.maximum(high - low, 1).astype(float))[1] - 1
    least, found = np.iinfo(np.int64).min, np.zeros(len(n), bool)
    best, second, whose = 9 * rest - 4 * n, np.full(len(n), least), root

    def joined(a, b):
        """The largest number, the largest of another root and the root of the largest, of two runs each."""
        (p, p2, r), (q, q2, s) = a, b
        first = p >= q
        return np.where(first, p, q), np.where(first, np.maximum(p2, np.where(r == s, q2, q)), np.maximum(q2, np.where(r == s, p2, p))), np.where(first, r, s)

    for k in range(int(level.max()) + 1):
        rows = np.flatnonzero((level == k) & (high > low))
        a, b = low[rows], high[rows] - (1 << k)
        most, other, own = joined((best[a], second[a], whose[a]), (best[b], second[b], whose[b]))
        found[rows] = np.where(own == root[rows], other, most) >= 4 * n[rows]
        if (1 << k) >= len(best):
            break
        half = 1 << k
        best, second, whose = joined((best[:-half], second[:-half], whose[:-half]), (best[half:], second[half:], whose[half:]))
    out = np.empty(len(n), bool)
    out[order] = found
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that another key with their h fits, with `lead`, one of those keys, and its size drawn by h."""
    (h, key, n, rest), first, end = _buckets(batches, ("h", "key", "n", "rest"))
    size = end - first
    bucket = np.repeat(np.arange(len(first)), size)
    rows = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    some = _with_partner(bucket, n[rows], rest[rows], key[rows])
    rows, bucket = rows[some], bucket[some]
    _, bucket, size = np.unique(bucket, return_inverse=True, return_counts=True)
    h, key, n, rest = h[rows], key[rows], n[rows], rest[rows]
    mixed = (key.view(np.uint64) ^ h.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((mixed * np.uint64(0xBF58476D1CE4E5B9), bucket))
    lead = order[(np.cumsum(size) - size)[bucket]] if len(order) else order
    whole = pa.table({"h": h, "key": key, "n": n, "rest": rest, "lead": key[lead], "lead_n": n[lead]})
    yield from whole.to_batches(max_chunksize=50_000)


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose h has keys of different roots; `rest`, if there, says which of them have a partner that fits: the others go."""
    batches = [b for b in batches if b.num_rows]
    names = batches[0].schema.names if batches else ["h", "key", "n", "root"]
    columns, first, end = _buckets(batches, names)
    if not len(first):
        return
    root, edges = columns[names.index("root")], np.stack([first, end], 1).ravel()
    # Each second segment is a bucket; the one past the last row is cut off.
    low, high = (f.reduceat(np.append(root, root[-1]), edges)[::2] for f in (np.minimum, np.maximum))
    some = low != high
    size = (end - first)[some]
    rows = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    found = dict(zip(names, (c[rows] for c in columns)))
    if "rest" in found:
        kept = _with_partner(np.repeat(np.arange(len(size)), size), found["n"], found["rest"], found["root"])
        found = {name: c[kept] for name, c in found.items()}
    yield from pa.table(found).to_batches(max_chunksize=50_000)


def _runs(batches: Iterator[pa.RecordBatch], column: str, rows: int = CHUNK) -> Iterator[pa.Table]:
    """A task's sorted rows in tables of some thousand rows that end where the column changes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            h = whole[column].to_numpy()
            end = int(np.searchsorted(h, h[-1]))
            if end:
                yield whole.slice(0, end)
            held, size = whole.slice(end).to_batches(), len(whole) - end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _open_places(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of rows with one h, of different roots, whose sizes, places of h and sketches allow the similarity, and how far the sketches differ.

    Rows are ordered by h; in one result no place comes twice as i, or twice as j.
    """
    h, n, root = (table[c].to_numpy() for c in ("h", "n", "root"))
    n = n.astype(np.int64)
    rest = table["rest"].to_numpy().astype(np.int64) if "rest" in table.column_names else n
    cells = table["sketch"].to_pylist()
    long = np.fromiter(map(len, cells), np.int64, len(cells))
    place, folds = np.zeros(len(cells), np.int64), {}
    for size in np.unique(long).tolist():
        at = np.flatnonzero(long == size)
        place[at] = np.arange(len(at))
        folds[size, size] = np.frombuffer(b"".join([cells[k] for k in at]), np.uint64).reshape(len(at), -1)

    def at_size(size: int, to: int) -> np.ndarray:
        if (size, to) not in folds:
            folds[size, to] = folded(folds[size, size], to // 8)
        return folds[size, to]

    rows = np.flatnonzero(h[1:] == h[:-1])
    distance = 1
    while len(rows):
        other = rows + distance
        fits = (root[rows] != root[other]) & _fits(n[rows], n[other], rest[rows], rest[other])
        i, j = rows[fits], other[fits]
        apart = np.zeros(len(i), np.int64)
        for size, wide in set(zip(long[i].tolist(), long[j].tolist())):
            to = min(size, wide)
            for at in np.array_split(np.flatnonzero((long[i] == size) & (long[j] == wide)), 1 + len(i) // 4096):
                apart[at] = np.bitwise_count(at_size(size, to)[place[i[at]]] ^ at_size(wide, to)[place[j[at]]]).sum(1, dtype=np.int64)
        kept = 9 * apart <= n[i] + n[j]
        if kept.any():
            yield i[kept], j[kept], apart[kept]
        distance += 1
        rows = rows[rows + distance < len(h)]
        rows = rows[h[rows] == h[rows + distance]]


def _closest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of `_open_pairs`, that with the least different sketch for each row: no more pairs than rows."""
    for table in _runs(batches, "h"):
        key = table["key"].to_numpy()
        least, partner = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), -1)
        for i, j, apart in _open_places(table):
            for one, other in ((i, j), (j, i)):
                closer = apart < least[one]
                least[one[closer]], partner[one[closer]] = apart[closer], other[closer]
        some = np.flatnonzero(partner >= 0)
        if len(some):
            low, high = np.minimum(key[some], key[partner[some]]), np.maximum(key[some], key[partner[some]])
            low, high = np.unique(np.stack([low, high], 1), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of keys with one h, of different roots, whose sizes and sketches allow the similarity; rows come ordered by h."""
    for table in _runs(batches, "h"):
        key = table["key"].to_numpy()
        for i, j, _ in _open_places(table):
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j])], names=["a", "b"])


def fingerprint_pairs(firsts: DataFrame) -> DataFrame:
    """(a, b) of keys: sets whose fingerprints meet in the trie join, each with the first of its fingerprint or sub-trie."""
    prints = firsts.groupBy("first.fp").agg(F.min("key").alias("lead"))
    equal = firsts.select("key", F.col("first.fp").alias("fp")).join(prints, "fp").select("key", "lead")
    links = simhash.links(prints.select("fp"))
    near = links.join(prints.select(F.col("fp").alias("a"), F.col("lead").alias("key")), "a").join(prints.select(F.col("fp").alias("b"), "lead"), "b")
    both = equal.unionByName(near.select("key", "lead")).filter("key <> lead")
    return both.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))


def allowed(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of keys whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            kept = pa.array([may_be_similar(*four) for four in zip(x, y, n, m)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    sides = [firsts.select(F.col("key").alias(k), F.col("first.n").alias(n), F.col("first.sketch").alias(s)) for k, n, s in (("a", "n", "x"), ("b", "m", "y"))]
    both = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a bigint, b bigint")


def similar(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """The distinct pairs (a, b) of keys whose shingle sets have a similarity of 0.8 or more."""
    pairs = write_through(allowed(pairs, firsts))
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    asked = write_through(firsts.join(keys, "key").select("key", F.col("first.rid").alias(RID)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column("key"), batch.column("_text")):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), pa.array([shingle_set(t.as_py()).view(np.int64)], pa.list_(pa.int64()))],
                                                 names=["key", "found"])

    texts = join_narrow(_texts(rows, text_col).select(RID, "_text"), asked, [RID], "inner", 32).select("key", "_text")
    sets = write_through(texts.mapInArrow(run, "key bigint, found array<bigint>"))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("found").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("found").alias("y")), "b")
    # |x & y| / |x | y| >= 4 / 5, in whole numbers.
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


@own_names
def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` without all but the first of each group of near copies, linked ones included.

    The first has the smallest id, null ids come last. Texts without words are copies of each other.
    """
    rows = identified(docs)
    source = rows.select(RID, F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    marked = write_through(keyed(source, "_t"))
    order = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col(RID).alias("rid"), "fp", "n", "sketch")
    firsts = write_through(marked.groupBy("key").agg(F.min(order).alias("first")))
    met = write_through(similar(fingerprint_pairs(firsts), firsts, source, "_t"))
    shared = write_through(prefixes(source, cell_counts(source, "_t"), "_t").repartition("h").mapInArrow(
        _shared, "h bigint, key bigint, n int, rest int, lead bigint, lead_n int"))
    fits = 5 * F.least("n", "lead_n").cast("bigint") >= 4 * F.greatest("n", "lead_n").cast("bigint")
    led = shared.filter((F.col("key") != F.col("lead")) & fits).select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))
    grouped = write_through(components(met))
    apart = led.distinct()
    for side in ("a", "b"):
        apart = join_narrow(apart, grouped.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), [side], "left", 16)
    led = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = write_through(met.unionByName(similar(led, firsts, source, "_t")))
    # The closest pairs connect what is left of large groups at a cost that follows their rows; then all pairs still open are compared.
    opened = shared.select("h", "key", "n", "rest")
    for finder in (_closest_pairs, _open_pairs):
        known = write_through(components(links).select(F.col("node").alias("key"), "root"))
        rooted = join_narrow(opened, known, ["key"], "left", 16).select("h", "key", "n", "rest", F.coalesce("root", "key").alias("root"))
        # Only rows that one of another component fits get their sketch, so pairs that it rules out are never rows.
        opened = write_through(rooted.repartition("h").mapInArrow(_open_rows, "h bigint, key bigint, n int, rest int, root bigint"))
        sketched = opened.join(firsts.select("key", F.col("first.sketch").alias("sketch")).hint("merge"), "key")
        found = sketched.select("h", "key", "n", "rest", "root", "sketch").repartition("h").sortWithinPartitions("h").mapInArrow(finder, "a bigint, b bigint")
        pairs = write_through(found.distinct())
        links = write_through(links.unionByName(similar(pairs, firsts, source, "_t")))
        # Every row with a partner is in a closest pair, so rows of other sets need no second sketch.
        met = write_through(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        opened = join_narrow(opened.select("h", "key", "n", "rest"), met, ["key"], "left_semi", 8)
    grouped = components(links).select(F.col("node").alias("key"), "root")
    settled = write_through(firsts.join(grouped, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")))
    heads = settled.groupBy("root").agg(F.min("first").alias("head"))
    gone = write_through(marked.join(settled.join(heads, "root").select("key", "head"), "key").filter(F.col("head.rid") != F.col(RID)).select(RID))
    return join_narrow(rows, gone, [RID], "left_anti", 24).select(*docs.columns)
