"""N-gram Jaccard join by PartEnum signatures: documents whose shingle sets have a similarity of 0.8 or more.

Sizes are cut into bands of a ratio of 1.25, so similar sets lie in one band or in neighbouring
ones; every set carries the signatures of its own band and of the next. Two sets of a band's
sizes differ in at most k features if they are similar. The feature domain is cut into n1 * n2
ranges of the features' hashes. By the pigeonhole principle similar sets differ by at most
k2 = (k + 1) / n1 - 1 features in one of the n1 first-level parts, and there agree on some n2 - k2
of its n2 second-level parts: each such choice of parts, with what a set holds in them, is one
signature, and similar sets share at least one.

Signatures are shuffled as packed arrays of six bytes each: half a hash, whose other half says
where it goes, and the place of the text. Texts are never shuffled, pairs bring both their sets
to one task, and what a step shuffled goes from the disks when it ends. What shares a signature is settled in this order, so
that large groups of copies cost what they hold and not their pairs: rows of equal sets are one
set; each set is compared with the one leader it shares most signatures with; sets that are not
connected yet meet per signature with a sketch, whose differing bits never exceed the
differing features, and those with a partner meet again with a finer one: first each set is
compared with the closest of some other components, then all
remaining pairs of different components that the sketch allows are compared exactly.
Signatures shared by very many sets are cut into those of a second, independent choice of
parts, and what is still large into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.llm.components import components
from verdictlake.llm.rows import RID, identified, join_narrow, split_words, table, without_own_names
from verdictlake.scale import shuffles_removed, write_through

SHINGLE = 5
K2, N2 = 1, 3
GOLD = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES, SLICE_ROWS = 4 << 20, 4096
BUCKET, MOST = 1 << 18, 1 << 22
CROWD = 2048
LEVELS = 3
COARSE, FINE = 3, 12
CHUNK, SMALL, WAYS = 20_000, 48, 4
SHARE = 10_000
WORD_BITS = 64

# Largest size of each band: sets of similarity 0.8 lie in one band or in neighbours.
_tops = [1]
while _tops[-1] < 1 << 40:
    _tops.append((_tops[-1] + 1) * 5 // 4)
TOPS = np.array(_tops, np.int64)


def times(k: int) -> np.uint64:
    """GOLD * k modulo 2 ** 64."""
    return np.uint64(int(GOLD) * int(k) % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def marks(start: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row `offset` rows after that of `start`."""
    return mixed(start + GOLD * offset).view(np.int64)


def places(rid: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's start of its file, and its place from there."""
    file, at = (rid.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in "fi")
    return mixed(file), at


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of bounded rows and text; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, min(int(np.searchsorted(ends, before + most, "right")), start + rows))
            yield batch.slice(start, end - start)
            start = end


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Per text the rising 64-bit hashes of its distinct word shingles, A-Z lower-cased.

    Fewer words than `size` are one shingle; no words or a null text give an empty set.
    """
    index, forms, offsets = split_words(texts, lower=True)
    words = forms.cast(pa.binary()).to_pylist()
    word = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))[index]
    whole = word[:max(0, len(word) - size + 1)].copy()
    for k in range(1, size):
        whole = mixed(whole + times(size)) + word[k:k + len(whole)]
    whole = mixed(whole)
    found = []
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= size:
            found.append(np.unique(whole[a:b - size + 1]))
        elif b > a:
            short = word[a:a + 1].copy()
            for k in range(a + 1, b):
                short = mixed(short + times(b - a)) + word[k:k + 1]
            found.append(mixed(short + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def band(n: int) -> int:
    return int(np.searchsorted(TOPS, n))


def differences(tag: int) -> int:
    """Most features in which similar sets of up to the band's largest size differ."""
    return int(TOPS[tag]) * 2 // 9


@lru_cache(maxsize=256)
def _scheme(tag: int, seed: int, k2: int = K2, n2: int = N2) -> tuple[np.ndarray, int, int, np.ndarray, np.ndarray]:
    """Starts of all parts but the first, n1, n2, the chosen parts of each subset, and a number per signature."""
    k = differences(tag)
    k2 = min(k2, k)
    n1, n2 = -(-(k + 1) // (k2 + 1)), n2 if k else 1
    parts = np.uint64(n1 * n2)
    j = np.arange(1, n1 * n2, dtype=np.uint64)
    starts = (((j << np.uint64(32)) + parts - np.uint64(1)) // parts) << np.uint64(32)
    chosen = np.zeros((n2, 0), np.uint64) if n2 <= k2 else np.array(
        [[p in c for c in combinations(range(n2), n2 - k2)] for p in range(n2)], np.uint64)
    ids = np.arange(n1 * chosen.shape[1], dtype=np.uint64).reshape(n1, -1)
    return starts, n1, n2, chosen, mixed(ids + (np.uint64(tag) << np.uint64(40)) + (np.uint64(seed) << np.uint64(56)) + np.uint64(1))


def signatures(found: np.ndarray, seed: int = 0) -> np.ndarray:
    """All signatures of a set: those of its own band and of the next."""
    if not len(found):
        return found
    features = np.sort(mixed(found ^ times(seed))) if seed else found
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(features ^ GOLD), dtype=np.uint64)])
    out = []
    for tag in (band(len(found)), band(len(found)) + 1):
        starts, n1, n2, chosen, number = _scheme(tag, seed)
        edges = np.concatenate([sums[:1], sums[np.searchsorted(features, starts)], sums[-1:]])
        parts = np.diff(edges).reshape(n1, n2)
        out.append(mixed((parts @ chosen) ^ number).ravel())
    return np.concatenate(out)


def signature_count(n: int) -> int:
    return 0 if not n else sum(_scheme(t, 0)[4].size for t in (band(n), band(n) + 1))


def sketch(found: np.ndarray, cells: int = COARSE) -> bytes:
    """Parities of the features' counts over a power of two of cells; a differing feature flips one bit.

    `cells` are those per feature that similar sets may differ in.
    """
    cells = max(64, 1 << int(cells * (differences(band(len(found))) + 1) - 1).bit_length())
    at = ((found * GOLD) >> np.uint64(20)).astype(np.int64) & (cells - 1)
    return np.packbits(np.bincount(at, minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes], group: np.ndarray) -> np.ndarray:
    """Sketches as rows of 64-bit words, those of a group folded to its shortest and filled up with zeros."""
    own = np.array([len(x) // 8 for x in sketches])
    least = np.full(group[-1] + 1, own.max())
    np.minimum.at(least, group, own)
    wanted = least[group]
    out = np.zeros((len(sketches), wanted.max()), np.uint64)
    for size, width in set(zip(own.tolist(), wanted.tolist())):
        rows = np.flatnonzero((own == size) & (wanted == width))
        words = np.frombuffer(b"".join([sketches[k] for k in rows]), np.uint64).reshape(len(rows), -1, width)
        out[rows, :width] = np.bitwise_xor.reduce(words, axis=1)
    return out


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != text_col], F.coalesce(F.col(text_col), F.lit("")).alias("_t"))


def traits(rows: DataFrame, text_col: str) -> DataFrame:
    """(_rid, _id, key, same, n, sketch): the row's number, one that rows of equal shingle sets share, the set's size and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_t"):
            sets = shingle_sets(piece.column("_t"))
            same = np.fromiter((xxhash.xxh64_intdigest(f.tobytes(), 7) for f in sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays(
                [piece.column(RID), piece.column("_id"), pa.array(marks(*places(piece.column(RID)))), pa.array(same.view(np.int64)),
                 pa.array([len(f) for f in sets], pa.int64()), pa.array([sketch(f) for f in sets], pa.binary())],
                names=[RID, "_id", "key", "same", "n", "sketch"])

    source = _texts(rows.select(RID, "_id", text_col), text_col)
    number = F.lit(0).cast("bigint")
    schema = source.drop("_t").withColumns({"key": number, "same": number, "n": number, "sketch": F.lit(b"")}).schema
    return source.mapInArrow(run, schema)


def packed_signatures(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, start, sigs, keys, owners): signatures of many texts at a time, as arrays.

    `sigs` are the lower halves of the signatures, the upper ones give the bucket. `owners` are rows
    from `start` on, or indexes of `keys` where the texts are not of rows close to each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_t"):
            start, at = places(piece.column(RID))
            base = at.min()
            near = (start == start[0]).all() and at.max() - base < 1 << 16
            start, keys = start + times(base), marks(start, at)
            each = [signatures(f) for f in shingle_sets(piece.column("_t"))]
            sigs = np.concatenate(each)
            owners = np.repeat((at - base if near else np.arange(len(each))).astype(np.uint16), [len(s) for s in each])
            bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            sigs, owners, bucket = sigs.astype(np.uint32)[order], owners[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            found = []
            for a, b in zip(edge, [*edge[1:], len(bucket)]):
                of, own = (keys[:0], owners[a:b]) if near else np.unique(owners[a:b], return_inverse=True)
                found.append((int(bucket[a]), int(start[0].view(np.int64)), sigs[a:b].tobytes(), (of if near else keys[of]).tobytes(), own.astype(np.uint16).tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), *[pa.binary()] * 3))],
                                                 names=["bucket", "start", "sigs", "keys", "owners"])

    return rows.mapInArrow(run, "bucket bigint, start bigint, sigs binary, keys binary, owners binary")


def _unpacked(bucket: int, held: list[tuple[int, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(sig, key) of packed rows of a bucket, the signatures as the bucket and their lower halves."""
    starts, sigs, keys, owners = zip(*held)
    count = np.array([len(x) // 4 for x in sigs])
    own = np.frombuffer(b"".join(owners), np.uint16)
    key = marks(np.repeat(np.array(starts, np.int64).view(np.uint64), count), own.astype(np.uint64))
    end = np.cumsum(count)
    for k in (k for k, x in enumerate(keys) if x):
        at = slice(end[k] - count[k], end[k])
        key[at] = np.frombuffer(keys[k], np.int64)[own[at]]
    return np.frombuffer(b"".join(sigs), np.uint32) + (np.array([bucket], np.uint64) << np.uint64(32)), key


def _shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(sig, key, lead) of signatures that two or more sets have; the lead is theirs of the smallest mixed key.

    Buckets are even unless a signature is common to very many sets: those above `most` are
    handed on row by row, without a lead.
    """
    held, size, last = [], 0, None
    for batch in batches:
        for bucket, start, sigs, keys, owners in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last:
                if held:
                    yield from _led(*_unpacked(last, held))
                held, size, last = [], 0, bucket
            size += len(sigs) // 4
            held.append((start, sigs, keys, owners))
            if size > most:
                for row in held:
                    sig, key = _unpacked(bucket, [row])
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(key), pa.nulls(len(key), pa.int64())], names=["sig", "key", "lead"])
                held = []
    if held:
        yield from _led(*_unpacked(last, held))


def _led(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    same = np.concatenate([[False], sig[1:] == sig[:-1], [False]])
    some = np.flatnonzero(same[1:] | same[:-1])
    if not len(some):
        return
    sig, key = sig[some], key[some]
    order = np.lexsort((mixed(key.view(np.uint64)), sig))
    sig, key = sig[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lead = np.repeat(key[first], np.diff(np.append(first, len(sig))))
    yield from pa.table({"sig": sig.view(np.int64), "key": key, "lead": lead}).to_batches(max_chunksize=50_000)


def spread(many: DataFrame, one: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, share: int = 10_000) -> DataFrame:
    """Join to a one-row-per-key table; keys counted above `share` rows are dealt over several tasks.

    The rows of such a key are salted and its one row repeated, once per `share` rows; there
    are at most rows / share of these keys. `counted` is a narrow written table with the rows'
    keys, by default `many` itself, and its other columns choose the salt.
    """
    counted = many if counted is None else counted
    hot = write_through(counted.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > share).select(
        key, F.ceil(F.col("_rows") / F.lit(share)).alias("_parts")))
    if hot.isEmpty():
        return many.join(one, key, how)
    draw = F.xxhash64(*[c for c in counted.columns if c != key])
    salted = join_narrow(many, hot, [key], "left", 16).withColumn(
        "_salt", F.when(F.col("_parts").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(draw, F.col("_parts")))).drop("_parts")
    repeated = join_narrow(one, hot, [key], "left", 16).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


BLOCK = ["sig", "u", "v"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks of a task's sorted rows, some thousand rows or one block at a time, with each row's block number."""
    held, rows = [], 0

    def whole(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(table), bool)
        for c in BLOCK:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        end = len(table) if last else (starts[-1] if len(starts) else 0)
        if end:
            yield table.slice(0, end), np.cumsum(new)[:end]
        rest = table.slice(end)
        held, rows = rest.to_batches(), len(rest)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            yield from whole(False)
    if rows:
        yield from whole(True)


def _close(table: pa.Table, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of all pairs i < j of a block that are of different roots and that sizes and sketches allow."""
    size = np.bincount(group)
    first = np.cumsum(size) - size
    root, n, own = (table[c].to_numpy() for c in ("root", "n", "own"))
    low, high = np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)
    if (low == high).all():
        return
    across = table["u"].to_numpy() != table["v"].to_numpy()
    bits = _folded(table["sketch"].to_pylist(), group)

    def allowed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (root[i] != root[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & ((own[i] != own[j]) | ~across[i])
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = 9 * apart <= n[i] + n[j]
        return i[ok], j[ok], apart[ok]

    # Small blocks all at once, rows at each distance in turn; large ones some rows at a time.
    rows = np.flatnonzero(((low != high) & (size <= SMALL))[group])
    distance = 1
    while len(rows):
        rows = rows[rows + distance < len(group)]
        rows = rows[group[rows] == group[rows + distance]]
        yield allowed(rows, rows + distance)
        distance += 1
    for g in np.flatnonzero((low != high) & (size > SMALL)):
        step = max(1, (1 << 21) // (size[g] * bits.shape[1]))
        for a in range(first[g], first[g] + size[g], step):
            end = min(a + step, first[g] + size[g])
            i, j = np.meshgrid(np.arange(a, end), np.arange(a, first[g] + size[g]), indexing="ij")
            later = i < j
            yield allowed(i[later], j[later])


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, u, v, own, key) of a block that have a possible partner in it."""
    for table, group in _blocks(batches):
        some = np.zeros(len(table), bool)
        for i, j, _ in _close(table, group):
            some[i] = some[j] = True
        if some.any():
            yield from table.select([*BLOCK, "own", "key"]).filter(pa.array(some)).to_batches()


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, other, root, apart) for each row that has possible partners in its block: the closest set of each of the WAYS closest roots."""
    for table, group in _blocks(batches):
        key, root = table["key"].to_numpy(), table["root"].to_numpy()
        best = [np.zeros(0, np.int64)] * 3

        def reduced(parts: list[np.ndarray]) -> list[np.ndarray]:
            i, j, apart = parts
            order = np.lexsort((j, apart, root[j], i))
            i, j, apart = i[order], j[order], apart[order]
            lead = np.ones(len(i), bool)
            lead[1:] = (i[1:] != i[:-1]) | (root[j[1:]] != root[j[:-1]])
            i, j, apart = i[lead], j[lead], apart[lead]
            order = np.lexsort((j, apart, i))
            i, j, apart = i[order], j[order], apart[order]
            near = np.ones(len(i), bool)
            near[WAYS:] = i[WAYS:] != i[:-WAYS]
            return [i[near], j[near], apart[near]]

        held, size = [], 0
        for i, j, apart in _close(table, group):
            held.append([np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])])
            size += 2 * len(i)
            if size > 1 << 20:
                best, held, size = reduced([np.concatenate(c) for c in zip(best, *held)]), [], 0
        i, j, apart = reduced([np.concatenate(c) for c in zip(best, *held)])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[i], key[j], root[j], apart)], names=["key", "other", "root", "apart"])


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of a block's sets that are possible partners."""
    for table, group in _blocks(batches):
        key = table["key"].to_numpy()
        for i, j, _ in _close(table, group):
            if len(i):
                yield _pairs(key[i], key[j])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _sets(texts: DataFrame) -> DataFrame:
    """(key, found): the rising shingle hashes of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_t"):
            yield pa.RecordBatch.from_arrays([pa.array(marks(*places(piece.column(RID)))), pa.array(
                [f.tobytes() for f in shingle_sets(piece.column("_t"))], pa.binary())], names=["key", "found"])

    return texts.mapInArrow(run, "key bigint, found binary")


def _others(texts: DataFrame, seed: int) -> DataFrame:
    """(key, found): the signatures of each text by another choice of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_t"):
            keys = pa.array(marks(*places(piece.column(RID))))
            found = [signatures(f, seed) for f in shingle_sets(piece.column("_t"))]
            ends = np.cumsum([0, *map(len, found)])
            for a in range(0, len(found), 64):
                b = min(a + 64, len(found))
                values = pa.array(np.concatenate(found[a:b]).view(np.int64))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array((ends[a:b + 1] - ends[a]).astype(np.int32)), values)], names=["key", "found"])

    return texts.mapInArrow(run, "key bigint, found array<bigint>")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs of sorted rows (a, b, found), two a pair, whose sets have a similarity of 0.8 or more."""
    last, first = None, b""
    for batch in batches:
        kept = []
        for pair, found in zip(zip(*(batch.column(c).to_pylist() for c in "ab")), batch.column("found").to_pylist()):
            if pair != last:
                last, first = pair, found
                continue
            x, y = np.frombuffer(first, np.uint64), np.frombuffer(found, np.uint64)
            # |x & y| / |x | y| >= 4 / 5, in whole numbers; no count is that high if sizes differ by more.
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)):
                kept.append(pair)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["a", "b"])


def _fine(texts: DataFrame) -> DataFrame:
    """(key, n, sketch) with the finer sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_t"):
            sets = shingle_sets(piece.column("_t"))
            yield pa.RecordBatch.from_arrays([pa.array(marks(*places(piece.column(RID)))), pa.array([len(f) for f in sets], pa.int64()), pa.array(
                [sketch(f, FINE) for f in sets], pa.binary())], names=["key", "n", "sketch"])

    return texts.mapInArrow(run, "key bigint, n bigint, sketch binary")


class Join:
    """One run over `identified` rows; holds the written tables that its steps share."""

    def __init__(self, rows: DataFrame, id_col: str, text_col: str, crowd: int = CROWD, most: int = MOST):
        self.rows = rows.select(RID, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        self.crowd, self.most = crowd, most
        self.marked = write_through(traits(self.rows, "_text"))
        head = F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col(RID).alias("rid"), "key")
        self.firsts = write_through(self.marked.filter("n > 0").groupBy("same").agg(
            F.min(head).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("key", F.col("first.key")))

    def texts(self, keys: DataFrame | None = None) -> DataFrame:
        """(_rid, _t): one text per set, of all sets or of those in `keys`.

        The wanted rows are bits of words of 64 rows, so the words of 128 million rows are still
        sent to where the texts are.
        """
        firsts = self.firsts if keys is None else self.firsts.join(keys, "key", "left_semi")
        file, at = F.col(f"{RID}.f").alias("_file"), F.col(f"{RID}.i")
        word, bit = F.shiftright(at, WORD_BITS.bit_length() - 1).alias("_word"), at.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
        wanted = write_through(firsts.select(F.col("first.rid").alias(RID)).select(
            file, word, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy("_file", "_word").agg(F.bit_or("_bit").alias("_bits")))
        rows = join_narrow(self.rows.select(RID, "_text", file, word), wanted, ["_file", "_word"], "inner", 32)
        return _texts(rows.filter(F.getbit("_bits", bit) == 1).select(RID, "_text"), "_text")

    def shared(self) -> DataFrame:
        """(sig, key, lead) of all signatures that two or more sets have."""
        sizes = self.firsts.groupBy("n").agg(F.count(F.lit(1)).alias("sets"))
        # At most one row per band reaches the driver: the signatures of a set follow from its band.
        below = F.size(F.filter(F.array(*[F.lit(int(t)) for t in TOPS]), lambda t: t < F.col("n")))
        bands = sizes.groupBy(below.alias("band")).agg(F.sum("sets").alias("sets")).collect()
        total = sum(r["sets"] * signature_count(int(TOPS[r["band"]])) for r in bands)
        packed = packed_signatures(self.texts(), max(1, -(-total // BUCKET)))
        most = self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _shared(batches, most)

        found = write_through(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig bigint, key bigint, lead bigint"))
        plain = found.filter("lead is null").select("sig", "key")
        if plain.isEmpty():
            return found
        leads = write_through(plain.groupBy("sig").agg(F.min_by("key", F.xxhash64("key")).alias("lead"), F.count(F.lit(1)).alias("sets")).filter("sets > 1").drop("sets"))
        return write_through(found.filter("lead is not null").unionByName(spread(plain, leads, "sig")))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the written, distinct pairs (a, b) of sets that have a similarity of 0.8 or more."""
        sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
        sets = _sets(self.texts(sides.select("key").distinct()))
        if sides.groupBy("key").count().filter(F.col("count") > SHARE).isEmpty():
            both = join_narrow(sets, sides, ["key"], "inner", 24)
        else:
            # A common leader is in many pairs: those pairs are spread.
            both = spread(write_through(sides), sets, "key", share=SHARE)
        return both.select("a", "b", "found").repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_alike, "a bigint, b bigint")

    def finer(self, crowded: DataFrame, seed: int) -> DataFrame:
        """Crowded signatures cut by those of another choice of parts: similar sets share one of these too."""
        crowded = write_through(crowded)
        other = _others(self.texts(crowded.select("key").distinct()), seed).select("key", F.explode("found").alias("_also"))
        return crowded.join(other, "key").select(F.xxhash64("sig", "_also").alias("sig"), "key", "root")

    def dealt(self, rooted: DataFrame) -> DataFrame:
        """(sig, u, v, own, key): signatures of sets of several roots in blocks of bounded size, each pair of blocks a group."""
        ready = []
        for seed in range(1, LEVELS + 1):
            several = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
            rooted = write_through(rooted.join(several.select("sig", "size"), "sig"))
            crowded = rooted.filter(F.col("size") > self.crowd).drop("size")
            if seed == LEVELS or crowded.isEmpty():
                ready.append(rooted)
                break
            ready.append(rooted.filter(F.col("size") <= self.crowd))
            rooted = write_through(self.finer(crowded, seed))
        blocks = F.ceil(F.col("size") / F.lit(self.crowd)).cast("int")
        whole = None
        for r in ready:
            part = r.select("sig", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("own"))
            whole = part if whole is None else whole.unionByName(part)
        return whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "sig", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "key")

    def met(self, dealt: DataFrame, sketches: DataFrame, known: DataFrame, run, schema: str) -> DataFrame:
        """`run` over the blocks of `dealt`, their sets with size, sketch and root."""
        # Joined by a shuffle on the key: rows of one key lie together then, and their equal sketches pack well in the next one.
        rows = join_narrow(dealt.join(sketches.hint("merge"), "key"), known, ["key"], "left", 16).withColumn("root", F.coalesce("root", "key"))
        return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, schema)

    def roots(self) -> DataFrame:
        """(key, root) of every set that has a link."""
        def grouped(links: DataFrame) -> DataFrame:
            return write_through(components(links).select(F.col("node").alias("key"), "root"))

        shared = self.shared()
        common = shared.filter("key <> lead").groupBy("key", "lead").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        best = common.groupBy("key").agg(F.max_by("lead", F.struct("times", "lead")).alias("lead"))
        links = write_through(self.similar(write_through(best.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct())))
        known = grouped(links)
        rooted = join_narrow(shared.select("sig", "key"), known, ["key"], "left", 16).select("sig", "key", F.coalesce("root", "key").alias("root"))
        block = "sig bigint, u int, v int, own int, key bigint"
        rows = write_through(self.met(self.dealt(rooted), self.firsts.select("key", "n", "sketch"), known, _with_partner, block))
        fine = write_through(_fine(self.texts(rows.select("key").distinct())))
        # A set is compared with a few others in all, however many signatures it shares: the closest of each of its closest components.
        met = self.met(rows, fine, known, _closest, "key bigint, other bigint, root bigint, apart bigint")
        lead = met.groupBy("key", "root").agg(F.min(F.struct("apart", "other")).alias("near"))
        ranked = lead.withColumn("way", F.row_number().over(Window.partitionBy("key").orderBy("near"))).filter(F.col("way") <= WAYS)
        near = write_through(ranked.select(F.least("key", "near.other").alias("a"), F.greatest("key", "near.other").alias("b")).distinct())
        links = links.unionByName(write_through(self.similar(near)))
        known = grouped(links)
        left = write_through(self.met(rows, fine, known, _allowed, "a bigint, b bigint").distinct())
        return self.compared(left.join(near, ["a", "b"], "left_anti"), links, known, grouped)

    def compared(self, left: DataFrame, links: DataFrame, known: DataFrame, grouped) -> DataFrame:
        """(key, root) after comparing the pairs `left`, some per set and round, but for pairs connected meanwhile."""
        width = 16
        while True:
            a, b = (known.select(F.col("key").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
            apart = join_narrow(join_narrow(left, a, ["a"], "left", 16), b, ["b"], "left", 16).filter(
                F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
            turn = write_through(apart.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))))
            if turn.isEmpty():
                return known
            links = links.unionByName(write_through(self.similar(write_through(turn.filter(F.col("turn") <= width).select("a", "b")))))
            known = grouped(links)
            left, width = turn.filter(F.col("turn") > width).select("a", "b"), 4 * width


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """`identified` docs (but for columns named with a leading underscore), and per row (_rid, n, id): its set's size and the smallest id its links reach.

    Rows link when their sets of distinct five-word shingles (A-Z lower-cased; fewer words are
    one shingle) have a Jaccard similarity of 0.8 or more; rows of equal sets are linked, so
    repeated rows are. Null, empty and blank texts have empty sets and link with nothing. Null
    ids rank after all others; a group of null ids has a null id. Columns of `docs` other than
    the two are not read, so they may have any name. An empty table gives no rows. Shingles and
    sets are compared by 64-bit hashes.
    """
    with shuffles_removed(docs.sparkSession):
        rows = identified(without_own_names(docs))
        run = Join(rows, id_col, text_col, **options)
        first = F.struct("first.late", "first.id").alias("first")
        settled = write_through(run.firsts.join(run.roots(), "key", "left").select("same", F.coalesce("root", "key").alias("root"), first))
        heads = settled.groupBy("root").agg(F.min("first").alias("head"))
        named = write_through(spread(settled, heads, "root").select("same", F.col("head.id").alias("_head")))
        met = spread(run.marked.select("same", RID, "_id", "n"), named, "same", "left")
    return rows, met.select(RID, "_id", "n", F.when(F.col("n") > 0, F.col("_head")).otherwise(F.col("_id")).alias("id"))


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    _, found = linked(table(spark, folder, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                   ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS f FROM w),
g AS (SELECT doc_id, len(f) AS n, unnest(f) AS f FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.f = b.f AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a)
SELECT s.doc_id, len(f)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
"""
