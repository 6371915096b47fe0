"""SimHash near-duplicate detection with pigeonring filtering.

A document's fingerprint is the 64-bit majority vote of its shingles' XXH64 values.
Two fingerprints link when they differ in at most `max_bits` bits; documents of one
connected component share a component_id.

Candidate search.  A fingerprint is a ring of `SEGMENTS` segments.  If two
fingerprints differ in at most t bits, some segment i starts a chain whose
cumulative differences stay within the proportional budgets floor(l*t/m) for every
chain length l = 1..m (the strong pigeonring principle).  With t = 4 and m = 5 the
budgets are 0, 1, 2, 3, 4: segment i is equal and segment i+1 differs in one bit at
most, so one half of segment i+1 is equal too.  The join key is therefore
(i, segment i, half of segment i+1) - about 20 bits, ten keys per fingerprint - and
every candidate is led along the rest of the chain, segment by segment, and leaves where it
is over a budget; the last length is the full Hamming check.

Scale.  Exact copies collapse to one fingerprint before the search (partial
aggregation).  A bucket is never expanded into all its pairs: inside a bucket a
breadth-first walk emits one star per connected group.  A bucket of more than
`block_rows` fingerprints is split in hash blocks, and every pair of blocks is a task
of its own, so no bucket is gathered whole and no link is lost.

Similarity.  Copies that share 0.8 of their shingles differ in about ten of 64 bits, where
ring segments are too short to search by.  `similar_links` therefore lays the ring over the
sets of shingles themselves, whose Hamming distance is what the similarity bounds: shingles
are dealt over the ring's segments by hash, and a chain begins at a segment without a
difference, whose content is the join key (set_keys()).  A key holds a few shingles that a
passage shared by chance rarely fills alone, so there are no hot anchors.  Documents that
share a key are compared by chains of budgets over a wider fingerprint (`WIDE` bits, of the
distinct shingles), segment by segment.  That estimate also lets less similar pairs through,
so it only forms groups: within each, the distinct shingle hashes themselves are compared,
and a link is a pair whose exact similarity is enough.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SEED = 42
#: Bit widths of the ring's segments, from the highest bit; their sum is 64.
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
_CHUNK = 1 << 15
#: Bits of the wide fingerprint, and how many 32-bit segments its ring has.
WIDE, WIDE_SEGMENTS = 256, 8
#: Segments without a difference that a ring must be expected to have (or one for certain).
ALIKE = 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def split_words(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_digests(words: list[bytes], shingle_words: int) -> Iterator[bytes]:
    """XXH64 of every shingle, repeats included, 8 bytes each, in chunks."""
    if not words:
        return
    line = b" ".join(words)
    if len(words) <= shingle_words:
        yield xxhash.xxh64_digest(line, SEED)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    a, b = starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(a), _CHUNK):
        yield b"".join([digest(line[x:y], SEED) for x, y in zip(a[at : at + _CHUNK], b[at : at + _CHUNK])])


def fingerprint(text: str | None, shingle_words: int = 4) -> bytes:
    """The fingerprint, 8 bytes from the highest; null or wordless text: zero."""
    return _fingerprint(split_words(text), shingle_words)


def _fingerprint(words: list[bytes], shingle_words: int) -> bytes:
    votes, count = np.zeros(64, np.int64), 0
    for got in shingle_digests(words, shingle_words):
        bits = np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
        count += len(bits)
    return np.packbits(2 * votes > count).tobytes()


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return _shingle_set(split_words(text), shingle_words)


def _shingle_set(words: list[bytes], shingle_words: int) -> np.ndarray:
    parts = [np.frombuffer(got, ">u8").astype(np.uint64) for got in shingle_digests(words, shingle_words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_digest(h: np.ndarray) -> bytes:
    """Names a set of shingles."""
    return xxhash.xxh3_128_digest(h.tobytes())


def wide_sketch(h: np.ndarray) -> bytes:
    """The fingerprint of WIDE bits of a set of shingles."""
    votes = np.zeros(WIDE, np.int64)
    for at in range(0, len(h), _CHUNK):
        own = h[at : at + _CHUNK]
        words = np.stack([_mixed(own, k) for k in range(WIDE // 64)], axis=1)
        votes += np.unpackbits(words.view(np.uint8).reshape(len(own), -1), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(h)).tobytes()


def wide_budget(similarity: float) -> int:
    """Differing bits that sets of this similarity keep under (two and a half deviations)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(WIDE * share + 2.5 * math.sqrt(WIDE * share * (1 - share)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp bigint) for every row; other columns of `docs` are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = b"".join(fingerprint(t.as_py(), shingle_words) for t in batch.column(1))
            fps = np.frombuffer(got, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _offsets() -> list[int]:
    """Distance of each segment from the lowest bit."""
    return [64 - sum(WIDTHS[: i + 1]) for i in range(SEGMENTS)]


def ring_keys(fp: Column) -> Column:
    """array<bigint> of the ten chain keys of a fingerprint."""
    low = _offsets()
    seg = lambda at, bits: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
    keys = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        upper = WIDTHS[j] // 2
        for half, (at, bits) in enumerate(((low[j] + WIDTHS[j] - upper, upper), (low[j], WIDTHS[j] - upper))):
            tag = F.lit((2 * i + half) << _TAG).cast("bigint")
            keys.append(tag + F.shiftleft(seg(low[i], WIDTHS[i]), 20) + seg(at, bits))
    return F.array(*keys)


def chain_passes(parts: Callable[[int], np.ndarray], rows: np.ndarray, starts: np.ndarray, segments: int, max_diff: int, pruned: np.ndarray | None = None) -> np.ndarray:
    """The rows whose chain from their start keeps within the proportional budgets to its end.

    `parts(k, rows)` gives the differences of those rows in segment k.  A chain of length l
    may have floor(l * max_diff / segments) differences; rows over it leave at once, so the
    later segments of most rows are never looked at.  What passes the last length has had
    the full check.  `pruned`, if given, counts the rows that left at each length.
    """
    total = np.zeros(len(rows), np.int64)
    for length in range(1, segments + 1):
        total += parts((starts + length - 1) % segments, rows)
        ok = total <= length * max_diff // segments
        if pruned is not None:
            pruned[length - 1] += int((~ok).sum())
        if not ok.all():
            rows, starts, total = rows[ok], starts[ok], total[ok]
        if not len(rows):
            break
    return rows


_LOW = np.array([64 - sum(WIDTHS[: i + 1]) for i in range(SEGMENTS)], np.uint64)
_MASK = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)


def within(x: np.ndarray, max_bits: int, start: np.ndarray | int, pruned: np.ndarray | None = None) -> np.ndarray:
    """True where the differing bits `x` keep within the budgets of the chain that begins at segment `start` (of each row, or of all).

    Two fingerprints of at most max_bits differing bits pass for some start, namely that of
    a key they share; what passes differs in at most max_bits bits.
    """
    found = np.zeros(len(x), bool)
    parts = lambda k, rows: np.bitwise_count((x[rows] >> _LOW[k]) & _MASK[k])
    found[chain_passes(parts, np.arange(len(x)), np.broadcast_to(start, len(x)), SEGMENTS, max_bits, pruned)] = True
    return found


def wide_within(x: np.ndarray, max_bits: int, start: np.ndarray | int = 0, pruned: np.ndarray | None = None) -> np.ndarray:
    """True for rows of differing bits (four 64-bit words each) with a chain, from any segment, within its budgets; `start` is not used."""
    words = np.ascontiguousarray(x).view(np.uint32)
    found = np.zeros(len(x), bool)
    parts = lambda k, rows: np.bitwise_count(words[rows, k])
    for begin in range(WIDE_SEGMENTS):  # each start tries what no other has found
        rest = np.flatnonzero(~found)
        if not len(rest):
            break
        found[chain_passes(parts, rest, np.full(len(rest), begin), WIDE_SEGMENTS, max_bits, pruned)] = True
    return found


# ---------------------------------------------------------------- rings of shingle sets


def set_budget(larger: int, similarity: float) -> int:
    """Most shingles in which two sets of at most `larger` shingles differ at this similarity."""
    return int(2 * larger * (1 - similarity) / (1 + similarity) + 1e-9)


@lru_cache(maxsize=4096)
def ring_segments(budget: int) -> int:
    """Segments of the ring for sets that differ in at most `budget` shingles.

    One more than the budget always leaves a segment without a difference.  For large
    budgets fewer do: shingles are dealt over the segments by hash, so segment after
    segment has none with probability exp(-budget / segments), and enough segments are
    taken to expect `ALIKE` of them.
    """
    m = 1
    while m < budget + 1 and m * math.exp(-budget / m) < ALIKE:
        m += max(1, m // 32)
    return min(m, budget + 1)


@lru_cache(maxsize=64)
def _class_bounds(similarity: float) -> list[int]:
    """Least sizes of the size classes; a set is at most 1 / similarity times the size of another it is similar to."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] / similarity)))
    return bounds


def set_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """The ring keys of a set of distinct shingle hashes, as int64.

    A pair of similar sets is compared in the class of the larger.  A set therefore has
    keys in its own class, and in those above that hold sets it can be similar to.  In a
    class, the ring's segments are those of its budget, and the key of a segment is the
    hash of what the set has there: two sets share it where their chain of budgets begins,
    at a segment without a difference.  Empty segments are no evidence and give no key; to
    make up for them small sets are dealt over several rings.
    """
    bounds = _class_bounds(similarity)
    own = bisect.bisect_right(bounds, len(h)) - 1
    out = []
    for c in range(own, len(bounds) - 1):
        if bounds[c] * similarity > len(h) + 1e-9 and c > own:
            break
        m = ring_segments(set_budget(bounds[c + 1] - 1, similarity))
        for ring in range(4 if m <= 8 else 2 if m <= 32 else 1):
            z = _mixed(h, 2 * (64 * c + ring))
            at = (z % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, at, _mixed(h, 2 * (64 * c + ring) + 1))
            full = np.flatnonzero(np.bincount(at, minlength=m))
            out.append(_mixed(sums[full] ^ (full.astype(np.uint64) << np.uint64(32)), 64 * c + ring))
    return np.concatenate(out).view(np.int64)


def _mixed(z: np.ndarray, step: int) -> np.ndarray:
    """A finaliser of each value plus so many steps."""
    z = z + np.uint64((int(_MIX[0]) * (step + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def bucket_links(fps: np.ndarray, max_bits: int, within: Callable = within, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Stars (root, member) with the connectivity of all links among `fps`."""
    left, roots, members = np.arange(len(fps)), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.flatnonzero(within(fps[left] ^ fps[queue.pop()], max_bits, start))
            if len(near):
                got = left[near]
                roots.append(np.full(len(got), root))
                members.append(got)
                queue.extend(got.tolist())
                left = np.delete(left, near)
    none = np.zeros(0, np.int64)
    return (np.concatenate(roots), np.concatenate(members)) if roots else (none, none)


_SMALL = 6
_TAG = 40  # bits of a key below the mark of where its chain begins


def _links(max_bits: int, within: Callable):
    """Batches (key, pair, node, fingerprint), sorted by key and pair, to links of nodes."""

    def of(keys: np.ndarray, starts: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys sorted, whole buckets; `starts` are the segments that keys begin at."""
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        size = np.repeat(sizes, sizes)
        a, b = [], []
        for lag in range(1, _SMALL):  # small buckets: all of them at once
            near = np.flatnonzero((keys[lag:] == keys[:-lag]) & (size[lag:] <= _SMALL))
            near = near[within(fps[near] ^ fps[near + lag], max_bits, starts[near])]
            a.append(nodes[near])
            b.append(nodes[near + lag])
        for k in np.flatnonzero(sizes > _SMALL):
            own = slice(first[k], first[k] + sizes[k])
            r, m = bucket_links(fps[own], max_bits, within, int(starts[first[k]]))
            a.append(nodes[own][r])
            b.append(nodes[own][m])
        return np.concatenate(a), np.concatenate(b)

    def words(column: pa.Array) -> np.ndarray:
        if pa.types.is_integer(column.type):
            return column.to_numpy().view(np.uint64)
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def out(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            ids = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
            a, b = of(ids, keys[:, 0] >> (_TAG + 1), nodes, fps)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = (np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), batch.column(2).to_numpy(), words(batch.column(3)))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            changed = (held[0] != held[0][-1]).any(axis=1)
            ended = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
            if ended:
                yield out(*(x[:ended] for x in held))
                held = tuple(x[ended:] for x in held)
        if held is not None:
            yield out(*held)

    return run


def _search(keys: DataFrame, max_bits: int, block_rows: int, within: Callable) -> DataFrame:
    """Links (a, b) among the nodes of each key, for rows (key, node, fp)."""
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    blocks = F.ceil(F.col("n") / block_rows)
    own = F.pmod(F.xxhash64("node"), F.coalesce(blocks, F.lit(1)))
    dealt = keys.join(hot, "key", "left").withColumn("own", own).withColumn(
        "pair",
        F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda o: F.least(o, F.col("own")) * blocks + F.greatest(o, F.col("own")))
        ),
    )
    dealt = dealt.select("key", F.explode("pair").alias("pair"), "node", "fp")
    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return dealt.mapInArrow(_links(max_bits, within), "a bigint, b bigint").distinct()


def fingerprint_links(fps: DataFrame, max_bits: int = 4, block_rows: int = 4096) -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose components are those of all links.

    `fps` has one column fp, each value once.
    """
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be from 0 to {SEGMENTS - 1}: more needs more segments")
    keys = fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), F.col("fp").alias("node"), "fp")
    return _search(keys, max_bits, block_rows, within)


def exact_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, index) at least this similar, with the connectivity of all such pairs.

    `sets` are arrays of distinct values, none empty.  A walk from each set in turn reaches its true
    neighbours; what it reached leaves the comparison.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(int(flat.max()) + 1, bool)
    left, own = np.arange(len(sets)), flat  # sets not yet reached, and their values
    a, b = [], []
    while len(left) > 1:
        queue, own, left = [int(left[0])], own[sizes[left[0]] :], left[1:]
        while queue and len(left):
            u = queue.pop()
            mine = flat[ends[u] - sizes[u] : ends[u]]
            marked[mine] = True
            shared = np.add.reduceat(marked[own], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            marked[mine] = False
            near = shared >= similarity * (sizes[u] + sizes[left] - shared) - 1e-9
            if near.any():
                a.append(np.full(int(near.sum()), u))
                b.append(left[near])
                queue.extend(left[near].tolist())
                own = own[np.repeat(~near, sizes[left])]
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _exact_search(sets: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """Links (a, b) among the nodes of each key, for rows (key, node, hashes).

    A key of many rows is split in hash blocks as in _search(): in up to 16 from `block_rows` / 16
    rows on, in more beyond `block_rows` rows or 32 MB a block.
    """
    n, parts = F.col("n"), F.col("parts")
    parts_of = F.greatest(F.least(F.ceil(16 * n / block_rows), F.lit(16)), F.ceil(n / block_rows), F.ceil(F.col("bytes") / (32 << 20)))
    hot = sets.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("hashes")).alias("bytes")).select("key", parts_of.alias("parts")).filter(parts > 1)
    dealt = sets.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce(parts, F.lit(1))))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda o: F.least(o, F.col("own")) * parts + F.greatest(o, F.col("own")))
    dealt = dealt.withColumn("pair", F.when(parts.isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs))
    dealt = dealt.select("key", F.explode("pair").alias("pair"), "node", "hashes")
    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            a, b = exact_links(sets, similarity)
            ids = np.array(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        for batch in batches:
            for key, pair, node, hashes in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if (key, pair) != at:
                    if len(sets) > 1:
                        yield from out()
                    at, nodes, sets = (key, pair), [], []
                nodes.append(node)
                sets.append(np.frombuffer(hashes.as_py(), np.uint64))
        if len(sets) > 1:
            yield from out()

    return dealt.mapInArrow(run, "a bigint, b bigint").filter("a <> b").distinct()


_SKETCH = "id bigint, fp bigint, digest binary, name bigint, wide binary, keys array<bigint>"
_SEEN = 100_000  # sets remembered in a task; forgetting one only costs rows


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_words: int = 4, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row for every row: the fingerprint of near_duplicates(), and of the set of shingles a digest, a 64-bit name, the wide fingerprint and ring keys.

    Of equal sets in a task, the first has the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(at, 1024), []
                for d, t in zip(part.column(0).to_pylist(), part.column(1)):
                    words = split_words(t.as_py())
                    fp = int.from_bytes(_fingerprint(words, fingerprint_words), "big", signed=True)
                    h = _shingle_set(words, shingle_words)
                    digest = set_digest(h)
                    keys = set_keys(h, similarity) if len(h) and digest not in seen else np.zeros(0, np.int64)
                    if len(seen) < _SEEN:
                        seen.add(digest)
                    rows.append((d, fp, digest, int.from_bytes(digest[:8], "big", signed=True), wide_sketch(h), keys))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split(" ")[0] for f in _SKETCH.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SKETCH)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name), sorted, to those whose key has another name, each once; a run may be of any length."""
    last: tuple[int, int] | None = None  # the row before this batch, and whether it went out
    out = True
    for batch in batches:
        if not batch.num_rows:
            continue
        key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            key, name = np.r_[last[0], key], np.r_[last[1], name]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        key, name = key[fresh], name[fresh]
        same = key[1:] == key[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        went = last is not None and out
        keep = shared.copy()
        if last is not None:
            keep[0] = shared[0] and not went
        # the last row may yet find a partner, so it is not counted as gone unless it has one
        last, out = (int(key[-1]), int(name[-1])), bool(shared[-1]) or (went and len(key) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(name[keep])], ["key", "name"])


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, block_rows: int = 4096, each: DataFrame | None = None) -> DataFrame:
    """(a, b) pairs of ids with the connectivity of documents at least this similar.

    Similarity is that of the sets of shingles, computed exactly for every link.  Documents of
    one set count as the one of the smallest id, and are linked with it.  Rows with a null id
    take no part.  `each` are their stored sketches(), made here if not given.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [(set_digest(h), h.tobytes()) for h in (shingle_set(t.as_py(), shingle_words) for t in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], ["node", "digest", "hashes"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    each = materialize(sketches(rows, "id", "text", 4, shingle_words, similarity), "sketches") if each is None else each
    # of equal sets that of a null id may have the keys; names, not ids, are what keys stand for
    named = each.filter("id is not null")
    reps = materialize(named.groupBy("digest").agg(F.min("id").alias("node"), F.min("name").alias("name"), F.min("wide").alias("fp")), "distinct-sketches")
    copies = named.select("id", "digest").join(reps.select("digest", "node"), "digest").filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    dealt = each.select(F.explode("keys").alias("key"), "name").repartition("key").sortWithinPartitions("key", "name")
    shared = materialize(dealt.mapInArrow(_shared, "key bigint, name bigint"), "shared-keys")
    # nothing is near a wordless text but another, which has the same set
    keys = shared.join(reps.select("name", "node", "fp"), "name").select("key", "node", "fp")
    groups = connected_components(materialize(_search(keys, wide_budget(similarity), block_rows, wide_within), "wide-links"))
    near = materialize(reps.select("digest", "node").join(groups, "node").select("digest", "node", F.col("root").alias("key")), "wide-groups")
    few = rows.join(near.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    sets = materialize(few.mapInArrow(whole, "node bigint, digest binary, hashes binary"), "shingle-sets")
    sets = sets.join(near, ["node", "digest"]).dropDuplicates(["node", "digest"]).select("key", "node", "hashes")
    return copies.union(_exact_search(sets, similarity, block_rows))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4, block_rows: int = 4096) -> DataFrame:
    """One row per row of `docs`: id, fp (bigint), component_id (its component's smallest id).

    Null and wordless texts have fingerprint zero and link like any other.  Repeated
    rows each return a row.  A null id takes no part in the smallest id.  An empty table
    gives an empty result.  Columns of `docs` other than id and text are not read.
    """
    return _near_duplicates(materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints"), max_bits, block_rows)


def _near_duplicates(each: DataFrame, max_bits: int, block_rows: int) -> DataFrame:
    reps = materialize(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    edges = materialize(fingerprint_links(reps.select("fp"), max_bits, block_rows), "links")
    roots = connected_components(edges)  # node, root
    linked = reps.join(roots, reps["fp"] == roots["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    merged = linked.join(least, "root").select(F.col("fp").alias("node"), "component")
    of = reps.join(merged, reps["fp"] == merged["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    of = materialize(of, "components")
    return each.join(of, "fp").select("id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = 0.8, shingle_words: int = 4, max_bits: int = 4, block_rows: int = 4096) -> DataFrame:
    """`docs` with one row of each group of near duplicates: that of the smallest id.

    Groups are those of near_duplicates(), joined by those of similar_links() unless
    `similarity` is None.  Rows that repeat an id stay once.  Rows with a null id can't be
    named, so they stay.
    """
    made = fingerprints(docs, id_col, text_col, shingle_words) if similarity is None else sketches(docs, id_col, text_col, shingle_words, similarity=similarity)
    each = materialize(made, "sketches")
    found = _near_duplicates(each.select("id", "fp"), max_bits, block_rows).filter("id is not null")
    merged = materialize(found.filter(F.col("id") != F.col("component_id")).select("id", "component_id").distinct(), "merged")
    dropped = merged.select(F.col("id").alias("_gone"))
    if similarity is not None:
        # links are moved to their components' smallest ids, so copies are no nodes here
        links = similar_links(docs, id_col, text_col, similarity=similarity, block_rows=block_rows, each=each)
        for end in ("a", "b"):
            links = links.join(merged.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("component_id", end)).drop("component_id")
        groups = connected_components(materialize(links.filter("a <> b").distinct(), "near-links"))
        dropped = dropped.union(groups.filter("node <> root").select("node"))
    rows = docs.join(dropped, docs[id_col] == dropped["_gone"], "left_anti")
    repeated = found.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_again"))
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, rows[id_col] == repeated["_again"], "left_semi").dropDuplicates([id_col])
    return rows.join(repeated, rows[id_col] == repeated["_again"], "left_anti").unionByName(once)
