"""Exact Jaccard join of documents on word n-grams, as a metric-space join.

Documents with equal shingle sets are one point. Two points of n and m shingles that link at similarity t differ by at most
n - ceil(t n) of the first's shingles; a count over windows of the lowest hashes takes out points that can have no partner.
Pivots are documents: each shingle elects the least point that holds it. A point lives in the region of the pivot that has won most of
its shingles and, by the triangle inequality for the shingles by which two sets differ, visits every region that may hold a point
that links with it. Within a region documents are pivots again, now by Jaccard distance: Voronoi cells take in,
by the triangle inequality, every point that may link with a member, and are joined recursively and exactly;
points already connected need no comparison. Regions beyond a bounded size are split into cells by Spark first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, share, shared, small_batches
from cleargrain.llm.components import connected_components

N = 5
PERCENT = 80
#: Shingles that a task gathers before it sends them on, and those of a block of points.
FLUSH = 500_000
BLOCK_SHINGLES = 500_000
#: Bytes of texts that are shingled in one go, longer texts alone.
CHUNK_BYTES = 1 << 18
#: Tasks over which the points of one component, or the copies of one point, are dealt when names are joined back.
SALTS = 8
#: Buckets of shingles number 2 to this power at least; more as points grow.
LEAST_BUCKET_BITS = 6
#: Shingles of a region that one task solves; larger regions are split first.
REGION_SHINGLES = 2_000_000
LEAF = 12
MAX_PIVOTS = 64
BITMAP_BITS = 1 << 26

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct n-word shingles of a text, in rising order.

    A polynomial hash over the lower-case bytes, with prefix sums, gives all words at once; n mixed word hashes in a
    row, each times its place's own odd factor, give a shingle. Two shingles fall together with probability 2**-64. chunks() does the same
    for many texts, which it joins by spaces.
    """

    def __init__(self, n: int = N):
        self.n = n
        self.up, self.down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)
        self.factors = _powers(0xD6E8FEB86659FD93, n + 1)[1:]

    def words(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the words in order."""
        if not text:
            return np.zeros(0, np.uint64)
        return self._words(text.encode("utf-8", "surrogatepass"))[0]

    def _words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in order, and the byte at which each starts."""
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[raw]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = turns[::2], turns[1::2]
        if not len(start):
            return np.zeros(0, np.uint64), start
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw] + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64)), start

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        if len(words) < self.n:  # the whole sequence is one shingle; its length is part of it
            one = (words * self.factors[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
            return mix(np.array([one], dtype=np.uint64))
        last = len(words) - self.n + 1
        total = np.zeros(last, np.uint64)
        for k in range(self.n):
            total += words[k : k + last] * self.factors[k]
        return np.unique(mix(total))

    def chunks(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of about CHUNK_BYTES of the texts (UTF-8) at a time: the shingles, text after text, and how many each has."""
        held, size = [], 0
        for text in texts:
            held.append(text or b"")
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield self._many(held)
                held, size = [], 0
        if held:
            yield self._many(held)

    def _many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, start = self._words(b" ".join(texts))
        first_byte = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        edges = np.searchsorted(start, first_byte)
        count = np.diff(edges)
        own = np.repeat(np.arange(len(texts)), count)
        padded = np.concatenate([words, np.zeros(self.n - 1, np.uint64)])
        total = np.zeros(len(words), np.uint64)
        for k in range(self.n):
            total += padded[k : k + len(words)] * self.factors[k]
        short = np.flatnonzero((count > 0) & (count < self.n))
        for i in short:  # the whole sequence is one shingle; its length is part of it
            total[edges[i]] = (words[edges[i] : edges[i + 1]] * self.factors[: count[i]]).sum(dtype=np.uint64) + np.uint64(count[i])
        total = mix(total)
        first = edges[1:][own] - np.arange(len(words)) >= self.n
        for a, b in zip(edges, edges[1:] - self.n + 1):
            if b > a + 1:
                total[a:b].sort()
        first[1:] &= (total[1:] != total[:-1]) | (own[1:] != own[:-1])
        first[edges[short]] = True
        return total[first], np.bincount(own[first], minlength=len(texts))


def points_of(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number, a signed long, for each of the sets that lie one after the other in shingles; 0 for an empty one."""
    out = np.zeros(len(sizes), dtype=np.int64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(shingles), starts) + sizes[full].astype(np.uint64)).astype(np.int64)
    return out


def point_of(shingles: np.ndarray) -> int:
    """One number for a shingle set, as a signed long."""
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64)).astype(np.int64)[0])


def shared_needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any set that it links with."""
    return -(-percent * n // 100)


def window_size(n, percent: int = PERCENT):
    """Shingles with the lowest hashes that make up the window of a set of n."""
    return np.minimum(n, 2 * (n - shared_needed(n, percent)) + 1)


@lru_cache(maxsize=1 << 16)
def window_needed(n: int, percent: int = PERCENT) -> int:
    """Shingles of its window that a set of n shares at least with the window of any set that it links with.

    If two sets share c, the j-th of these is in the window of a set of k once j + (k - c) is no more than the window's size.
    """
    m = np.arange(shared_needed(n, percent), 100 * n // percent + 1)
    c = -(-percent * (n + m) // (100 + percent))
    both = np.minimum(window_size(n, percent) - (n - c), window_size(m, percent) - (m - c))
    return int(both[c <= np.minimum(n, m)].min())


def _send(parts: list[tuple[int, np.ndarray]], n_buckets: int) -> pd.DataFrame:
    """Shingles of points by bucket. What the points at hand share with each other is counted here, under a bucket below 0.

    Of a shingle that several points hold one entry goes on, marked as shared; so a shingle that very many documents
    hold makes one entry per task and flush. bucket, shingles (32 bits that follow the bucket's), places in the
    table of points (the top bit marks shared), the table.
    """
    bits = n_buckets.bit_length() - 1
    table = np.array([p for p, _ in parts], dtype=np.int64)
    s = mix(np.concatenate([w for _, w in parts]))  # windows hold low hashes; mixed again they fall evenly into buckets
    own = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(w) for _, w in parts])
    order = np.argsort(s)
    s, own = s[order], own[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    run = np.cumsum(first) - 1
    several = np.bincount(run) > 1
    counts = np.bincount(own[several[run]], minlength=len(table))
    s, own = s[first], own[first] | (several.astype(np.uint32) << np.uint32(31))
    short = ((s << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    edges = np.searchsorted((s >> np.uint64(64 - bits)).astype(np.int64), np.arange(n_buckets + 1))
    rows = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            place = own[a:b] & np.uint32(2**31 - 1)
            used, at = np.unique(place, return_inverse=True)
            rows.append((k, short[a:b].tobytes(), (at.astype(np.uint32) | (own[a:b] & np.uint32(1 << 31))).tobytes(), table[used].tobytes()))
    has = counts > 0
    if has.any():
        rows.append((-1 - int(table[0]) % n_buckets, b"", counts[has].astype(np.uint32).tobytes(), table[has].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "shingle", "place", "points"])


def _shared_counts(block: pd.DataFrame) -> pd.DataFrame:
    """point, shared: how many of a point's shingles in the bucket other points hold too; copies may count twice."""
    if block["bucket"].iloc[0] < 0:
        point = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in block["points"]])
        times = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in block["place"]])
        points, index = np.unique(point, return_inverse=True)
        return pd.DataFrame({"point": points, "shared": np.bincount(index, weights=times).astype(np.int64)})
    s = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in block["shingle"]])
    at = [np.frombuffer(b, dtype=np.uint32) for b in block["place"]]
    marked = np.concatenate(at) >> np.uint32(31) == 1
    point = np.concatenate([np.frombuffer(t, dtype=np.int64)[a & np.uint32(2**31 - 1)] for t, a in zip(block["points"], at)])
    order = np.argsort(s)
    s, point, marked = s[order], point[order], marked[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    run = np.cumsum(first) - 1
    differ = point != point[first][run]
    several = np.bincount(run, weights=differ | marked) > 0
    points, counts = np.unique(point[several[run] & ~marked], return_counts=True)
    return pd.DataFrame({"point": points, "shared": counts})


def shared_counts(rows: DataFrame, window, n_buckets: int) -> DataFrame:
    """point, shared for rows that window, a function of a batch, turns into (point, shingles) pairs."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, seen, held = [], set(), 0
        for batch in batches:
            for point, s in window(batch):
                if len(s) and point not in seen:
                    seen.add(point)
                    parts.append((point, s))
                    held += len(s)
                    if held > FLUSH:
                        yield _send(parts, n_buckets)
                        parts, seen, held = [], set(), 0
        if parts:
            yield _send(parts, n_buckets)

    dealt = rows.mapInPandas(deal, "bucket long, shingle binary, place binary, points binary")
    counted = dealt.groupBy("bucket").applyInPandas(_shared_counts, "point long, shared long")
    return counted.groupBy("point").agg(F.sum("shared").alias("shared"))


def spare(n, percent: int = PERCENT):
    """Shingles of a set of n that may lack in a set that it links with."""
    return n - (-(-percent * n // 100))


def pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points and their shingles in blocks of about BLOCK_SHINGLES: one row each, named by its least point."""
    points, sizes, blobs, held = [], [], [], 0

    def block() -> pd.DataFrame:
        p = np.array(points, dtype=np.int64)
        return pd.DataFrame({"block": [int(p.min())], "points": [p.tobytes()], "sizes": [np.array(sizes, dtype=np.int64).tobytes()], "shingles": [b"".join(blobs)]})

    for batch in batches:
        for p, blob in zip(batch["point"], batch["shingles"]):
            points.append(p)
            sizes.append(len(blob) // 8)
            blobs.append(blob)
            held += sizes[-1]
            if held > BLOCK_SHINGLES:
                yield block()
                points, sizes, blobs, held = [], [], [], 0
    if points:
        yield block()


def elect_pivots(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """block, bucket, key, pivot, times: the document pivot of each shingle that several points hold, told to every block that holds it.

    A shingle elects the least point that holds it. A block names one candidate a shingle, so a shingle that a third of all points
    hold makes one entry a block. Shingles are cut to 32 bits after the bucket's: two that fall together elect one pivot.
    """
    bits = n_buckets.bit_length() - 1

    def nominate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, points, sizes, blob in zip(batch["block"], batch["points"], batch["sizes"], batch["shingles"]):
                s = np.frombuffer(blob, dtype=np.uint64) >> np.uint64(32 - bits)
                own = np.repeat(np.frombuffer(points, dtype=np.int64), np.frombuffer(sizes, dtype=np.int64))
                order = np.argsort(s)
                s = s[order]
                starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                times = np.diff(np.append(starts, len(s))).astype(np.uint32)
                s, own = s[starts], np.minimum.reduceat(own[order], starts)
                key, edges = s.astype(np.uint32), np.searchsorted((s >> np.uint64(32)).astype(np.int64), np.arange(n_buckets + 1))
                rows = [(name, k, key[a:b].tobytes(), own[a:b].tobytes(), times[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["block", "bucket", "key", "pivot", "times"])

    def elect(bucket: pd.DataFrame) -> pd.DataFrame:
        key, point, times = (np.frombuffer(b"".join(bucket[c]), dtype=t) for c, t in (("key", np.uint32), ("pivot", np.int64), ("times", np.uint32)))
        ends = np.cumsum(bucket["key"].map(len).to_numpy() // 4)
        order = np.argsort(key)
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        run = np.empty(len(key), np.int64)
        run[order] = np.cumsum(first) - 1
        winner, total = np.minimum.reduceat(point[order], np.flatnonzero(first)), np.bincount(run, weights=times).astype(np.uint32)
        rows = []
        for name, a, b in zip(bucket["block"], np.concatenate([[0], ends[:-1]]), ends):
            r = run[a:b]
            r, k = r[total[r] > 1], key[a:b][total[r] > 1]
            if len(r):
                rows.append((name, bucket["bucket"].iloc[0], k.tobytes(), winner[r].tobytes(), total[r].tobytes()))
        return pd.DataFrame(rows, columns=["block", "bucket", "key", "pivot", "times"])

    schema = "block long, bucket int, key binary, pivot binary, times binary"
    return blocks.mapInPandas(nominate, schema).groupBy("bucket").applyInPandas(elect, schema)


def assign_regions(blocks: DataFrame, pivots: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """region, point, home, shingles: where each point lives and which regions it visits.

    How many of a set's shingles a pivot has won moves by no more between two sets than the shingles that one has and the other lacks. So a
    point with more than twice spare() of its shingles won by one pivot lives there alone, with the nearest such pivot, and whatever links
    with it has at least spare() + 1 shingles there: points visit all pivots that have won so many. A point without
    such a pivot lives with the pivots of its spare() + 1 rarest shingles, one of which it shares with any
    other such point that it links with. Points of whose shingles too few are shared at all have no partner.
    """
    bits = n_buckets.bit_length() - 1

    def settle(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["region", "point", "home", "shingles"]
        if not len(block) or not len(told):
            return pd.DataFrame(columns=columns)
        points, sizes = (np.frombuffer(block[c].iloc[0], dtype=np.int64) for c in ("points", "sizes"))
        blob = block["shingles"].iloc[0]
        key = np.frombuffer(blob, dtype=np.uint64) >> np.uint64(32 - bits)
        known = np.concatenate([np.frombuffer(b, dtype=np.uint32).astype(np.uint64) | np.uint64(int(k) << 32) for k, b in zip(told["bucket"], told["key"])])
        pivot, times = (np.frombuffer(b"".join(told[c]), dtype=t) for c, t in (("pivot", np.int64), ("times", np.uint32)))
        order = np.argsort(known)
        known, pivot, times = known[order], pivot[order], times[order]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        has = known[at] == key
        own = np.repeat(np.arange(len(points)), sizes)
        free = spare(sizes, percent)
        alive = np.bincount(own[has], minlength=len(points)) >= sizes - free
        has &= alive[own]
        names, place = np.unique(pivot, return_inverse=True)
        pair, won = np.unique(own[has] * len(names) + place[at[has]], return_counts=True)
        who, where = pair // len(names), pair % len(names)
        # the nearest pivot that has won enough, the smallest of equals
        near = np.lexsort((where, -won, who))
        near = near[(won > 2 * free[who])[near]]
        near = near[np.concatenate([[True], who[near][1:] != who[near][:-1]])] if len(near) else near
        home = np.zeros(len(pair), bool)
        home[near] = True
        settled = np.zeros(len(points), bool)
        settled[who[near]] = True
        # of the others, the pivots of their rarest shingles
        rare = np.flatnonzero(alive[own] & ~settled[own])
        rare = rare[np.lexsort((key[rare], np.where(has[rare], times[at[rare]], 1), own[rare]))]
        rank = np.arange(len(rare)) - np.searchsorted(own[rare], own[rare])
        rare = rare[(rank <= free[own[rare]]) & has[rare]]
        home[np.searchsorted(pair, np.unique(own[rare] * len(names) + place[at[rare]]))] = True
        # the smallest set that may link has ceil(percent of n) shingles
        visit = won > spare(sizes - free, percent)[who]
        own_region = names[where] == points[who]
        take = np.flatnonzero(home | visit | own_region)
        ends = np.cumsum(sizes) * 8
        sets = [blob[ends[i] - 8 * sizes[i] : ends[i]] for i in who[take]]
        return pd.DataFrame({"region": names[where[take]], "point": points[who[take]], "home": home[take] | own_region[take], "shingles": sets})

    told = pivots.select(F.col("block").alias("told"), "bucket", "key", "pivot", "times")
    return blocks.groupBy("block").cogroup(told.groupBy("told")).applyInPandas(settle, "region long, point long, home boolean, shingles binary")


def may_link(sizes: np.ndarray, shared: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets may link with another, by their sizes and by how many of their shingles other sets hold.

    Sets of n and m shingles that link share percent * (n + m) / (100 + percent) or more, and no more than either shares with all others. So a
    near copy with many words of its own is past linking, however many sets lie about it.
    """
    most = ((100 + percent) * shared - percent * sizes) // percent  # the largest set that each may link with
    order = np.argsort(sizes)
    best = np.maximum.accumulate(most[order])  # of the sets up to a size
    upto = np.searchsorted(sizes[order], most, side="right")
    return (most >= sizes) | ((upto > 0) & (best[np.maximum(upto, 1) - 1] >= sizes))


def link_in_region(sets: list[np.ndarray], home: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the number of the first set that it is connected with by links of which one end at least is at home.

    A Voronoi cell join: pivots are chosen among the sets at home until each of these lies within twice the link distance of one or is one,
    MAX_PIVOTS at a time; each set belongs to the nearest pivot, and visits any other cell whose radius plus the link distance reaches
    it. Cells larger than LEAF are joined the same way if that at least halves the work. A pivot's distances come
    from the lists of sets that hold each of its shingles. What is connected already needs no comparison, and sets that cannot link take no part.
    """
    n = len(sets)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = np.intersect1d(*sets, assume_unique=True).size if 100 * sizes.min() >= percent * sizes.max() else 0
        root[1] = 0 if 100 * common >= percent * (sizes.sum() - common) else 1
        return root
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    df = np.bincount(flat)
    alive, before = np.ones(n, bool), n + 1
    while 1 < alive.sum() < before:
        before = alive.sum()
        held = np.bincount(flat[alive[owner]], minlength=len(df))
        alive[alive] = may_link(sizes[alive], np.bincount(owner, weights=held[flat] > 1, minlength=n).astype(np.int64)[alive], percent)
    if not alive.all():
        left = np.flatnonzero(alive)
        if len(left) > 1 and home[left].any():
            root[left] = left[link_in_region([sets[i] for i in left], home[left], percent)]
        return root
    starts = np.concatenate([[0], np.cumsum(sizes)])
    by_shingle = owner[np.argsort(flat, kind="stable")]
    ends = np.cumsum(df)
    kin = np.bincount(owner, weights=df[flat], minlength=n) / np.maximum(sizes, 1)
    eps = 1 - percent / 100

    def against(p: int) -> np.ndarray:
        """Jaccard distances of all sets from p; links found on the way are noted."""
        nonlocal root
        common = np.zeros(n, np.int64)
        lists, held = [], 0
        for s in flat[starts[p] : starts[p + 1]]:
            lists.append(by_shingle[ends[s] - df[s] : ends[s]])
            held += len(lists[-1])
            if held > 1_000_000:
                common += np.bincount(np.concatenate(lists), minlength=n)
                lists, held = [], 0
        if lists:
            common += np.bincount(np.concatenate(lists), minlength=n)
        union = sizes + sizes[p] - common
        linked = 100 * common >= percent * union
        joined = np.unique(root[linked])
        if len(joined) > 1:
            root = np.where(np.isin(root, joined), joined[0], root)
        return 1 - common / union

    def one(rows: np.ndarray) -> bool:
        return bool((root[rows] == root[rows[0]]).all())

    def fewer(rows: np.ndarray) -> np.ndarray:
        """Links between components have an end outside the largest, and one at home: the fewer of both."""
        names, counts = np.unique(root[rows], return_counts=True)
        apart, at_home = rows[root[rows] != names[counts.argmax()]], rows[home[rows]]
        return apart if len(apart) < len(at_home) else at_home

    todo = [np.arange(n)]
    while todo:
        rows = todo.pop()
        if one(rows) or not home[rows].any():
            continue
        if len(rows) > LEAF:
            left, pivots, distances = home[rows].copy(), [], []
            while left.any() and len(pivots) < min(MAX_PIVOTS, len(rows) // 2):
                # the set whose shingles are most common in the region is likely a centre
                k = int(np.flatnonzero(left)[np.argmax(kin[rows[left]])])
                pivots.append(k)
                distances.append(against(int(rows[k]))[rows].astype(np.float32))
                left &= distances[-1] > 2 * eps
                left[k] = False
            if one(rows):
                continue
            d = np.array(distances)
            cell_of, near = d.argmin(axis=0), d.min(axis=0)
            cells = []
            for c in range(len(pivots)):
                own = (cell_of == c) & ~left & home[rows]
                if own.any():
                    cells.append(own | (d[c] <= near[own].max() + eps + 1e-6))
            if left.any():  # the rest is a cell of its own, with all that may reach it
                cells.append(left | (near + eps + 1e-6 >= near[left].min()))
            parts = [rows[cell] for cell in cells]
            if 2 * sum(len(part) * len(fewer(part)) for part in parts) <= len(rows) * len(fewer(rows)):
                todo += parts
                continue
        for p in fewer(rows):  # compared with all
            if one(rows):
                break
            against(int(p))
    return root


def _solve(percent: int):
    """Links (a, b) that connect the points of each region, or of each cell or pair of blocks of one."""

    def solve(bin_: pd.DataFrame) -> pd.DataFrame:
        keys = [c for c in ("region", "cell", "pair") if c in bin_]
        rows = bin_.sort_values([*keys, "point", "home"], ascending=[True] * (len(keys) + 1) + [False]).drop_duplicates([*keys, "point"])
        names, home, blobs = rows["point"].to_numpy(np.int64), rows["home"].to_numpy(bool), rows["shingles"].to_numpy()
        edges = np.append(np.flatnonzero(~rows.duplicated(keys).to_numpy()), len(rows))
        a, b = [names[:0]], [names[:0]]
        for i, j in zip(edges, edges[1:]):
            if j - i > 1 and home[i:j].any():
                root = link_in_region([np.frombuffer(x, dtype=np.uint64) for x in blobs[i:j]], home[i:j], percent)
                joined = np.flatnonzero(root != np.arange(j - i))
                a.append(names[i + joined])
                b.append(names[i + root[joined]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return solve


def link_regions(placed: DataFrame, region_shingles: int, percent: int) -> DataFrame:
    """Links (a, b) of all regions (region, point, home, shingles). Small ones share tasks, those beyond region_shingles are split first."""
    size = F.length("shingles") / 8
    weights = placed.groupBy("region").agg(F.sum(size).alias("weight"), F.count("*").alias("m")).where("m > 1")
    weights = cut_lineage(weights)
    total, n_heavy = weights.agg(F.sum("weight"), F.count_if(F.col("weight") > region_shingles)).first()
    n_bins = max(1, int(total or 0) // (region_shingles // 4))
    light = placed
    heavy = weights.where(F.col("weight") > region_shingles).select("region")
    if n_heavy:
        light = placed.join(heavy, "region", "left_anti")
    links = light.withColumn("bin", F.pmod(F.xxhash64("region"), F.lit(n_bins))).groupBy("bin").applyInPandas(_solve(percent), "a long, b long")
    if n_heavy:
        for part in _split_regions(placed.join(heavy, "region", "left_semi"), region_shingles, percent):
            links = links.unionByName(part)
    return links


def _far_apart(percent: int):
    """Of the points of a cell that were drawn, those that become pivots: the most central first, each farther than twice the link distance from the others."""

    def choose(drawn: pd.DataFrame) -> pd.DataFrame:
        drawn = drawn.sort_values("point")
        sets = [np.frombuffer(b, dtype=np.uint64) for b in drawn["shingles"]]
        d = np.zeros((len(sets), len(sets)))
        for i, j in zip(*np.triu_indices(len(sets), 1)):
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            d[i, j] = d[j, i] = 1 - common / (len(sets[i]) + len(sets[j]) - common)
        kept: list[int] = []
        for k in np.argsort(d.sum(axis=0), kind="stable").tolist():
            if all(d[k, i] > 2 * (1 - percent / 100) for i in kept):
                kept.append(k)
        return drawn.iloc[kept]

    return choose


def _split_regions(members: DataFrame, region_shingles: int, percent: int, per_cell: int = 16, max_rounds: int = 4) -> list[DataFrame]:
    """Links (a, b) of regions too large for one task, in parts.

    In a round about per_cell points at home of each large cell are drawn, and those far apart become its pivots; points at home go to the nearest, and any point visits
    each cell that it may reach. Points that link with the cell's pivot are connected through it, so only the others stay at home there; a cell
    without others, or to which only its pivot belongs, is done. Cells of a bounded size are solved, larger ones split again. What does not get at least half
    as much work (pairs of a point at home and any other) stays whole, with the points not linked with its best pivot at home if those are fewer, and is cut into
    blocks of a bounded size: each block of points at home is compared with each block of its cell.
    """
    eps = 1 - percent / 100
    keys, keep = ["region", "cell"], ["region", "cell", "point", "home", "shingles"]
    left = cut_lineage(members.groupBy("region", "point").agg(F.max("home").alias("home"), F.first("shingles").alias("shingles")).withColumn("cell", F.lit("")))
    out, whole = [], []
    size = F.length("shingles") / 8

    def measure(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("p_point")
        sets = [np.frombuffer(b, dtype=np.uint64) for b in pivots["p_shingles"]]
        if not len(rows) or not len(sets):
            return pd.DataFrame(columns=[*keep, "pivot", "d"])
        far: list[list[float]] = []
        for blob in rows["shingles"]:
            s, d = np.frombuffer(blob, dtype=np.uint64), []
            for other in sets:
                common = np.intersect1d(s, other, assume_unique=True).size
                union = len(s) + len(other) - common
                d.append(0.0 if 100 * common >= percent * union else 1 - common / union)
            far.append(d)
        return rows[keep].assign(pivot=[pivots["p_point"].to_list()] * len(rows), d=far)

    for round_no in range(max_rounds):
        counts = left.groupBy(*keys).agg(
            F.count_if("home").alias("m"), F.min(F.when(F.col("home"), F.col("point"))).alias("least"), F.sum(size).alias("weight"), F.ceil(F.sum(size) / region_shingles).cast("int").alias("chunks")
        )
        counts = cut_lineage(counts.where("m > 0"))
        rows = cut_lineage(left.join(counts.select(*keys, "m", "least", "chunks"), keys))
        drawn = F.pmod(F.xxhash64(F.lit(round_no), "point"), F.col("m")) < per_cell
        drawn = rows.where(F.col("home") & (drawn | (F.col("point") == F.col("least")))).select(*keep)
        pivots = drawn.groupBy(*keys).applyInPandas(_far_apart(percent), drawn.schema)
        pivots = cut_lineage(pivots.join(counts.select(*keys, "chunks"), keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("point"), "chunks").cast("int"))
        by = [*keys, "chunk"]
        pivots = pivots.select(*[F.col(c).alias(f"p_{c}") for c in (*keep, "chunk")])  # names of their own, as both sides stem from one table
        schema = "region long, cell string, point long, home boolean, shingles binary, pivot array<long>, d array<double>"
        measured = rows.select(*keep, "chunk").groupBy(*by).cogroup(pivots.groupBy(*[f"p_{c}" for c in by])).applyInPandas(measure, schema)
        measured = cut_lineage(measured.withColumn("near", F.array_min("d")).withColumn("nearest", F.element_at("pivot", F.array_position("d", F.array_min("d")).cast("int"))))
        met = measured.select(*keep, "near", "nearest", F.explode(F.arrays_zip("pivot", "d")).alias("z")).select("*", F.col("z.pivot").alias("pivot"), F.col("z.d").alias("dk")).drop("z")
        out.append(met.where("dk = 0 and point != pivot").select(F.col("point").alias("a"), F.col("pivot").alias("b")))
        # a linked point is at a distance of eps or less; a pivot has been compared with its whole cell
        bound = measured.where("home and point != nearest").groupBy(*keys, F.col("nearest").alias("pivot")).agg(F.max(F.greatest("near", F.lit(eps))).alias("radius"))
        visits = met.join(bound, [*keys, "pivot"]).where((F.col("home") & (F.col("pivot") == F.col("nearest"))) | (F.col("dk") <= F.col("radius") + eps + 1e-9))
        sizes = cut_lineage(visits.groupBy(*keys, "pivot").agg(F.sum(size).alias("weight"), F.count_if(F.col("dk") > 0).alias("open")).where("open > 0"))
        work = sizes.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("open")).alias("after")).join(counts, keys)
        stuck = cut_lineage(work.where("2 * after > m * weight").select(*keys, "m"))
        # cells that split too little: links between components have an end outside the largest, and one at home
        linked = measured.join(stuck.select(*keys), keys, "left_semi").groupBy(*keys, "nearest").agg(F.count_if(F.col("near") == 0).alias("n"), F.count("*").alias("all"))
        best = linked.groupBy(*keys).agg(F.max_by("nearest", F.struct("n", "nearest")).alias("best"), (F.sum("all") - F.max("n")).alias("apart"))
        kept = measured.join(cut_lineage(stuck.join(best, keys)), keys)
        apart = ~((F.col("near") == 0) & (F.col("nearest") == F.col("best")))
        whole.append(cut_lineage(kept.withColumn("home", F.when(F.col("apart") < F.col("m"), apart).otherwise(F.col("home"))).select(*keep)))
        cells = visits.join(sizes.select(*keys, "pivot", F.col("weight").alias("cell_weight")), [*keys, "pivot"]).join(stuck.select(*keys), keys, "left_anti")
        cells = cells.select("region", F.concat_ws("/", "cell", F.col("pivot").cast("string")).alias("cell"), "point", (F.col("dk") > 0).alias("home"), "shingles", "cell_weight")
        cells = cut_lineage(cells)
        out.append(cells.where(F.col("cell_weight") <= region_shingles).groupBy(*keys).applyInPandas(_solve(percent), "a long, b long"))
        left = cells.where(F.col("cell_weight") > region_shingles).select(*keep)
        if left.isEmpty():
            break
    # each block of points at home meets each block of all points of its cell
    left = reduce(DataFrame.unionByName, whole, left)
    counts = left.groupBy(*keys).agg(F.ceil(F.sum(F.when(F.col("home"), size)) / region_shingles).cast("int").alias("across"), F.ceil(F.sum(size) / region_shingles).cast("int").alias("down"))
    rows = left.join(counts.where("across > 0"), keys)
    place = F.xxhash64("point")
    pair = lambda x, y: F.concat_ws(":", x.cast("string"), y.cast("string"))
    lives = rows.where("home").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).withColumn("pair", pair(F.pmod(place, F.col("across")), F.col("y")))
    meets = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).withColumn("pair", pair(F.col("x"), F.pmod(place, F.col("down")))).withColumn("home", F.lit(False))
    met = lives.select(*keep, "pair").unionByName(meets.select(*keep, "pair"))
    out.append(met.groupBy(*keys, "pair").applyInPandas(_solve(percent), "a long, b long"))
    return out


def group_ngrams(docs: DataFrame, n: int = N, percent: int = PERCENT, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_shingles, component_id, kept: one row per document.

    component_id is the smallest doc_id reachable by links, the document itself included. Words are runs
    of non-space, A-Z in lower case; a text of fewer than n words is one shingle; null texts and those
    without words have none, link with nothing, are their own component and kept. Of any other component the row with the smallest doc_id is
    kept and, of several with that id, the smallest mark; rows equal in both are all marked. A null doc_id is never the
    smallest: its row links like any other and is null in component_id only where no linked row has an id. Repeated rows repeat. An empty
    table gives no rows. Other columns are ignored.
    """
    small_batches(docs)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("mark"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            found, at = np.zeros((3, batch.num_rows), dtype=np.int64), 0
            for flat, sizes in shingle.chunks(t.as_py() for t in batch.column("text")):
                found[:, at : at + len(sizes)] = sizes, [window_needed(x, percent) if x else 0 for x in sizes.tolist()], points_of(flat, sizes)
                at += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), *[pa.array(x) for x in found]], ["doc_id", "mark", "n_shingles", "window_needed", "point"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    places = cut_lineage(texts.mapInArrow(describe, f"doc_id {kind}, mark long, n_shingles long, window_needed long, point long"))
    # equal sets are one point; the text of its least row stands for it
    least = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    firsts = places.where("n_shingles > 0").groupBy("point").agg(F.min(least).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("window_needed").alias("window_needed"))
    firsts = cut_lineage(firsts.withColumn("mark", F.col("least.mark")))
    n_buckets = 1 << max(LEAST_BUCKET_BITS, (firsts.count() // 4_000).bit_length())

    # 1. of a window of 2 * spare + 1 shingles, all but spare must be shared, or fewer where a smaller set's window ends before
    shingle = Shingler(n)

    def wide(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        for flat, sizes in shingle.chunks(batch["text"]):
            starts = np.cumsum(sizes) - sizes
            for point, a, b in zip(points_of(flat, sizes).tolist(), starts, starts + window_size(sizes, percent)):
                if b > a:
                    yield point, flat[a:b]

    counted = shared_counts(texts.select("text"), wide, n_buckets)
    chosen = cut_lineage(firsts.join(counted, "point").where("shared >= window_needed").select("point", "mark", "n_shingles"))

    # 2. the sets of what is left. A bitmap of fixed size spares the other texts the work; the join after it is exact.
    place = F.pmod(F.xxhash64("mark"), F.lit(BITMAP_BITS))
    marks = chosen.select((place + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in marks.toLocalIterator():
        bitmap[(row[0] - 1) * 4096 : row[0] * 4096] = np.frombuffer(row[1], dtype=np.uint8)
    held_bitmap = share(docs, bitmap)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared(held_bitmap)
        points, sets, held = [], [], 0
        for batch in batches:
            at = batch["place"].to_numpy(np.int64)
            for flat, sizes in shingle.chunks(batch["text"][(bits[at >> 3] >> (at & 7)) & 1 == 1]):
                starts = np.cumsum(sizes) - sizes
                for point, a, b in zip(points_of(flat, sizes).tolist(), starts, starts + sizes):
                    if b > a:
                        points.append(point)
                        sets.append(flat[a:b].tobytes())
                held += len(flat)
                if held > FLUSH:
                    yield pd.DataFrame({"point": points, "shingles": sets})
                    points, sets, held = [], [], 0
        if points:
            yield pd.DataFrame({"point": points, "shingles": sets})

    sets = texts.select("text", place.alias("place")).mapInPandas(expand, "point long, shingles binary").drop_duplicates(["point"])
    sets = sets.join(chosen.select("point"), "point", "left_semi")
    blocks = cut_lineage(sets.mapInPandas(pack_blocks, "block long, points binary, sizes binary, shingles binary"))

    # 3. documents elected as pivots, the regions around them, and the points that visit
    shingles = blocks.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    n_lists = 1 << max(LEAST_BUCKET_BITS, min(31, int(shingles // BLOCK_SHINGLES).bit_length()))
    placed = cut_lineage(assign_regions(blocks, elect_pivots(blocks, n_lists), n_lists, percent))
    component = connected_components(link_regions(placed, region_shingles, percent)).withColumnRenamed("node", "point")

    # the least row of each component; its points, and the copies of a point, are dealt over SALTS tasks when it is joined back
    linked = cut_lineage(firsts.select("point", "least").join(component, "point"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    names = linked.groupBy("component").agg(F.min("least").alias("name")).withColumn("salt", salts)
    named = linked.select("point", "component", F.pmod(F.xxhash64("point"), F.lit(SALTS)).cast("int").alias("salt")).join(names, ["component", "salt"])
    named = firsts.select("point", "least").join(named.select("point", "name"), "point", "left").select("point", F.coalesce("name", "least").alias("name"))
    placed = places.withColumn("salt", F.pmod(F.xxhash64("mark", "doc_id"), F.lit(SALTS)).cast("int")).join(named.withColumn("salt", salts), ["point", "salt"], "left")
    worded = F.col("n_shingles") > 0
    first = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("mark") == F.col("name.mark"))
    return placed.select("doc_id", "mark", "n_shingles", F.when(worded, F.col("name.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), (~worded | first).alias("kept"))


def join_ngrams(docs: DataFrame, n: int = N, percent: int = PERCENT, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document, as group_ngrams() finds them."""
    return group_ngrams(docs, n, percent, region_shingles).select("doc_id", "n_shingles", "component_id")


#: The same join in DuckDB SQL, from all pairs of documents that share a shingle.
NGRAM_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
sets AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingled) WHERE len(s) > 0 GROUP BY s),
entries AS (SELECT doc_id, n, unnest(s) AS x FROM sets),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component_id END AS component_id
FROM shingled d LEFT JOIN sets t ON list_sort(d.s) = t.s LEFT JOIN component c ON c.a = t.doc_id
"""
