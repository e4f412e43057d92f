"""Compression of vectors to codes: one codebook a part, fitted by k-means with Drake-Hamerly adaptive bounds.

Components become whole numbers and vectors are cut into equal parts. For every part of every vector the state keeps the b codebook entries
that are closest, in order, an upper bound on the distance to the first, lower bounds on those to the others, and one outer lower bound for
all entries that are not among the b. When entries move, the bounds give way by as much. Where the upper bound stays under the
lower ones the assignment stands; else only the entries whose bounds it reaches are compared, in whole numbers, and all entries only when it reaches
the outer bound. b begins at a quarter of the entries and comes down, batch by batch, to what was needed, but not below an eighth.

State is written to the checkpoint folder after every pass; sums of a part's entries come from the parts that changed, aggregated in
each task and then by Spark. What reaches the driver are the codebooks, whose size is set by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, free_name, share, shared

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Whole numbers are held to this size, so that squared distances of parts up to 256 long stay exact.
LARGEST = 2**22
#: Labels whose sums are broadcast at most; more are dealt by label over SALTS tasks each.
BROADCAST_LABELS, SALTS = 100_000, 32

STATE = "row long, v binary, width int, near binary, low binary, up binary, code binary, before binary"


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to the entries, as whole numbers; sums in doubles are exact up to 2^53."""
    x, c = x.astype(np.float64), entries.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def closest(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The b closest entries in order (ties to the lower index), the distance to the first, and lower bounds: of the others, then of the rest."""
    k = len(entries)
    found = squares(x, entries) * k + np.arange(k)
    first = np.sort(np.partition(found, min(b, k - 1), axis=1)[:, : b + 1] if b < k else found, axis=1)
    apart = np.sqrt((first // k).astype(np.float64))
    low = apart[:, 1:] if b < k else np.column_stack([apart[:, 1:], np.full(len(x), np.inf)])
    return (first[:, :b] % k).astype(np.uint8), apart[:, 0], low


def moved(x: np.ndarray, near: np.ndarray, up: np.ndarray, low: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> int:
    """Bring near, up and low of one part position up to date with entries that have moved by drift at most. Returns the most bounds that any row reached."""
    k, b = len(entries), near.shape[1]
    up += drift[near[:, 0]]
    low[:, :-1] -= drift[near[:, 1:]]
    low[:, -1] -= drift.max()
    low[:] = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    rows = np.flatnonzero(up >= low[:, 0])
    own = x[rows] - entries[near[rows, 0]]
    up[rows] = np.sqrt((own * own).sum(axis=1).astype(np.float64))
    reached = (low[rows] <= up[rows, None] * (1 + 1e-12)).sum(axis=1)
    some = (reached > 0) & (reached < b)
    if some.any():
        at, z = rows[some], reached[some]
        width = int(z.max()) + 1
        held = near[at, :width].astype(np.int64)
        away = x[at, None, :] - entries[held]
        keys = (away * away).sum(axis=2) * k + held
        keys[np.arange(width) > z[:, None]] = np.iinfo(np.int64).max  # beyond the bounds that were reached: stays where it is
        order = np.argsort(keys, axis=1, kind="stable")
        near[at, :width] = np.take_along_axis(held, order, axis=1)
        exact = np.sqrt((np.take_along_axis(keys, order, axis=1) // k).astype(np.float64))
        up[at] = exact[:, 0]
        low[at, : width - 1] = np.where(np.arange(1, width) <= z[:, None], exact[:, 1:], low[at, : width - 1])
    every = rows[reached == b]
    if len(every):
        near[every], up[every], low[every] = closest(x[every], entries, b)
    low[:] = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]  # a bound holds for all entries after it
    return int(reached.max()) if len(rows) else 0


def _packed(near: np.ndarray, up: np.ndarray, low: np.ndarray, b: int) -> dict[str, list[bytes]]:
    """State columns with the b closest entries; bounds in single precision, turned outward."""
    low = np.nextafter(np.nextafter(low[:, :, :b].astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))
    up = np.nextafter(up.astype(np.float32), np.float32(np.inf))
    near = np.ascontiguousarray(near[:, :, :b])
    return {"width": [b] * len(near), "near": [x.tobytes() for x in near], "low": [x.tobytes() for x in low], "up": [x.tobytes() for x in up], "code": [x.tobytes() for x in near[:, :, 0]]}


def _whole(blobs, parts: int) -> np.ndarray:
    """Vectors (rows) as parts (second axis) of whole numbers."""
    return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(len(blobs), parts, -1).astype(np.int64)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label and v (binary 32-bit floor(scale * x), within LARGEST) of the vectors without null or non-finite components, and its length."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("embedding").cast("array<double>").alias("x"), "vec_id", "label")

    def floors(x: pd.Series) -> pd.Series:
        return pd.Series([np.clip(np.floor(scale * np.asarray(v, dtype=np.float64)), -LARGEST, LARGEST).astype("<i4").tobytes() for v in x], dtype=object)

    return cut_lineage(kept.select("row", "vec_id", "label", F.pandas_udf(floors, "binary")("x").alias("v"), F.size("x").alias("length")))


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, place): the vectors of the smallest ids, ties by their components."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return _whole([bytes(r[0]) for r in rows], parts).transpose(1, 0, 2)


def assigned(state: DataFrame, books: np.ndarray, drift: np.ndarray | None = None) -> DataFrame:
    """STATE after assigning every part to its closest entry; without drift from nothing, else from the bounds held."""
    parts, k = books.shape[:2]
    held = share(state, (books, drift))
    least, most = max(1, k // 8), max(1, k // 4)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, _ = shared(held)
        for batch in batches:
            if len(batch):
                x = _whole(batch["v"], parts)
                near, up, low = (np.stack(c, axis=1) for c in zip(*[closest(x[:, p], books[p], most) for p in range(parts)]))
                yield batch[["row", "v"]].assign(**_packed(near, up, low, most), before=None)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, drift = shared(held)
        for whole in batches:
            for b, batch in whole.groupby("width"):
                x, shape = _whole(batch["v"], parts), (len(batch), parts)
                near = np.frombuffer(b"".join(batch["near"]), dtype=np.uint8).reshape(*shape, b).copy()
                low = np.frombuffer(b"".join(batch["low"]), dtype="<f4").reshape(*shape, b).astype(np.float64)
                up = np.frombuffer(b"".join(batch["up"]), dtype="<f4").reshape(shape).astype(np.float64)
                needed = max(moved(x[:, p], near[:, p], up[:, p], low[:, p], books[p], drift[p]) for p in range(parts))
                yield batch[["row", "v"]].assign(**_packed(near, up, low, min(b, max(least, needed + 1))), before=list(batch["code"]))

    return cut_lineage(state.mapInPandas(first if drift is None else again, STATE))


def changed_sums(state: DataFrame, parts: int, entries: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What the last pass changed in each entry's number of parts and in their sums: (part, entry), (part, entry, place)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts * entries, length + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _whole(batch["v"], parts).reshape(-1, length)
            book = np.tile(np.arange(parts) * entries, len(batch))
            new = np.frombuffer(b"".join(batch["code"]), dtype=np.uint8)
            if batch["before"].iloc[0] is None:
                steps = [(1, np.ones(len(new), bool), new)]
            else:
                old = np.frombuffer(b"".join(batch["before"]), dtype=np.uint8)
                steps = [(1, new != old, new), (-1, new != old, old)]
            for sign, rows, code in steps:
                at = book[rows] + code[rows]
                total[:, 0] += sign * np.bincount(at, minlength=len(total))
                for j in range(length):
                    total[:, j + 1] += sign * np.bincount(at, x[rows, j], minlength=len(total)).astype(np.int64)
        rows = np.flatnonzero(total.any(axis=1))
        if len(rows):
            yield pd.DataFrame({"entry": rows.astype(np.int64), **{f"s{j}": total[rows, j] for j in range(length + 1)}})

    sums = state.select("v", "code", "before").mapInPandas(add, "entry long, " + ", ".join(f"s{j} long" for j in range(length + 1)))
    out = np.zeros((parts * entries, length + 1), np.int64)
    for r in sums.groupBy("entry").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(length + 1)]).collect():  # parts * entries rows
        out[r[0]] = r[1:]
    out = out.reshape(parts, entries, length + 1)
    return out[:, :, 0], out[:, :, 1:]


def fit_codes(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """STATE of whole_vectors() of one length after the last assignment, and the final codebooks."""
    books = first_entries(kept, parts, entries)
    counts, sums, state, drift = 0, 0, kept.select("row", "v"), None
    for _ in range(rounds):
        state = assigned(state, books, drift)
        more = changed_sums(state, parts, books.shape[1], books.shape[2])
        counts, sums = counts + more[0], sums + more[1]
        used = (counts > 0)[:, :, None]
        new = np.where(used, sums // np.maximum(counts, 1)[:, :, None], books)
        drift = np.nextafter(np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)), np.inf) * (new != books).any(axis=2)
        books = new
    return assigned(state, books, drift), books


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per vector without null or non-finite components.

    The length of most vectors (of several the smallest) is the table's; it must be a multiple of parts. Vectors of other lengths get null
    code and error and take no part. Whole numbers beyond LARGEST count as that. The first codebooks are the vectors of the smallest ids, null last, ties by
    their components; with fewer vectors than entries there are as many entries as vectors. Repeated rows are vectors of their own.
    Null labels form one group. An empty table gives no rows. Columns besides vec_id, embedding and label are ignored.
    """
    kept = whole_vectors(vectors, scale)
    usual = kept.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    if usual[0] % parts or not usual[0]:
        raise ValueError(f"vectors of {usual[0]} components can't be cut into {parts} equal parts")
    state, books = fit_codes(kept.where(F.col("length") == usual[0]), parts, entries, rounds)
    held = share(kept, books)

    def errors(v: pd.Series, code: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=np.int64)
        books = shared(held)
        chosen = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(v), parts)
        away = _whole(v, parts) - books[np.arange(parts), chosen]
        return pd.Series((away * away).sum(axis=(1, 2)))

    coded = state.select("row", F.lower(F.hex("code")).alias("code"), F.pandas_udf(errors, "long")("v", "code").alias("error"))
    coded = cut_lineage(kept.select("row", "vec_id", "label").join(coded, "row", "left"))
    # label_error: the sums of bounded many labels are broadcast; else a label's rows are dealt over SALTS tasks
    key = free_name(coded, "same_label")
    coded = coded.withColumn(key, F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("label")))
    sums = cut_lineage(coded.groupBy(key).agg(F.sum("error").alias("label_error")))
    salted = sums.limit(BROADCAST_LABELS + 1).count() > BROADCAST_LABELS
    null_safe = lambda x: F.xxhash64(f"{x}.none", f"{x}.label")
    if salted:
        sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    sums = sums.withColumnRenamed(key, "whose")
    same = (null_safe(key) == null_safe("whose")) & F.col(f"{key}.none").eqNullSafe(F.col("whose.none")) & F.col(f"{key}.label").eqNullSafe(F.col("whose.label"))
    met = coded.join(sums, same & (coded["salt"] == sums["salt"])) if salted else coded.join(F.broadcast(sums), same)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment to the entries of round n, and the entries of round n + 1."""
    return f"""
near{n} AS (
  SELECT p.id, p.part, min_by(b.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) + b.entry / 1024.0) AS entry,
         min(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)) AS error
  FROM pieces p JOIN books{n} b ON b.part = p.part GROUP BY p.id, p.part),
places{n} AS (
  SELECT part, entry, j, floor(sum(x[j]) / count(*)) AS x
  FROM (SELECT n.part, n.entry, p.x, unnest(range(1, len(p.x) + 1)) AS j FROM near{n} n JOIN pieces p ON p.id = n.id AND p.part = n.part) GROUP BY part, entry, j),
books{n + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM books{n} b LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS x FROM places{n} GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""


#: The same codes in DuckDB SQL, for whole tables of one length of vectors.
VECTOR_CODES_SQL = f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT id, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM (SELECT id, x, unnest(range({PARTS})) AS part FROM v)),
books0 AS (SELECT part, id - 1 AS entry, x FROM pieces WHERE id <= {ENTRIES}),{_round_sql(0)},{_round_sql(1)},{_round_sql(2).split("places2")[0].rstrip().rstrip(",")},
coded AS (
  SELECT id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near2 GROUP BY id),
digest AS (
  SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM (SELECT part, entry, array_to_string(list_transform(x, lambda c: c::BIGINT), ',') AS c FROM books2))
SELECT v.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN coded c ON c.id = v.id, digest
"""
