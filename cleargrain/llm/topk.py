"""Exact top-k search by inner product: a Voronoi kNN join.

Components are quantised to floor(256 x). Search by inner product becomes search by distance when every data vector
gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and every query, drawn out to length M, a 0 there: then
|q' - x'|^2 = 2 M^2 - 2 M q.x / |q|. Data vectors go to the nearest of about sqrt(n) pivots. A summary of each group (size, least and
largest distance from the pivot, its nearest members' distances) bounds each query's k-th distance from above. A group needs no
copy of the query if its members are farther, by the triangle inequality or by the plane between its pivot and another.
Groups near each other share a task, large ones take several; the rest is solved there and merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, hash_key, share, shared

SCALE = 256
#: Sums of products below this are exact in doubles; beyond it Python's integers are used.
EXACT = 2.0**53
LONGEST = 2**63 - 1
#: Pivots at most, a bound on what is broadcast; past its square groups grow instead.
MAX_PIVOTS = 4_096


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, row (a number of its own for each row), id and nameless (vec_id without null), v (whole numbers as binary doubles or,
    where they fit, 16-bit integers), length, squared norm.

    Null vectors and those with null or non-finite components are left out.
    """
    fine = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    kind = vectors.schema["vec_id"].dataType.simpleString()
    blank = F.lit("" if kind == "string" else 0).cast(kind)
    fine = fine.select(F.coalesce("vec_id", blank).alias("id"), F.col("vec_id").isNull().alias("nameless"), F.monotonically_increasing_id().alias("row"), "x")

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = [np.nan_to_num(np.floor(scale * np.asarray(x, dtype=np.float64))) for x in batch["x"]]
            short = [x.astype("<i2") if len(x) and np.abs(x).max() < 2**15 else x for x in whole]
            done = {"v": [x.tobytes() for x in short], "length": [len(x) for x in whole], "wide": [x.dtype.kind == "f" for x in short], "norm2": [float(x @ x) for x in whole]}
            yield batch[["id", "nameless", "row"]].assign(**done)

    done = cut_lineage(fine.mapInPandas(floors, f"id {kind}, nameless boolean, row long, v binary, length int, wide boolean, norm2 double"))
    return done.withColumn("vec_id", F.when(~F.col("nameless"), F.col("id")))


def matrix(blobs, wide, width: int) -> np.ndarray:
    """Vectors as rows of doubles that hold whole numbers; shorter ones end in zeros."""
    out = np.zeros((len(blobs), width))
    for i, (blob, w) in enumerate(zip(blobs, wide)):
        v = np.frombuffer(blob, dtype="<f8" if w else "<i2")
        out[i, : len(v)] = v
    return out


class Groups:
    """Pivots, the groups around them, and which of their tasks a query must see."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots, top
        self.norm2 = (pivots * pivots).sum(axis=1)
        self.lift = np.sqrt(np.maximum(top - self.norm2, 0))
        between = self.norm2[:, None] + self.norm2 - 2 * (pivots @ pivots.T) + (self.lift[:, None] - self.lift) ** 2
        self.between = np.sqrt(np.maximum(between, 0))

    def distances(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(axis=1)[:, None] + self.norm2 - 2 * (x @ self.pivots.T) + (lift[:, None] - self.lift) ** 2
        return np.sqrt(np.maximum(d2, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each data vector and the distance from it."""
        if not len(x):
            return np.zeros(0, np.int32), np.zeros(0)
        d = self.distances(x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0)))
        near = d.argmin(axis=1)
        return near.astype(np.int32), d[np.arange(len(d)), near]

    def lay_out(self, summary: list, chunk_rows: int) -> None:
        """Deal the groups to tasks: near ones together up to chunk_rows, one beyond that over several.

        summary: (group, size, least and largest distance, distances of the nearest members) of each group that has members.
        """
        n = len(self.pivots)
        self.size, self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.near = {}
        for cell, size, lo, hi, near in summary:
            self.size[cell], self.lo[cell], self.hi[cell], self.near[cell] = size, lo, hi, np.asarray(near)
        centre = self.between[:, : max(1, isqrt(n))].argmin(axis=1)
        self.first, self.tasks = np.zeros(n, np.int64), np.ones(n, np.int64)
        task, held = 0, 0
        for cell in np.lexsort((np.arange(n), centre)):
            if self.size[cell] > chunk_rows or held + self.size[cell] > chunk_rows:
                task, held = task + (held > 0), 0
            self.first[cell], self.tasks[cell] = task, max(1, -(-self.size[cell] // chunk_rows))
            if self.tasks[cell] > 1:
                task += int(self.tasks[cell])
            else:
                held += int(self.size[cell])
        self.n_tasks = task + 1

    def wanted(self, x: np.ndarray, k: int) -> np.ndarray:
        """(query, group): whether the group may hold one of the query's k nearest, its own row not counted."""
        norm = np.sqrt((x * x).sum(axis=1))
        drawn = x * np.divide(np.sqrt(self.top), norm, out=np.ones_like(norm), where=norm > 0)[:, None]
        d = self.distances(drawn, np.zeros(len(x)))
        reach = np.full((len(x), k + 1), np.inf)  # upper bounds of the k + 1 nearest so far; one may be the query's own row
        for cell, near in self.near.items():
            reach = np.sort(np.hstack([reach, d[:, [cell]] + near]), axis=1)[:, : k + 1]
        far = reach[:, k] * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.top))
        out = (d - self.hi <= far[:, None]) & (self.lo - d <= far[:, None]) & (self.size > 0)
        # a member is on its pivot's side of the plane between that and any other pivot
        for cell in np.flatnonzero(out.any(axis=0)):
            apart = self.between[cell] > 0
            ask = np.flatnonzero(out[:, cell])
            beyond = ((d[ask, cell] ** 2)[:, None] - d[ask][:, apart] ** 2) / (2 * self.between[cell][apart])
            out[ask, cell] = beyond.max(axis=1, initial=-np.inf) <= far[ask]
        return out


def make_groups(vectors: DataFrame, k: int, chunk_rows: int, max_pivots: int, seed: int) -> tuple[Groups, int, DataFrame]:
    """The groups of quantise()'d vectors, the longest length, and the vectors with cell and distance."""
    length, top, n = vectors.agg(F.max("length"), F.max("norm2"), F.count("*")).first()
    width = length or 1
    n_pivots = max(1, min(max_pivots, isqrt(n)))
    picked = vectors.orderBy(hash_key(seed, F.col("row"))).limit(n_pivots).select("v", "wide").collect()
    pivots = matrix([r[0] for r in picked], [r[1] for r in picked], width) if picked else np.zeros((1, width))
    groups = Groups(pivots, float(top or 0))
    held = share(vectors, groups)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared(held)
        for batch in batches:
            for i in range(0, len(batch), 2_000):
                part = batch.iloc[i : i + 2_000]
                cell, distance = own.place(matrix(part["v"], part["wide"], width))
                yield part.assign(cell=cell, distance=distance)

    kind = vectors.schema["id"].dataType.simpleString()
    columns = ["id", "nameless", "row", "v", "wide"]
    data = cut_lineage(vectors.select(*columns).mapInPandas(assign, f"id {kind}, nameless boolean, row long, v binary, wide boolean, cell int, distance double"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, d in batch.groupby("cell")["distance"]:
                yield pd.DataFrame({"cell": [cell], "n": [len(d)], "lo": [d.min()], "hi": [d.max()], "near": [np.sort(d.to_numpy())[: k + 1]]})

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        near = np.sort(np.concatenate(rows["near"].to_list()))[: k + 1]
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "n": [rows["n"].sum()], "lo": [rows["lo"].min()], "hi": [rows["hi"].max()], "near": [near]})

    schema = "cell int, n long, lo double, hi double, near array<double>"
    # one row of k + 1 distances a group and batch meets in a task; max_pivots rows come to the driver at most
    groups.lay_out(data.select("cell", "distance").mapInPandas(nearest, schema).groupBy("cell").applyInPandas(least, schema).collect(), chunk_rows)
    return groups, width, data


def search_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, max_pivots: int = MAX_PIVOTS, chunk_rows: int = 20_000, query_rows: int = 20_000, seed: int = 13
) -> DataFrame:
    """query_id, rank, vec_id, score: the k data rows with the largest integer inner product for each query row.

    queries is quantise()'d rows of vectors, as is vectors; a query's own row is no candidate. Ties go to the
    smaller vec_id (null first), then to the row that stands first. A vector shorter than another counts as ending in zeros. Repeated rows are candidates
    of their own. Without queries or candidates there are no rows. Ranks are exact at any size of components; a score beyond
    the range of a long is given as its end.
    """
    groups, width, data = make_groups(vectors, k, chunk_rows, max_pivots, seed)
    held = share(vectors, groups)
    exact = groups.top < EXACT  # by Cauchy and Schwarz no sum of products is larger
    n_sides = max(1, -(-queries.count() // query_rows))
    kind = vectors.schema["id"].dataType.simpleString()
    columns = ["id", "nameless", "row", "v", "wide"]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A copy of each query for each task whose groups may hold one of its k best."""
        own = shared(held)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                wanted = own.wanted(matrix(part["v"], part["wide"], width), k)
                tasks = np.zeros((len(part), own.n_tasks), bool)
                for cell in np.flatnonzero(wanted.any(axis=0)):
                    tasks[:, own.first[cell] : own.first[cell] + own.tasks[cell]] |= wanted[:, [cell]]
                who, task = np.nonzero(tasks)
                yield part[columns].iloc[who].assign(task=task)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared(held)
        for batch in batches:
            cell = batch["cell"].to_numpy()
            yield batch[columns].assign(task=own.first[cell] + batch["row"].to_numpy() % own.tasks[cell])

    schema = f"id {kind}, nameless boolean, row long, v binary, wide boolean, task long"
    sent = queries.select(*columns).mapInPandas(send, schema).withColumn("side", F.pmod(F.xxhash64("row"), F.lit(n_sides)).cast("int"))
    dealt = data.mapInPandas(deal, schema).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(n_sides - 1))))

    def solve(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            rows = rows.assign(named=~rows["nameless"]).sort_values(["named", "id", "row"], kind="stable")
            ids, nameless, own = (rows[c].to_numpy() for c in ("id", "nameless", "row"))
            x = matrix(rows["v"], rows["wide"], width).T
            for i in range(0, len(asked), 128):
                part = asked.iloc[i : i + 128]
                q = matrix(part["v"], part["wide"], width)
                scores = q @ x if exact else np.array([[int(v) for v in line] for line in q], dtype=object) @ np.array([[int(v) for v in line] for line in x], dtype=object)
                for q_id, q_none, q_row, line in zip(part["id"], part["nameless"], part["row"], scores):
                    others = np.flatnonzero(own != q_row)
                    if exact and len(others) > k:  # those that reach the k-th largest, ties included
                        others = others[line[others] >= np.partition(line[others], -k)[-k]]
                    best = sorted(others.tolist(), key=lambda j: (-line[j], j))[:k]
                    out += [(q_id, q_none, q_row, ids[j], nameless[j], max(-LONGEST - 1, min(LONGEST, int(line[j]))), str(int(line[j])), own[j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "query_nameless", "query_row", "id", "nameless", "score", "whole", "row"])

    schema = f"query_id {kind}, query_nameless boolean, query_row long, id {kind}, nameless boolean, score long, whole string, row long"
    keys = ["task", "side"]
    found = sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(solve, schema)
    # whole numbers beyond a long are compared by sign, digits and value
    digits = F.length("whole") * F.when(F.col("score") < 0, -1).otherwise(1)
    text = F.when(F.col("score") < 0, F.translate("whole", "0123456789", "9876543210")).otherwise(F.col("whole"))
    largest = [F.desc("score")] if exact else [F.desc("score"), digits.desc(), text.desc()]
    order = Window.partitionBy("query_row").orderBy(*largest, F.desc("nameless"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    name = lambda c: F.when(~F.col(c.replace("id", "nameless")), F.col(c))
    return ranked.select(name("query_id").alias("query_id"), "rank", name("id").alias("vec_id"), "score")


#: The same search in DuckDB SQL.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
