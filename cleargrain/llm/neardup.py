"""Embedding near-duplicates with spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it when their inner product reaches a bound, so a filter keeps a cap of the
sphere. Directions are all pairs of a code word of the first half of the (randomly rotated) coordinates and
one of the second, so that the list of passed filters is decoded from two small tables of products. Rotations are
Hadamard transforms between random signs, so a code takes memory in proportion to the dimension. Vectors
at a small angle share filters with near certainty; they are joined on filters and verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, share, shared
from cleargrain.llm.components import SALTS, connected_components, forest, roots_of

THRESHOLD = 0.93
#: A code is CODES product codes, each with WORDS words a half: 32,768 filters, whose numbers take two bytes.
CODES, WORDS = 128, 16
#: Filters that two vectors at the threshold share on average. Of 20,000 trial pairs at the threshold none shared no filter.
SHARED = 18.0
TRIALS = 96
#: Rounds of signs and Hadamard transform in a rotation.
ROUNDS = 3
#: Rows that are compared in one block.
BLOCK = 2_000


def hadamard(size: int) -> np.ndarray:
    """The orthogonal Hadamard matrix of a power of two."""
    out = np.ones((1, 1))
    while len(out) < size:
        out = np.block([[out, out], [out, -out]]) / np.sqrt(2)
    return out


@dataclass
class ProductCode:
    #: (round, code, coordinate): 1 or -1
    signs: np.ndarray
    #: (code, word, coordinate) of the first and of the second half
    first: np.ndarray
    second: np.ndarray
    bound: float

    def products(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of each vector with all words of the first and of the second half: (vector, code, word)."""
        _, codes, size = self.signs.shape
        outer = 1 << (size.bit_length() - 1) // 2
        left, right = hadamard(outer), hadamard(size // outer)
        turned = np.zeros((len(units), 1, size))
        turned[:, 0, : units.shape[1]] = units
        for signs in self.signs:
            grid = (turned * signs).reshape(len(units) * codes, outer, size // outer)
            turned = (left @ grid @ right).reshape(len(units), codes, size)
        halves = turned.transpose(1, 0, 2)
        first, second = halves[:, :, : size // 2] @ self.first.transpose(0, 2, 1), halves[:, :, size // 2 :] @ self.second.transpose(0, 2, 1)
        return first.transpose(1, 0, 2), second.transpose(1, 0, 2)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """Numbers of the filters that each unit vector passes, in rising order."""
        out = []
        for a, b in zip(*self.products(units)):
            code, first = np.nonzero(a >= self.bound - b.max(axis=1, keepdims=True))  # words that some partner lifts to the bound
            at, second = np.nonzero(a[code, first][:, None] + b[code] >= self.bound)
            out.append(((code[at] * WORDS + first[at]) * WORDS + second).astype(np.int32))
        return out


def product_code(dim: int, threshold: float = THRESHOLD, shared_filters: float = SHARED, seed: int = 19) -> ProductCode:
    """A code for dim dimensions. The bound is set by trial on random pairs at the threshold's angle."""
    size = max(4, 1 << (dim - 1).bit_length())
    rng = np.random.default_rng([seed, dim])
    signs = rng.choice(np.array([-1, 1], np.int8), (ROUNDS, CODES, size))

    def words() -> np.ndarray:
        w = rng.standard_normal((CODES, WORDS, size // 2), np.float32)
        return w / np.linalg.norm(w, axis=2, keepdims=True) / np.sqrt(np.float32(2))

    code = ProductCode(signs, words(), words(), 0.0)
    x = rng.standard_normal((TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((TRIALS, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = threshold * x + np.sqrt(1 - threshold**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    (a, b), (c, d) = code.products(x), code.products(y / np.linalg.norm(y, axis=1, keepdims=True))
    both = np.stack([np.minimum(p[:, :, None] + q[:, None], r[:, :, None] + s[:, None]).astype(np.float32).ravel() for p, q, r, s in zip(a, b, c, d)])
    place = -int(shared_filters * TRIALS)
    code.bound = float(np.partition(both, place, axis=None)[place])
    return code


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shared_filters: float = SHARED, rows_per_task: int = 20_000, seed: int = 19) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their embeddings have the same length and the cosine,
    in double precision, reaches the threshold. Null or zero embeddings and such with null or non-finite
    components link with nothing, nor does a null vec_id: its component_id is null, kept false. Equal embeddings of
    one label are one class, compared once; each member links with the others. Rows that share a vec_id are vectors of their own, with their
    own links. Empty table: no rows.
    """
    value = F.col("embedding").cast("array<double>")
    stored = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select("vec_id", "label", value.alias("x"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
    usable &= F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("x", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").withColumn("class", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>"))))
    classes = cut_lineage(good.groupBy("class", "label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")))
    # a class goes by its smallest vec_id or, where another class has the same, by its number in the order of these
    shared_ids = not classes.groupBy("first").count().where("count > 1").isEmpty()
    if shared_ids:
        order = ["first", "class"]
        classes = cut_lineage(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id()))
    else:
        classes = classes.withColumn("rep", F.col("first").cast("long"))
    dims = [r[0] for r in classes.select(F.size("x")).distinct().collect()]
    held = share(vectors, {d: product_code(d, threshold, shared_filters, seed) for d in dims})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = shared(held)
        for batch in batches:
            batch["d"] = [len(x) for x in batch["x"]]
            for d, part in batch.groupby("d"):
                x = np.stack(part["x"].to_list())
                units = x / np.abs(x).max(axis=1, keepdims=True)
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                step = max(1, 2**24 // (CODES * d))  # rotated copies of these lie in memory at once
                lists = [f for at in range(0, len(units), step) for f in codes[d].decode(units[at : at + step])]
                yield pd.DataFrame({
                    "label": part["label"], "dim": d, "rep": part["rep"], "n": part["n"], "x": [v.astype(stored).tobytes() for v in x],
                    "filters": [f.astype(np.uint16).tobytes() for f in lists], "passed": lists,
                })

    label_kind = vectors.schema["label"].dataType.simpleString()
    decoded = classes.select("label", "x", "rep", "n").mapInPandas(decode, f"label {label_kind}, dim int, rep long, n long, x binary, filters binary, passed array<int>")
    decoded = cut_lineage(decoded)
    groups = ["label", "dim", "filter"]
    light = decoded.select("label", "dim", F.explode("passed").alias("filter"))
    sizes = light.groupBy(*groups).agg(F.count("*").alias("m"))
    total = decoded.agg(F.sum(F.size("passed"))).first()[0] or 0
    # a filter of more rows than a task takes is cut into parts; each row meets every part once
    rows_per_task = max(BLOCK, min(rows_per_task, 2**26 // (int(stored[2]) * max(dims, default=1))))
    crowded = sizes.where(F.col("m") > rows_per_task).select(*groups, F.ceil(F.col("m") / rows_per_task).cast("int").alias("parts"))
    rows_by_filter = decoded.select("label", "dim", F.explode("passed").alias("filter"), "rep", "n", "x", "filters").join(crowded, groups, "left")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = rows_by_filter.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    n_bins = max(1, total // rows_per_task)
    small, large = F.pmod(F.xxhash64(*groups), F.lit(n_bins)), F.pmod(F.xxhash64(*groups, "lo", "hi"), F.lit(2**40)) + n_bins
    dealt = dealt.withColumn("bin", F.when(F.col("parts").isNull(), small).otherwise(large)).drop("parts", "other")

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([*groups, "lo", "hi"], kind="stable").reset_index(drop=True)
        rep, n = block["rep"].to_numpy(np.int64), block["n"].to_numpy(np.int64)
        part, lo, hi, filters = (block[c].to_numpy() for c in ("part", "lo", "hi", "filter"))
        blobs, lists = block["x"].to_list(), block["filters"].to_list()
        names = block[[*groups, "lo", "hi"]]
        edges = np.flatnonzero((names != names.shift()).any(axis=1).to_numpy())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        links = np.zeros(len(block), np.int64)

        def units(start: int, stop: int) -> np.ndarray:
            x = np.stack([np.frombuffer(b, dtype=stored) for b in blobs[start:stop]]).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

        def compare(a: int, x: np.ndarray, b: int, y: np.ndarray) -> None:
            """Link the rows from a on to those from b on, both of one filter."""
            near = x @ y.T >= threshold
            if a == b:
                near = np.triu(near, 1)
            if lo[a] != hi[a]:  # a pair of parts: pairs within a part are compared elsewhere
                near &= part[a : a + len(x)][:, None] != part[b : b + len(y)]
            i, j = np.nonzero(near)
            if not len(i):
                return
            i, j = i + a, j + b
            # the first filter that a pair shares counts it
            members = np.unique(np.concatenate([i, j]))
            i, j = np.searchsorted(members, i), np.searchsorted(members, j)
            own = [np.frombuffer(lists[m], dtype=np.uint16) for m in members]
            smaller = [f[f < filters[a]] for f in own]
            names_of, at = np.unique(np.concatenate(smaller), return_inverse=True)
            if len(names_of):
                has = np.zeros((len(members), len(names_of)), np.float32)
                has[np.repeat(np.arange(len(members)), [len(f) for f in smaller]), at] = 1
                new = ~(has @ has.T > 0)[i, j]
                i, j = i[new], j[new]
            np.add.at(links, members[i], n[members[j]])
            np.add.at(links, members[j], n[members[i]])
            root = roots_of(len(members), i, j)
            joined = np.flatnonzero(root != np.arange(len(members)))
            found.append((rep[members[joined]], rep[members[root[joined]]]))

        for start, stop in zip(edges, [*edges[1:], len(block)]):
            if stop - start < 2:
                continue
            for a in range(start, stop, BLOCK):
                x = units(a, min(a + BLOCK, stop))
                compare(a, x, a, x)
                for b in range(a + BLOCK, stop, BLOCK):
                    compare(a, x, b, units(b, min(b + BLOCK, stop)))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        if not len(a):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype(np.int64)
        nodes, roots = forest(a, b)
        counts = np.zeros(len(nodes), np.int64)
        np.add.at(counts, np.searchsorted(nodes, rep[links > 0]), links[links > 0])
        return pd.DataFrame({"rep": nodes, "links": counts, "root": roots})

    solved = cut_lineage(dealt.groupBy("bin").applyInPandas(solve, "rep long, links long, root long"))
    links = solved.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(solved, "rep", "root").withColumnRenamed("node", "rep")
    members = good.select("vec_id", "class").join(classes.select("class", "rep", "n"), "class").join(links, "rep", "left").join(component, "rep", "left")
    linked = members.select("vec_id", "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    if shared_ids:  # numbers back to ids, a component's members in SALTS tasks
        names = classes.select(F.col("rep").alias("component_id"), F.col("first").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        linked = linked.withColumn("salt", F.pmod(F.xxhash64("vec_id", "class"), F.lit(SALTS)).cast("int")).join(names, ["component_id", "salt"]).withColumn("component_id", F.col("id").cast("long"))
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same in DuckDB SQL, by comparing all pairs of a label.
NEAR_DUP_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
