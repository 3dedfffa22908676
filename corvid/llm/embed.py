"""Near-duplicate vectors by int8 tile products with per-vector error bounds, rechecked in double precision.

A unit vector x is s*q + e with q in int8. For two of them |x.y - s_x s_y q_x.q_y| <= |e_x| |s_y q_y| + |e_y|, so a pair
whose product and bound stay under the threshold can't link; the others are recomputed from the whole vectors. Equal
vectors stand for one row of a tile, with their number. Vectors are grouped at their nearest pivot, and tiles of two
pivots meet only if the angle between the pivots, less the two radii, leaves room for a link.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) for every vector that can link, and (rep, vec, copies) for each different one."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(good)
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    reps = rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = materialize(reps, "vectors")
    return rows.select("id", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep"), reps.select("rep", "copies", "vec")


def _unit(vectors):
    import numpy as np

    m = np.array(vectors, dtype=np.float64)
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.linalg.norm(m, axis=1)[:, None]


def _quantise(unit):
    """int8 codes, scales, and the norms of what the codes leave out and of what they stand for, rounded up."""
    import numpy as np

    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - stands, axis=1) + 1e-12, np.linalg.norm(stands, axis=1) + 1e-12


def _tile_product(a, b, threshold: float):
    """Index pairs (i, j) with a[i].b[j] >= threshold in double precision; a and b are quantised unit vectors."""
    import numpy as np

    (ua, qa, sa, ea, _), (ub, qb, sb, eb, nb) = a, b
    # s_a s_b q_a.q_b + e_a n_b + e_b >= threshold, over s_a s_b, is one product of rows longer by two places. The slack
    # covers what float32 sums of so many places may round off.
    slack = (qa.shape[1] + 2) * 2.0**-21
    wide_b = np.column_stack([qb, nb / sb, (eb - threshold + slack) / sb]).astype(np.float32).T.copy()
    wide_a = np.column_stack([qa, ea / sa, 1 / sa]).astype(np.float32)
    out = []
    for lo in range(0, len(ua), 1024):
        i, j = np.nonzero(wide_a[lo : lo + 1024] @ wide_b >= 0)
        i += lo
        for k in range(0, len(i), 1 << 18):
            ii, jj = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            real = np.einsum("ij,ij->i", ua[ii], ub[jj]) >= threshold
            out.append((ii[real], jj[real]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = 4096, max_pivots: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths don't link. Equal vectors link with each other. Of rows with one repeated id each counts as a vector of its
    own; all show the most links of them and their smallest component. ``tile`` rows at most (in expectation) meet ``tile`` others in a task; of ``max_pivots``
    pivots, taken by a hash of the vectors, only angles and counts come to the driver.
    """
    import numpy as np

    spark = vectors.sparkSession
    members, reps = _classes(vectors, id_col, vec_col)
    n = reps.count()
    dims = [r[0] for r in reps.select(F.size("vec").alias("d")).distinct().collect()]
    edges = links = None
    for dim in dims:
        part = reps.where(F.size("vec") == dim)
        found = _links(part, part.count() if len(dims) > 1 else n, threshold, tile, max_pivots)
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        edges = spark.createDataFrame([], "kind int, a long, b long")
    edges = materialize(edges, "links")
    links = edges.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    groups = connected_components(edges.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = (
        reps.select("rep", "copies").join(links, F.col("rep") == links.a, "left")
        .select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .join(groups, F.col("rep") == groups.node, "left")
        .select("rep", "n_links", F.coalesce("component", "rep").alias("component_id"))
    )
    known = members.join(classes, "rep").select("id", "n_links", "component_id")
    known = known.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(known, F.col("vec_id") == known.id, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, n: int, threshold: float, tile: int, max_pivots: int) -> DataFrame:
    """Rows (0, rep, number of vectors linked) and (1, rep, rep) of a spanning forest, from each pair of tiles."""
    import numpy as np

    k = int(max(1, min(max_pivots, n // tile)))
    pivots = _unit([r.vec for r in reps.orderBy(F.xxhash64("vec"), "rep").select("vec").limit(k).collect()])
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6

    def home(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(np.stack(batch.column("vec").to_numpy(zero_copy_only=False)))
            angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
            at = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("vec"), pa.array(at.astype(np.int32)), pa.array(angle[np.arange(len(at)), at])], names=["rep", "copies", "vec", "pivot", "angle"])

    housed = reps.mapInArrow(home, "rep long, copies long, vec array<double>, pivot int, angle double")
    radius, tiles = np.zeros(k), np.zeros(k, np.int64)
    for r in housed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
        radius[r.pivot], tiles[r.pivot] = r.r, -(-r.n // tile)
    first = np.concatenate([[0], np.cumsum(tiles)])
    total = int(first[-1])
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) - radius[:, None] - radius[None, :]
    meets = [np.concatenate([np.arange(first[q], first[q + 1]) for q in range(k) if p == q or apart[p, q] <= reach] or [np.zeros(0, np.int64)]) for p in range(k)]

    def deal(batches) -> Iterator:
        """Each vector goes to every pair of tiles that its tile is in."""
        import pyarrow as pa

        for batch in batches:
            ids, vec = batch.column("rep").to_numpy(), batch.column("vec")
            pivot = batch.column("pivot").to_numpy()
            own = first[pivot] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles[pivot]
            for p in np.unique(pivot):
                at = np.flatnonzero(pivot == p)
                others = meets[p]
                for lo in range(0, len(at), 256):
                    rows = at[lo : lo + 256]
                    mine = np.repeat(own[rows], len(others))
                    pair = np.minimum(mine, np.tile(others, len(rows))) * total + np.maximum(mine, np.tile(others, len(rows)))
                    take = pa.array(np.repeat(rows, len(others)))
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(mine), batch.column("rep").take(take), batch.column("copies").take(take), vec.take(take)], names=["pair", "tile", "rep", "copies", "vec"])

    def product(table):
        import pyarrow as pa

        pair = table.column("pair")[0].as_py()
        t = table.column("tile").to_numpy()
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        unit = _unit(np.stack(table.column("vec").to_numpy()))
        whole = (unit, *_quantise(unit))
        low, high = divmod(pair, total)
        ia, ib = np.flatnonzero(t == low), np.flatnonzero(t == high)
        a, b = tuple(x[ia] for x in whole), tuple(x[ib] for x in whole)
        i, j = _tile_product(a, b, threshold) if len(ia) and len(ib) else (np.zeros(0, np.int64),) * 2
        i, j = ia[i], ib[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        n_links = np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
        some = np.flatnonzero(n_links)
        src, dst = forest(ids[i], ids[j]) if len(i) else (np.zeros(0, np.int64),) * 2
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(src), np.int32)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([ids[some], src])), "b": pa.array(np.concatenate([n_links[some], dst]))})

    dealt = housed.mapInArrow(deal, "pair long, tile long, rep long, copies long, vec array<double>")
    return dealt.groupBy("pair").applyInArrow(product, "kind int, a long, b long")
