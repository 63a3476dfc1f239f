"""Example index and nearest-example retrieval (SQL-13, SQL-14).

Exact k-nearest search by a partitioned metric index.  A few stored vectors
are pivots; every stored vector belongs to the cell of its nearest pivot and
keeps its distance to it.  A query first searches its own cell, which bounds
its k-th distance; then it goes only to the cells that the triangle inequality
lets that bound reach.  Cells and their queries are cut into chunks, and no
vector but the pivots passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.operators.profile import top_k
from sparktab.operators.sequence import stable


def refresh_index(indexed: DataFrame, candidates: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """SQL-13: rows of ``candidates`` whose id is not indexed yet, and the new index."""
    new = candidates.join(indexed.select(key), key, "left_anti")
    return new, indexed.unionByName(new)


def sq_l2(a, b):
    """Squared Euclidean distance of two array<double> columns."""
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


PIVOTS = 64  # sampled vectors, the only ones that the driver sees
CHUNK = 4000  # about so many stored vectors, and so many queries, meet in one task
STORE_ROWS = 256  # store rows compared at a time: bounds a task's distance matrix to a query chunk x this
SLACK = 1e-9  # of the bounds, relative: no rounding can exclude a neighbour


def _distances(a, b):
    """Squared distances of all rows of ``a`` to all of ``b``, summed dimension by dimension, in order."""
    import numpy as np
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j:j + 1] - b[None, :, j]
        out += diff * diff
    return out


def _matrix(column):
    import numpy as np
    return np.stack(column.to_numpy()).astype(np.float64)


def _placed(rows: DataFrame, key: str, vec: str, pivots) -> DataFrame:
    """(id, v, cell, near): the nearest pivot (the first of equals) and the distance to it."""
    import numpy as np
    import pandas as pd

    def place(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                some = pdf.iloc[at:at + 4096]
                d = np.sqrt(_distances(_matrix(some["v"]), pivots))
                cell = d.argmin(1)
                yield pd.DataFrame({"id": some["id"].to_numpy(np.int64), "v": some["v"].to_numpy(), "cell": cell.astype(np.int32),
                                    "near": d[np.arange(len(d)), cell]})

    return rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")) \
        .mapInPandas(place, "id bigint, v array<double>, cell int, near double")


def _compare(asked: DataFrame, store: DataFrame, chunks: dict[int, int], asks: dict[int, int], k: int) -> DataFrame:
    """(qid, sid, distance), up to k a query and task: ``asked`` (qid, v, cell,
    near, reach) against the stored vectors of the same cell whose distance to
    the pivot differs by at most ``reach``."""
    import numpy as np
    import pandas as pd

    number = lambda of: F.element_at(F.create_map(*[F.lit(x) for c, n in of.items() for x in (c, n)]), F.col("cell"))
    s = store.where(F.col("cell").isin(list(asks))).withColumn("schunk", F.pmod(F.xxhash64("id"), number(chunks)).cast("int")) \
        .withColumn("qchunk", F.explode(F.sequence(F.lit(0), number(asks) - 1)))
    q = asked.withColumn("qchunk", F.pmod(F.xxhash64("qid"), number(asks)).cast("int")).withColumn("schunk", F.explode(F.sequence(F.lit(0), number(chunks) - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "sid": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})
        if not len(left) or not len(right):
            return held
        qv, qid, qn, reach = _matrix(left["v"]), left["qid"].to_numpy(), left["near"].to_numpy(), left["reach"].to_numpy()
        right = right.sort_values("near")  # a slice of the store is a ring round the pivot
        for at in range(0, len(right), STORE_ROWS):
            some = right.iloc[at:at + STORE_ROWS]
            sn = some["near"].to_numpy()
            here = np.flatnonzero((qn + reach >= sn[0]) & (qn - reach <= sn[-1]))
            if not len(here):
                continue
            sid = some["id"].to_numpy()
            d = _distances(qv[here], _matrix(some["v"]))
            order = np.lexsort((np.broadcast_to(sid, d.shape), d))[:, :k]  # by distance, then id
            held = pd.concat([held, pd.DataFrame({"qid": np.repeat(qid[here], order.shape[1]), "sid": sid[order].ravel(),
                                                  "distance": np.take_along_axis(d, order, 1).ravel()})])
            held = held.sort_values(["qid", "distance", "sid"]).groupby("qid").head(k)
        return held

    keys = ["cell", "schunk", "qchunk"]
    return q.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(best, "qid bigint, sid bigint, distance double")


def nearest(queries: DataFrame, store: DataFrame, k: int = 5, qid: str = "qid", sid: str = "sid",
            vec: str = "embedding", pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """SQL-14: the k stored vectors nearest to each query (ties by id), exact:
    (qid, sid, squared distance, rank).

    ``pivots`` vectors are taken from the store by a hash of their id; they
    decide the speed only.  Rows without an id or a vector are left out; ids
    are integers and a query's id is unique; an empty store or no query gives
    no rows; with fewer than k stored vectors each query gets all of them."""
    import numpy as np
    picked = store.where(F.col(vec).isNotNull() & F.col(sid).isNotNull()).orderBy(F.xxhash64(sid, F.lit(5)), sid).limit(pivots).select(vec).collect()  # bounded
    none = store.sparkSession.createDataFrame([], f"{qid} bigint, {sid} bigint, distance double, rank int")
    if not picked:
        return none
    p = np.unique(np.array([r[0] for r in picked], np.float64), axis=0)
    s = stable(_placed(store, sid, vec, p))
    q = stable(_placed(queries, qid, vec, p).withColumnRenamed("id", "qid"))
    cells = {r["cell"]: r for r in s.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("lo"), F.max("near").alias("hi")).collect()}  # one row a pivot
    chunks = {c: -(-r["n"] // chunk) for c, r in cells.items()}

    def rounds(asked: DataFrame) -> DataFrame | None:
        sizes = {r["cell"]: -(-r["n"] // chunk) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        return _compare(asked, s, {c: chunks[c] for c in sizes}, sizes, k) if sizes else None

    # a pivot's own cell holds the pivot, so no cell is empty
    home = rounds(q.withColumn("reach", F.lit(float("inf"))))
    if home is None:
        return none
    home = stable(top_k(home, ["qid"], [F.col("distance"), F.col("sid")], k, out="rank"))
    bound = home.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance")) * (1 + SLACK) + SLACK).otherwise(F.lit(float("inf"))).alias("reach"))
    order = sorted(cells)
    pivot_of = p[order]
    lo, hi, held = (np.array([cells[c][x] for c in order]) for x in ("lo", "hi", "n"))

    def reached(batches):
        import pandas as pd
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                some = pdf.iloc[at:at + 4096]
                d = np.sqrt(_distances(_matrix(some["v"]), pivot_of))
                # all of a cell lies within d + hi: the nearest cells that hold k vectors bound the k-th distance too
                far = np.argsort(d + hi, axis=1)
                enough = np.minimum((np.cumsum(held[far], axis=1) < k).sum(1), len(order) - 1)
                bound = np.take_along_axis(d + hi, far, 1)[np.arange(len(d)), enough] * (1 + SLACK) + SLACK
                r = np.minimum(some["reach"].to_numpy(), bound if held.sum() >= k else np.inf)[:, None]
                # a vector of the cell lies lo..hi from its pivot, so at least d - hi and lo - d from the query
                row, cell = np.nonzero((d - hi <= r) & (lo - d <= r) & (np.array(order) != some["cell"].to_numpy()[:, None]))
                yield pd.DataFrame({"qid": some["qid"].to_numpy()[row], "v": some["v"].to_numpy()[row], "cell": np.array(order, np.int32)[cell],
                                    "near": d[row, cell], "reach": r[row, 0]})

    away = stable(q.join(bound, "qid").mapInPandas(reached, "qid bigint, v array<double>, cell int, near double, reach double"))
    more = rounds(away)
    found = home.drop("rank") if more is None else home.drop("rank").unionByName(more)
    top = top_k(found, ["qid"], [F.col("distance"), F.col("sid")], k, out="rank")
    return top.select(F.col("qid").alias(qid), F.col("sid").alias(sid), "distance", "rank")
