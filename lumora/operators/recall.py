"""Recall: exact vector top-k, tag routes and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.vectors import dot, normalize

#: Query vectors are broadcast up to so many; beyond that Spark chooses.
BROADCAST_QUERIES = 10_000


def vector_scores(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """query_id, asset_id, score of every query (query_id, q) and asset (asset_id, v)."""
    small = len(queries.limit(BROADCAST_QUERIES + 1).select("query_id").collect()) <= BROADCAST_QUERIES
    # Each vector is normalised once, not once a pair.
    left, right = assets.select("asset_id", normalize(F.col("v")).alias("v")), queries.select("query_id", normalize(F.col("q")).alias("q"))
    return left.crossJoin(F.broadcast(right) if small else right).select("query_id", "asset_id", dot(F.col("v"), F.col("q")).alias("score"))


def topk(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "asset_id") -> DataFrame:
    """The k best of each query with rank from 1; the smaller id wins ties."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def max_union(routes: list[DataFrame]) -> DataFrame:
    """The best score of each (query_id, asset_id) over all routes, and the route that gave it (first by name on ties)."""
    every = routes[0]
    for r in routes[1:]:
        every = every.unionByName(r)
    best = F.min_by("route", F.struct(-F.col("score"), F.col("route")))
    return every.groupBy("query_id", "asset_id").agg(F.max("score").alias("score"), best.alias("route"))


#: Terms meet texts on a window of KEY words.
KEY = 3


def containments(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, item_id where a text holds a term (item_id, term) as it is. A text with the term has the words inside of it, all
    but its first and last, which may be parts of longer words. So terms and texts meet on the first KEY of these, and what
    meets is verified. Terms of fewer words are compared with all texts, which their number bounds."""
    words = F.split("term", r"\s+")
    keyed = terms.withColumn("key", F.when(F.size(words) >= KEY + 2, F.array_join(F.slice(words, 2, KEY), " ")))
    long = keyed.filter("key IS NOT NULL")
    places = docs.withColumn("w", F.split("text", r"\s+")).select("doc_id", F.expr(f"explode(array_distinct(transform(sequence(0, greatest(size(w) - {KEY}, 0)), i -> concat_ws(' ', slice(w, i + 1, {KEY})))))").alias("key"))
    # Only the keys of terms go on, so the texts are joined to few rows.
    met = places.join(long.select("key").distinct(), "key", "left_semi").join(long, "key").select("doc_id", "item_id", "term")
    verified = docs.join(met, "doc_id").filter(F.contains(F.col("text"), F.col("term"))).select("doc_id", "item_id")
    short = docs.join(keyed.filter("key IS NULL"), F.contains(F.col("text"), F.col("term"))).select("doc_id", "item_id")
    return verified.unionByName(short)


#: Rows of a tile, and how many numbers of a product are held at once.
TILE = 2048


def unit_rows():
    """The function from a tile's numbers to unit vectors; a zero vector stays as it is. It travels to the workers by value,
    so they need not have this package."""
    import numpy as np

    def units(m: bytes, kind: str, rows: int):
        x = np.frombuffer(m, kind).reshape(rows, -1).astype("<f8")
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm == 0, 1, norm)

    return units


def tiled(vectors: DataFrame, threshold: float | None = None) -> tuple[DataFrame, str]:
    """Tiles (tile, ids, m, labels, own) of up to TILE vectors (asset_id, v) as they lie, without a shuffle, written once, and
    the kind of number in `m`. With a threshold, `labels` has for each row the least id of its tile that links of a cosine
    above it reach, and `own` the different ones among these. Null vectors are left out."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from lumora.operators.graph import _kept

    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    names, size, units, rows = ["tile", "ids", "m", "labels", "own"], TILE, unit_rows(), vectors.select("asset_id", "v").filter("v IS NOT NULL")

    def lay(batches):
        tile, held = TaskContext.get().partitionId() << 32, []

        def out(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by("asset_id").combine_chunks()
            ids = table.column("asset_id").to_numpy().astype("<i8")
            m = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            labels = ids
            if threshold is not None:
                x = units(m, kind, len(ids))
                near = np.concatenate([x[k : k + 256] @ x.T > threshold for k in range(0, len(x), 256)])
                at = np.full(len(ids), -1)
                for first in range(len(ids)):
                    if at[first] < 0:
                        at[first], front = first, np.array([first])
                        while len(front):
                            front = np.flatnonzero(near[front].any(0) & (at < 0))
                            at[front] = first
                labels = ids[at]
            cols = [pa.array([tile], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), m, labels.tobytes()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([np.unique(labels).tolist()], pa.list_(pa.int64()))], names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, size))
                tile, held = tile + 1, table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    return _kept(rows.mapInArrow(lay, "tile long, ids binary, m binary, labels binary, own array<long>")), kind


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) of vectors (asset_id, v) whose cosine is above `threshold`. Each pair of tiles meets once and is one
    product of matrices; only pairs above the threshold are rows. Every pair is compared, as the definition asks, so the work
    grows with the square of the table, but a task never holds more than a partition of tiles, and tiles are read again,
    not copied to disk, for each partition that they meet."""
    import numpy as np
    import pyarrow as pa

    tiles, kind = tiled(vectors)
    units = unit_rows()
    left, right = tiles.select("tile", "ids", "m"), tiles.select(F.col("tile").alias("other"), F.col("ids").alias("ids_b"), F.col("m").alias("m_b"))
    met = left.join(right.hint("shuffle_replicate_nl"), F.col("tile") <= F.col("other"))

    def multiply(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                a, b = (np.frombuffer(row[c], "<i8") for c in ("ids", "ids_b"))
                x, y = units(row["m"], kind, len(a)), units(row["m_b"], kind, len(b))
                for k in range(0, len(a), 256):
                    i, j = np.nonzero(x[k : k + 256] @ y.T > threshold)
                    p, q = a[k + i], b[j]
                    keep = p < q if row["tile"] == row["other"] else p != q
                    p, q = p[keep], q[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return met.mapInArrow(multiply, "a long, b long")
