"""Graph operators: components by minimum labels, numbering, non-maximum suppression, online clusters."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """A durable cut of the lineage in the session's shared folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumora-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node that edges (a, b) reach; nodes without edges are their own and take no part in
    the rounds, so that what these write follows the edges."""
    both = _kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = _kept(ends.join(nodes.select("node"), "node", "left_semi").select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.toDF("a", "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jumped = _kept(least.join(labels.toDF("new", "far"), "new").select("node", "label", F.least("new", "far").alias("new")))
        labels = jumped.select("node", F.col("new").alias("label"))
        if jumped.filter("new <> label").isEmpty():
            return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def similar_components(vectors: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of vectors (asset_id, v): the least id that links of a cosine above `threshold` reach.

    Links are not written, only those that join what a task has not joined yet. Tiles find their own components; all meet
    the first tile; then only vectors outside of the largest component so far meet the others, since links inside of it
    change nothing. So without a large component every pair is compared, and pairs of these vectors twice.
    """
    import numpy as np
    import pyarrow as pa

    from lumora.operators.recall import TILE, tiled, unit_rows

    tiles, kind = tiled(vectors, threshold)
    size, units = TILE, unit_rows()

    def join(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        for batch in batches:
            links = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                (a, of), (b, by) = (np.unique(np.frombuffer(row[c], "<i8"), return_inverse=True) for c in ("labels", "labels_b"))
                if len({root(x) for x in a.tolist()} | {root(x) for x in b.tolist()}) == 1:
                    continue
                x, y, near = units(row["m"], kind, len(of)), units(row["m_b"], kind, len(by)), np.zeros((len(a), len(b)), bool)
                for k in range(0, len(x), 256):
                    i, j = np.nonzero(x[k : k + 256] @ y.T > threshold)
                    near[of[k + i], by[j]] = True
                # A tree for each component of this pair of tiles.
                new_a, new_b = near.any(1), np.ones(len(b), bool)
                for first in np.flatnonzero(new_a):
                    front = np.array([first]) if new_a[first] else ()
                    while len(front):
                        new_a[front] = False
                        others = np.flatnonzero(near[front].any(0) & new_b)
                        new_b[others] = False
                        front = np.flatnonzero(near[:, others].any(1) & new_a)
                        for q in (*b[others].tolist(), *a[front].tolist()):
                            p, q = root(int(a[first])), root(q)
                            if p != q:
                                up[max(p, q)] = min(p, q)
                                links.append((max(p, q), min(p, q)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(F.col("m").alias("m_b"), F.col("labels").alias("labels_b"))
        return _kept(left.select("m", "labels").join(right.hint("shuffle_replicate_nl")).mapInArrow(join, "a long, b long"))

    def counted(batches):
        for batch in batches:
            n = sum(int(np.isin(np.frombuffer(r["labels"], "<i8"), r["some"]).sum()) for r in batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def outside(batches):
        m, labels = [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in (m, labels)], ["m", "labels"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = np.frombuffer(row["labels"], "<i8")
                keep = np.flatnonzero(np.isin(own, row["some"]))
                vs = np.frombuffer(row["m"], kind).reshape(len(own), -1)
                for k in keep.tolist():
                    m.append(vs[k].tobytes())
                    labels.append(own[k].tobytes())
                    if len(m) == size:
                        yield out()
                        m.clear(), labels.clear()
        if m:
            yield out()

    own = tiles.select("tile", F.explode("own").alias("node"))
    first = tiles.agg(F.min("tile")).first()[0]
    links = joined(tiles, tiles.filter(F.col("tile") == (-1 if first is None else first)))
    roots = components(own.select("node"), links)
    # The component of most tile components: any choice gives the same result.
    largest = roots.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()
    if largest:
        some = _kept(own.join(roots.filter(F.col("label") != largest.label), "node").groupBy("tile").agg(F.collect_list("node").alias("some")))
        # Each partition of tiles reads all of `some`, a number for each component of a tile; vectors are not dealt out for it.
        # A row is at most TILE numbers, and the product spills what is more than memory holds.
        some = some.coalesce(1).withColumnRenamed("tile", "of").hint("shuffle_replicate_nl")
        met = tiles.join(some, F.col("tile") == F.col("of"))
        n = met.select("labels", "some").mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0
        # Where they are half of the vectors, the tiles themselves are what all meet, instead of a copy of most of them.
        apart = 2 * n >= tiles.agg(F.sum(F.octet_length("labels") / 8)).first()[0]
        rest = tiles if apart else _kept(met.select("m", "labels", "some").mapInArrow(outside, "m binary, labels binary"))
        roots = components(own.select("node"), links.union(joined(tiles, rest)))

    def rows(batches):
        for batch in batches:
            for ids, labels in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (ids, labels)], ["node", "own"])

    placed = tiles.select("ids", "labels").mapInArrow(rows, "node long, own long").join(roots.toDF("own", "label"), "own").select("node", "label")
    return placed.union(vectors.filter("v IS NULL").select("asset_id", "asset_id"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its place from 1 in the unique `order`. Ranges are sorted and counted each for itself, and only the counts,
    one for each partition, are summed in one place."""
    placed = _kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def numbered_clusters(labels: DataFrame) -> DataFrame:
    """Adds cluster size and `person_%04d`, the largest first, then the one whose least node comes first."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("face_count"))
    named = numbered(sizes, [F.desc("face_count"), F.col("label")], "_place").withColumn("person_id", F.format_string("person_%04d", "_place")).drop("_place")
    return labels.join(named, "label")


def non_max_suppression(boxes: Column, iou: float = 0.35, containment: float = 0.62) -> Column:
    """Folds an array of boxes (x, y, w, h), ordered by descending area: a box stays if it overlaps no kept one."""

    def clear(k: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(k.x + k.w, b.x + b.w) - F.greatest(k.x, b.x))
        h = F.greatest(F.lit(0.0), F.least(k.y + k.h, b.y + b.h) - F.greatest(k.y, b.y))
        inter = w * h
        union, least = k.w * k.h + b.w * b.h - inter, F.least(k.w * k.h, b.w * b.h)
        return (F.coalesce(F.try_divide(inter, union), F.lit(0.0)) < iou) & (F.coalesce(F.try_divide(inter, least), F.lit(0.0)) < containment)

    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.forall(kept, lambda k: clear(k, b)), F.concat(kept, F.array(b))).otherwise(kept))


def online_clusters(faces: DataFrame, threshold: float) -> DataFrame:
    """Leader clustering of (library, face_id, v) in order of face_id: the nearest centroid at `threshold` or above takes a
    face and moves to the running mean, made a unit vector again, else the face opens a cluster. A library is one ordered group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("face_id")
        centres, counts, out = np.zeros((0, 0)), [], []
        for v in rows["v"]:
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1.0)
            if not counts:
                centres = v[None, :]
            else:
                sims = centres @ v
                k = int(np.argmax(sims))
                if sims[k] >= threshold:
                    mean = (centres[k] * counts[k] + v) / (counts[k] + 1)
                    centres[k] = mean / (np.linalg.norm(mean) or 1.0)
                    counts[k] += 1
                    out.append(k)
                    continue
                centres = np.vstack([centres, v])
            out.append(len(counts))
            counts.append(1)
        return pd.DataFrame({"library": rows["library"], "face_id": rows["face_id"], "cluster": out})

    return faces.groupBy("library").applyInPandas(run, "library string, face_id long, cluster long")
