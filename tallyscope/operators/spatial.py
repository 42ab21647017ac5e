"""Spatial weights and Moran statistics with permutation tests.

KNN weights (J3) are an exact join over a grid whose cells follow the density, never a cross
join. The bounding square is halved level by level; a point starts at the first level at which
its cell holds few points, so a crowded city starts with small cells and an empty region with
large ones. At each level, from the finest up, a still-open point joins the 3x3 block of cells
around its own. Every point outside that block is farther than the cell side, so a point whose
k-th candidate distance is within the side has its exact k nearest neighbours (ties by
Precinct_ID) and is closed; open points go on to the next, coarser level. A cell of a level is
read only by the few points that start or are still open there, so no cell joins itself in
full. The data side keeps the ``k+1`` smallest ids at each exact location, as no other point
there can be a neighbour of anyone; that ranking runs inside salted sub-groups first, so a
location holding a third of all rows is no hot group.

Polygon contiguity (J4, M8): vertices (queen) or undirected edges (rook) are
exploded and equi-joined; weights are row-standardised.

Moran (M6): mean-centred values, spatial lag by a grouped join over the edge list, global and
local statistics in one aggregation. Permutation p gives node i the value of node image_p(i)
under a keyed bijection (``functions.permute``) that any engine can recompute, so nothing is
sorted. Up to BROADCAST_NODES nodes the values are one broadcast vector and every node adds up
its permuted neighbours where it is; beyond, values travel as rows that hold PACK permutations
in an array, so the shuffle is n * k * P / PACK rows. Both give the same counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.adjust import benjamini_hochberg
from ..functions.index import consecutive_index
from ..functions.joins import join_dimension
from ..functions.permute import image, images, key_arrays, rounds_literal
from ..schema import SpatialParams
from ..session import ensure_checkpoint_dir, ship_package
from .common import AnalysisUnavailable, MethodResult

EPS = float(np.finfo(float).eps)
#: Nodes whose values are broadcast (64 MB); more travel as rows.
BROADCAST_NODES = 1 << 23
#: Permutations handled together, edges of a task looked at together, neighbours of a node in one list.
PACK, EDGE_BLOCK, HUB_NEIGHBOURS = 64, 1 << 13, 1 << 16
#: Edges whose ends are permuted once for all of them, nodes of a task, and bits of a coordinate that order nodes by place.
SHARED_EDGES, TASK_NODES, PLACE_BITS = 1 << 17, 1 << 14, 16
PRUNE_SALTS = 32
#: Points whose candidates one task ranks: their number, not the size of the shuffle, names the tasks.
POINTS_PER_TASK = 1 << 14


def _prune_locations(nodes: DataFrame, keep: int) -> DataFrame:
    """Keep the ``keep`` smallest ids per exact (x, y) location (salted two-level rank)."""
    salted = nodes.withColumn("_salt", F.abs(F.xxhash64("id")) % PRUNE_SALTS)
    w1 = Window.partitionBy("x", "y", "_salt").orderBy("id")
    first = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= keep).drop("_r", "_salt")
    w2 = Window.partitionBy("x", "y").orderBy("id")
    return first.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= keep).drop("_r")


#: Levels looked at in one pass when the starting levels are sought, and the finest level there is
#: (a cell side of 2**-48 of the square: doubles hardly tell such places apart).
LEVEL_STEP = 6
FINEST = 48


def _cell(x: str, origin: float, span: float) -> Column:
    """Cell coordinate at the level in column ``lv``."""
    return F.floor((F.col(x) - F.lit(origin)) / F.lit(span) * F.pow(F.lit(2.0), F.col("lv"))).cast("long")


def _start_levels(nodes: DataFrame, data: DataFrame, crowd: int, first: int, x0: float, y0: float, span: float) -> DataFrame:
    """(id, x, y, start): the first level from ``first`` on at which the point's cell holds at most ``crowd`` data points."""
    found, left, low = [], nodes.select("id", "x", "y"), first
    while True:
        high = min(low + LEVEL_STEP - 1, FINEST)
        levels = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lv")
        cells = data.select("nx", "ny", levels).groupBy("lv", _cell("nx", x0, span).alias("cx"), _cell("ny", y0, span).alias("cy")).count()
        # cells only get emptier, so the number of crowded levels names the first other one
        packed = cells.filter(F.col("count") > crowd).select("lv", "cx", "cy")
        seen = left.select("id", "x", "y", levels).select("id", "x", "y", "lv", _cell("x", x0, span).alias("cx"), _cell("y", y0, span).alias("cy"))
        crowded = seen.join(packed, ["lv", "cx", "cy"], "left_semi").groupBy("id").agg(F.max("lv").alias("deep"))
        now = left.join(crowded, "id", "left").select("id", "x", "y", (F.coalesce("deep", F.lit(low - 1)) + 1).alias("start")).checkpoint()
        if high == FINEST:
            return _union([*found, now.withColumn("start", F.least("start", F.lit(FINEST)))])
        found.append(now.filter(F.col("start") <= high))
        left = now.filter(F.col("start") > high).select("id", "x", "y")
        if left.isEmpty():
            return _union(found)
        low = high + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def knn_edges(nodes: DataFrame, k: int, candidates: list[int] | None = None) -> DataFrame:
    """Exact k-nearest-neighbour edges (src, dst, dist) for nodes (id of any ordered type, x, y DOUBLE).

    ``k`` must already be min(k, n - 1). ``candidates``, if given, gets the number of pairs
    that each level compared.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    st = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                   F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, y0 = float(st["x0"]), float(st["y0"])
    # a little wider than the points, so that the last ones lie inside the last cell
    span = max(float(st["x1"]) - x0, float(st["y1"]) - y0, 1e-12) * (1 + 1e-9)
    data = _prune_locations(nodes, k + 1).select(F.col("id").alias("nid"), F.col("x").alias("nx"), F.col("y").alias("ny")).checkpoint()
    crowd = 2 * (k + 1)
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-int(st["n"]) // POINTS_PER_TASK))
    first = max(0, int(math.log(max(int(st["n"]) / crowd, 1.0), 4)) - 1)
    started = _start_levels(nodes, data, crowd, first, x0, y0, span)
    todo = sorted((r["start"] for r in started.select("start").distinct().collect()), reverse=True)
    open_q, found, level = None, [], todo[0]
    block = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("o")
    while True:
        here = started.filter(F.col("start") == level).select("id", "x", "y")
        here = here if open_q is None else here.unionByName(open_q)
        lv = F.lit(level).alias("lv")
        q = here.select("id", "x", "y", lv, block).select(
            "id", "x", "y", (_cell("x", x0, span) + F.col("o.dx")).alias("cx"), (_cell("y", y0, span) + F.col("o.dy")).alias("cy"))
        d = data.select("nid", "nx", "ny", lv).select("nid", "nx", "ny", _cell("nx", x0, span).alias("cx"), _cell("ny", y0, span).alias("cy"))
        cand = q.repartition(tasks, "cx", "cy").join(d.repartition(tasks, "cx", "cy"), ["cx", "cy"]).filter(F.col("id") != F.col("nid")).select(
            "id", "x", "y", "nid", F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)).alias("dist"))
        if candidates is not None:
            candidates.append(cand.count())
        if level > 0:
            # the k-th neighbour must lie within the cell side, or something outside the block may be nearer
            cand = cand.filter(F.col("dist") <= F.lit(span / 2.0**level))
        by_distance = Window.partitionBy("id").orderBy("dist", "nid")
        top = cand.withColumn("_r", F.row_number().over(by_distance)).filter(F.col("_r") <= k)
        if level > 0:
            top = top.withColumn("_ok", F.count(F.lit(1)).over(Window.partitionBy("id")) == k)
        else:
            top = top.withColumn("_ok", F.lit(True))  # the block holds everything
        top = top.checkpoint()
        closed = top.filter("_ok")
        found.append(closed.select(F.col("id").alias("src"), F.col("nid").alias("dst"), "dist"))
        if level == 0:
            return _union(found)
        open_q = here.join(closed.select("id").distinct(), "id", "left_anti").checkpoint()
        coarser = [t for t in todo if t < level]
        if not open_q.isEmpty():
            level -= 1
        elif coarser:
            level, open_q = coarser[0], None
        else:
            return _union(found)


def polygon_edges(polys: DataFrame, kind: str) -> DataFrame:
    """Queen (shared vertex) or rook (shared edge) contiguity edges (src, dst) from rings."""
    if kind not in ("queen", "rook"):
        raise ValueError("polygon weights must be queen or rook")
    ring = F.col("Geometry")
    if kind == "queen":
        keys = polys.select(F.col("Precinct_ID").alias("id"),
                            F.explode(F.transform(ring, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))).alias("key"))
    else:
        seg = F.transform(
            F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring)).alias("b")),
            lambda e: F.array_join(F.array_sort(F.array(
                F.concat_ws(",", e["a"]["x"].cast("string"), e["a"]["y"].cast("string")),
                F.concat_ws(",", e["b"]["x"].cast("string"), e["b"]["y"].cast("string")))), "|"),
        )
        keys = polys.select(F.col("Precinct_ID").alias("id"), F.explode(seg).alias("key"))
    return _meeting(keys.distinct().checkpoint())


#: Rings of one vertex or edge that meet in one group.
MEETING_RINGS = 64


def _meeting(keys: DataFrame) -> DataFrame:
    """(src, dst): ordered pairs of different ids that share a key, from distinct (id, key).

    The ids of a key are dealt to parts of about MEETING_RINGS, and each two parts meet in a group
    of their own: a hub is pairs of parts, spread over all tasks, and no group grows with it. A key
    of one id takes no part. Pairs of a hub are its result, so their number is what it must be.
    """
    ids = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    hubs = ids.filter(F.col("k") > MEETING_RINGS).select("key", F.ceil(F.col("k") / MEETING_RINGS).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = join_dimension(keys, hubs, "key", "left").select("id", "key", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).alias("part"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    a = dealt.select(F.col("id").alias("src"), "key", F.col("part").alias("i"), every.alias("j"))
    b = dealt.select(F.col("id").alias("dst"), "key", every.alias("i"), F.col("part").alias("j"))
    return a.join(b, ["key", "i", "j"]).filter("src <> dst").select("src", "dst").distinct()


def row_standardise(edges: DataFrame) -> DataFrame:
    """w = 1 / out-degree, one grouped count joined back on the source id."""
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_deg"))
    return edges.join(deg, "src").select("src", "dst", (1.0 / F.col("_deg")).alias("w"))


QUADRANT = ("high-high cluster", "low-low cluster", "high-low spatial outlier", "low-high spatial outlier")


#: Two statistics this close (relative) count as equal.
TIE = 1e-9


def _place(nodes: DataFrame) -> Column:
    """The bits of both coordinates in turn, so that near nodes mostly have near places."""
    st = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    cell = lambda c, lo, hi: F.floor((F.col(c) - F.lit(lo)) / F.lit(max(hi - lo, 1e-12)) * F.lit((1 << PLACE_BITS) - 1)).cast("bigint")
    both = cell("x", st[0], st[1]), cell("y", st[2], st[3])
    bit = lambda turn, b: F.shiftleft(F.shiftright(both[turn], b).bitwiseAND(F.lit(1).cast("bigint")), 2 * b + turn)
    return sum((bit(turn, b) for b in range(PLACE_BITS) for turn in (0, 1)), F.lit(0).cast("bigint"))


def permuted_counts(nodes: DataFrame, edges: DataFrame, n: int, denom: float, observed: float, permutations: int, seed: int) -> tuple[DataFrame, int]:
    """How often permuted statistics reach the observed ones.

    ``nodes`` (id, idx 0..n-1, z, local_i; place, if given, is near for nodes that are near),
    ``edges`` (src, dst indexes, w). Returns the counts
    per node (idx, cnt; nodes without edges left out) and the count of the global statistic.
    """
    gathered = n <= BROADCAST_NODES
    found = (_counts_from_vector if gathered else _counts_from_rows)(nodes, edges, n, denom, permutations, seed).checkpoint()
    reached = found.filter("idx IS NULL").groupBy("p").agg(F.sum("t").alias("t")).agg(F.count_if(F.abs(F.col("t") / F.lit(denom)) >= abs(observed) * (1 - TIE))).first()[0]
    return found.filter("idx IS NOT NULL").groupBy("idx").agg(F.sum("cnt").alias("cnt")), int(reached)


def _counts_from_vector(nodes: DataFrame, edges: DataFrame, n: int, denom: float, permutations: int, seed: int) -> DataFrame:
    """(idx, cnt) per node and (p, t) per task and permutation, no shuffle: a node finds the values of its
    permuted neighbours in the broadcast vector."""
    column = nodes.select("idx", "z").toArrow()
    z = np.empty(n)
    z[column.column("idx").to_numpy()] = column.column("z").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(z)
    scale = denom / n
    nodes = nodes if "place" in nodes.columns else nodes.withColumn("place", F.col("idx"))
    # a hub's neighbours are added up in pieces
    piece = F.pmod(F.xxhash64("dst"), F.lit(max(1, n // HUB_NEIGHBOURS))).alias("piece")
    lists = edges.groupBy("src", piece).agg(F.collect_list(F.struct("dst", "w")).alias("near"))
    whole = lists.groupBy("src").agg(F.flatten(F.collect_list("near")).alias("near")) if n > HUB_NEIGHBOURS else lists.drop("piece")
    rows = nodes.select("idx", "local_i", "place").join(whole.withColumnRenamed("src", "idx"), "idx")
    rows = rows.checkpoint()  # ranges are drawn from a pass of their own
    # neighbours in one batch, so that most ends of its edges are shared
    tasks = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_NODES))
    rows = rows.repartitionByRange(tasks, "place", "idx").sortWithinPartitions("place", "idx").drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        total = np.zeros(permutations)
        for rb in batches:
            near = rb.column("near")
            dst, w = (np.asarray(near.flatten().field(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            first = np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False))])
            own, local = rb.column("idx").to_numpy(), np.abs(rb.column("local_i").to_numpy())
            count = np.zeros(len(own), np.int64)
            for i, j in _row_blocks(first, SHARED_EDGES):
                count[i:j] += _reached(z, own[i:j], local[i:j], dst[first[i] : first[j]], w[first[i] : first[j]], first[i : j + 1] - first[i], scale, seed, total)
            none = pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count), *none], ["idx", "cnt", "p", "t"])
        none = pa.nulls(permutations, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.arange(permutations, dtype=np.int32)), pa.array(total)], ["idx", "cnt", "p", "t"])

    return rows.mapInArrow(run, "idx bigint, cnt bigint, p int, t double")


def _reached(z: np.ndarray, own: np.ndarray, local: np.ndarray, dst: np.ndarray, w: np.ndarray, first: np.ndarray, scale: float, seed: int, total: np.ndarray) -> np.ndarray:
    """How many permutations reach |I_i| at each of the nodes ``own``, whose edges (``dst``, ``w``) begin at
    ``first``; ``total`` gets the sums of the global statistic."""
    n, count = len(z), np.zeros(len(own), np.int64)
    shared = len(dst) <= 2 * SHARED_EDGES  # a hub of more is looked up piece by piece
    ends, place = np.unique(np.concatenate([own, dst]) if shared else own, return_inverse=True)
    for a in range(0, len(total), PACK):
        pair, offset = key_arrays(seed, a, min(a + PACK, len(total)), n)
        values = np.empty((len(ends), pair.shape[1]))
        for k in range(0, len(ends), EDGE_BLOCK // 8):
            values[k : k + EDGE_BLOCK // 8] = z[images(ends[k : k + EDGE_BLOCK // 8], pair, offset, n)]
        for i, j in _row_blocks(first, EDGE_BLOCK):
            lag = np.zeros((j - i, pair.shape[1]))
            degree = int(first[i + 1] - first[i])
            even = shared and degree * (j - i) == first[j] - first[i] and bool((np.diff(first[i : j + 1]) == degree).all())
            # neighbour by neighbour where all nodes have as many
            for t in range(degree) if even else ():
                at = slice(first[i] + t, first[j], degree)
                lag += values.take(place[len(own) :][at], axis=0) * w[at, None]
            for lo in () if even else range(int(first[i]), int(first[j]), EDGE_BLOCK):
                hi = min(lo + EDGE_BLOCK, int(first[j]))
                part = values[place[len(own) + lo : len(own) + hi]] if shared else z[images(dst[lo:hi], pair, offset, n)]
                part *= w[lo:hi, None]
                row = np.searchsorted(first, np.arange(lo, hi), "right") - 1 - i
                head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                lag[row[head]] += np.add.reduceat(part, head, axis=0)
            total[a : a + PACK] += (values[place[i:j]] * lag).sum(0)
            count[i:j] += (np.abs(z[own[i:j], None] * lag / scale) >= local[i:j, None] * (1 - TIE)).sum(1)
    return count


def _row_blocks(first: np.ndarray, edges: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``edges`` edges."""
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + edges, "right")) - 1)
        yield i, j
        i = j


def _counts_from_rows(nodes: DataFrame, edges: DataFrame, n: int, denom: float, permutations: int, seed: int) -> DataFrame:
    """The same for any number of nodes: values travel to their places, PACK permutations in a row's array.

    A block of permutations shuffles n narrow rows a permutation once and n arrays an edge; hubs are
    pre-aggregated. Every block is checkpointed, so the disk holds one block's shuffle.
    """
    found = None
    for a in range(0, permutations, PACK):
        block = range(a, min(a + PACK, permutations))
        turns = F.array(*[F.struct(F.lit(p).alias("p"), rounds_literal(seed, p, n, inverse=True).alias("rounds")) for p in block])
        sent = nodes.select("idx", "z", F.explode(turns).alias("turn")).select(image(F.col("idx"), F.col("turn.rounds"), n).alias("pos"), "turn.p", "z")
        packed = sent.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("p", "z"))).alias("values")).select("pos", F.col("values.z").alias("zs")).checkpoint()
        lags = edges.join(packed, F.col("dst") == F.col("pos")).groupBy("src").agg(F.array(*[F.sum(F.col("w") * F.col("zs")[i]) for i in range(len(block))]).alias("lags"))
        both = lags.join(packed.withColumnRenamed("pos", "src"), "src").join(nodes.select(F.col("idx").alias("src"), "z", "local_i"), "src")
        hits = F.aggregate("lags", F.lit(0).cast("bigint"), lambda acc, g: acc + (F.abs(F.col("z") * g / F.lit(denom / n)) >= F.abs("local_i") * (1 - TIE)).cast("bigint"))
        both = both.select("src", hits.alias("cnt"), F.zip_with("zs", "lags", lambda v, g: v * g).alias("ts")).checkpoint()
        sums = both.agg(F.array(*[F.struct(F.lit(p).alias("p"), F.sum(F.col("ts")[i]).alias("t")) for i, p in enumerate(block)]).alias("s")).select(F.explode("s").alias("s"))
        rows = both.selectExpr("src as idx", "cnt", "cast(null as int) as p", "cast(null as double) as t").unionByName(
            sums.selectExpr("cast(null as bigint) as idx", "cast(null as bigint) as cnt", "s.p as p", "s.t as t"))
        found = rows if found is None else found.unionByName(rows)
    return found


def moran(
    df: DataFrame,
    variable: str,
    params: SpatialParams | None = None,
    edges: DataFrame | None = None,
    polygons: DataFrame | None = None,
) -> MethodResult:
    """Global and local Moran's I with permutation p-values, BH adjustment and quadrants."""
    params = params or SpatialParams()
    if variable not in df.columns:
        raise AnalysisUnavailable(f"no column {variable} to analyse")
    if not {"Latitude", "Longitude"} <= set(df.columns):
        raise AnalysisUnavailable("the table has no Latitude and Longitude")
    v = F.col(variable).try_cast("double")
    ok = F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull() & v.isNotNull() & ~F.isnan(v)
    work = df.filter(ok).select(F.col("Precinct_ID").alias("id"), F.col("Longitude").cast("double").alias("x"),
                                F.col("Latitude").cast("double").alias("y"), v.alias("v")).persist()
    st = work.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).first()
    n = int(st["n"])
    repeated = df.filter(F.col("Precinct_ID").isNotNull()).groupBy("Precinct_ID").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"Precinct_ID {repeated[0][0]} stands in more than one row")
    total = df.count()
    if n < 3:
        raise AnalysisUnavailable(f"{n} rows have coordinates and a value; 3 are needed")
    # Consecutive node indexes in Precinct_ID order (range partitions + per-partition offsets): edges and ties go by
    # number, ids come back at the end.
    work = consecutive_index(work, ["id"], "idx").checkpoint()
    named = work.filter("id IS NOT NULL").select("id", "idx")
    kind, numbered = params.weights_type, None
    if edges is None:
        if kind == "knn":
            k = min(int(params.knn_neighbors), n - 1)
            near = knn_edges(work.filter("id IS NOT NULL").select(F.col("idx").alias("id"), "x", "y"), k).select("src", "dst")
            numbered = row_standardise(near).persist()
            weights = (numbered.join(named.withColumnsRenamed({"id": "a", "idx": "src"}), "src")
                       .join(named.withColumnsRenamed({"id": "b", "idx": "dst"}), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
            label = f"{k} nearest neighbours"
        else:
            if polygons is None and "Geometry" in df.columns:
                polygons = df.filter(F.col("Geometry").isNotNull()).select("Precinct_ID", "Geometry")
            if polygons is None or "Geometry" not in polygons.columns:
                raise AnalysisUnavailable(f"{kind} weights need polygons in a Geometry column")
            valid_poly = polygons.join(work.select(F.col("id").alias("Precinct_ID")), "Precinct_ID", "left_semi")
            edges = polygon_edges(valid_poly, kind)
            label = f"{kind} polygon adjacency"
    else:
        label = "supplied weights"
    if numbered is None:
        weights = row_standardise(edges).persist()
        numbered = (weights.join(named.withColumnsRenamed({"id": "src", "idx": "si"}), "src")
                    .join(named.withColumnsRenamed({"id": "dst", "idx": "di"}), "dst").select(F.col("si").alias("src"), F.col("di").alias("dst"), "w").persist())
    mean = float(st["mean"])
    zed = work.select("idx", "id", (F.col("v") - F.lit(mean)).alias("z"), _place(work).alias("place"))
    denom = float(zed.agg(F.sum(F.col("z") * F.col("z"))).first()[0])
    if denom <= EPS:
        raise AnalysisUnavailable(f"{variable} does not vary")
    lag = (numbered.join(zed.select(F.col("idx").alias("dst"), F.col("z").alias("zj")), "dst")
           .groupBy("src").agg(F.sum(F.col("w") * F.col("zj")).alias("lag")))
    nodes = zed.join(lag.withColumnRenamed("src", "idx"), "idx", "left").fillna({"lag": 0.0})
    nodes = nodes.withColumn("local_i", F.col("z") * F.col("lag") / F.lit(denom / n)).checkpoint()
    global_i = float(nodes.agg(F.sum(F.col("z") * F.col("lag"))).first()[0]) / denom

    permutations, seed = int(params.permutations), int(params.random_state)
    ship_package(df.sparkSession)
    counts, exceed = permuted_counts(nodes.select("idx", "z", "local_i", "place"), numbered, n, denom, global_i, permutations, seed)
    global_p = (exceed + 1) / (permutations + 1)
    # without neighbours every lag is 0, as observed
    local = (nodes.filter("id IS NOT NULL").join(counts, "idx", "left").fillna({"cnt": permutations})
             .select("id", "z", "lag", "local_i", ((F.col("cnt") + 1) / F.lit(permutations + 1)).alias("raw_p")).persist())
    local = benjamini_hochberg(local, "raw_p", "adj_p")
    z, lg = F.col("z"), F.col("lag")
    pattern = (F.when((z >= 0) & (lg >= 0), QUADRANT[0]).when((z < 0) & (lg < 0), QUADRANT[1])
               .when((z >= 0) & (lg < 0), QUADRANT[2]).when((z < 0) & (lg >= 0), QUADRANT[3]).otherwise("unclassified"))
    alpha = float(params.alpha)
    diag = local.select(
        F.col("id").alias("Precinct_ID"),
        F.col("local_i").alias("Local_Moran_I"),
        F.col("raw_p").alias("Local_Moran_Raw_P"),
        F.col("adj_p").alias("Local_Moran_Adjusted_P"),
        pattern.alias("Spatial_Pattern"),
        (F.col("adj_p") < alpha).alias("Spatial_Significant"),
    ).persist()
    significant = int(diag.agg(F.count_if("Spatial_Significant")).first()[0])
    out = df.join(diag, "Precinct_ID", "left")  # one row per key on both sides, checked above
    meta = {
        "weights": label,
        "valid_observations": n,
        "excluded_for_missing_coordinates_or_value": total - n,
        "global_moran_i": global_i,
        "global_expected_i": -1 / (n - 1),
        "global_permutation_p": global_p,
        "permutations": permutations,
        "local_correction": "Benjamini-Hochberg",
        "alpha": alpha,
        "significant_local_patterns": significant,
    }
    return MethodResult(out, meta, {"weights": weights, "local": diag})


def moran_statistics(df: DataFrame, variable: str, edges: DataFrame) -> tuple[DataFrame, float]:
    """I_i, lag and quadrant per node plus global I (no permutations) for given edges."""
    v = F.col(variable).try_cast("double")
    ok = F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull() & v.isNotNull()
    work = df.filter(ok).select(F.col("Precinct_ID").alias("id"), v.alias("v"))
    st = work.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).first()
    n, mean = int(st["n"]), float(st["mean"])
    zed = work.select("id", (F.col("v") - F.lit(mean)).alias("z"))
    denom = float(zed.agg(F.sum(F.col("z") * F.col("z"))).first()[0])
    weights = row_standardise(edges)
    lag = (weights.join(zed.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst")
           .groupBy("src").agg(F.sum(F.col("w") * F.col("zj")).alias("lag")))
    nodes = zed.join(lag.withColumnRenamed("src", "id"), "id", "left").fillna({"lag": 0.0})
    z, lg = F.col("z"), F.col("lag")
    pattern = (F.when((z >= 0) & (lg >= 0), QUADRANT[0]).when((z < 0) & (lg < 0), QUADRANT[1])
               .when((z >= 0) & (lg < 0), QUADRANT[2]).when((z < 0) & (lg >= 0), QUADRANT[3]).otherwise("unclassified"))
    nodes = nodes.select(F.col("id").alias("Precinct_ID"), "z", "lag", (z * lg / F.lit(denom / n)).alias("Local_Moran_I"), pattern.alias("Spatial_Pattern"))
    global_i = float(nodes.agg(F.sum(z * lg)).first()[0]) / denom
    return nodes, global_i
