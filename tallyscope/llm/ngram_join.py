"""N-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct word shingles. Two sets link when
100 * |intersection| >= 80 * |union|. In one global order (frequent shingles, named by a
sample, come last; others stand by hash) linked sets share an element among the first
n - ceil(0.8 n) + 1 of each, and at least m among the first n - ceil(0.8 n) + m. Only
prefixes of the second kind are indexed. Equal sets are one set.

The index keeps lists of at least two sets, each entry with the set's size and the position
of the element. Lists are read in blocks of similar size, and blocks whose sizes or positions
rule a link out are skipped. In each list the sets are first held against one leader, each
set against the leader it shares most with. Whoever links to it, a highly similar set, takes
its answers over: pairs inside a component need no look, and what x and y share is bounded by
what each shares with a common leader and what both have beside it. Two sets of one leader that
need elements beside it meet at such an element, in lists of their own, which near copies with
different changes hardly share. Pairs that then share enough of their prefixes are verified on
the whole sets, so no link between different components is missed.

Null text and text without words give an empty set, linked with nothing. Rows with a null id
are classed by themselves (component null). Rows with equal ids and different texts are one
node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.exchange import PACKED, bucket_bits, frequent_hashes, is_member, pack_rows, unpack_rows
from tallyscope.llm.graph import components
from tallyscope.llm.ragged import LOWER, NON_SPACE, mix, row_slices, utf8, window_hashes, word_hashes, words
from tallyscope.llm.tables import stage

#: Link condition: DEN * |intersection| >= NUM * |union|.
NUM, DEN = 80, 100
#: A tenth of each set is indexed beyond the elements that one shared element needs.
EXTRA = 10
#: Size classes of index blocks: a link spans neighbouring classes at most.
CLASS_BASE = DEN / NUM
#: Up to so many document ids (16 MB) are broadcast to fetch their sets; beyond, they are joined.
IDS_BROADCAST = 2_000_000


def shingles(rb: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch and their row offsets."""
    data, offsets = utf8(rb.column("text"))
    data = LOWER[data]
    w = words(data, offsets, NON_SPACE)
    h, _, first = window_hashes(word_hashes(data, w), w, size, short_rows=True)
    return h, first


def least_overlap(n: int) -> int:
    """Fewest elements that a set of ``n`` shares with a set it links to."""
    return -(-NUM * n // DEN)


def prefix_size(n: int) -> int:
    """Indexed elements of a set of ``n``: linked sets share 1 + n // EXTRA of them, for the smaller n."""
    return min(n, n - least_overlap(n) + 1 + n // EXTRA)


def sets_of(rb: pa.RecordBatch, size: int) -> list[np.ndarray]:
    h, first = shingles(rb, size)
    return [np.unique(h[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]


def signature(own: np.ndarray) -> int:
    """A 64-bit name of a set (of its size and the sum of its mixed elements)."""
    with np.errstate(over="ignore"):
        total = mix(own + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(own))]))[0].astype(np.int64))


def index_rows(spark: SparkSession, docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc table, packed prefix entries, bucket bits), from one staged pass over the texts."""

    def sampled(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h, first = shingles(rb, size)
        return h, np.repeat(np.arange(rb.num_rows), np.diff(first))

    last = frequent_hashes(docs, sampled)
    shared = spark.sparkContext.broadcast(last)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(spark, n_bytes // 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*PACKED.replace(" binary", "").replace(" int", "").split(", "), "doc_ids", "sizes"]
        for rb in row_slices(batches):
            sets = sets_of(rb, size)
            sig = np.array([signature(s) for s in sets], np.int64)
            n = np.array([len(s) for s in sets], np.int32)
            heads, where = [], []
            seen = set()
            for i, own in enumerate(sets):
                if not len(own) or (key := int(sig[i])) in seen:
                    continue
                seen.add(key)
                take = prefix_size(len(own))
                if len(shared.value):
                    late = is_member(own, shared.value)
                    own = np.concatenate([own[~late], own[late]])
                heads.append(own[:take])
                # position in 256ths of the prefix, rounded down
                where.append((np.arange(take) * 256 // take).astype(np.uint8))
                seen.add(key)
            docs_row = pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([sig.tobytes()], pa.binary()), *(pa.array([None], pa.binary()) for _ in range(3)),
                 pa.array([rb.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names)
            yield docs_row
            if heads:
                first: dict[int, int] = {}
                for i, s in enumerate(sig.tolist()):
                    if n[i]:
                        first.setdefault(s, i)
                rows = np.fromiter(first.values(), np.int64)
                owner = np.repeat(np.arange(len(rows)), [len(h) for h in heads])
                # an id entry is the signature followed by the size
                ids = np.stack([sig[rows], n[rows].astype(np.int64)], 1)
                packed = pack_rows(np.concatenate(heads), owner, ids, bits, np.concatenate(where))
                none = pa.nulls(packed.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*packed.columns, none, none], names)

    staged = stage(spark, docs.mapInArrow(run, f"{PACKED}, doc_ids binary, sizes binary"), "jaccard-index")

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for ids, sig, n in zip(rb.column("doc_ids").to_pylist(), rb.column("ids").to_pylist(), rb.column("sizes").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, k)) for x, k in ((ids, np.int64), (sig, np.int64), (n, np.int32))], ["doc_id", "sig", "n"])

    table = staged.filter("bucket = -1").select("ids", "doc_ids", "sizes").mapInArrow(unroll, "doc_id bigint, sig bigint, n int")
    return table, staged.filter("bucket >= 0").select("bucket", "ids", "counts", "hashes", "extra"), bits


def shared_entries(packed: DataFrame, bits: int) -> DataFrame:
    """(h, sig, n, pos): index entries of elements that at least two different sets have in their prefix.

    ``pos`` is a lower bound on the element's position.
    """

    def run(table: pa.Table) -> pa.Table:
        h, row, extra = unpack_rows(_wide_ids(table), bits)
        both = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64).reshape(-1, 2)
        sig, n = both[row, 0], both[row, 1]
        order = np.lexsort((sig, h))
        h, sig, n, extra = h[order], sig[order], n[order], extra[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])]
        h, sig, n, extra = h[fresh], sig[fresh], n[fresh], extra[fresh]
        many = np.r_[False, h[1:] == h[:-1]]
        many[:-1] |= many[1:]
        h, sig, n, extra = h[many], sig[many], n[many], extra[many].astype(np.int64)
        pos = extra * np.minimum(n, n + NUM * n // -DEN + 1 + n // EXTRA) // 256
        return pa.table({"h": h.view(np.int64), "sig": sig, "n": n, "pos": pos})

    return packed.groupBy("bucket").applyInArrow(run, "h bigint, sig bigint, n bigint, pos bigint")


def _wide_ids(table: pa.Table) -> pa.Table:
    """The packed rows with row numbers in place of the (signature, size) entries."""
    ids, at = [], 0
    for raw in table.column("ids").to_pylist():
        n = len(raw) // 16
        ids.append(np.arange(at, at + n, dtype=np.int64).tobytes())
        at += n
    return table.set_column(table.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))


def fetch_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(sig, grams) of the documents ``ids`` (doc_id), read again from the texts."""
    small = ids.limit(IDS_BROADCAST + 1).count() <= IDS_BROADCAST
    some = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches):
            sets = sets_of(rb, size)
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sig", "grams"])

    # equal ids with different texts: a set once
    return some.select("doc_id", "text").mapInArrow(run, "sig bigint, grams array<bigint>").dropDuplicates(["sig"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) of the pairs (a, b) that link or not: sizes of intersection and union."""
    left = pairs.join(sets.withColumnsRenamed({"sig": "a", "grams": "grams_a"}), "a")
    both = left.join(sets.withColumnsRenamed({"sig": "b", "grams": "grams_b"}), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.select("a", "b", common.alias("common"), (F.size("grams_a") + F.size("grams_b") - F.size(F.array_intersect("grams_a", "grams_b"))).alias("total"))


#: Size and positions still allow a link: the smaller set is at least 0.8 of the larger, and the
#: elements from the shared one on are enough for the overlap that a link needs.
_SIZES = f"least(x.n, y.n) * {DEN} >= greatest(x.n, y.n) * {NUM}"
_POSITIONS = f"least(x.n - x.pos, y.n - y.pos) * {DEN + NUM} >= {NUM} * (x.n + y.n)"


#: Elements that linked sets of n_x and n_y elements share at least, and how many of those the
#: prefixes must hold: a prefix of t elements leaves n - t others, so t - (n - overlap) are in it.
_OVERLAP = f"ceil({NUM} * (x.n + y.n) / {DEN + NUM})"
_PREFIX = f"least({{0}}.n, {{0}}.n - ceil({NUM} * {{0}}.n / {DEN}) + 1 + floor({{0}}.n / {EXTRA}))"
_SHARED = f"least({_PREFIX.format('x')} - x.n, {_PREFIX.format('y')} - y.n) + {_OVERLAP}"


def sharing(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(a, b, shared) of the pairs (a, b) that share as many prefix elements as a link needs."""
    listed = prefixes.select("sig", "n", "hs")
    both = pairs.join(listed.withColumnRenamed("sig", "a").alias("x"), "a").join(listed.withColumnRenamed("sig", "b").alias("y"), "b")
    return both.select("a", "b", F.expr(_SHARED).alias("least"), F.size(F.array_intersect("x.hs", "y.hs")).alias("shared")).filter("shared >= least").select("a", "b", "shared")


def lonely_elements(sets: DataFrame) -> DataFrame:
    """(sig, lonely): how many elements of a set are in no other of ``sets``; sets without any are left out."""
    single = sets.select("sig", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("k"), F.min("sig").alias("sig")).filter("k = 1")
    return single.groupBy("sig").agg(F.count("*").alias("lonely"))


#: Members of a leader that meet it in one part.
PART_MEMBERS = 1024


def meeting_beside(spark: SparkSession, marked: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, other): pairs of one leader that may link, by the elements that both have beside the leader.

    A pair that needs t elements beside its leader shares t of them. Each set lists those it has in
    common with any other set, rare ones first; the first that a pair shares must leave t in both lists.
    """
    member = marked.filter("held is not null").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.first("held").alias("held"), F.max(F.col("component") != F.col("main")).alias("open"))
    member = member.select("sig", "n", "component", "open", "held.lead", F.coalesce("held.common", "n").alias("inside"))
    # sets that are all in common with their leader have nothing beside it
    member = stage(spark, member.filter("inside < n"), "jaccard-members")
    parts = member.groupBy("lead").agg(F.ceil(F.count("*") / PART_MEMBERS).alias("parts"))
    lead = parts.join(sets.select(F.col("sig").alias("lead"), F.col("grams").alias("of_lead")), "lead")
    lead = lead.select("lead", "of_lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    placed = member.select("sig", "lead").join(parts, "lead").select("sig", "lead", F.pmod(F.xxhash64("sig"), F.col("parts")).alias("part"))
    beside = sets.join(placed, "sig").join(lead, ["lead", "part"]).select("sig", F.explode(F.array_except("grams", "of_lead")).alias("g"))
    beside = stage(spark, beside, "jaccard-differences")
    spread = beside.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1")
    listed = beside.join(spread, "g").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("es"))
    listed = stage(spark, member.join(listed, "sig").select("sig", "n", "component", "open", "lead", "inside", F.size("es").alias("e"), F.posexplode("es.g").alias("i", "g")), "jaccard-beside")
    need = f"({_OVERLAP} - least(x.inside, y.inside))"
    met = listed.filter("open").alias("x").join(listed.alias("y"), ["lead", "g"])
    met = met.filter(f"x.component <> y.component and {_SIZES} and {need} >= 1 and least(x.e - x.i, y.e - y.i) >= {need}")
    return met.select("x.sig", F.col("y.sig").alias("other"))


def links(spark: SparkSession, docs: DataFrame, table: DataFrame, packed: DataFrame, bits: int, size: int) -> DataFrame:
    """Edges (a, b) between set signatures: every link, up to those inside a component that others already join."""
    # prefixes without the elements that no other set has in its own; a set with fewer of them than a link to
    # a set of the smallest possible size needs is in no link (one row holds at most one set's prefix)
    prefixes = shared_entries(packed, bits).groupBy("sig").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("es"))
    prefixes = prefixes.select("sig", "n", F.col("es.h").alias("hs"), F.col("es.pos").alias("ps"))
    prefixes = stage(spark, prefixes.filter(f"size(hs) >= 1 + floor(ceil({NUM} * n / {DEN}) / {EXTRA})"), "jaccard-prefixes")
    # the first element that linked sets share stands among these
    # left: how many of these elements there are from this one on (positions are known to a 256th of the prefix)
    lists = prefixes.select("sig", "n", F.size("hs").alias("k"), F.posexplode(F.arrays_zip("hs", "ps")).alias("i", "e"))
    left = F.col("k") - F.col("i") + F.ceil(F.col("n") / 256)
    lists = lists.select("sig", "n", F.col("e.hs").alias("h"), F.col("e.ps").alias("pos"), left.alias("left"))
    lists = lists.filter(f"pos <= n - ceil({NUM} * n / {DEN})").withColumn("block", F.floor(F.log(CLASS_BASE, F.col("n"))))
    near = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")
    # the leader of a list, in each block, is the set of whose prefix the largest share is in lists: the
    # least changed of a group of near copies; read by its own block and the next ones
    best = F.max_by(F.struct("sig", "n", "pos"), F.struct("share", "sig"))
    leaders = lists.join(prefixes.select("sig", (F.size("hs") / F.col("n")).alias("share")), "sig").groupBy("h", "block").agg(best.alias("lead")).select("h", near, "lead.*")
    met = lists.alias("x").join(leaders.alias("y"), ["h", "block"]).filter(f"x.sig <> y.sig and {_SIZES} and {_POSITIONS}")
    stars = sharing(met.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct(), prefixes)
    held = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    first = stage(spark, held.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "jaccard-pairs")

    # one document per set that stands in some list of two sets
    home = stage(spark, table.filter("n > 0").join(lists.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "jaccard-homes")
    needed = first.select(F.col("a").alias("sig")).union(first.select("b")).distinct()
    sets = stage(spark, fetch_sets(spark, docs, home.join(needed, "sig", "left_semi").select("doc_id"), size), "jaccard-sets")
    checked = stage(spark, verify(first, sets), "jaccard-checked")
    good = f"common * {DEN} >= total * {NUM}"
    edges = checked.filter(good).select("a", "b")
    label = stage(spark, components(spark, edges), "jaccard-labels")

    # What is left: pairs of one list in different components. Lists within one component are skipped whole.
    named = lists.join(label.withColumnsRenamed({"node": "sig"}), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    spread = named.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("h")
    open_lists = stage(spark, named.join(spread, "h"), "jaccard-open")
    # the largest component of each list is not held against itself
    sizes = open_lists.groupBy("h", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    # what each set has in common with one that it was held against
    known = checked.select(F.col("a").alias("sig"), F.col("b").alias("lead"), "common")
    known = known.unionByName(checked.select(F.col("b").alias("sig"), F.col("a").alias("lead"), "common"))
    leads_of = known.groupBy("lead").agg(F.count("*").alias("k"))
    itself = leads_of.select(F.col("lead").alias("sig"), "lead", F.lit(None).cast("int").alias("common"))
    known = known.unionByName(itself).join(leads_of, "lead")
    # of several, the one that most sets were held against
    leads = known.groupBy("sig").agg(F.max_by(F.struct("lead", "common"), F.struct("k", "lead")).alias("held"))
    # sets of the open lists and their leaders, and what of them no other one of these has: it is in no intersection
    members = open_lists.select("sig").distinct()
    fresh = home.join(members, "sig", "left_semi").join(needed, "sig", "left_anti").select("doc_id")
    every = stage(spark, sets.unionByName(fetch_sets(spark, docs, fresh, size)), "jaccard-open-sets")
    marked = stage(spark, open_lists.join(main, "h").join(leads, "sig", "left").join(lonely_elements(every), "sig", "left").withColumn("lonely", F.coalesce("lonely", F.lit(0))), "jaccard-marked")
    x = marked.filter("component <> main").withColumn("block", near).alias("x")
    # What x and y share lies in their common leader, at most what each has in common with it (common is null for
    # the leader itself), or beside it. Pairs that need elements beside it meet at those, below; here are the others.
    inside = {s: f"coalesce({s}.held.common, {s}.n)" for s in "xy"}
    apart = f"(x.held is null or y.held is null or x.held.lead <> y.held.lead or least({inside['x']}, {inside['y']}) >= {_OVERLAP})"
    enough = f"least(x.n - x.lonely, y.n - y.lonely) >= {_OVERLAP}"
    rest = x.join(marked.alias("y"), ["h", "block"]).filter(f"x.component <> y.component and {_SIZES} and {_POSITIONS} and least(x.left, y.left) >= {_SHARED} and {enough} and {apart}")
    rest = rest.select("x.sig", F.col("y.sig").alias("other")).unionByName(meeting_beside(spark, marked, every))
    # kept, as a pair stands in several lists and Spark would hold each of its rows against the checked pairs
    rest = stage(spark, rest.select(F.greatest("sig", "other").alias("a"), F.least("sig", "other").alias("b")).distinct(), "jaccard-met")
    rest = stage(spark, sharing(rest.join(first, ["a", "b"], "left_anti"), prefixes).select("a", "b"), "jaccard-rest")
    return edges.unionByName(verify(rest, every).filter(good).select("a", "b"))


def link_components(spark: SparkSession, docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ided = picked.filter("doc_id is not null")
    table, packed, bits = index_rows(spark, ided, size)
    edges = links(spark, ided, table, packed, bits, size)
    label = components(spark, edges).withColumnsRenamed({"node": "sig", "component": "class"})
    classed = table.join(label, "sig", "left").withColumn("class", F.coalesce("class", "sig"))
    # equal ids with different texts tie their classes together
    several = classed.filter("n > 0").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("a", "b")
    if not several.isEmpty():
        merged = components(spark, several).withColumnsRenamed({"node": "class", "component": "merged"})
        classed = classed.join(merged, "class", "left").withColumn("class", F.coalesce("merged", "class")).drop("merged")
    classed = stage(spark, classed, "jaccard-classed")
    least = classed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    full = classed.filter("n > 0").join(least, "class").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    empty = classed.filter("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = full.unionByName(empty)

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches):
            n = pa.array([len(s) for s in sets_of(rb, size)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(rb.num_rows, pa.int64()), n, pa.nulls(rb.num_rows, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return out.unionByName(picked.filter("doc_id is null").mapInArrow(unnamed, "doc_id bigint, n_shingles bigint, component_id bigint"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- an element of a document alone is in no intersection
t AS MATERIALIZED (SELECT doc_id, s FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM t x JOIN t y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT r.doc_id, coalesce(min(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
