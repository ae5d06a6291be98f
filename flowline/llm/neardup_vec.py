"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets ``BITS`` signs of random projections of its distance from its label's mean (without that,
vectors with much in common would mostly agree), concatenated to a key; vectors are sorted by label and key, and each one is compared with its ``WINDOW`` predecessors. Two vectors at cosine 0.98 agree in one
sign with probability 0.94, so close vectors keep long common prefixes and are neighbours in some pass. The more
vectors a label has, the longer a prefix must be, so passes follow the label's size: as many as leave a pair that
comes into a window with probability (size / WINDOW) ** -``CROWD`` in a pass a chance of ``MISSED`` to come into none.
Pairs verified in double precision are all united, inside the task already: a block of a pass gives at most one link a
vector, a spanning forest of all its pairs.

A window is bounded, links aren't: in a dense cluster a vector has more partners than a window holds. So of each component
that is larger than a window, the vector of most links (its hub) is compared with all vectors of its label: hubs are held in
blocks while the label streams past. Of the components that this makes, those larger than a window are then settled exactly:
members whose angles to the hub leave room for a link with a vector outside are compared with all vectors outside that
leave it. So a link can only be missed between two components of a window's size at most, if all passes miss it.
What is settled are components, and links are then counted exactly inside each component. In one of more than ``BLOCK``
vectors, those within half the angle of a link around its mean (the core) all link to each other, which needs no
product; vectors outside the core (queries, in held blocks) are multiplied with all (entries, in parts that stream past).
Only counts leave a task. Equal vectors of one label are one row with a multiplicity.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing, as do vectors of different dimensions. Repeated rows are vectors of their own. Null vec_ids count as
vectors, but a component is never named by one unless all its vec_ids are null. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill
from .components import components
from .vectors import matrix, usable

LEAST = 0.98
WINDOW, BITS = 128, 48
CROWD, MISSED, MOST_PASSES = 0.16, 1e-4, 64
BLOCK = 512
#: Parts of a label in the join that gives vectors its size and mean.
SALTS = 32


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large or small components neither overflow nor vanish when squared.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def passes_of(size: int) -> int:
    """Passes over a label with so many vectors."""
    chance = min(0.9999, (max(1, size) / WINDOW) ** -CROWD)
    return min(MOST_PASSES, max(4, math.ceil(math.log(MISSED) / math.log(1 - chance))))


@functools.cache
def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((MOST_PASSES * BITS, dim)).T


def _sums(batches):
    """Sums of unit vectors by label and dimension, of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, labels = np.array([len(v) for v in batch.column("v")]), batch.column("label").to_numpy()
        out = []
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            names, place = np.unique(labels[at], return_inverse=True)
            total = np.zeros((len(names), dim))
            np.add.at(total, place, unit(matrix(batch.column("v").take(pa.array(at)))))
            out += zip(names.tolist(), [dim] * len(names), np.bincount(place).tolist(), total.tolist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["label", "dim", "n", "s"])


def label_means(vectors: DataFrame) -> DataFrame:
    """(label, v) -> label, dim, size, mean: of each label's unit vectors of a dimension."""
    sums = vectors.select("label", "v").mapInArrow(_sums, "label long, dim int, n long, s array<double>")
    at = sums.select("label", "dim", "n", F.posexplode("s").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("n").alias("size"), (F.sum("x") / F.sum("n")).alias("x"))
    return at.groupBy("label", "dim").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m")).select("label", "dim", "size", F.col("m.x").alias("mean"))  # one vector each


def _keys(batches):
    powers = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    for batch in batches:
        sizes, labels = np.array([len(v) for v in batch.column("v")]), batch.column("size").to_numpy()
        passes = np.array([passes_of(n) for n in labels.tolist()], dtype=int)
        for dim, n in sorted({*zip(sizes.tolist(), passes.tolist(), strict=True)}):
            part = batch.filter(pa.array((sizes == dim) & (passes == n)))
            away = unit(matrix(part.column("v"))) - matrix(part.column("mean"))
            signs = (away @ projections(dim)[:, : n * BITS] > 0).reshape(len(part), n, BITS)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("label", "cid", "v")] + [pa.array((signs @ powers).tolist(), pa.list_(pa.int64()))], ["label", "cid", "v", "keys"])


def forest(close: np.ndarray, offset: int) -> np.ndarray:
    """The least column that each column reaches over all pairs of ``close``, whose row i is column ``offset`` + i."""
    low = np.arange(close.shape[1])
    i, j = np.nonzero(close)
    i += offset
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _neighbours(batches):
    """Compare each row with its predecessors in order; links as (vector, least vector that it reaches in the block, 0).

    How many links a vector has in a block is told as (vector, vector, links).
    """
    held: list = []  # (pass, label, dim), units and ids of the last rows
    for batch in batches:
        if not batch.num_rows:
            continue
        passes, labels, ids = (batch.column(c).to_numpy() for c in ("pass", "label", "cid"))
        sizes = np.array([len(v) for v in batch.column("v")])
        cut = np.flatnonzero((passes[1:] != passes[:-1]) | (labels[1:] != labels[:-1]) | (sizes[1:] != sizes[:-1])) + 1
        a, b, links = [], [], []
        for start, stop in zip([0, *cut], [*cut, len(ids)], strict=True):
            for at in range(start, stop, 2048):
                high = min(stop, at + 2048)
                part, own = unit(matrix(batch.column("v").slice(at, high - at))), ids[at:high]
                key, before = (passes[at], labels[at], sizes[at]), 0
                if held and held[0] == key:
                    before = len(held[2])
                    part, own = np.concatenate([held[1], part]), np.concatenate([held[2], own])
                for x in range(before, len(own), WINDOW):
                    y, first = min(len(own), x + WINDOW), max(0, x - WINDOW)
                    close = part[x:y] @ part[first:y].T >= LEAST
                    behind = np.arange(x, y)[:, None] - np.arange(first, y)[None, :]
                    close &= (behind > 0) & (behind <= WINDOW)
                    if close.any():
                        low = forest(close, x - first)
                        linked = np.flatnonzero(low != np.arange(len(low)))
                        a += own[first + linked].tolist()
                        b += own[first + low[linked]].tolist()
                        degree = close.sum(axis=0)
                        degree[x - first :] += close.sum(axis=1)
                        some = np.flatnonzero(degree)
                        links += [0] * len(linked) + degree[some].tolist()
                        a += own[first + some].tolist()
                        b += own[first + some].tolist()
                held = [key, part[-WINDOW:], own[-WINDOW:]]
        if a:
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "links": links})


def _away(batches):
    """Members with their component's hub: the angle between the two."""
    for batch in batches:
        if batch.num_rows:
            sizes, angles = np.array([len(v) for v in batch.column("v")]), np.zeros(batch.num_rows)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                v, hub = (unit(matrix(batch.column(c).take(pa.array(at)))) for c in ("v", "hub"))
                angles[at] = np.arccos(np.clip((v * hub).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "label", "cid", "v")] + [pa.array(angles)], ["component", "label", "cid", "v", "away"])


def _facing(batches):
    """Rows by (label, dim, block, part), the held ones first: entries of other components within the reach of a held row."""
    key, held, known = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("label", "dim", "block", "part", "held")]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
        for start, stop in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            now, part = tuple(x[start] for x in at[:4]), batch.slice(start, stop - start)
            if now != key:
                key, held, known = now, [], None
            rows = unit(matrix(part.column("v"))), *(part.column(c).to_numpy() for c in ("cid", "component", "reach"))
            if at[4][start]:
                held.append(rows)
                continue
            if known is None:
                known = [np.concatenate(x) for x in zip(*held, strict=True)]
            for i in range(0, part.num_rows, 2048):
                cosine = rows[0][i : i + 2048] @ known[0].T
                x, y = np.nonzero((cosine >= known[3]) & (rows[2][i : i + 2048, None] != known[2]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[1][i + x]), pa.array(known[1][y]), pa.array(cosine[x, y])], ["a", "b", "cosine"])


def facing(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (a) and queries (b) of the same label and dimension, but different components, whose cosine is the query's ``reach`` at least.

    Both sides have label, dim, cid, v and component. Queries are held in blocks, entries stream past them in parts.
    """
    by = ["label", "dim"]
    blocks = lambda rows, size, name: rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    per = blocks(entries, 8 * BLOCK, "parts").join(blocks(queries, BLOCK, "blocks"), by)
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    sized = lambda rows: rows.withColumn("salt", F.pmod("cid", F.lit(SALTS)).cast("int")).join(salted, [*by, "salt"])
    own = [*by, "cid", "v", "component"]
    entries = sized(entries).select(*own, F.lit(0.0).alias("reach"), every("blocks").alias("block"), share("parts").alias("part"), F.lit(False).alias("held"))
    queries = sized(queries).select(*own, "reach", share("blocks").alias("block"), every("parts").alias("part"), F.lit(True).alias("held"))
    at = [*by, "block", "part"]
    both = entries.union(queries).repartition(*at).sortWithinPartitions(*at, F.desc("held"))
    return both.mapInArrow(_facing, "a long, b long, cosine double")


def placed(known: DataFrame, copies: DataFrame) -> DataFrame:
    """All vectors with their component, which is their own number where they have no links."""
    rows = copies.join(known, F.col("cid") == F.col("vertex"), "left")
    return rows.select("label", F.size("v").alias("dim"), "cid", "v", F.coalesce("component", "cid").alias("component"))


def hubs_of(rows: DataFrame, degrees: DataFrame) -> DataFrame:
    """Of each component that is larger than a window, the vector of most links."""
    large = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WINDOW).select("component")
    named = rows.select("component", "cid").join(large, "component").join(degrees, F.col("cid") == F.col("of"))
    top = named.groupBy("component").agg(F.max(F.struct("degree", "cid")).alias("top")).select(F.col("top.cid").alias("hub"))
    return spill(rows.join(top, F.col("cid") == F.col("hub")).drop("hub"), "hubs")


def rest_links(rows: DataFrame, hubs: DataFrame) -> DataFrame | None:
    """All links between a component with a hub and the vectors outside it, or None if no angle leaves room for one.

    A member at angle x of its hub and a vector at angle y of it are y - x apart at least. So only vectors within the
    largest x and the angle of a link of the hub matter, and only members that the nearest of these could link to.
    """
    link, room = math.acos(LEAST), 1e-6
    members = salted_join(rows, hubs.select("component", F.col("v").alias("hub")))
    members = spill(members.select("component", "label", "cid", "v", "hub").mapInArrow(_away, "component long, label long, cid long, v array<double>, away double"), "away")
    reach = members.groupBy("component").agg(F.cos(F.least(F.max("away") + link + room, F.lit(math.pi))).alias("reach"))
    near = facing(hubs.join(reach, "component"), rows).join(hubs.select("cid", "component"), F.col("b") == F.col("cid"))
    near = spill(near.select("component", "a", F.acos(F.least("cosine", F.lit(1.0))).alias("off")), "outside")
    if near.isEmpty():
        return None
    nearest = near.groupBy("component").agg(F.min("off").alias("nearest"))
    asking = salted_join(members, nearest).where(F.col("away") + link + room >= F.col("nearest"))
    asking = asking.select(F.col("component").alias("label"), F.size("v").alias("dim"), "cid", "v", "component", F.lit(LEAST).alias("reach"))
    vectors = rows.select("cid", "v", "dim", F.col("component").alias("own"))
    entries = near.join(vectors, F.col("a") == F.col("cid")).select(F.col("component").alias("label"), "dim", "cid", "v", F.col("own").alias("component"))
    return spill(facing(spill(asking, "asking"), spill(entries, "entries")).select("a", "b"), "rest")


def _core(batches):
    """Vectors, and if they are in the core: closer to the mean than half the angle of a link."""
    least = math.cos(math.acos(LEAST) / 2 - 1e-6)
    for batch in batches:
        if batch.num_rows:
            mean = batch.column("mean")
            known = mean.is_valid().to_numpy(zero_copy_only=False)
            core = np.zeros(batch.num_rows, dtype=bool)
            for dim in {len(v) for v in mean.filter(pa.array(known))}:
                at = np.flatnonzero(known & (np.array([0 if v is None else len(v) for v in mean.to_pylist()]) == dim))
                means = matrix(mean.take(pa.array(at)))
                sizes = np.sqrt((means * means).sum(axis=1))
                core[at] = (unit(matrix(batch.column("v").take(pa.array(at)))) * means).sum(axis=1) >= np.where(sizes > 0, least * sizes, np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "cid", "v", "n")] + [pa.array(core)], ["component", "cid", "v", "n", "core"])


def _units(batches):
    for batch in batches:
        if batch.num_rows:
            rows = [unit(np.array([v]))[0] for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("n"), pa.array(rows, pa.list_(pa.float64()))], ["component", "n", "v"])


def _count(batches):
    """Rows by (component, block, part), the held queries first: how many vectors (with multiplicity) each query links to, and how many queries each core vector."""
    key, held, queries = None, [], None

    def done():
        if queries is not None:
            yield pa.RecordBatch.from_arrays([pa.array(queries[1]), pa.array(queries[3])], ["cid", "links"])

    for batch in batches:
        if not batch.num_rows:
            continue
        c, i, j = (batch.column(x).to_numpy() for x in ("component", "block", "part"))
        hold = batch.column("held").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (hold[1:] != hold[:-1])) + 1
        for start, stop in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            now, part = (c[start], i[start], j[start]), batch.slice(start, stop - start)
            if now != key:
                yield from done()
                key, held, queries = now, [], None
            rows = unit(matrix(part.column("v"))), part.column("cid").to_numpy(), part.column("n").to_numpy()
            if hold[start]:
                held.append(rows)
                continue
            if queries is None:
                queries = [np.concatenate(x) for x in zip(*held, strict=True)]
                queries.append(np.zeros(len(queries[1])))
            for at in range(0, part.num_rows, 2048):
                v, ids, n = (x[at : at + 2048] for x in rows)
                close = (v @ queries[0].T >= LEAST) & (ids[:, None] != queries[1][None, :])
                queries[3] += n @ close
                core = part.column("core").to_numpy(zero_copy_only=False)[at : at + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(ids[core]), pa.array((close @ queries[2])[core])], ["cid", "links"])
    yield from done()


def salted_join(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """Join what ``per`` says of each component with its members, those of a large one in ``SALTS`` parts."""
    salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("cid", F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"], how).drop("salt")


def count_links(known: DataFrame, copies: DataFrame) -> DataFrame:
    """(vertex, component) and the vectors (cid, v, n) -> cid, links: other vectors of the component that each one links to."""
    member = known.join(copies, F.col("vertex") == F.col("cid")).select("component", "cid", "v", F.col("n").cast("double").alias("n"))
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    member = spill(salted_join(member, sizes), "members")
    large = member.where(F.col("size") > BLOCK).select("component", "n", "v").mapInArrow(_units, "component long, n double, v array<double>")
    mean = large.select("component", "n", F.posexplode("v").alias("at", "x")).groupBy("component", "at").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    mean = mean.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m")).select("component", F.col("m.x").alias("mean"))  # one vector
    member = spill(salted_join(member, mean, "left").mapInArrow(_core, "component long, cid long, v array<double>, n double, core boolean"), "cores")
    per = member.groupBy("component").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(~F.col("core"), 1)).alias("asking"), F.sum(F.when(F.col("core"), F.col("n"))).alias("inside"))
    rows = salted_join(member, per).withColumns({"x": F.xxhash64("cid", F.lit("b")), "parts": F.ceil(F.col("all") / BLOCK).cast("int"), "blocks": F.ceil(F.col("asking") / BLOCK).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod("x", n).cast("int")
    own = ["component", "cid", "v", "n", "core"]
    entries = rows.where("blocks > 0").select(*own, every("blocks").alias("block"), share("parts").alias("part"), F.lit(False).alias("held"))
    queries = rows.where("not core").select(*own, share("blocks").alias("block"), every("parts").alias("part"), F.lit(True).alias("held"))
    at = ["component", "block", "part"]
    counted = entries.union(queries).repartition(*at).sortWithinPartitions(*at, F.desc("held")).mapInArrow(_count, "cid long, links double")
    inside = rows.where("core").select("cid", (F.col("inside") - F.col("n")).alias("links"))
    return counted.union(inside).groupBy("cid").agg(F.sum("links").cast("long").alias("links"))


def link_vectors(embeddings: DataFrame) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    good = usable(F.col("v")) & F.col("label").isNotNull()
    rows = rows.withColumn("hash", F.when(good, F.sha2(F.concat_ws(",", "label", F.to_json("v")), 256)))
    # Equal vectors of a label: one row with a number of its own, given once, in a written table.
    copies = rows.where("hash is not null").groupBy("hash").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.min("label").alias("label"), F.min("v").alias("v"))
    copies = spill(copies.withColumn("cid", F.monotonically_increasing_id()), "copies")

    means = spill(label_means(copies), "means").select(F.col("label").alias("of"), "dim", "size", "mean", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sized = copies.join(means, (F.col("label") == F.col("of")) & (F.size("v") == F.col("dim")) & (F.pmod("cid", F.lit(SALTS)) == F.col("salt")))
    keyed = sized.select("label", "cid", "v", "size", "mean").mapInArrow(_keys, "label long, cid long, v array<double>, keys array<long>")
    keyed = keyed.select("label", "cid", "v", F.size("v").alias("dim"), F.posexplode("keys").alias("pass", "key"))
    keyed = keyed.repartitionByRange("pass", "label", "dim", "key", "cid").sortWithinPartitions("pass", "label", "dim", "key", "cid")
    found = keyed.select("pass", "label", "cid", "v").mapInArrow(_neighbours, "a long, b long, links long")
    found = spill(found.groupBy("a", "b").agg(F.sum("links").alias("links")), "found")
    links, degrees = found.where("a != b").select("a", "b"), found.where("a = b").select(F.col("a").alias("of"), F.col("links").alias("degree"))
    known = spill(components(links), "known")
    rows_of = lambda known: spill(placed(known, copies), "placed")
    placed_now = rows_of(known)
    hubs = hubs_of(placed_now, degrees)
    if not hubs.isEmpty():
        more = spill(facing(hubs.withColumn("reach", F.lit(LEAST)), placed_now).select("a", "b"), "more")
        if not more.isEmpty():
            links = links.union(more)
            known = spill(components(links), "known")
            placed_now = rows_of(known)
            hubs = hubs_of(placed_now, degrees)
        rest = rest_links(placed_now, hubs)
        if rest is not None and not rest.isEmpty():
            known = spill(components(links.union(rest)), "known")

    counted = count_links(known, copies)
    least = known.join(copies, F.col("vertex") == F.col("cid")).groupBy("component").agg(F.min("low").alias("least"))
    named = known.join(least, "component").select(F.col("vertex").alias("cid"), "least").join(counted, "cid", "left")
    classes = copies.join(named, "cid", "left").select(F.col("hash").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("least", "low").alias("low"))
    return rows.select("vec_id", "hash").join(classes, F.col("hash") == F.col("of"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("low", "vec_id"), F.lit(True)).alias("kept")
    )


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(least.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(least.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""
