"""Operator 4: near-duplicate groups by MinHash with tensored banding.

Sketch. A document's set is its distinct word shingles, hashed to 64 bits. Two families, A and B, of `GROUPS`
groups of `ROWS` minhashes each are computed; a table is a pair (i, j) of a group of A and a group of B,
its key the two groups' values. So GROUPS^2 tables cost 2*GROUPS*ROWS minhashes, about the square root of what
separate tables would. At similarity s a pair shares a table with probability (1-(1-s^ROWS)^GROUPS)^2,
0.9998 at 0.8 and more above.

Steps; everything is a stored table, so nothing that is lost has to be computed from the start:
1. Documents with equal sets form a class, whose least doc_id stands for it; copies meet in one
   aggregation that combines before the shuffle.
2. Groups' values that only one class has are dropped; keys are formed from the rest, and again those of one
   class are dropped. What is left is the buckets.
3. Rounds: each bucket has a centre, in the first round the class that most keys could hold, which is the one nearest
   to the others, then another one each round. Each class takes, of the centres of its buckets that lie in another
   component, the one that it shares most buckets with. These pairs, one a class at most, are confirmed on full sets,
   and components joined. Buckets that lie in one component are done.
4. Peeling: a class shares with others only those shingles that a class of another component has too. If these are f of
   its n, it can be similar to no set of more than ((100 + similar) f - similar n) / similar shingles; classes none of
   whose groups (of one value of family A) holds one that small leave. This is exact, and takes out most classes that
   are merely alike.
5. What is left meets once more, by values of family A (two of one bucket share one). Each such group is cut into blocks
   of bounded bytes, and every two blocks meet in a task, which compares their classes' sets of different components as
   a product of matrices and hands on links that join something. So no pair of a bucket is lost, and no pairs are
   written; the work is that of all pairs of what step 4 leaves in a group.

Sets are of 64-bit hashes of shingles, and n_shingles counts them: two different shingles of one document, or of a pair,
coincide with probability 2^-64 each.

Edge cases: null or empty texts, or texts without words, have an empty set, n_shingles 0 and their own id;
fewer words than a shingle has make one shingle of all; rows without doc_id have no component and are
kept; rows that are repeated with their doc_id are one document; an empty table gives no rows; columns other than doc_id
and text, of whatever names, are not read; a very long text needs a few times its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, dropped, released, stored

WORDS, SIMILAR = 4, 80  #: words of a shingle; per cent
GROUPS, ROWS, ROUNDS, SEED = 18, 4, 3, 11
SKETCH = "doc_id long, n_shingles long, class string, a array<long>, b array<long>"
FEW = 500_000  #: ids up to which a counted table of ids is broadcast
SEEN = 200_000  #: classes that a task remembers to have sketched
CHARS = 1 << 21  #: of texts whose words are hashed together
BLOCK = 1 << 20  #: bytes of the sets of a block in step 5
COLUMNS = 4096  #: shingles that are compared at a time
EDGES = 500_000  #: edges that a task contracts


class Shingler:
    def __init__(self, words: int):
        self.words = words
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def set_of(self, h: np.ndarray) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of words that are given by their hashes."""
        if not len(h):
            return h
        if len(h) < self.words:
            h = np.r_[h, np.zeros(self.words - len(h), np.uint64)]
        total = np.zeros(len(h) - self.words + 1, np.uint64)
        for k in range(self.words):
            total += (h[k : k + len(total)] ^ (h[k : k + len(total)] >> np.uint64(31))) * self.odd[k]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        return np.unique(total)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text; words of many texts are hashed together, each distinct one once."""
        at = 0
        while at < len(texts):
            lists, held = [], 0
            while at < len(texts) and held < CHARS:
                text = texts[at].as_py() or ""
                lists.append(text.encode().lower().split())
                held += len(text)
                at += 1
            words, place, size = coded(lists, pa.large_binary())
            hashes = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), np.uint64)[place]
            cut = np.r_[0, np.cumsum(size)]
            for i, j in zip(cut[:-1], cut[1:]):
                yield self.set_of(hashes[i:j])


def minhashes(x: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """2*groups values: of each group of rows minhashes one 64-bit hash."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(1, 1 << 32, 2 * groups * rows, dtype=np.uint32) | np.uint32(1)
    half = (x ^ (x >> np.uint64(32))).astype(np.uint32)  # uniform, so a product with an odd number orders them anew
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(half), 1024):
        np.minimum(low, np.multiply.outer(a, half[at : at + 1024]).min(1), out=low)
    out = np.arange(2 * groups, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        out = (out ^ low.reshape(2 * groups, rows)[:, r].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, size and class of the set, the groups' values; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        s = Shingler(words)
        seen: set[str] = set()
        for b in batches:
            out = []
            for d, x in zip(b.column(0).to_pylist(), s.sets(b.column(1))):
                if not len(x):
                    out.append((d, 0, None, None, None))
                    continue
                name = hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest()
                if name in seen:  # a class's sketch is needed once
                    out.append((d, len(x), name, None, None))
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                m = minhashes(x, groups, rows)
                out.append((d, len(x), name, m[:groups], m[groups:]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def few(ids: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table of ids, to be broadcast if it was counted and is small."""
    most = FEW if most is None else most
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def sets_of(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, n_shingles, shingles) of the documents named by nodes, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        s = Shingler(words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = list(s.sets(b.column(1)[at : at + 500]))
                columns = [b.column(0)[at : at + 500].cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n_shingles", "shingles"])

    rows = docs.select(F.col("doc_id").alias("node"), "text").join(few(nodes), "node", "left_semi")
    return rows.mapInArrow(run, "node long, n_shingles long, shingles binary").where("n_shingles > 0")


class Forest:
    """Union-find; the root of a component is its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a partition's edges, as stars."""
    f = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f.join(u, v)
    nodes = list(f.parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([f.find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, task_edges: int = EDGES) -> DataFrame:
    """(node, root) for all nodes of edges (u, v), root being the least node that can be reached.

    Edges are dealt into partitions of about `task_edges`, each of which is contracted to stars in its task; large-star
    and small-star rounds join the partitions' stars, until nothing changes. With one partition, nothing is left to do
    after the contraction. The degree of a node doesn't matter, as its neighbours' least is a partial aggregate.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    sign = None
    while True:
        parts = max(1, -(-e.count() // task_edges))
        dealt = e.coalesce(1) if parts == 1 else e.repartition(parts, "v")
        stars = stored(dealt.mapInArrow(contracted, "u long, v long").where("u != v"), "stars")
        dropped(e.sparkSession, e)
        if parts > 1:
            both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            e = stored(small.where("u != v").distinct(), "edges")
            now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if parts == 1 or now == sign:
            done = stars if parts == 1 else e
            roots = done.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        sign = now


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= similar * union."""
    small = sets.select("node", "n_shingles", "shingles")
    left = small.select(F.col("node").alias("u"), F.col("n_shingles").alias("n"), F.col("shingles").alias("x"))
    right = small.select(F.col("node").alias("v"), F.col("n_shingles").alias("m"), F.col("shingles").alias("y"))
    # a size filter first: the intersection is at most the smaller set
    sizes = pairs.join(left.select("u", "n"), "u").join(right.select("v", "m"), "v")
    sizes = sizes.where(100 * F.least("n", "m") >= similar * F.greatest("n", "m")).select("u", "v")
    sizes = stored(sizes.distinct(), "sized")  # only the sets of these pairs move
    left = left.join(few(stored(sizes.select("u").distinct(), "ids")), "u", "left_semi")
    right = right.join(few(stored(sizes.select("v").distinct(), "ids")), "v", "left_semi")
    rows = sizes.join(left.select("u", "x"), "u").join(right.select("v", "y"), "v").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similar * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, root) after joining the components that links (u, v) connect."""
    ends = links.join(labels.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(labels.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
    roots = components(ends.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).withColumnRenamed("root", "to")
    return stored(labels.join(roots.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")


def buckets_of(values: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, weight): the tables' buckets that hold more than one node; (node, v): shared values of family A.

    values: (node, a, b). weight: how many keys of a node could be shared.
    """
    flat = stored(values.select("node", F.posexplode(F.concat("a", "b")).alias("at", "v")), "values")
    shared = flat.groupBy("v").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("v")
    hit = flat.join(shared, "v", "left_semi")
    sides = hit.groupBy("node").agg(
        F.collect_set(F.when(F.col("at") < groups, F.col("v"))).alias("a"),
        F.collect_set(F.when(F.col("at") >= groups, F.col("v"))).alias("b"),
    )  # 2 * groups values at most
    sides = stored(sides, "sides")
    dropped(flat.sparkSession, flat)
    weight = (F.size("a") * F.size("b")).alias("weight")
    keys = sides.select("node", weight, F.explode("a").alias("x"), "b").select("node", "weight", "x", F.explode("b").alias("y"))
    keys = stored(keys.select(F.xxhash64("x", "y").alias("key"), "node", "weight"), "keys")
    full = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    buckets = stored(keys.join(full, "key", "left_semi"), "buckets")
    dropped(flat.sparkSession, keys)
    return buckets, sides.select("node", F.explode("a").alias("v"))


def still_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their roots, of buckets that lie in several components."""
    here = members.join(labels, "node")
    keys = here.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return here.join(keys, "key", "left_semi")


def peeled(here: DataFrame, values: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(node, root) of the members that could still have a link to a member of another component (step 4).

    Groups are those of values of family A, of which a member has a few: they hold the buckets."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, root, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(x.as_buffer(), np.int64)
                columns = [pa.array(np.full(len(x), node)), pa.array(np.full(len(x), root)), pa.array(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "s"])

    nodes = here.select("node", "root").distinct()
    rows = nodes.join(sets.select("node", "shingles"), "node").select("node", "root", "shingles").mapInArrow(shingles, "node long, root long, s long")
    rows = stored(rows, "shingles")
    both = rows.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("s")
    f = rows.join(both, "s", "left_semi").groupBy("node").agg(F.count("*").alias("f"))
    reach = nodes.join(f, "node").join(sets.select("node", "n_shingles"), "node")
    reach = reach.select("node", "root", "n_shingles", F.floor(((100 + similar) * F.col("f") - similar * F.col("n_shingles")) / similar).alias("reach"))
    members = values.join(reach, "node")
    least = members.groupBy("v").agg(F.min("n_shingles").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("v", "least")
    out = stored(members.join(least, "v").where("reach >= least").select("node", "root").distinct(), "open")
    dropped(rows.sparkSession, rows)
    return out


def meet(nodes: list[int], roots: list[int], side: np.ndarray, sets: list[np.ndarray], similar: int) -> Iterator[tuple[int, int]]:
    """Links that join components, of the nodes of one block (side 0 alone) or of two. All pairs are compared, as a
    product of the matrices of nodes and shingles, COLUMNS shingles at a time."""
    size = np.array([len(x) for x in sets], np.int64)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    used = n[column] > 1
    number = np.cumsum(n > 1) - 1
    row, column = row[used], number[column[used]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(number[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[i:j], column[i:j] - at] = 1
        common += m[left] @ m[right].T
    common = common.astype(np.int64)
    f = Forest()
    for k, i in enumerate(left):
        near = right[100 * common[k] >= similar * (size[i] + size[right] - common[k])]
        for j in near.tolist():
            if i != j and f.join(roots[i], roots[j]):
                yield nodes[i], nodes[j]


def rest_links(open_: DataFrame, values: DataFrame, sets: DataFrame, similar: int = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(u, v): confirmed links between components of the open nodes that share a value, enough to join all that are linked."""
    rows = open_.join(values, "node").join(sets.select("node", F.length("shingles").alias("bytes")), "node")
    rows = stored(rows.select("v", "node", "root", "bytes"), "open-values")
    same = ["lo", "hi", "count", "low", "high", "sign", "bytes"]  # groups of the same nodes meet once
    groups = rows.groupBy("v").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("count"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("sign"), F.sum("bytes").alias("bytes"),
    )
    groups = groups.where("lo != hi").groupBy(*same).agg(F.min("v").alias("v")).select("v", F.ceil(F.col("bytes") / block).alias("blocks"))
    cells = rows.join(groups, "v").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks"))
    cells = cells.select("v", "node", "root", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("v", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "root")
    cells = cells.join(sets.select("node", "shingles"), "node").select("v", "p", "q", "mine", "node", "root", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> pa.RecordBatch:
            nodes, roots, mine, sets = zip(*held)
            found = list(meet(nodes, roots, (np.array(mine) != cell[1]).astype(int), [np.frombuffer(x, np.uint64) for x in sets], similar)) if len(set(roots)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            for v, p, q, mine, node, root, x in zip(*[c.to_pylist() for c in b.columns]):
                if cell != (v, p, q):
                    if held:
                        yield links()
                    cell, held = (v, p, q), []
                held.append((node, root, mine, x))
        if held:
            yield links()

    dealt = cells.repartition("v", "p", "q").sortWithinPartitions("v", "p", "q")
    return dealt.mapInArrow(run, "u long, v long")


def linked(buckets: DataFrame, values: DataFrame, sets: DataFrame, similar: int = SIMILAR, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of the nodes in buckets: the components of the confirmed links."""
    labels = stored(sets.select("node").distinct().select("node", F.col("node").alias("root")), "labels")
    members = buckets
    for k in range(rounds):
        here = members.join(labels, "node")
        first = F.struct("weight", F.xxhash64("node")) if k == 0 else F.xxhash64("node", F.lit(k))
        centre = here.groupBy("key").agg(F.max_by(F.struct("node", "root"), first).alias("m"))
        centre = centre.select("key", F.col("m.node").alias("to"), F.col("m.root").alias("to_root"))
        near = here.join(centre, "key").where("root != to_root").groupBy("node", "to").count()
        pairs = near.groupBy("node").agg(F.max_by("to", F.struct("count", "to")).alias("to"))
        pairs = stored(pairs.select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v")).distinct(), "pairs")
        links = stored(confirmed(pairs, sets, similar), "links")
        if not links.isEmpty():
            labels = merged(labels, links)
        left = stored(still_mixed(members, labels).select("key", "node", "weight"), "members")
        dropped(buckets.sparkSession, members)
        members = left
        if members.isEmpty():
            return labels
    open_ = peeled(still_mixed(members, labels), values, sets, similar)
    links = stored(rest_links(open_, values, sets, similar), "links")
    return labels if links.isEmpty() else merged(labels, links)


def groups_of(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, groups: int = GROUPS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    drawn = stored(sketches(docs, words, groups, rows), "sketches")
    classes = stored(drawn.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node")), "classes")
    first = drawn.where("a is not null").join(classes, "class")
    buckets, values = buckets_of(first.groupBy("node", "class").agg(F.first("a").alias("a"), F.first("b").alias("b")), groups)
    sets = sets_of(docs, stored(buckets.select("node").distinct(), "nodes"), words)
    labels = linked(buckets, values, stored(sets, "sets"), similar, rounds)
    roots = classes.join(labels, "node", "left").select("class", F.coalesce("root", "node").alias("root"))
    out = drawn.select("doc_id", "n_shingles", "class").join(roots, "class", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the documents whose component has one of smaller doc_id; columns as they are."""
    found = groups_of(docs, **parameters)
    return docs.join(stored(found.where("not kept").select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN [array_to_string(w[i : i + {WORDS - 1}], ' ') for i in generate_series(1, len(w) - {WORDS - 1})]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILAR} * (x.n + y.n - c)
), l AS MATERIALIZED (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, least(doc_id, coalesce(least, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
