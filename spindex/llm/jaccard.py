"""Exact n-gram Jaccard self-join in the metric space of shingle sets.

Documents with equal sets are one *node*.  Links are pairs of nodes with
|x & y| / |x | y| >= t, and the result is the connected components.

Regions.  Jaccard distance is a metric, but two unrelated texts are at
distance 1 from each other and from every pivot, so cells around document
pivots alone would all overlap.  The first partition therefore uses exact
projections of the same metric.  Within a band of set sizes up to U, linked
sets differ in at most T = floor(2U (1-t)/(1+t)) members.  The hash space is
cut into more than T classes; the distances within the classes add up to the
whole distance, so at least one class has distance 0: with every distinct
projection as a pivot, linked sets lie in the same cell of radius 0 in some
class.  A region is the set of nodes with one (band, class, projection).
Empty projections say nothing; there are E classes to spare for them, and only
a set with more than E empty ones is also entered under those.  A set is
entered in its own band and in any higher one that a linked set may have.

Joins.  (1) Every region's smallest node is its pivot; the distances of the
members to their pivots are measured exactly, and links within radius r = 1-t
are kept.  A region all of whose members are now in one component is done.
(2) The others (of equal regions, one) drop members whose bit sketch rules out
every other component's members.  A large region is split into pairs of
blocks.  (3) What is left is joined recursively: pivots are chosen, every
member goes to the Voronoi cell of its nearest pivot and, by the triangle
inequality, to each earlier cell whose pivot is at most 2r farther away than
its own; the cells are joined in the same way, and small ones pair by pair.
Pairs already in one component are skipped, as they can't change the result.

Texts that are null or without words have size 0 and are linked with nothing.
Repeated keys are separate rows; a component's id is its smallest key.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, freeing, freeing_group, numbered, original, partitions, small_batches, stored, temporary
from .shingles import U, blocks, forget, mix, sets

SKETCH = 1024       # bits of the smallest sketch
REGION = 4096       # members that one task joins
LEAF = 48           # members that are joined pair by pair
BLOCK = 512         # members of a component that are compared with as many others in one task


class Bands:
    """Size bands and their classes for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.top = [0, 1]
        self._cuts: dict[int, tuple[np.ndarray, int]] = {}

    def of(self, size: int) -> list[int]:
        """The bands that a set of this size is entered in."""
        most = size * self.den // self.num  # of a linked set
        while self.top[-1] < most:
            self.top.append(max(self.top[-1] + 1, self.top[-1] * 3 // 2))
        first = next(b for b in range(1, len(self.top)) if self.top[b] >= size)
        out = [first]
        while self.top[out[-1]] < most:
            out.append(out[-1] + 1)
        return out

    def cuts(self, band: int) -> tuple[np.ndarray, int]:
        """Inner borders of the band's classes and the empty classes allowed for."""
        if band not in self._cuts:
            u = self.top[band]
            m = 2 * u * (self.den - self.num) // (self.den + self.num) + 1
            least = max(1, self.top[band - 1] * self.num // self.den)
            mean = m * math.exp(-least / m)
            spare = math.ceil(mean + 3 * math.sqrt(mean)) if m > 1 else 0
            m += spare
            self._cuts[band] = (np.array([c * (1 << 64) // m for c in range(1, m)], dtype=U), spare)
        return self._cuts[band]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The region keys of a set (sorted hashes)."""
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(s + U(0x9E3779B97F4A7C15)), dtype=U)))
        out = []
        for band in self.of(len(s)):
            cuts, spare = self.cuts(band)
            at = np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))
            key = mix((total[at[1:]] - total[at[:-1]]) * U(0xD6E8FEB86659FD93)
                      + (np.arange(len(at) - 1, dtype=U) << U(8)) + U(band * _BAND & (1 << 64) - 1))
            empty = at[1:] == at[:-1]
            out.append(key if empty.sum() > spare else key[~empty])
        return np.concatenate(out)


_BAND = 0xA24BAED4963EE407


def node_of(s: np.ndarray) -> int:
    """A set's 64-bit name."""
    total = mix(s ^ U(0xC2B2AE3D27D4EB4F)).sum(dtype=U, keepdims=True)
    return int(mix(total + U(len(s) * 0x165667B19E3779F9 & (1 << 64) - 1))[0].view(np.int64))


def sketch_of(s: np.ndarray) -> bytes:
    """Parity bits, at least two for every member: two sketches differ in at
    most as many bits as the sets in members."""
    bits = max(SKETCH, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s) >> U(36)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(sketch: bytes, length: int) -> np.ndarray:
    """The sketch of the same set with ``length`` words (a power of two)."""
    words = np.frombuffer(sketch, U)
    while len(words) > length:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


_SCAN = [("kind", "int"), ("k", None), ("node", "long"), ("n", "long"), ("digest", "binary"), ("ref", "long"),
         ("sketch", "binary"), ("region", "long"), ("member", "long"), ("pivot", "long"), ("part", "int"), ("low", "binary"),
         ("high", "binary"), ("who", "binary")]


def _scan(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, parts: int) -> DataFrame:
    """One pass over the texts.  kind 0: a row's (k, node, n, digest).  kind 1: a node
    of a block, (ref, node, n, sketch).  kind 2: (region, member, pivot) within
    a block.  kind 3: the block's region keys, one entry per region and packed
    by part: 48 bits of the key, 16 bits for the node; ref is the block's."""
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join(f"{c} {t or kind}" for c, t in _SCAN)

    def each(batches):
        bands = Bands(num, den)
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            texts = batch.column("t").to_pylist()
            arrow = pa.schema([("kind", pa.int32()), ("k", batch.column("k").type)] + [
                (c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for c, t in _SCAN[2:]])

            def rows(kind, count, **cols):
                full = [pa.array([kind] * count, pa.int32()) if f.name == "kind" else
                        pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(count, f.type) for f in arrow]
                return pa.RecordBatch.from_arrays(full, schema=arrow)

            for a, b in blocks(texts):
                got = sets(texts[a:b], n)
                names = [node_of(s) if len(s) else None for s in got]
                yield rows(0, b - a, k=batch.column("k").slice(a, b - a), node=names, n=[len(s) for s in got],
                           digest=[hashlib.sha256(t).digest() for t in texts[a:b]])
                place: dict[int, int] = {}
                own = []
                for s, name in zip(got, names):
                    if name is not None and name not in place:
                        place[name] = len(place)
                        own.append(s)
                base = block << 16
                block += 1
                if not own:
                    continue
                yield rows(1, len(own), ref=base + np.arange(len(own)), node=list(place), n=[len(s) for s in own],
                           sketch=[sketch_of(s) for s in own])
                every = [bands.keys(s) for s in own]
                keys, who = np.concatenate(every), np.repeat(np.arange(len(own)), [len(x) for x in every])
                order = np.argsort(keys, kind="stable")
                keys, who = keys[order], who[order]
                first = np.concatenate(([True], keys[1:] != keys[:-1]))
                group = np.cumsum(first) - 1
                lead = who[first]
                rest = np.flatnonzero(~first)
                part = ((keys >> U(32)) * U(parts)) >> U(32)
                region = _region(keys, part)
                if len(rest):
                    yield rows(2, len(rest), region=region[rest], member=base + who[rest], pivot=base + lead[group[rest]])
                keys, part = keys[first], part[first]
                ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
                starts = np.append(0, ends[:-1])
                low, high = (keys & U(0xFFFFFFFF)).astype("<u4"), ((keys >> U(32)) & U(0xFFFF)).astype("<u2")
                lead = lead.astype("<u2")
                cut = lambda x: [x[i:j].tobytes() for i, j in zip(starts, ends)]
                yield rows(3, len(starts), part=part[starts].astype(np.int32), ref=np.full(len(starts), base),
                           low=cut(low), high=cut(high), who=cut(lead))
        forget()

    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("k"), t.alias("t")).mapInArrow(freeing(each), schema)


def _region(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    return ((keys & U(0xFFFFFFFFFFFF)) | (part << U(48))).view(np.int64)


def _stars(table: pa.Table) -> pa.Table:
    """The regions of a part that occur in several blocks: members and pivot."""
    low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
    refs = np.repeat(table.column("ref").to_numpy(), [len(x) for x in low])
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
    keys = np.concatenate(low).astype(U) | (join("high", "<u2").astype(U) << U(32))
    member = refs + join("who", "<u2")
    part = U(table.column("part")[0].as_py())
    order = np.lexsort((member, keys))
    keys, member = keys[order], member[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    lead = member[first][np.cumsum(first) - 1]
    rest = ~first
    return pa.table({"region": _region(keys, np.full(len(keys), part))[rest], "member": member[rest], "pivot": lead[rest]})


def linked(inter: int, a: int, b: int, num: int, den: int) -> bool:
    return den * inter >= num * (a + b - inter)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node of the component) of nodes with edges
    ``a, b``: smallest label of the neighbours, then the label's label, until
    nothing changes.  Minima are combined before they move."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                    .select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        # a node passes what it found on to its label, too
        up = (near.join(labels, F.col("a") == F.col("node")).select(F.col("label").alias("a"), "near"))
        near = near.union(up).groupBy("a").agg(F.min("near").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = hooked.alias("x").join(hooked.alias("y"), F.col("x.label") == F.col("y.node"))
        new = stored(jump.select("x.node", F.least("x.label", "y.label").alias("label"), "x.old"), "labels")
        changed = new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if changed:
            return labels


def _node_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``node, s`` (the set, packed) of the wanted ``node, k``, from the texts of those keys."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    keys = wanted.select(F.col("k").alias("k2")).distinct()

    def each(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for a, b in blocks(texts):
                got = [s for s in sets(texts[a:b], n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in got], pa.int64()),
                                                  pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "s"])
        forget()

    found = rows.join(keys, F.expr("k <=> k2"), "left_semi").select("t").mapInArrow(freeing(each), "node long, s binary")
    # repeated keys bring other texts along, and equal sets may be found twice
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _inter(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _feasible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that sizes ``na, nb`` and sketches ``sa, sb`` don't rule out."""
    def each(batches):
        for batch in batches:
            keep = []
            for x, y, total in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), batch.column("total").to_pylist()):
                length = min(len(x), len(y)) // 8
                apart = int(np.bitwise_count(fold(x, length) ^ fold(y, length)).sum(dtype=np.int64))
                keep.append(apart * (den + num) <= total * (den - num))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sizes = pairs.where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
    return sizes.select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("total")).mapInArrow(freeing(each), "a long, b long")


def _measure(pairs: DataFrame, node_sets: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of the pairs ``a, b``."""
    def each(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                keep.append(linked(_inter(x, y), len(x), len(y), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = node_sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = node_sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(freeing(each), "a long, b long")


class Region:
    """The recursive exact join of a region's members in one task.  ``labels``
    are the members' components so far; with ``sides`` only pairs of members
    on different sides are asked for."""

    def __init__(self, members: list[np.ndarray], sketches: np.ndarray, labels: np.ndarray, num: int, den: int,
                 sides: np.ndarray | None = None):
        self.s, self.sketch, self.num, self.den, self.sides = members, sketches, num, den, sides
        self.size = np.array([len(s) for s in members])
        self.label = np.array(labels)
        self.links: list[tuple[int, int]] = []
        self.r = 1 - num / den

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the others, those in another component that sketches and sizes don't rule out."""
        others = others[self.label[others] != self.label[i]]
        if self.sides is not None:
            others = others[self.sides[others] != self.sides[i]]
        size, own = self.size[others], self.size[i]
        others = others[(size * self.den >= own * self.num) & (own * self.den >= size * self.num)]
        apart = np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(1, dtype=np.int64)
        # |x ^ y| <= (1 - t) / (1 + t) (|x| + |y|) for linked sets
        return others[apart * (self.den + self.num) <= (self.size[others] + own) * (self.den - self.num)]

    def distances(self, pivot: int, who: np.ndarray) -> np.ndarray:
        p = self.s[pivot]
        return np.array([1 - (k := _inter(p, self.s[i])) / (len(p) + self.size[i] - k) for i in who])

    def link(self, i: int, j: int) -> None:
        self.links.append((i, j))
        self.label[self.label == self.label[i]] = self.label[j]

    def join(self, who: np.ndarray) -> None:
        """Finds links until every linked pair of ``who`` is in one component."""
        if len(np.unique(self.label[who])) < 2:
            return
        d = None
        if len(who) > LEAF:
            pivots = who[np.linspace(0, len(who) - 1, 8).astype(int)]
            d = np.stack([self.distances(p, who) for p in pivots])
            home, own = d.argmin(0), d.min(0)
            # the Voronoi cell and its window, a hair wider than 2r: rounding must not lose a link
            cells = [(home == j) | ((home > j) & (d[j] <= own + 2 * self.r + 1e-9)) for j in range(len(pivots))]
            if max(c.sum() for c in cells) <= 0.8 * len(who):
                for c in cells:
                    self.join(who[c])
                return
        for x, i in enumerate(who):
            rest = who[x + 1:]
            if d is not None:  # the triangle inequality at the pivots
                rest = rest[(np.abs(d[:, x + 1:] - d[:, x:x + 1]) <= self.r + 1e-9).all(0)]
            for j in self.may_link(i, rest):
                if self.label[i] != self.label[j] and linked(
                        _inter(self.s[i], self.s[j]), self.size[i], self.size[j], self.num, self.den):
                    self.link(i, j)


def _by_region(table: pa.Table):
    """The rows of each region of a group."""
    table = table.take(pa.array(np.argsort(table.column("sub").to_numpy(), kind="stable")))
    sub = table.column("sub").to_numpy()
    ends = np.append(np.flatnonzero(np.diff(sub)) + 1, len(sub))
    for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        yield table.slice(a, b - a)


def _region_of(rows: pa.Table, members: list[np.ndarray], num: int, den: int) -> Region:
    sketches = rows.column("sketch").to_pylist()
    length = min(map(len, sketches)) // 8
    sketches = np.stack([fold(x, length) for x in sketches])
    side = rows.column("side").to_numpy()
    return Region(members, sketches, rows.column("label").to_numpy(), num, den, side if side[0] >= 0 else None)


def _prune(num: int, den: int):
    """Members of unresolved regions that may be linked to one of another component."""
    def each(table: pa.Table) -> pa.Table:
        out = [table.slice(0, 0)]
        for rows in _by_region(table):
            region = _region_of(rows, [range(x) for x in rows.column("n").to_pylist()], num, den)
            who = np.arange(rows.num_rows)
            out.append(rows.filter(pa.array([len(region.may_link(i, who)) > 0 for i in who], pa.bool_())))
        return pa.concat_tables(out).select(["sub", "node", "n", "label", "side", "sketch"])
    return each


def _recurse(num: int, den: int):
    def each(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        for rows in _by_region(table):
            region = _region_of(rows, [np.frombuffer(x, U) for x in rows.column("s").to_pylist()], num, den)
            region.join(np.arange(rows.num_rows))
            nodes = rows.column("node").to_pylist()
            out += [(nodes[i], nodes[j]) for i, j in region.links]
        cols = list(zip(*out)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})
    return each


def _unresolved(stars: DataFrame, pairs: DataFrame, refs: DataFrame, nodes: DataFrame, labels: DataFrame,
                region_rows: int) -> DataFrame:
    """Members of the regions that hold several components: ``sub, side, node, n, label, sketch``."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(
        F.col("node").alias("b"), F.col("label").alias("lb"))
    apart = pairs.join(la, "a", "left").join(lb, "b", "left").where(
        F.coalesce("la", "a") != F.coalesce("lb", "b")).select("member", "pivot")
    open_regions = stars.join(apart, ["member", "pivot"], "left_semi").select("region").distinct()
    held = stars.join(open_regions, "region", "left_semi")
    held = held.select("region", F.explode(F.array("member", "pivot")).alias("ref")).distinct()
    held = stored(held.join(refs.select("ref", "node"), "ref").select("region", "node").distinct(), "open_regions")
    delete(stars.sparkSession)
    # a region of two was measured; of regions with the same members one is enough
    alike = held.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("m > 2")
    chosen = alike.groupBy("m", "x", "y").agg(F.min("region").alias("region"))
    many = F.ceil(F.col("m") / region_rows).cast("int")
    rows = held.join(chosen.select("region", many.alias("blocks")), "region")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("sub"),
                       F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
    # members of a block meet those of another block in the pair's region, and their own in the block's
    return rows.join(nodes, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100,
         region_rows: int = REGION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The self-join of ``docs`` with n-word shingles and Jaccard similarity of
    num / den or more: ``rows`` (key, node, n_shingles, digest of the text), ``links``
    between nodes (a, b) that connect all linked ones (not all links: see
    :func:`all_links`), and ``labels`` (node, label)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = 4 * partitions(spark)
    scan = stored(_scan(docs, key, text, n, num, den, parts), "scan")
    rows = stored(scan.where("kind = 0").select("k", "node", "n", "digest"), "rows")
    refs = stored(scan.where("kind = 1").select("ref", "node", "n", "sketch"), "refs")
    across = scan.where("kind = 3").select("part", "ref", "low", "high", "who").groupBy("part").applyInArrow(
        freeing_group(_stars), "region long, member long, pivot long")
    stars = stored(scan.where("kind = 2").select("region", "member", "pivot").union(across), "stars")
    delete(spark, *(f[:f.rindex("/")] for f in scan.inputFiles()[:1]))  # the packed keys are the bulk of it
    of = lambda ref, node: refs.select(F.col("ref").alias(ref), F.col("node").alias(node))
    pairs = stored(stars.select("member", "pivot").distinct().join(of("member", "a"), "member").join(
        of("pivot", "b"), "pivot").where("a <> b"), "pairs")
    nodes = stored(refs.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    with_sketch = lambda x: nodes.select(
        F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(_feasible(both.join(with_sketch("a"), "a").join(with_sketch("b"), "b"), num, den), "feasible")
    first = stored(rows.groupBy("node").agg(F.min("k").alias("k")), "first_keys")
    wanted = both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct().join(first, "node")
    node_sets = stored(_node_sets(docs, wanted, key, text, n), "sets")
    delete(spark)  # the shuffled texts
    small_batches(spark, 128)  # a row holds two sets here
    links = stored(_measure(both, node_sets, num, den), "links")
    labels = components(links)
    group = F.pmod(F.col("sub"), F.lit(parts)).alias("part")
    opened = _unresolved(stars, pairs, refs, nodes, labels, region_rows)
    pruned = stored(opened.select("*", group).groupBy("part").applyInArrow(
        freeing_group(_prune(num, den)), "sub long, node long, n long, label long, side int, sketch binary"), "pruned")
    delete(spark)  # the regions' shuffles
    if not pruned.isEmpty():
        # a member that no pivot came near has no set yet
        others = pruned.select("node").distinct().join(wanted, "node", "left_anti").join(first, "node")
        node_sets = node_sets.unionByName(_node_sets(docs, others, key, text, n))
        more = stored(pruned.join(node_sets, "node").select("*", group).groupBy("part").applyInArrow(
            freeing_group(_recurse(num, den)), "a long, b long"), "more_links")
        links = links.unionByName(more)
        labels = components(links)
    return rows.select(F.col("k").alias(key), "node", F.col("n").alias("n_shingles"), "digest"), links, labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80,
                    den: int = 100) -> DataFrame:
    """``key, n_shingles, component_id`` (the component's smallest key), one row per row of ``docs``."""
    with temporary(docs.sparkSession) as folders:
        rows, _, labels = join(docs, key, text, n, num, den)
        found = stored(_component_rows(rows, labels, key), "components")
        folders.pop()  # the result stays
    return found


def _component_rows(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    rows = rows.select(F.col(key).alias("k"), "node", "n_shingles")
    # per node and then per component; a row without a node is its own component
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("k").alias("k")).join(labels, "node", "left")
    nodes = nodes.select("node", "k", F.coalesce("label", "node").alias("label"))
    least = nodes.groupBy("label").agg(F.min("k").alias("component_id"))
    ids = nodes.join(least, "label").select("node", "component_id")
    return rows.join(ids, "node", "left").select(
        F.col("k").alias(key), "n_shingles",
        F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"))


def _shared(members: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many hashes each two of the sets share."""
    who = np.repeat(np.arange(len(members)), [len(s) for s in members])
    _, column, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    twice = times[column] > 1
    who, column = who[twice], (np.cumsum(times > 1) - 1)[column[twice]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    inter = np.zeros((len(members), len(members)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(members), min(width, int(column[-1]) + 1 - start)), np.float32)
        has[who[a:b], column[a:b] - start] = 1
        inter += (has @ has.T).astype(np.int64)  # at most ``width``: exact
    return inter


def _within(num: int, den: int, pairs: bool):
    """All links in blocks of components: the pairs themselves, or how many rows each node is linked with."""
    def each(table: pa.Table) -> pa.Table:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows in _by_region(table):
            members = [np.frombuffer(x, U) for x in rows.column("s").to_pylist()]
            node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            size, inter = np.array([len(s) for s in members]), _shared(members)
            link = den * inter >= num * (size[:, None] + size - inter)
            link &= side[:, None] != side if side[0] >= 0 else ~np.eye(len(node), dtype=bool)
            if pairs:
                i, j = np.nonzero(link & (node[:, None] < node))
                a.append(node[i])
                b.append(node[j])
            else:
                a.append(node)
                b.append(link @ rows.column("same").to_numpy())
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})
    return each


def _links(docs: DataFrame, nodes: DataFrame, key: str, text: str, n: int, num: int, den: int, pairs: bool,
           block: int) -> DataFrame:
    """Linked nodes are in one component, so every pair of a component's nodes
    (``nodes``: node, k, same, label) is compared, once: a large component is
    split into blocks, and each pair of blocks is a task's."""
    parts = 4 * partitions(docs.sparkSession)
    many = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    held = nodes.join(many.select("label", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "label")
    held = stored(held.join(_node_sets(docs, held.select("node", "k"), key, text, n), "node"), "component_sets")
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("node", "same", "s", F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("sub"),
                       F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"))
    return held.withColumn("part", F.pmod(F.col("sub"), F.lit(parts))).groupBy("part").applyInArrow(
        freeing_group(_within(num, den, pairs)), "a long, b long")


def _nodes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("same"))
    return stored(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "link_nodes")


def all_links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100,
              block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``rows`` as of :func:`join`, and every link ``a, b`` (a < b) between different nodes: as many
    as there are, which is the square of a group of near copies."""
    with temporary(docs.sparkSession) as folders:
        rows, _, labels = join(docs, key, text, n, num, den)
        nodes = _nodes(rows.select(F.col(key).alias("k"), "node"), labels)
        links = stored(_links(docs, nodes, key, text, n, num, den, True, block), "all_links")
        rows = stored(rows, "rows")
        del folders[-2:]  # the results stay
    return rows, links


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100,
                block: int = BLOCK) -> DataFrame:
    """``key, n_shingles, component_id, n_links``: the last is the number of other
    rows that a row is linked with, copies included; one row per row of ``docs``."""
    with temporary(docs.sparkSession) as folders:
        rows, _, labels = join(docs, key, text, n, num, den)
        rows = rows.select(F.col(key).alias("k"), "node", "n_shingles")
        nodes = _nodes(rows, labels)
        counts = _links(docs, nodes, key, text, n, num, den, False, block).groupBy(F.col("a").alias("node")).agg(
            F.sum("b").alias("others"))
        least = nodes.groupBy("label").agg(F.min("k").alias("component_id"))
        ids = nodes.join(least, "label").join(counts, "node", "left").select(
            "node", "component_id", (F.col("same") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        found = stored(rows.join(ids, "node", "left").select(
            F.col("k").alias(key), "n_shingles",
            F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "link_counts")
        folders.pop()  # the result stays
    return found


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the one with the
    smallest key (null last), then node, then digest of the text.  Rows that agree
    in key and text are interchangeable.  A row without words is its own component."""
    with temporary(docs.sparkSession) as folders:
        rows, _, labels = join(docs, key, text, n, num, den)
        rows = rows.select(F.col(key).alias("k"), "node", "digest")
        best = F.struct(F.col("k").isNull().alias("no_key"), "k", "node", "digest", "same")
        # combined per text, per node and then per component
        nodes = (rows.where("node IS NOT NULL").groupBy("node", "k", "digest").agg(F.count(F.lit(1)).alias("same"))
                 .groupBy("node").agg(F.min(best).alias("best")))
        nodes = nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(
            F.min("best").alias("best"))
        empty = rows.where("node IS NULL").select("k", "digest").distinct().withColumn("same", F.lit(1).cast("long"))
        stay = stored(nodes.select("best.k", "best.digest", "best.same").unionByName(empty), "survivors")
        folders.pop()  # the result stays
    t = F.coalesce(F.col(text), F.lit(""))
    given = numbered(docs, F.col(key).alias("of"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("of_digest"))
    found = given.join(stay, F.col("of").eqNullSafe(F.col("k")) & (F.col("of_digest") == F.col("digest")))
    again = found.where("same > 1").dropDuplicates(["k", "digest"])
    return original(found.where("same = 1"), docs).unionByName(original(again, docs))
