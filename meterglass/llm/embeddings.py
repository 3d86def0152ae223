"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Vectors are compared when labels (and dimensions) are equal; two link when their cosine reaches the
threshold. Labels with more than ``LEAF`` rows are split by ``TREES`` trees. A tree's node is cut
along a random direction; rows nearer to the cut than the spill width go to both sides, so that a
linked pair is seldom parted (at the threshold, in 64 dimensions, by some 3 of 100 cuts). Of a few
directions and places that cut is taken which leaves the least to compare, so cuts go through gaps
and don't tear groups of copies. All pairs within a leaf are compared in double precision, and
links are united. Leaves of all trees together are searched, so a pair is lost only if every tree
parts it.

Trees grow in rounds. A round takes the nodes with more than ``LEAF`` rows, fits up to ``LEVELS``
levels of cuts on a sample of about ``SAMPLE`` of each node's rows, chosen by hash, and sends all
rows down. Fitted cuts go to all tasks while they are few (checked) and meet the rows by a shuffle
beyond; rows of one node are dealt over salts there.

A group so tight that no cut helps is a ball: rows within half the threshold's angle of a centre all
link with each other, by the triangle inequality, and are counted, never compared. What lies
outside of it goes on down the tree; what of it is near enough to link with rows of the ball (within
one and a half angles) is compared with them, too, ball rows being dealt over groups of ``LEAF``.
Where neither a cut nor a ball helps, blocks of ``LEAF`` rows are compared pair by pair of blocks:
this is exact, and the only work that grows with the square of a group.

No pairs leave a task. A group of rows gives each row's number of links and links that span what is
linked. A pair that meets at several places counts at the least of them: rows carry the places they
stand in. A row's core is the least of its balls; pairs of one core count by its size.

Defined results: every row is a vector of its own, rows that repeat a vec_id included; component_id
is the least vec_id of its component, which rows that share a vec_id share; rows with a null vec_id
link like others, and a component of only such has a null component_id and is kept; null, empty and
zero vectors, vectors with null or non-finite components and rows with a null label link with
nothing and stay alone; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salt, stored
from .simhash import components, least_ids

THRESHOLD = 0.93
TREES = 4
#: Rows that are compared in one group, all with all.
LEAF = 512
#: Rows that a node's cuts are fitted on, about.
SAMPLE = 2048
LEVELS = 7
#: Width of the overlap on each side of a cut, in standard deviations of a linked pair's distance along it.
SPILL = 0.5
DIRECTIONS = 4
#: Share of the node's comparisons that a cut may leave, and share of a node that a ball must hold.
WORTH, BALL = 0.93, 0.2
ROUNDS = 16
#: Bytes of fitted cuts, and nodes, that are sent to every task.
MOST_BROADCAST = 32 << 20
MOST_NODES = 100_000
#: What a row is at a place: in a leaf that may still be split, in a ball, near a ball, in a leaf that can't be split.
OPEN, INSIDE, NEAR, FUZZY = range(4)
ROWS = "kin string, place long, node long, vec binary, kind int"


def place_of(*path) -> int:
    """A place's number: even, and the row's that is only near a ball is odd."""
    return xxhash.xxh64_intdigest(repr(path).encode()) >> 2 << 1


def direction(place: int, k: int, dims: int) -> np.ndarray:
    d = np.random.Generator(np.random.Philox([place, k])).standard_normal(dims)
    return d / np.linalg.norm(d)


def units(vecs: list[bytes], wide: bool) -> np.ndarray:
    """Vectors of one dimension, scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(vecs), np.float64 if wide else np.float32).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Angles:
    """What a threshold means for cuts and balls."""

    def __init__(self, threshold: float):
        self.threshold, angle = threshold, np.arccos(threshold)
        self.inside = np.cos(angle / 2) + 1e-9
        self.near = np.cos(min(np.pi, 1.5 * angle)) - 1e-9

    def spill(self, dims: int, width: float) -> float:
        return width * np.sqrt((2 - 2 * self.threshold) / dims)


def grown(x: np.ndarray, rows: float, place: int, level: int, angles: Angles, leaf: int, levels: int, width: float):
    """The part of a tree below ``place``, fitted on a sample ``x`` of its ``rows`` rows."""
    if rows <= leaf or level == levels or len(x) < 16:
        return ("leaf", place, OPEN)
    spill, least = angles.spill(x.shape[1], width), None
    for k in range(DIRECTIONS):
        along = np.sort(x @ direction(place, k, x.shape[1]))
        at = along[np.unique((np.linspace(0.04, 0.96, 24) * len(along)).astype(int))]
        left, right = np.searchsorted(along, at + spill) / len(along), 1 - np.searchsorted(along, at - spill) / len(along)
        work = left**2 + right**2
        if least is None or work.min() < least[0]:
            least = (work.min(), k, float(at[work.argmin()]))
    below = (angles, leaf, levels, width)
    if least[0] <= WORTH:
        _, k, at = least
        along = x @ direction(place, k, x.shape[1])
        sides = [(x[part], rows * part.mean(), place_of(place, side)) for side, part in enumerate((along < at + spill, along >= at - spill))]
        return ("cut", place, k, at, *(grown(*side, level + 1, *below) for side in sides))
    some = x[:: max(1, len(x) // 16)]
    centre = x[(x @ some[((some @ x.T) >= angles.inside).sum(1).argmax()]) >= angles.inside].mean(0)
    centre /= np.linalg.norm(centre)
    out = x @ centre < angles.inside
    if out.mean() > 1 - BALL:
        return ("leaf", place, FUZZY)
    return ("ball", place, centre, grown(x[out], rows * out.mean(), place_of(place, "loose"), level + 1, *below))


def sent(tree, x: np.ndarray, own: np.ndarray, angles: Angles, width: float):
    """(rows, place, kind) of where the rows ``own`` of ``x`` arrive."""
    if not len(own):
        return
    if tree[0] == "leaf":
        yield own, tree[1], tree[2]
    elif tree[0] == "cut":
        _, place, k, at, left, right = tree
        along, spill = x[own] @ direction(place, k, x.shape[1]), angles.spill(x.shape[1], width)
        yield from sent(left, x, own[along < at + spill], angles, width)
        yield from sent(right, x, own[along >= at - spill], angles, width)
    else:
        _, place, centre, loose = tree
        cosine = x[own] @ centre
        inside = cosine >= angles.inside
        yield own[inside], place, INSIDE
        yield own[~inside & (cosine >= angles.near)], place | 1, NEAR
        yield from sent(loose, x, own[~inside], angles, width)


def comparable(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """node (a number of the row), vec_id, kin (label and dimension; null for vectors that link with nothing) and vec; whether vec is of doubles."""
    wide = dict(vectors.dtypes)["embedding"] != "array<float>"

    def run(batches):
        numbers = count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, labels, lists = (batch.column(c) for c in ("vec_id", "label", "embedding"))
            sizes = np.array([n or 0 for n in pa.compute.list_value_length(lists).to_pylist()])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if wide else np.float32)
            starts, vecs = np.cumsum(sizes) - sizes, [b""] * len(sizes)
            for dims in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == dims)
                x = flat[starts[rows][:, None] + np.arange(dims)]
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                for r, v in zip(rows[good], x[good]):
                    vecs[r] = v.tobytes()
            kin = [f"{label}:{n}" if label is not None and v else None for label, n, v in zip(labels.to_pylist(), sizes.tolist(), vecs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(numbers) for _ in kin], pa.int64()), ids, pa.array(kin, pa.string()), pa.array([v if k else b"" for v, k in zip(vecs, kin)], pa.binary())],
                names=["node", "vec_id", "kin", "vec"],
            )

    typed = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    return typed.mapInArrow(run, "node long, vec_id long, kin string, vec binary"), wide


class Forest:
    def __init__(self, threshold: float, wide: bool, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, levels: int = LEVELS, width: float = SPILL, most_broadcast: int = MOST_BROADCAST):
        self.angles, self.wide, self.trees, self.leaf, self.sample, self.levels, self.width, self.most_broadcast = Angles(threshold), wide, trees, leaf, sample, levels, width, most_broadcast

    def fit(self, rows: DataFrame) -> DataFrame:
        """kin, place, tree (pickled): what is below each place. ``rows``: kin, place, node, vec and n, the rows of their place."""
        angles, wide, leaf, levels, width = self.angles, self.wide, self.leaf, self.levels, self.width
        chosen = F.pmod(F.xxhash64("node", "place", F.lit("sample")), F.lit(1 << 30)) < F.lit(float(self.sample << 30)) / F.col("n")

        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            kin, place, n = (k.as_py() for k in key)
            order = np.argsort(group.column("node").to_numpy())  # so that a rerun gives the same tree
            vecs = group.column("vec").to_pylist()
            tree = grown(units([vecs[i] for i in order], wide), n, place, 0, angles, leaf, levels, width)
            return pa.table({"kin": [kin], "place": [place], "tree": [pickle.dumps(tree)]})

        return rows.filter(chosen).select("kin", "place", "n", "node", "vec").groupBy("kin", "place", "n").applyInArrow(run, "kin string, place long, tree binary")

    def down(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        """All rows at the places that their trees send them to; vec only where a leaf may still be split."""
        angles, wide, width, step = self.angles, self.wide, self.width, 4096
        n_bytes, n_trees = fitted.agg(F.sum(F.length("tree")), F.count(F.lit(1))).first()
        small = (n_bytes or 0) <= self.most_broadcast and n_trees <= MOST_NODES
        trees = rows.sparkSession.sparkContext.broadcast({(r.kin, r.place): r.tree for r in fitted.collect()} if small else {})

        def arrive(tree, kin, nodes, vecs):
            x = units(vecs, wide)
            for own, place, kind in sent(tree, x, np.arange(len(vecs)), angles, width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kin] * len(own), pa.string()), pa.array([place] * len(own), pa.int64()), pa.array([nodes[i] for i in own], pa.int64()), pa.array([vecs[i] if kind == OPEN else None for i in own], pa.binary()), pa.array([kind] * len(own), pa.int32())],
                    names=["kin", "place", "node", "vec", "kind"],
                )

        def run(batches):
            """Rows come sorted by place, a place's fitted tree before them unless it was sent ahead."""
            place, tree = None, None
            for batch in batches:
                own = list(zip(*(batch.column(c).to_pylist() for c in ("kin", "place", "node", "vec", "tree"))))
                at = 0
                while at < len(own):
                    key = own[at][:2]
                    if key != place:
                        place, packed = key, own[at][4] or trees.value.get(key)
                        tree = pickle.loads(packed)
                    end = at
                    while end < len(own) and own[end][:2] == key and end - at < step:
                        end += 1
                    nodes, vecs = [r[2] for r in own[at:end] if r[4] is None], [r[3] for r in own[at:end] if r[4] is None]
                    if nodes:
                        yield from arrive(tree, key[0], nodes, vecs)
                    at = end

        plain = rows.select("kin", "place", "node", "vec", F.lit(None).cast("binary").alias("tree"))
        if small:
            return plain.sortWithinPartitions("kin", "place").mapInArrow(run, ROWS)
        salts = F.ceil(F.col("n") / (64 * self.leaf)).cast("int")
        dealt = rows.select("kin", "place", "node", "vec", F.lit(None).cast("binary").alias("tree"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
        sizes = rows.select("kin", "place", "n").distinct()
        heads = fitted.join(sizes, ["kin", "place"]).select("kin", "place", F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("vec"), "tree", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        met = dealt.unionByName(heads).repartition("kin", "place", "salt").sortWithinPartitions("kin", "place", "salt", F.asc_nulls_first("node"))
        return met.drop("salt").mapInArrow(run, ROWS)

    def places(self, base: DataFrame) -> DataFrame:
        """node, kin, place, kind: every place of every row, once it can't or need not be split."""
        spark, leaf = base.sparkSession, self.leaf
        rows = base.filter("kin IS NOT NULL").select("kin", "node", "vec")
        large = cut(rows.groupBy("kin").count().filter(F.col("count") > leaf))
        few = F.broadcast if large.count() <= MOST_NODES else lambda df: df
        root = lambda t: F.shiftleft(F.shiftrightunsigned(F.xxhash64("kin", F.lit(t)), 2), 1)
        done = [rows.join(few(large), "kin", "left_anti").select("node", "kin", root(0).alias("place"), F.lit(OPEN).alias("kind"))]
        open_rows = rows.join(few(large), "kin").select("kin", F.explode(F.array(*[root(t) for t in range(self.trees)])).alias("place"), "node", "vec", F.col("count").alias("n"))
        for _ in range(ROUNDS):
            if open_rows.isEmpty():
                return united(spark, done)
            arrived = stored(self.down(open_rows, stored(self.fit(open_rows))))
            sizes = stored(arrived.filter(F.col("kind") == OPEN).groupBy("kin", "place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf))
            few = F.broadcast if sizes.count() <= MOST_NODES else lambda df: df
            again = F.col("n").isNotNull() & (F.col("kind") == OPEN)
            arrived = arrived.join(few(sizes), ["kin", "place"], "left")
            done.append(arrived.filter(~again).select("node", "kin", "place", "kind"))
            open_rows = arrived.filter(again).select("kin", "place", "node", "vec", "n")
        return united(spark, [*done, open_rows.select("node", "kin", "place", F.lit(FUZZY).alias("kind"))])


def united(spark, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out.distinct())


def dealt(stands: DataFrame, leaf: int) -> DataFrame:
    """Rows with the groups that they are compared in: part (group), side (0 or 1) and inner.

    In a group rows of side 0 are compared with those of side 1 and, where ``inner``, with each
    other. A place with up to ``leaf`` rows is one group. In a larger one, a ball's own rows (those
    of its most common core) are dealt over parts of ``leaf`` rows on side 1; all others are blocks
    of ``leaf`` rows, each of which meets each part, itself and each other block.
    """
    at = ["kin", "at"]
    by_core = stands.groupBy(*at, F.when(F.col("kind") == INSIDE, F.col("core")).alias("core")).agg(F.count(F.lit(1)).alias("n"))
    sizes = by_core.groupBy(*at).agg(F.sum("n").alias("n"), F.max(F.when(F.col("core").isNotNull(), F.struct("n", "core"))).alias("top"))
    big = cut(sizes.filter(F.col("n") > leaf).select(*at, "n", F.coalesce("top.n", F.lit(0)).alias("m"), F.col("top.core").alias("main")))
    few = F.broadcast if big.count() <= MOST_NODES else lambda df: df
    parts = lambda n: F.ceil(n / leaf).cast("int")
    blocks, cores = parts(F.col("n") - F.col("m")), parts(F.col("m"))
    mine = lambda n: F.pmod(F.xxhash64("node", F.lit("deal")), n).cast("int")
    group = lambda part, side, inner: F.struct(part.alias("part"), side.alias("side"), inner.alias("inner"))
    name = lambda kind, i, j: F.concat(F.lit(kind), i.cast("string"), F.lit("-"), j.cast("string"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    one = F.array(group(F.lit(""), zero, yes))
    own = F.transform(every(blocks), lambda i: group(name("c", i, mine(cores)), F.lit(1), no))
    others = F.concat(
        F.transform(every(blocks), lambda j: group(name("b", F.least(j, mine(blocks)), F.greatest(j, mine(blocks))), (j < mine(blocks)).cast("int"), j == mine(blocks))),
        F.transform(every(cores), lambda s: group(name("c", mine(blocks), s), zero, no)),
    )
    is_own = (F.col("kind") == INSIDE) & F.col("main").eqNullSafe(F.col("core")) & F.col("main").isNotNull()
    groups = F.when(F.col("n").isNull(), one).when(is_own, own).otherwise(others)
    return stands.join(few(big), at, "left").withColumn("g", F.explode(groups)).drop("n", "m", "main").select("*", "g.*").drop("g")


def span(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n rows with links (a, b): the least row each is linked with through them."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def met_before(codes: np.ndarray, a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    """Which pairs of rows are compared at a lesser place, too. codes: a row's places, padded with -1."""
    out = np.zeros(len(a), bool)
    for column in codes.T:
        mine = column[a]
        look = np.flatnonzero((mine >= 0) & (mine >> 1 < place >> 1) & ~out)
        theirs = codes[b[look]]
        both = (theirs >= 0) & (theirs >> 1 == mine[look, None] >> 1) & ~((theirs & 1 == 1) & (mine[look, None] & 1 == 1))
        out[look] |= both.any(1)
    return out


def links_of_group(x, cores, near, codes, side, inner, place, threshold):
    """Each row's number of links that count here, and for each row the least row that it is linked with."""
    n = len(x)
    numbers, lefts, rights = np.zeros(n, np.int64), [], []
    zero = np.flatnonzero(side == 0)
    for at in range(0, len(zero), 256):
        part = zero[at : at + 256]
        other = x @ x[part].T >= threshold  # row, column
        b, a = np.nonzero(other)
        a = part[a]
        fit = ((side[b] == 1) | inner & (b > a)) & ~(near[a] & near[b])
        a, b = a[fit], b[fit]
        lefts.append(a)
        rights.append(b)
        counted = ~((cores[a] >= 0) & (cores[a] == cores[b]))
        a, b = a[counted], b[counted]
        first = ~met_before(codes, a, b, place)
        np.add.at(numbers, a[first], 1)
        np.add.at(numbers, b[first], 1)
    return numbers, span(np.concatenate(lefts), np.concatenate(rights), n) if lefts else np.arange(n)


def compared(groups: DataFrame, threshold: float, wide: bool) -> DataFrame:
    """node, other, n: numbers of links (other null) and links that span what is linked (n null)."""
    keys = ["kin", "at", "part"]

    def judge(place: int, rows: list[tuple]):
        node, vec, core, near, codes, side, inner = zip(*rows)
        width = max(map(len, codes))
        padded = np.array([[*c, *[-1] * (width - len(c))] for c in codes], np.int64)
        x, inner = units(list(vec), wide), any(inner)
        numbers, root = links_of_group(x, np.array([-1 if c is None else c for c in core]), np.array(near), padded, np.array(side), inner, place, threshold)
        hit, moved = np.flatnonzero(numbers), np.flatnonzero(root != np.arange(len(rows)))
        return [(node[i], None, int(numbers[i])) for i in hit] + [(node[i], node[root[i]], None) for i in moved]

    def run(batches):
        group, rows = None, []
        for batch in batches:
            out = []
            for *key, node, vec, core, near, codes, side, inner in zip(*(batch.column(c).to_pylist() for c in (*keys, "node", "vec", "core", "near", "codes", "side", "inner"))):
                if key != group:
                    if len(rows) > 1:
                        out += judge(group[1], rows)
                    group, rows = key, []
                rows.append((node, vec, core, near, codes, side, inner))
            yield found(out)
        yield found(judge(group[1], rows) if len(rows) > 1 else [])

    def found(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["node", "other", "n"])

    return groups.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "node long, other long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept. Options: those of ``Forest``."""
    plain, wide = comparable(vectors)
    base = stored(plain)
    forest = Forest(threshold, wide, **options)
    stands = forest.places(base)
    mine = stands.groupBy("node").agg(F.min(F.when(F.col("kind") == INSIDE, F.col("place"))).alias("core"), F.collect_list(F.struct("place", "kind")).alias("places"))
    known = stored(base.join(mine, "node").select("node", "kin", "vec", "core", "places", F.transform("places", lambda p: p["place"]).alias("codes")))
    each = known.withColumn("p", F.explode("places")).select("kin", (F.col("p.place") - F.col("p.place") % 2).alias("at"), "node", "vec", "core", (F.col("p.kind") == NEAR).alias("near"), F.col("p.kind").alias("kind"), "codes")
    found = stored(compared(dealt(each, forest.leaf), threshold, wide))
    # a core's rows link with each other: its size counts and its least node spans it, met salt by salt
    cored = known.filter("core IS NOT NULL").select("kin", "core", "node", salt(F.col("node")).alias("salt"))
    sizes = summed(cored, ["kin", "core"], F.count(F.lit(1)), F.min("node"))
    in_core = stored(cored.join(sizes, ["kin", "core", "salt"]).select("node", F.col("low").alias("other"), (F.col("n") - 1).alias("n")))
    numbers = found.filter("n IS NOT NULL").select("node", "n").unionByName(in_core.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n_links"))
    same_id = base.filter("kin IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "node", salt(F.col("node")).alias("salt"))
    repeats = summed(same_id, ["vec_id"], F.count(F.lit(1)), F.min("node")).filter("n > 1")
    by_id = same_id.join(repeats, ["vec_id", "salt"]).select("node", F.col("low").alias("other"))
    edges = found.filter("other IS NOT NULL").select("node", "other").unionByName(in_core.select("node", "other")).unionByName(by_id).filter("node <> other")
    ids = base.select("node", F.col("vec_id").alias("id"))
    least = least_ids(ids, components(edges.select(F.col("node").alias("u"), F.col("other").alias("v"))))
    out = base.select("node", "vec_id").join(numbers, "node", "left").join(least, "node", "left")
    component = F.col("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component, F.col("vec_id").eqNullSafe(component).alias("kept"))


def summed(rows: DataFrame, keys: list[str], n: Column, low: Column) -> DataFrame:
    """Keys with n and low, once for each salt that the key has rows in: combined by salt first, for keys with very many rows."""
    by_salt = rows.groupBy(*keys, "salt").agg(n.alias("n"), low.alias("low"))
    return by_salt.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.collect_set("salt").alias("salts")).select(*keys, "n", "low", F.explode("salts").alias("salt"))
