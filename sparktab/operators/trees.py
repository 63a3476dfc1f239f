"""Tree candidates of one frame grown together (MLT-01, MLT-04).

``pyspark.ml`` fits one estimator at a time: each fit bins the rows again and
each level of each tree is a pass of its own over them.  A ``Grower`` takes
all decision trees, forests and boosted chains at once and grows them by the
same rules (at most 32 bins a feature, best variance gain, a third of the
features for each node of a forest's tree, Poisson(1) weights by a hash of the
row, a chain's further trees on twice the residual):

* rows are binned once a fit, in blocks of a byte a value; a pass over them
  takes a level of every tree under growth;
* a task sums counts and labels by (tree, node, feature, bin), so what it
  sends does not grow with its rows; large sums are added by key before splits
  are chosen, and the driver gets a split a node;
* decision trees have no chance in them, so one grown to the greatest depth
  holds the others, and is the first tree of every chain; chains that differ
  in their length only are one chain.

Weights and features depend on (seed, tree, row or level), not on the
partitioning; sums of doubles do, in their last digits."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32  # as maxBins of pyspark.ml
SAMPLED = 100_000  # rows whose values place the cuts (pyspark.ml: 10,000)
BLOCK = 1 << 14  # rows that are summed at a time: their columns stay in a core's cache
ROWS_A_TASK = 4_000_000
JOINT = 1 << 13  # cells of features that are summed as one, over all nodes of a level
FOREST_BYTES = 48 << 20  # sums of the forests' trees that a task holds at a time
DIRECT_BYTES = 32 << 20  # sums that go to the driver without being added by key
CHUNK = 64  # nodes of a tree that are added by one key
TABLED = 6  # steps by table: 2^6 ends, a bit of a word each
_BRUIJN = np.uint64(0x03F79D71B4CB0A89)  # times 1 << i, its upper 6 bits differ for every i
_END = np.zeros(64, np.int64)
_END[(np.uint64(1) << np.arange(64, dtype=np.uint64)) * _BRUIJN >> np.uint64(58)] = np.arange(64)
# Poisson(1) by 16 bits of a hash
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)

# estimators by name, as workers import this module and pyspark.ml takes seconds
_KINDS = {"DecisionTreeRegressor": {"maxDepth"}, "RandomForestRegressor": {"maxDepth", "numTrees"}, "GBTRegressor": {"maxDepth", "maxIter", "stepSize"}}
_FREE = {"seed", "cacheNodeIds", "maxMemoryInMB", "checkpointInterval"}


def _kind(est) -> str:
    return type(est).__name__ if type(est).__module__ == "pyspark.ml.regression" else ""


def grows(est) -> bool:
    """Whether an estimator is one of the three, with nothing set that a ``Grower`` does not know."""
    if _kind(est) not in _KINDS:
        return False
    plain, known = type(est)(), _KINDS[_kind(est)] | _FREE
    set_ = {p.name: v for p, v in est.extractParamMap().items() if p.name not in known}
    return set_ == {p.name: v for p, v in plain.extractParamMap().items() if p.name not in known}


def cuts_of(values: np.ndarray) -> np.ndarray:
    """Cuts of a feature by the rule of ``pyspark.ml``: between all values if
    they are few, else so that each bin gets about as many rows."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    mid = (v[:-1] + v[1:]) / 2
    if len(mid) < BINS:
        return mid
    stride = target = n.sum() / BINS
    upto, out = np.cumsum(n), []
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out[:BINS - 1])


def _codes(columns: list, cuts: list) -> np.ndarray:
    """Bin of each value; a missing one is in the last bin, so it goes right."""
    out = np.empty((len(cuts), len(columns[0])), np.uint8)
    for o, c, v in zip(out, cuts, columns):
        o[:] = np.searchsorted(c, v, "left")
    return out


def _halves(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each inner node in ``steps`` levels, the ends below its left and its right child, as bits."""
    left, right = [], []
    for d in range(steps):
        w = 1 << (steps - d - 1)
        for j in range(1 << d):
            left.append(((1 << w) - 1) << (2 * j * w))
            right.append(((1 << w) - 1) << ((2 * j + 1) * w))
    return np.array(left, np.uint64), np.array(right, np.uint64)


class _Down:
    """Steps of binned rows down trees, each (feature or -1 at a leaf, last bin
    of the left) by node of a full tree: node i has children 2i + 1 and 2i + 2.

    For the first ``TABLED`` steps a table by bin holds, for each feature of a
    tree, the ends that a row's value leaves open; all features together leave
    one, or those below one leaf.  Further steps are taken one by one."""

    def __init__(self, trees: list, steps: int):
        t = min(steps, TABLED)
        left, right = _halves(t)
        inner, bins = np.arange((1 << t) - 1), np.arange(BINS)[:, None]
        self.more, self.trees = steps - t, []
        for feat, cut in trees:
            feat, cut = feat[:(1 << steps) - 1], cut[:(1 << steps) - 1]
            f, c = feat[inner], cut[inner]
            tables = [(i, np.bitwise_and.reduce(np.where(bins <= c[f == i], ~right[f == i], ~left[f == i]), axis=1)) for i in np.unique(f[f >= 0])]
            ends = np.arange((1 << t) - 1, (1 << (t + 1)) - 1)
            for i in inner[f < 0][::-1]:  # upper leaves last
                depth = int(i + 1).bit_length() - 1
                w = 1 << (t - depth)
                at = (i + 1 - (1 << depth)) * w
                ends[at:at + w] = i
            below = np.concatenate([feat, np.full(1 << steps, -1, feat.dtype)])
            node = np.arange(len(below))
            kids = np.where((below < 0)[:, None], node[:, None], 2 * node[:, None] + [1, 2]).ravel()
            self.trees.append((tables, ends[_END % (1 << t)] if t else ends, np.maximum(below, 0).astype(np.int64), np.concatenate([cut, np.zeros(1 << steps, cut.dtype)]), kids))

    def nodes(self, codes: np.ndarray):
        """The node of each row in each tree, a tree at a time."""
        n = codes.shape[1]
        places, flat, row = [None] * len(codes), codes.ravel(), np.arange(n)
        for tables, ends, feat, cut, kids in self.trees:
            if tables:
                bits = None
                for i, table in tables:
                    if places[i] is None:
                        places[i] = codes[i].astype(np.int64)
                    got = table.take(places[i], mode="clip")
                    if bits is None:
                        bits = got
                    else:
                        bits &= got
                bits &= np.negative(bits)  # the lowest
                bits *= _BRUIJN
                bits >>= np.uint64(58)
                node = ends.take(bits.view(np.int64), mode="clip")
            else:
                node = np.zeros(n, np.int64)
            for _ in range(self.more):
                at = (feat * n).take(node, mode="clip")
                at += row
                right = flat.take(at, mode="clip") > cut.take(node, mode="clip")
                node += node
                node += right
                node = kids.take(node, mode="clip")
            yield node


class _Tree:
    """A tree under growth.  ``chain``: place of the chain that it goes on, None
    for labels; ``bag``: (multiplier of the rows' hashes, seeds) of a forest's tree."""

    def __init__(self, depth: int, chain: int | None = None, bag: tuple | None = None):
        self.depth, self.chain, self.bag = depth, chain, bag
        n = 2 ** (depth + 1) - 1
        self.feat, self.cut, self.value = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n)
        self.open = np.zeros(1, np.int64)  # nodes of the level that may be split

    def chosen(self, level: int, k: int) -> np.ndarray:
        """Features of each open node, a third of them."""
        order = np.random.default_rng([*self.bag[1], level]).random((1 << level, k)).argsort(1)
        return np.sort(order[self.open - (2 ** level - 1), :-(-k // 3)], 1)

    def split(self, level: int, found: dict) -> None:
        """Takes over what ``_best`` found for the open nodes."""
        if level == 0:
            self.value[0] = found["mean"][0]
        at, node = np.flatnonzero(found["gain"]), self.open
        i = node[at]
        self.feat[i], self.cut[i] = found["feat"][at], found["cut"][at]
        self.value[2 * i + 1], self.value[2 * i + 2] = found["left"][at], found["right"][at]
        kids = np.stack([2 * i + 1, 2 * i + 2], 1).ravel()
        rows = np.stack([found["n_left"][at], found["n_right"][at]], 1).ravel()
        self.open = kids[rows >= 2] if level + 1 < self.depth else kids[:0]

    def upto(self, depth: int) -> tuple:
        n = 2 ** (depth + 1) - 1
        feat = self.feat[:n].copy()
        feat[n // 2:] = -1
        return feat, self.cut[:n], self.value[:n]


def _best(n: np.ndarray, s: np.ndarray, feats: np.ndarray | None) -> dict:
    """The best cut of each node by variance gain, from counts and sums by
    (node, feature, bin); ``gain`` is False for a node that stays a leaf."""
    total, label = n[:, 0].sum(1).astype(float), s[:, 0].sum(1)
    mean = label / np.maximum(total, 1)
    left = n.cumsum(2)[:, :, :-1].astype(float)
    dev = s.cumsum(2)[:, :, :-1] - left * mean[:, None, None]  # from the node's mean, so a large mean takes no digits
    right = total[:, None, None] - left
    ok = (left > 0) & (right > 0)
    gain = np.where(ok, dev * dev * total[:, None, None] / np.where(ok, left * right, 1), 0.0)
    flat = gain.reshape(len(gain), -1)
    at = (flat >= flat.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)  # the first of equals, whatever the order of the sums
    node, (f, cut) = np.arange(len(at)), np.divmod(at, gain.shape[2])
    nl, d = left[node, f, cut], dev[node, f, cut]
    nr = total - nl
    return {"gain": flat[node, at] > 1e-24 * label * mean, "feat": f if feats is None else feats[node, f], "cut": cut, "mean": mean,
            "left": mean + d / np.maximum(nl, 1), "right": mean - d / np.maximum(nr, 1), "n_left": nl, "n_right": nr}


def _groups(bins: list, cells: int) -> list:
    """Features that are summed as one: the product of their bins is ``cells`` at most."""
    out = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        for g in out:
            if math.prod(bins[i] for i in g) * bins[f] <= cells:
                g.append(f)
                break
        else:
            out.append([f])
    return out


def _apart(sums: np.ndarray, group: list, bins: list, out: np.ndarray) -> None:
    """Sums of each feature of a group, from those by all of them."""
    cube = sums.reshape(len(out), *[bins[f] for f in group])
    for a, f in enumerate(group):
        out[:, f, :bins[f]] = cube.sum(tuple(i + 1 for i in range(len(group)) if i != a))


def _summed(level: int, trees: list, bins: list):
    """A task's sums of a level: ((tree, first node), (counts, label sums)) over (node, feature, bin)."""
    k, first = len(bins), 2 ** level - 1

    def run(blocks):
        walk = _Down([(t.feat, t.cut) for t in trees], level)
        plans, by_groups = [], {}
        for t in trees:
            slot = np.full(2 ** (level + 1) - 1, len(t.open), np.int64)
            slot[t.open] = np.arange(len(t.open))
            if t.bag:
                feats = t.chosen(level, k)
                plans.append((t, slot, feats, [np.zeros((len(t.open) + 1) * BINS, complex) for _ in feats.T]))
            else:
                groups = _groups(bins, JOINT // len(t.open))
                plans.append((t, slot, groups, [np.zeros((len(t.open) + 1) * math.prod(bins[f] for f in g), complex) for g in groups]))
        for codes, label, z, so_far in blocks:
            joint, flat, rows_of = {}, codes.ravel(), codes.shape[1]
            y = np.empty(rows_of, complex)  # a label and a count of one
            for (t, slot, what, sums), node in zip(plans, walk.nodes(codes)):
                if t.bag:
                    weight = _POISSON.take((z * np.uint64(t.bag[0]) >> np.uint64(48)).view(np.int64), mode="clip")
                    rows = np.flatnonzero(weight)
                    place = slot.take(node.take(rows, mode="clip"), mode="clip")
                    if 2 * len(t.open) <= 2 ** level:  # most rows are on leaves
                        some = np.flatnonzero(place < len(t.open))
                        rows, place = rows.take(some), place.take(some)
                    w = weight.take(rows, mode="clip")
                    got = np.empty(len(rows), complex)
                    np.multiply(label.take(rows, mode="clip"), w, out=got.real)
                    got.imag = w
                    m = what.shape[1]
                    of = np.concatenate([what, what[:1]]) * rows_of
                    base = place * BINS
                    for i in range(m):
                        at = of[:, i].copy().take(place, mode="clip")
                        at += rows
                        at = flat.take(at, mode="clip") + base
                        np.add.at(sums[i], at, got)
                    continue
                if t.chain is None:
                    y.real = label
                else:
                    np.subtract(label, so_far[t.chain], out=y.real)
                    y.real *= 2
                y.imag = 1
                place = slot.take(node, mode="clip") if level else node
                for g, add in zip(what, sums):
                    if (key := tuple(g)) not in joint:
                        code = codes[g[0]].astype(np.int64)
                        for f in g[1:]:
                            code *= bins[f]
                            code += codes[f]
                        joint[key] = code
                    at = place * math.prod(bins[f] for f in g)
                    at += joint[key]
                    np.add.at(add, at, y)
        for i, (t, _, what, sums) in enumerate(plans):
            opened = len(t.open)
            if t.bag:
                both = np.stack([a.reshape(-1, BINS)[:opened] for a in sums], 1)
            else:
                both = np.zeros((opened, k, BINS), complex)
                for g, a in zip(what, sums):
                    _apart(a[:opened * math.prod(bins[f] for f in g)], g, bins, both)
            n, s = both.imag, both.real.copy()
            n = n.astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64)
            for at in range(0, opened, CHUNK):
                yield (i, at), (n[at:at + CHUNK], s[at:at + CHUNK])

    return run


def _plus(a: tuple, b: tuple) -> tuple:
    return np.add(a[0], b[0], dtype=np.int64), a[1] + b[1]


class TreesModel:
    """A weighted sum of grown trees over the named columns."""

    def __init__(self, features: list[str], cuts: list, trees: list, weights: list):
        self.features, self.cuts, self.trees, self.weights = features, cuts, trees, weights

    def transform(self, df: DataFrame) -> DataFrame:
        return predict({"prediction": self}, df, "")


def predict(models: dict, df: DataFrame, prefix: str = "p_") -> DataFrame:
    """``df`` with a column for each model, all of one ``Grower``, in one pass;
    a tree that several models share is walked once."""
    names, some = list(models), next(iter(models.values()))
    shared = {}
    for j, m in enumerate(models.values()):
        for tree, w in zip(m.trees, m.weights):
            shared.setdefault(id(tree), (tree, []))[1].append((j, w))
    by_depth = {}
    for tree, use in shared.values():
        depth = len(tree[0]).bit_length() - 1
        by_depth.setdefault(depth, []).append((tree, use))
    cuts = some.cuts

    @F.arrow_udf("struct<" + ",".join(f"p{j}:double" for j in range(len(names))) + ">")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        walks = [(_Down([t[:2] for t, _ in same], depth), same) for depth, same in by_depth.items()]
        for batch in parts:
            out = np.zeros((len(names), len(batch)))
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.flatten()]
            for at in range(0, len(batch), BLOCK):
                codes = _codes([c[at:at + BLOCK] for c in columns], cuts)
                for walk, same in walks:
                    for node, ((_, _, value), use) in zip(walk.nodes(codes), same):
                        got = value.take(node, mode="clip")
                        for j, w in use:
                            out[j, at:at + BLOCK] += w * got
            yield pa.StructArray.from_arrays([pa.array(o) for o in out], names=[f"p{j}" for j in range(len(names))])

    scored = df.withColumn("_trees", score(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in some.features])))
    return scored.select(*df.columns, *[F.col(f"_trees.p{j}").alias(f"{prefix}{n}") for j, n in enumerate(names)])


class Grower:
    """Cuts of the features of a frame, and fits of tree candidates on parts of
    it.  Rows have a null-free ``label`` and ``_h``, a hash of their key."""

    def __init__(self, df: DataFrame, features: list[str], n_rows: int, seed: int = 42):
        self.features, self.seed = features, seed
        some = self._columns(df)
        if n_rows > SAMPLED:
            some = some.where(F.pmod("_z", F.lit(1 << 20)) < (SAMPLED << 20) // n_rows)
        got = some.select(*features).toArrow()
        self.cuts = [cuts_of(got.column(i).to_numpy().astype(float)) for i in range(len(features))]
        self.bins = [len(c) + 1 for c in self.cuts]

    def _columns(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in self.features], "label",
                         F.xxhash64("_h", F.lit(self.seed)).alias("_z"))

    def _blocks(self, df: DataFrame, n_rows: int):
        k, cuts = len(self.features), self.cuts
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_A_TASK))

        def binned(batches):
            """Pickled blocks of a task's rows: bins by feature, label, hash, and no chain's sums yet."""
            held, n = [], 0

            def packed(upto: int):
                whole = [np.concatenate(a, -1) for a in zip(*held)]
                for at in range(0, upto, BLOCK):
                    codes, label, z = (np.ascontiguousarray(a[..., at:at + BLOCK]) for a in whole)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((codes, label, z, np.zeros((0, len(label)))), 5)], pa.binary())], names=["block"])
                held[:] = [tuple(a[..., upto:] for a in whole)]

            for b in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                held.append((_codes(cols[:k], cuts), cols[k], cols[k + 1].view(np.uint64)))
                n += len(cols[k])
                if n >= BLOCK:
                    yield from packed(n - n % BLOCK)
                    n %= BLOCK
            if n:
                yield from packed(n)

        rows, spark = self._columns(df).coalesce(tasks).mapInArrow(binned, "block binary"), df.sparkSession
        # the bytes as they are: DataFrame.rdd would pickle them as text
        blocks = getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toJavaRDD()
        return RDD(blocks, spark.sparkContext, CPickleSerializer()).map(lambda b: b).persist(StorageLevel.MEMORY_AND_DISK_DESER), tasks

    def fit(self, candidates: dict, df: DataFrame, n_rows: int) -> dict:
        """{name: TreesModel} of {name: estimator}, each on all rows of ``df``."""
        forests = {n: e for n, e in candidates.items() if _kind(e) == "RandomForestRegressor"}
        boosted = {n: e for n, e in candidates.items() if _kind(e) == "GBTRegressor"}
        single = {n: e for n, e in candidates.items() if _kind(e) == "DecisionTreeRegressor"}
        chains = {}  # (depth, step): trees, the longest first
        for e in sorted(boosted.values(), key=lambda e: -e.getMaxIter()):
            chains.setdefault((e.getMaxDepth(), e.getStepSize()), e.getMaxIter())
        grown, waiting = {c: [] for c in chains}, []
        for name, e in forests.items():
            seed = e.getSeed() % (1 << 63)
            odd = np.random.default_rng(seed).integers(1 << 62, size=e.getNumTrees(), dtype=np.int64)
            waiting += [(name, _Tree(e.getMaxDepth(), bag=(2 * int(o) + 1, [seed, t]))) for t, o in enumerate(odd)]
        woods = {n: [] for n in forests}
        state, tasks = self._blocks(df, n_rows)
        old, first, done = None, {}, 0  # the first tree, cut at each depth
        while done < max(list(chains.values()), default=0) or waiting or (done == 0 and (single or chains)):
            live = [c for c in chains if chains[c] > done]
            now, held = [], 0
            depths = {e.getMaxDepth() for e in [*single.values(), *boosted.values()]}
            if done == 0 and depths:
                now.append(_Tree(max(depths)))
            elif done:
                now += [_Tree(c[0], chain=i) for i, c in enumerate(live)]
            while waiting and (held == 0 or held + self._bytes(waiting[0][1]) <= FOREST_BYTES):
                name, t = waiting.pop(0)
                held += self._bytes(t)
                woods[name].append(t)
                now.append(t)
            for level in range(max(t.depth for t in now)):
                at = [t for t in now if level < t.depth and len(t.open)]
                if not at:
                    break
                self._level(state, tasks, level, at)
                if old is not None:
                    old.unpersist()
                    old = None
            if done == 0:
                first = {d: now[0].upto(d) for d in depths}
            for i, c in enumerate(live):
                grown[c].append((now[i].upto(c[0]), c[1]) if done else (first[c[0]], 1.0))
            done += 1
            add = [(*grown[c][-1][0], grown[c][-1][1]) for c in live if chains[c] > done]  # the longest come first
            if add:
                old, state = state, state.map(_moved(add)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        for s in (old, state):
            if s is not None:
                s.unpersist()
        model = lambda trees: TreesModel(self.features, self.cuts, [t for t, _ in trees], [float(w) for _, w in trees])
        out = {n: model([(first[e.getMaxDepth()], 1.0)]) for n, e in single.items()}
        out |= {n: model(grown[e.getMaxDepth(), e.getStepSize()][:e.getMaxIter()]) for n, e in boosted.items()}
        out |= {n: model([(t.upto(t.depth), 1 / len(ts)) for t in ts]) for n, ts in woods.items()}
        return {n: out[n] for n in candidates}

    def _bytes(self, tree: _Tree) -> int:
        return 2 ** max(0, tree.depth - 1) * -(-len(self.bins) // 3) * BINS * 16

    def _level(self, state, tasks: int, level: int, trees: list) -> None:
        """Splits of a level of the trees, by one pass."""
        k = len(self.bins)
        feats = [t.chosen(level, k) if t.bag else None for t in trees]
        sums = state.mapPartitions(_summed(level, trees, self.bins))
        size = sum(len(t.open) * (k if f is None else f.shape[1]) * BINS * 16 for t, f in zip(trees, feats))

        def best(item):
            (i, at), (n, s) = item
            return i, at, _best(n, s, None if feats[i] is None else feats[i][at:at + CHUNK])

        if size * tasks > DIRECT_BYTES:
            found = sums.reduceByKey(_plus, tasks).map(best).collect()  # a split a node
        else:
            merged = {}
            for key, part in sums.collect():  # DIRECT_BYTES at most
                merged[key] = _plus(merged[key], part) if key in merged else part
            found = [best(item) for item in merged.items()]
        by = [[] for _ in trees]
        for i, at, f in sorted(found, key=lambda x: x[:2]):
            by[i].append(f)
        for t, fs in zip(trees, by):
            if fs:
                t.split(level, {c: np.concatenate([f[c] for f in fs]) for c in fs[0]})
            else:  # no rows at all
                t.open = t.open[:0]


def _moved(add: list):
    """A block with the chains' sums so far, after one more tree of each."""
    def run(block):
        codes, label, z, so_far = block
        new = np.zeros((len(add), len(label)))
        new[:len(so_far)] = so_far[:len(add)]
        for d in {len(t[0]).bit_length() - 1 for t in add}:
            some = [i for i, t in enumerate(add) if len(t[0]).bit_length() - 1 == d]
            for i, node in zip(some, _Down([add[i][:2] for i in some], d).nodes(codes)):
                new[i] += add[i][3] * add[i][2].take(node, mode="clip")
        return codes, label, z, new

    return run
