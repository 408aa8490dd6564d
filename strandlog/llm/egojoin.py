"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import SLICE, released, roots, stage, tidy
from strandlog.llm.components import components

#: Leading principal dimensions: GRID of them deal vectors to tasks, LEAD of them order and prune within a task.
GRID, LEAD = 2, 6
#: Residents of a cell that one task holds; larger cells are dealt to several keys.
TILE = 8_192
#: Sequence intervals of at most so many vectors are compared in whole.
LEAF = 128
#: Slack of distances in projections, far above rounding and far below a grid cell.
SLACK = 1e-9


def unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max()  # very large or small vectors neither overflow nor vanish
    return v / np.sqrt((v * v).sum())


def principal(units: DataFrame, lead: int = LEAD) -> dict[int, np.ndarray]:
    """Leading principal directions of the unit vectors of each dimension (dim x lead), from sums over all of them.

    A task keeps one matrix of sums for each dimension d that occurs, and gives it away at its end in
    slices, which are added up in the executors: d * d numbers come to the driver, however many
    vectors there are.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, list] = {}
            for v in b.column("embedding").to_pylist():
                by.setdefault(len(v), []).append(unit(v))
            for d, vs in by.items():
                x = np.c_[np.ones(len(vs)), np.array(vs)]
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            flat = m.ravel()
            parts = [flat[at : at + SLICE].tobytes() for at in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["d", "part", "sums"])

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for d, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                got = np.frombuffer(data.as_buffer(), np.float64)
                total[d, part] = total[d, part] + got if (d, part) in total else got
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["d", "part", "sums"])

    kind = "d int, part int, sums binary"
    with tidy(units.sparkSession):
        slices = units.select("embedding").mapInArrow(released(run), kind).repartition("d", "part").mapInArrow(released(add), kind).collect()
    rows: dict[int, list] = {}
    for d, _, data in sorted(slices, key=lambda r: (r[0], r[1])):
        rows.setdefault(d, []).append(np.frombuffer(data, np.float64))
    out = {}
    for d, s in rows.items():
        m = np.concatenate(s).reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[d] = vectors[:, ::-1][:, :lead].copy()
    return out


class Sequence:
    """Unit vectors in epsilon grid order, with their leading coordinates and ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, counts: np.ndarray, axes: np.ndarray, eps: float):
        p = x @ axes
        order = np.lexsort(np.floor(p / eps).T[::-1])
        self.ids, self.x, self.p, self.counts = ids[order], x[order], p[order], counts[order]


def join(a: Sequence, b: Sequence, eps: float, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of a, links of b, i, j): how many vectors each links with, and a forest of the links, of pairs with cosine >= least.

    Joins sequence intervals: two whose bounding boxes on the leading principal
    dimensions are over eps apart have no link and are skipped; short ones are compared;
    the longer of others is halved. With same, a is b and each pair counts once.
    """
    la, lb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    ii, jj = [], []
    stack = [(0, len(a.ids), 0, len(b.ids))]
    boxes: dict[tuple, tuple] = {}

    def box(side, s, p, q):
        key = (side, p, q)
        if key not in boxes:
            boxes[key] = (s.p[p:q].min(0), s.p[p:q].max(0))
        return boxes[key]

    while stack:
        p, q, r, s = stack.pop()
        if p >= q or r >= s or same and s <= p:
            continue
        (alow, ahigh), (blow, bhigh) = box(0, a, p, q), box(1, b, r, s)
        gap = np.maximum(np.maximum(blow - ahigh, alow - bhigh), 0)
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            continue
        if q - p > LEAF or s - r > LEAF:
            if q - p >= s - r:
                m = (p + q) // 2
                stack += [(p, m, r, s), (m, q, r, s)]
            else:
                m = (r + s) // 2
                stack += [(p, q, r, m), (p, q, m, s)]
            continue
        i, j = np.nonzero(a.x[p:q] @ b.x[r:s].T >= least)
        i, j = i + p, j + r
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        np.add.at(la, i, b.counts[j])
        np.add.at(lb, j, a.counts[i])
        i, j = _forest(i, j + (0 if same else len(a.ids)))
        ii.append(i)
        jj.append(j)
    if not ii:
        return la, lb, np.empty(0, np.int64), np.empty(0, np.int64)
    return la, lb, *_forest(np.concatenate(ii), np.concatenate(jj))


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = roots(at[: len(i)], at[len(i) :], len(nodes))
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _joined(axes: dict[int, np.ndarray], eps: float, least: float):
    """Rows in the order of (label, dim, cells, sub, flag): holds a key's residents and lets its visitors stream past."""

    def run(batches):
        now, home, guests, ready = None, [], [], None

        def sequence(rows):
            ids, vectors, counts = zip(*rows, strict=True)
            x = np.array([unit(v) for v in vectors])
            return Sequence(np.array(ids), x, np.array(counts, np.int64), axes[x.shape[1]], eps)

        def out(a, b, same):
            la, lb, i, j = join(a, b, eps, least, same)
            ids = a.ids if same else np.concatenate([a.ids, b.ids])
            n = la + lb if same else np.concatenate([la, lb])
            some = np.flatnonzero(n)
            root = np.full(len(ids), -1, np.int64)
            root[i] = ids[j]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(n[some]), pa.array(root[some], mask=root[some] < 0)], names=["node", "n", "to"]
            )

        def flush():
            nonlocal ready, home, guests
            if ready is None and home:
                ready, home = sequence(home), []
                yield out(ready, ready, True)
            if ready is not None and guests:
                yield out(ready, sequence(guests), False)
            guests = []

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "c0", "c1", "sub")), strict=True))
            flags = b.column("flag").to_pylist()
            rows = list(zip(b.column("node").to_pylist(), b.column("embedding").to_pylist(), b.column("copies").to_pylist(), strict=True))
            for key, flag, row in zip(keys, flags, rows, strict=True):
                if key != now:
                    yield from flush()
                    now, home, ready = key, [], None
                if not flag:
                    home.append(row)
                elif home or ready is not None:
                    guests.append(row)
                    if len(guests) >= TILE:
                        yield from flush()
        yield from flush()

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of vectors (vec_id, embedding, label).

    Vectors of one label (not null) and dimension link at a cosine of `least` or more, in
    double precision. n_links counts the other vectors linked directly, equal ones included;
    component_id is the smallest vec_id reachable (a null vec_id never is the smallest); kept
    says that it is the row's own. Vectors that are null, empty or zero, or that hold null or
    non-finite components, and those without label, link with nothing: 0, their own id, true
    (a null vec_id: null, null). Rows that repeat are linked like any equal vectors. No rows
    give no rows. Other columns are ignored.

    Equal vectors of a label are one class (pre-aggregated), compared once and weighed by its
    number of copies. A class is resident in the cell of the grid of width eps on the two
    leading principal dimensions, and visits half of the cells around it; eps is the distance
    of unit vectors at the least cosine. Cells of more than TILE classes are dealt to several
    keys. Links leave a task as counts and as a forest, never as all pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("least has to be over 0 and at most 1")
    eps = float(np.sqrt(2 - 2 * least)) + 1e-7
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    good = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = v.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    axes = principal(classes)

    def cells(batches):
        for b in batches:
            got = [np.floor((unit(x) @ axes[len(x)])[:GRID] / eps).astype(int).tolist() + [0] for x in b.column("embedding").to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.int32()) for k in range(GRID)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "c0", "c1"])

    placed = classes.select("node", "label", "dim", "copies", "embedding").mapInArrow(released(cells), "node long, label string, dim int, copies long, embedding array<double>, c0 int, c1 int")
    key = ["label", "dim", "c0", "c1"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    near = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    visits = F.explode(F.array(*[F.struct(F.lit(a).alias("s0"), F.lit(b).alias("s1")) for a, b in near])).alias("s")
    moved = placed.select("*", visits).withColumns({"c0": F.col("c0") + F.col("s.s0"), "c1": F.col("c1") + F.col("s.s1"), "own": (F.col("s.s0") == 0) & (F.col("s.s1") == 0)})
    met = moved.drop("s").join(parts, key).withColumn("home", F.pmod(F.col("node"), F.col("parts")).cast("int"))
    subs = F.when(F.col("own"), F.sequence("home", F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = met.withColumn("sub", F.explode(subs)).withColumn("flag", ~(F.col("own") & (F.col("sub") == F.col("home"))))
    dealt = dealt.select(*key, "sub", "flag", "node", "copies", "embedding")
    joined = dealt.repartition(*key, "sub").sortWithinPartitions(*key, "sub", "flag").mapInArrow(released(_joined(axes, eps, least)), "node long, n long, to long")
    joined = stage(joined, "vector-links")
    root = components(joined.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")), "vector-components")
    n = joined.groupBy(F.col("node").alias("n_node")).agg(F.sum("n").alias("n"))
    of = classes.join(root.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("root", "node"))
    of = of.join(n, F.col("node") == F.col("n_node"), "left").select("label", "embedding", "least", "copies", "root", F.coalesce("n", F.lit(0)).alias("n"))
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_members"))
    of = of.join(tops, "root").select(
        F.col("label").alias("l"), F.xxhash64("embedding").alias("x"), F.col("embedding").alias("e"), (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = v.where("good").join(of, (F.col("label") == F.col("l")) & (F.xxhash64("embedding") == F.col("x")) & (F.col("embedding") == F.col("e")))
    linked = linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = v.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    return linked.unionByName(alone)
