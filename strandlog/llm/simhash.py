"""SimHash fingerprints and their exact near-duplicate components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import released, roots, spare, stage
from strandlog.llm.components import components

#: Population counts of the four 16-bit words of a fingerprint give its cell: 17 values each.
SIDE = 17
CELLS = SIDE**4
#: Residents of a cell that one task holds; larger cells are dealt to several keys.
TILE = 32_768
SUB = 1 << 20
STEP = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over the text's word shingles, repeats included; 0 without words.

    A-Z are lower-cased; words are what ASCII white space leaves; a text of fewer words
    than a shingle is one shingle. A bit is set if it is set in over half of the XXH64
    hashes (seed 42).
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[at : at + STEP], last[at : at + STEP])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, of a column to keep, key of every row; a null text has no words."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", "key"][: b.num_columns])

    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(key).alias("key")] if key else [])]
    return docs.select(*kept).mapInArrow(released(run), "doc_id long, fp long" + ", key string" * bool(key))


def _counts(fp: np.ndarray, width: int) -> np.ndarray:
    """Population counts of each fingerprint's words of `width` bits."""
    return np.bitwise_count(fp.view({8: np.uint8, 16: np.uint16}[width]).reshape(len(fp), -1)).astype(np.int16)


def _ahead(radius: int) -> np.ndarray:
    """The steps from a cell to those cells after it (and itself) whose population counts differ by radius at most in sum."""
    r = range(-radius, radius + 1)
    steps = [(a, b, c, d) for a in r for b in r for c in r for d in r if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return np.array([s for s in steps if s >= (0, 0, 0, 0)], np.int64)


def compare(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Exact links between left and right (None: within left), as a forest of (fingerprint, fingerprint).

    Both sides are put in the order of their bytes' population counts and cut into tiles.
    The sum over the bytes of how far two tiles' ranges of counts are apart is the least
    number of bits in which their members differ: beyond the radius the tile pair is
    skipped, else it is compared by exclusive-or and bit counts.
    """

    def tiles(fp):
        c = _counts(fp, 8)
        order = np.lexsort(c.T[::-1])
        fp, c = fp[order], c[order]
        cuts = range(0, len(fp), tile)
        return fp, [(at, min(at + tile, len(fp))) for at in cuts], np.array([c[a : a + tile].min(0) for a in cuts]), np.array([c[a : a + tile].max(0) for a in cuts])

    a, at, alow, ahigh = tiles(left)
    b, bt, blow, bhigh = (a, at, alow, ahigh) if right is None else tiles(right)
    ii, jj = [], []
    for k, (s, e) in enumerate(at):
        gap = (np.maximum(blow - ahigh[k], 0) + np.maximum(alow[k] - bhigh, 0)).sum(1)
        for m in np.flatnonzero(gap <= radius):
            if right is None and m < k:
                continue
            s2, e2 = bt[m]
            hit = np.bitwise_count(a[s:e, None] ^ b[None, s2:e2]) <= radius
            i, j = np.nonzero(hit)
            i, j = i + s, j + s2
            if right is None:
                keep = i < j
                i, j = i[keep], j[keep]
            else:
                j = j + len(a)
            if len(i) > len(hit):  # a spanning forest of the tile pair has all its components
                nodes, at_ = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = roots(at_[: len(i)], at_[len(i) :], len(nodes))
                own = root != np.arange(len(nodes))
                i, j = nodes[own], nodes[root[own]]
            ii.append(i)
            jj.append(j)
    if not ii:
        return a[:0], a[:0]
    both = a if right is None else np.concatenate([a, b])
    i, j = np.concatenate(ii), np.concatenate(jj)
    nodes, at_ = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = roots(at_[: len(i)], at_[len(i) :], len(nodes))
    own = root != np.arange(len(nodes))
    return both[nodes[own]], both[nodes[root[own]]]


def _deal(sizes: np.ndarray, radius: int):
    """Gives each fingerprint to its own cell (as resident) and to those ahead of it (as visitor), in blobs by key."""
    ahead = _ahead(radius)
    pace = np.array([SIDE**3, SIDE**2, SIDE, 1], np.int64)

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(fp):
                continue
            c = _counts(fp, 16).astype(np.int64)
            keys, flags, owners = [], [], []
            own = c @ pace
            sub = (fp % np.uint64(1_000_003)).astype(np.int64) % sizes[own]
            every = np.arange(len(fp))
            keys.append(own * SUB + sub), flags.append(np.zeros(len(fp), np.int64)), owners.append(every)
            for step in ahead:
                to = c + step
                ok = ((to >= 0) & (to < SIDE)).all(1)
                cell = to[ok] @ pace
                mine, n = every[ok], sizes[cell]
                mine, cell, n = mine[n > 0], cell[n > 0], n[n > 0]
                if not step.any():  # to the later parts of the own cell
                    for s in range(1, int(n.max(initial=1))):
                        late = (n > s) & (sub[mine] < s)
                        keys.append(cell[late] * SUB + s), owners.append(mine[late]), flags.append(np.ones(late.sum(), np.int64))
                    continue
                for s in range(int(n.max(initial=0))):
                    has = n > s
                    keys.append(cell[has] * SUB + s), owners.append(mine[has]), flags.append(np.ones(has.sum(), np.int64))
            key, flag, owner = map(np.concatenate, (keys, flags, owners))
            order = np.lexsort((flag, key))
            key, flag, blob = key[order], flag[order], fp[owner[order]]
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (flag[1:] != flag[:-1])])
            offsets = np.r_[cut, len(key)].astype(np.int32) * 8
            blobs = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(blob.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(flag[cut].astype(np.int32)), blobs], names=["key", "flag", "fps"])

    return run


def _link(radius: int, chunk: int = 16_384):
    """Rows in the order of (key, flag): holds a key's residents and lets its visitors stream past."""

    def run(batches):
        now, home, guests, ready = None, [], [], None
        out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def flush():
            nonlocal ready, home, guests
            if ready is None and home:
                ready, home = np.concatenate(home), []
                yield out(*compare(ready, None, radius))
            if ready is not None and guests:
                yield out(*compare(ready, np.concatenate(guests), radius))
            guests = []

        for batch in batches:
            keys, flags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            blobs = batch.column(2)
            waiting = 0
            for i in range(batch.num_rows):
                if keys[i] != now:
                    yield from flush()
                    now, home, ready = keys[i], [], None
                fps = np.frombuffer(blobs[i].as_buffer(), np.uint64)
                if flags[i] == 0:
                    home.append(fps.copy())
                elif home or ready is not None:
                    guests.append(fps.copy())
                    waiting += len(fps)
                    if waiting >= chunk:
                        yield from flush()
                        waiting = 0
        yield from flush()

    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): a forest whose components are those of all pairs of distinct fp within `radius` bits.

    Population counts of the four 16-bit words place a fingerprint in one of 83,521 cells;
    fingerprints within the radius are in cells whose counts differ by no more in sum, so a
    fingerprint meets its own cell and half of the cells around it. The number of members
    of each cell (83,521 numbers at most) is read first: a cell of more than TILE members is
    dealt to several keys, so a task holds TILE residents and streams the others past them.
    """
    cell = F.lit(0)
    for k in (0, 16, 32, 48):
        cell = cell * SIDE + F.bit_count(F.shiftrightunsigned("fp", k).bitwiseAND(0xFFFF))
    sizes = np.zeros(CELLS, np.int64)
    for row in fps.groupBy(cell.alias("cell")).count().collect():
        sizes[row[0]] = -(-row[1] // TILE)
    dealt = fps.select("fp").mapInArrow(released(_deal(sizes, radius)), "key long, flag int, fps binary")
    return dealt.repartition("key").sortWithinPartitions("key", "flag").mapInArrow(released(_link(radius)), "a long, b long")


def rooted(fp: DataFrame, least: Column, radius: int) -> DataFrame:
    """fp, least (aggregated over its rows) and root (its component's smallest fingerprint) of each distinct fp."""
    classes = stage(fp.groupBy("fp").agg(least), "simhash-classes")
    root = components(links(classes, radius), "simhash-links")
    return classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of docs (doc_id, text).

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest
    doc_id reachable over links. Null and empty texts have fingerprint zero and link like
    any other; rows that repeat are linked by their equal fingerprints; a null doc_id never
    is the smallest, and a component of only such rows has a null id. No rows give no rows.
    Other columns are ignored. Equal fingerprints are one class throughout (the smallest id
    is pre-aggregated), so a large group of copies is one fingerprint to compare.
    """
    fp = stage(fingerprints(docs, words), "simhash")
    linked = rooted(fp, F.min("doc_id").alias("least"), radius)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    of = linked.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fp.join(of, F.col("fp") == F.col("_fp")).select("doc_id", hex_fp().alias("fingerprint"), "component_id")


def hex_fp():
    return F.lpad(F.lower(F.hex("fp")), 16, "0")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest doc_id, null ids last.

    Of rows with that doc_id the one of the least text digest stays, then that of the least hash of
    all columns. A null doc_id is no name: a component of only such rows keeps one of them too.
    """
    key = spare(docs.columns)
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    # starts with the id, so that null ids ("") and ids never share a key, nor do two texts: a key is of one component
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest, F.xxhash64(*docs.columns).cast("string"))
    keyed = docs.withColumn(key, named)
    fp = stage(fingerprints(keyed, words, key), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    best = rooted(fp, least.alias("least"), radius).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias(key + "_"))
    return keyed.join(best, F.col(key) == F.col(key + "_"), "left_semi").dropDuplicates([key]).drop(key)
