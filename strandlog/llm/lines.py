"""Line de-duplication by an exact set-similarity join with rarity-ordered prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import add_counts, only_likely, packed_counts, released, stage, tidy, unstage

#: Jaccard similarity of token sets, as a fraction.
NUM, DEN = 4, 5
#: Token counts are kept by this many hash buckets; any order of tokens gives the same result, a good one gives it sooner.
BUCKETS = 1 << 20
#: Bytes of text that are split at once (a longer line is split by itself), and lines.
CHUNK, MOST_LINES = 1 << 18, (1 << 16) - 1
#: Postings that are dealt at once, that a bucket holds on average, and from which a token is dealt to cells of its own.
FLUSH, HELD, HOT = 300_000, 300_000, 50_000
#: Tokens that can be hot: those with over one in so many of all postings.
HOT_TOKENS = 4096
#: Bits of the bitmap of (token, size class) that selects the postings of later rounds; a size class is an eighth of what lies between two powers of two.
WANTED, CLASSES = 1 << 25, 8
#: Earlier sets that a set is verified against in the first round, and how many times more in each round after it.
WITNESSES, MORE = 1, 1024

LINES = "doc_id long, row_key long, line int, n int, s1 long, s2 long, f0 long, f1 long, prefix array<int>"
POSTING = [("token", "<u4"), ("n", "<u4"), ("i", "<u4"), ("id", "<u8"), ("doc", "<u8"), ("line", "<u4"), ("f0", "<u8"), ("f1", "<u8"), ("probe", "u1")]
WIDTH = sum(np.dtype(t).itemsize for _, t in POSTING)

#: Odd factors of the hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_U = np.uint64
#: The first k bytes of a little-endian load of 8.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def least_overlap(n, m):
    """Tokens that sets of n and m share at least if their similarity is NUM / DEN or more."""
    return -(-(NUM * (n + m)) // (NUM + DEN))


def prefix_length(n):
    """So many of a set's rarest tokens hold one that is also among those of any similar set."""
    return n - -(-NUM * n // DEN) + 1


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> _U(32)) * _U(by)
        return h ^ h >> _U(29)


def _hashes(y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words y[start:end]; y has 8 bytes more than its words.

    Words are read 8 bytes at a time: the first 8, and what follows of the longer ones.
    """
    at = np.ndarray(len(y) - 7, "<u8", y, 0, (1,))  # unaligned: the 8 bytes from each place on
    n = ends - starts
    with np.errstate(over="ignore"):
        a = at[starts] & _MASK[np.minimum(n, 8)]
        h, g = (_mix((a ^ n.astype(np.uint64) * _U(x)) * _U(y_) + _U(z), x) for x, y_, z in (_BASES, _BASES[::-1]))
        more, k = np.flatnonzero(n > 8), 8
        while len(more):
            a = at[starts[more] + k] & _MASK[np.minimum(n[more] - k, 8)]
            h[more], g[more] = _mix((h[more] ^ a) * _U(_BASES[0]) + _U(k), _BASES[1]), _mix((g[more] ^ a) * _U(_BASES[2]) + _U(k), _BASES[0])
            k += 8
            more = more[n[more] > k]
    return h, g


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a run of whole lines: owner (line of the run), a first and a second hash."""

    def __init__(self, raw: np.ndarray, first: np.ndarray):
        """first: the places in raw at which lines start."""
        y = np.zeros(len(raw) + 8, np.uint8)
        np.add(raw, (raw - np.uint8(65) < 26).view(np.uint8) << 5, out=y[: len(raw)])  # A-Z to a-z
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[first] = True
        edge = word[1:] & (~word[:-1] | fresh)
        starts = np.flatnonzero(edge)
        edge = word[:-1] & (~word[1:] | fresh)
        ends = np.flatnonzero(edge)
        # of lines of equal starts (empty ones) the last has the words
        self.owner = np.repeat(np.arange(len(first)), np.diff(np.r_[np.searchsorted(starts, first), len(starts)]))
        self.h, self.g = _hashes(y, starts, ends)


def runs(column: pa.Array):
    """(bytes, starts of lines, text and line number of each) of whole lines, CHUNK bytes or one line at a time."""
    raw, at = _texts(column)
    ends = np.flatnonzero(raw == 10)
    # a line starts at each text's start and after each line end, so a text of k line ends has k + 1 lines
    owner = np.r_[np.arange(len(at) - 1), np.searchsorted(at, ends, "right") - 1]
    starts = np.r_[at[:-1], ends + 1]
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    number = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
    k = 0
    while k < len(starts):
        m = min(max(k + 1, int(np.searchsorted(starts, starts[k] + CHUNK, "right")) - 1), k + MOST_LINES, len(starts))
        to = starts[m] if m < len(starts) else len(raw)
        yield raw[starts[k] : to], starts[k:m] - starts[k], owner[k:m], number[k:m]
        k = m


def rarity(docs: DataFrame) -> np.ndarray:
    """Levels of the occurrences of tokens over all of docs, by hash bucket: BUCKETS bytes, whatever the corpus.

    A level is 8 times the binary logarithm of one more than the count, 255 at most.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for raw, first, _, _ in runs(b.column(0)):
                np.add.at(total, (Words(raw, first).h % _U(BUCKETS)).astype(np.int64), 1)
        if total.any():
            yield from packed_counts(total)

    total = add_counts(docs.select("text").mapInArrow(released(count), "part int, counts binary"), BUCKETS)
    return np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)


#: The level of a token that is there once in all texts: no other set holds it.
ALONE = 8


def token_sets(raw: np.ndarray, first: np.ndarray, level: np.ndarray):
    """(lines with words, sizes of their token sets, the tokens' keys in the order of rarity, their second hashes), line after line."""
    w = Words(raw, first)
    # rarity, then hash: one order for all lines; the lowest bits give way to the level
    key = level[(w.h % _U(BUCKETS)).astype(np.int64)].astype(np.uint64) << _U(56) | w.h >> _U(8)
    order = np.argsort(key)
    order = order[np.argsort(w.owner[order].astype(np.uint16), kind="stable")]
    owner, key, other = w.owner[order], key[order], w.g[order]
    if len(owner):
        new = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (other[1:] != other[:-1])]
        owner, key, other = owner[new], key[new], other[new]
    which, sizes = np.unique(owner, return_counts=True)
    return which, sizes, key, other


def _described(which, sizes, key, other):
    """n, two 64-bit digests of each set (of independent hashes of its tokens), its 128-bit parity sketch and its prefix.

    Bit k of the sketch tells whether an odd number of tokens fall on k: sets that differ in d tokens differ in d bits at most.
    """
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        s1 = np.add.reduceat(_mix(key, _BASES[0]), first).view(np.int64)
        s2 = np.add.reduceat(_mix(other, _BASES[1]), first).view(np.int64)
    place = _mix(other, _BASES[0])
    bit, high = _U(1) << (place & _U(63)), (place >> _U(6) & _U(1)).astype(bool)
    f0, f1 = (np.bitwise_xor.reduceat(np.where(high == x, bit, _U(0)), first).view(np.int64) for x in (False, True))
    n = np.where(sizes >= NUM, prefix_length(sizes), 0)  # smaller sets are similar to equal ones alone
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    alone = key[at] >> _U(56) <= _U(ALONE)
    tokens = pa.array((key[at] & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), mask=alone)
    prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), tokens)
    return [pa.array(sizes.astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(f0), pa.array(f1), prefix]


def _listed(level: np.ndarray):
    """A row for each line with words."""

    def run(batches):
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("row_key")
            for raw, first, owner, number in runs(b.column("text")):
                which, sizes, key, other = token_sets(raw, first, level)
                if len(which):
                    rows = pa.array(owner[which])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), keys.take(rows), pa.array(number[which].astype(np.int32)), *_described(which, sizes, key, other)],
                        names=["doc_id", "row_key", "line", "n", "s1", "s2", "f0", "f1", "prefix"],
                    )

    return run


def _parts(count: int) -> int:
    return -(-count // HOT)


def _deal(buckets: int, hot: dict[int, tuple[int, int]], wanted: np.ndarray | None):
    """Postings (that wanted, a bitmap over WANTED hashes of tokens and size classes, has) as blobs by key: a bucket of tokens, or a cell of a hot one.

    The sets of a hot token are dealt to parts, and each pair of its parts is a cell: any two sets meet in one.
    """
    spots = np.array(sorted(hot), np.uint32)
    base = {t: (k, *hot[int(t)]) for k, t in enumerate(spots.tolist())}

    def blobs(part):
        cols = {c: np.concatenate([p[c] for p in part]) for c, _ in POSTING}
        key = (cols["token"] % np.uint32(buckets)).astype(np.int64)
        own = np.arange(len(key))
        if len(spots):
            is_hot = np.isin(cols["token"], spots)
            keys, owners = [key[~is_hot]], [own[~is_hot]]
            for t, (_, start, parts) in base.items():
                mine = own[is_hot & (cols["token"] == t)]
                if not len(mine):
                    continue
                part_ = (_mix(cols["id"][mine], _BASES[0]) % _U(parts)).astype(np.int64)
                for other in range(parts):
                    low, high = np.minimum(part_, other), np.maximum(part_, other)
                    keys.append(-1 - (start + low * parts + high))
                    owners.append(mine)
            key, own = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[cut[1:], len(key)]
        cols = {c: cols[c][own] for c in cols}
        packed = [b"".join(_planes(cols[c][a:b], t) for c, t in POSTING) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(packed, pa.binary())], names=["key", "postings"])

    def run(batches):
        part, size = [], 0
        for b in batches:
            prefix = b.column("prefix")
            lengths = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten()
            has = tokens.is_valid().to_numpy(zero_copy_only=False)
            token = tokens.fill_null(0).to_numpy().view(np.uint32)
            if wanted is not None:
                h = _spread(token, _size_class(np.repeat(b.column("n").to_numpy(), lengths)))
                has &= (wanted[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
            row = np.repeat(np.arange(len(lengths)), lengths)[has]
            i = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[has]
            if not len(row):
                continue
            take = lambda c: b.column(c).to_numpy(zero_copy_only=False)[row]  # noqa: B023, E731
            last = take("last").astype(bool)
            part.append({"token": token[has], "n": take("n").astype(np.uint32), "i": i.astype(np.uint32), "id": take("id").view(np.uint64), "doc": np.where(last, ~_U(0), take("doc").view(np.uint64) ^ _U(1 << 63)), "line": take("line").astype(np.uint32) | last.astype(np.uint32) << np.uint32(31), "f0": take("f0").view(np.uint64), "f1": take("f1").view(np.uint64), "probe": take("probe").astype(np.uint8)})
            size += len(row)
            if size >= FLUSH:
                yield blobs(part)
                part, size = [], 0
        if part:
            yield blobs(part)

    return run


def _size_class(n: np.ndarray) -> np.ndarray:
    """Grows with n, which is 1 at least, in exact arithmetic: the power of two below n, and which of its CLASSES equal parts n is in."""
    m, e = np.frexp(n.astype(np.float64))
    return (e * CLASSES + (m * 2 * CLASSES).astype(np.int64) - CLASSES).astype(np.uint64)


def _spread(token: np.ndarray, size_class: np.ndarray) -> np.ndarray:
    return (_mix(token.astype(np.uint64) | size_class << _U(32), _BASES[1]) & _U(WANTED - 1)).astype(np.int64)


def _planes(col: np.ndarray, kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(col.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes()


def _read(blob) -> dict[str, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    k, at, out = len(raw) // WIDTH, 0, {}
    for c, kind in POSTING:
        width = np.dtype(kind).itemsize
        out[c] = np.ascontiguousarray(raw[at : at + k * width].reshape(width, k).T).view(kind).ravel()
        at += k * width
    return out


def compare(t: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """x, y, dist and more: for each posting of a probe, up to `most` sets y of the same token and an earlier place that may be similar to x.

    Filters: sizes, the token's positions, parity sketches. more: the search was ended by `most`.
    """
    key = t["token"].astype(np.uint64) << _U(32) | t["n"].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    n, i = t["n"][order].astype(np.int64), t["i"][order].astype(np.int64)
    ids, doc, line, f0, f1 = (t[c][order] for c in ("id", "doc", "line", "f0", "f1"))
    token = key & ~_U(0xFFFFFFFF)
    low = np.searchsorted(key, token | (-(-NUM * n // DEN)).astype(np.uint64))
    high = np.searchsorted(key, token | (DEN * n // NUM).astype(np.uint64), "right")
    live = np.flatnonzero(t["probe"][order] & (high - low > 1))
    found, more = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    xs, ys, ds = [], [], []
    k = 0
    while len(live):
        k += 1
        for step in (-k, k):
            b = live + step
            ok = b >= low[live] if step < 0 else b < high[live]
            a, b = live[ok], b[ok]
            ok = (doc[b] < doc[a]) | (doc[b] == doc[a]) & (line[b] < line[a])
            a, b = a[ok], b[ok]
            need = least_overlap(n[a], n[b])
            d = np.bitwise_count(f0[a] ^ f0[b]).astype(np.int64) + np.bitwise_count(f1[a] ^ f1[b])
            ok = (d <= n[a] + n[b] - 2 * need) & (np.minimum(n[a] - i[a], n[b] - i[b]) >= need)
            a, b = a[ok], b[ok]
            if len(a):
                found[a] += 1
                xs.append(a), ys.append(b), ds.append(d[ok])
        full = found[live] >= most
        more[live[full]] = True
        live = live[~full & ((live - k > low[live]) | (live + k + 1 < high[live]))]
    if not xs:
        return {c: np.empty(0, kind) for c, kind in (("x", np.int64), ("y", np.int64), ("dist", np.int32), ("more", bool))}
    a, b, d = map(np.concatenate, (xs, ys, ds))
    return {"x": ids[a].view(np.int64), "y": ids[b].view(np.int64), "dist": d.astype(np.int32), "more": more[a]}


def _candidates(most: int):
    """Rows in the order of key: the postings of a key are held and compared."""

    def run(batches):
        now, held = None, []

        def flush():
            t = {c: np.concatenate([h[c] for h in held]) for c, _ in POSTING}
            got = compare(t, most)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in got.values()], names=list(got))

        for b in batches:
            for key, blob in zip(b.column("key").to_pylist(), b.column("postings"), strict=True):
                if key != now:
                    if held:
                        yield flush()
                    now, held = key, []
                held.append(_read(blob.as_buffer()))
        if held:
            yield flush()

    return run


def _words(line: bytes) -> frozenset[bytes]:
    return frozenset(line.lower().split())


def _verified(batches):
    """Pairs of whole lines: x, and whether the Jaccard similarity of their words is NUM / DEN or more and x is of a later place."""
    for b in batches:
        ok = []
        for p, q, later in zip(b.column("words").to_pylist(), b.column("other").to_pylist(), b.column("later").to_pylist(), strict=True):
            s, t = _words(p), _words(q)
            ok.append(later and DEN * len(s & t) >= NUM * len(s | t))
        yield pa.RecordBatch.from_arrays([b.column("x"), pa.array(ok, pa.bool_()), b.column("open")], names=["x", "ok", "open"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _place() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "line")


def _check(checks: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """checks (x, y, open) to (x, ok, open): the lines of x and y are looked up in their texts and compared in whole. Staged."""
    ids = checks.select(F.col("x").alias("k")).unionByName(checks.select(F.col("y").alias("k"))).distinct()
    asked = stage(only_likely(classes.select("id", "place", "row_key"), ids, "k", of="id").join(ids, F.col("id") == F.col("k")).select("id", "place", "row_key", F.xxhash64("row_key", "place.line").alias("at")), "lines-asked")
    each = keyed.select("row_key", F.posexplode(F.split("text", "\n", -1)).alias("number", "words"))
    each = only_likely(each.withColumn("at", F.xxhash64("row_key", "number")), asked, "at").select(F.col("row_key").alias("r"), "number", F.col("words").cast("binary").alias("words"))
    texts = each.join(asked, (F.col("r") == F.col("row_key")) & (F.col("number") == F.col("place.line"))).select("id", "place", "words").dropDuplicates(["id"])
    texts = stage(texts, "lines-texts")
    first = texts.select(F.col("id").alias("a"), F.col("place").alias("a_place"), "words")
    second = texts.select(F.col("id").alias("b"), F.col("place").alias("b_place"), F.col("words").alias("other"))
    both = checks.join(first, F.col("x") == F.col("a")).join(second, F.col("y") == F.col("b"))
    both = both.select("x", "open", "words", "other", (F.col("b_place") < F.col("a_place")).alias("later"))
    done = stage(both.mapInArrow(released(_verified), "x long, ok boolean, open boolean"), "lines-verified")
    unstage(asked), unstage(texts)
    return done


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """A bitmap of WANTED hashes of tokens (token int, n int: the size of a set that has it) and the size classes of the sets
    that may be similar: four megabytes, however many there are."""
    part = WANTED // 8 // 64

    def run(batches):
        bits = np.zeros(WANTED // 8, np.uint8)
        for b in batches:
            token, n = b.column(0).to_numpy().view(np.uint32), b.column(1).to_numpy().astype(np.int64)
            low, high = _size_class(-(-NUM * n // DEN)), _size_class(DEN * n // NUM)
            for k in range(int((high - low).max()) + 1 if len(n) else 0):
                h = _spread(token, np.minimum(low + _U(k), high))
                np.bitwise_or.at(bits, h >> 3, np.uint8(1) << (h & 7).astype(np.uint8))
        rows = bits.reshape(64, part)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["k", "bits"])

    def both(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(bits.as_buffer(), np.uint8)
                sums[k] = sums[k] | got if k in sums else got.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "bits"])

    out = np.zeros((64, part), np.uint8)
    with tidy(tokens.sparkSession):
        rows = tokens.mapInArrow(released(run), "k int, bits binary").repartition("k").mapInArrow(released(both), "k int, bits binary").collect()
    for k, bits in rows:
        out[k] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _often(classes: DataFrame) -> tuple[int, list]:
    """(number of postings, (token, postings) of those with over one in HOT_TOKENS of them and over HOT)."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            np.add.at(total, _bucket(b.column(0).flatten().drop_null().to_numpy()), 1)
        yield from packed_counts(total)

    counts = add_counts(classes.select("prefix").mapInArrow(released(count), "part int, counts binary"), BUCKETS)
    total = int(counts.sum())
    least = max(HOT, total // HOT_TOKENS)
    some = counts > least  # fewer than HOT_TOKENS buckets; most corpora have none
    if not some.any():
        return total, []

    def exact(batches):
        for b in batches:
            tokens = b.column(0).flatten().drop_null().to_numpy()
            tokens, n = np.unique(tokens[some[_bucket(tokens)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array(n, pa.int64())], names=["token", "n"])

    with tidy(classes.sparkSession):
        return total, classes.select("prefix").mapInArrow(released(exact), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint32) % np.uint32(BUCKETS)).astype(np.int64)


def _near(classes: DataFrame, keyed: DataFrame) -> list[DataFrame]:
    """Staged tables (x, ok, open) of the rounds; ok says that class x is similar to a class of an earlier place.

    A round looks, for each class that is still open, for a few classes of an earlier place that pass
    the filters, and verifies them. Filters rarely pass what is not similar, so nearly all
    classes are settled by the first round; the others go on with more candidates each, until
    every one of a class's candidates has been looked at.
    """
    total, often = _often(classes)
    hot, cells = {}, 0
    for token, n in sorted(often):
        hot[token & 0xFFFFFFFF] = (cells, _parts(n))
        cells += _parts(n) ** 2
    buckets = max(1, -(-total // HELD))
    rounds, most, probes, wanted = [], WITNESSES, classes.withColumn("probe", F.lit(True)), None
    while True:
        dealt = probes.select("id", "n", "f0", "f1", "prefix", "probe", "place.last", "place.doc", "place.line").mapInArrow(released(_deal(buckets, hot, wanted)), "key long, postings binary")
        pairs = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(released(_candidates(most)), "x long, y long, dist int, more boolean")
        if not rounds:
            checks = pairs.groupBy("x").agg(F.min_by("y", "dist").alias("y"), (F.max("more") | (F.min("y") != F.max("y"))).alias("open"))
        else:
            checks = pairs.groupBy("x", "y").agg(F.max("more").alias("open"))
        checks = stage(checks, "lines-candidates")
        rounds.append(_check(checks, classes, keyed))
        unstage(checks)
        rest = rounds[-1].groupBy("x").agg(F.max("ok").alias("ok"), F.max("open").alias("open")).where("open and not ok").select(F.col("x").alias("rest"))
        rest = stage(rest, "lines-open")
        if rest.isEmpty():
            return rounds
        most *= MORE
        # all classes are what is looked for, and the open ones come once more as probes: a class never meets itself, as its place is its own
        again = only_likely(classes, rest, "rest", of="id").join(rest, F.col("id") == F.col("rest")).drop("rest")
        wanted = _bitmap(again.select(F.explode("prefix").alias("token"), "n").where("token is not null"))
        probes = classes.withColumn("probe", F.lit(False)).unionByName(again.withColumn("probe", F.lit(True)))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, removed (line numbers from 0, sorted) and n_near (those that equal no earlier line), of the rows of docs with removed lines.

    row_key is xxhash64(doc_id, text). See `deduplicated` for what is removed.
    """
    keyed = _keyed(docs)
    lines = stage(keyed.mapInArrow(released(_listed(rarity(keyed))), LINES), "lines")
    place = _place()
    classes = lines.groupBy("s1", "s2", "n").agg(
        F.min(F.struct(place.alias("place"), "row_key")).alias("f"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("f0", "f1", "prefix"))
    )
    classes = classes.select("s1", "s2", "n", "f.place", "f.row_key", "copies", "f0", "f1", "prefix")
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")
    described, lines = lines, stage(lines.select("doc_id", "row_key", "line", "n", "s1", "s2"), "lines-placed")
    unstage(described)  # sketches and prefixes are the classes' from here on
    near = None
    for done in _near(classes, keyed):
        ok = done.where("ok").select(F.col("x").alias("n_id"))
        near = ok if near is None else near.unionByName(ok)
    near, slim = near.distinct(), classes.select("id", "s1", "s2", "n", "place", "copies")
    fate = only_likely(slim, near, "n_id", of="id").join(near, F.col("id") == F.col("n_id")).drop("n_id").withColumn("near", F.lit(True))
    fate = fate.unionByName(slim.where("copies > 1").withColumn("near", F.lit(False)))
    fate = fate.groupBy(F.col("s1").alias("a"), F.col("s2").alias("b"), F.col("n").alias("c")).agg(F.min("place").alias("first"), F.max("near").alias("near"))
    fate = stage(fate, "line-fates")
    unstage(classes)
    each = only_likely(lines.select("doc_id", "row_key", "line", "n", "s1", "s2", place.alias("place")), fate.select(F.col("a").alias("s1")), "s1")
    each = each.join(fate, (F.col("s1") == F.col("a")) & (F.col("s2") == F.col("b")) & (F.col("n") == F.col("c")))
    gone = each.where("near or place > first")
    gone = gone.groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_set("line")).alias("removed"), F.count_distinct(F.when(F.col("place") <= F.col("first"), F.col("line"))).alias("n_near")
    )
    gone = stage(gone, "line-removals")
    unstage(lines), unstage(fate)
    return gone


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with their text (and n_chars, if there is one) without the lines that match an earlier one, and removed (their numbers, from 0).

    A text's lines are what \\n separates. A line's tokens are the set of its words (ASCII white
    space between them, A-Z lower-cased); two lines match if the sets' Jaccard similarity is
    0.8 or more. A line is removed if any line of an earlier place matches it, removed itself or
    not; places are ordered by doc_id (null last), then line number. Lines of equal place (of
    rows that repeat a doc_id) do not remove each other. Lines without words never match and
    stay. A null text stays null; a text may become empty. Texts and lines may be of any length:
    a task holds an Arrow batch and CHUNK bytes, or one line, of it. No rows give no rows. Rows
    stay, and so do their other columns, but `removed` and n_near are replaced.

    Token counts over all texts, by hash bucket, give the order of rarity. Equal sets are one
    class (pre-aggregated; equal are sets of equal size and two equal digests of 64 bits, of
    independent hashes). A class meets others by its rarest tokens (prefix filter; a token that
    all texts hold once meets none); pairs pass by length, by position and by a parity sketch.
    Of those, a class is verified, in whole lines, against one and, as long as that fails,
    against more of an earlier place.
    """
    docs = docs.drop(*[c for c in ("removed", "n_near") if c in docs.columns])
    gone = removals(docs).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "removed", "n_near")
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    out = keyed.join(gone, (F.col("_row") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(removed, i)), '\\n')")
    out = out.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.drop("_row", "_id", "_key")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near and removed_lines (numbers from 0, comma-separated), one row for each row of docs."""
    gone = removals(docs).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "removed", "n_near")
    slim = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = slim.join(gone, (F.col("_row") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"),
    )
