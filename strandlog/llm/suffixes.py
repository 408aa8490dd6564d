"""Removal of byte strings that repeat anywhere in a corpus, by a sparse, distributed suffix array.

A string of `length` bytes is repeated if it also starts anywhere else. Sorting every
suffix of a corpus would move each byte some hundred times, so only suffixes that start at
*anchors* are sorted. The anchor of a window of `length` bytes is the start of the `gram`
bytes of least hash within it (the leftmost of equal ones). It depends on the window's bytes
alone, so two equal windows have equal anchors at equal places: nothing is lost. About two
in (length - gram + 2) places are anchors.

1. Each task finds its texts' anchors, and for each the run of windows that it anchors (the
   *stretch*). Anchors with equal grams and equal stretches prove each other repeated; in a
   task, they are settled at once and one of them goes on.
2. Anchors meet by their gram's hash. One that meets no other is dropped; equal stretches are
   settled; of the rest the bytes are looked up (their suffixes' leading bytes).
3. The looked-up suffixes are range-partitioned by their leading bytes with splitters that
   Spark samples; each bucket sorts its windows by a multikey quicksort, eight bytes a
   key, and compares neighbours. Equal grams are equal leading bytes, so no run of them
   crosses a bucket's boundary; runs that cross the boundaries of batches are carried on.
4. Settled windows are merged to spans and cut from the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import only_likely, released, stage

LENGTH, GRAM = 200, 32
#: Windows that are hashed at once, and windows that are sorted at once.
CHUNK, SORTED = 1 << 20, 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

ANCHOR = "meet long, kind int, gram long, stretch long, key binary, at int, low int, high int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(max(n, 1 << 16), base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima from the left and from the right of blocks of w."""
    n = len(v)
    pad = np.full(-(-n // w) * w, _MASK, np.uint64)
    pad[:n] = v
    grid = pad.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(at, low, high, gram hash, stretch hash) of a text's anchors: each anchors the windows that start from low to high.

    A very long text is gone through in chunks of windows; an anchor whose windows are cut
    by a chunk's end is listed once for each part.
    """
    n = len(data) - length + 1
    found = []
    for start in range(0, max(n, 0), CHUNK):
        count = min(CHUNK, n - start)
        b = np.frombuffer(data, np.uint8, count + length - 1, start).astype(np.uint64)
        with np.errstate(over="ignore"):
            up, down = _powers(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b + np.uint64(1)) * up[:-1], out=sums[1:])
            grams = _mixed((sums[gram:] - sums[: len(b) - gram + 1]) * down[: len(b) - gram + 1])
            places = np.arange(len(grams), dtype=np.uint64)
            least = _least(grams & np.uint64(0xFFFFFFFF00000000) | places, length - gram + 1)
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            high = np.r_[low[1:], len(at)] - 1
            at = at[low]
            stretch = (sums[high + length] - sums[low]) * down[low]
            # the place of the anchor in its stretch and the stretch's length are part of it
            stretch = _mixed(stretch ^ _mixed(((at - low) << 32 | high - low).astype(np.uint64)))
        found.append((at + start, low + start, high + start, grams[at].view(np.int64), stretch.view(np.int64)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _spans(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching or overlapping [low, high] ranges of equal key merged; key holds numbers."""
    if not len(key):
        return key, low, high
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(key * wide + high)
    first = np.r_[True, key[1:] * wide + low[1:] > reach[:-1] + 1]
    at = np.flatnonzero(first)
    return key[at], low[at], reach[np.r_[at[1:], len(key)] - 1] & (wide - 1)


def _batch(meet, kind, gram, stretch, keys, at, low, high) -> pa.RecordBatch:
    i32 = lambda a: pa.array(np.asarray(a, np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(meet), i32(kind), pa.array(gram), pa.array(stretch), pa.array(keys, pa.binary()), i32(at), i32(low), i32(high)],
        names=["meet", "kind", "gram", "stretch", "key", "at", "low", "high"],
    )


def _find(length: int, gram: int, most: int = 4 << 20):
    """kind 1: an anchor that has to meet others; kind 2: likewise, already known to be repeated; kind 0: settled windows (low to high)."""

    def settle(rows, keys):
        owner, at, low, high, g, s = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((owner, s, g))
        owner, at, low, high, g, s = (x[order] for x in (owner, at, low, high, g, s))
        new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        k, lo, hi = _spans(owner[many], low[many], high[many])
        some = np.array(keys, dtype=object)
        # settled windows are dealt out by their text
        to = np.array([int.from_bytes(keys[i][:8], "little", signed=True) for i in k.tolist()], np.int64)
        zero = np.zeros(len(k), np.int64)
        yield _batch(to, zero, to, zero, some[k].tolist(), zero, lo, hi)
        first = np.flatnonzero(new)
        yield _batch(g[first], 1 + many[first], g[first], s[first], some[owner[first]].tolist(), at[first], low[first], high[first])

    def run(batches):
        keys, seen, rows, total = [], set(), [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                key = hashlib.sha256(data).digest()
                if key in seen:
                    continue
                seen.add(key)
                at, low, high, g, s = anchors(data, length, gram)
                rows.append((np.full(len(at), len(keys)), at, low, high, g, s))
                keys.append(key)
                total += len(at)
                if total > most:
                    yield from settle(rows, keys)
                    keys, rows, total = [], [], 0
        if rows:
            yield from settle(rows, keys)

    return run


SETTLED = "key binary, kind int, gram long, at int, low int, high int"


def _meet(batches):
    """Rows in the order of (meet, kind 0 apart, stretch, key, at): kind 0 settled windows; kind 1 and 2 suffixes to look up (2: one whose windows are all settled)."""
    held: list[pa.RecordBatch] = []

    def settle(t: pa.Table):
        if not t.num_rows:
            return
        c = {n: t.column(n).to_numpy() for n in ("kind", "gram", "stretch", "at", "low", "high")}
        keys = t.column("key")
        codes = keys.combine_chunks().dictionary_encode()
        codes = (pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes)
        names, code = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
        ready = c["kind"] == 0
        out_key, out_low, out_high = [code[ready]], [c["low"][ready]], [c["high"][ready]]
        live = np.flatnonzero(~ready)
        # the same anchor of the same text, seen in copies that other tasks have read, is one
        order = live[np.lexsort((c["low"][live], c["at"][live], code[live], c["stretch"][live], c["gram"][live]))]
        g, s, k, at, low = (x[order] for x in (c["gram"], c["stretch"], code, c["at"], c["low"]))
        same = np.r_[False, (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (k[1:] == k[:-1]) & (at[1:] == at[:-1]) & (low[1:] == low[:-1])] if len(order) else np.empty(0, bool)
        known = np.maximum.reduceat(c["kind"][order], np.flatnonzero(~same)) if len(order) else np.empty(0, int)
        order = order[~same]
        if len(order):
            g, s = c["gram"][order], c["stretch"][order]
            new_s = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]
            group = np.cumsum(new_s) - 1
            many = (np.bincount(group)[group] > 1) | (np.maximum.reduceat(known, np.flatnonzero(new_s))[group] == 2)
            done = order[many]
            out_key.append(code[done]), out_low.append(c["low"][done]), out_high.append(c["high"][done])
            # a stretch that stands alone is looked up if its gram has others; of each other stretch one is
            new_g = np.r_[True, g[1:] != g[:-1]]
            gram_of = np.cumsum(new_g) - 1
            others = np.bincount(gram_of)[gram_of] > 1
            open_ = np.bincount(gram_of, weights=~many)[gram_of] > 0
            ask = np.flatnonzero(others & open_ & new_s)
            if len(ask):
                i = order[ask]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(code[i])), pa.array((1 + many[ask]).astype(np.int32)), *(pa.array(c[n][i]) for n in ("gram", "at", "low", "high"))],
                    names=["key", "kind", "gram", "at", "low", "high"],
                )
        k, lo, hi = _spans(*(np.concatenate(x).astype(np.int64) for x in (out_key, out_low, out_high)))
        zero = pa.array(np.zeros(len(k), np.int32))
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(k)), zero, pa.array(np.zeros(len(k), np.int64)), zero, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
            names=["key", "kind", "gram", "at", "low", "high"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < 100_000:
            continue
        t = pa.Table.from_batches(held)
        m = t.column("meet").to_numpy()
        cut = np.searchsorted(m, m[-1])  # the last run goes on in the next batch
        if cut:
            yield from settle(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield from settle(pa.Table.from_batches(held))


def _look_up(length: int):
    """The bytes of the stretches that a text is asked for."""

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for key, text, asks in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("asks").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for a in asks:
                    row = (data[a["at"] : a["at"] + 64], a["gram"], a["kind"], key, a["at"] - a["low"], a["low"], data[a["low"] : a["high"] + length])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lead", "gram", "kind", "key", "ahead", "low", "bytes"])

    return run


def equal_rows(words: np.ndarray, starts: np.ndarray, group: np.ndarray, n_words: int) -> np.ndarray:
    """Which of the strings words[start], words[start + 8], ... (n_words of eight bytes) have an equal one in their group.

    A multikey quicksort with keys of eight bytes: strings are sorted by group and first key;
    only those that are equal so far to a neighbour go on to the next key.
    """
    live = np.arange(len(starts))
    for k in range(n_words):
        key = words[starts[live] + 8 * k]
        order = np.lexsort((key, group))
        live, group, key = live[order], group[order], key[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])] if len(live) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1 if len(live) else new
        live, group = live[keep], group[keep]
        if not len(live):
            break
    out = np.zeros(len(starts), bool)
    out[live] = True
    return out


def _windows(length: int, gram: int):
    """Rows in the order of their leading bytes: sorts the windows of each run of equal grams and settles the repeated ones."""
    n_words = -(-length // 8)

    def compare(rows):
        """rows: (run, kind, key, ahead, low, bytes)."""
        data = b"".join(r[5] for r in rows)
        data += b"\0" * 8
        words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        size = np.array([len(r[5]) for r in rows])
        first = np.cumsum(size) - size
        count = size - length + 1
        owner = np.repeat(np.arange(len(rows)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ahead = np.array([r[3] for r in rows])
        run = np.array([r[0] for r in rows])
        # windows compare within a gram and a place of the anchor in the window
        place = ahead[owner] - within
        starts = first[owner] + within
        tail = length % 8  # the last key of a length that is no multiple of 8 overlaps the one before
        hit = np.zeros(len(starts), bool)
        lo_place, hi_place = (int(place.min()), int(place.max())) if len(place) else (0, -1)
        step = max(1, SORTED * (hi_place - lo_place + 1) // max(1, len(starts)))
        for p in range(lo_place, hi_place + 1, step):
            pick = np.flatnonzero((place >= p) & (place < p + step)) if step <= hi_place - lo_place else np.arange(len(starts))
            group = run[owner[pick]] * np.int64(1 << 20) + place[pick]
            same = equal_rows(words, starts[pick], group, length // 8)
            if tail:  # strings equal in all whole keys are few: the rest is compared in bytes
                few = pick[same]
                ends = [data[s : s + length] for s in starts[few].tolist()]
                seen: dict = {}
                for i, e in zip(few.tolist(), ends, strict=True):
                    seen.setdefault((int(run[owner[i]]), int(place[i]), e), []).append(i)
                same = np.zeros(len(pick), bool)
                hit[[i for v in seen.values() if len(v) > 1 for i in v]] = True
            else:
                hit[pick[same]] = True
        own = np.array([r[1] == 1 for r in rows])  # the others' windows are settled
        hit &= own[owner]
        low = np.array([r[4] for r in rows])
        k, lo, hi = _spans(owner[hit], low[owner[hit]] + within[hit], low[owner[hit]] + within[hit])
        return pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i in k.tolist()], pa.binary()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["key", "low", "high"])

    def run(batches):
        rows, now, number, started, size = [], None, 0, 0, 0
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("gram", "kind", "key", "ahead", "low", "bytes")]
            for g, *row in zip(*cols, strict=True):
                if g != now:
                    if size > SORTED:
                        yield compare(rows)
                        rows, size = [], 0
                    now, number, started = g, number + 1, len(rows)
                rows.append((number, *row))
                size += len(row[-1]) - length + 1
        if rows:
            yield compare(rows)

    return run


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, low, high): in the distinct text with SHA-256 key, the windows that start from low to high are repeated in other places."""
    found = docs.select("text").mapInArrow(released(_find(length, gram)), ANCHOR)
    met = found.repartition("meet").sortWithinPartitions("meet").mapInArrow(released(_meet), SETTLED)
    met = stage(met, "suffixes")
    asked = met.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("gram", "kind", "at", "low", "high")).alias("asks"))
    texts = _texts(docs, met.where("kind > 0").select("key"))
    bytes_ = texts.join(asked, "key").select("key", "text", "asks").mapInArrow(released(_look_up(length)), "lead binary, gram long, kind int, key binary, ahead int, low int, bytes binary")
    lead = F.substring("lead", 1, gram)
    sorted_ = bytes_.withColumn("lead", lead).repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram").drop("lead")
    more = stage(sorted_.mapInArrow(released(_windows(length, gram)), "key binary, low int, high int"), "suffixes-more")
    return met.where("kind = 0").select("key", "low", "high").unionByName(more)


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of the distinct texts whose key is in keys, and of few others."""
    keyed = docs.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    return only_likely(keyed, keys, "key").groupBy("key").agg(F.first("text").alias("text"))


def _cut(length: int):
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for low, high in sorted((s["low"], s["high"] + length) for s in spans):
                    if low > end:
                        n += 1
                        if end >= 0:
                            removed += end - begin
                        kept.append(data[max(at, 0) : low])
                        begin, end = low, high
                    else:
                        end = max(end, high)
                    at = end
                removed += end - begin
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((removed, n, hashlib.sha256(rest).hexdigest(), rest))
            a, c, d, e = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.binary())], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of docs (doc_id, text); with texts, kept (the bytes that are left) too.

    Texts are UTF-8 bytes (null: none). Each byte that a string of `length` bytes covers
    which also starts anywhere else, in the same text too, is removed; strings are judged on
    the input. A removal may cut a character. Rows that repeat a text remove all of it if it
    has `length` bytes. Shorter texts lose nothing. Null or repeated doc_ids are kept as they
    are. No rows give no rows. Other columns are ignored.

    Equal texts are one text throughout; only digests and anchors are shuffled, and the bytes
    of those texts alone that have an open or a settled window.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = repeated(rows, length, gram)
    slim = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("hex"), *([F.encode("text", "UTF-8").alias("whole")] if texts else []))
    copies = rows.where(F.octet_length("text") >= length).groupBy(F.sha2("text", 256).alias("hex"), F.octet_length("text").alias("_n")).count().where("count > 1")
    copied = copies.select(F.col("hex").alias("c_hex"), F.lit(True).alias("copied"))
    spans = found.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = spans.join(copied.select(F.unhex("c_hex").alias("key")), "key", "left_anti")
    spans = stage(spans, "suffix-spans")
    cut = _texts(rows, spans.select("key")).join(spans, "key").mapInArrow(released(_cut(length)), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut.select(F.lower(F.hex("key")).alias("k_hex"), "n_removed", "n_spans", F.col("kept_sha256").alias("k_sha"), *(["kept"] if texts else []))
    nothing = hashlib.sha256(b"").hexdigest()
    out = slim.join(copied, F.col("hex") == F.col("c_hex"), "left").join(cut, F.col("hex") == F.col("k_hex"), "left")
    all_ = F.coalesce("copied", F.lit(False))
    columns = [
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.lit(nothing)).otherwise(F.coalesce("k_sha", "hex")).alias("kept_sha256"),
    ]
    if texts:
        columns.append(F.when(all_, F.lit(b"")).otherwise(F.coalesce("kept", "whole")).alias("kept"))
    return out.select("doc_id", "n_bytes", *columns)
