"""The operators against brute force on small, awkward tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlog.llm import bpe, chat, components, egojoin, lines, mixing, simhash, suffixes, telephony, toxicity, warc
from strandlog.llm.queries import TOKENIZER


def docs_of(spark, rows):
    """rows (doc_id, text) with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("key", "size", "fp", "score", "node", "n", "low", "removed", "_text", "source"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(rng, n, letters="abcdé", most=5):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n))


def least_of_groups(nodes, linked):
    """Smallest reachable node by plain union-find."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least_of_groups({x for e in edges for x in e}, edges)
    in_link = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in in_link}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 WARC


def brute_warc(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000:
            groups[p].append(page)
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        ids = [x for x in groups.get(p, []) if x is not None]
        first = max(ids) if ids else None
        again = len(p) >= 1000 and first is not None and page != first
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_warc(spark):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "http://a", big), (5, "http://b\r\nc%", big), (3, None, big), (7, "u", other), (8, "u", other), (9, "u", None), (10, "u", ""), (None, "u", big), (5, "http://b\r\nc%", big), (11, "u", "y" * 200_000), (12, "u", "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("_digest", F.lit(2)).repartition(3)
    got = sorted((tuple(r) for r in warc.archived_pages(spark, df).collect()), key=repr)
    assert got == brute_warc(rows)
    assert warc.archived_pages(spark, df.limit(0)).count() == 0


def test_warc_source(spark, tmp_path):
    rows = [(k, f"http://h/{k}", ("p" if k % 3 else "same") * 500) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.archive(df, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    hit = back.where("record_type = 'response' and target_uri = 'http://h/4'")
    plan = hit._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"Filters: \[.*EqualTo.*target_uri|PushedFilters: \[.*target_uri", plan) and "Filter (" not in plan.split("===")[0], plan
    r = hit.collect()
    assert [bytes(x.payload).decode() for x in r] == [rows[4][2]]
    assert {x.target_uri for x in back.where("record_type in ('response', 'revisit')").collect()} == {u for _, u, _ in rows}
    assert all(x.payload is None for x in back.where("record_type = 'revisit'").collect())
    (tmp_path / "w" / "stray.warc.gz").write_bytes(b"left by a failed task")
    assert warc.read(spark, str(tmp_path / "w"), "record_id string").count() == back.count()  # only committed archives are read


def test_warc_plain_and_foreign_files(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    rec = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:4>", "Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "u"}, block)
    req = warc.record({"WARC-Type": "request", "WARC-Record-ID": "<urn:page:5>"}, b"z" * 100_000)
    (tmp_path / "a.warc").write_bytes(req + rec)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(req) + gzip.compress(rec))
    (tmp_path / "c.warc.gz").write_bytes(warc.gzip_member(req) + warc.gzip_member(rec))
    got = warc.read(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert [(bytes(r.payload), r.payload_bytes, r.payload_sha1) for r in got] == [(b"abc", 3, hashlib.sha1(b"abc").hexdigest())] * 3
    assert base64.b32encode(b"x") and zlib.decompress(warc.gzip_member(rec), 31) == rec


# --- 2 chat


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "cleo", None), (1, 3, "ann", "bye"), (2, 0, None, "solo"), (None, 5, "ann", "é"), (1, 3, "ann", "bye"), (1, None, "bob", "first")] + [(3, k, "ab"[k % 2], str(k)) for k in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("part", F.lit(9))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df, part_turns=3).collect()}
    want = defaultdict(list)
    for c, t, w, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")):
        want[(c, (t or 0) // 3)].append((w or "unknown", x or ""))
    seats = defaultdict(set)
    for (c, _), said in want.items():
        seats[c] |= {w for w, _ in said}
    assert set(got) == {(c, s, p) for c, p in want for s in seats[c]}
    for (c, s, p), r in got.items():
        # spans count from the dialogue's start, so that parts join to the whole
        text, mask = "".join(got[(c, s, q)].text for _, _, q in sorted(k for k in got if k[:2] == (c, s) and k[2] < p)), []
        start = len(text)
        for w, x in want[(c, p)]:
            head = "<|im_start|>assistant\n" if w == s else f"<|im_start|>user name={w}\n"
            if w == s:
                mask.append(f"{len(text) + len(head)}-{len(text) + len(head) + len(x) + 10}")
            text += f"{head}{x}<|im_end|>\n"
        assert (r.text, r["mask"], r.n_turns) == (text[start:], ",".join(mask), len(want[(c, p)]))
    assert chat.rotate(df.limit(0)).count() == 0


# --- 3 telephony


def slow_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def test_codecs():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    data = np.random.default_rng(1).integers(0, 256, 64 * 9).astype(np.uint8)
    assert telephony.adpcm_decode(data).tolist() == [v for k in range(9) for v in slow_adpcm(data[64 * k : 64 * k + 64].tobytes())]
    assert telephony.resample(np.array([0, 100, 200], np.int16)).tolist()[0::2] == [0, 100, 200]


def test_telephony(spark):
    rng = random.Random(2)
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (5, "é" * 32), (6, "x" * 65), (None, words(rng, 3000)), (7, "y" * 300_000)] + [(10 + k, words(rng, k)) for k in range(12)]
    got = telephony.read_back(telephony.store(docs_of(spark, rows)), pcm=True).collect()
    assert len(got) == len(rows)
    by_text = {}
    texts = dict(rows)
    tags = set()
    for r in got:
        n, payload = telephony.payload_of(texts[r.doc_id])
        tag = telephony.pick(payload)
        tags.add(tag)
        media = telephony.wave(tag, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        want = telephony.resample(telephony.decode(tag, np.frombuffer(payload, np.uint8)))
        assert np.frombuffer(bytes(r.pcm), "<i2").tolist() == want.tolist()
        assert by_text.setdefault(texts[r.doc_id] or "", r.feature) == r.feature
    assert tags == {telephony.MULAW, telephony.ALAW, telephony.ADPCM}
    assert telephony.read_back(telephony.store(docs_of(spark, rows).limit(0))).count() == 0


# --- 4 toxicity


def test_block_max_index_is_exact():
    rng = np.random.default_rng(4)
    x = (rng.random((700, 40)) < 0.1) * rng.random((700, 40))
    index = toxicity.Index.build([(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in x])
    for _ in range(50):
        q = (rng.random(40) < 0.2) * rng.random(40)
        but = int(rng.integers(-1, 700))
        ids, sims = index.nearest(np.flatnonzero(q), q[np.flatnonzero(q)], 15, but)
        full = x @ q
        if but >= 0:
            full[but] = -1
        want = [i for i in np.lexsort((np.arange(700), -np.round(full, 12))) if full[i] > 1e-15][:15]
        assert np.allclose(sims, full[want]) and len(ids) == len(want)


def test_isotonic():
    steps, level = toxicity.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert steps.tolist() == [1, 2, 4] and level.tolist() == [0, 0.5, 1]


def test_toxicity(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        t = words(rng, rng.randint(5, 60), "abcde", 4).split()
        if k % 4 == 0:
            for _ in range(rng.randint(2, 5)):
                t.insert(rng.randrange(len(t) + 1), rng.choice(["vilething", "Awfulness", "vilely"]))
        rows.append((k, " ".join(t)))
    rows += [(None, "vilething"), (1000, None), (1001, ""), (8, rows[8][1])]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(500)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, ("doc_id",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    fresh = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in fresh) >= 97
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}
    assert all(int(e.split(":")[0]) % 4 == 0 for r in fresh if r.predicted for e in r.evidence.split(",")[:1])
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0")), ("doc_id",)).collect()
    assert {r.score for r in none} == {0.0}
    keep = toxicity.score(docs, model)
    assert set(docs.columns) <= set(keep.columns)
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped), ("doc_id",)).collect()}
    assert all(other[r.doc_id] == r.score for r in got)


# --- 5 SimHash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(8)
    base = [words(rng, 60) for _ in range(8)]
    rows = [(k, rng.choice(base) if rng.random() < 0.3 else words(rng, rng.choice([0, 1, 2, 3, 40]))) for k in range(120)]
    for k in range(120, 260):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "zz"
        rows.append((k, " ".join(t).upper() if k % 2 else "  ".join(t)))
    rows += [(500, None), (501, " \t\x0b"), (None, base[0]), (3, rows[3][1]), (600, " "), (None, "quite alone in the world")]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    root = least_of_groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = Counter((d, f"{f:016x}", least.get(root[f])) for d, f in fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0
    kept = simhash.keep_one(docs_of(spark, rows))
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, _, c in want if c is not None}) and set(kept.columns) == set(docs_of(spark, rows).columns)


def test_compare_tiles():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a = np.unique(np.concatenate([a, a[:200] ^ np.uint64(1 << 5), a[:100] ^ np.uint64(0b111 << 40), a[:50] ^ np.uint64(0b1111)]))
    i, j = simhash.compare(a, None, 3, tile=64)
    full = [(int(x), int(y)) for k, x in enumerate(a) for y in a[k + 1 :][np.bitwise_count(a[k + 1 :] ^ x) <= 3]]
    assert least_of_groups(a.tolist(), full) == least_of_groups(a.tolist(), list(zip(i.tolist(), j.tolist())))


def test_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    fps = [k for k in range(64)] + [(1 << 40) + k * 15 for k in range(30)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df).collect()]
    want = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert least_of_groups(fps, got) == least_of_groups(fps, want) 


# --- 6 BPE


def test_bpe(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(9)
    letters = "abcdefgthinerABCÉÜßİΣςıéñ中文字कि́ัก0123456789½²'.,!?-_ \n\t<|> 　\x1c\x85😀ՐԱ́"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for k in range(300)]
    rows += [(k + 300, " ".join(rng.choice(["th", "in", "aaaa", "'s", "the", "<|endoftext|>", "<|startoftext|>x", "ABABAB", "unbelievable"]) for _ in range(20))) for k in range(60)]
    rows += [(500, None), (501, ""), (None, "null id"), (502, "word " * 50_000), (503, "a" * 3000), (1, rows[1][1])]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(docs_of(spark, rows), TOKENIZER, ("doc_id",)).collect())
    want = Counter()
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        dec = lib.decode(ids, skip_special_tokens=False)
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest(), tuple(ids))] += 1
    assert got == want
    assert bpe.encode(docs_of(spark, rows).limit(0), TOKENIZER).count() == 0


def test_automaton_against_merging():
    rng = random.Random(10)
    for _ in range(60):
        names, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(names), rng.choice(names)
            if a + b not in names:
                names.append(a + b)
                merges.append((a, b))
        ids = {n: i for i, n in enumerate(names)}
        auto = bpe.Automaton([0, 1, 2], [(ids[a], ids[b], ids[a + b]) for a, b in merges], len(names))
        for _ in range(30):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            seq = list(text)
            for a, b in merges:
                out = []
                for s in seq:
                    if out and out[-1] == a and s == b and not (len(out) and out[-1] == a + b):
                        out[-1] = a + b
                    else:
                        out.append(s)
                seq = out
            state = 0
            for s in seq:
                state = auto.step(state, ids[s])
                assert state >= 0
            # and no other tokenization is accepted
            def count(at, q):
                if at == len(text):
                    return 1
                return sum(count(at + len(n), to) for n in names if text.startswith(n, at) and (to := auto.step(q, ids[n])) >= 0)

            assert count(0, 0) == 1


# --- 7 lines


def brute_lines(rows):
    places = [((d is None, d or 0, i), r, i, frozenset(x.encode().lower().split())) for r, (d, t) in enumerate(rows) for i, x in enumerate((t or "").split("\n"))]
    gone = defaultdict(list)
    for p, r, i, s in places:
        if s and any(q < p and u and 5 * len(s & u) >= 4 * len(s | u) for q, _, _, u in places):
            gone[r].append(i)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    new = lambda: [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 10, 30, 80, 150, 300]))]
    pool, rows = [new() for _ in range(40)], []
    for k in range(90):
        out = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(pool)) if rng.random() < 0.7 else new()
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9, 20])):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(vocabulary).upper()
            out.append(" ".join(x))
        rows.append((k if rng.random() < 0.9 else None if rng.random() < 0.3 else k - 1, "\n".join(out)))
    rows += [(200, None), (201, ""), (rows[5][0], rows[5][1]), (202, "\n\n"), (203, "same\r\nsame")]
    gone = brute_lines(rows)
    want = Counter((d, len((t or "").split("\n")), ",".join(map(str, gone[r]))) for r, (d, t) in enumerate(rows))
    assert Counter((r.doc_id, r.n_lines, r.removed_lines) for r in lines.line_report(docs_of(spark, rows)).collect()) == want
    kept = Counter((r.doc_id, r.text) for r in lines.deduplicated(docs_of(spark, rows)).collect())
    assert kept == Counter((d, t if not gone[r] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[r])) for r, (d, t) in enumerate(rows))
    assert lines.line_report(docs_of(spark, rows).limit(0)).count() == 0


def test_later_rounds_deal_postings_of_similar_sizes(spark):
    n = np.arange(1, 5000)
    classes = lines._size_class(n)
    assert (np.diff(classes.astype(np.int64)) >= 0).all() and (classes == lines._size_class(n[::-1])[::-1]).all()
    for k in n[:900:7]:  # any size that can be similar is within the classes that are marked
        low, high = lines._size_class(np.array([-(-4 * k // 5), 5 * k // 4]))
        assert all(low <= c <= high for c in classes[-(-4 * k // 5) - 1 : 5 * k // 4])

    wanted = lines._bitmap(spark.createDataFrame([(7, 40), (-9, 5)], "token int, n int"))
    sizes = [1, 4, 5, 6, 20, 31, 32, 40, 50, 62, 400]
    sets = pa.RecordBatch.from_pydict(
        {"id": range(len(sizes)), "n": pa.array(sizes, pa.int32()), "f0": [0] * len(sizes), "f1": [0] * len(sizes), "prefix": pa.array([[7, None, -9, 8]] * len(sizes), pa.list_(pa.int32())),
         "probe": [False] * len(sizes), "last": [False] * len(sizes), "doc": range(len(sizes)), "line": pa.array([0] * len(sizes), pa.int32())}
    )
    dealt = [lines._read(blob.as_buffer()) for b in lines._deal(1, {}, wanted)([sets]) for blob in b.column("postings")]
    got = {(int(t), int(n)) for d in dealt for t, n in zip(d["token"].view(np.int32), d["n"], strict=True)}
    assert got == {(7, 32), (7, 40), (7, 50), (-9, 4), (-9, 5), (-9, 6)}


def test_lines_of_many_rounds(spark, monkeypatch):
    """Sketches that say nothing leave candidates that are not similar, so rounds follow; all joins shuffle, and while postings are dealt one table has prefixes."""
    rng, live, seen, common = random.Random(3), {}, [], [f"w{k}" for k in range(20)]
    rows = [(k, " ".join([f"rare{k % 10}", *rng.sample(common, 9)])) for k in range(60)]  # of ten words that have to share nine, all share their rarest
    rows += [(100 + k, "\n".join([f"rare{k}", rows[10 + k][1].replace(rows[10 + k][1].split()[-1], "other"), rows[50 + k][1] + " more"])) for k in range(10)]
    stage, unstage, described = lines.stage, lines.unstage, lines._described

    def staged(df, name):
        if name == "lines-candidates":
            seen.append(sorted(n for n, columns in live.values() if "prefix" in columns))
        out = stage(df, name)
        live[out._staged] = name, out.columns
        return out

    monkeypatch.setattr(lines, "stage", staged)
    monkeypatch.setattr(lines, "unstage", lambda df: (live.pop(df._staged), unstage(df)))
    monkeypatch.setattr(lines, "MORE", 4)

    def no_sketch(*a):
        out = described(*a)
        return [*out[:3], pa.array(np.zeros(len(out[0]), np.int64)), pa.array(np.zeros(len(out[0]), np.int64)), out[5]]

    monkeypatch.setattr(lines, "_described", no_sketch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.doc_id, r.removed_lines) for r in lines.line_report(docs_of(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    gone = brute_lines(rows)
    assert got == {(d, ",".join(map(str, gone[r]))) for r, (d, _) in enumerate(rows)}
    # the tables with sketches and prefixes that are on disk while postings are dealt
    assert len(seen) > 1 and seen == [["line-classes"]] * len(seen)


# --- 8 mixing


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(k, words(rng, rng.choice([0, 1, 5, 40])), rng.choice(["a", "b", "B", "é", None, ""]) if k % 3 else "hot") for k in range(400)] + [(7, "x y", "a"), (7, "x y", "a"), (None, "n n n", "b"), (500, None, "b"), (501, "z", "lonely")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    a = mixing.assign(df).collect()
    by = defaultdict(int)
    for d, t, s in rows:
        by[s] += len((t or "").split())
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(by.values()), set(order)
    share = {s: left * weight[s] / sum(weight.values()) for s in order}
    while over := {s for s in free if share[s] > 2 * by[s] + 1e-9}:
        free -= over
        for s in over:
            target[s] = 2.0 * by[s]
        rest = left - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    target |= {s: share[s] for s in free}
    taken = defaultdict(int)
    for r in a:
        assert r.size == len((r.text or "").split()) and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    # the sums are whole words; rows that repeat share their place and may differ by their size
    assert all(abs(taken[s] - target[s]) <= 3 for s in order) and len(a) == len(rows)
    e = mixing.emit(mixing.assign(df)).select("doc_id", "source", "copy_words", "position").collect()
    positions = [r.position for r in e]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert sum(r.copy_words for r in e) == sum(taken.values())
    first, last = Counter(), Counter()
    for r in e:
        (first if r.position < 0.5 else last)[r.source] += r.copy_words
    for k, s in enumerate(order):  # the schedule: sources of trend 2 are demanded later, those of trend 1/2 earlier
        if taken[s] > 300 and k % 3 < 2:
            assert (first[s] > last[s]) == (k % 3 == 0)
    assert mixing.mixed(df.limit(0)).count() == 0
    x, y = (sorted(map(repr, mixing.mixed(df.repartition(n)).collect())) for n in (2, 5))
    assert x == y


# --- 9 suffixes


def brute_suffixes(rows, n):
    seen = Counter(d[i : i + n] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - n + 1))
    out = Counter()
    for k, t in rows:
        d = (t or "").encode()
        hit = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        rest = bytes(c for c, x in zip(d, hit) if not x)
        spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(d)))
        out[(k, len(d), sum(hit), spans, hashlib.sha256(rest).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length, gram, seed", [(200, 32, 1), (50, 8, 2), (53, 10, 3)])
def test_suffixes(spark, length, gram, seed):
    rng = random.Random(seed)
    base, rows = [words(rng, length) for _ in range(6)], []
    for k in range(80):
        p = rng.random()
        if p < 0.2:
            t = rng.choice(base)
        elif p < 0.6:
            b = rng.choice(base)
            at = rng.randint(0, len(b))
            t = b[:at] + rng.choice(["X", "", words(rng, 20)]) + b[at + rng.randint(0, 3) :]
            if rng.random() < 0.5:
                t = words(rng, 30) + t[: rng.randint(length // 2, 3 * length)] + words(rng, 40) + t[rng.randint(0, length) :]
        elif p < 0.7:
            t = "a" * rng.randint(0, 3 * length) + words(rng, 10)
        elif p < 0.75:
            t = ("ab" * 2 * length)[: rng.randint(length - 50, 3 * length)]
        elif p < 0.85:
            t = words(rng, length)[: rng.randint(length - 5, length + 5)] * 2
        else:
            t = words(rng, rng.randint(0, 200))
        rows.append((k, t))
    rows += [(100, None), (101, ""), (None, base[0]), (3, rows[3][1])]
    got = suffixes.cut_repeats(docs_of(spark, rows), length, gram)
    assert Counter(tuple(r) for r in got.collect()) == brute_suffixes(rows, length)
    assert suffixes.cut_repeats(docs_of(spark, rows).limit(0), length, gram).count() == 0


def test_suffix_chunks(monkeypatch):
    rng = random.Random(4)
    data = words(rng, 2000).encode()
    whole = suffixes.anchors(data, 50, 8)
    monkeypatch.setattr(suffixes, "CHUNK", 333)
    parts = suffixes.anchors(data, 50, 8)
    spread = lambda a: [int(x) for x, lo, hi in zip(a[0], a[1], a[2]) for _ in range(lo, hi + 1)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == len(data) - 49
    assert set(whole[3].tolist()) == set(parts[3].tolist())


# --- 10 vectors


def brute_vectors(rows):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    pairs = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98]
    links, root = Counter(x for p in pairs for x in p), least_of_groups(range(len(rows)), pairs)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return Counter((i, links[k], least.get(root[k]), None if i is None else i == least.get(root[k])) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [8192, 5])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(egojoin, "TILE", tile)
    rng = np.random.default_rng(13)
    centres, rows = rng.normal(size=(12, 16)), []
    for k in range(220):
        v = centres[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.15, 2])
        rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 1e-3, 50])], int(k % 3) if k % 2 else 7))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0] * 15 + [float("nan")], 1), (303, [1.0] * 15 + [None], 1), (304, [], 1), (305, [1.0] * 16, None), (306, [float("inf")] + [0.0] * 15, 7), (307, [1.0, 2.0], 7), (308, [2.0, 4.0], 7)]
    rows += [(None, rows[5][1], rows[5][2]), (400, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("c0", F.lit(1)).repartition(3)
    assert Counter(tuple(r) for r in egojoin.near_vectors(df).collect()) == brute_vectors(rows)
    assert egojoin.near_vectors(df.limit(0)).count() == 0


def test_one_leading_dimension_is_enough(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0), (3, [-1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in egojoin.near_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


