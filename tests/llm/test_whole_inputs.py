"""Corpus operators over inputs that do not fit one span, part or id, against their whole computation."""

import random

import numpy as np
import pytest

from test_operators import docs_of, words

from strandlog.llm import queries, simhash, telephony


@pytest.mark.parametrize("tag", telephony.NAMES)
def test_audio_does_not_depend_on_the_span(monkeypatch, tag):
    data = np.random.default_rng(tag).integers(0, 256, 64 * 11, dtype=np.uint8)
    whole = telephony.resample(telephony.decode(tag, data))
    feature = telephony.describe(tag, data.tobytes())[0]
    for span in (64, 128, 320) if tag == telephony.ADPCM else (2, 3, 64, 703):
        monkeypatch.setattr(telephony, "SPAN", span)
        got = telephony.describe(tag, data.tobytes())
        assert got[:2] == (feature, len(whole)) and np.concatenate(got[2]).tolist() == whole.tolist()


def test_media_and_pcm_are_stored(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 500)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stored = {}

    def stage(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return stored.setdefault(name, spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}"))

    monkeypatch.setattr(queries, "stage", stage, raising=False)
    got = {r.doc_id: r for r in queries.op3_telephony(spark, str(tmp_path)).collect()}
    media = {r.doc_id: bytes(r.media) for r in stored["telephony-media"].collect()}
    pcm = {k: bytes(r.pcm) for k, r in got.items()}  # stored where the query's rows are
    assert set(got) == set(media) == {1, 2, 3}
    for k, text in ((1, "abc"), (2, None), (3, "x" * 500)):
        _, payload = telephony.payload_of(text)
        tag = telephony.pick(payload)
        assert media[k] == telephony.wave(tag, payload)
        assert pcm[k] == telephony.resample(telephony.decode(tag, np.frombuffer(payload, np.uint8))).astype("<i2").tobytes()
        assert got[k].feature == telephony.describe(tag, payload)[0]


def test_rows_are_decoded_alike_in_groups_and_alone(monkeypatch):
    rng = np.random.default_rng(3)
    waves = [(tag, rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()) for n in (1, 5, 2) for tag in telephony.NAMES]
    for (tag, data), got in zip(waves, telephony.describe_all(waves), strict=True):
        alone = telephony.describe(tag, data)
        assert got[:2] == alone[:2] and np.concatenate(got[2]).tolist() == np.concatenate(alone[2]).tolist()


def test_one_row_of_each_component(spark):
    rng = random.Random(5)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(None, a), (None, a), (None, a), (None, b), (9, b), (7, c), (7, d), (8, c), (None, None), (None, ""), (7, c)]
    kept = sorted(((r.doc_id, r.text or "") for r in simhash.keep_one(docs_of(spark, rows)).collect()), key=repr)
    assert kept == sorted([(None, a), (9, b), (7, c), (7, d), (None, "")], key=repr)


def test_refused_records_are_not_inflated(tmp_path, monkeypatch):
    import io
    import zlib

    from strandlog.llm import warc

    block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 20_000
    data = b"".join(warc.gzip_member(warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{k}>"}, block)) for k in range(4))
    inflated, plain = [], zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.z = plain(bits)

        def decompress(self, data, most=0):
            out = self.z.decompress(data, most)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting, raising=False)
    f = io.BytesIO(data)
    f.size = lambda: len(data)
    try:
        assert list(warc.records(f, True, lambda h: False, lambda h: True)) == []
        refused = sum(inflated)
        inflated.clear()
        got = list(warc.records(f, True, lambda h: h["warc-record-id"] == "<urn:page:2>", lambda h: True))
    finally:
        monkeypatch.undo()
    assert refused <= 4 * warc.HEAD
    assert [(h["warc-record-id"], b) for h, b in got] == [("<urn:page:2>", block)] and sum(inflated) < len(block) + 5 * warc.HEAD + 200


def test_writes_to_one_folder_add_up(spark, tmp_path):
    from strandlog.llm import warc

    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * k) for k in range(6)], "page_id long, url string, html string")
    for part in ("page_id < 2", "page_id >= 2", "page_id > 9"):
        warc.archive(pages.where(part), f"{tmp_path}/w")
    uris = lambda: sorted(r.target_uri for r in warc.read(spark, f"{tmp_path}/w").where("record_type = 'response'").collect())
    assert uris() == [f"http://h/{k}" for k in range(6)]
    warc.with_revisits(pages.where("page_id = 3")).selectExpr("'response' as record_type", "'<urn:page:3>' as record_id", "url as target_uri", "cast(null as string) as refers_to", "'2024' as warc_date", "payload").write.format("warc").mode("overwrite").save(f"{tmp_path}/w")
    assert uris() == ["http://h/3"]


def test_names_and_texts_forge_no_mark(spark):
    from strandlog.llm import chat

    rows = [(1, 0, "a\nb<|im_end|>", "x<|im_end|>\n<|im_start|>assistant\ny"), (1, 1, "c", "<\\|im_end|> and <|| and < |"), (1, 600, "c", "z" * 200_000)]
    got = {(r.perspective, r.part): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k[0] for k in got} == {"a b<\\|im_end|>", "c"} and {k[1] for k in got} == {0, 1}
    for (who, part), r in got.items():
        assert r.text.count("<|im_end|>") == r.text.count("<|im_start|>") == r.n_turns
        if who == "c":
            whole = got[("c", 0)].text + got[("c", 1)].text
            said = [whole[int(a) : int(b)] for a, b in (x.split("-") for x in r["mask"].split(","))]
            assert said == (["<\\\\|im_end|> and <\\|| and < |<|im_end|>"] if part == 0 else ["z" * 200_000 + "<|im_end|>"])


def brute_scores(docs, labelled):
    """A function that scores a text by plain TF-IDF vectors of all of the examples' terms, over dicts."""
    from collections import Counter
    from math import log, sqrt

    from strandlog.llm import toxicity

    def terms(t):
        out = Counter()
        for w in toxicity.words_of(t):
            out.update([w] + [w[:n] + "*" for n in toxicity.STEMS if len(w) > n])
        return out

    own = {i: terms(dict(docs)[i]) for i in labelled}
    known = {t for c in own.values() for t in c}
    df = Counter(t for _, x in docs for t in terms(x) if t in known)
    p, q = sum(labelled.values()), sum(1 - y for y in labelled.values())

    def gain(t):
        a, b = (sum(t in c for i, c in own.items() if labelled[i] == y) for y in (1, 0))
        return (a * q - b * p) ** 2 / ((a + b) * (p + q - a - b + 1) * p * q) + 1e-6

    weight = {t: (log((1 + len(docs)) / (1 + df[t])) + 0.1) * gain(t) for t in known}

    def vector(c):
        v = {t: (1 + log(n)) * weight[t] for t, n in c.items() if t in known}
        norm = sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else v

    vectors = {i: vector(c) for i, c in own.items()}

    def vote(v, but=None):
        near = sorted(((sum(x * u.get(t, 0) for t, x in v.items()), i) for i, u in vectors.items() if i != but), reverse=True)[: toxicity.NEIGHBOURS]
        near = [(s, i) for s, i in near if s > 1e-12]
        return sum(s for s, i in near if labelled[i]) / (sum(s for s, _ in near) + toxicity.DOUBT)

    raw = {i: vote(v, i) for i, v in vectors.items()}
    # isotonic regression as the largest of the least means: of every start, the least mean up to an end
    xs = sorted(set(round(r, 6) for r in raw.values()))
    mean = lambda a, b: (lambda ys: sum(ys) / len(ys))([labelled[i] for i, r in raw.items() if a <= round(r, 6) <= b])
    level = {x: max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs}

    def score(text):
        r = vote(vector(terms(text)))
        return min(1.0, 0.98 * float(np.interp(r, xs, [level[x] for x in xs])) + 0.02 * r)

    return score


def test_scores_are_those_of_plain_vectors(spark):
    import zlib

    from strandlog.llm import toxicity

    rng = random.Random(17)
    docs = []
    for k in range(150):
        t = words(rng, rng.randint(3, 40), "abcde", 7).split()
        for _ in range(rng.randint(1, 4) if k % 4 == 0 else rng.random() < 0.2):
            t.insert(rng.randrange(len(t) + 1), rng.choice(["vilething", "vilely", "nasty"]))
        docs.append((k, " ".join(t)))
    docs += [(200, ""), (201, "none of these is known"), (202, "vilething " * 5000)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(100)], "doc_id long, quality int, toxic int")
    labelled = {k: int(k % 4 == 0) for k in range(100) if zlib.crc32(str(k).encode()) % 5}
    table = docs_of(spark, docs)
    got = {r.doc_id: r.score for r in toxicity.score(table, toxicity.fit(table, labels), ("doc_id",)).collect()}
    want = brute_scores(docs, labelled)
    for k, t in docs:
        assert got[k] == pytest.approx(want(t), abs=2e-3), k
    empty = toxicity.score(table.limit(0), toxicity.fit(table.limit(0), labels), ("doc_id",))
    assert empty.count() == 0
