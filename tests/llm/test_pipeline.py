"""The pipeline's rows against a brute-force version of its stages."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_operators import brute_lines, least_of_groups, slow_fingerprint

from strandlog.llm import toxicity
from strandlog.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    vocabulary = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{k}" for k in range(1500)]
    line = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(8, 30)))
    shared, rows = [line() for _ in range(12)], []
    for k in range(260):
        lines = [line() for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        if k % 5 == 0:
            lines = [f"{x} vilething awfulness vilething" for x in lines]
        rows.append([k, "\n".join(lines), "en", rng.choice(["web", "books", None]) if k % 3 else "hot"])
    for k in range(260, 300):  # copies, whole and near
        t = rows[rng.randrange(1, 250)][1].split(" ")
        if k % 2:
            t[rng.randrange(len(t))] = "changed"
        rows.append([k, " ".join(t), "en", "hot"])
    rows += [[300, None, None, "web"], [301, "", "en", "books"], [302, "\n \n", "en", None]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def mixed(docs):
    """Copies of each doc_id of docs (doc_id, text, source)."""
    size = {d: len((t or "").split()) for d, t, _ in docs}
    by = defaultdict(list)
    for d, _, s in docs:
        by[s].append(d)
    n = {s: sum(size[d] for d in ds) for s, ds in by.items()}
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(n.values()), set(order), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * n[s]}:
        for s in over:
            target[s] = 2.0 * n[s]
        free -= over
        left = 1.5 * sum(n.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    copies = {}
    for s, ds in by.items():
        repeats, rest = divmod(round(target[s]), n[s])
        for d in sorted(ds, key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
            if size[d]:
                copies[d] = repeats + (rest > 0)
                rest -= size[d]
    return copies


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # toxicity: the stage's own score decides, and it finds what was planted
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = toxicity.score(docs, toxicity.fit(docs, labels), ("doc_id",)).collect()
    toxic = {r.doc_id for r in scores if r.predicted}
    marked = {r[0] for r in rows if r[1] and "vilething" in r[1]}
    assert toxic == marked
    left = [(d, t, s) for d, t, _, s, _ in rows if d not in toxic]
    # line dedup
    gone = brute_lines([(d, t) for d, t, _ in left])
    assert sum(map(len, gone.values())) > 20
    left = [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[r]), s) for r, (d, t, s) in enumerate(left)]
    # SimHash: the smallest doc_id of each component stays
    fps = {d: slow_fingerprint(t) for d, t, _ in left}
    root = least_of_groups(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert len(set(root.values())) < len(root)
    left = [x for x in left if root[x[0]] == x[0]]
    # mixing, then tokens
    copies, lib = mixed(left), Tokenizer.from_file(TOKENIZER)
    lib.no_truncation()
    lib.no_padding()
    want = Counter()
    for d, t, s in left:
        if copies.get(d):
            ids = lib.encode(t or "", add_special_tokens=False).ids
            decoded = lib.decode(ids, skip_special_tokens=False)
            want[(d, s, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += copies[d]
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({})
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
