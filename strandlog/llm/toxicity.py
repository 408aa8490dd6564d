"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import add_counts, packed_counts, released, spare, stage, tidy, unstage

#: Labelled rows that become examples, of each label at most: they bound the index and what the driver holds.
#: Counts of labels, document frequencies and the scoring cover all rows.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 600, 1200
NEIGHBOURS = 15
#: Similarity that counts as evidence of nothing in a vote.
DOUBT = 0.5
BLOCK = 64
FOLDS = 5
STEMS = (4, 6)
#: Terms that over one in so many examples have are kept as rows of a matrix.
DENSE = 16
#: Texts whose products with that matrix are made at once.
TOGETHER = 64

_WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """A word and its stems (first letters, marked by a star), as inflected forms share them."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def counted(text: str | None) -> Counter:
    """Number of occurrences of each term of a text."""
    out: Counter[str] = Counter()
    for w, n in Counter(words_of(text)).items():
        for f in features(w):
            out[f] += n
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the integers of all ranges, one range after the other; the number of the range of each)."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + np.repeat(starts - (np.cumsum(n) - n), n), owner


class Index:
    """Inverted lists by term (examples and their weights), cut into blocks of examples, with each cut's largest weight.

    Terms of many examples are rows of a matrix instead, whose cuts are slices.
    """

    def __init__(self, examples: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int):
        """One entry of each array for each term of each example."""
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        often = np.bincount(terms, minlength=n_terms) * DENSE > max(n, DENSE)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        width = self.blocks * BLOCK
        self.matrix = np.zeros((int(often.sum()), width), np.float32)
        dense = often[terms]
        self.matrix[self.row[terms[dense]], examples[dense]] = weights[dense]
        self.matrix_tops = self.matrix.reshape(len(self.matrix), self.blocks, BLOCK).max(2) if len(self.matrix) else np.zeros((0, self.blocks), np.float32)
        e, t, w = examples[~dense], terms[~dense], weights[~dense].astype(np.float32)
        order = np.lexsort((e, t))
        e, t, w = e[order], t[order], w[order]
        self.example, self.weight = e.astype(np.int32), w
        key = t.astype(np.int64) * self.blocks + e // BLOCK
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.cut = np.r_[cut, len(key)].astype(np.int32)
        self.cut_block = (key[cut] % self.blocks).astype(np.int32)
        self.cut_top = np.maximum.reduceat(w, cut) if len(cut) else w
        self.first = np.searchsorted(key[cut] // self.blocks, np.arange(n_terms + 1)).astype(np.int32)

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """Of the examples' vectors (terms, weights)."""
        owner = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        return cls(owner, terms, weights, len(vectors), int(terms.max(initial=-1)) + 1)

    def dense(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """What the matrix rows add to the products of queries (terms, weights) with each example, and to the bounds of each block."""
        q = np.zeros((len(queries), len(self.matrix)), np.float32)
        for k, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            q[k, row[row >= 0]] = weights[row >= 0]
        return q @ self.matrix, q @ self.matrix_tops

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1, dense: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest dot product over 0 (ties: the lower number) but one, and these products: exact, in single precision.

        A block's bound is the sum of its terms' largest weights times the query's. The blocks
        of the largest bounds are evaluated first, then those whose bound reaches the k-th best.
        dense: the query's rows of dense(), if they are at hand.
        """
        known, bound = dense or (x[0] for x in self.dense([(terms, weights)]))
        sparse = self.row[terms] < 0
        terms, weights = terms[sparse], weights[sparse].astype(np.float32)
        cuts, owner = _ranges(self.first[terms], self.first[terms + 1])
        blocks, pull = self.cut_block[cuts], weights[owner]
        bound = bound + np.bincount(blocks, self.cut_top[cuts] * pull, self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        ids, sims = np.empty(0, np.int64), np.empty(0)
        for at, to in ((0, 4), (4, len(order))):
            chosen = order[at:to]
            if len(ids) >= k:
                chosen = chosen[bound[chosen] >= sims.min() - 1e-5]  # more than the products' rounding
            if not len(chosen):
                continue
            inside = np.zeros(self.blocks, bool)
            inside[chosen] = True
            mine = inside[blocks]
            c = cuts[mine]
            i, which = _ranges(self.cut[c], self.cut[c + 1])
            score = known + np.bincount(self.example[i], self.weight[i] * pull[mine][which], self.blocks * BLOCK)
            cols = (np.sort(chosen)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = score[cols]
            got = score > 0
            if but >= 0:
                got &= cols != but
            ids, sims = np.concatenate([ids, cols[got]]), np.concatenate([sims, score[got]])
            if len(ids) > k:
                least = -np.partition(-sims, k - 1)[k - 1]
                ids, sims = ids[sims >= least], sims[sims >= least]
                keep = np.lexsort((ids, -sims))[:k]
                ids, sims = ids[keep], sims[keep]
        order = np.lexsort((ids, -sims))
        return ids[order], sims[order]


@dataclass
class Model:
    """terms: all of the examples', in the order of their numbers; gain: what a term's TF-IDF weight is multiplied by."""

    terms: list[str]
    gain: np.ndarray
    labels: np.ndarray
    ids: list[int | None]
    index: Index | None = None
    idf: np.ndarray | None = None
    steps: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def __post_init__(self):
        self.number = {t: i for i, t in enumerate(self.terms) if t[-1] != "*"}
        self.stems = [{t[:-1]: i for i, t in enumerate(self.terms) if t[-1] == "*" and len(t) == n + 1} for n in STEMS]

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k not in ("terms", "number", "stems")}
        return state | {"joined": "\n".join(self.terms)}

    def __setstate__(self, state):
        joined = state.pop("joined")
        self.__dict__.update(state)
        self.terms = joined.split("\n")
        self.__post_init__()

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's terms that any example has, ascending, and how often it has each."""
        counts = Counter(words_of(text))
        rows = [[self.number.get(w, -1) for w in counts]]
        rows += [[stems.get(w[:n], -1) if len(w) > n else -1 for w in counts] for n, stems in zip(STEMS, self.stems, strict=True)]
        terms = np.array(rows).ravel()
        known = terms >= 0
        if not known.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n = np.tile(np.fromiter(counts.values(), np.int64, len(counts)), len(rows))[known]
        terms = terms[known]
        order = np.argsort(terms, kind="stable")
        terms, n = terms[order], n[order]
        cut = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        return terms[cut], np.add.reduceat(n, cut)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit weights: (1 + ln count) times inverse document frequency times gain."""
        w = (1 + np.log(counts)) * self.idf[terms] * self.gain[terms]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm > 0 else w

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None):
        """For each query (terms, weights): toxic neighbours' similarity over that of all and of doubt, the neighbours and their similarities."""
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            for k, (q, known, bound) in enumerate(zip(some, *self.index.dense(some), strict=True), at):
                ids, sims = self.index.nearest(*q, NEIGHBOURS, -1 if but is None else but[k], (known, bound))
                yield float((sims * self.labels[ids]).sum() / (sims.sum() + DOUBT)), ids, sims

    def learn(self, n_docs: int, frequency: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, odds: float):
        """Weights, the index and the calibration, of the examples' terms (owner: the example of each) and of document frequencies."""
        self.idf = np.log((1 + n_docs) / (1 + frequency)) + 0.1
        n = len(self.labels)
        starts = np.searchsorted(owner, np.arange(n + 1))
        own = [(terms[a:b], self.vector(terms[a:b], counts[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        weights = np.concatenate([w for _, w in own]) if own else np.empty(0)
        # examples of like heaviest terms share blocks, which makes the bounds tight
        lead = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in own])
        order = np.lexsort((lead, self.labels))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.labels, self.ids = self.labels[order], [self.ids[i] for i in order.tolist()]
        self.index = Index(place[owner], terms, weights, n, len(self.terms))
        raw = np.array([v for v, _, _ in self.votes([own[i] for i in order.tolist()], list(range(n)))])
        # each label weighs as it does among all labelled rows, whatever the sample's shares
        toxic = self.labels == 1
        steps, levels = isotonic(raw, self.labels, np.where(toxic, odds * (~toxic).sum() / max(1, toxic.sum()), 1.0))
        # level from the first to the last vote of each pool, and straight lines between them
        order = np.sort(raw)
        last = order[np.searchsorted(order, np.r_[steps[1:], np.inf]) - 1]
        self.steps, self.levels = np.c_[steps, last].ravel(), np.repeat(levels, 2)

    def scores(self, texts: list[str | None]):
        """(score, evidence) of each text: the calibrated vote, and the three nearest examples as doc_id:label:similarity."""
        read = [self.read(t) for t in texts]
        for raw, ids, sims in self.votes([(terms, self.vector(terms, counts)) for terms, counts in read]):
            share = np.interp(raw, self.steps, self.levels)
            evidence = ",".join(f"{self.ids[i]}:{int(self.labels[i])}:{s:.4f}" for i, s in zip(ids[:3].tolist(), sims[:3].tolist(), strict=True))
            yield min(1.0, 0.98 * float(share) + 0.02 * raw), evidence


def gains(owner: np.ndarray, terms: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """How far each term tells the labels apart: the chi-square of having it, over the number of examples. No term has none."""
    toxic = labels == 1
    a = np.bincount(terms[toxic[owner]], minlength=n_terms).astype(float)
    b = np.bincount(terms[~toxic[owner]], minlength=n_terms).astype(float)
    p, q, seen = toxic.sum(), (~toxic).sum(), a + b
    off = a * q - b * p
    return off * off / (seen * (p + q - seen + 1) * p * q) + 1e-6


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, levels) of the weighted isotonic regression of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * c
            pools[-1][2] += c
        else:
            pools.append([a, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is of the fold that no label is learnt from: crc32 of its doc_id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """A bounded sample of the labelled rows outside the held-out fold (doc_id, text, toxic), and toxic rows per clean one among all of them."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = dict(rows.groupBy(F.col("toxic") > 0).count().collect())
    picked = [
        rows.where(cond).select("doc_id", F.lit(y).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for y, cond, most in ((1, "toxic > 0", TOXIC_EXAMPLES), (0, "toxic <= 0", CLEAN_EXAMPLES))
    ]
    chosen = picked[0].unionByName(picked[1])  # at most TOXIC_EXAMPLES + CLEAN_EXAMPLES rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found, n.get(True, 0) / max(1, n.get(False, 0))


def _terms(batches):
    """doc_id, toxic and the terms of each example with their counts."""
    for b in batches:
        got = [counted(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.string()), b.column("toxic"), pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))],
            names=["doc_id", "toxic", "terms", "counts"],
        )


def _flat(column) -> tuple[pa.Array, np.ndarray]:
    """(values of a list column, the row of each)."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The index, from a bounded sample of labelled rows; document frequencies are counted over all of docs. None without examples of both labels.

    The vocabulary is every term of the examples. What the driver holds is the examples' terms
    and one number a term; the counting of documents is merged in the executors, by slices.
    """
    sample, odds = examples(docs, labels)
    kept = stage(sample.mapInArrow(released(_terms), "doc_id string, toxic int, terms array<string>, counts array<bigint>"), "toxicity-examples")
    rows = kept.toArrow().sort_by("doc_id")
    unstage(kept)
    y = rows.column("toxic").to_numpy().astype(float)
    if not (y == 1).any() or not (y == 0).any():
        return None
    flat, owner = _flat(rows.column("terms"))
    coded = flat.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    counts = _flat(rows.column("counts"))[0].to_numpy()
    order = np.lexsort((numbers, owner))
    owner, numbers, counts = owner[order], numbers[order], counts[order]
    terms = coded.dictionary.to_pylist()
    model = Model(terms, gains(owner, numbers, y, len(terms)), y, rows.column("doc_id").to_pylist())

    def frequencies(batches):
        count = np.zeros(len(model.terms) + 1, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                count[model.read(text)[0]] += 1
                count[-1] += 1
        if count[-1]:
            yield from packed_counts(count)

    with tidy(docs.sparkSession):
        total = add_counts(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(frequencies), "part int, counts binary"), len(terms) + 1)
    model.learn(int(total[-1]), total[:-1], owner, numbers, counts, odds)
    return model


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs named in keep (all if None) with held_out boolean, score double, predicted int and evidence string.

    A score is the calibrated, similarity-weighted vote of the NEIGHBOURS nearest labelled
    examples; its input is the text alone, in whole, whatever its length. A null or empty text,
    or one without any term of the examples, has no neighbours and gets the share of toxic rows
    among such examples. Without a model (no examples of both labels) every score is 0.
    predicted is 1 from 0.5 on. Columns of docs that are named like a new one are replaced; rows
    that repeat are scored alike; a null doc_id counts as held out; no rows give no rows. No shuffle.
    """
    new = ["held_out", "score", "predicted", "evidence"]
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in new)
    kept = docs.select(*keep, docs["text"].cast("string").alias(spare(keep)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        for b in batches:
            texts, got = b.column(len(keep)), []
            for at in range(0, b.num_rows, TOGETHER):
                some = texts.slice(at, TOGETHER).to_pylist()
                got += model.scores(some) if model else [(0.0, "")] * len(some)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string())], names=[*keep, "score", "evidence"]
            )

    out = kept.mapInArrow(released(run), fields + ", score double, evidence string")
    held = held_out() if "doc_id" in keep else F.lit(None).cast("boolean")
    return out.select(*keep, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
