"""BPE tokenizer as a deterministic automaton over tokens, and its use on whole corpora.

The automaton is built from the merge list by one gadget a merge. At first there is one
state with a loop for every base symbol. The gadget of the merge (a, b) -> c

* gives every state with an arc for a an arc for c, which ends where b's arcs end (if a's end
  has an arc for b at all; else the merge never applies);
* sends the arcs for a to a new state: a copy of their former end without the arc for b.

So all arcs of one label end in one state, a state only ever loses an arc when it is
made, and it gains arcs only through later merges. `Automaton` keeps just that: for each
state the token and the merge it was made for; for each token its parts, its birth and its
end. The paths it accepts are exactly the tokenizations BPE makes, and
every prefix of such a path is one, so one pass over a word leaves one state at each
place that a token of the path may end: the encoder follows tables, with no merge loop.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandlog.llm._common import released, spare

#: Bytes (about) of the words that a worker remembers in each of two generations, and arcs of its table. A full young
#: generation becomes the old one, and a word that is found there is young again; a full table starts again.
REMEMBER, ARCS = 32 << 20, 1 << 18
#: Bytes of the longest word that is remembered.
SHORT = 64
#: Letters, numbers and cases up to here have not changed between Unicode's editions.
SETTLED = regex.compile("[^\\u0000-\\u024f\\u2010-\\u2027]")


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 as itself, the rest from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (chr(256 + k) for k in range(256))
    return [chr(b) if b in plain else next(other) for b in range(256)]


class Automaton:
    """States and arcs of the merge list; token ids are those of the vocabulary."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], n_ids: int):
        self.left = [-1] * n_ids  # token -> the left part of the merge that made it
        self.born = [0] * n_ids  # token -> number of that merge, from 1 on
        self.end = [-1] * n_ids  # token -> state in which its arcs end; -1: it has none
        self.right = [-1] * n_ids  # token -> the right part of that merge
        self.owner, self.since = [-1], [0]  # state -> the token whose arcs it was made for, and by which merge
        self.taken: dict[int, int] = {}  # (a, b) -> the merge that took b's arc from the end of a
        for t in base:
            self.end[t] = 0
        made = set(base)
        for r, (a, b, c) in enumerate(merges, 1):
            if not {a, b} <= made:
                raise ValueError(f"merge {r} uses a symbol that no earlier merge has made")
            if c in made:
                raise ValueError(f"merge {r} makes a symbol again")
            made.add(c)
            if self.end[a] < 0 or self.end[b] < 0 or not self._has(self.end[a], b):
                continue  # a is never before b by now, so c never is made
            self.left[c], self.right[c], self.born[c], self.end[c] = a, b, r, self.end[b]
            self.taken[a << 20 | b] = r
            self.owner.append(a)
            self.since.append(r)
            self.end[a] = len(self.owner) - 1
        self.table: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after token, -1 if there is no arc. Rows of the table are filled as they are first used."""
        key = state << 20 | token
        to = self.table.get(key)
        if to is None:
            if len(self.table) >= ARCS:
                self.table.clear()
            to = self.table[key] = self.end[token] if self.end[token] >= 0 and self._has(state, token) else -1
        return to

    def _has(self, state: int, token: int) -> bool:
        """Whether a state, as the end of token a after merge t, has an arc for a token.

        A token that is younger than the state is there if its left part was. An older one is,
        if the merge (a, token) has not taken it and the state had it before: as the end of a
        when the token was made or, if a is younger, as the end of a's right part when a was made.
        """
        if not state:
            return True
        a, t = self.owner[state], self.since[state]
        while True:
            b = self.born[token]
            if b < t or not b:
                taken = self.taken.get(a << 20 | token)
                if taken is not None and taken <= t:
                    return False
                if b < self.born[a]:
                    a, t = self.right[a], self.born[a] - 1  # before that merge, which may be (a, a)
                    continue
                if not b:
                    return True  # a and the token are base symbols: the first state
                t = b
            token = self.left[token]


class Tokenizer:
    """A tokenizers JSON file of a BPE model with word ends, byte-level symbols and a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.added.items()}
        self.marks = {x[:2] for x in self.added}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = pieces[0]["pattern"]["Regex"]
        self.split = regex.compile(self.pattern)
        self.other = None
        self.symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = [vocab[s + e] for s in self.symbols for e in {"", self.suffix} if s + e in vocab]
        made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.automaton = Automaton(base, made, max(self.text) + 1)
        # tokens by their bytes: those within a word, and those that end one
        whole = {s: b for b, s in enumerate(self.symbols)}
        self.inner, self.final, self.longest = {}, {}, 1
        for t, i in vocab.items():
            ends = bool(self.suffix) and t.endswith(self.suffix)
            stem = t[: -len(self.suffix)] if ends else t
            key = bytes(whole[c] for c in stem)
            (self.final if ends or not self.suffix else self.inner)[key] = i
            self.longest = max(self.longest, len(key))
        # bytes that a token starts with: that token within a word, or -1
        self.nodes = {k[:n]: self.inner.get(k[:n], -1) for d in (self.inner, self.final) for k in d for n in range(1, len(k) + 1)}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = REMEMBER
        self.labels = [self.text.get(i, "").encode() for i in range(max(self.text) + 1)]

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word.

        The word's one accepted path is looked for from the start, the longest token first. The
        prefix up to any place has one accepted path, so a place is entered once at most.
        """
        n = len(word)
        if n == 0:
            return []
        step, table, nodes, final, longest = self.automaton.step, self.automaton.table, self.nodes, self.final, self.longest
        seen = bytearray(n + 1)
        out: list[int] = []
        open_: list[tuple[int, list]] = []  # states on the path, each with the tokens that are left to try from it
        i = state = 0
        while True:
            left, j, last = [], i + 1, min(n, i + longest + 1)
            while j < last:
                token = nodes.get(word[i:j])
                if token is None:
                    break
                if token >= 0:
                    left.append((j, token))
                j += 1
            if j == n and (token := final.get(word[i:])) is not None:
                left.append((n, token))
            open_.append((state, left))
            while True:
                if not open_:
                    raise ValueError("a byte of the word is no symbol of the vocabulary")
                state, left = open_[-1]
                to = -1
                while left and to < 0:
                    j, token = left.pop()
                    if not seen[j]:
                        to = table.get(state << 20 | token)
                        if to is None:
                            to = step(state, token)
                if to >= 0:
                    break
                open_.pop()
                if out:
                    out.pop()
            out.append(token)
            if j == n:
                return out
            seen[j] = 1
            i, state = j, to

    def normalize(self, text: str) -> str:
        """NFC, runs of white space as one space, and lower case by single characters (no final sigma)."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        return text.lower()

    def split_words(self, text: str) -> list[str]:
        """The normalized, pre-split words. Texts with characters whose class depends on the edition of Unicode
        are normalized and split (not encoded) by the tokenizers library, so that its edition counts."""
        if text.isascii() or not SETTLED.search(text):
            return self.split.findall(self.normalize(text))
        if self.other is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self.other = (
                normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]),
                pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True),
            )
        return [w for w, _ in self.other[1].pre_tokenize_str(self.other[0].normalize_str(text))]

    def word(self, w: str) -> bytes:
        """Ids, as little-endian 32-bit, of a pre-split word, remembered."""
        got = self.words.get(w)
        if got is None:
            got = self.old.get(w)
            if got is None:
                got = np.array(self.encode_word(w.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            if len(w) <= SHORT:
                self.room -= 200 + 2 * len(w) + len(got)
                if self.room < 0:
                    self.old, self.words, self.room = self.words, {}, REMEMBER
                self.words[w] = got
        return got

    def parts(self, text: str):
        """Ids of each word and special token of text, in order; special tokens are cut out before all else."""
        for piece in self.special.split(text) if self.special and any(x in text for x in self.marks) else (text,):
            if piece in self.added:
                yield np.array([self.added[piece]], "<u4").tobytes()
            elif piece:
                word = self.word
                for w in self.split_words(piece):
                    yield self.words.get(w) or word(w)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.parts(text or "")), "<u4").tolist()

    def decoded(self, ids: list[int]) -> bytes:
        """decode() of ids that all are of the vocabulary, in UTF-8."""
        return b" ".join(map(self.labels.__getitem__, ids))

    def decode(self, ids) -> str:
        """Emits the labels of the path's arcs; as there is no decoder in the file, they are joined by spaces. Unknown ids are left out."""
        return " ".join(self.text[i] for i in ids if i in self.text)


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One tokenizer a process and path; workers keep it, and the words it remembers, from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Encodes docs.text and decodes it again, one row a row: the columns named in keep, then n_tokens long,
    ids_sha256 and decoded_sha256 string (of the ids as little-endian 32-bit integers; of the decoded text in
    UTF-8) and, with ids, ids array<int>.

    A null text is an empty one: no ids, the digests of nothing. Whole texts of any length are encoded; one row at
    a time is in memory. Rows repeat as they do in docs. `path` is read on the executors, so it has to be there.
    No shuffle: each task encodes its own rows.
    """
    kept = docs.select(*keep, docs["text"].cast("string").alias(spare(keep)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    out = (fields + ", " if fields else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        t = load(path)
        for b in batches:
            n, a, d, lists = [], [], [], []
            for text in b.column(len(keep)).to_pylist():
                raw = b"".join(t.parts(text or ""))
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                d.append(hashlib.sha256(t.decoded(np.frombuffer(raw, "<u4").tolist())).hexdigest())
                if ids:
                    lists.append(np.frombuffer(raw, "<i4"))
            cols = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + cols, names=[*keep, *names])

    return kept.mapInArrow(released(run), out)
