"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton's states are the tokens (the last label read) and a start state.
It is built merge by merge (Berglund, Martens and van der Merwe, Constructing a
BPE tokenization DFA, 2024): the gadget of a merge (u, v) -> w adds the label w
and takes away every arc over which the merge would apply.  What a gadget
takes away depends only on the labels that stand at the two sides of a border
while merges are applied, so the table of arcs is kept in factors: each label's
spines, with the ranks between which their labels stand there, and the ranks of the merges.
An entry (state, label) is read from the factors once and then held.

The automaton is deterministic and every prefix that it accepts has one path, so a word
is encoded in one pass over its places: each place that can be reached has one state,
from which each label that is spelled there makes one step or none.  Decoding
reads ids and emits the labels of their arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from arcloom.llm.common import small
from arcloom.llm.pretokens import Cache, byte_letters, plain

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
START = -1
NEVER = 1 << 60


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = "", unknown: str | None = None):
        self.ids = vocab
        self.labels = {i: t for t, i in vocab.items()}
        self.word_end = word_end
        self.rank: dict[tuple[int, int], int] = {}
        #: label -> [(label at its right edge, rank at which that is merged away)], and the same for the left edge
        self.right = {i: [(i, NEVER)] for i in self.labels}
        self.left = {i: [(i, NEVER)] for i in self.labels}
        made = {vocab[a + b] for a, b in merges}
        self.reachable = {i for i in self.labels if i not in made}
        self.arcs: dict[tuple[int, int], bool] = {}
        for r, (a, b) in enumerate(merges):
            self._gadget(r, vocab[a], vocab[b], vocab[a + b])
        #: first two letters -> length of the longest label that starts so
        self.longest: dict[str, int] = {}
        for label in vocab:
            letters = label.removesuffix(word_end) if word_end else label
            self.longest[letters[:2]] = max(len(letters), self.longest.get(letters[:2], 1))
        self.unknown = vocab.get(unknown) if unknown else None

    def _gadget(self, r: int, u: int, v: int, w: int) -> None:
        self.rank.setdefault((u, v), r)
        if u in self.reachable and v in self.reachable and not self._merges(u, v, r):
            self.reachable.add(w)
        self.right[w] = [(w, NEVER)] + [(t, min(end, r)) for t, end in self.right[v]]
        self.left[w] = [(w, NEVER)] + [(t, min(end, r)) for t, end in self.left[u]]

    def _merges(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a merge of a rank below ``before`` crosses the border of a and b.
        Of equal merges the leftmost comes first: one inside a wins, one inside b loses."""
        get = self.rank.get
        for x, x_end in self.right[a]:
            for y, y_end in self.left[b]:
                m = get((x, y))
                if m is not None and m < x_end and m <= y_end and m < before:
                    return True
        return False

    def arc(self, state: int, label: int) -> bool:
        if state == START:
            return True
        key = (state, label)
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= 2_000_000:
                self.arcs.clear()
            known = self.arcs[key] = not self._merges(state, label)
        return known

    def _spelled(self, word: str) -> list[str]:
        """The word's stretches that labels can spell; an unknown letter is left out, or with an
        unknown label stands by itself."""
        last = len(word) - 1
        known = [(c + self.word_end if i == last else c) in self.ids for i, c in enumerate(word)]
        if all(known):
            return [word]
        if self.unknown is None:
            return [left] if (left := "".join([c for c, k in zip(word, known, strict=True) if k])) else []
        out = [""]
        for c, k in zip(word, known, strict=True):
            if k:
                out[-1] += c
            else:
                out += ["\0", ""]
        return [x for x in out if x]

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token, given in the vocabulary's letters."""
        stretches = self._spelled(word)
        out: list[int] = []
        for i, part in enumerate(stretches):
            if part == "\0":
                out.append(self.unknown)
            else:
                out += self._path(part, i == len(stretches) - 1 and word[-1:] == part[-1:])
        return out

    def _path(self, word: str, ends: bool) -> list[int]:
        n, ids, arcs, reachable = len(word), self.ids, self.arcs, self.reachable
        state: list[int | None] = [None] * (n + 1)  # by place: the last label of the only path there
        came = [0] * (n + 1)
        state[0] = START
        for at in range(n):
            here = state[at]
            if here is None:
                continue
            for stop in range(at + 1, min(n, at + self.longest.get(word[at : at + 2], 1)) + 1):
                label = ids.get(word[at:] + self.word_end if ends and stop == n else word[at:stop])
                if label is None or state[stop] is not None or label not in reachable:
                    continue
                known = arcs.get((here, label))
                if known or known is None and self.arc(here, label):
                    state[stop], came[stop] = label, at
        path, at = [], n
        while at:
            path.append(state[at])
            at = came[at]
        return path[::-1]

    def decode(self, ids: list[int]) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in ids if i in labels])


#: fixed values: letters and other numerals of the characters that ``plain`` texts have beyond ASCII
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMERALS = "0-9²³¹¼-¾"


@cache
def machine(path: str) -> Automaton:
    spec = json.loads(Path(path).read_text())
    model = spec["model"]
    made = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "", model["unk_token"])
    made.labels |= {t["id"]: t["content"] for t in spec["added_tokens"]}
    return made


@cache
def _ids(path: str, bound: int):
    """text -> ids."""
    from tokenizers import Tokenizer

    tk, automaton = Tokenizer.from_file(path), machine(path)
    special = {t["content"]: t["id"] for t in json.loads(Path(path).read_text())["added_tokens"]}
    machine_letters = str.maketrans(byte_letters())
    split_at = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    in_word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMERALS}]|[^{LETTERS}{NUMERALS}]+")

    words = Cache(lambda word: automaton.encode(word.encode().decode("latin-1").translate(machine_letters)), bound)
    #: words with the marks and line breaks around them, mostly made of known words
    chunks = Cache(lambda chunk: [i for w in in_word.findall(chunk) for i in words[w]], bound // 4)

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        if plain(text) and not any(s in text for s in special):
            for w in text.lower().split():
                ids += words[w] if w.isalpha() else chunks[w]
            return ids
        for part in split_at.split(text) if split_at else [text]:
            if part in special:
                ids.append(special[part])
            else:
                split = tk.pre_tokenizer.pre_tokenize_str(tk.normalizer.normalize_str(part))
                for w, _ in split:
                    ids += automaton.encode(w)
        return ids

    return encode


@cache
def _tokenizer(path: str, bound: int):
    """text -> (number of ids, ids joined by spaces, text decoded from the ids)."""
    encode, automaton = _ids(path, bound), machine(path)
    shown = {i: str(i) for i in automaton.labels}

    def both(text: str) -> tuple[int, str, str]:
        ids = encode(text)
        return len(ids), " ".join([shown[i] for i in ids]), automaton.decode(ids)

    return both


def encode_decode(docs: DataFrame, tokenizer: str, cache_size: int = 800_000) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for every document: ids as decimal numbers
    joined by spaces, decoded by emitting the arcs' labels.

    A null text counts as empty; repeated rows give repeated results; an empty
    table gives an empty one; a long text is encoded whole, word by word; a letter that
    no label spells is left out, or is the unknown label where the vocabulary has one;
    columns other than doc_id and text are ignored.
    """

    def run(batches):
        encode = _tokenizer(tokenizer, cache_size)
        for b in small(batches, 256):
            found = [encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, tokenizer: str, cache_size: int = 800_000) -> DataFrame:
    """As encode_decode, with SHA-256 digests made in place of the two long columns."""

    def run(batches):
        encode = _tokenizer(tokenizer, cache_size)
        for b in small(batches, 256):
            found = [encode(t or "") for t in b.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.int64())]
            columns += [pa.array([hashlib.sha256(f[k].encode()).hexdigest() for f in found]) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
