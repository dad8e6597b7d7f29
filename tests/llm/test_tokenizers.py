"""The tokenizer operators against the libraries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, table
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from arcloom.llm import bpe_automaton, packing, token_counts  # noqa: E402

WORD, BYTE, PIECE = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def tk(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_counts_match_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = awkward() + [(30, "▁a▁ b▁"), (31, "end "), (32, " "), (33, "<s></s>")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table(spark, rows), PIECE, limit=50).collect())
    want = sorted((d or -1, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for d, t in rows)
    assert got == want
    assert token_counts.count_tokens(table(spark, []), PIECE).count() == 0


def test_ids_and_labels_match_tokenizers(spark):
    lib = tk(WORD)
    rows = awkward() + [(30, "aaaaa aaaa AAA it's 'LL 12³ ½ <|startoftext|>x<|endoftext|>"), (31, "é ΑΣ İ")]
    got = sorted(tuple(r)[:1] * 0 + (r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_automaton.digests(table(spark, rows), WORD).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d or -1, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    texts = {r.doc_id: (r.ids, r.decoded) for r in bpe_automaton.encode_decode(table(spark, [(1, "hello there")]), WORD).collect()}
    assert texts[1][1] == lib.decode([int(i) for i in texts[1][0].split()], skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abethin ", max_size=40))
def test_automaton_on_repeated_letters(text):
    ids = tk_word().encode(text, add_special_tokens=False).ids
    assert bpe_automaton._tokenizer(WORD, 1000)(text)[1] == " ".join(map(str, ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzABZ019 \n'.,-_²³¹¼½¾ªºµ×÷ßŉſİıÀéñÿĀžŊ\u00ad\u0307\u0301‐…“”日ñ½²msdt")), max_size=30))
def test_every_class_of_character(text):
    lib = tk_word()
    ids = lib.encode(text, add_special_tokens=False).ids
    n, shown, decoded = bpe_automaton._tokenizer(WORD, 1000)(text)
    assert (n, shown, decoded) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("text", ["20 m²", "km²", "x³y", "½cup", "1ª 2º", "a²b³c¹", "İstanbul", "naïve's ſs 'ſ", "٣ ⅷ", "a\u0301 é", "x" * 3000])
def test_numerals_and_letters(text):
    ids = tk_word().encode(text, add_special_tokens=False).ids
    assert bpe_automaton._tokenizer(WORD, 1000)(text)[1] == " ".join(map(str, ids))


def test_letters_that_no_label_spells():
    merges, vocab = [("a", "b")], {"a": 0, "b": 1, "ab": 2, "?": 3}
    assert bpe_automaton.Automaton(vocab, merges).encode("axb") == [2]
    assert bpe_automaton.Automaton(vocab, merges, unknown="?").encode("axb") == [0, 3, 1]
    assert bpe_automaton.Automaton(vocab, merges).encode("xx") == []


_cache = {}


def tk_word():
    return _cache.setdefault("w", tk(WORD))


def test_small_merges_by_brute_force():
    """An automaton over a few merges against merging by rank."""
    merges = [("a", "a"), ("aa", "a"), ("b", "aa"), ("a", "b"), ("aa", "aa")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(x + y for x, y in merges)])}
    machine = bpe_automaton.Automaton(vocab, merges)
    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            parts = list(word)
            while True:
                found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert machine.encode(word) == [vocab[p] for p in parts], word


def test_packing(spark):
    lib = tk(BYTE)
    rows = awkward()
    got = packing.best_fit_pack(table(spark, rows), BYTE, 256, 0).collect()
    by_row, bins = Counter(), defaultdict(list)
    for r in got:
        by_row[r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        at, end, piece = 0, (len(ids) - 1) % 256 + 1, 0
        while at < len(ids):
            want[d or -1, piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())] += 1
            at, end, piece = end, end + 256, piece + 1
    assert by_row == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.best_fit_pack(table(spark, []), BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25))
def test_plans_place_everything_once(counts):
    runs = packing.plan(counts, 60, groups=5)
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, lo, n, first, offset in runs:
        ranks[length] += range(lo, lo + n)
        for i in range(n):
            bins[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 60
    # no more than plain best fit by decreasing length, for all the coarseness of five groups
    rooms: list[int] = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [room for room in rooms if room >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(60 - length)
    assert len(bins) <= len(rooms)


@pytest.mark.parametrize("sf, most", [("sf0.001", 97), ("sf0.01", 481)])
def test_packing_of_the_given_texts(spark, sf, most):
    """As few sequences as plain best fit by decreasing length, or as the bound from below says."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert packing.best_fit_pack(docs, BYTE).select("sequence_id").distinct().count() <= most


def test_a_group_for_each_length_and_not_for_each_document(monkeypatch):
    from arcloom.llm import packing

    calls = []
    own = packing._fullest
    monkeypatch.setattr(packing, "_fullest", lambda *a: calls.append(len(a[1])) or own(*a))
    counts = {s: 500 + s % 7 for s in range(30, 100, 3)}
    runs = packing.scheme(counts, 100, 100 * 100, 0.35)
    assert sum(n for _, _, n, _, _ in runs) == sum(counts.values())
    assert max(calls) <= len(counts) and len(calls) <= 4 * len(counts)
