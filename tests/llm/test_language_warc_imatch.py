import hashlib
import os
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from helpers import awkward, table
from pyspark.sql import functions as F

from arcloom.llm import imatch, language_id, warc

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    row = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row.n > 20 and row.right >= 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_cases(spark):
    rows = [(i, "der die das und nicht " * 9, "de") for i in range(20)] + [(50 + i, "the and of which that " * 9, "en") for i in range(20)]
    rows += [(100, None, "de"), (101, "12 !?", "en"), (102, "und nicht", None), (103, "Ж", None), (None, "that", "en")]
    got = {r.doc_id: r for r in language_id.identify(table(spark, rows)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0
    assert got[102].lang_pred == "de" and got[103].lang_pred in ("de", "en") and got[None].lang_pred == "en"
    assert language_id.identify(table(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(table(spark, [(1, "text", None)])).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(5)]
        rows += [(100 * i + k, " ".join(words * 4), f"l{i:02}") for k in range(4)]
        want |= {100 * i + k: f"l{i:02}" for k in range(4)}
    docs = table(spark, rows).select("doc_id", "text", "lang")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert got == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    same, other = "<p>same</p>" * 20, "<p>Ünï</p>" * 20
    rows = [(5, "http://b.example.org/x?q=1", same), (2, "https://www.Example.com/", same), (9, None, same), (3, "http://a.example.org/", other),
            (4, "http://a.example.org/", "short"), (6, "http://a.example.org/", "short"), (7, "no host", None), (8, "http://x.org:81/a b\tc", "")]
    archive = warc.write_archive(pages(spark, rows))
    got = {r.page_id: r for r in archive.records().collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {5: 2, 9: 2}
    found = archive.lookup(spark.createDataFrame([("http://a.example.org/",), ("http://none.example/",)], "url string")).collect()
    assert {r.page_id for r in found} == {3, 4, 6}
    every = archive.lookup(spark.createDataFrame([(u,) for _, u, _ in rows], "url string")).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, got.values()))
    empty = warc.write_archive(pages(spark, []))
    assert empty.records().count() == 0 and empty.lookup(pages(spark, rows)).count() == 0
    assert warc.write_archive(pages(spark, [(None, None, None)])).records().first().page_id is None
    assert warc.url_key("http://www.Example.com:80/a?b") == "com,example,www:80)/a?b"


STRANGE_URLS = ["http://[abc/", "http://[::1/x", "http://a.org:port/", "http://a.org:99999999/", "http://ex\u2100.org/", "http://bücher.example/straße", "//", "://",
                "", " ", "http://", "a\tb\nc//[", "http://h/\u0000", "javascript:void(0)", "🤗://🤗", "http://user:pw@h.org/", "x" * 5000]


def test_any_url_string(spark):
    """A string that is no URL is a key like others: written, read back and found."""
    keys = [warc.url_key(u) for u in STRANGE_URLS]
    assert all("\t" not in k and "\n" not in k for k in keys)
    assert warc.url_key("http://[abc/") == "http://[abc/)/" and warc.url_key("http://bücher.example/ä") == "example,bücher)/ä"
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(STRANGE_URLS)] + [(90, None, None)]
    archive = warc.write_archive(pages(spark, rows))
    assert sorted(r.page_id for r in archive.records().collect()) == [*range(len(STRANGE_URLS)), 90]
    for i, u in enumerate(STRANGE_URLS[:2]):
        assert i in {r.page_id for r in archive.lookup(spark.createDataFrame([(u,)], "url string")).collect()}
    every = archive.lookup(pages(spark, rows).select("url"))
    assert sorted(r.page_id for r in every.collect()) == [*range(len(STRANGE_URLS)), 90]


def test_index_of_many_blocks(spark, monkeypatch):
    """One key with more captures than a block, between others, dealt over several files."""
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 50}.org/{i}", f"<p>{i}</p>") for i in range(3000)]
    archive = warc.write_archive(pages(spark, rows))
    assert archive.directory.count() > 2
    hot = archive.lookup(spark.createDataFrame([("http://hot.org/",), ("http://hot.org/",), ("http://h9.org/9",)], "url string"))
    assert sorted(r.page_id for r in hot.collect()) == sorted([i for i in range(3000) if i % 3] + [9])
    every = archive.lookup(pages(spark, rows).select("url"))
    assert sorted(r.page_id for r in every.collect()) == list(range(3000))


def test_warc_files_are_gzip_members_of_whole_records(spark, tmp_path):
    import gzip

    warc.write_archive(pages(spark, [(1, "http://a.org/", "x" * 200), (2, "http://a.org/", "x" * 200)]), f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz")).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: revisit" in text and "WARC-Refers-To: <urn:page:1>" in text


def test_imatch(spark):
    rng = random.Random(1)
    rows = awkward() + [(100 + i, " ".join(f"term{rng.randrange(600)}" for _ in range(40))) for i in range(40)]
    got = imatch.edited_likeness(table(spark, rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(((-(10**9) if d is None else d, t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (d, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    shown = sorted((-(10**9) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    assert [x for x in shown if x[0] not in (4, -(10**9))] == [x for x in sorted(want) if x[0] not in (4, -(10**9))]
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(dict((d, t) for d, t in rows).get(r.doc_id), set()).add(r.fingerprint)
    assert all(len(p) == 1 for t, p in prints.items() if t)
    far = [r for r in got if r.doc_id and r.doc_id >= 100]
    assert sum(r.near_edited for r in far) > 3 * sum(r.near_next for r in far)
    assert imatch.edited_likeness(table(spark, [])).count() == 0
    assert imatch.edited_likeness(table(spark, [(1, "only one here")])).first().near_next == 1


def test_imatch_terms_by_hand(spark):
    """Fingerprints of texts with the same lexicon terms in another order are equal."""
    rows = [(i, f"common{i % 3} rare{i} common{(i + 1) % 3}") for i in range(30)] + [(90, "a b c d e f g h i j"), (91, "J i H g f e d c b a.")]
    got = {r.doc_id: r.fingerprint for r in imatch.imatch(table(spark, rows)).collect()}
    assert got[90] == got[91] != got[0]


def imatch_by_hand(rows):
    """doc_id, print, edited print, likenesses of rows in order of doc_id, largest first."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of_long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    terms = lambda t: sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\W_]+", (t or "").lower())})

    def mask(t):
        bits = (1 << 64) - 1
        for i in range(1, imatch.DRAWS + 1):
            bits &= xxhash.xxh64_intdigest(struct.pack("<i", i), of_long(t, 42))
        return bits

    def digest(found):
        seed = 42
        for t in found:
            seed = of_long(t, seed)
        return f"{seed:016x}"

    counts = Counter(t for _, text in rows for t in terms(text))
    lexicon = {t for t, n in counts.items() if imatch.LEAST * len(rows) <= n <= imatch.MOST * len(rows)}

    def prints(text):
        own = terms(text)
        inside = [(t, mask(t)) for t in own if t in lexicon]
        subsets = [[t for t, m in inside if m >> s & 1] for s in range(imatch.SUBSETS)]
        found = [digest(x) if x else None for x in subsets]
        return [*found, None if any(found) else digest(own)]

    def like(a, b):
        some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in some) / len(some)

    out, rows = {}, sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, after = t or "", after or ""
        m = len(t) // 3
        a, b = prints(t), prints(t[: len(t) - m] + after[:m])
        out[d] = tuple(" ".join(x or "-" for x in p) for p in (a, b)) + (like(a, b), like(a, prints(after)))
    return out


@pytest.mark.parametrize("inline", [imatch.MOST_INLINE, 0])
def test_imatch_by_hand(spark, monkeypatch, inline):
    """Lexicon, fingerprints and likeness by brute force, with the lexicon as a constant and joined."""
    monkeypatch.setattr(imatch, "MOST_INLINE", inline)
    rng = random.Random(3)
    rows = [(i, " ".join(f"term{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "only words of its own"), (203, "words of only its own!"), (204, "Ünï, ß 日本")]
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.edited_likeness(table(spark, rows)).collect()}
    want = imatch_by_hand(rows)
    assert {d: x[:2] for d, x in got.items()} == {d: x[:2] for d, x in want.items()}
    assert all(abs(got[d][k] - want[d][k]) < 1e-12 for d in want for k in (2, 3))


def test_languages_by_hand(spark):
    """Predictions and scores against sets of n-grams in place of filters of hashes."""
    rng = random.Random(21)
    syllables = {"aa": "ka ro mi tu".split(), "bb": "sch ung ein der".split(), "cc": "ción que los ndo".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang] if rng.random() < 0.9 else ["xo", "li"]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(150))]
    rows += [(500 + i, " ".join(word(rng.choice(list(syllables))) for _ in range(20)), None) for i in range(60)]

    def grams(text):
        padded = "    " + "".join(c if c.isalpha() else " " for c in text.lower()) + "    "
        return [padded[i - 1 : i + 3] for i in range(4, len(padded) - 4) if padded[i].isalpha()]

    counts = {lang: Counter(g for _, t, own in rows if own == lang for g in grams(t)) for lang in syllables}
    counts = {lang: {g: n for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    has = {lang: {g for g, x in c.items() if 20 * x >= max(r.get(g, 0) for r in rate.values())} for lang, c in rate.items()}
    docs = table(spark, rows)
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    for d, t, _ in rows:
        own = grams(t)
        shares = {lang: sum(g in has[lang] for g in own) / len(own) for lang in sorted(has)}
        best = max(shares, key=shares.get)
        assert got[d].lang_pred == best or shares[got[d].lang_pred] == shares[best]
        assert abs(got[d].score - shares[best]) < 0.01
