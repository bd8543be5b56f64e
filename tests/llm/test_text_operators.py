"""Operators that judge one text at a time."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tessera.llm import byte_bpe, hashed_ngrams, language_id, license_scan, matroska, queries, token_files, toxicity, url_filter

from tests.compare import assert_same
from tests.conftest import DATA

LONG = "Ab' cd're  é\n\n  x1 " * 40_000
#: A key each; null, empty, blank, very long, repeated rows, ties, malformed to some parsers.
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "Under the MIT License. under the mit license"), (5, "Under the MIT License. under the mit license"), (6, "日本語のテキスト、長い'文'"), (None, "no key"), (7, "a" * 5000), (8, "it's 'S 'ReX \u00a0 !!\r\n x")]
EXTRA = "doc_id long, text string, lang string, score double, ids string, n_tokens string, _text string, labels string"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "en", 0.5, "x", "y", "z", "w") for r in rows], EXTRA)


@pytest.fixture(scope="module")
def encoding():
    import base64

    import tiktoken

    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# 2: byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.vocabulary(queries.RANKS, public_tokenizers.PATTERN)


SEAMS = ["", "a", "it's we're they'll 'r 're", "x  \n\n  y", "   ", "a" * 40 + "  " + "1" * 40, "!?'ve'ré  \t日本 語", "'lll", "antidisestablishmentarianism" * 9, "ab" * 300, "é" * 300 + "日" * 300, "\n" * 90 + "x", LONG[:3000]]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 50, 512, 1000])
def test_tree_of_halves_is_the_library(encoding, vocabulary, leaf):
    r, encode = np.random.default_rng(leaf), byte_bpe.Encoder(vocabulary, leaf)
    alphabet = [*"aab ''slrevemtd  \n\t1!?.é日ß ́🙂", "the", "ing", " of", "'re", "  "]
    for text in [*SEAMS, *("".join(r.choice(alphabet, r.integers(1, 120))) for _ in range(300))]:
        assert encode(text) == encoding.encode_ordinary(text)
        assert [p for p, _ in encode.parts(text)] == vocabulary.split(text)


def test_pieces_of_a_megabyte(encoding, vocabulary):
    encode, r = byte_bpe.Encoder(vocabulary), np.random.default_rng(1)
    for text in ["z" * 100_000, " " * 200_000 + "x", "'" + "l" * 50_000, "日本" * 30_000, "".join(r.choice(list("aeinorst"), 50_000))]:
        assert encode(text) == encoding.encode_ordinary(text)
    text = "".join(r.choice(list("aeinorst"), 1_000_000))
    ids = encode(text)
    assert byte_bpe.decode(ids, vocabulary.tokens) == text.encode()
    for a, b in set(zip(ids, ids[1:], strict=False)):  # each two neighbours are the encoding of their bytes
        assert vocabulary.merge((vocabulary.tokens[a] + vocabulary.tokens[b]).decode()) == [a, b]


def test_each_token_is_the_encoding_of_its_bytes(vocabulary):
    """By merges alone, without looking the whole up."""
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    for token in vocabulary.tokens:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert rank < 1 << 30, token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_round_trip_is_the_library(spark, encoding):
    out = byte_bpe.round_trip(docs(spark), queries.RANKS, public_tokenizers.PATTERN, ["doc_id"], leaf_chars=1000)
    expected = []
    for key, text in TEXTS:
        ids = encoding.encode_ordinary(text or "")
        expected.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


def test_encode_and_decode_columns(spark, encoding):
    out = byte_bpe.encode_column(docs(spark), queries.RANKS, public_tokenizers.PATTERN, ["doc_id", "score"])
    assert all(r.lossless for r in out.collect())
    back = byte_bpe.decode_column(out, queries.RANKS, public_tokenizers.PATTERN, ["doc_id"])
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t in TEXTS)
    assert byte_bpe.encode_column(docs(spark, []), queries.RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


# 1: licence scan


def phrase_places(text, phrase):
    words = license_scan.words_of((text or "").encode())
    want = phrase.encode().split()
    return len(words), [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]


def test_base_places_are_exact(spark):
    rows = [*TEXTS, (20, "cc-by-nc; CC BY NC 4.0 / Apache License, Version 2.0"), (21, "under the mit license " * 50), (22, "under the mit licenses"), (23, "xunder the mit license"), (24, "Apache License Version 20")]
    out = license_scan.digest(license_scan.scan(docs(spark, rows), ["doc_id"]), ["doc_id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id]
        places = {n.label: phrase_places(text, n.phrase.replace("{", "").replace("}", ""))[1] for n in license_scan.NOTICES if n.base}
        every = sorted(p for some in places.values() for p in some)
        assert r.n_words == phrase_places(text, "x")[0] and r.n_base == len(every)
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted(k for k, v in places.items() if v))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("released under the mit licence", "mit"),
        ("Permision is hereby granted, free of charge, to any person obtaning a copy", "mit"),
        ("under the GNU General Public Licence version 3", "gpl-3"),
        ("the GNU Genral Public License, version 2", "gpl-2"),
        ("Licensed under CC BY-ND", "cc-by-nd"),
        ("licensed under the bsd license", ""),
    ],
)
def test_notices_with_edits(spark, text, label):
    row = license_scan.digest(license_scan.scan(docs(spark, [(1, f"Some words. {text} and more")]), ["doc_id"]), ["doc_id"]).first()
    assert row.labels == label


def test_spans_of_a_notice(spark):
    row = license_scan.scan(docs(spark, [(1, "A b under the mit licnse c")]), ["doc_id"]).first()
    assert [(s.label, s.first_word, s.n_words, s.edits, s.matched) for s in row.spans] == [("mit", 2, 4, 1, "under the mit licnse")]


def places_by_all_alignments(text, notice, most):
    """(start, end) of stretches between spaces: the fewest edits that make the notice of them,
    where characters in braces allow none, before, in or after them."""
    plain, hard = "", []
    for part in notice.phrase.replace("}", "{").split("{"):
        exact = "{" + part + "}" in notice.phrase
        plain, hard = plain + part, hard + [exact] * len(part)
    starts = [i for i in range(len(text)) if i == 0 or text[i - 1] == " "]
    found, far = {}, most + 1
    for a in starts:
        row = [0 if not j else far for j in range(len(plain) + 1)]
        for j, h in enumerate(hard):
            row[j + 1] = far if h else min(far, row[j] + 1)
        for b in range(a, min(len(text), a + len(plain) + most)):
            now = [far if hard[0] else min(far, row[0] + 1)]
            for j, h in enumerate(hard):
                same = row[j] if plain[j] == text[b] else far if h else row[j] + 1
                inside = h and j + 1 < len(hard) and hard[j + 1]
                now.append(min(far, same, far if h else now[j] + 1, far if inside else row[j + 1] + 1))
            row = now
            if row[-1] <= most and (b + 1 == len(text) or text[b + 1] == " "):
                found[a, b + 1] = row[-1]
    return found


def test_edited_notices_by_all_alignments():
    """Every place within a notice's edits overlaps a span of it with no more edits than the
    place needs, and every span is such a place."""
    r = np.random.default_rng(5)
    patterns, automaton = license_scan.compiled(license_scan.NOTICES)
    for k, (p, _) in enumerate(patterns):
        for n in range(12):
            chars = list(p.plain)
            for _ in range(n % (p.edits + 2)):
                at, kind = r.integers(len(chars)), r.random()
                chars[at : at + 1] = [] if kind < 0.3 else [r.choice(list("abe "))] if kind < 0.6 else [r.choice(list("abe ")), chars[at]]
            text = " ".join(f"some words under {''.join(chars)} license of {p.plain[:9]} mit".split())
            spans = {(a, b): e for i, a, b, e in license_scan.spans_in(text, patterns, automaton) if i == k}
            places = places_by_all_alignments(text, p.notice, p.edits)
            for (a, b), e in spans.items():
                assert places[a, b] == e, (text, p.plain)
            for a, b in places:
                assert any(x < b and a < y for x, y in spans), (text, p.plain)
            if places:
                assert min(spans.values()) == min(places.values()), (text, p.plain)


def test_many_places_in_one_text():
    import time

    patterns, automaton = license_scan.compiled(license_scan.NOTICES)
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        spans = license_scan.spans_in("under the mit license " * n, patterns, automaton)
        took.append(time.process_time() - began)
        assert sum(1 for k, *_ in spans if k == 0) == n
    assert took[1] < 8 * took[0] + 1  # in proportion


# 3: URL filter

URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/en", "http://a.b.net/es/1?x#y", "http://xnet/fr/", "http://net/fr/", "http://q.org?/en/", "http://m.a.org/x", "http://a.com#/b", "ftp://u:p@h.com:80/ads/1", "http://a.io/login", "http://a.io/loginx", "http://a.com/\nx", "x://y://z.com/"]


def test_urls_by_both_ways_and_sql(spark, duck, monkeypatch):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)] + [(0, None, "r", "v")], "page_id long, url string, rule string, verdict string")
    one = url_filter.judge(pages, ["page_id"]).toPandas()
    monkeypatch.setattr(url_filter, "MOST_INLINE_RULES", 0)
    assert_same(one, url_filter.judge(pages, ["page_id"]).toPandas())
    cursor = duck.cursor()
    frame = pages.toPandas()  # noqa: F841
    cursor.execute("create schema u; create table u.pages as select * from frame; set schema = 'u'")
    assert_same(one, cursor.execute(url_filter.SQL).df())
    said = {URLS[int(r.page_id)]: (r.rule, r.verdict) for r in one.itertuples(index=False)}
    assert said["HTTP://WWW.Example.COM/en/x"] == ("www.example.com/en/", "allow")
    assert said["http://a.b.net/es/1?x#y"] == ("net/es/", "block")


def test_urls_of_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), ["page_id"]).count() == 0


# 4: Matroska


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 30_000, 200_000])
def test_media_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    payload = matroska.payload_of(raw)
    data = matroska.mux(payload)
    media = matroska.demux(data)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and set(payload[n:]) <= {255} and len(payload) - n <= 576
    assert matroska.read_back(data, media) == payload
    assert media.doc_type == "matroska" and media.codecs == {1: "A_PCM/INT/LIT"}
    assert [p.timestamp_ns // 12_000_000 for p in media.packets] == list(range(len(media.packets)))
    assert all(data[at : at + 4] == bytes.fromhex("1f43b675") for _, _, at in media.cues)
    if n > 150_000:
        assert {p.lacing for p in media.packets} == {0, 1, 2, 3}


def test_laces_of_uneven_frames():
    frames = [b"a" * n for n in (3, 700, 255, 1, 9)]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        body = b"\x82" + b"\x00\x05" + bytes([lacing << 1]) + matroska.laced(frames, lacing)
        group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, body) + matroska.unsigned(matroska.REFERENCE, 1))
        data = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.unsigned(matroska.TIMESTAMP, 7) + group))
        found = matroska.demux(data).packets
        assert [p.size for p in found] == [3, 700, 255, 1, 9] and {(p.track, p.keyframe, p.timestamp_ns) for p in found} == {(2, False, 12_000_000)}


def test_unknown_sizes_and_cut_off_media():
    block = matroska.unsigned(matroska.TIMESTAMP, 1) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    cluster = bytes.fromhex("1f43b675ff") + block
    data = bytes.fromhex("1853806701ffffffffffffff") + cluster * 2 + matroska.element(matroska.CUES, b"")
    assert [p.cluster for p in matroska.demux(data).packets] == [0, 1]
    whole = matroska.mux(matroska.payload_of(b"x" * 20_000))
    for cut in range(0, len(whole), 997):
        assert matroska.read_back(whole[:cut], matroska.demux(whole[:cut])) is not None
    assert matroska.demux(b"").packets == matroska.demux(b"\x00" * 50).packets == []


def test_cut_off_media_have_whole_packets_alone():
    whole = matroska.mux(matroska.payload_of(b"x" * 60_000))
    every = matroska.demux(whole)
    for cut in [*range(0, len(whole), 499), len(whole) - 1]:
        media = matroska.demux(whole[:cut])
        assert media.packets == every.packets[: len(media.packets)] and media.cues == every.cues[: len(media.cues)]
        assert all(p.offset + p.size <= cut for p in media.packets)


def test_malformed_laces_have_no_packets():
    def block(lacing, body):
        cluster = matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0" + bytes([lacing << 1]) + body)
        return matroska.demux(matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, cluster))).packets

    assert len(block(matroska.XIPH, b"\x01\x02abcde")) == 2 and len(block(matroska.FIXED, b"\x01abcd")) == 2
    for lacing, body in [(matroska.XIPH, b"\x01\x09abc"), (matroska.XIPH, b"\x01\xff\xff"), (matroska.FIXED, b"\x01abc"), (matroska.EBML_LACING, b"\x02\x81\x80abc"), (matroska.EBML_LACING, b"\x01\x89abc"), (matroska.XIPH, b"")]:
        assert block(lacing, body) == []


def test_media_of_another_writer():
    """By hand: sizes of eight bytes, a void, a seek head, checksums, two tracks, microseconds, a
    cluster of unknown size, a block group with a reference, cues that come first."""
    eight = lambda name, body: bytes.fromhex(name) + (1 << 56 | len(body)).to_bytes(8, "big") + body
    head = eight("1a45dfa3", bytes.fromhex("428681 01 42f781 01 42f281 04 42f381 08 428284") + b"webm" + bytes.fromhex("428781 04 428581 02"))
    info = eight("1549a966", bytes.fromhex("bf84 01020304 2ad7b1 82 03e8"))
    audio = eight("ae", bytes.fromhex("d781 02 73c588 0000000000000002 8381 02 86") + b"\x86A_OPUS" + bytes.fromhex("e1 83 9f8102"))
    video = eight("ae", bytes.fromhex("d781 01 73c581 01 8381 01 86") + b"\x85V_VP8")
    tracks = eight("1654ae6b", video + audio)
    cues = bytes.fromhex("1c53bb6b 8d bb 8b b381 05 b7 86 f781 01 f181") + b"\x40"
    one = bytes.fromhex("1f43b675 01ffffffffffffff e7 82 0100") + bytes.fromhex("a3 87 81 0005 80") + b"abc" + bytes.fromhex("a0 8c a1 86 82 fffe 00") + b"hi" + bytes.fromhex("fb 82 fffe")
    two = eight("1f43b675", bytes.fromhex("e7 81 09 ec 82 0000 a3 85 82 0000 80") + b"z")
    body = eight("114d9b74", b"") + bytes.fromhex("ec 83 000000") + info + cues + tracks
    data = head + bytes.fromhex("18538067 01ffffffffffffff") + body + one + two
    media = matroska.demux(data)
    assert media.doc_type == "webm" and media.codecs == {1: "V_VP8", 2: "A_OPUS"}
    assert [(p.track, p.timestamp_ns, data[p.offset : p.offset + p.size], p.keyframe, p.cluster) for p in media.packets] == [(1, 261_000, b"abc", True, 0), (2, 254_000, b"hi", False, 0), (2, 9_000, b"z", True, 1)]
    assert [(t, track, at - len(head)) for t, track, at in media.cues] == [(5_000, 1, 12 + 64)]


def test_features_by_counting():
    import math

    samples = bytes([0, 255, 255, 3, 200, 200, 127, 128] * 72)
    media = matroska.demux(matroska.mux(samples))
    p = [samples.count(x) / len(samples) for x in set(samples)]
    crossings = sum((a > 127) != (b > 127) for a, b in zip(samples, samples[1:], strict=False))
    expected = f"packets=1;clusters=1;cues=1;ms=12;mean={sum(samples) / 576:.3f};rms={math.sqrt(sum(x * x for x in samples) / 576):.3f};crossings={crossings};entropy={-sum(x * math.log2(x) for x in p):.4f}"
    assert matroska.feature(samples, media) == expected


def test_cue_tables(spark):
    media = matroska.mux_column(docs(spark), ["doc_id"])
    cues = matroska.cues(media, ["doc_id"]).where("doc_id = 4").orderBy("cue_no").collect()
    data = bytes(media.where("doc_id = 4").first().media)
    assert len(cues) == len(matroska.demux(data).cues) > 1 and all(data[c.offset : c.offset + 4] == bytes.fromhex("1f43b675") for c in cues)
    assert [c.timestamp_ns for c in cues] == sorted(c.timestamp_ns for c in cues) and {c.track for c in cues} == {1}
    assert matroska.cues(spark.createDataFrame([(1, None), (2, b"")], "doc_id long, media binary"), ["doc_id"]).count() == 0


def test_media_columns(spark):
    out = {r.doc_id: r for r in matroska.stored_features(docs(spark), ["doc_id"]).collect()}
    assert out[1].n_bytes == 0 and out[1].payload_bytes == 576 and out[1].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert out[1].feature == out[2].feature and out[4].tail_crc32 == zlib.crc32(matroska.payload_of(LONG.encode())[-32:])
    media = matroska.mux_column(docs(spark), ["doc_id"])
    assert matroska.packets(media, ["doc_id"]).where("doc_id = 4").count() == out[4].payload_bytes // 576
    assert matroska.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary"), ["doc_id"]).count() == 0
    assert matroska.stored_features(docs(spark, []), ["doc_id"]).count() == 0


# 7 and 8: classifiers


def slow_buckets(text, orders, bits):
    """Of all n-grams of characters, one by one."""
    out = []
    for n in orders:
        for i in range(len(text) - n + 1):
            h = ord(text[i])
            for c in text[i + 1 : i + n]:
                h = h * 16_777_619 % 2**32 ^ ord(c)
            out.append((h + n) * 2_654_435_761 % 2**32 >> 32 - bits)
    return out


FOLDED = ["", "a", "Ab", "ÀÉ ñ\tSS", "日本語 Тест", "x" * 50, "The  end.\n"]


@pytest.mark.parametrize("portion", [1, 3, 1 << 20])
def test_ngrams_one_by_one(monkeypatch, portion):
    monkeypatch.setattr(hashed_ngrams, "PORTION", portion)
    for text in FOLDED:
        low = " " + " ".join(text.lower().split()) + " "
        assert hashed_ngrams.folded(text.encode()) == low
        for orders in (range(1, 4), range(3, 6), range(1, 2)):
            assert sorted(np.concatenate(list(hashed_ngrams.buckets(low, orders, 13)) or [[]]).tolist()) == sorted(slow_buckets(low, orders, 13))
    assert hashed_ngrams.folded("ÀÉ".encode()) == " àé "


def test_toxicity_one_by_one():
    texts = [f"{w} text number {i}".encode() for i in range(40) for w in ("awful", "lovely")] + [t.encode() for t in FOLDED]
    toxic = np.array([(i + 1) % 2 for i in range(80)] + [0] * len(FOLDED))
    seen = np.zeros(1 << toxicity.BITS, bool)
    rows = [toxicity.features(t, seen) for t in texts]
    for t, row in zip(texts, rows, strict=True):
        assert sorted(row.tolist()) == sorted(set(slow_buckets(hashed_ngrams.folded(t), toxicity.ORDERS, toxicity.BITS)))
    ratio = toxicity.log_count_ratios(rows, toxic)
    for bucket in {b for row in rows for b in row.tolist()}:
        bad, good = (sum(bucket in set(row.tolist()) for row, y in zip(rows, toxic, strict=True) if y == k) for k in (1, 0))
        expected = np.log((bad + 1) / (40 + 2)) - np.log((good + 1) / (len(texts) - 40 + 2)) if bad + good > 1 else 0
        assert abs(ratio[bucket] - expected) < 1e-5
    model = toxicity.fit(texts, toxic)
    scores = [1 / (1 + np.exp(-model.bias - sum(float(model.weights[b]) for b in set(row.tolist())))) for row in rows]
    assert [s >= 0.3 for s in scores[:80]] == (toxic[:80] == 1).tolist()


def test_toxicity_scores_one_by_one(spark):
    texts = [(i, f"{'awful' if i % 2 else 'lovely'} text number {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels, F.lit(True))
    rows = [(i, t) for i, t in enumerate([*FOLDED, None, LONG])]
    for r in toxicity.score(docs(spark, rows), model, ["doc_id"]).collect():
        found = set(slow_buckets(hashed_ngrams.folded((dict(rows)[r.doc_id] or "").encode()), toxicity.ORDERS, toxicity.BITS))
        assert abs(r.score - 1 / (1 + np.exp(-model.bias - sum(float(model.weights[b]) for b in found)))) < 1e-6


def test_language_scores_one_by_one(spark):
    words = {"en": "the house of a man", "fr": "la maison d'un homme", "ja": "人の家は大きい"}
    table = spark.createDataFrame([(i, f"{words[lang]} {i}", lang) for i in range(60) for lang in [[*words][i % 3]]], "doc_id long, text string, lang string")
    model = language_id.train(table, F.lit(True))
    assert model.languages == ["en", "fr", "ja"]
    rows = [*((i, t) for i, t in enumerate([*FOLDED, LONG[:5000]])), *((50 + i, w) for i, w in enumerate(words.values()))]
    out = {r.doc_id: r for r in language_id.predict(docs(spark, rows), model, ["doc_id"]).collect()}
    for key, text in rows:
        if not any(map(str.isalpha, text)):
            assert (out[key].lang_pred, out[key].score) == ("und", 0.0)
            continue
        found = slow_buckets(hashed_ngrams.folded(text.encode()), language_id.ORDERS, language_id.BITS)
        mean = sum(model.table[b].astype(float) for b in found) / len(found)
        e = np.exp((mean + model.bias) / model.temperature - max((mean + model.bias) / model.temperature))
        assert abs(out[key].score - max(e) / sum(e)) < 1e-4 and out[key].lang_pred == model.languages[int(np.argmax(e))]
        assert out[key].accepted == (out[key].score >= model.least_score)
    assert [out[50 + i].lang_pred for i in range(3)] == [*words]


def test_calibration_by_trying():
    r = np.random.default_rng(2)
    known = r.integers(0, 3, 400)
    z = r.normal(0, 1, (400, 3)) + 3 * np.eye(3)[known]
    temperature, least = language_id.calibrated(z, known)
    p = np.exp(z / temperature) / np.exp(z / temperature).sum(1, keepdims=True)
    kept = p.max(1) >= least
    assert (p.argmax(1) == known)[kept].mean() >= language_id.PRECISION and 0 < kept.sum() < 400
    loss = lambda t: -np.log((np.exp(z / t) / np.exp(z / t).sum(1, keepdims=True))[np.arange(400), known]).mean()
    assert loss(temperature) <= min(loss(t) for t in (0.2, 0.5, 1, 2, 5)) + 1e-3


def test_toxicity(spark):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(words, 30)) + (" you worthless idiot" if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(0, None), (3, 1), (9999, 1)], "doc_id long, toxic int")
    table = docs(spark, [*rows, *TEXTS[:4], (None, "x")])
    usable = toxicity.fold("doc_id", 4) != 2
    model = toxicity.train(table, labels, usable)
    out = toxicity.score(table, model, ["doc_id"]).collect()
    assert len(out) == 405 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)
    held = [x for x in out if x.doc_id is not None and x.doc_id > 8 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert held and all(x.predicted == int(x.doc_id % 3 == 0) for x in held)
    none = toxicity.train(table, labels.limit(0), usable)
    assert all(x.predicted == 0 for x in toxicity.score(table, none, ["doc_id"]).collect())
    assert toxicity.score(docs(spark, []), model, ["doc_id"]).count() == 0


def test_toxicity_of_the_held_out_fold(spark):
    out = queries.op7_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.9


def test_language(spark):
    out = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_texts(spark):
    table = docs(spark, [*TEXTS, (30, "12 ² _!"), (31, "ñ")])
    model = language_id.train(table, F.lit(True))
    out = language_id.predict(table, model, ["doc_id"]).collect()
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3, 6, 30, 31)} == {1: "und", 2: "und", 3: "und", 6: "en", 30: "und", 31: "en"}
    unlearned = language_id.train(table.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language_id.predict(table, unlearned, ["doc_id"]).collect()} == {("und", 0.0)}


# 10: token files


@pytest.mark.parametrize("n", [0, 1, 2, 4096])
def test_blocks(n):
    r = np.random.default_rng(n)
    for high in (1, 2, 300, 49_408, 2**32):
        values = r.integers(0, high, n, np.uint64).astype(np.uint32)
        if n > 3:
            values[[1, 3]] = 2**32 - 1
        assert (token_files.unpack(token_files.pack(values)) == values).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORDS)
    rows = [*TEXTS, (9, "Ünï Ǆ ΐΣ Ab\u0301.\x1cx hable.$$$ 3.5, a.. <|endoftext|>"), (10, "a <|endoftext|> b <|startoftext|>"), (11, "A<|EndOfText|>b <|STARTOFTEXT|> x<|endoftext|>y <|endoftext|")]
    out = token_files.round_trip(docs(spark, rows), queries.WORDS, 2).collect()
    start = 0
    for r, (key, text) in zip(sorted(out, key=lambda r: r.start), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.round_trip(docs(spark, []), queries.WORDS, 2).count() == 0


def test_token_files_of_a_table(spark):
    out = queries.op10_token_files(spark, DATA).orderBy("doc_id").collect()
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out[:-1]]))
