"""Repeated rows, very long texts and words, odd code points: results stay whole and equal rows get equal results."""

import collections
import hashlib
import math
import random
import struct
import time
import zlib

import pytest

from lucerna.llm import bpe, common, decontaminate, line_dedup, lm, near_dup, quality, secrets, sharding, token_files, tokens
from tests.llm.test_brute_force import removed
from tests.llm.test_operators import counts_of, shingles

DRAW = random.Random(9)
WORDS = ["".join(DRAW.choice("abcdefgh") for _ in range(DRAW.randrange(2, 7))) for _ in range(3000)]
BODY = " ".join(DRAW.choice(WORDS) for _ in range(90))
LONG = "\n".join(" ".join(DRAW.choice(WORDS) for _ in range(400)) for _ in range(150))
LINE = " ".join(DRAW.choice(WORDS) for _ in range(20_000))
ODD = "₝'ll ͸࢏ x՘y \U000e0001 ﻿bom   sep 1٠2 " + BODY
ROWS = [(7, BODY)] * 3 + [(None, BODY)] * 2 + [(8, LONG), (9, LINE), (10, "x" * 20_000), (11, ODD), (12, "0af3" * 2_000), (13, LONG[:-1]), (14, None), (14, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string").repartition(3).cache()


def collected(df):
    """All rows by id and, as ids repeat, each with its count."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    assert {i: len(x) for i, x in out.items()} == {i: sum(j == i for j, _ in ROWS) for i, _ in ROWS}
    return out


def same(rows):
    return {i: x[0] for i, x in rows.items() if all(r == x[0] for r in x) or pytest.fail(f"rows of {i} differ")}


TEXT = {i: t or "" for i, t in ROWS}


def test_encoders(docs, spark):
    library = bpe.library(tokens.default_path())
    encoded, counts = same(collected(tokens.encode_decode(docs))), same(collected(tokens.count_tokens(docs)))
    files = token_files.write_tokens(docs, common.scratch(spark, "t"), file_bytes=50_000)
    stored = collected(token_files.read_tokens(files))
    for i, s in TEXT.items():
        ids = library.encode(s, add_special_tokens=False).ids
        assert encoded[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert encoded[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (counts[i].n_tokens, counts[i].n_bytes) == (len(ids), len(s.encode()))
        assert {r.ids_crc32 for r in stored[i]} == {zlib.crc32(struct.pack(f"<{len(ids) + 1}I", *ids, 0))}
    spans = sorted((r.start, r.start + r.n_tokens) for x in stored.values() for r in x)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_counts_and_secrets(docs):
    for i, r in same(collected(quality.quality(docs))).items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(TEXT[i])[:5]
    found = same(collected(secrets.secrets(docs)))
    assert found[12].n_hex == 1 and found[12].spans == "hex:0:8000" and found[14].spans == ""


def test_shards(docs, spark):
    rows = sharding.write_shards(docs, common.scratch(spark, "t"), shards=4, bucket_bytes=100_000).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_duplicates(docs):
    rows = collected(near_dup.near_duplicates(docs, 85))
    assert {r.n_shingles for r in rows[8]} == {len(shingles(LONG))}
    assert {r.component_id for i in (7, 8, 11, 13) for r in rows[i]} == {7, 8}
    kept = near_dup.keep_one(docs, 85)
    assert {r.doc_id for r in kept.collect()} == {None, 7, 8, 9, 10, 12, 14}


def test_lines(docs):
    rows = collected(line_dedup.removed_lines(docs))
    want = removed({i: s for i, s in TEXT.items()})
    for i in (8, 9, 10, 11, 12, 13):
        assert [r.removed for r in rows[i]] == [want[i]]
    assert sorted(map(len, (r.removed for r in rows[None]))) == [0, 1] and all(r.removed == [0] for r in rows[7])


def test_leaks_and_scores(docs, spark):
    items = spark.createDataFrame([(1, " ".join(BODY.split()[20:60])), (2, " ".join(LINE.split()[15_000:15_040]))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(0, 1), (0, 1), (7, 1), (7, 1), (7, 1), (9, 2), (11, 1)]
    scored = collected(lm.scores(docs))
    for x in scored.values():
        assert all(r.base_score == pytest.approx(x[0].base_score) and r.score == pytest.approx(x[0].score, rel=1e-5) and r.score < 0 for r in x)


def windows_reach(value, bits):
    """Whether some window's entropy, counted anew for each, reaches `bits`."""
    n = secrets.WINDOW
    return any(-sum(c / n * math.log2(c / n) for c in collections.Counter(value[i : i + n]).values()) >= bits for i in range(len(value) - n + 1))


def test_long_candidates(spark):
    """Megabytes without a blank: paths, slugs, random letters, and very many candidates in one text."""
    draw = random.Random(4)
    dull = lambda n: "".join(draw.choice("abcA1") for _ in range(n))
    letters = "".join(draw.choice(secrets.ALPHABET[:62]) for _ in range(100_000))
    # one window in many that reaches the bits, at every place round the ends of the pieces
    hidden = [dull(k) + letters[:20] + dull(150) for k in range(140, 240, 7)]
    texts = ["ab1-" * 250_000, "key " + "ab1-" * 250_000 + "ab1", letters, " ".join(letters[k : k + 24] for k in range(0, 48_000, 24)), *hidden, *(dull(500) for _ in range(20))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.secrets(rows).collect()}
    assert time.time() - began < 120
    assert got[1] == "" and got[2] == "entropy:0:100000"
    many = got[3].split(",")
    assert len(many) > 1900 and all((int(a) % 25, int(b) - int(a)) == (0, 24) for _, a, b in (s.split(":") for s in many))
    for k in range(4, len(texts)):
        assert (got[k] != "") == windows_reach(texts[k], secrets.BITS["mixed"]), texts[k]
    assert sum(got[k] != "" for k in range(4, 4 + len(hidden))) >= 10 and not all(got.values())
