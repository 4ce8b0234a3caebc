"""Whole results of the operators that SQL cannot express, against plain Python versions of them."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from lucerna.llm import common, decontaminate, lm, quality, sharding, vec
from tests.llm.test_operators import ITEM, ROWS, TEXT, WORD, by_id, counts_of, docs, library, lowered, nothing, shingles  # noqa: F401


def text_of(i):
    return TEXT[i] if i is not None else ROWS[1][1]


def measures_of(s):
    n, chars, symbols, dup, repeats, lines = counts_of(s)
    return {"word_length": chars / n, "symbols": symbols / n, "dup_lines": dup / lines, "repeats": repeats / n} if n else {}


def rounded(v):
    """A value as the sketch keeps it: its bucket's middle."""
    if v <= quality.SMALLEST:
        return 0.0
    return 2 / (quality.GAMMA + 1) * quality.GAMMA ** math.ceil(math.log(v) / math.log(quality.GAMMA))


def kept_ids(rows):
    """Rows (id, text, lang, source) that the quality rules keep, from sorted values of every group."""
    measured = [(i, lang, source, measures_of(t)) for i, t, lang, source in rows]

    def quartiles(name, fits):
        v = sorted(rounded(m[name]) for _, lang, source, m in measured if name in m and fits(lang, source))
        return len(v), *(v[max(0, math.ceil(len(v) * p) - 1)] for p in (0.25, 0.75))

    kept = set()
    for i, lang, source, m in measured:
        n, _, _, _, repeats, _ = counts_of(next(t for j, t, _, _ in rows if j == i))
        ok = bool(m) and n >= 50 and 100 * repeats <= 50 * n
        for name, (least, both) in quality.MEASURES.items() if ok else ():
            whole = quartiles(name, lambda a, b: True)
            by_lang = quartiles(name, lambda a, b, lang=lang: a == lang)
            own = quartiles(name, lambda a, b, lang=lang, source=source: (a, b) == (lang, source))
            prior = quality.PRIOR_ROWS
            q = []
            for k in (1, 2):
                mid = (by_lang[0] * by_lang[k] + prior * whole[k]) / (by_lang[0] + prior)
                q.append((own[0] * own[k] + prior * mid) / (own[0] + prior))
            spread = max(q[1] - q[0], least)
            ok &= m[name] <= q[1] + quality.FENCE * spread and (not both or m[name] >= q[0] - quality.FENCE * spread)
        if ok:
            kept.add(i)
    return kept


def test_quality_verdicts(docs):  # noqa: F811
    want = kept_ids([(i, t or "", lang, source) for i, t, lang, source, *_ in ROWS])
    rows = by_id(quality.quality(docs))
    assert {i for i, r in rows.items() if r.kept} == want
    assert want


def test_quality_fences_reject_outliers(spark):
    rows = [(i, " ".join(["alpha", "beta", "gamma"][(i + k) % 3] + str(k) for k in range(60 + i % 9)), ("en", None)[i % 2], "s") for i in range(60)]
    rows += [(100, " ".join("$$$$$$ w" + str(k) for k in range(70)), "en", "s"), (101, " ".join("x" * 30 + str(k) for k in range(70)), None, "s"), (102, " ".join(str(k) for k in range(70)), "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id for r in quality.quality(df).collect() if r.kept}
    assert got == kept_ids(rows) and not got & {100, 101}


def item_words(s):
    return re.findall(rb"[0-9a-z\x80-\xff]+", lowered(s).encode())


def grams(w, n):
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def leaked(texts, items, threshold=decontaminate.THRESHOLD, overlap=decontaminate.OVERLAP):
    """{(document, item): (score, question share, answer share)}: every window, of the item's length class, of every text against every item."""
    parts = {i: [item_words(p) for p in decontaminate.split_item(t)] for i, t in items if t is not None and item_words(t)}
    full = {i: collections.Counter(q + a) for i, (q, a) in parts.items()}
    df = collections.Counter(t for c in full.values() for t in c)
    mean = sum(sum(c.values()) for c in full.values()) / len(full)
    idf = {t: math.log(1 + (len(full) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    k1, b = decontaminate.K1, decontaminate.B
    impact = {i: {t: idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * sum(c.values()) / mean)) for t, n in c.items()} for i, c in full.items()}
    found = {}
    for d, s in texts.items():
        w = item_words(s)
        for i, own in impact.items():
            stride = 16
            while stride < sum(full[i].values()):
                stride *= 4
            windows = max(1, math.ceil(len(w) / stride) - 1)
            for k in range(windows):
                passage = w[k * stride : len(w) if k + 1 == windows else (k + 2) * stride]
                terms = set(passage)
                score = sum(v for t, v in own.items() if t in terms) / sum(own.values())
                shares = []
                for p in parts[i]:
                    n = min(5, len(p))
                    shares.append(len(grams(p, n) & grams(passage, n)) / len(grams(p, n)) if n else 1.0)
                if score >= threshold and min(shares) >= overlap and score > found.get((d, i), (0,))[0]:
                    found[d, i] = (score, *shares)
    return found


def near(item):
    words = item.split(" ")
    words[3] = "changed"
    return " ".join(words)


ITEMS = [(1, ITEM), (2, near(ITEM)), (3, None), (4, " "), (5, "one"), (6, TEXT[3].split("\n")[0] + " " + TEXT[4]), (7, "Never seen here. Nor this."), (8, TEXT[70][:200]), (9, "a b c d e")]


@pytest.mark.parametrize(("segment", "at_once"), [(16 << 20, 8), (60, 2), (1, 1)])
def test_leaks(docs, spark, monkeypatch, segment, at_once):  # noqa: F811
    """The same pairs and scores however the items are cut into indexes."""
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(docs, items).collect()}
    want = leaked({i: text_of(i) for i in [*TEXT, None]}, ITEMS)
    assert set(got) == set(want) and len(want) > 3
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-4)


def test_lm_scores_step_by_step(docs, monkeypatch):  # noqa: F811
    import numpy as np
    import pyarrow as pa

    held, train = {}, lm.train

    def kept(encoded, shared):
        held.update(weights=train(encoded, shared), tables=shared.value)
        return held["weights"]

    monkeypatch.setattr(lm, "WORDS", 40)
    monkeypatch.setattr(lm, "train", kept)
    rows = by_id(lm.scores(docs))
    w, t = {k: v.astype(np.float64) for k, v in held["weights"].items()}, held["tables"]
    size, klass = t.shape.size, t.shape.klass
    assert size == 40
    toks = {i: WORD.findall(lowered(text_of(i))) for i in rows}
    c = collections.Counter(x for i, words in toks.items() if zlib.crc32(str("" if i is None else i).encode()) % 10 for x in words)
    common = {}
    table = t.find()
    for x in c:
        h = lm._hashes(*vec.buffers(pa.array([x])))[0]
        at = int(table.find(h)[0])
        if 0 <= at < size:
            common[x] = at
    assert len(common) == size and min(c[x] for x in common) >= max(n for x, n in c.items() if x not in common)
    rare = [n for x, n in c.items() if x not in common]

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    hidden = len(w["state"])
    for i, words in toks.items():
        h, before, total = np.zeros(hidden), size + 2, 0.0
        for x in [*words, None]:
            token = size + 1 if x is None else common.get(x, size)
            a, g = w["input"][before] + w["bias"], h @ w["state"]
            z, r = sigmoid(a[:hidden] + g[:hidden]), sigmoid(a[hidden : 2 * hidden] + g[hidden : 2 * hidden])
            n = np.tanh(a[2 * hidden :] + r * g[2 * hidden :])
            h = (1 - z) * n + z * h
            total += math.log10(softmax(h @ w["class_w"] + w["class_b"])[klass[token]])
            members = np.flatnonzero(klass == klass[token])
            total += math.log10(softmax(w["word_w"][members] @ h + w["word_b"][members])[list(members).index(token)])
            if token == size:
                total += math.log10((c[x] + 0.1) / (sum(rare) + 0.1 * (len(rare) + 1)))
            before = token
        assert rows[i].score == pytest.approx(total, rel=1e-4)


def removed(texts):
    """{document: lines that go}: each line against all earlier ones, in order of id."""
    short, sets, out = set(), [], {}
    for i in sorted(texts, key=lambda i: (i is not None, i)):
        out[i] = []
        for k, line in enumerate(texts[i].split("\n")):
            w = WORD.findall(line.lower())
            x = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or tuple(w)
            if not w:
                continue
            if (x in short) if len(w) < 5 else any(100 * len(x & y) >= 80 * len(x | y) for y in sets):
                out[i].append(k)
            short.add(x) if len(w) < 5 else sets.append(x)
    return out


def test_pipeline_rows(docs, spark, tmp_path, library):  # noqa: F811
    import corpus_pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS[:4], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    good = kept_ids([(i, t or "", lang, source) for i, t, lang, source, *_ in ROWS])
    texts = {i: text_of(i) for i in good}
    gone, cut = removed(texts), {}
    for i, s in texts.items():
        left = [x for k, x in enumerate(s.split("\n")) if k not in gone[i]]
        if any(WORD.search(x) for x in left):
            cut[i] = "\n".join(left)
    sets, least = {i: shingles(s) for i, s in cut.items() if i is not None}, {}
    for i in sorted(sets):  # components by repeated merging
        linked = {least[j] for j in least if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        to = min([i, *linked])
        least = {j: to if c in linked else c for j, c in least.items()} | {i: to}
    one = {i: s for i, s in cut.items() if i is None or least[i] == i}
    hit = {d for d, _ in leaked(one, ITEMS[:4])}
    want = {i: s for i, s in one.items() if i not in hit}

    got = by_id(corpus_pipeline.run(spark, folder))
    assert set(got) == set(want) and hit
    for i, s in want.items():
        ids = library.encode(s, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest, hashlib.sha256(s.encode()).hexdigest())


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup", "near_dedup", "decontamination"])
def test_stages_take_nulls_clashing_names_and_empty_tables(spark, tmp_path, stage):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    shape = "doc_id long, text string, lang string, source string, n_chars long, row string, counts string, _id string, gone string, hash string"
    body = " ".join(f"word{k}" for k in range(80))
    rows = [(None, None, None, None, None), (None, body, None, None, None), (None, body, "en", "s", 3), (1, "", "en", None, 0), (2, body + " tail", None, "s", 5), (2, body + " tail", None, "s", 5)]
    table = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], shape)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, table, folder)
    kept = out.collect()
    assert out.columns == table.columns and 0 < len(kept) <= len(rows) and {tuple(r)[5:] for r in kept} == {("x",) * 5}
    assert run(spark, table.limit(0), folder).count() == 0


def chained(*values):
    """The session's 64-bit hash of several values: each seeds the next, nulls count for nothing; int is 4 bytes, ("long", x) 8."""
    h = 42
    for v in values:
        if isinstance(v, tuple):
            v = None if v[1] is None else v[1].to_bytes(8, "little", signed=True)
        elif isinstance(v, int):
            v = v.to_bytes(4, "little", signed=True)
        elif isinstance(v, str):
            v = v.encode()
        h = h if v is None else xxhash.xxh64_intdigest(v, seed=h)
    return h - (1 << 64) if h >> 63 else h


def winner(key, shards, seed):
    return max((chained(key, seed, s), s) for s in range(shards))[1]


def test_every_shard_and_slot(spark):
    """Winners of the draws, buckets and Fisher-Yates of all rows, in plain Python; one row is repeated two hundred times."""
    seed, shards, bucket_bytes = 17, 5, 2000
    rows = [(i, f"text ñ {i} " * (i % 9)) for i in range(300)] + [(None, "no id"), (None, None), (301, None), (301, ""), (302, "long " * 3000)]
    rows += [(303, "again")] * 200 + [(304, "again"), (5, "same id")]
    buckets = math.ceil(sum(len((t or "").encode()) + 16 for _, t in rows) / shards / bucket_bytes)
    groups, seen = collections.defaultdict(list), collections.Counter()
    for i, t in rows:
        seen[i, t] += 1
        key = None if i is None else str(i)
        parts = (("long", i), t)
        by_id = chained(key or "", seed + 1)
        spread = chained(("long", by_id), ("long", chained(*parts)), ("long", chained(1, *parts)), ("long", seen[i, t]))
        groups[winner(key, shards, seed), spread % buckets].append((by_id, spread, i, t))
    want, base = [], collections.Counter()
    for shard, bucket in sorted(groups):
        pile = sorted(groups[shard, bucket], key=lambda r: r[:2])
        draw = np.random.default_rng([seed, shard, bucket])
        for last in range(len(pile) - 1, 0, -1):
            other = int(draw.integers(0, last + 1))
            pile[last], pile[other] = pile[other], pile[last]
        for _, _, i, t in pile:
            grown = winner(None if i is None else str(i), shards + 1, seed)
            want.append((shard, base[shard], i, t, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), grown))
            base[shard] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.write_shards(docs, common.scratch(spark, "t"), shards=shards, seed=seed, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.shard, r.slot, r.row.doc_id, r.row.text, r.size, r.text_crc32, r.grown_shard) for r in got) == sorted(want)
