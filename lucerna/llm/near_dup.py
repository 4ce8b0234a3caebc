"""MinHash near-duplicates with sequential Bayesian verification (operator 6).

Documents with one shingle set are one node. Nodes that share a band of their
signature are candidates, but pairs of a band's bucket are never all written
out: each round compares the members of a bucket with a few leaders of it, and
only while they lie in different components. Links found are merged before
the next round, and leaders are retired from their bucket. What is left is
compared in full: small buckets by pairs of rows, larger ones in blocks whose
pairs are compared in memory, each pair in the first band it shares, so that
only links that join two components are ever written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import common, vec

SHINGLE = 5
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
#: Hashes compared before each decision, and the chance of a miss at which a pair is dropped.
BATCH = 20
MISS = 1e-6
#: Members up to which the pairs of a bucket are written out; larger buckets are compared in blocks.
FEW = 16
#: Bytes of shingle sets of a block, and its members at most.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 2048
#: Copies of a member that the blocks of its bucket may take on average; if more, another round with leaders thins the buckets first.
REPLICAS = 4
#: Document ids up to which the texts to verify are picked by a broadcast list (8 bytes each).
BROADCAST_IDS = 1_000_000
_SEED = 0x5EED
_FEATURES = "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary"


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    base = vec.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) + np.uint64(_SEED))
    return base[:HASHES] | np.uint64(1), base[HASHES:]


def text_shingles(data: np.ndarray, offsets: np.ndarray):
    """Distinct shingle hashes of each row, ascending, and each row's first."""
    lowered = vec.lower_ascii(data)
    starts, ends, first = vec.word_spans(lowered, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    shingles, at = vec.shingle_hashes(vec.span_hashes(lowered, starts, ends), first, SHINGLE)
    return vec.unique_by_row(shingles, at)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash signatures (rows x HASHES, 32 bits) of rows with at least one value."""
    out = np.empty((len(first) - 1, HASHES), np.uint32)
    scale, shift = _multipliers()
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((values * scale[k] + shift[k]) >> np.uint64(32), first[:-1])
    return out


def _features(sets: bool = False):
    """doc_id, n, k1, k2 (key of the set), bands, sig of each text, and the set itself if asked for."""

    def run(batches):
        weight = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for part, data, offsets in vec.text_slices(batches):
            values, first = text_shingles(data, offsets)
            n = np.diff(first)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bands, sigs = [None] * len(n), [None] * len(n)
            if full.size:
                starts = first[:-1][full]
                k1[full] = np.add.reduceat(vec.mix(values), starts).view(np.int64)
                k2[full] = np.add.reduceat(vec.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).view(np.int64)
                sig = signatures(values, np.append(starts, len(values)))
                grouped = vec.mix(sig.reshape(-1, BANDS, ROWS).astype(np.uint64) + weight)
                folded = vec.mix(grouped.sum(axis=2, dtype=np.uint64)).view(np.int64)
                short = sig.astype("<u2")
                for j, i in enumerate(full.tolist()):
                    bands[i], sigs[i] = folded[j], short[j].tobytes()
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            names = ["doc_id", "n", "k1", "k2", "bands", "sig"]
            if sets:
                columns.append(pa.array([values[x:y].astype("<u8").tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()))
                names.append("shingles")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch, the matches below which P(similarity >= threshold | matches) < miss under a uniform prior.

    With m of n hashes equal the posterior is Beta(m + 1, n - m + 1), whose
    upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while True:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
        out.append(m)
    return out


def _likely(threshold: float):
    def run(batches):
        least = least_matches(threshold)
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            live, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (left[live, part] == right[live, part]).sum(axis=1)
                keep = matches >= m
                live, matches = live[keep], matches[keep]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return run


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text_a", vec.CHUNK_BYTES // 4):
                (va, fa), (vb, fb) = (text_shingles(*vec.buffers(vec.text_array(part.column(c)))) for c in ("text_a", "text_b"))
                rows = np.concatenate([vec.rows_of(fa), vec.rows_of(fb)])
                values = np.concatenate([va, vb])
                order = np.lexsort((values, rows))
                v, r = values[order], rows[order]
                both = np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=part.num_rows)
                union = np.diff(fa) + np.diff(fb) - both
                yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (union > 0)))

    return run


def block_links(percent: int):
    """Links (a, b) between components of the members of one bucket, or of two blocks of it.

    Signatures are compared batch by batch, and pairs that could reach the
    similarity on their full sets; what a link joins is one component from then
    on. A pair is left to the first band that it shares.
    """

    def run(group: pa.Table) -> pa.Table:
        least, size = least_matches(percent / 100), group.num_rows
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u2").reshape(size, HASHES)
        bands = np.array(group["bands"].to_pylist(), np.int64).reshape(size, BANDS)
        n, rep, label, side = (group[c].to_numpy().copy() for c in ("n", "rep", "comp", "side"))
        band, across = group["band"][0].as_py(), group["i"][0].as_py() != group["j"][0].as_py()
        found, ids = np.unique(np.frombuffer(b"".join(group["shingles"].to_pylist()), "<u8"), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(n)])
        held = np.zeros(len(found), bool)
        links = []
        for i in range(size - 1):
            other = np.arange(i + 1, size)
            near = (label[other] != label[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))
            if across:
                near &= side[other] != side[i]
            other = other[near]
            matches = np.zeros(len(other), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sig[other, part] == sig[i, part]).sum(axis=1)
                keep = matches >= m
                other, matches = other[keep], matches[keep]
            other = other[(bands[other] == bands[i]).argmax(axis=1) == band]
            if not other.size:
                continue
            held[ids[at[i] : at[i + 1]]] = True
            first = np.concatenate([[0], np.cumsum(n[other])])
            where = np.repeat(at[other] - first[:-1], n[other]) + np.arange(first[-1])
            both = np.add.reduceat(held[ids[where]].astype(np.int64), first[:-1])
            held[ids[at[i] : at[i + 1]]] = False
            for j in other[100 * both >= percent * (n[other] + n[i] - both)].tolist():
                if label[j] != label[i]:
                    links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _blocks(mixed: DataFrame, buckets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of the members of larger buckets (band, bucket, blocks)."""
    own = common.stored(mixed.join(common.small(buckets, BROADCAST_IDS), ["band", "bucket"]).select("band", "bucket", "blocks", "rep", "comp"), "crowded")
    reps = common.stored(own.select(F.col("rep").alias("doc_id")).distinct(), "crowded-reps")
    full = texts.join(common.small(reps, BROADCAST_IDS), "doc_id", "left_semi").mapInArrow(_features(True), f"{_FEATURES}, shingles binary")
    full = full.dropDuplicates(["doc_id", "k1", "k2", "n"]).where("n > 0").select(F.col("doc_id").alias("rep"), "n", "bands", "sig", "shingles", F.posexplode("bands").alias("band", "bucket"))
    rows = full.join(common.small(own, BROADCAST_IDS // 4), ["band", "bucket", "rep"])
    rows = rows.withColumn("side", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "bucket", F.least("side", "y").alias("i"), F.greatest("side", "y").alias("j"), "side", "rep", "comp", "n", "bands", "sig", "shingles")
    return rows.groupBy("band", "bucket", "i", "j").applyInArrow(block_links(percent), "a long, b long")


def _narrow(df: DataFrame) -> DataFrame:
    """Short lists in as many files as the cluster has room for tasks, not one for each shuffle partition."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a < b) that can reach a lesser node; comp is the least.

    Every node hooks onto its least neighbour, chains are halved until they
    are stars, and edges are drawn anew between the stars' centres. No round
    needs more than a minimum for each node. Lists of few nodes are broadcast.
    """
    labels = None
    while True:
        up = common.stored(_narrow(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))), "hooks")
        n = up.count()
        if not n:
            return labels if labels is not None else up.select("node", F.col("up").alias("comp"))
        held = F.broadcast if n <= BROADCAST_IDS else lambda df: df
        while True:
            top = held(up.select(F.col("node").alias("n2"), F.col("up").alias("u2")))
            jumped = common.stored(_narrow(up.join(top, F.col("up") == F.col("n2"), "left").select("node", F.coalesce("u2", "up").alias("up"), F.col("u2").isNotNull().alias("moved"))), "jumps")
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        own = up.select("node", F.col("up").alias("comp"))
        first, second = held(up.toDF("na", "ua")), held(up.toDF("nb", "ub"))
        if labels is not None:
            own = labels.join(first, F.col("comp") == F.col("na"), "left").select("node", F.coalesce("ua", "comp").alias("comp")).union(own)
        labels = common.stored(_narrow(own), "labels")
        redrawn = edges.join(first, F.col("a") == F.col("na"), "left").join(second, F.col("b") == F.col("nb"), "left")
        redrawn = redrawn.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).where("a <> b")
        edges = common.stored(_narrow(redrawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "edges")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: signatures first, then full sets."""
    one = nodes.select(F.col("rep").alias("ra"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    two = nodes.select(F.col("rep").alias("rb"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    sized = pairs.join(one, F.col("a") == F.col("ra")).join(two, F.col("b") == F.col("rb"))
    sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
    likely = common.stored(sized.mapInArrow(_likely(percent / 100), "a long, b long"), "likely")
    wanted = common.stored(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), "wanted")
    held = common.stored(texts.join(common.small(wanted, BROADCAST_IDS), "doc_id", "left_semi"), "texts")
    one, two = held.toDF("ia", "text_a"), held.toDF("ib", "text_b")
    both = likely.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib")).select("a", "b", "text_a", "text_b")
    out = common.stored(both.mapInArrow(_exact(percent), "a long, b long"), "links")
    common.dropped(likely, wanted, held)
    return out


def _shingle_rows(batches):
    for part, data, offsets in vec.text_slices(batches):
        values, first = text_shingles(data, offsets)
        reps = np.asarray(part.column("doc_id"), np.int64)[vec.rows_of(first)]
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(values.view(np.int64))], ["rep", "shingle"])


def _lone_shingles(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles of a document no other of these documents has; none are left out."""
    reps = common.stored(reps.select(F.col("rep").alias("doc_id")).distinct(), "open")
    few = reps.count() <= BROADCAST_IDS
    held = texts.join(F.broadcast(reps) if few else reps, "doc_id", "left_semi")
    rows = held.mapInArrow(_shingle_rows, "rep long, shingle long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    return common.stored(single.groupBy("rep").agg(F.count("*").alias("lone")), "lone")


def _linkable(mixed: DataFrame, sizes: DataFrame, lone: DataFrame, percent: int) -> DataFrame:
    """Members that can still link with another of their bucket.

    No other document shares x's lone shingles, so with any y the similarity
    is at most (n_x - lone_x) / (lone_x + n_y); x goes if even the bucket's
    smallest n_y is too large for that.
    """
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df
    rows = mixed.join(few(common.stored(sizes.join(few(mixed.select("rep").distinct()), "rep", "left_semi").join(few(lone), "rep", "left").select("rep", "n", F.coalesce("lone", F.lit(0)).alias("lone")).distinct(), "sizes")), "rep")
    rows = common.stored(rows, "sized")
    least = rows.groupBy("band", "bucket").agg(F.min("n").alias("least"))
    rows = rows.join(least, ["band", "bucket"]).where(100 * (F.col("n") - F.col("lone")) >= percent * (F.col("lone") + F.col("least")))
    rows = common.stored(rows.select("band", "bucket", "rep", "comp", "n"), "linkable")
    open_ = rows.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "bucket")
    return common.stored(rows.join(open_, ["band", "bucket"], "left_semi"), "mixed")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B| over sets of 5-word shingles.

    Returns doc_id, n_shingles, component_id (least id reachable), kept
    (doc_id = component_id). Words are split at ASCII white space, A-Z lower
    cased; a text with fewer than five words is one shingle. A text without
    words, or null, is linked with nothing, as is a row with a null id (its
    component is null and it is kept). Rows of one id are one node; it is
    linked where any of its sets is. Extra columns are ignored. The chance that a link of similarity s
    is in no common band is (1 - s^4)^25: 2 in a million at 0.8. A text may be
    of any length; repeated rows get a row each; an empty table gives an empty
    result.
    """
    common.bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    features = common.stored(rows.mapInArrow(_features(), _FEATURES), "features")
    linked = features.where("n > 0 AND doc_id IS NOT NULL")
    sets = common.stored(linked.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "sets")
    reps = sets.select(*(F.col(c).alias(f"_{c}") for c in ("k1", "k2", "n", "rep")))
    nodes = linked.join(reps, (F.col("doc_id") == F.col("_rep")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") == F.col("_n")))
    nodes = common.stored(nodes.dropDuplicates(["doc_id", "k1", "k2", "n"]).select(F.col("doc_id").alias("rep"), "n", "bands", "sig"), "nodes")
    texts = rows.where("doc_id IS NOT NULL")
    sizes = nodes.groupBy("rep").agg(F.max("n").alias("n"))

    banded = nodes.select("rep", F.posexplode("bands").alias("band", "bucket")).distinct()
    heads = banded.groupBy("band", "bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("most")).where("head < most").select("band", "bucket", "head")
    heads = common.stored(heads, "heads")
    members = common.stored(banded.join(heads, ["band", "bucket"]).where("rep <> head").select("band", "bucket", "rep", "head"), "members")

    links = comps = lone = None
    pairs, leaders = members.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), 1
    while True:
        pairs = common.stored(pairs, "pairs")
        found = _verified(pairs, nodes, texts, percent)
        links = found if links is None else links.union(found)
        comps = components(links)
        state = members.join(comps, F.col("rep") == F.col("node"), "left").select("band", "bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
        state = common.stored(state, "state")
        open_ = state.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "bucket")
        mixed = common.stored(state.join(open_, ["band", "bucket"], "left_semi"), "mixed")
        common.dropped(pairs, state)
        if mixed.isEmpty():
            break
        lone = _lone_shingles(mixed, texts) if lone is None else lone
        mixed = _linkable(mixed, sizes, lone, percent)
        room = F.greatest(F.lit(2), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.max("n")))))
        buckets = common.stored(mixed.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.ceil(F.count("*") / room).alias("blocks")), "buckets")
        cost = buckets.agg(F.sum("m"), F.sum(F.when(F.col("m") > FEW, F.col("m") * F.col("blocks")))).first()
        if not cost[0]:
            break
        if (cost[1] or 0) <= REPLICAS * cost[0]:
            small = mixed.join(common.small(buckets.where(F.col("m") <= FEW).select("band", "bucket"), BROADCAST_IDS), ["band", "bucket"], "left_semi")
            other = small.select("band", "bucket", F.col("rep").alias("head"), F.col("comp").alias("head_comp"))
            pairs = small.join(other, ["band", "bucket"]).where(F.col("comp") < F.col("head_comp")).select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
            more = _verified(common.stored(pairs, "pairs"), nodes, texts, percent)
            large = common.stored(buckets.where(F.col("m") > FEW).select("band", "bucket", "blocks"), "large")
            if not large.isEmpty():
                more = more.union(common.stored(_blocks(mixed, large, texts, percent), "links"))
            if not more.isEmpty():
                comps = components(links.union(more))
            break
        # another round: more leaders, each compared with the members of its bucket, and retired from it
        leaders *= 16
        part = F.pmod(F.xxhash64("rep"), F.lit(leaders))
        other = mixed.groupBy("band", "bucket", part.alias("part")).agg(F.min(F.struct("rep", "comp")).alias("head"))
        other = common.stored(other.select("band", "bucket", F.col("head.rep").alias("head"), F.col("head.comp").alias("head_comp")), "heads")
        pairs = mixed.join(other, ["band", "bucket"]).where(F.col("comp") != F.col("head_comp")).select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
        members = common.stored(mixed.join(other.select("band", "bucket", F.col("head").alias("rep")), ["band", "bucket", "rep"], "left_anti").select("band", "bucket", "rep"), "members")

    own = features.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = linked.select("doc_id", "n", "k1", "k2").join(sets, ["k1", "k2", "n"])
    rest = rest.join(comps, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    return own.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that `near_duplicates` keeps: one document of each component.

    Rows that share the kept id all stay, as do rows with a null id or without
    words. Columns may have any names. An empty table gives an empty result.
    """
    gone = near_duplicates(docs, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    gone = common.stored(gone.distinct(), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(common.small(gone, BROADCAST_IDS), F.col("row")[id_col].cast("long") == F.col("_gone"), "left_anti")
    return rows.select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), 85)
