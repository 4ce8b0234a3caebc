"""Decision graphs.

`nodes`: protocol_id, node_id, kind, text, section, source_ref. `edges`:
protocol_id, edge_pos, source, target, label, reference, independent. All
graphs are worked on at once: what asks for a graph (starts, options, cases) is
dealt out in parts, and a task has such a part and the edges of its protocol. A
graph of more than EDGES edges is in no task: it is followed by joins, level by
level. A walk is a machine: a graph is compiled to one move for each node, and a case
makes one move after the other on a stack of stretches still to go.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.functions import text as X
from lucerna.operators import index as I
from lucerna.operators import lineage, scan

# Labels of context edges, kinds of nodes, outcomes of a walk, headings of rendered text.
CONTEXT_LABELS = ("contexto",)
START, DECISION = "start", "decision"
COMPLETE, PENDING, NO_ROUTE, UNKNOWN_DATUM = "completo", "pendiente", "sin_ruta", "dato_desconocido"
WALK_HEADING = "Recorrido del árbol clínico "
CONSULT_HEADING, CONSULT_END = "Ramas del árbol clínico ", " relacionadas con la consulta:"
OVERVIEW_HEADING, OVERVIEW_END = "Inicio del árbol clínico ", ", en el orden del recorrido:"
NOTES_HEADING = "Además, según el diagrama:"
TREE_FILE = "Árbol clínico "

FIRST_NODES = 10


def is_context(label: Column) -> Column:
    return F.lower(X.text(label)).isin(*CONTEXT_LABELS)


def traversable(edges: DataFrame) -> DataFrame:
    """P16."""
    return edges.where(~F.coalesce("reference", F.lit(False)) & ~is_context(F.col("label")))


def support(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(protocol_id, node_id, support_id, text, pos) by incoming reference edges, then outgoing context edges."""
    into = edges.where(F.coalesce("reference", F.lit(False))).select("protocol_id", F.col("target").alias("node_id"), F.col("source").alias("support_id"), F.struct(F.lit(0), "edge_pos").alias("pos"))
    out = edges.where(is_context(F.col("label"))).select("protocol_id", F.col("source").alias("node_id"), F.col("target").alias("support_id"), F.struct(F.lit(1), "edge_pos").alias("pos"))
    named = nodes.select("protocol_id", F.col("node_id").alias("support_id"), "text")
    return into.union(out).join(named, ["protocol_id", "support_id"]).select("protocol_id", "node_id", "support_id", "text", "pos")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(protocol_id, problem): not just one start, edges to unknown nodes, decisions with fewer than two ways out."""
    starts = nodes.groupBy("protocol_id").agg(F.count_if(F.col("kind") == START).alias("n")).where("n <> 1").select("protocol_id", F.lit("starts").alias("problem"))
    ends = edges.select("protocol_id", F.explode(F.array("source", "target")).alias("node_id")).join(nodes, ["protocol_id", "node_id"], "left_anti").select("protocol_id", F.concat(F.lit("unknown node: "), F.col("node_id")).alias("problem"))
    ways = traversable(edges).groupBy("protocol_id", F.col("source").alias("node_id")).agg(F.count("*").alias("ways"))
    few = nodes.where(F.col("kind") == DECISION).join(ways, ["protocol_id", "node_id"], "left").where(F.coalesce("ways", F.lit(0)) < 2).select("protocol_id", F.concat(F.lit("dead decision: "), F.col("node_id")).alias("problem"))
    return starts.union(ends).union(few).distinct()


#: Nodes from which one task of a graph follows the edges, and columns of a task's table of reach (64 marks each).
STARTS, WORDS = 256, 64
#: Edges up to which a task holds a graph; rounds after which reach that is known is taken out, and levels that are kept apart.
EDGES, ROUNDS, LEVELS = 100_000, 8, 32
#: Rows of a level up to which they are broadcast (they carry their routes).
LEVEL_ROWS = 20_000


def _ways(edges: DataFrame) -> DataFrame:
    return traversable(edges).select("protocol_id", "source", "target", "label", F.col("edge_pos").cast("int").alias("edge_pos"))


def _dealt(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """The edges of each protocol, once for each of its jobs (protocol_id, job)."""
    return _apart(_ways(edges).join(I.small(jobs.select("protocol_id", "job").distinct()), "protocol_id"))


def _apart(df: DataFrame) -> DataFrame:
    """The same rows in columns of their own, so that they can be grouped beside what they come from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _by_size(edges: DataFrame, rows: DataFrame, held, spread) -> DataFrame:
    """What `held` gives for the edges and rows of the protocols that fit a task, and `spread` for those of the others."""
    large = [r.protocol_id for r in traversable(edges).groupBy("protocol_id").count().where(F.col("count") > EDGES).collect()]
    if not large:
        return held(edges, rows)
    of = F.col("protocol_id").isin(large)
    return held(edges.where(~of), rows.where(~of)).unionByName(spread(edges.where(of), rows.where(of)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _merged(parts: list[DataFrame]) -> list[DataFrame]:
    """The rows as one checkpoint, so that plans don't grow with a graph's depth."""
    return [lineage.cut(_union(parts).coalesce(parts[-1].rdd.getNumPartitions()))] if len(parts) > LEVELS else parts


def _followed(starts: pa.Table, ways: pa.Table) -> pa.Table:
    """Routes from each start over the edges of its protocol, level by level; a node is met first by the route whose edges come first."""
    out: dict[str, list] = {}
    for w in sorted(ways.select(["source", "target", "label", "edge_pos"]).to_pylist(), key=lambda w: (w["edge_pos"], w["target"])):
        out.setdefault(w["source"], []).append((w["target"], w["label"], w["edge_pos"]))
    made: dict[str, list] = {name: [] for name in _ROUTE}
    for start, protocol in zip(starts["node_id"].to_pylist(), starts["protocol_id"].to_pylist()):
        met = {start: ([], [0])}
        level = [start]
        while level:
            grown = []
            for node in level:
                path, trail = met[node]
                for target, label, pos in out.get(node, ()):
                    if target not in met:
                        met[target] = [*path, {"node_id": node, "label": label}], [*trail, pos]
                        grown.append(target)
            level = grown
        for node, (path, trail) in met.items():
            for name, value in zip(_ROUTE, (protocol, start, node, len(path), path, trail)):
                made[name].append(value)
    return pa.table(made, schema=pa.schema(list(_ROUTE.items())))


_STEP = pa.struct([("node_id", pa.string()), ("label", pa.string())])
_ROUTE = {"protocol_id": pa.string(), "start": pa.string(), "node_id": pa.string(), "depth": pa.int32(), "path": pa.list_(_STEP), "trail": pa.list_(pa.int32())}


def routes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(protocol_id, start, node_id, depth, path array<struct<node_id, label>>, trail) along first-found shortest routes.

    Ties go by edge position from the start on. A task follows the edges of one
    protocol from up to about STARTS of its starts, so a graph of any depth, with
    or without cycles, takes one shuffle; what a task holds is that protocol's
    edges and the nodes one start has met. Graphs of more than EDGES edges take a
    join for each level instead.
    """
    return _by_size(edges, starts.select("protocol_id", "node_id").where("node_id IS NOT NULL").distinct(), _held_routes, _spread_routes)


def _spread_routes(edges: DataFrame, begun: DataFrame) -> DataFrame:
    """Routes by a join for each level: of a node's routes the one whose edges come first stays, by position and then target."""
    ways, key = lineage.cut(_ways(edges)), ["protocol_id", "start", "node_id"]
    step = F.struct("edge_pos", F.col("target").alias("node_id"), "label")
    none = F.array().cast("array<struct<edge_pos:int,node_id:string,label:string>>")
    level = lineage.cut(begun.select("protocol_id", F.col("node_id").alias("start"), "node_id", none.alias("steps")))
    met = [level]
    while not level.isEmpty():
        grown = ways.join(I.small(level.withColumnRenamed("node_id", "source"), LEVEL_ROWS), ["protocol_id", "source"])
        best = grown.groupBy("protocol_id", "start", F.col("target").alias("node_id")).agg(F.min(F.concat("steps", F.array(step))).alias("steps"))
        level = lineage.cut(best.join(_union([m.select(*key) for m in met]), key, "left_anti"))
        met = _merged([*met, level])
    passed = F.concat(F.array("start"), F.transform("steps", lambda s: s["node_id"]))
    path = F.transform("steps", lambda s, k: F.struct(F.get(passed, k).alias("node_id"), s["label"].alias("label")))
    trail = F.concat(F.array(F.lit(0)), F.transform("steps", lambda s: s["edge_pos"]))
    return _union(met).select(*key, F.size("steps").alias("depth"), path.alias("path"), trail.alias("trail"))


def _held_routes(edges: DataFrame, begun: DataFrame) -> DataFrame:
    share = begun.groupBy("protocol_id").agg(F.ceil(F.count("*") / F.lit(STARTS)).alias("_jobs"))
    begun = begun.join(I.small(share), "protocol_id").withColumn("job", F.pmod(F.xxhash64("node_id"), F.col("_jobs")).cast("int")).drop("_jobs")
    ways = _dealt(edges, begun)
    found = begun.groupBy("protocol_id", "job").cogroup(ways.groupBy("protocol_id", "job")).applyInArrow(_followed, "protocol_id string, start string, node_id string, depth int, path array<struct<node_id:string,label:string>>, trail array<int>")
    return found


def _components(n: int, out: list[list[int]]) -> tuple[list[int], int]:
    """The strongly connected component of each node, numbered so that edges lead to lower or equal numbers."""
    index, low, own, stack, calls, count, at = [0] * n, [0] * n, [-1] * n, [], [], 0, 0
    for root in range(n):
        if index[root]:
            continue
        calls.append((root, 0))
        while calls:
            v, k = calls.pop()
            if k == 0:
                at += 1
                index[v] = low[v] = at
                stack.append(v)
            for i in range(k, len(out[v])):
                w = out[v][i]
                if not index[w]:
                    calls += [(v, i + 1), (w, 0)]
                    break
                if own[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while own[v] < 0:
                        own[stack.pop()] = count
                    count += 1
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[v])
    return own, count


def _marked(marks: pa.Table, ways: pa.Table) -> pa.Table:
    """Which of a job's marks (node, word, bit) reach each node: a bitset for each component of the graph, handed on along its edges in topological order."""
    names = sorted({*marks["node_id"].to_pylist(), *ways["source"].to_pylist(), *ways["target"].to_pylist()})
    number = {name: k for k, name in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for a, b in zip(ways["source"].to_pylist(), ways["target"].to_pylist()):
        out[number[a]].append(number[b])
    own, count = _components(len(names), out)
    words = np.asarray(marks["word"])
    first = int(words.min()) if len(words) else 0
    held = np.zeros((count, int(words.max()) - first + 1 if len(words) else 1), np.uint64)
    for name, word, bit in zip(marks["node_id"].to_pylist(), words.tolist(), marks["bit"].to_pylist()):
        held[own[number[name]], word - first] |= np.uint64(1) << np.uint64(bit)
    after: list[set[int]] = [set() for _ in range(count)]
    for v, targets in enumerate(out):
        after[own[v]].update(own[w] for w in targets)
    for c in range(count - 1, -1, -1):
        if held[c].any():
            for d in after[c]:
                if d != c:
                    held[d] |= held[c]
    node, word = np.nonzero(held[own])
    protocol = marks["protocol_id"][0].as_py() if len(marks) else None
    return pa.table({"protocol_id": pa.array([protocol] * len(node), pa.string()), "node_id": pa.array(names, pa.string()).take(pa.array(node)), "word": pa.array(word + first, pa.int64()), "bits": pa.array(held[own][node, word].view(np.int64))})


def reached_by(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(protocol_id, node_id, word, bits): which marks (protocol_id, node_id, slot from 0) reach each node over the edges, or stand there.

    Slot s is bit s % 64 of word s // 64; words without a bit have no row. Cycles
    are condensed and bitsets handed on in topological order, in one pass over a
    protocol's edges for each WORDS words of its marks, so rows and time are
    edges x words and not nodes x marks. In graphs of more than EDGES edges the
    words that have bits are handed on by joins.
    """
    return _by_size(edges, marks.select("protocol_id", "node_id", "slot"), _held_reach, _spread_reach)


def _spread_reach(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Reach by a join for each step along the edges; every ROUNDS steps, bits that a node has already are not handed on again, so cycles end."""
    ways, key = lineage.cut(_ways(edges).select("protocol_id", "source", "target").distinct()), ["protocol_id", "node_id", "word"]
    every = F.expr("bit_or(bits)").alias("bits")
    new = lineage.cut(marks.select("protocol_id", "node_id", F.floor(F.col("slot") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("bits")).groupBy(*key).agg(every))
    held, rounds = [new], 0
    while not new.isEmpty():
        rounds += 1
        moved = ways.join(I.small(new.withColumnRenamed("node_id", "source")), ["protocol_id", "source"]).groupBy("protocol_id", F.col("target").alias("node_id"), "word").agg(every)
        if rounds % ROUNDS == 0:
            held = [lineage.cut(_union(held).groupBy(*key).agg(every))]
            known = held[0].withColumnRenamed("bits", "_known")
            moved = moved.join(known, key, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))).where("bits <> 0").drop("_known")
        new = lineage.cut(moved)
        held.append(new)
    return _union(held).groupBy(*key).agg(every)


def _held_reach(edges: DataFrame, marks: DataFrame) -> DataFrame:
    word = F.floor(F.col("slot") / 64).cast("long")
    set_ = marks.select("protocol_id", "node_id", word.alias("word"), (F.col("slot") % 64).cast("int").alias("bit"), F.floor(word / WORDS).cast("int").alias("job"))
    return set_.groupBy("protocol_id", "job").cogroup(_dealt(edges, set_).groupBy("protocol_id", "job")).applyInArrow(_marked, "protocol_id string, node_id string, word long, bits long")


def join_nodes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(protocol_id, node_id) that all starts of a protocol reach, first in the breadth-first order of the first start."""
    begun = starts.select("protocol_id", "node_id").distinct()
    marks = lineage.cut(begun.withColumn("slot", F.row_number().over(Window.partitionBy("protocol_id").orderBy("node_id")) - 1))
    total = marks.groupBy("protocol_id").agg(F.count("*").alias("all"))
    met = reached_by(edges, marks).groupBy("protocol_id", "node_id").agg(F.sum(F.bit_count("bits")).alias("n")).join(I.small(total), "protocol_id").where("n = all")
    walk = routes(edges, marks.where("slot = 0")).select("protocol_id", "node_id", "depth", "trail")
    order = Window.partitionBy("protocol_id").orderBy("depth", "trail", "node_id")
    return met.join(walk, ["protocol_id", "node_id"]).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("protocol_id", "node_id")


def all_conditions(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """N4 for every node: (protocol_id, node_id, pos, decision_id, label): decisions on the shortest route of which some option does not reach the node.

    A decision's options are marks with successive slots; a node is free of the
    decision if it holds all of them, which a look at the one or two words of
    these slots tells. Decisions with one option, and those on no route, need no marks.
    """
    decisions = nodes.where(F.col("kind") == DECISION).select("protocol_id", F.col("node_id").alias("decision_id"))
    steps = routes(edges, starts).select("protocol_id", "node_id", F.posexplode("path").alias("pos", "step"))
    steps = steps.select("protocol_id", "node_id", "pos", F.col("step.node_id").alias("decision_id"), F.col("step.label").alias("label"))
    steps = lineage.cut(steps.join(decisions, ["protocol_id", "decision_id"]))
    decisions = steps.select("protocol_id", "decision_id").distinct()
    options = traversable(edges).select("protocol_id", F.col("source").alias("decision_id"), F.col("target").alias("option_id")).join(decisions, ["protocol_id", "decision_id"]).distinct()
    several = options.groupBy("protocol_id", "decision_id").count().where("count > 1")
    options = options.join(several, ["protocol_id", "decision_id"], "left_semi")
    options = lineage.cut(scan.numbers(options, ["protocol_id"], ["decision_id", "option_id"], "slot").drop(scan.PART))
    held = reached_by(edges, options.select("protocol_id", F.col("option_id").alias("node_id"), "slot"))
    wanted = options.groupBy("protocol_id", "decision_id", F.floor(F.col("slot") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("mask"))
    asked = steps.join(wanted, ["protocol_id", "decision_id"]).join(held, ["protocol_id", "node_id", "word"], "left")
    lacks = F.coalesce("bits", F.lit(0)).bitwiseAND(F.col("mask")) != F.col("mask")
    found = asked.groupBy("protocol_id", "node_id", "pos", "decision_id", "label").agg(F.bool_or(lacks).alias("lacks"))
    return found.where("lacks").drop("lacks")


def conditions(edges: DataFrame, nodes: DataFrame, starts: DataFrame, target: str) -> DataFrame:
    """N4 for one node: (protocol_id, pos, node_id, label)."""
    return all_conditions(edges, nodes, starts).where(F.col("node_id") == target).select("protocol_id", "pos", F.col("decision_id").alias("node_id"), "label")


def _fold(s: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower()) if not unicodedata.combining(c)).strip()


@dataclass
class Move:
    """What a walk does at a node: `ask` has ways (label, qualifier, target); `part` has heads and where they meet; `go` has its next node, if any."""

    kind: str
    said: str = ""
    ways: list[tuple[str, str, str]] = field(default_factory=list)
    heads: list[str] = field(default_factory=list)
    meet: str | None = None
    onward: str | None = None
    notes: list[tuple[str, str]] = field(default_factory=list)


def _ranks(out: dict[str, list[dict]], root: str) -> dict[str, int]:
    """Places of the nodes that a root reaches, level by level."""
    ranks, level = {root: 0}, [root]
    while level:
        level = [n for n in dict.fromkeys(e["target"] for p in level for e in out.get(p, ())) if n not in ranks]
        ranks.update({n: len(ranks) + k for k, n in enumerate(level)})
    return ranks


def compiled(nodes: list[dict], edges: list[dict]) -> tuple[str, dict[str, Move]]:
    """The start and the move of each node of one protocol. ValueError unless there is one start."""
    starts = [n["node_id"] for n in nodes if n["kind"] == START]
    if len(starts) != 1:
        raise ValueError(f"a tree needs one start, this has {len(starts)}")
    out: dict[str, list[dict]] = {}
    for e in sorted(edges, key=lambda e: e["edge_pos"]):
        if not e.get("reference") and (e.get("label") or "").lower() not in CONTEXT_LABELS:
            out.setdefault(e["source"], []).append(e)
    moves = {}
    for n in nodes:
        mine = out.get(n["node_id"], [])
        apart = [e["target"] for e in mine if e.get("independent")]
        if n["kind"] == DECISION:
            move = Move("ask", ways=[(e.get("label") or "", _fold((e.get("label") or "").partition("+")[2]), e["target"]) for e in mine])
        elif apart:
            ranks = [_ranks(out, h) for h in apart]
            common = set(ranks[0]).intersection(*ranks[1:])
            move = Move("part", heads=apart, meet=min(common, key=ranks[0].get, default=None))
        else:
            plain = [e["target"] for e in mine if not e.get("label")]
            move = Move("go", onward=plain[0] if len(plain) == 1 else None, notes=[(e["label"], e["target"]) for e in mine if e.get("label")])
        move.said = _fold(n["text"])
        moves[n["node_id"]] = move
    return starts[0], moves


class Walk:
    """One case on its way (N6, N7, J16): a stack of stretches (next node, node to stop before)."""

    def __init__(self, start: str, moves: dict[str, Move], answers: dict[str, str]) -> None:
        self.moves, self.answers = moves, answers
        self.stack: list[tuple[str | None, str | None]] = [(start, None)]
        self.seen: set[str] = set()
        self.steps: list[tuple[str, str | None]] = []
        self.notes: list[tuple[str, str]] = []
        self.status, self.stopped_at, self.options = None, None, []

    def _halt(self, status: str, node: str, options: list[str]) -> None:
        self.status, self.stopped_at, self.options = status, node, options

    def _ask(self, node: str, move: Move) -> str | None:
        told = [self.moves[n].said for n, choice in self.steps if self.moves[n].kind != "ask"]
        ways = {label: target for label, q, target in reversed(move.ways) if not q or any(q in t for t in told)}
        labels = [label for label, q, _ in move.ways if not q or any(q in t for t in told)]
        answer = labels[0] if len(labels) == 1 else self.answers.get(node)
        if not labels:
            self._halt(NO_ROUTE, node, [])
        elif answer in ways:
            self.steps.append((node, answer))
            return ways[answer]
        else:
            self._halt(UNKNOWN_DATUM if answer == X.UNKNOWN else PENDING, node, labels)
        return None

    def move(self) -> None:
        """The next move: the stretch on top ends, or goes on by one node."""
        node, stop = self.stack.pop()
        if node is None or node == stop or node in self.seen:
            return
        self.seen.add(node)
        move = self.moves[node]
        if move.kind == "ask":
            self.stack.append((self._ask(node, move), stop))
            return
        self.steps.append((node, None))
        self.notes += move.notes
        if move.kind == "part":
            self.stack += [(move.meet, stop), *((h, move.meet) for h in reversed(move.heads))]
        else:
            self.stack.append((move.onward, stop))

    def result(self) -> dict:
        while self.stack and self.status is None:
            self.move()
        return {"steps": [{"node_id": n, "choice": c} for n, c in self.steps], "status": self.status or COMPLETE, "stopped_at": self.stopped_at, "options": self.options, "notes": [{"label": a, "node_id": b} for a, b in self.notes]}


def walk(nodes: list[dict], edges: list[dict], answers: dict[str, str]) -> dict:
    """N7 for one case."""
    return Walk(*compiled(nodes, edges), answers).result()


def all_routes(nodes: list[dict], edges: list[dict]) -> list[dict]:
    """Every combination of answers that leads to an end."""
    program = compiled(nodes, edges)
    out, open_ = [], [{}]
    while open_:
        answers = open_.pop()
        got = Walk(*program, answers).result()
        if got["status"] == PENDING:
            open_.extend({**answers, got["stopped_at"]: option} for option in got["options"])
        else:
            out.append({"answers": answers, **got})
    return out


WALK = "steps array<struct<node_id:string,choice:string>>, status string, stopped_at string, options array<string>, notes array<struct<label:string,node_id:string>>"


#: Cases of one protocol that a task walks, about.
CASES = 50_000


def walk_cases(cases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N7 for every case (case_id, protocol_id, answers map<string,string>).

    A protocol's cases are dealt out to tasks of about CASES; each task gets the
    protocol's nodes and edges beside them and compiles its graph once. A null
    map counts as empty; a protocol that is not there is an error.
    """
    kind = cases.schema["case_id"].dataType
    rows = cases.select("case_id", "protocol_id", F.map_entries(F.coalesce("answers", F.create_map().cast("map<string,string>"))).alias("answers"))
    share = rows.groupBy("protocol_id").agg(F.ceil(F.count("*") / F.lit(CASES)).cast("int").alias("jobs"))
    share = lineage.cut(share)
    rows = rows.join(I.small(share), "protocol_id").withColumn("job", F.pmod(F.xxhash64("case_id"), F.col("jobs")).cast("int")).drop("jobs")
    node, edge = (F.struct(*cs) for cs in (("node_id", "kind", "text"), ("edge_pos", "source", "target", "label", "reference", "independent")))
    graph = nodes.select("protocol_id", node.alias("node"), F.lit(None).alias("edge")).union(edges.select("protocol_id", F.lit(None), edge))
    jobs = share.select("protocol_id", F.explode(F.sequence(F.lit(0), F.col("jobs") - 1)).alias("job"))
    graph = _apart(graph.join(I.small(jobs), "protocol_id"))
    shape = pa.struct([("steps", pa.list_(_CHOICE)), ("status", pa.string()), ("stopped_at", pa.string()), ("options", pa.list_(pa.string())), ("notes", pa.list_(pa.struct([("label", pa.string()), ("node_id", pa.string())])))])

    def run(cases: pa.Table, graph: pa.Table) -> pa.Table:
        program = compiled([n for n in graph["node"].to_pylist() if n], [e for e in graph["edge"].to_pylist() if e])
        found = [Walk(*program, {a["key"]: a["value"] for a in answers}).result() for answers in cases["answers"].to_pylist()]
        made = pa.array(found, shape)
        return pa.table([cases["case_id"], cases["protocol_id"], *made.flatten()], names=["case_id", "protocol_id", *(f.name for f in shape)])

    return rows.groupBy("protocol_id", "job").cogroup(graph.groupBy("protocol_id", "job")).applyInArrow(run, f"case_id {kind.simpleString()}, protocol_id string, {WALK}")


_CHOICE = pa.struct([("node_id", pa.string()), ("choice", pa.string())])


def first_section(order: DataFrame, nodes: DataFrame, k: int = FIRST_NODES) -> DataFrame:
    """In walk order (rows need depth and trail), the nodes of the start's section if it has one, else the first k; no start."""
    rows = scan.placed(order.join(nodes, ["protocol_id", "node_id"]), ["protocol_id"], ["depth", "trail", "node_id"])
    lead = F.max(F.when((F.col("kind") == START) & (X.text("section") != ""), F.col("section")))
    numbered = scan.numbers(rows.where(F.col("kind") != START), ["protocol_id"], ["depth", "trail", "node_id"], "_n").drop(scan.PART).withColumn("_n", (F.col("_n") + 1).cast("int"))
    rows = numbered.join(I.small(rows.groupBy("protocol_id").agg(lead.alias("_lead"))), "protocol_id")
    return rows.where(F.when(F.col("_lead").isNotNull(), F.col("section") == F.col("_lead")).otherwise(F.col("_n") <= k)).withColumnRenamed("_lead", "first_section")


def decisions_in_order(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """(protocol_id, node_id, text, pos) of the decisions as a walk over all edges meets them."""
    rows = order.join(nodes.where(F.col("kind") == DECISION), ["protocol_id", "node_id"])
    rows = scan.numbers(rows.select("protocol_id", "node_id", "text", "depth", "trail"), ["protocol_id"], ["depth", "trail", "node_id"], "pos")
    return rows.select("protocol_id", "node_id", "text", F.col("pos").cast("int").alias("pos"))


def citation_key(section: Column, source_ref: Column, node_id: Column) -> Column:
    """The section, else the page of the protocol, else the reference, else the node."""
    ref = X.text(source_ref)
    return F.when(X.text(section) != "", section).when(F.startswith(ref, F.lit("p.")), F.concat(F.lit("protocolo "), ref)).when(ref != "", ref).otherwise(node_id)


def _cited(rows: DataFrame, by: str) -> DataFrame:
    """A10: (by, citations): distinct texts by key, both in the order of `pos`; rows need pos, text, section, source_ref, node_id."""
    key = citation_key(F.col("section"), F.col("source_ref"), F.col("node_id"))
    firsts = rows.groupBy(by, key.alias("key"), "text").agg(F.min("pos").alias("pos"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    each = firsts.groupBy(by, "key").agg(F.min("pos").alias("at"), texts.alias("verbatim"))
    cites = F.transform(F.array_sort(F.collect_list(F.struct("at", "key", "verbatim"))), lambda x: F.struct(x["key"].alias("section"), x["verbatim"].alias("verbatim_text")))
    return each.groupBy(by).agg(cites.alias("citations"))


def _listed(rows: DataFrame, by: list[str], line: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


def _asked(text: Column, choice: Column) -> Column:
    return F.concat(F.lit("- "), X.headline(text), F.lit(" → "), choice)


def _told(text: Column) -> Column:
    return F.concat(F.lit("- "), X.indent(text))


def render(walks: DataFrame, nodes: DataFrame, protocols: DataFrame) -> DataFrame:
    """(case_id, rule_id, path, answer_text, citations) of walks: a line per step, then the notes; no start.

    `protocols`: protocol_id, version.
    """
    own = nodes.select("protocol_id", "node_id", "kind", "text", "section", "source_ref")
    steps = walks.select("case_id", "protocol_id", F.posexplode("steps").alias("n", "step")).select("case_id", "protocol_id", F.struct(F.lit(0), "n").alias("pos"), "step.node_id", "step.choice", F.lit(None).cast("string").alias("label"))
    notes = walks.select("case_id", "protocol_id", F.posexplode("notes").alias("n", "note")).select("case_id", "protocol_id", F.struct(F.lit(1), "n").alias("pos"), "note.node_id", F.lit(None).cast("string").alias("choice"), "note.label")
    rows = steps.union(notes).join(I.small(own), ["protocol_id", "node_id"]).where((F.col("kind") != START) | F.col("label").isNotNull())
    bold = F.concat(F.lit("**"), F.col("choice"), F.lit("**"))
    step_line = F.when(F.col("choice").isNotNull(), _asked(F.col("text"), bold)).otherwise(_told(F.col("text")))
    first = _listed(rows.where(F.col("label").isNull()), ["case_id"], step_line)
    note_line = F.concat(F.lit("- "), F.col("label"), F.lit(": "), X.indent("text"))
    more = _listed(rows.where(F.col("label").isNotNull()), ["case_id"], note_line).withColumnRenamed("body", "notes_body")
    ends = rows.where(F.col("label").isNull()).groupBy("case_id").agg(F.max(F.struct("pos", "node_id"))["node_id"].alias("rule_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("path"))
    out = walks.select("case_id", "protocol_id").join(protocols, "protocol_id").join(first, "case_id", "left").join(more, "case_id", "left").join(ends, "case_id", "left").join(_cited(rows, "case_id"), "case_id", "left")
    text = F.concat(F.lit(WALK_HEADING), "protocol_id", F.lit(" "), "version", F.lit(":\n\n"), X.text("body"), F.coalesce(F.concat(F.lit("\n\n" + NOTES_HEADING + "\n"), "notes_body"), F.lit("")))
    return out.select("case_id", "rule_id", "path", text.alias("answer_text"), "citations")


def render_consult(chosen: DataFrame, nodes: DataFrame, edges: DataFrame, starts: DataFrame, protocols: DataFrame) -> DataFrame:
    """(qid, rule_id, answer_text, citations) of chosen nodes (qid, protocol_id, node_id, pos).

    Each node is followed by the other branches of the last decision that
    conditions it; each branch has its full condition and is shown once.
    """
    held = lineage.cut(all_conditions(edges, nodes, starts))
    last = held.groupBy("protocol_id", "node_id").agg(F.max(F.struct("pos", "decision_id"))["decision_id"].alias("decision_id"))
    ways = traversable(edges).select("protocol_id", F.col("source").alias("decision_id"), F.col("target").alias("branch_id"), "edge_pos")
    beside = chosen.join(last, ["protocol_id", "node_id"]).join(ways, ["protocol_id", "decision_id"])
    shown = chosen.select("qid", "protocol_id", "node_id", F.struct(F.col("pos").cast("int"), F.lit(-1)).alias("pos")).union(beside.select("qid", "protocol_id", F.col("branch_id").alias("node_id"), F.struct(F.col("pos").cast("int"), F.col("edge_pos").cast("int"))))
    shown = shown.groupBy("qid", "protocol_id", "node_id").agg(F.min("pos").alias("pos"))
    named = nodes.select("protocol_id", F.col("node_id").alias("decision_id"), F.col("text").alias("decision_text"))
    clause = F.concat(F.lit("«"), X.headline("decision_text"), F.lit("» = "), X.text("label"))
    when = held.join(named, ["protocol_id", "decision_id"]).groupBy("protocol_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", clause.alias("clause")))), lambda x: x["clause"]), " y ").alias("when"))
    rows = shown.join(nodes.select("protocol_id", "node_id", "text", "section", "source_ref"), ["protocol_id", "node_id"]).join(when, ["protocol_id", "node_id"], "left")
    line = F.concat(F.lit("\n- "), F.coalesce(F.concat(F.lit("Cuando "), "when", F.lit(": ")), F.lit("")), X.indent("text"))
    body = _listed(rows, ["qid", "protocol_id"], line)
    first = chosen.groupBy("qid").agg(F.min(F.struct("pos", "node_id"))["node_id"].alias("rule_id"))
    text = F.concat(F.lit(CONSULT_HEADING), "protocol_id", F.lit(" "), "version", F.lit(CONSULT_END + "\n"), "body")
    return body.join(protocols, "protocol_id").join(first, "qid").join(_cited(rows, "qid"), "qid").select("qid", "rule_id", text.alias("answer_text"), "citations")


def render_overview(nodes: DataFrame, edges: DataFrame, starts: DataFrame, protocols: DataFrame) -> DataFrame:
    """(protocol_id, answer_text, citations): the first part of each graph in the order of a walk."""
    rows = first_section(routes(edges, starts).drop("path"), nodes).select("protocol_id", "node_id", "kind", "text", "section", "source_ref", "first_section", F.col("_n").alias("pos"))
    labels = traversable(edges).groupBy("protocol_id", F.col("source").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_pos", X.text("label").alias("label")))), lambda x: x["label"]), " / ").alias("labels"))
    rows = rows.join(labels, ["protocol_id", "node_id"], "left")
    line = F.when(F.col("kind") == DECISION, _asked(F.col("text"), X.text("labels"))).otherwise(_told(F.col("text")))
    body = _listed(rows, ["protocol_id", "first_section"], line).join(protocols, "protocol_id").join(_cited(rows, "protocol_id"), "protocol_id")
    where = F.coalesce(F.concat(F.lit(" («"), "first_section", F.lit("»)")), F.lit(""))
    text = F.concat(F.lit(OVERVIEW_HEADING), "protocol_id", F.lit(" "), "version", where, F.lit(OVERVIEW_END + "\n\n"), "body")
    return body.select("protocol_id", text.alias("answer_text"), "citations")


def citations_as_sources(walks: DataFrame) -> DataFrame:
    """One retrieved row per citation: score 1.0, method arbol, no page; a citation without a section names the last node. Rows need source_file, rule_id, citations."""
    rows = walks.select("case_id", "source_file", "rule_id", F.explode("citations").alias("c"))
    return rows.select("case_id", "source_file", F.coalesce(F.col("c.section"), F.col("rule_id")).alias("section"), F.lit(None).cast("int").alias("page"), F.col("c.verbatim_text").alias("text"), F.lit(1.0).alias("score"), F.lit("arbol").alias("retrieval_method"))


def chosen_answers(answers: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, protocol_id, answers): of what an extractor says (case_id, protocol_id, node_id, value), only values that are labels of that decision."""
    labels = traversable(edges).select("protocol_id", F.col("source").alias("node_id"), F.col("label").alias("value")).distinct()
    valid = answers.join(I.small(labels), ["protocol_id", "node_id", "value"], "left_semi")
    pairs = valid.groupBy("case_id", "protocol_id", "node_id").agg(F.min("value").alias("value")).groupBy("case_id", "protocol_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "value")))).alias("answers"))
    every = answers.select("case_id", "protocol_id").distinct().join(pairs, ["case_id", "protocol_id"], "left")
    return every.withColumn("answers", F.coalesce("answers", F.create_map().cast("map<string,string>")))


def selected_nodes(selected: DataFrame, nodes: DataFrame, ranked: DataFrame, most: int = 4) -> DataFrame:
    """(qid, node_id, pos, by_model): ids that a selector names (qid, ids array<string>; null where it failed), known ones, once each, at most `most`; else the lexical ranking (qid, node_id, rank)."""
    known = nodes.where(F.col("kind") != START).select("node_id").distinct()
    named = selected.select("qid", F.posexplode(F.array_distinct("ids")).alias("at", "node_id")).join(I.small(known), "node_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    model = named.withColumn("pos", place).where(F.col("pos") <= most).select("qid", "node_id", "pos", F.lit(True).alias("by_model"))
    rest = ranked.join(model.select("qid").distinct(), "qid", "left_anti").select("qid", "node_id", F.col("rank").alias("pos"), F.lit(False).alias("by_model"))
    return model.unionByName(rest)


def classified(questions: DataFrame, protocols: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(qid, protocol_id, mode): a known protocol or null, and caso unless the verdict says consulta.

    `verdicts` (qid, protocol, mode) come from a classifier; without one, the
    protocol is the one with most of its `terms` in the question, if it is the
    only such, and the mode is consulta for a question without a digit.
    """
    if verdicts is None:
        asked = questions.select("qid", "question", X.tokens("question").alias("words"))
        hits = asked.select("qid", F.explode("words").alias("term")).distinct().join(I.small(protocols.select("protocol_id", F.explode("terms").alias("term")).distinct()), "term").groupBy("qid", "protocol_id").agg(F.count("*").alias("n"))
        best = hits.groupBy("qid").agg(F.max(F.struct("n", "protocol_id")).alias("top"), F.sort_array(F.collect_list("n"), False).alias("all"))
        best = best.where((F.size("all") == 1) | (F.get("all", F.lit(0)) > F.get("all", F.lit(1)))).select("qid", F.col("top.protocol_id").alias("protocol"))
        verdicts = asked.join(best, "qid", "left").select("qid", "protocol", F.when(F.col("question").rlike("[0-9]"), "caso").otherwise("consulta").alias("mode"))
    known = I.small(protocols.select(F.col("protocol_id"), F.upper("protocol_id").alias("protocol")).distinct())
    mode = F.lower(F.trim(X.text("mode")))
    clean = verdicts.select("qid", F.upper(F.trim(X.text("protocol"))).alias("protocol"), F.when(mode.isin("caso", "consulta"), mode).otherwise("caso").alias("mode"))
    return questions.select("qid").join(clean, "qid", "left").join(known, "protocol", "left").select("qid", "protocol_id", F.coalesce("mode", F.lit("caso")).alias("mode"))
