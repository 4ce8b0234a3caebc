"""Sources and sinks (S2, S5 to S7, S11 to S15, S17). YAML documents are small, reviewed files read on the driver."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lucerna.functions import text as X
from lucerna.operators.flow import CONTEXT_LABELS, DECISION, START

EXTERNAL_TYPES = ("guia", "revision")
"""Source types of outside documents (fixed values)."""


def pages_from_text(spark: SparkSession, path: str, separator: str = "\f") -> DataFrame:
    """S2 for text and markdown files: a page per form feed, numbered from 1, blank pages dropped. Other formats plug in an extractor."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("source_file"), F.posexplode(F.split(F.decode("content", "UTF-8"), separator)).alias("page", "text"))
    return rows.withColumn("page", F.col("page") + 1).where(F.trim("text") != "")


def pages_with(spark: SparkSession, path: str, extract) -> DataFrame:
    """S2 with an extractor: bytes of a file to (page, text) pairs, on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = [(p.rpartition("/")[2], n, t) for p, c in zip(df["path"], df["content"]) for n, t in extract(bytes(c)) if t.strip()]
            yield pd.DataFrame(rows, columns=["source_file", "page", "text"])

    return files.mapInPandas(run, "source_file string, page int, text string")


def catalog(spark: SparkSession, items: list[dict]) -> DataFrame:
    """File, source_type, topic, title (the file by default), year; other types are errors."""
    for item in items:
        if item.get("source_type") not in EXTERNAL_TYPES:
            raise ValueError(f"source_type of {item.get('file')}: {item.get('source_type')}")
    rows = [(i["file"], i["source_type"], i.get("topic"), i.get("title") or i["file"], i.get("year")) for i in items]
    return spark.createDataFrame(rows, "file string, source_type string, topic string, title string, year int")


def documents(own: DataFrame, outside: DataFrame, known: DataFrame) -> DataFrame:
    """(pos, source_file, source_type, source_title) of files (source_file): the house's own by name, then outside ones by name.

    ValueError, before anything is read, if an outside file is not in the
    catalog `known` (file, source_type, title).
    """
    keyed = known.select(X.file_key("file").alias("_key"), "source_type", F.coalesce("title", "file").alias("source_title"))
    found = outside.select("source_file", X.file_key("source_file").alias("_key")).join(keyed, "_key", "left")
    lost = [r.source_file for r in found.where("source_type IS NULL").select("source_file").limit(5).collect()]
    if lost:
        raise ValueError(f"not in the catalog: {', '.join(lost)}")
    rows = own.select(F.lit(0).alias("group"), "source_file", F.lit("institucional").alias("source_type"), F.col("source_file").alias("source_title"))
    rows = rows.union(found.select(F.lit(1), "source_file", "source_type", "source_title"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("group", "source_file"))).select("pos", "source_file", "source_type", "source_title")


TABLES = "source_file string, document string, reviewed boolean, title string, page int, general_notes array<string>, rows array<struct<cells:array<struct<col:string,val:string>>,notes:array<string>>>"


def curated_tables(spark: SparkSession, files: list[tuple[str, dict | None]]) -> DataFrame:
    """One row per table of the reviewed documents (file name, parsed YAML or None where there is none).

    ValueError if a document names another file, is not marked reviewed, or
    has a table without rows.
    """
    out = []
    for name, doc in files:
        if doc is None:
            continue
        if re.sub("[^a-z0-9]", "", str(doc.get("document", "")).lower()) != re.sub("[^a-z0-9]", "", name.lower()):
            raise ValueError(f"{name}: table file of {doc.get('document')}")
        if not doc.get("reviewed"):
            raise ValueError(f"{name}: tables not reviewed")
        for table in doc.get("tables") or []:
            if not table.get("rows"):
                raise ValueError(f"{name}: table {table.get('id')} without rows")
            rows = [([(str(k), "" if v is None else str(v)) for k, v in (r.get("cells") or {}).items()], [str(x) for x in r.get("notes") or []]) for r in table["rows"]]
            out.append((name, str(doc["document"]), True, str(table.get("title") or ""), table.get("page"), [str(x) for x in table.get("general_notes") or []], rows))
    return spark.createDataFrame(out, TABLES)


def newest_versions(files: DataFrame) -> DataFrame:
    """Rows (protocol, version, path) of the newest version of each protocol, by the order of its text."""
    nth = F.row_number().over(Window.partitionBy("protocol").orderBy(F.desc("version")))
    return files.withColumn("_n", nth).where("_n = 1").drop("_n")


def registry(headers: DataFrame) -> DataFrame:
    """S17."""
    return headers.select("protocol_id", "name", "description").orderBy("protocol_id")


def _lines(v) -> str:
    """A node's text: lines without blanks round them, no empty ones."""
    return "\n".join(filter(None, map(str.strip, str(v or "").splitlines())))


def version_label(v) -> str:
    """F31 on the driver: v and two digits at least; nothing without a digit."""
    digits = re.sub(r"\D", "", str(v or ""))
    return f"v{int(digits):02d}" if digits else ""


#: The dialects: where header, code and graph stand, and what a node calls its kind, text, section and reference.
DIALECTS = {
    "diagram": {"header": "document", "code": "code", "kind": "kind", "text": "text", "section": "section", "ref": None},
    "nodes": {"header": "metadata", "code": "protocol", "kind": "type", "text": "label", "section": None, "ref": "src"},
}


def parse_tree(tree: dict) -> tuple[dict, list[dict], list[dict]]:
    """Header, nodes and edges of either dialect: one with a `diagram`, one with `nodes` and `edges` at the top.

    ValueError for any other document, one without code or version, with no or
    several starts, an edge to an unknown node, or a decision with fewer than
    two ways out.
    """
    name = "diagram" if "diagram" in tree else "nodes" if "nodes" in tree and "edges" in tree else None
    if name is None:
        raise ValueError("neither dialect of a decision tree")
    at, body = DIALECTS[name], tree["diagram"] if name == "diagram" else tree
    meta, titles = tree.get(at["header"]) or {}, {str(k): str(v) for k, v in (body.get("sections") or {}).items()}
    head = {"protocol_id": str(meta.get(at["code"]) or "").strip(), "version": version_label(meta.get("version")), "name": _lines(meta.get("title")), "description": _lines(meta.get("scope"))}
    code = head["protocol_id"]
    nodes = [
        {"protocol_id": code, "node_id": str(n["id"]), "kind": str(n.get(at["kind"]) or "").lower(), "text": _lines(n.get(at["text"])), "section": titles.get(str(n.get(at["section"])), "") if at["section"] else "", "source_ref": str(n.get(at["ref"]) or "") if at["ref"] else ""}
        for n in body["nodes"]
    ]
    edges = [
        {"protocol_id": code, "edge_pos": k, "source": str(e["from"]), "target": str(e["to"]), "label": str(e.get("label") or "").strip(), "reference": bool(e.get("reference")), "independent": bool(e.get("independent"))}
        for k, e in enumerate(body["edges"])
    ]
    if wrong := _problems(head, nodes, edges):
        raise ValueError(f"{code or 'tree'}: {wrong[0]}")
    return head, nodes, edges


def _problems(head: dict, nodes: list[dict], edges: list[dict]) -> list[str]:
    known, ways = {n["node_id"] for n in nodes}, Counter(e["source"] for e in edges if not e["reference"] and e["label"].lower() not in CONTEXT_LABELS)
    starts = sum(n["kind"] == START for n in nodes)
    out = ["no code or version"] * (not head["protocol_id"] or not head["version"])
    out += [f"{starts} starts"] * (starts != 1)
    out += [f"edge to unknown node {x}" for e in edges for x in (e["source"], e["target"]) if x not in known]
    return out + [f"decision {n['node_id']} with fewer than two ways" for n in nodes if n["kind"] == DECISION and ways[n["node_id"]] < 2]


NODES = "protocol_id string, node_id string, kind string, text string, section string, source_ref string"
EDGES = "protocol_id string, edge_pos int, source string, target string, label string, reference boolean, independent boolean"


def tree_tables(spark: SparkSession, trees: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    parsed = [parse_tree(t) for t in trees]
    heads = spark.createDataFrame([tuple(h[c] for c in ("protocol_id", "version", "name", "description")) for h, _, _ in parsed], "protocol_id string, version string, name string, description string")
    nodes = spark.createDataFrame([tuple(n[c.split()[0]] for c in NODES.split(", ")) for _, ns, _ in parsed for n in ns], NODES)
    edges = spark.createDataFrame([tuple(e[c.split()[0]] for c in EDGES.split(", ")) for _, _, es in parsed for e in es], EDGES)
    return heads, nodes, edges


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S11."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S12."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """Columns are the union of all parts', in order of first appearance."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").option("header", True).csv(path)


def append_new(items: DataFrame, path: str, key: str, spark: SparkSession) -> None:
    """Appends as JSON lines the items whose key is not there yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        items = items.join(spark.read.schema(items.schema).json(path).select(key).distinct(), key, "left_anti")
    items.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """S15."""
    df.write.mode("overwrite").json(path)


def create_store(df: DataFrame, path: str, recreate: bool = False) -> None:
    """A store partitioned by source type; nothing happens if it exists and is not to be made anew."""
    df.write.mode("overwrite" if recreate else "ignore").partitionBy("source_type").parquet(path)


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """All columns but the vectors, which the scan then skips."""
    return spark.read.parquet(path).drop("embedding")
