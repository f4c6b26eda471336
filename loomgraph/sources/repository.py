"""A repository of files as frames: files, parameters, dependencies, launch nodes, code units.

Files are read by Spark (``binaryFile``), so any store will do, and parsed in Arrow batches
on the executors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.windows import folded_values
from . import parsers
from .changes import SKIPPED
from .tables import width_for

#: Where a line ends in a file.
LINE_ENDS = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
LANGUAGES = {"py": "python", "cpp": "cpp", "hpp": "cpp", "h": "cpp", "cc": "cpp", "sh": "shell", "cmake": "cmake", "yaml": "yaml", "yml": "yaml", "xml": "xml"}


def read_files(spark: SparkSession, root: str, max_bytes: int = 200_000) -> DataFrame:
    """(path, text): files below root under a size bound, outside skipped folders; path is relative."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace("path", "^.*?" + _quoted(base) + "/", "")
    files = raw.select(relative.alias("path"), "content").where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))

    @F.pandas_udf(StringType())
    def text(content: pd.Series) -> pd.Series:
        return content.map(parsers.decode)

    return files.select("path", text("content").alias("text"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def dealt_out(files: DataFrame, each: int = 2_000) -> DataFrame:
    """The files in tasks of about ``each``, for parsers: small texts may well come from one partition."""
    return files.repartition(width_for(files.count(), each, files.sparkSession.sparkContext.defaultParallelism))


def _rows(files: DataFrame, parse, schema: str, pattern: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"]) for r in parse(t or "")]
            yield pd.DataFrame(rows, columns=names)

    return dealt_out(files.where(F.col("path").rlike(pattern)).select("path", "text")).mapInPandas(run, schema)


def parameters(files: DataFrame) -> DataFrame:
    """(path, ord, scope, name, value) of parameter files in config, params or param folders.

    Keyed by the whole path, so files of one name in two folders stay apart.
    """
    own = files.where(F.col("path").rlike(r"(^|/)(config|params|param)/.*\.ya?ml$"))
    lines = own.select(F.col("path").alias("doc"), F.posexplode(F.split("text", LINE_ENDS)).alias("ln", "text"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("ln")) - 1
    return folded_values(lines).select(F.col("doc").alias("path"), place.alias("ord"), "scope", "name", "value")


def dependencies(files: DataFrame) -> DataFrame:
    """(name, version): of manifests and requirements lists; the last path that names one wins."""
    xml = _rows(files, lambda t: parsers.package_manifest(t)[1], "path string, name string, version string", r"(^|/)package\.xml$")
    txt = _rows(files, lambda t: list(parsers.requirements(t)), "path string, name string, version string", r"(^|/)requirements[^/]*\.txt$")
    both = xml.unionByName(txt)
    return both.groupBy("name").agg(F.max_by("version", "path").alias("version"))


_NODE = "path string, ord int, package string, executable string, name string, param_files array<string>, remappings array<struct<inside:string,outside:string>>, arguments array<string>, unresolved array<string>"


def launch_nodes(files: DataFrame) -> DataFrame:
    """Nodes that Python and XML launch files declare, in order."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"]):
                found = parsers.launch_python(t or "") if p.endswith(".py") else parsers.launch_xml(t or "")
                rows += [(p, k, n["package"], n["executable"], n["name"], n["param_files"], [{"inside": a, "outside": b} for a, b in n["remappings"]], n["arguments"], n["unresolved"]) for k, n in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "ord", "package", "executable", "name", "param_files", "remappings", "arguments", "unresolved"])

    return dealt_out(files.where(F.col("path").rlike(r"launch[^/]*\.(py|xml)$|\.launch$")).select("path", "text")).mapInPandas(run, _NODE)


def code_units(files: DataFrame, limit: int = 120) -> DataFrame:
    """(path, ord, kind, name, doc): the first units of Python sources in path order."""
    units = _rows(files, lambda t: [(k, *u) for k, u in enumerate(parsers.code_units(t)[0])], "path string, ord int, kind string, name string, doc string", r"\.py$")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    units = units.withColumn("name", F.when(F.col("kind") == "module", stem).otherwise(F.col("name")))
    return units.orderBy("path", "ord").limit(limit)


def foreign_imports(files: DataFrame) -> DataFrame:
    """(module): imported modules that are neither of the standard library nor local."""
    import sys

    found = _rows(files, lambda t: [(m,) for m in sorted(parsers.code_units(t)[1])], "path string, module string", r"\.py$").select("module").distinct()
    local = files.where("path like '%.py'").select(F.regexp_extract("path", r"([^/]+?)(/__init__)?\.py$", 1).alias("module")).unionByName(files.select(F.split("path", "/")[0].alias("module"))).distinct()
    return found.where(~F.col("module").isin(*sorted(sys.stdlib_module_names))).join(local, "module", "left_anti")


def index_files(files: DataFrame) -> DataFrame:
    """(path, language, ln, text): lines of files whose suffix names a language."""
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    f = files.withColumn("language", table[suffix]).where("language is not null")
    return f.select("path", "language", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("p", "text")).select("path", "language", (F.col("p") + 1).alias("ln"), "text")


def components(files: DataFrame) -> DataFrame:
    """(component, package, executable, parameters, sources): nodes with the parameters passed to them.

    A parameter belongs to a node if one of its files has the path's base name and its
    scope is the node's or ``/**``, or the file has no scopes at all. Parameters that no
    node claims make a component of their own, named by scope, else by the file's stem.
    """
    nodes = launch_nodes(files).withColumn("component", F.coalesce("name", "executable")).where("component is not null")
    params = parameters(files).withColumn("base", F.regexp_extract("path", r"([^/]+)$", 1))
    scoped = params.groupBy("path").agg(F.max(F.col("scope") != "").alias("has_scopes"))
    params = params.join(scoped, "path")
    passed = nodes.select("component", "package", "executable", F.explode_outer("param_files").alias("file")).withColumn("base", F.regexp_extract("file", r"([^/]+)$", 1))
    p = params.select("base", "path", "ord", "scope", "has_scopes", F.col("name").alias("parameter"), "value")
    own = (~F.col("has_scopes")) | (F.col("scope") == F.col("component")) | (F.col("scope") == "/**")
    claimed = passed.join(p, "base").where(own)
    rest = params.join(claimed.select("path", "scope").distinct(), ["path", "scope"], "left_anti")
    owner = F.when(F.col("scope").isin("", "/**"), F.regexp_extract("base", r"^(.*?)\.[^.]*$", 1)).otherwise(F.col("scope"))
    loose = rest.select(owner.alias("component"), F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("executable"), "path", "ord", F.col("name").alias("parameter"), "value")
    every = claimed.select("component", "package", "executable", "path", "ord", "parameter", "value").unionByName(loose)
    bare = nodes.select("component", "package", "executable", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("parameter"), F.lit(None).cast("string").alias("value"))
    g = every.unionByName(bare).groupBy("component").agg(
        F.max("package").alias("package"),
        F.max("executable").alias("executable"),
        F.array_sort(F.collect_set(F.when(F.col("parameter").isNotNull(), F.struct("path", "ord", F.col("parameter").alias("name"), "value")))).alias("parameters"),
        F.array_sort(F.collect_set("path")).alias("sources"),
    )
    return g


def plugins(parameters_: DataFrame) -> DataFrame:
    """(component, library): parameters whose value is a plugin ``library::Class``."""
    m = F.regexp_extract("value", r"^['\"]?([A-Za-z_][\w/]*)(?:::|/)([A-Za-z_]\w*)['\"]?$", 2)
    lib = F.regexp_extract("value", r"^['\"]?([A-Za-z_][\w/]*)(?:::|/)([A-Za-z_]\w*)['\"]?$", 1)
    return parameters_.where(F.lower("name").contains("plugin") & (m != "")).select(m.alias("component"), lib.alias("library")).distinct()


def code_graph(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON document; ``links`` counts before ``edges``; absolute paths become relative."""
    schema = "nodes array<struct<id:string,label:string,_origin:string,file_type:string,source_file:string,source_location:string,type:string>>, links array<struct<source:string,target:string,relation:string,confidence:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    n = doc.select(F.explode("nodes").alias("n")).select("n.*").withColumn("source_file", F.regexp_replace("source_file", "^" + _quoted(root.rstrip("/")) + "/", "") if root else F.col("source_file"))
    e = doc.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*").withColumn("is_fact", F.col("confidence").eqNullSafe("EXTRACTED"))
    return n, e


SHEET = """node_id string, grounded boolean, kind string, statement string, symbols array<struct<symbol:string,meaning:string,dimensions:string>>,
 steps array<struct<n:int,text:string,invokes:array<string>,cites:array<string>>>, properties array<struct<property:string,why:string,cites:array<string>>>,
 assumptions array<struct<assumption:string,breaks_when:string>>, failure_modes array<struct<mode:string,signature:string,cause:string>>, source_ids array<string>,
 check struct<node_id:string,kind:string,grounded:boolean,ungrounded_citations:array<string>,uncited_steps:array<int>,unknown_invocations:array<string>,closure_holes:array<string>,canon_notes:array<string>,shape:array<string>,vacuous_invocations:boolean,ok:boolean>,
 instantiation struct<node_id:string,project:string,components:array<string>,why_here:string,concrete:array<struct<symbol:string,in_your_project:string>>,knobs:array<struct<parameter:string,file:string,means:string>>,notation:string,invented:map<string,array<string>>,thin:string,unsupported:array<string>>"""


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder of JSON documents; absent keys are null, unreadable files have ``_corrupt_record``."""
    return spark.read.schema(SHEET + ", _corrupt_record string").option("multiLine", True).json(folder)


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster, ord, src, dst, why) of one JSON document per cluster, edges before inbound ones."""
    edge = "array<struct<`from`:string,`to`:string,why:string>>"
    doc = spark.read.schema(f"cluster string, edges {edge}, inbound {edge}").option("multiLine", True).json(folder)
    both = F.concat(F.coalesce("edges", F.array().cast(edge)), F.coalesce("inbound", F.array().cast(edge)))
    return doc.select("cluster", F.posexplode(both).alias("ord", "e")).select("cluster", "ord", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.why")
