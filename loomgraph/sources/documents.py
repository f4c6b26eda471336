"""JSON documents of the curated graph and of projects, as relations.

A missing document is an empty relation where the data model allows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _document(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    if not required and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def seeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(base concepts (id), seeds (ord, id, name, domain, item, kind))."""
    doc = _document(spark, path, "base struct<concepts:array<string>>, seeds array<struct<id:string,name:string,domain:string,concepts:array<string>,techniques:array<string>>>")
    base = doc.select(F.explode("base.concepts").alias("id"))
    s = doc.select(F.posexplode("seeds").alias("ord", "s")).select("ord", "s.*")
    items = s.select("ord", "id", "name", "domain", F.explode("concepts").alias("item"), F.lit("concept").alias("kind")).unionByName(
        s.select("ord", "id", "name", "domain", F.explode("techniques").alias("item"), F.lit("technique").alias("kind"))
    )
    return base, items


def canon_edges(spark: SparkSession, path: str) -> DataFrame:
    """(ord, src, dst, cluster, why); empty without a document."""
    doc = _document(spark, path, "edges array<struct<`from`:string,`to`:string,cluster:string,why:string>>", required=False)
    return doc.select(F.posexplode("edges").alias("ord", "e")).select("ord", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.cluster", "e.why")


def amendments(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The amendment relations by name, in the form that ``graph.amend`` takes."""
    pair = "array<struct<`from`:string,`to`:string,rel:string>>"
    schema = f"add_floor array<string>, add_concepts array<string>, add_techniques array<string>, drop_edges {pair}, retarget_edges array<struct<`from`:string,old_to:string,new_to:string>>, add_edges {pair}, retier array<struct<id:string,tier:string>>, merge array<struct<`from`:string,into:string>>"
    doc = _document(spark, path, schema, required=False)

    def rows(name):
        return doc.select(F.explode(name).alias("x"))

    return {
        "added": rows("add_floor").select(F.col("x").alias("id"), F.lit("concept").alias("type"), F.lit("assumed").alias("tier"))
        .unionByName(rows("add_concepts").select(F.col("x").alias("id"), F.lit("concept").alias("type"), F.lit("statement").alias("tier")))
        .unionByName(rows("add_techniques").select(F.col("x").alias("id"), F.lit("technique").alias("type"), F.lit("statement").alias("tier"))),
        "drop": rows("drop_edges").select(F.col("x.from").alias("src"), F.col("x.to").alias("dst")),
        "retarget": rows("retarget_edges").select(F.col("x.from").alias("src"), F.col("x.old_to").alias("old_dst"), F.col("x.new_to").alias("dst")),
        "add": rows("add_edges").select(F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.rel"),
        "retier": rows("retier").select("x.id", "x.tier"),
        "merge": rows("merge").select(F.col("x.from").alias("alias"), F.col("x.into").alias("target")),
    }


def build_graph(spark: SparkSession, seeds_path: str, edges_path: str, amendments_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, type, tier), edges (src, dst, rel)) of the curated graph, amendments applied.

    The floor is assumed; seeds are algorithms that require their items; canon edges count
    where both ends exist; then the amendments follow in their fixed order.
    """
    from ..operators.graph import amend

    base, items = seeds(spark, seeds_path)
    a = amendments(spark, amendments_path)
    floor = base.select("id", F.lit("concept").alias("type"), F.lit("assumed").alias("tier"))
    algorithms = items.select("id", F.lit("algorithm").alias("type"), F.lit("derivation").alias("tier"))
    parts = items.select(F.col("item").alias("id"), F.col("kind").alias("type"), F.lit("statement").alias("tier"))
    order = floor.withColumn("p", F.lit(0)).unionByName(algorithms.withColumn("p", F.lit(1))).unionByName(parts.withColumn("p", F.lit(2))).unionByName(a["added"].withColumn("p", F.lit(3)))
    nodes = order.groupBy("id").agg(F.min(F.struct("p", "type", "tier")).alias("n")).select("id", "n.type", "n.tier")
    edges = items.select(F.col("id").alias("src"), F.col("item").alias("dst"), F.lit("requires").alias("rel"))
    canon = canon_edges(spark, edges_path).select("src", "dst", F.lit("requires").alias("rel"))
    known = nodes.select("id")
    canon = canon.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel")
    return amend(nodes, edges.unionByName(canon).distinct(), drop=a["drop"], retarget=a["retarget"], add=a["add"], retier=a["retier"], merge=a["merge"])


def brief(spark: SparkSession, path: str) -> DataFrame:
    """(component, subsystem, algorithms, files) of a hand-written project brief."""
    doc = _document(spark, path, "project string, subsystems map<string,array<string>>, components map<string,struct<algorithms:array<string>,files:array<string>>>")
    sub = doc.select(F.explode("subsystems").alias("subsystem", "cs")).select("subsystem", F.explode("cs").alias("component"))
    com = doc.select(F.explode("components").alias("component", "c")).select("component", "c.algorithms", "c.files")
    return com.join(sub, "component", "left").select("component", "subsystem", "algorithms", "files")


def profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries (node_id, state, at, evidence, suspect), denied (node_id)); empty without a document."""
    doc = _document(spark, path, "entries array<struct<node_id:string,state:string,at:string,evidence:string,suspect:boolean>>, denied map<string,string>", required=False)
    return doc.select(F.explode("entries").alias("e")).select("e.*"), doc.select(F.explode(F.map_keys("denied")).alias("node_id"))


def conventions(spark: SparkSession, path: str) -> DataFrame:
    """(prio, family, root, letter, means, pattern) of notation conventions."""
    doc = _document(spark, path, "families array<struct<family:string,roots:array<string>,symbols:array<struct<symbol:string,means:string,recognise:string>>>>")
    f = doc.select(F.posexplode("families").alias("prio", "f")).select("prio", "f.*")
    return f.select("prio", "family", F.explode("roots").alias("root"), "symbols").select("prio", "family", "root", F.explode("symbols").alias("s")).select("prio", "family", "root", F.col("s.symbol").alias("letter"), "s.means", F.coalesce("s.recognise", F.lit("")).alias("pattern"))


def alias_titles(spark: SparkSession, path: str) -> DataFrame:
    """(id, titles): an empty list is known to have no source, which is not the same as no row."""
    doc = _document(spark, path, "aliases map<string,array<string>>", required=False)
    return doc.select(F.explode("aliases").alias("id", "titles"))


def library_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((key, items), (domain, subsystem)); keys with empty lists stay."""
    doc = _document(spark, path, "libraries map<string,array<string>>, domain_subsystem map<string,string>")
    return doc.select(F.explode("libraries").alias("key", "items")), doc.select(F.explode("domain_subsystem").alias("domain", "subsystem"))


def library_topics(spark: SparkSession, path: str) -> DataFrame:
    """(key, topic, role, ord) of default endpoints by library and executable."""
    doc = spark.read.option("wholetext", True).text(path)
    m = doc.select(F.explode(F.from_json("value", "map<string,struct<publishes:array<string>,subscribes:array<string>>>")).alias("key", "v"))
    pubs = m.select("key", F.posexplode("v.publishes").alias("ord", "topic"), F.lit("publishes").alias("role"))
    return pubs.unionByName(m.select("key", F.posexplode("v.subscribes").alias("ord", "topic"), F.lit("subscribes").alias("role")))


def environment(path: str, current: dict[str, str]) -> dict[str, str]:
    """KEY=value lines of a file under the variables already set, which win."""
    found = {}
    try:
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, mark, value = line.strip().partition("=")
                if mark and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
    except FileNotFoundError:
        pass
    return found | current
