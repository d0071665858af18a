"""Import edges and cycles, by equi-joins and an iterated distinct join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..sources.storage import cut

# How a line names the module that it imports.
IMPORTS = (r"from\s+([\w.\-/]+)\s+import", r"import\s+([\w.\-/]+)", r"""import\s+.*from\s+['"]([./\w\-]+)['"]""", r"""require\(['"]([./\w\-]+)['"]\)""")


def base_name(path):
    """The last path segment up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def import_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst) between file paths of chunks(file_path, content); of files with the same
    base name the last in path order is meant."""
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in IMPORTS]))
    wanted = chunks.select(F.col("file_path").alias("src"), F.explode(found).alias("module")).select("src", base_name("module").alias("name")).distinct()
    files = chunks.groupBy(base_name("file_path").alias("name")).agg(F.max("file_path").alias("dst"))
    return wanted.join(files, "name").select("src", "dst").distinct()


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges whose ends both have an edge in and an edge out, and how many there are."""
    size = edges.count()
    while size:
        heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges, size


def _spread_least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after each label has flowed along the edges, the least winning."""
    labels = cut(nodes)
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
        now = cut(labels.join(sent, "node", "left").select("node", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("moved")))
        labels = now.select("node", "label")
        if not now.where("moved").take(1):
            return labels


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node) of every node that can reach itself.

    Rounds of trimming and colouring: nodes without an edge in or out are stripped; the
    least reachable name colours the rest; what also reaches its colour's first node,
    inside the colour, is one strongly connected component, which is set aside. Memory is
    linear in the edges, and a round needs as many joins as its longest shortest path.
    """
    live, size = _trimmed(cut(edges.select("src", "dst").distinct()))
    found = live.where("src = dst").select(F.col("src").alias("node")).distinct()
    while size:
        nodes = live.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))
        colour = _spread_least(nodes, live)
        inside = live.join(colour.select(F.col("node").alias("src"), F.col("label").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("cd")), "dst").where("cs = cd")
        # backwards from each colour's first node: 0 marks it and what reaches it
        back = cut(inside.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _spread_least(colour.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label")), back).where("label = 0").select("node")
        part = reached.join(colour, "node")
        large = part.join(part.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "label", "left_semi").select("node")
        found = cut(found.union(large).distinct())
        live, size = _trimmed(cut(live.join(reached.withColumnRenamed("node", "src"), "src", "left_anti").join(reached.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    return found


def latest(rows: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
