"""Readers and writers of records, graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPER_SCHEMA = (
    "seq BIGINT, paperId STRING, title STRING, abstract STRING, year INT, citationCount INT, venue STRING, url STRING, authors ARRAY<STRUCT<name:STRING>>, externalIds MAP<STRING,STRING>, screening STRUCT<relevant:BOOLEAN,confidence:DOUBLE,reason:STRING>"
)
TRIPLE_SCHEMA = (
    "seq BIGINT, subject STRUCT<name:STRING,type:STRING>, relation STRING, object STRUCT<name:STRING,type:STRING>, confidence DOUBLE, evidence STRING, source_paper_id STRING, source_year STRING"
)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole-file JSON array or object; malformed files raise."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """One record a line, blank lines skipped; a bad line raises or, if tolerant, is left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def read_checkpoints(spark: SparkSession, folder: str, schema: str | T.StructType, pattern: str = "paper_*.json") -> DataFrame:
    """All per-paper checkpoint files of a folder, unreadable ones left out."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").json(folder, multiLine=True, mode="DROPMALFORMED", pathGlobFilter=pattern)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def normalise_papers(raw: DataFrame) -> DataFrame:
    """Papers under either set of column names: paperId, paper_id or id; year or publication_year."""
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have])
    out = raw.withColumn("paperId", pick("paperId", "paper_id", "id"))
    return out.withColumn("year", pick("year", "publication_year").try_cast("int"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two tables; edges are clustered by their start."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("u").sortWithinPartitions("u", "v").write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the elements of a GraphML document; arrays joined by commas, nulls as ''."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("part"), F.format_string('<node id="%s"><data key="type">%s</data></node>', esc(F.col("node")), esc(F.col("type"))).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data><data key="paper">%s</data><data key="year">%s</data></edge>', *[esc(F.col(c)) for c in ("u", "v", "relation", "source_paper", "year")]).alias("value"))
    return n.unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file, sorted; for graphs that a viewer can open."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(-1, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (2, "</graph></graphml>")], "part int, value string")
    graphml_lines(nodes, edges).unionByName(head).coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def write_ranked_csv(ranked: DataFrame, path: str) -> None:
    """rank, type, score and the description's first 200 characters; a header even without rows."""
    x = ranked.select("rank", F.col("family").alias("type"), F.col("composite_score").alias("score"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"))
    x.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_review_csv(df: DataFrame, path: str, separator: str = "; ") -> None:
    """A reviewer's sheet: lists joined, one file (A10)."""
    cols = [F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def write_gate(decisions: DataFrame, path: str) -> None:
    """The audit of all candidates, and the eligible and review queues, each its own table."""
    decisions.write.mode("overwrite").parquet(f"{path}/audit")
    written = decisions.sparkSession.read.parquet(f"{path}/audit")
    for status, name in (("automatically_eligible", "eligible"), ("review_required", "review")):
        written.where(F.col("status") == status).write.mode("overwrite").parquet(f"{path}/{name}")


def resolve_corpus(spark: SparkSession, configured: str | None, folder: str, names: tuple[str, ...] = ("corpus_filtered", "filtered_papers", "filtered_corpus", "screened_papers")) -> DataFrame | None:
    """The corpus table that exists first, or None, which is not an empty corpus."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [configured] if configured else [f"{folder}/{n}" for n in names]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.parquet(path)
    return None


def candidate_input(eligible: DataFrame | None, validated: DataFrame | None, raw: DataFrame | None) -> tuple[DataFrame, bool]:
    """The strictest candidates there are, and whether they passed the gate."""
    for df, passed in ((eligible, True), (validated, True), (raw, False)):
        if df is not None:
            return df, passed
    raise ValueError("no candidates: run detection first")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a folder (A18); read in parallel, contents never leave the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One row: a digest of all digests, whatever the order of files (A18); of a run's outputs, a bounded list."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("digest"))


def run_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(run, newest, files): runs under a root by their newest file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    run = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.groupBy(run.alias("run")).agg(F.max("modificationTime").alias("newest"), F.count("*").alias("files"))
