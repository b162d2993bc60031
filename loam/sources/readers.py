"""Sources: files, directories and inline values as rows of (source, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a walk leaves out.
SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache")


def files(spark: SparkSession, path: str, recursive: bool = True, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """path, content of the files under a path, and path, reason of those that are refused: for their size (whose bytes are not
    read), or because their name or a folder's below the path begins with an underscore, which Spark's readers pass over. Hidden files and
    SKIPPED directories are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    hidden = "|".join(rf"/{s.replace('.', chr(92) + '.')}/" for s in SKIPPED) + r"|/\.[^/]*(/|$)"
    inner = F.replace(F.col("path"), F.lit(path.rstrip("/")), F.lit(""))
    seen = found.filter(~inner.rlike(hidden))
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    passed_over = spark.createDataFrame([(p, "begins with an underscore") for p in underscored(spark, path, recursive)], "path string, reason string")
    inner = F.replace(F.col("path"), F.lit(path.rstrip("/")), F.lit(""))
    return seen.filter(fits).select("path", "content"), seen.filter(~fits).select("path", F.lit("too large").alias("reason")).unionByName(passed_over.filter(~inner.rlike(hidden)))


def underscored(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """Files below a path that Spark does not list. The driver lists the path, as Spark itself does, and keeps these names alone."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = system.makeQualified(top)
    if not system.exists(top):
        return []
    found, listed = [], system.listFiles(top, recursive)
    while listed.hasNext():
        file = listed.next().getPath().toString()
        if "/_" in file[len(top.toString()) :]:
            found.append(file)
    return found


def inline(value: Column) -> Column:
    """The bytes of an inline value: strict base64, else the text itself."""
    strict = value.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(value) > 0)
    return F.when(strict, F.try_to_binary(value, F.lit("base64"))).otherwise(F.encode(value, "utf-8"))


def inline_uri(value: Column, extension: str = ".txt") -> Column:
    return F.concat(F.lit("inline:"), F.substring(F.sha2(value, 256), 1, 32), F.lit(extension))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from JSON lines; fails if an id is missing or repeats."""
    rows = spark.read.schema("id string, query string, relevant_chunk_ids array<string>, relevant_document_ids array<string>, answer_reference string, metadata map<string,string>, source string, created_at string").json(path)
    bad = rows.groupBy("id").count().filter("id IS NULL OR count > 1").head(1)
    if bad or rows.filter("query IS NULL").head(1):
        raise ValueError("golden queries need an id of their own and a query")
    return rows


def write_golden(rows: DataFrame, path: str, order: str = "id") -> None:
    """Golden queries as JSON lines that golden() reads: by `order`, keys sorted and nulls written, so that a set made anew differs only where its rows do."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    rows.orderBy(order).select(line.alias("value")).write.text(path)
