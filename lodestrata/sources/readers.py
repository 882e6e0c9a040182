"""Readers: JSON lines, trees of JSON files, wrapped arrays, maps, XML catalogs, logs, listings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.functions.columns import SOURCE, extension, is_test_path, language, squeeze
from lodestrata.sources.shared import exists

BAD = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are no rows, a line that does not parse has its text in _corrupt_record."""
    s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if BAD not in s.fieldNames():
        s = T.StructType([*s.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    # by an expression: a scan of JSON files refuses to give the lines that did not parse alone
    return lines.select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and those that did not."""
    return df.where(F.col(BAD).isNull()).drop(BAD), df.where(F.col(BAD).isNotNull()).select(BAD)


def json_files(spark: SparkSession, folder: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One document a file, in folders of any depth; files that do not parse are left out."""
    s = T._parse_datatype_string(f"{schema}, {BAD} string")
    reader = spark.read.schema(s).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(folder).where(F.col(BAD).isNull()).drop(BAD)


def wrapped(spark: SparkSession, folder: str, array: str, element: str, glob: str = "*.json") -> DataFrame:
    """Elements of a top-level array of each file."""
    return json_files(spark, folder, f"{array} array<struct<{element}>>", glob).select(F.explode(array).alias("x")).select("x.*")


def map_values(spark: SparkSession, folder: str, field: str, element: str, glob: str = "*.json") -> DataFrame:
    """Values of a top-level map of each file."""
    return json_files(spark, folder, f"{field} map<string, struct<{element}>>", glob).select(F.explode(F.map_values(field)).alias("x")).select("x.*")


def weakness_catalog(spark: SparkSession, path: str) -> DataFrame:
    """id, name, description and extended description of each weakness of an XML catalog."""
    nested = "Related_Weaknesses struct<Related_Weakness: array<struct<_Nature: string, _CWE_ID: string, _View_ID: string>>>"
    df = spark.read.format("xml").option("rowTag", "Weakness").schema(f"_ID string, _Name string, Description string, Extended_Description string, {nested}").load(path)
    text = lambda c: F.coalesce(squeeze(F.col(c)), F.lit(""))
    return df.select(F.col("_ID").alias("id"), F.col("_Name").alias("name"), text("Description").alias("desc"), text("Extended_Description").alias("desc_ext"), F.col("Related_Weaknesses.Related_Weakness").alias("related"))


def weakness_edges(catalog: DataFrame, view: str = "1000") -> DataFrame:
    """(child, parent) of a view."""
    r = catalog.select(F.col("id").alias("child"), F.explode("related").alias("r"))
    return r.where((F.col("r._Nature") == "ChildOf") & (F.col("r._View_ID") == view)).select("child", F.col("r._CWE_ID").alias("parent")).distinct()


def category_members(spark: SparkSession, path: str, view: str = "699") -> DataFrame:
    """(node, category) of a view."""
    df = spark.read.format("xml").option("rowTag", "Category").schema("_ID string, _Name string, Relationships struct<Has_Member: array<struct<_CWE_ID: string, _View_ID: string>>>").load(path)
    m = df.select(F.col("_ID").alias("category"), F.explode("Relationships.Has_Member").alias("m"))
    return m.where(F.col("m._View_ID") == view).select(F.col("m._CWE_ID").alias("node"), "category").distinct()


def catalog_roots(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    return catalog.select(F.col("id").alias("node")).join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def ids(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """White-space separated ids of text files, each once; none where there is no such file, an error if ``strict``."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """path (relative to the folder), extension, is_parent and content of files in folders of any depth."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    top = folder.rstrip("/")
    path = F.regexp_replace("path", "^.*?" + r"\Q" + top.split("://", 1)[-1] + r"\E/", "")
    out = df.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), "length")
    out = out.withColumn("extension", F.lower(extension(F.col("path")))).withColumn("is_parent", F.col("path").rlike(r"_parent(\.[^./]*)?$"))
    return out.where(F.col("extension").isin(extensions)) if extensions else out


def sidecar_status(items: DataFrame, sidecars: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``items`` with the JSON text of their sidecar and its status: found, missing, or error where it does not parse."""
    side = sidecars.select(*keys, F.col(content).alias(content), F.lit(True).alias("there_"))
    met = items.join(side, keys, "left")
    ok = F.try_parse_json(content).isNotNull()
    status = F.when(F.col("there_").isNull(), "missing").when(F.coalesce(ok, F.lit(False)), "found").otherwise("error")
    return met.withColumn("status", status).withColumn(content, F.when(F.col("status") == "found", F.col(content))).drop("there_")


def project_sources(listing: DataFrame, path: str = "path", with_tests: bool = True) -> DataFrame:
    """C and C++ files of a listing; without ``with_tests`` those of test folders and named like tests are left out."""
    out = listing.where(F.lower(extension(F.col(path))).isin(SOURCE))
    return out if with_tests else out.where(~is_test_path(F.col(path)))


def tree_listing(lines: DataFrame, extensions: list[str], deny: list[str]) -> DataFrame:
    """commit_id, file, blob_oid, lang from lines (commit_id, value) such as '100644 blob <oid>\\t<path>'."""
    oid, path = F.regexp_extract("value", r"^\d+ blob ([0-9a-f]+)\t", 1), F.regexp_extract("value", r"^\d+ blob [0-9a-f]+\t(.*)$", 1)
    out = lines.select("commit_id", path.alias("file"), oid.alias("blob_oid")).where("blob_oid <> ''")
    out = out.where(F.lower(extension(F.col("file"))).isin(extensions))
    for prefix in deny:
        out = out.where(~F.startswith("file", F.lit(prefix)))
    return out.withColumn("lang", language(F.col("file")))


def log_blocks(lines: DataFrame, order: str = "line", header: str = r"^[0-9a-f]{40}\t") -> DataFrame:
    """hash and body of each block of a log (scope, line, value): a line with hash and tab begins one."""
    w = Window.partitionBy("scope").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(F.col("value").rlike(header).cast("int")).over(w)).where("block > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]), "\n")
    return numbered.groupBy("scope", "block").agg(body.alias("text")).select("scope", F.substring_index("text", "\t", 1).alias("hash"), F.expr("substring(text, instr(text, '\t') + 1)").alias("body"))


def prediction_files(spark: SparkSession, glob: str) -> DataFrame:
    """Predictions of sibling runs; lines that do not parse are left out."""
    schema = "cve_id string, commit_id string, root_parent_id string, predicted_functions array<struct<file: string, sig: string>>"
    return split_rejects(jsonl(spark, glob, schema))[0]


def html_fields(page: Column) -> Column:
    """Title, links and text of a page by patterns; the text is what is left without script, style and markup."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    entities = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    text = F.regexp_replace(bare, "<[^>]*>", " ")
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for a, b in entities:
        text, title = F.replace(text, F.lit(a), F.lit(b)), F.replace(title, F.lit(a), F.lit(b))
    return F.struct(squeeze(title).alias("title"), F.regexp_extract_all(page, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), 1).alias("links"), squeeze(text).alias("text"))


def month_links(pages: DataFrame) -> DataFrame:
    """Distinct links of paginated listings (year, month, page, links): pages up to the first that is empty or repeats page 1."""
    first = pages.where("page = 1").select("year", "month", F.col("links").alias("first_"))
    p = pages.join(first, ["year", "month"], "left")
    stop = p.groupBy("year", "month").agg(F.min(F.when((F.size("links") == 0) | ((F.col("page") > 1) & (F.col("links") == F.col("first_"))), F.col("page"))).alias("stop"))
    kept = p.join(stop, ["year", "month"]).where(F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    return kept.groupBy("year", "month").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("links")))).alias("links"), F.max(F.col("stop").isNotNull()).alias("complete"))
