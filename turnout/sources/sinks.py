"""Sinks: per-event tables, reports, ordered text, append-only logs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnout.functions import fixed, text as T
from turnout.operators.ordered import tasks
from turnout.session import file_system
from turnout.sources.versions import Log

# Exported columns of the CRM views.
CONTACT_COLUMNS = (
    "email", "firstname", "lastname", "jobtitle", "company", "function", "seniority", "country", "region", "owner_email",
    "lifecyclestage", "attendance_status", "minutes", "icp_tier", "needs_review", "company_domain", "suppression_reason", "icp_source")
COMPANY_COLUMNS = ("domain", "name", "industry", "numemployees")
#: For tables of a folder per key: tasks move their own files into place, not the driver all of them one by one.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Packed files lie in a folder that listings pass over, with the columns of Spark's binary files.
PACKS = "_packs"
PACKED = "path string, modificationTime timestamp, length bigint, content binary"


def write_events(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Overwrite only the events present in ``df``; every other event's output stays."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
       .partitionBy("event_slug").format(fmt).save(path))


def write_views(contacts: DataFrame, companies: DataFrame, folder: str) -> None:
    """The three projections of one run: analyst view, contacts, companies."""
    flat = contacts.select(*[c for c, t in contacts.dtypes if not t.startswith(("array", "struct", "map"))])
    write_events(flat, f"{folder}/analyst", "csv", header=True)
    write_events(contacts.select("event_slug", *[c for c in CONTACT_COLUMNS if c in contacts.columns]), f"{folder}/contacts", "csv", header=True)
    write_events(companies.select("event_slug", *COMPANY_COLUMNS), f"{folder}/companies", "csv", header=True)


def write_report(report: DataFrame, path: str) -> None:
    write_events(report, path, "json")


def write_ordered_text(blocks: DataFrame, path: str, key: str, number: str) -> None:
    """Text blocks per key in order: part files sort by name, rows inside them by number.

    Range partitioning keeps the order without gathering a key's blocks into one value.  The number of tasks is
    kept as stated: blocks are few bytes but a file for each key.
    """
    ranged = blocks.repartitionByRange(tasks(blocks.sparkSession), key, number).sortWithinPartitions(key, number).select(key, "value")
    ranged.write.mode("overwrite").options(**MANY_FILES).partitionBy(key).text(path)


def append_log(rows: DataFrame, path: str, part: str | int) -> None:
    """Add ``rows`` to a log as its ``part``; a repeated job or batch replaces what it wrote before."""
    Log(rows.sparkSession, path).append(part, rows)


def write_assets(assets: DataFrame, folder: str) -> None:
    """Text files of assets (``asset_id``, ``value``), packed: a folder and a file for each would be as many as there are assets.

    Packs are Parquet below ``folder`` with the columns of Spark's binary files, a row for each file: its path,
    size and time, and its bytes (the text and the end of its last line).
    """
    content = F.encode(F.concat(F.coalesce("value", F.lit("")), F.lit("\n")), "UTF-8")
    rows = assets.select(F.concat(F.lit("asset_id="), F.url_encode("asset_id"), F.lit("/part")).alias("path"), content.alias("content"))
    rows.select("path", F.current_timestamp().alias("modificationTime"), F.octet_length("content").cast("bigint").alias("length"), "content").write.parquet(
        f"{folder}/{PACKS}")


def manifest(spark: SparkSession, folder: str, verdicts: DataFrame) -> DataFrame:
    """Files that exist under ``folder`` (``.../asset_id=.../part``), loose or packed: kind, maker, size, words and whether they are grounded.

    The asset's name or ending tells its kind and maker; content is read for Markdown alone, to count words.
    Loose files, such as films, are listed one by one by the driver.
    """
    of_asset = lambda path: F.url_decode(F.regexp_extract(path, "asset_id=([^/]+)/", 1)).alias("asset_id")
    markdown = F.col("asset_id").endswith(".md")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        of_asset("path"), "length", "modificationTime", F.lit(None).cast("bigint").alias("words"))
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(
        of_asset(F.replace(F.col("_metadata.file_path"), F.lit("%25"), F.lit("%"))), F.col("value"))  # an address there, with % escaped
    found = found.unionByName(lines.filter(markdown).select("asset_id", T.words(F.col("value")).cast("bigint").alias("words")), allowMissingColumns=True)
    fs, packs = file_system(spark, f"{folder}/{PACKS}")
    if fs.exists(packs):
        packed = spark.read.schema(PACKED).parquet(f"{folder}/{PACKS}").withColumn("asset_id", of_asset("path"))
        words = F.when(markdown, T.words(F.decode("content", "UTF-8"))).cast("bigint")
        found = found.unionByName(packed.select("asset_id", "length", "modificationTime", words.alias("words")))
    sizes = found.filter("asset_id <> ''").groupBy("asset_id").agg(
        F.count("length").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("written"), F.sum("words").alias("words"))
    name = F.element_at(F.split("asset_id", "/"), -1)
    kind = source = F
    for ending, (what, maker) in fixed.ASSET_KINDS.items():
        hit = name.endswith(ending) if ending[0] == "." else name == ending
        kind, source = kind.when(hit, what), source.when(hit, maker)
    return sizes.withColumns({"kind": kind.otherwise("other"), "source": source.otherwise("unknown")}).join(
        verdicts.select("asset_id", F.col("passed").alias("grounded")), "asset_id", "left")
