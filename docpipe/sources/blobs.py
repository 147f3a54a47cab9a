"""Files, blob manifests, results and ledger tables.

A *manifest* is a table ``name, size, created, modified, metadata`` with the
metadata as a map. Bytes stay out of it unless an operator says otherwise.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from docpipe.functions.scalars import as_timestamp, blob_url, parse_sidecar, render_sidecar
from docpipe.plans.lookup import lookup
from docpipe.schemas import LEDGER, PRIMARY_KEYS
from docpipe.sources.result_files import register_result_files

SIDECAR_SUFFIX = ".meta"
DELETE_ALWAYS_TRUE = ("s3",)


def scan_files(spark: SparkSession, path: str | None = None, glob: str | None = None,
               recursive: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """File table ``path, size, modified, content``.

    Spark's binary reader leaves out empty files and names that start with an
    underscore. A manifest ``(path, size[, modified])`` adds those: entries the
    reader did not return become rows with null content. Paths are compared as
    the file system qualifies them, so a plain path and a URI are one file, and
    come out that way. Only paths are compared, so no bytes are shuffled. A
    manifest with content is the file table itself and takes no path.
    """
    found = None
    if path is not None:
        reader = spark.read.format("binaryFile")
        if glob is not None:
            reader = reader.option("pathGlobFilter", glob)
        if recursive:
            reader = reader.option("recursiveFileLookup", "true")
        found = reader.load(path).select(
            "path", F.col("length").alias("size"),
            F.col("modificationTime").cast("timestamp_ntz").alias("modified"), "content",
        )
    if manifest is None:
        if found is None:
            raise ValueError("A path or a manifest is needed")
        return found
    if "content" in manifest.columns:
        if path is not None:
            raise ValueError("A manifest with content takes no path")
        return manifest
    if found is None:
        raise ValueError("A manifest without content needs a path")
    listed = manifest.withColumn("path", qualified_path(spark, F.col("path")))
    unread = listed.join(found.select("path"), "path", "left_anti")
    return found.unionByName(unread, allowMissingColumns=True)


def qualified_path(spark: SparkSession, path: Column) -> Column:
    """A path as the binary reader writes it: with the scheme, and without an
    empty authority. Plain and relative paths belong to the default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    root = store.makeQualified(hadoop.Path("/")).toString().rstrip("/")
    here = store.makeQualified(store.getWorkingDirectory()).toString().rstrip("/")
    return (
        F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_replace(path, "^([A-Za-z0-9+.-]+):///", "$1:/"))
        .when(path.startswith("/"), F.concat(F.lit(root), path))
        .otherwise(F.concat(F.lit(f"{here}/"), path))
    )


def _is_blob(name: Column) -> Column:
    return ~name.endswith(SIDECAR_SUFFIX)


def list_blobs(files: DataFrame, prefix: str | None = None, limit: int = 1000) -> DataFrame:
    """First ``limit`` blobs by name, sidecars left out."""
    found = files.filter(_is_blob(F.col("name")))
    if prefix:
        found = found.filter(F.col("name").startswith(prefix))
    columns = [c for c in ("name", "size", "created", "modified", "metadata") if c in files.columns]
    return found.select(*columns).orderBy("name").limit(limit)


def fetch_blobs(names: DataFrame, files: DataFrame) -> DataFrame:
    """``name, outcome, content`` per wanted name; missing ones are rows."""
    stored = files.select("name", "content", F.lit(True).alias("__hit"))
    return lookup(names, stored, "name").select(
        "name",
        F.when(F.col("__hit"), F.lit("ok")).otherwise(F.lit("not_found")).alias("outcome"),
        "content",
    )


def blob_exists(names: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select("name").distinct().withColumn("__hit", F.lit(True))
    return names.select("name").join(known, "name", "left").select(
        "name", F.coalesce("__hit", F.lit(False)).alias("exists")
    )


def latest_by_name(incoming: DataFrame) -> DataFrame:
    """Last upload of each name by ``(uploaded_at, seq)``."""
    fields = [c for c in incoming.columns if c != "name"]
    order = F.struct("uploaded_at", "seq")
    return incoming.groupBy("name").agg(
        F.max_by(F.struct(*fields), order).alias("__last")
    ).select("name", "__last.*")


def upsert_blobs(manifest: DataFrame, incoming: DataFrame, url_scheme: str = "file", **location: str) -> DataFrame:
    """Manifest after uploads ``name, size, content_type, metadata,
    uploaded_at, seq``, plus ``url`` of each uploaded blob.

    The last upload of a name wins. ``content_type`` and ``created`` come first
    in the metadata, so user keys of the same name override them.
    """
    base = F.create_map(
        F.lit("content_type"), F.col("content_type"),
        F.lit("created"), F.translate(F.col("uploaded_at").cast("string"), " ", "T"),
    )
    user = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(user, k))
    last = latest_by_name(incoming)
    uploaded = last.select(
        "name",
        "size",
        F.col("uploaded_at").alias("created"),
        F.col("uploaded_at").alias("modified"),
        F.map_concat(kept, user).alias("metadata"),
        blob_url(F.col("name"), url_scheme, **location).alias("url"),
    )
    untouched = manifest.join(last.select("name"), "name", "left_anti").select(
        "name", "size", "created", "modified", "metadata", F.lit(None).cast("string").alias("url")
    )
    return untouched.unionByName(uploaded)


def remove_blobs(manifest: DataFrame, names: DataFrame, url_scheme: str = "file") -> tuple[DataFrame, DataFrame]:
    """``(manifest without the names, name + deleted flag per request)``. An S3
    delete reports true for missing keys as well."""
    rest = manifest.join(names.select("name"), "name", "left_anti")
    flags = blob_exists(names, manifest).withColumnRenamed("exists", "deleted")
    if url_scheme in DELETE_ALWAYS_TRUE:
        flags = flags.withColumn("deleted", F.lit(True))
    return rest, flags


def blob_with_metadata(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Listing with the metadata of ``name.meta``; an empty map where there is
    none. ``sidecars`` is ``name, meta``."""
    parsed = sidecars.select(
        F.expr(f"left(name, length(name) - {len(SIDECAR_SUFFIX)})").alias("name"),
        parse_sidecar(F.col("meta")).alias("metadata"),
    )
    empty = F.create_map().cast("map<string,string>")
    listing = files.filter(_is_blob(F.col("name"))).drop("metadata")
    return listing.join(parsed, "name", "left").withColumn("metadata", F.coalesce("metadata", empty))


def set_blob_metadata(sidecars: DataFrame, changes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces whole sidecars: ``changes`` is ``name, metadata`` per blob.
    Returns the sidecar table and ``name, updated``; missing blobs are not."""
    flags = blob_exists(changes, files).withColumnRenamed("exists", "updated")
    written = changes.join(files.select("name"), "name", "left_semi").select(
        F.concat("name", F.lit(SIDECAR_SUFFIX)).alias("name"),
        render_sidecar(F.col("metadata")).alias("meta"),
    )
    kept = sidecars.join(written.select("name"), "name", "left_anti")
    return kept.select("name", "meta").unionByName(written), flags


RESULT_EXTENSIONS = {"markdown": ".md", "json": ".json", "yaml": ".yaml", "text": ".txt"}


def result_path(directory: str, job_id: Column, output_format: Column | None = None,
                ext_by_format: bool = False) -> Column:
    """``{directory}/{job_id}.md`` whatever the format, unless asked otherwise."""
    extension = F.lit(".md")
    if ext_by_format and output_format is not None:
        for name, suffix in RESULT_EXTENSIONS.items():
            extension = F.when(output_format == name, F.lit(suffix)).otherwise(extension)
    return F.concat(F.lit(f"{directory.rstrip('/')}/"), job_id.cast("string"), extension)


def write_results(df: DataFrame, directory: str, layout: str = "table", ext_by_format: bool = False) -> None:
    """Writes ``job_id, content[, output_format]``. ``table`` is one Parquet
    table with the result paths; ``files`` one UTF-8 file per job on any file
    system Arrow knows, all of them or, if a task fails, none."""
    fmt = F.col("output_format") if "output_format" in df.columns else None
    named = df.withColumn("result_path", result_path(directory, F.col("job_id"), fmt, ext_by_format))
    if layout == "table":
        named.write.mode("overwrite").parquet(directory)
    elif layout == "files":
        name = F.substr("result_path", F.lit(len(directory.rstrip("/")) + 2))
        files = named.select(name.alias("name"), F.col("content").cast("string").alias("content"))
        options = {"path": directory, "run": uuid.uuid4().hex}
        files.write.format(register_result_files(df.sparkSession)).options(**options).mode("append").save()
    else:
        raise ValueError(f"Unknown layout: {layout}")


class ConstraintError(ValueError):
    """Rows that break a table constraint."""


def append_rows(df: DataFrame, path: str, table: str | None = None) -> None:
    """Appends a batch. With a ledger ``table`` name its NOT NULL columns are
    checked, and its primary key inside the batch and against the stored rows.
    Rows that are stored already, equal in all columns, are left out, so a
    batch that is tried again adds nothing. Two writers at once are not seen."""
    if table is not None:
        keys = PRIMARY_KEYS[table]
        required = [f.name for f in LEDGER[table] if not f.nullable and f.name in df.columns]
        columns = [f for f in LEDGER[table] if f.name in df.columns]
        row = F.sha2(F.to_json(F.struct(*(F.col(f.name).cast(f.dataType) for f in columns))), 256)
        missing = reduce(or_, (F.col(c).isNull() for c in required), F.lit(False))
        incoming = df.withColumn("__row", row).groupBy(*(F.col(k).cast("string") for k in keys)).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__row"), F.max(missing).alias("__missing"))
        stored = _load_table(df.sparkSession, path, LEDGER[table])
        known = stored.select(*(F.col(k).cast("string") for k in keys), row.alias("__stored"))
        broken = incoming.join(known, keys, "left").agg(
            F.max("__missing").alias("missing"),
            F.max((F.col("__n") > 1) | F.coalesce(F.col("__row") != F.col("__stored"), F.lit(False))).alias("twice"),
        ).first()
        if broken.missing:
            raise ConstraintError(f"{table}: null in a required column")
        if broken.twice:
            raise ConstraintError(f"{table}: duplicate primary key")
        df = df.join(stored.select(*keys), keys, "left_anti").select(*df.columns)
    df.write.mode("append").parquet(path)


def load_ledger(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The four ledger tables under ``directory`` with their declared schemas;
    a table that was never written is empty."""
    base = directory.rstrip("/")
    return {name: _load_table(spark, f"{base}/{name}", schema) for name, schema in LEDGER.items()}


def _load_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    store = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
