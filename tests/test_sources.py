"""Blob manifests, results, ledger tables, collections and checks."""

import pickle
from datetime import datetime
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docpipe.fixtures import Inputs
from docpipe.functions.scalars import blob_url
from docpipe.operators import checks, credentials
from docpipe.plans.ordered import sliced_row_number
from docpipe.schemas import LEDGER
from docpipe.session import SIZES, shared_dir
from docpipe.sources import blobs, collections
from docpipe.sources.result_files import register_result_files

NOW = datetime(2024, 1, 15)
MANIFEST = "name string, size bigint, created timestamp_ntz, modified timestamp_ntz, metadata map<string,string>"


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame(
        [("a.txt", 1, NOW, NOW, {}), ("b.txt", 2, NOW, NOW, {}), ("a.txt.meta", 9, NOW, NOW, {})], MANIFEST
    )


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_listing(manifest):
    assert [r.name for r in blobs.list_blobs(manifest).collect()] == ["a.txt", "b.txt"]
    assert [r.name for r in blobs.list_blobs(manifest, "b").collect()] == ["b.txt"]
    assert [r.name for r in blobs.list_blobs(manifest, limit=1).collect()] == ["a.txt"]


def test_lifecycle(spark, manifest):
    incoming = spark.createDataFrame(
        [("c.txt", 5, "text/plain", {"owner": "x", "content_type": "mine"}, NOW, 1),
         ("b.txt", 7, "text/plain", None, NOW, 1), ("b.txt", 8, "text/plain", None, NOW, 2)],
        "name string, size bigint, content_type string, metadata map<string,string>, uploaded_at timestamp_ntz, seq int",
    )
    after = {r.name: r for r in blobs.upsert_blobs(manifest, incoming, base="/data").collect()}
    assert after["b.txt"].size == 8 and after["a.txt"].url is None
    assert after["c.txt"].url == "file:///data/c.txt"
    assert after["c.txt"].metadata == {"created": "2024-01-15T00:00:00", "owner": "x", "content_type": "mine"}
    rest, flags = blobs.remove_blobs(manifest, names(spark, "a.txt", "zzz"))
    assert sorted(r.name for r in rest.collect()) == ["a.txt.meta", "b.txt"]
    assert {r.name: r.deleted for r in flags.collect()} == {"a.txt": True, "zzz": False}
    _, s3 = blobs.remove_blobs(manifest, names(spark, "zzz"), "s3")
    assert s3.collect()[0].deleted is True


def test_fetch(spark):
    stored = spark.createDataFrame([("a", bytearray(b"x"))], "name string, content binary")
    got = {r.name: (r.outcome, r.content) for r in blobs.fetch_blobs(names(spark, "a", "b"), stored).collect()}
    assert got == {"a": ("ok", bytearray(b"x")), "b": ("not_found", None)}


def test_metadata_is_replaced(spark, manifest):
    sidecars = spark.createDataFrame([("a.txt.meta", "key1=v1\nkey2=v2")], "name string, meta string")
    joined = {r.name: r.metadata for r in blobs.blob_with_metadata(manifest, sidecars).collect()}
    assert joined == {"a.txt": {"key1": "v1", "key2": "v2"}, "b.txt": {}}
    changes = spark.createDataFrame(
        [("a.txt", {"key3": "v3"}), ("zzz", {"k": "v"})], "name string, metadata map<string,string>"
    )
    table, flags = blobs.set_blob_metadata(sidecars, changes, manifest)
    assert [(r.name, r.meta) for r in table.collect()] == [("a.txt.meta", "key3=v3")]
    assert {r.name: r.updated for r in flags.collect()} == {"a.txt": True, "zzz": False}


def test_unknown_provider():
    with pytest.raises(ValueError, match="Unknown blob storage provider"):
        blob_url(F.lit("a"), "invalid")


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([("j1", "café", "json"), ("j2", "", "text")], "job_id string, content string, output_format string")
    for _ in range(2):
        blobs.write_results(df, str(tmp_path / "out"), "files")
    assert (tmp_path / "out" / "j1.md").read_text("utf-8") == "café"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["j1.md", "j2.md"]
    blobs.write_results(df, str(tmp_path / "by"), "files", ext_by_format=True)
    assert sorted(p.name for p in (tmp_path / "by").iterdir()) == ["j1.json", "j2.txt"]
    with pytest.raises(ValueError):
        blobs.write_results(df, str(tmp_path), "zip")


def test_ledger(spark, tmp_path):
    grants = spark.createDataFrame([("j", "u", "o", NOW)], LEDGER["job_access_grants"])
    blobs.append_rows(grants, f"{tmp_path}/job_access_grants", "job_access_grants")
    tables = blobs.load_ledger(spark, str(tmp_path))
    assert tables["job_access_grants"].count() == 1 and tables["jobs"].count() == 0
    assert tables["jobs"].schema.fieldNames() == LEDGER["jobs"].fieldNames()
    twice = grants.unionByName(grants)
    with pytest.raises(blobs.ConstraintError, match="duplicate primary key"):
        blobs.append_rows(twice, f"{tmp_path}/x", "job_access_grants")
    broken = grants.withColumn("granted_by_user_id", F.lit(None).cast("string"))
    with pytest.raises(blobs.ConstraintError, match="null in a required column"):
        blobs.append_rows(broken, f"{tmp_path}/x", "job_access_grants")


def test_append_twice_leaves_one_copy(spark, tmp_path):
    def grants(by):
        row = spark.createDataFrame([("j", "u", by)], "job_id string, granted_to_user_id string, granted_by_user_id string")
        return row.withColumn("granted_at", F.lit("2024-01-01").cast("timestamp_ntz"))

    path = f"{tmp_path}/job_access_grants"
    for _ in range(2):
        blobs.append_rows(grants("o"), path, "job_access_grants")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(blobs.ConstraintError, match="duplicate primary key"):
        blobs.append_rows(grants("p"), path, "job_access_grants")


def test_scan_plain_and_uri_paths(spark, tmp_path):
    for name, content in (("a b.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(content)
    paths = [(f"{tmp_path}/a b.txt", 3), (f"file://{tmp_path}/b.txt", 3), (f"file:{tmp_path}/c.txt", 0)]
    manifest = spark.createDataFrame(paths, "path string, size bigint")
    rows = blobs.scan_files(spark, str(tmp_path), manifest=manifest).collect()
    assert {r.path.rsplit("/", 1)[1]: r.content for r in rows} == {"a b.txt": b"one", "b.txt": b"two", "c.txt": None}
    assert len(rows) == 3
    with pytest.raises(ValueError, match="takes no path"):
        blobs.scan_files(spark, str(tmp_path), manifest=manifest.withColumn("content", F.lit(b"x")))


def test_collections(spark):
    coll = spark.createDataFrame([("1", "a", 1), ("2", "b", None)], "id string, name string, n int")
    updates = spark.createDataFrame([("1", None, 5), ("9", "x", 0)], "id string, name string, n int")
    got = {r.id: (r.name, r.n) for r in collections.collection_update(coll, updates, ["name", "n"], "id").collect()}
    assert got == {"1": (None, 5), "2": ("b", None)}
    added = collections.collection_insert(coll, spark.createDataFrame([("z",)], "name string"), "id", ["name"])
    assert added.count() == 3 and all(r.id for r in added.collect())
    new = spark.createDataFrame([("z", None), ("z", None), ("y", "7")], "name string, id string")
    twice = collections.collection_insert(added, new, "id", ["name"]).collect()
    assert len({r.id for r in twice}) == 6 and {r.id for r in added.collect()} < {r.id for r in twice}
    assert [r.id for r in twice if r.name == "y"] == ["7"]
    assert collections.collection_query(coll, {"name": "b"}, "id").collect()[0].id == "2"
    flags = collections.collection_flags(coll, updates, "id", "updated").collect()
    assert {r.id: r.updated for r in flags} == {"1": True, "9": False}


def test_checks(spark):
    df = spark.createDataFrame([(1, "admin"), (1, None), (2, "boss")], "k int, role string")
    assert [(r.k, r["rows"]) for r in checks.check_primary_key(df, ["k"]).collect()] == [(1, 2)]
    assert {r.role for r in checks.check_enum(df, "role", ["admin"]).collect()} == {None, "boss"}
    assert [tuple(r) for r in checks.check_not_null(df, ["k", "role"]).collect()] == [("role", 1)]
    parent = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in checks.check_foreign_key(df, parent, "k").collect()] == [2]


def test_token_rules(spark):
    rows = [("a", True, None), ("b", False, None), ("c", True, NOW), ("d", True, datetime(2024, 1, 14))]
    tokens = spark.createDataFrame(rows, "token_id string, is_active boolean, expires_at timestamp_ntz")
    got = {r.token_id: r.state for r in credentials.token_state(tokens, NOW).collect()}
    assert got == {"a": "valid", "b": "disabled", "c": "valid", "d": "expired"}
    made = spark.createDataFrame([(NOW, 0), (NOW, None), (NOW, 30)], "created_at timestamp_ntz, expires_days int")
    assert [r.expires_at for r in credentials.token_expiry(made).collect()] == [NOW, None, datetime(2024, 2, 14)]


def test_sliced_rank_equals_window(spark):
    df = spark.range(3000).selectExpr("id % 3 AS k", "hash(id) % 500 AS v", "id")
    ranked = sliced_row_number(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 40), "n")
    rows = sorted(ranked.collect(), key=lambda r: (r.k, r.v, r.id))
    expected = {}
    for r in rows:
        expected[r.k] = expected.get(r.k, 0) + 1
        assert r.n == expected[r.k]


def test_shared_folder_or_an_error():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    assert shared_dir(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))


def test_result_files_all_or_none(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.col("id").alias("job_id"), F.concat(F.lit("text é "), F.col("id").cast("string")).alias("content"))
    blobs.write_results(rows, f"{tmp_path}/out", layout="files")
    names = {f.name for f in (tmp_path / "out").iterdir()}
    assert names == {f"{i}.md" for i in range(40)} and (tmp_path / "out" / "7.md").read_text(encoding="utf-8") == "text é 7"
    # The last rows fail after others are written: what was there stays as it was.
    bad = rows.withColumn("content", F.when(F.col("job_id") == 39, F.raise_error(F.lit("half way")).cast("string")).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="half way"):
        blobs.write_results(bad, f"{tmp_path}/out", layout="files")
    assert {f.name for f in (tmp_path / "out").iterdir()} == names
    assert (tmp_path / "out" / "7.md").read_text(encoding="utf-8") == "text é 7"
    blobs.write_results(rows.withColumn("content", F.lit(None).cast("string")), f"{tmp_path}/out", layout="files")
    assert (tmp_path / "out" / "7.md").read_text(encoding="utf-8") == ""


def test_result_names_stay_in_the_folder(tmp_path):
    """A task tells the driver where its names are, not the names."""
    made = []
    register_result_files(SimpleNamespace(dataSource=SimpleNamespace(register=made.append)))
    writer = made[0]({"path": f"{tmp_path}/out", "run": "r"}).writer(None, False)
    names = [f"{i % 3}/{i}.md" for i in range(500)]
    message = writer.write(iter([pa.RecordBatch.from_pydict({"name": names, "content": [*map(str, range(500))]})]))
    assert len(pickle.dumps(vars(message))) < 200
    writer.commit([message, None])
    assert {n: (tmp_path / "out" / n).read_text() for n in names} == {n: str(i) for i, n in enumerate(names)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0", "1", "2"]


def test_sizes_are_set_once(spark):
    """Sizes that bound a task's memory are set unless the session has its own."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = spark.newSession()
    for k in SIZES:
        own.conf.unset(k)
    own.conf.set("spark.sql.files.openCostInBytes", "1m")
    Inputs(own, "/nowhere")
    assert own.conf.get(key) == SIZES[key] and own.conf.get("spark.sql.files.openCostInBytes") == "1m"
