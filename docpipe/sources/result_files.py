"""One file per result, written as a Spark data source with two phases.

Tasks write their files to a folder of their own run under the target, with a
list of their names, and tell the driver where that is. When all have ended, the
driver's commit gives the files of successful tasks their names, list by list,
by renames of whole files; until then no result is visible. If a task fails for
good the run's folder is deleted and nothing has changed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "docpipe_result_files"
#: Renames that the commit has under way at once, and names that it holds.
RENAMES, NAMES = 32, 4096


def register_result_files(spark: SparkSession) -> str:
    """Registers the format and returns its name. The classes are made here, so
    that they are sent to workers whole."""
    renames, names_held = RENAMES, NAMES

    class Written(WriterCommitMessage):
        def __init__(self, part: str):
            self.part = part

    def store_of(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")

    class ResultWriter(DataSourceArrowWriter):
        """``name, content``: file name under the folder, text."""

        def __init__(self, options: dict):
            self.folder, self.run = options["path"].rstrip("/"), options["run"]

        def staging(self) -> str:
            return f"{self.folder}/_staging-{self.run}"

        def write(self, iterator) -> WriterCommitMessage:
            import json
            import uuid

            # Two tries of a task don't share files.
            store, base = store_of(f"{self.staging()}/{uuid.uuid4().hex}")
            store.create_dir(base, recursive=True)
            at = 0
            with store.open_output_stream(f"{base}/names") as names:
                for batch in iterator:
                    for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                        with store.open_output_stream(f"{base}/{at}") as out:
                            out.write((content or "").encode("utf-8"))
                        names.write(f"{json.dumps(str(name))}\n".encode())
                        at += 1
            return Written(base.rpartition("/")[2])

        def commit(self, messages) -> None:
            import io
            import json
            from concurrent.futures import ThreadPoolExecutor
            from itertools import count, islice

            store, folder = store_of(self.folder)
            _, staging = store_of(self.staging())
            made = set()

            def move(base: str, at: int, name: str) -> None:
                store.move(f"{base}/{at}", f"{folder}/{name}")

            with ThreadPoolExecutor(renames) as pool:
                for base in (f"{staging}/{m.part}" for m in messages if m is not None):
                    at = count()
                    with io.BufferedReader(store.open_input_stream(f"{base}/names")) as listed:
                        while names := [json.loads(line) for line in islice(listed, names_held)]:
                            for parent in sorted({name.rpartition("/")[0] for name in names} - made):
                                store.create_dir(f"{folder}/{parent}".rstrip("/"), recursive=True)
                                made.add(parent)
                            list(pool.map(move, [base] * len(names), islice(at, len(names)), names))
            self.abort(messages)

        def abort(self, messages) -> None:
            store, staging = store_of(self.staging())
            if store.get_file_info(staging).type.name == "Directory":
                store.delete_dir(staging)

    class ResultFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "name string, content string"

        def writer(self, schema, overwrite: bool):
            return ResultWriter(dict(self.options))

    spark.dataSource.register(ResultFiles)
    return FORMAT
