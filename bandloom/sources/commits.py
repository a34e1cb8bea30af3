"""Several kinds written as one: either all of them are seen, or none.

Data of a commit lie in ``_data/<kind>/commit_id=<id>`` below the folder, where readers of the folder do not look by
themselves. The last thing that a commit writes is its record, ``_commits/<name>.json``, one small file that appears whole;
it names the data and how many rows each kind has. Readers take what the records name, so what a lost driver leaves behind
is never seen, and a commit of the same name, as after a repeated ingest, takes the place of the one before. A file of a
commit holds many sessions, one after the other, with their ids as a column; commits of before have a folder a session, and
are read as they are.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks
from .ranges import located
from .tables import ContractError, read_products

DATA, RECORDS = "_data", "_commits"


class Commit:
    """``with Commit(spark, folder, name) as c: c.save_kind(...)``. Leaving the block writes the record; an exception in it
    deletes what was written and goes on. ``rows`` tells the rows of each kind, counted by the tasks that wrote them."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        if not name or "/" in name or name.startswith((".", "_")):
            raise ContractError(f"not a name of a commit: {name!r}")
        self.spark, self.folder, self.name, self.id = spark, folder.rstrip("/"), name, uuid.uuid4().hex
        self.rows: dict[str, int] = {}
        self.counts: dict[str, dict[str, int]] = {}
        self.schemas: dict[str, str] = {}

    def __enter__(self) -> Commit:
        return self

    def _begin(self, kind: str) -> str:
        if kind in self.schemas:
            raise ContractError(f"{kind} is written twice in one commit")
        self.schemas[kind] = ""
        return f"{self.folder}/{DATA}/{kind}/commit_id={self.id}"

    def save_kind(self, df: DataFrame, kind: str, slices: int = 1, **provenance: str) -> None:
        """One kind in its own layout, checked as ``sinks.save_kind`` does."""
        seen = Observation()
        path = self._begin(kind)
        wrote = sinks.save_kind(df, path, kind, slices, name="", counted=seen, apart=False, **provenance)
        self.rows[kind], self.schemas[kind] = seen.get["rows"], wrote.schema.json()

    def table(self, df: DataFrame, kind: str, counts: dict | None = None) -> None:
        """A table without a layout; ``counts`` (name -> condition) are counted while it is written."""
        seen = Observation()
        path = self._begin(kind)
        more = {f"c{i}": F.count_if(c).alias(f"c{i}") for i, c in enumerate((counts or {}).values())}
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *more.values()).write.parquet(path)
        got = seen.get
        self.rows[kind], self.schemas[kind] = got["rows"], df.schema.json()
        self.counts[kind] = {name: got[f"c{i}"] for i, name in enumerate(counts or {})}

    def __exit__(self, kind, error, trace) -> None:
        system, top = located(self.folder)
        if kind is not None:
            for k in self.schemas:
                _delete(system, f"{top}/{DATA}/{k}/commit_id={self.id}")
            return
        system.create_dir(f"{top}/{RECORDS}", recursive=True)
        part = f"{top}/{RECORDS}/.{self.id}"
        said = {"name": self.name, "id": self.id, "rows": self.rows, "counts": self.counts, "schemas": self.schemas, "apart": False}
        with system.open_output_stream(part) as f:
            f.write(json.dumps(said, sort_keys=True).encode())
        system.move(part, f"{top}/{RECORDS}/{self.name}.json")


def _delete(system, path: str) -> None:
    from pyarrow import fs

    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def _below(folder: str, part: str) -> list:
    from pyarrow import fs

    system, top = located(folder.rstrip("/"))
    return system.get_file_info(fs.FileSelector(f"{top}/{part}", allow_not_found=True))


def records(folder: str) -> list[dict]:
    """The records of a folder, by name: one small file a commit."""
    system, _ = located(folder)
    out = []
    for f in sorted(_below(folder, RECORDS), key=lambda f: f.path):
        if f.base_name.endswith(".json") and not f.base_name.startswith("."):
            with system.open_input_stream(f.path) as s:
                out.append(json.loads(s.read()))
    return out


def read_kind(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All committed rows of one kind under the contract of ``read_products``. The records tell the columns, so no file is
    opened for its schema and session ids stay the texts that they are."""
    found = [r for r in records(folder) if kind in r["rows"]]
    if not found:
        raise ContractError(f"no committed {kind} below {folder}")
    top = f"{folder.rstrip('/')}/{DATA}/{kind}"
    fields: dict[str, T.StructField] = {}
    for r in found:
        for f in T.StructType.fromJson(json.loads(r["schemas"][kind])).fields:
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise ContractError(f"{kind} was committed with {f.name} of different types")
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields.values()])
    # Folders of sessions and files of many are not read as one.
    full = [[f"{top}/commit_id={r['id']}" for r in found if r["rows"][kind] and r.get("apart", True) == apart] for apart in (True, False)]
    read = [read_products(spark, top, kind, paths, schema).drop("commit_id") for paths in full if paths]
    return functools.reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], schema)


def sweep(folder: str) -> int:
    """Delete data that no record names and say how many kinds of commits that were. Not while a commit is being written."""
    system, _ = located(folder)
    known = {r["id"] for r in records(folder)}
    dead = [f for kind in _below(folder, DATA) for f in _below(folder, f"{DATA}/{kind.base_name}") if f.base_name.removeprefix("commit_id=") not in known]
    for f in dead:
        _delete(system, f.path)
    return len(dead)
