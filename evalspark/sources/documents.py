"""One JSON document per run, with a detail that is as long as the run has tasks.

A Python data source writer: every task writes, per document, a part file with
its own detail entries; the driver's commit puts a document together from its
head and its parts in order, by copying bytes, and renames it into place.  No
entry of the detail meets the others in one row, and a failed job leaves no
document.  Rows are sorted by document and index before, so parts follow each
other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from evalspark.sources.jsonarray import filesystem

NAME = "evalspark_documents"


@dataclass
class _Parts(WriterCommitMessage):
    partition: int = 0
    parts: dict[str, str] = field(default_factory=dict)      # by document its part of this task


class _Writer(DataSourceWriter):
    """Rows ``document, head, entry``: a head (a JSON object) once per document, then entries ``"key": value``."""

    def __init__(self, path: str, detail: str):
        self.path, self.detail, self.job = path, detail, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> _Parts:
        system, root = filesystem(self.path)
        task = TaskContext.get()
        folder = f"{root}/.parts-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        parts, name, out = {}, None, None
        for document, head, entry in rows:
            if document != name:
                if out:
                    out.close()
                name = document
                if not parts:
                    system.create_dir(folder, recursive=True)
                parts[name] = f"{folder}/{len(parts)}"
                out = system.open_output_stream(parts[name])
            kind, text = (b"H", head) if head is not None else (b"E", entry)
            out.write(kind + text.encode() + b"\n")
        if out:
            out.close()
        return _Parts(task.partitionId(), parts)

    def commit(self, messages: list) -> None:
        system, root = filesystem(self.path)
        found: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, part in m.parts.items():
                found.setdefault(name, []).append(part)
        for name, parts in found.items():
            target = f"{root}/{name}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            draft = f"{target}.{self.job}"
            with system.open_output_stream(draft) as out:
                open_detail = False
                for part in parts:
                    with system.open_input_stream(part) as stream:
                        for line in _lines(stream):
                            if line[:1] == b"H":             # sorts before all entries
                                head = line[1:].rstrip()[:-1].rstrip()
                                out.write(head + (b", " if head != b"{" else b"") + json.dumps(self.detail).encode() + b": {")
                            else:
                                out.write((b",\n" if open_detail else b"\n") + line[1:])
                                open_detail = True
                out.write(b"}}\n")
            system.move(draft, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs
        system, root = filesystem(self.path)
        folder = f"{root}/.parts-{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _lines(stream) -> Iterator[bytes]:
    """Lines of a byte stream, a bounded piece at a time (an entry is one line: JSON escapes line ends)."""
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "document string, head string, entry string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("detail", "detail"))


def write_documents(heads: DataFrame, entries: DataFrame, path: str, detail: str = "detail") -> None:
    """Write ``<path>/<document>`` for each row of ``heads`` (``document, head``: the JSON of an object), with the
    ``entries`` (``document, idx, entry``: the JSON of a value) of the document under ``detail``, keyed and ordered by ``idx``."""
    heads.sparkSession.dataSource.register(DocumentSource)
    keyed = entries.select("document", F.col("idx").cast("long").alias("idx"), F.lit(None).cast("string").alias("head"),
                           F.concat(F.lit('"'), F.col("idx").cast("string"), F.lit('": '), F.col("entry")).alias("entry"))
    first = heads.select("document", F.lit(None).cast("long").alias("idx"), "head", F.lit(None).cast("string").alias("entry"))
    ordered = first.unionByName(keyed).repartitionByRange("document", F.col("idx").asc_nulls_first()).sortWithinPartitions(
        "document", F.col("idx").asc_nulls_first())
    ordered.select("document", "head", "entry").write.format(NAME).option("path", path).option("detail", detail).mode("append").save()
