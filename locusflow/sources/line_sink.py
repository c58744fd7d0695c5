"""One ordered text file, written by executors (``format("count_table")``).

Rows come sorted and dealt by ranges. Each task writes a part beside the file; on commit the
parts are put together in order, and a single part just takes the file's name. A task that
runs again writes a part of its own, and only parts that Spark commits are used; on abort all go.
"""

from __future__ import annotations

import gzip
import json
import uuid
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from locusflow.sources.bam import _file_system, open_input, open_output

COPY_BYTES = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class TableWriter(DataSourceArrowWriter):
    """Options: ``path``; ``head``, a JSON list of lines; ``samples``, their number; ``zero``, what a sample without count gets.

    Rows have ``fields``, the texts that a line begins with, and ``counts``, the (sample,
    text) pairs of those samples that have one. Files named .gz are gzipped, part by part.
    """

    def __init__(self, options):
        self.path, self.head = options["path"], json.loads(options["head"])
        self.samples, self.zero = int(options["samples"]), options["zero"]
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _open(self, raw):
        return gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.path.endswith(".gz") else nullcontext(raw)

    def write(self, iterator):
        number = TaskContext.get().partitionId()
        part = Part(number, f"{self.folder}/{number:06d}-{uuid.uuid4().hex}")
        with open_output(part.path) as raw, self._open(raw) as f:
            if number == 0:
                f.write("".join(x + "\n" for x in self.head).encode())
            for batch in iterator:
                for fields, counts in zip(batch.column("fields"), batch.column("counts"), strict=True):
                    line = [self.zero] * self.samples
                    for c in counts.as_py() or ():
                        line[c["sample"]] = c["n"]
                    f.write("\t".join(["" if x is None else x for x in fields.as_py()] + line).encode() + b"\n")
        return part

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        system, name = _file_system(self.path)
        if len(parts) == 1:
            system.move(_file_system(parts[0].path)[1], name)
        else:
            with open_output(self.path) as out:
                if not parts:
                    with self._open(out) as f:
                        f.write("".join(x + "\n" for x in self.head).encode())
                for p in parts:
                    with open_input(p.path) as f:
                        while data := f.read(COPY_BYTES):
                            out.write(data)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        system, name = _file_system(self.folder)
        if system.get_file_info(name).type.name != "NotFound":
            system.delete_dir(name)


class TableSink(DataSource):
    @classmethod
    def name(cls):
        return "count_table"

    def schema(self):
        return "fields array<string>, counts array<struct<sample:int,n:string>>"

    def writer(self, schema, overwrite):
        return TableWriter(self.options)
