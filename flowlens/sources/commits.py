"""Text files that appear only when their job commits: a data source writer for a file a group and for logs that grow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .readers import PACKETS

#: Folder of files that aren't committed yet; readers skip names that begin with an underscore.
STAGED, DONE = "_staged", "_committed"
#: Kinds of what is written: a file for each name, or segments of a log.
FILES, LOG = "files", "log"


@dataclass
class Staged(WriterCommitMessage):
    """What one attempt of a task wrote: where it lies, and where it belongs."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class CommitWriter(DataSourceArrowWriter):
    """Writes rows (file, value), sorted by file, as lines of text.

    Each attempt of a task writes under a name of its own below ``_staged``.
    Only attempts that Spark counts are moved to their place, by the driver,
    after all tasks are done; if the job fails nothing is moved. A job given a
    ``batch`` that has been committed before changes nothing, so a driver that
    repeats a job doesn't double a log.
    """

    def __init__(self, path: str, kind: str, header: str, batch: str, overwrite: bool):
        self.path, self.kind, self.header, self.overwrite = path, kind, header, overwrite
        self.batch = batch or uuid.uuid4().hex
        self.job = uuid.uuid4().hex

    def _root(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = self._root()
        attempt, moves, name, out = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}", [], None, None
        fs.create_dir(attempt)
        try:
            for batch in iterator:
                for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    # A log's lines go to one segment an attempt, whatever their file.
                    file = file if self.kind == FILES else f"{self.batch}-{attempt.rsplit('/', 1)[-1]}.txt"
                    if file is None or file.startswith(("/", "_")) or ".." in file.split("/"):
                        raise ValueError(f"no name for a file below {root}: {file!r}")
                    if file != name:
                        if out:
                            out.close()
                        staged, name = f"{attempt}/{len(moves)}", file
                        out = fs.open_output_stream(staged)
                        moves.append((staged, f"{root}/{file}"))
                        if self.header:
                            out.write(self.header.encode() + b"\n")
                    out.write((value or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = self._root()
        moves = [m for message in messages if message for m in message.moves]
        done = f"{root}/{DONE}/{self.batch}"
        try:
            if fs.get_file_info(done).type != pyarrow.fs.FileType.NotFound:
                return
            twice = len(moves) - len({to for _, to in moves})
            if twice:
                raise ValueError(f"{twice} files were written by two tasks each; repartition the rows by file")
            if self.overwrite:
                for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
                    if info.base_name not in (STAGED, DONE):
                        (fs.delete_dir if info.type == pyarrow.fs.FileType.Directory else fs.delete_file)(info.path)
            for folder in sorted({to.rsplit("/", 1)[0] for _, to in moves}):
                fs.create_dir(folder)
            for staged, to in moves:
                fs.move(staged, to)
            fs.create_dir(f"{root}/{DONE}")
            with fs.open_output_stream(done) as f:
                f.write(b"")
        finally:
            self._clean(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*self._root())

    def _clean(self, fs: pyarrow.fs.FileSystem, root: str) -> None:
        folder = f"{root}/{STAGED}/{self.job}"
        if fs.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(folder)
        if not fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)):
            if fs.get_file_info(f"{root}/{STAGED}").type != pyarrow.fs.FileType.NotFound:
                fs.delete_dir(f"{root}/{STAGED}")


class CommitSource(DataSource):
    """Format ``committed_text``: options path, kind (files or log), header and batch."""

    @classmethod
    def name(cls) -> str:
        return "committed_text"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> CommitWriter:
        path = self.options["path"]
        return CommitWriter(path if "://" in path else "file://" + path, self.options.get("kind", FILES), self.options.get("header", ""), self.options.get("batch", ""), overwrite)


def _written(rows: DataFrame, path: str, kind: str, mode: str, header: str, batch: str) -> None:
    rows.sparkSession.dataSource.register(CommitSource)
    rows.select("file", "value").write.format("committed_text").mode(mode).option("path", path).option("kind", kind).option("header", header).option("batch", batch).save()


def named_files(rows: DataFrame, path: str, file: Column, value: Column, order: list[str], header: str = "", mode: str = "overwrite", batch: str = "") -> None:
    """One file of lines ``value`` for each name ``file`` below ``path``, in the given order; a file is written by one task as its rows stream by."""
    lines = rows.withColumns({"file": file, "value": value}).select("file", "value", *[F.col(c).alias(f"_{c}") for c in order])
    _written(lines.repartition("file").sortWithinPartitions("file", *[f"_{c}" for c in order]), path, FILES, mode, header, batch)


def burst_files(packets: DataFrame, path: str, least: int = 2, mode: str = "overwrite", batch: str = "") -> None:
    """A tab separated file ``device/activity/flow{number}_burst{start}.txt`` for each burst of at least ``least`` packets.

    Needs the columns of ``readers.packets`` and device, activity, burst and
    burst_start; a flow is told by its stream_id. ``readers.packets`` reads the
    files back. Null values are empty; packets without one of these names have no file.
    """
    from flowlens.operators.flows import at_least

    keys = ["device", "activity", "trans_proto", "stream_id", "burst"]
    names = [c.split()[0] for c in PACKETS.split(", ")]
    start = F.regexp_replace(F.format_number("burst_start", 6), ",", "")
    file = F.concat(F.col("device"), F.lit("/"), F.col("activity"), F.lit("/flow"), F.col("trans_proto"), F.lit("-"), F.col("stream_id"), F.lit("_burst"), start, F.lit(".txt"))
    value = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    named_files(at_least(packets.dropna(subset=keys), keys, least), path, file, value, ["ts", "frame_num"], "\t".join(names), mode, batch)


def append_log(rows: DataFrame, path: str, value: Column, order: list[str], batch: str = "") -> None:
    """Adds the lines ``value`` to the log at ``path``, a folder of segments that ``spark.read.text`` reads.

    Lines of a segment keep the order; a job with a ``batch`` that is already
    in the log adds nothing.
    """
    lines = rows.withColumn("value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    _written(lines.select(F.lit("").alias("file"), "value"), path, LOG, "append", "", batch)


def left_after_filter(rows: DataFrame, kept: str, event: str, keys: list[str]) -> DataFrame:
    """keys, flows, flows_left, events, events_left and line, what a results log says about a filter; ``kept`` is a boolean column."""
    on = F.col(kept)
    out = rows.groupBy(*keys).agg(F.count("*").alias("flows"), F.count_if(on).alias("flows_left"), F.count_distinct(event).alias("events"), F.count_distinct(F.when(on, F.col(event))).alias("events_left"))
    share = lambda a, b: F.format_string("%.6f %d %d", F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), F.col(a), F.col(b))
    return out.withColumn("line", F.concat(F.concat_ws(" ", *keys), F.lit("; Flows left: "), share("flows_left", "flows"), F.lit("; Activity left: "), share("events_left", "events")))
