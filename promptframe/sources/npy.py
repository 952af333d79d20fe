"""``.npy`` vector matrices as a Spark Python data source (SRC4, SNK4).

Reading splits each file into row ranges of at most ``rowsPerPartition``
rows (the header gives shape and dtype; tasks read the bytes of their range), so a
large matrix is read in parallel.  Output: ``pos`` (global row position,
files in name order) and ``vector array<float>``.  Writing stores each partition as
``part-<write>-<partition>-<n>.npy`` of at most ``rowsPerFile`` rows; write a sorted DataFrame to keep order.
Files are opened through the file system their path names (``sources.shared``).
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .shared import delete_file, list_files, open_fs, open_whole


def _open(path: str):
    """A file with the shape, column-major order, dtype and place of its data."""
    from numpy.lib import format as npf

    fs, inner = open_fs(path)
    f = fs.open_input_file(inner)
    version = npf.read_magic(f)
    read = npf.read_array_header_1_0 if version == (1, 0) else npf.read_array_header_2_0
    return f, *read(f), f.tell()


def npy_rows(path: str) -> int:
    f, shape, _, _, _ = _open(path)
    f.close()
    return int(shape[0]) if shape else 0


def npy_block(path: str, start: int, end: int):
    """Rows ``[start, end)`` of a file; only a column-major file is read beyond them."""
    import numpy as np

    f, shape, by_column, dtype, at = _open(path)
    with f:
        if dtype.hasobject:
            raise ValueError(f"{path} holds Python objects, not numbers")
        width = int(np.prod(shape[1:], dtype=np.int64))
        if by_column and len(shape) > 1:
            f.seek(at)
            whole = np.frombuffer(f.read(int(shape[0]) * width * dtype.itemsize), dtype)
            return whole.reshape(shape, order="F")[start:end]
        f.seek(at + start * width * dtype.itemsize)
        return np.frombuffer(f.read((end - start) * width * dtype.itemsize), dtype).reshape(end - start, width)


class _Range(InputPartition):
    def __init__(self, path, start, end, offset):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.offset = path, start, end, offset


class NpyReader(DataSourceReader):
    def __init__(self, path, rows_per_partition):
        self.path, self.rpp = path, rows_per_partition

    def partitions(self):
        parts, offset = [], 0
        for f in list_files(self.path, ".npy"):
            n = npy_rows(f)
            for s in range(0, n, self.rpp):
                parts.append(_Range(f, s, min(n, s + self.rpp), offset))
            offset += n
        return parts

    def read(self, partition):
        import numpy as np

        block = np.asarray(npy_block(partition.path, partition.start, partition.end), dtype=np.float32)
        for i, row in enumerate(block):
            yield (partition.offset + partition.start + i, row.reshape(-1).tolist())


class _Commit(WriterCommitMessage):
    def __init__(self, paths, rows):
        self.paths, self.rows = paths, rows


class NpyWriter(DataSourceWriter):
    """``part-<write>-<partition>-<n>.npy`` of each non-empty partition.

    The write id orders files by write (reading follows name order), and a
    retried task rewrites its own files through hidden temporary names.
    Overwrite removes, at commit, the part files this write did not produce.
    """

    def __init__(self, path, column, overwrite, rows_per_file):
        if rows_per_file < 1:
            raise ValueError("rowsPerFile must be >= 1")
        self.path, self.column, self.overwrite = path.rstrip("/"), column, overwrite
        self.rows_per_file, self.write_id = rows_per_file, write_id()
        open_fs(path)

    def write(self, iterator):
        from itertools import islice

        import numpy as np
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        vectors = (np.asarray(r[self.column], dtype=np.float32) for r in iterator)
        paths, n = [], 0
        while rows := list(islice(vectors, self.rows_per_file)):
            paths.append(f"{self.path}/part-{self.write_id}-{pid:05d}-{len(paths):04d}.npy")
            with open_whole(paths[-1]) as f:
                np.save(f, np.stack(rows))
            n += len(rows)
        return _Commit(paths, n)

    def commit(self, messages):
        if self.overwrite:
            remove_stale_parts(self.path, {p for m in messages if m is not None for p in m.paths}, ".npy")


def write_id() -> str:
    """Time-ordered id of one write job (driver side), shared by its tasks."""
    import time
    import uuid

    return f"{time.time_ns():020d}{uuid.uuid4().hex[:6]}"


def remove_stale_parts(path: str, keep: set, suffix: str) -> None:
    """Delete ``part-*`` files under ``path`` that are not in ``keep`` (overwrite commit)."""
    for f in list_files(path, suffix):
        if f.rsplit("/", 1)[1].startswith("part-") and f not in keep:
            delete_file(f)


class NpyDataSource(DataSource):
    """``format("npy")``; options: ``path``, ``rowsPerPartition`` (read), ``column`` and ``rowsPerFile`` (write)."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "pos long, vector array<float>"

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("rowsPerPartition", 65536)))

    def writer(self, schema, overwrite):
        return NpyWriter(self.options["path"], self.options.get("column", "vector"), overwrite,
                         int(self.options.get("rowsPerFile", 1_000_000)))


def register(spark) -> None:
    spark.dataSource.register(NpyDataSource)
