"""Raster files as a Spark data source: ``spark.dataSource.register(RasterSource)``, then ``spark.read.format("raster").load(folder)`` and ``df.write.format("raster")``.

One binary PPM (P6) file an image in a shared folder, which can be any that Arrow's file systems reach. Reading: files are dealt out over partitions, and each file is one batch of pixels.
Writing: rows must come by image and, within it, from top to bottom and left to right (``in_file_order``); a task holds one image at a time and writes it under a hidden name. When all
tasks are done the driver moves the files into place; if the job fails it removes them, and a task that fails removes its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..shipping import ship
from .rasters import PIXELS, parse

#: Files of one partition hold about so many bytes.
PART_BYTES = 32 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


def _folder(options) -> tuple[pafs.FileSystem, str]:
    if "path" not in options:
        raise ValueError("no path given")
    path = options["path"]
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else pafs.FileSystem.from_uri(f"file://{path}")


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[Files]:
        fs, base = _folder(self.options)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith((".ppm", ".pgm")) and not f.base_name.startswith("."))
        out, size = [Files([])], 0
        for path, n in found:
            if out[-1].paths and size + n > PART_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _folder(self.options)
        for path in part.paths:
            with fs.open_input_file(path) as f:
                got = parse(f.read())
            if got is None:
                continue
            h, w, _ = got.shape
            i, c = np.arange(h * w), got.reshape(-1, 3).astype(np.int32)
            slug = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array([slug] * len(i), pa.string()), pa.array(i), *(pa.array(v.astype(np.int32)) for v in (i % w, i // w, c[:, 0], c[:, 1], c[:, 2]))], ["slug", "i", "x", "y", "r", "g", "b"])


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _folder(self.options)
        fs.create_dir(base, recursive=True)
        names: list[tuple[str, str]] = []
        slug, held = None, []

        def close() -> None:
            rows = pa.Table.from_batches(held)
            at = [rows.column(c).to_numpy() for c in "xy"]
            image = np.zeros((int(at[1].max()) + 1, int(at[0].max()) + 1, 3), np.uint8)
            image[at[1], at[0]] = np.stack([rows.column(c).to_numpy() for c in "rgb"], 1)
            hidden = f".{slug}-{uuid.uuid4().hex}"
            names.append((hidden, f"{slug}.ppm"))
            with fs.open_output_stream(f"{base}/{hidden}") as f:
                f.write(f"P6\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + image.tobytes())

        try:
            for b in batches:
                slugs = b.column(b.schema.get_field_index("slug")).to_pylist()
                cuts = [0, *(k for k in range(1, len(slugs)) if slugs[k] != slugs[k - 1]), len(slugs)]
                for start, end in zip(cuts, cuts[1:], strict=False):
                    if start == end:
                        continue
                    if held and slugs[start] != slug:
                        close()
                        held = []
                    slug = slugs[start]
                    held.append(b.slice(start, end - start))
            if held:
                close()
        except BaseException:
            _remove(fs, base, names)
            raise
        return Written(names)

    def commit(self, messages) -> None:
        fs, base = _folder(self.options)
        new = {name: hidden for m in messages if m for hidden, name in m.names}
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
                if f.base_name.endswith((".ppm", ".pgm")) and f.base_name not in new:
                    fs.delete_file(f.path)
        for name, hidden in new.items():
            fs.move(f"{base}/{hidden}", f"{base}/{name}")

    def abort(self, messages) -> None:
        fs, base = _folder(self.options)
        for m in messages:
            if m:
                _remove(fs, base, m.names)


def _remove(fs: pafs.FileSystem, base: str, names: list[tuple[str, str]]) -> None:
    for hidden, _ in names:
        if fs.get_file_info(f"{base}/{hidden}").type == pafs.FileType.File:
            fs.delete_file(f"{base}/{hidden}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RasterSource)


def in_file_order(pixels: DataFrame) -> DataFrame:
    """Pixels (slug, x, y, r, g, b) as the writer takes them: images whole in a task, their rows in order."""
    return pixels.select("slug", "x", "y", "r", "g", "b").repartition("slug").sortWithinPartitions("slug", "y", "x")
