"""Raw rasters (binary PPM and PGM) as pixel relations and back; file listings; manifests as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..shipping import ship

PIXELS = "slug string, i bigint, x int, y int, r int, g int, b int"
IMAGE_NAMES = r"(?i)\.(jpg|jpeg|png|webp|ppm|pgm)$"
PUZZLE = (
    "id string, name string, difficulty string, width int, height int, labelMap struct<width:int,height:int,runs:array<int>>, "
    "regions array<struct<id:int,colorNumber:int,labelX:int,labelY:int,areaPx:bigint>>, palette map<string,string>, source string, "
    "thumbnail string, outline string, outlineWidth int, outlineHeight int"
)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, sha1, path, content) of the image files of a folder."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(IMAGE_NAMES))
    return files.select(slugify(F.col("path")).alias("slug"), F.sha1("content").alias("sha1"), "path", "content")


def decode(files: DataFrame) -> DataFrame:
    """Pixels of binary PPM (P6) and PGM (P5) contents with 8-bit samples; other contents give no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for slug, content in zip(part["slug"], part["content"], strict=True):
                if (got := parse(bytes(content))) is not None:
                    h, w, _ = got.shape
                    i = np.arange(h * w)
                    c = got.reshape(-1, 3)
                    yield pd.DataFrame({"slug": slug, "i": i, "x": i % w, "y": i // w, "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    ship(files.sparkSession)
    return files.select("slug", "content").mapInPandas(run, PIXELS)


def parse(content: bytes) -> np.ndarray | None:
    """(height, width, 3) bytes of a P5 or P6 file; None if it is none."""
    fields, at = [], 0
    while len(fields) < 4 and at < len(content):
        if content[at : at + 1].isspace():
            at += 1
        elif content[at : at + 1] == b"#":
            at = content.find(b"\n", at) % (len(content) + 1)
        else:
            end = at
            while end < len(content) and not content[end : end + 1].isspace():
                end += 1
            fields.append(content[at:end])
            at = end
    if len(fields) < 4 or fields[0] not in (b"P5", b"P6") or fields[3] != b"255":
        return None
    w, h, depth = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    raw = np.frombuffer(content, np.uint8, count=-1, offset=at + 1)
    return np.repeat(raw[: w * h * depth].reshape(h, w, depth), 3 // depth, axis=2) if len(raw) >= w * h * depth else None


def encode(pixels: DataFrame) -> DataFrame:
    """(slug, content): a binary PPM of each image of (slug, x, y, r, g, b)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        img = np.zeros((h, w, 3), np.uint8)
        img[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy(np.uint8)
        return pd.DataFrame({"slug": [pdf["slug"].iloc[0]], "content": [f"P6\n{w} {h}\n255\n".encode() + img.tobytes()]})

    ship(pixels.sparkSession)
    return pixels.groupBy("slug").applyInPandas(run, "slug string, content binary")


def encode_pam(pixels: DataFrame) -> DataFrame:
    """(img, width, height, content): a PAM file (P7, RGB_ALPHA) of each image of (img, x, y, r, g, b, a), all of whose pixels must be there. Rows
    of pixels are put together first, then the rows of an image, as a file holds one image whole."""
    sample = F.concat(*(F.lower(F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0")) for c in "rgba"))
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "h"))), lambda p: p["h"]), "")
    rows = pixels.select("img", "x", "y", sample.alias("h")).groupBy("img", "y").agg(F.count(F.lit(1)).alias("width"), joined("x").alias("h"))
    whole = rows.groupBy("img").agg(F.max("width").cast("int").alias("width"), F.count(F.lit(1)).cast("int").alias("height"), joined("y").alias("h"))
    header = F.format_string("P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n", "width", "height")
    return whole.select("img", "width", "height", F.concat(header.cast("binary"), F.unhex("h")).alias("content"))


def json_value(text: Column, path: str, kind: str) -> Column:
    """One value of a JSON text; null if the text is no JSON or has no such value."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def read_manifest(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The puzzles of a manifest, one record a line, or (``lines`` false) one array in each file; none if it isn't there. Broken records
    are left out."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], PUZZLE)
    return spark.read.schema(PUZZLE).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(path).where("id is not null")


def write_manifest(puzzles: DataFrame, path: str) -> None:
    """One JSON record a line, in the order of the ids."""
    puzzles.orderBy("id").write.mode("overwrite").json(path)
