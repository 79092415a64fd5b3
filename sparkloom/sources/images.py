"""Labelled file trees as records, and records as descriptors."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.describe import MAIN, Descriptor, describe
from sparkloom.operators.dataset import is_image

RECORD = T.StructType([T.StructField(c, T.StringType(), False) for c in ("split", "class_name", "file_name", "image_path")])
FEATURES = "image_path string, color array<float>, hog array<float>, lbp array<float>, all array<float>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def class_directories(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(class_index, class_name): the sub-directories of root/split by name, empty ones included.  They are as few as classes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{split}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = sorted(s.getPath().getName() for s in found if s.isDirectory())
    return spark.createDataFrame(list(enumerate(names)), "class_index int, class_name string")


def scan(spark: SparkSession, root: str, split: str, classes: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """(split, class_name, file_name, image_path) of the image files below root/split/<class>, in path order.

    nested: descend into sub-directories of a class and skip classes whose name begins with a dot; a missing directory gives
    no rows.  Otherwise only files right below a class, and classes limits them.  Contents are not read.
    """
    base = f"{root.rstrip('/')}/{split}"
    if not _exists(spark, base):
        return spark.createDataFrame([], RECORD)
    reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", "true").load(base).select("path")
    inner = F.split(F.regexp_extract("path", f".*/{split}/(.*)$", 1), "/")
    rows = files.where(is_image("path")).withColumn("p", inner)
    rows = rows.where(F.size("p") >= 2) if nested else rows.where(F.size("p") == 2)
    rows = rows.select(F.lit(split).alias("split"), F.col("p")[0].alias("class_name"), F.element_at("p", -1).alias("file_name"), F.col("path").alias("image_path"))
    if nested:
        rows = rows.where(~F.col("class_name").startswith("."))
    if classes is not None:
        rows = rows.join(classes.select("class_name"), "class_name", "left_semi").select(*RECORD.names)
    return rows.orderBy(F.split("image_path", "/"))


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The rows of Spark's image source (BGR, BGRA or grey bytes) as RGB in 0..1."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]
    return rgb.astype(np.float32) / 255


def orientation(data: bytes) -> int:
    """The Exif orientation, 1 to 8, that a JPEG or PNG file states; 1 where it states none."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            kind, size = struct.unpack_from(">BH", data, at + 1)
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return _tiff_orientation(data[at + 10 : at + 2 + size])
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"eXIf":
                return _tiff_orientation(data[at + 8 : at + 8 + size])
            at += 12 + size
    return 1


def _tiff_orientation(data: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return 1
    (at,) = struct.unpack_from(order + "I", data, 4)
    if at + 2 > len(data):
        return 1
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        if (entry := at + 2 + 12 * i) + 12 > len(data):
            return 1
        tag, kind, _, value = struct.unpack_from(order + "HHIH", data, entry)
        if tag == 0x0112 and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def upright(rgb: np.ndarray, turned: int) -> np.ndarray:
    """An image as its Exif orientation means it to be seen."""
    if turned >= 5:
        rgb = rgb.transpose(1, 0, 2)
    if turned in (2, 3, 6, 7):
        rgb = rgb[:, ::-1]
    if turned in (3, 4, 7, 8):
        rgb = rgb[::-1]
    return rgb


def _with_orientation(spark: SparkSession, image: DataFrame, folder: str) -> DataFrame:
    """image with the column turned, told by the files themselves."""

    def look(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows]), pa.array([orientation(r["content"]) for r in rows], pa.int32())], ["path", "turned"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(is_image("path"))
    found = files.select("path", "content").mapInArrow(look, "path string, turned int").where("turned <> 1")
    return image.join(found.withColumn("_p", _plain("path")).drop("path"), _plain("origin") == F.col("_p"), "left").drop("_p").withColumn("turned", F.coalesce("turned", F.lit(1)))


def _plain(path: str) -> Column:
    """One spelling for a local path: file:///a and file:/a."""
    return F.regexp_replace(path, "^file:/+", "/")


def features(spark: SparkSession, records: DataFrame, folder: str, settings: Descriptor = MAIN) -> DataFrame:
    """records with the four descriptor groups; each image is decoded once.  A file that cannot be decoded is an error.

    Where the settings say so, images are first turned as their Exif orientation states.
    """
    image = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*").where(is_image("origin"))
    image = _with_orientation(spark, image, folder) if settings.exif else image.withColumn("turned", F.lit(1))

    def look(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                if bad := [r["origin"] for r in rows if r["nChannels"] not in (1, 3, 4)]:
                    raise ValueError(f"not a readable image: {bad[0]}")
                found = [describe(upright(pixels(r["data"], r["height"], r["width"], r["nChannels"]), r["turned"]), settings) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["origin"] for r in rows]), *[pa.array([f[g] for f in found], pa.list_(pa.float32())) for g in ("color", "hog", "lbp", "all")]], ["image_path", "color", "hog", "lbp", "all"])

    found = image.mapInArrow(look, FEATURES).withColumn("_p", _plain("image_path")).drop("image_path")
    return records.join(found, _plain("image_path") == F.col("_p")).drop("_p")
