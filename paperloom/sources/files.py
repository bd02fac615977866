"""Files as a DataFrame: listing, detection by content, and the guards before any parsing."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import extension, media_type
from paperloom.options import Options

#: Suffixes that a directory scan takes (fixed values).
SUPPORTED = ("pdf", "docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "doc", "xls", "ppt")
MODERN = ("docx", "docm", "xlsx", "xlsm", "pptx", "pptm")
LEGACY = ("doc", "xls", "ppt")
OLE = "D0CF11E0A1B11AE1"


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the supported files under `path` (a file or a directory)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(extension(F.col("path")).isin(*SUPPORTED))


class InvalidInput(ValueError):
    """The path is no file that can be read."""


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file whatever its suffix; a directory and a missing file are refused."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        raise InvalidInput(f"not a file: {path}")
    return spark.read.format("binaryFile").load(path)


@F.udf(returnType=T.StructType([T.StructField("is_zip", T.BooleanType()), T.StructField("family", T.StringType()), T.StructField("macro", T.BooleanType()), T.StructField("members", T.LongType()), T.StructField("expanded", T.LongType()), T.StructField("compressed", T.LongType()), T.StructField("broken", T.StringType())]), useArrow=True)
def _zip_facts(content, max_members, max_expanded, max_member):  # noqa: ANN001, ANN202
    """What the central directory says; nothing is inflated. `broken` names the first limit passed."""
    if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
        return (False, None, False, 0, 0, 0, None)
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return (True, None, False, 0, 0, 0, "unreadable")
    names = [i.filename for i in infos]
    family = next((f for p, f in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(n.startswith(p) for n in names)), None)
    macro = any(n.endswith("/vbaProject.bin") for n in names)
    broken, total = ("members" if len(infos) > max_members else None), 0
    for i in infos if broken is None else ():
        total += i.file_size
        broken = "negative" if i.file_size < 0 else "member" if i.file_size > max_member else "expanded" if total > max_expanded else None
        if broken:
            break
    return (True, family, macro, len(infos), sum(i.file_size for i in infos), sum(i.compress_size for i in infos), broken)


def signature_type(signature: Column, ext: Column) -> Column:
    """Type by the first eight bytes (upper-case hex) for everything but ZIP packages, null for those."""
    ole = signature.startswith(OLE)
    return (
        F.when(signature.startswith("255044462D"), F.lit("pdf"))
        .when(ole & ext.isin(*MODERN), F.lit("encrypted_office"))
        .when(ole & ext.isin(*LEGACY), ext)
        .when(ole, F.lit("legacy_office"))
        .when(~signature.startswith("504B"), F.coalesce(F.nullif(ext, F.lit("")), F.lit("unknown")))
    )


def detect(files: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Adds `detected`: document_type, extension, media_type, is_legacy_office, is_macro_enabled, is_encrypted_office, and `archive`."""
    ext = extension(F.col("path"))
    sig = F.hex(F.substring("content", 1, 8))
    # only what may be a package is handed to Python
    maybe = F.when(sig.startswith("504B"), F.col("content"))
    out = files.withColumn("archive", _zip_facts(maybe, F.lit(options.max_members), F.lit(options.max_expanded), F.lit(options.max_member)))
    family = F.col("archive.family")
    macro = F.col("archive.macro") & family.isNotNull()
    packaged = F.when(macro, F.regexp_replace(family, "x$", "m")).otherwise(F.coalesce(family, F.nullif(ext, F.lit("")), F.lit("zip")))
    kind = F.coalesce(signature_type(sig, ext), F.when(F.col("archive.is_zip"), packaged), F.nullif(ext, F.lit("")), F.lit("unknown"))
    shown = F.when((kind == "pdf") & (ext == ""), F.lit("pdf")).when(F.col("archive.is_zip") & family.isNotNull(), kind).otherwise(ext)
    return out.withColumn(
        "detected",
        F.struct(
            kind.alias("document_type"), shown.alias("extension"), F.coalesce(media_type(kind), media_type(shown)).alias("media_type"),
            kind.isin(*LEGACY, "legacy_office").alias("is_legacy_office"), F.coalesce(macro, F.lit(False)).alias("is_macro_enabled"), (kind == "encrypted_office").alias("is_encrypted_office"),
        ),
    )


def by_size(files: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(files within the size limit, rejects of the others); the rejects' scan reads no content."""
    reject = [F.lit("InvalidInputFileError").alias("error_type"), F.lit("the file is larger than the limit").alias("error")]
    return files.where(F.col("length") <= options.max_file_size), files.where(F.col("length") > options.max_file_size).select("path", *reject)


def guard(detected: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(files that may be parsed, rejects(path, error_type, error)) by size, encryption, archive limits and type."""
    kind = F.col("detected.document_type")
    modern = kind.isin(*MODERN)
    reason = (
        F.when(F.col("length") > options.max_file_size, F.struct(F.lit("InvalidInputFileError").alias("error_type"), F.lit("the file is larger than the limit").alias("error")))
        .when(F.col("detected.is_encrypted_office"), F.struct(F.lit("UnsupportedFileTypeError").alias("error_type"), F.lit("the Office file is encrypted").alias("error")))
        .when(modern & F.col("archive.broken").isNotNull(), F.struct(F.lit("InvalidInputFileError").alias("error_type"), F.concat(F.lit("archive limit: "), F.col("archive.broken")).alias("error")))
        .when(~kind.isin(*MODERN, *LEGACY, "pdf"), F.struct(F.lit("UnsupportedFileTypeError").alias("error_type"), F.concat(F.lit("no extractor for "), kind).alias("error")))
    )
    judged = detected.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("path", "reason.error_type", "reason.error")
