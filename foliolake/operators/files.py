"""References between documents and files: what is referenced, missing, orphaned or stored twice."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of a file that are held at once while it is hashed.
PIECE = 1024 * 1024
_REF = r"""(?i)(?:src|href|poster|data-src)\s*=\s*["']([^"']+)["']|url\(\s*['"]?([^'")]+)['"]?\s*\)"""
_REMOTE = r"(?i)^(?:[a-z][a-z0-9+.\-]*:|//|#|$)"


def references(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, path): the local files that HTML refers to, without query and fragment, each once; addresses with a scheme are left out."""
    found = F.concat(*[F.regexp_extract_all(F.col(html), F.lit(_REF), F.lit(i)) for i in (1, 2)])
    refs = df.select(key, F.explode(found).alias("ref")).where(~F.col("ref").rlike(_REMOTE))
    path = F.regexp_replace(F.regexp_replace("ref", r"[?#].*$", ""), r"^(?:\./)+", "")
    return refs.select(key, path.alias("path")).where("path <> ''").distinct()


def orphaned(files: DataFrame, refs: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Files that nothing refers to."""
    return files.join(refs.select(*keys).distinct(), list(keys), "left_anti")


def missing(refs: DataFrame, files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """References to files that aren't there."""
    return refs.join(files.select(*keys).distinct(), list(keys), "left_anti")


def savings(files: DataFrame, content: str, size: str, order: Sequence[str]) -> DataFrame:
    """(content, copies, kept, freed) of contents stored twice or more: the first copy by `order` is kept, the bytes of the others are freed."""
    g = files.where(F.col(content).isNotNull()).groupBy(content).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*order)).alias("f"), F.sum(size).alias("bytes"), F.min_by(size, F.struct(*order)).alias("first"))
    return g.where("copies >= 2").select(content, "copies", F.col(f"f.{order[0]}").alias("kept"), (F.col("bytes") - F.col("first")).alias("freed"))


def first_existing(refs: DataFrame, files: DataFrame, key: Sequence[str], candidates: Sequence[Column]) -> DataFrame:
    """(key, resolved) of references: the first of the candidate paths that is a file, null if none is."""
    tried = refs.select(*key, F.posexplode(F.array(*candidates)).alias("place", "path"))
    hits = tried.join(files.select("path").distinct(), "path").groupBy(*key).agg(F.min_by("path", "place").alias("resolved"))
    return refs.select(*key).distinct().join(hits, list(key), "left")


def same_content(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status) of files a against originals b: 'no original', 'other size', 'other content' or 'same'; sizes are compared before hashes."""
    x = a.select(*keys, F.col("size_bytes").alias("s1"), F.col("hash").alias("h1"))
    y = b.select(*keys, F.col("size_bytes").alias("s2"), F.col("hash").alias("h2"))
    status = F.when(F.col("h2").isNull(), "no original").when(F.col("s1") != F.col("s2"), "other size").when(F.col("h1") != F.col("h2"), "other content").otherwise("same")
    return x.join(y, list(keys), "left").select(*keys, status.alias("status"))


def manifest(refs: DataFrame, shared: str, framework: str) -> DataFrame:
    """(place, files) of references by the first folder of their path: 'shared', 'framework' or 'local'."""
    place = F.when(F.col("path").startswith(shared), "shared").when(F.col("path").startswith(framework), "framework").otherwise("local")
    return refs.groupBy(place.alias("place")).agg(F.count_distinct("path").alias("files"))


def folder_sizes(files: DataFrame, depth: int = 1) -> DataFrame:
    """(folder, files, bytes) of the first `depth` parts of each path; a file outside any folder is in ''."""
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def _sha256(path: str) -> str:
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        file = open("/" + (rest or path).lstrip("/"), "rb")  # noqa: SIM115
    else:
        from pyarrow.fs import FileSystem

        system, inner = FileSystem.from_uri(path)
        file = system.open_input_stream(inner)
    h = hashlib.sha256()
    with file:
        while piece := file.read(PIECE):
            h.update(piece)
    return h.hexdigest()


def stored_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, hash) of the files under a folder that all executors share. Sizes are read from metadata alone, and only files that
    share a size with another are hashed, of any size: each is read in pieces of PIECE bytes, so no content has to fit a row."""
    ship(spark)

    @F.pandas_udf("string")
    def sha256(paths: pd.Series) -> pd.Series:
        return paths.map(_sha256)

    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sizes = meta.select("path", F.col("length").alias("size_bytes"))
    twins = sizes.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size_bytes")
    # paths are a few bytes, their files aren't: a stated number of partitions isn't put together again
    paths = sizes.join(twins, "size_bytes", "left_semi").select("path").repartition(spark.sparkContext.defaultParallelism * 3)
    return sizes.join(paths.select("path", sha256("path").alias("hash")), "path", "left")
