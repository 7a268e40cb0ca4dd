"""Files through Hadoop's FileSystem, so that every store Spark reads works alike."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parquarry.functions.misc import NULL_PARTITION

#: Files that are listed one by one through the driver's gateway before Spark lists them all.
FEW = 256


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        p = self._p(root)
        self.fs = p.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(p).toString().rstrip("/")

    def _p(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def full(self, relative: str) -> str:
        return relative if "://" in relative or relative.startswith(("/", "file:")) else f"{self.root}/{relative}"

    def exists(self, path: str = "") -> bool:
        return self.fs.exists(self._p(self.full(path) if path else self.root))

    def few(self, suffix: str = "", under: str = "") -> list[tuple[str, int, int]] | None:
        """(relative path, size, time of change) of data files, sorted; None where there are more than FEW.

        Names that begin with _ or . anywhere are not data, nor are empty files.
        """
        top = self._p(self.full(under) if under else self.root)
        if not self.fs.exists(top):
            return []
        out = []
        walk = self.fs.listFiles(top, True)
        while walk.hasNext():
            s = walk.next()
            rel = self.relative(s.getPath().toString())
            if s.getLen() > 0 and rel.endswith(suffix) and not any(x.startswith(("_", ".")) for x in rel.split("/")):
                out.append((rel, s.getLen(), s.getModificationTime()))
            if len(out) > FEW:
                return None
        return sorted(out)

    def files(self, suffix: str = "", under: str = "") -> list[str]:
        """Relative paths of data files, sorted."""
        found = self.few(suffix, under)
        if found is not None:
            return [f for f, *_ in found]
        # one call a file is too slow for many
        return sorted(r[0] for r in self.listing(suffix, under).select("file_path").toLocalIterator())

    def listing(self, suffix: str = "", under: str = "") -> DataFrame:
        """``file_path`` (relative), ``uri``, ``file_size``, ``modified`` of data files, listed by Spark in parallel."""
        r = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
        found = r.load(self.full(under) if under else self.root).where("length > 0")
        rel = F.expr(f"substring(path, {len(self.root) + 2})")
        hidden = F.exists(F.split(rel, "/"), lambda x: x.startswith("_") | x.startswith("."))
        return found.where(~hidden).select(rel.alias("file_path"), F.col("path").alias("uri"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("modified"))

    def versions(self, path: str) -> list[str]:
        """Names of the folders directly under ``path`` that a writer has finished, sorted."""
        found = self.fs.globStatus(self._p(f"{self.full(path)}/*/_SUCCESS")) or []
        return sorted(x.getPath().getParent().getName() for x in found)

    def relative(self, path: str) -> str:
        full = self.fs.makeQualified(self._p(path)).toString()
        return full[len(self.root) + 1 :] if full.startswith(self.root + "/") else full

    def delete(self, path: str) -> None:
        self.fs.delete(self._p(self.full(path)), True)

    def mkdirs(self, path: str = "") -> None:
        self.fs.mkdirs(self._p(self.full(path) if path else self.root))

    def rename(self, old: str, new: str) -> None:
        to = self._p(self.full(new))
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(self._p(self.full(old)), to):
            raise OSError(f"could not rename {old} to {new}")


def partition_values(relative: str) -> dict[str, str | None]:
    """Values of the name=value folders of a path."""
    out = {}
    for p in relative.split("/")[:-1]:
        if "=" in p:
            k, v = p.split("=", 1)
            out[k] = None if v == NULL_PARTITION else unquote(v)
    return out
