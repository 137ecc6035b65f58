"""Files that appear whole or not at all, and only if nobody else made them first."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write ``text`` at ``path`` unless something is there; whether this call wrote it.

    The text is written beside the target under a hidden name and then given its name in one step that
    fails if the name is taken: a hard link on a local disk, a rename without overwriting elsewhere,
    which is one operation of the name node on HDFS. Object stores need a connector whose rename or
    create is conditional.
    """
    folder, name = path.rsplit("/", 1)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if urlparse(path).scheme in ("", "file"):
        target, hidden = (unquote(urlparse(p).path) for p in (path, aside))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(hidden, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(hidden, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    source, target = fs.Path(aside), fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    system = source.getFileSystem(conf)
    out = system.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    plain[0] = getattr(fs, "Options$Rename").NONE
    try:
        fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, plain)
        return True
    except Exception as error:  # noqa: BLE001
        if "FileAlreadyExists" not in str(error):
            raise
        system.delete(source, False)
        return False
