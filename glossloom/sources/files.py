"""Small files beside tables, on whatever file system the tables are on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _on(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _on(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds."""
    fs, p = _on(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _on(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    fs, p = _on(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if there is one already."""
    fs, p = _on(spark, path)
    try:
        stream = fs.create(p, False)
    except Exception as e:  # a Java exception
        if fs.exists(p):
            return False
        raise OSError(path) from e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside the old one and put it in its place in one step, as far as the file system has one."""
    import uuid

    jvm = spark.sparkContext._jvm
    tmp = f"{path}.{uuid.uuid4().hex}"
    create(spark, tmp, text)
    fs, p = _on(spark, path)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(jvm.org.apache.hadoop.fs.Path(tmp), p, options)
    except Exception as e:
        delete(spark, tmp)
        raise OSError(path) from e


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _on(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not be moved to {to}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _on(spark, path)
    fs.delete(p, True)
