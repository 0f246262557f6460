"""What several operators share: the scratch folder, Arrow slices, labelled samples and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel works on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20
#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 12_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only a purely local session may go without; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote for these, when all that was made of them is stored itself; other frames stay as they are."""
    for df in frames:
        if name := df.__dict__.get("_scratch"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `limit` bytes of `column`, at least one row each."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size + 16)
    begin = 0
    while begin < batch.num_rows:
        done = end[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(end, done + limit, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a binary or string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_fold(doc_id: F.Column) -> F.Column:
    """True for rows whose labels are held out: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents outside the held-out fold.

    The rows with the smallest hashes of their ids are taken, so the sample is the same at every run.  Rows
    without an id or label are never in it.  The id list holds at most `rows` rows, which bounds the broadcast.  Of
    several rows of an id the text with the smallest hash is taken, and of different labels of an id the smallest.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~in_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    )
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = text.join(F.broadcast(ids), "doc_id")  # few are left, so this shuffles few
    return text.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"), F.min("y").alias("y")).select("doc_id", F.col("one.text").alias("text"), "y")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it is linked to.

    Alternates large-star and small-star rounds until nothing changes.  Each round joins the edges with one
    minimum per node, so no task gathers a neighbourhood, and the joins are ones that AQE may split on skew.
    Rounds grow with the logarithm of the longest chain.  Edges with a null end and loops are ignored.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        before, edges = edges, stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(b.alias("node"), b.alias("root")).distinct()
    return edges.select(a.alias("node"), b.alias("root")).unionByName(roots)


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links i - j join, at most one less than the nodes, and at most three a node."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = flat[: len(i)], flat[len(i) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    order = np.argsort(root, kind="stable")
    root = root[order]
    first = np.searchsorted(root, root)
    k = np.arange(len(nodes)) - first
    keep = k > 0
    return nodes[order[keep]], nodes[order[(first + (k - 1) // 2)[keep]]]
