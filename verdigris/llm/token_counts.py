"""Token counts by a separator scan over flat, unindexed token files.

A token file is the ids of one document after the other, each document ended by a separator id, without an
index. It is kept as fixed-size blocks (file, block, data), the unit that a task reads. Counting scans each
block on its own with one vectorised search for separators and gives a summary: tokens, separators, tokens
before the first and after the last, counts between. A prefix scan over the summaries stitches the documents
that cross blocks: it carries the open document's tokens and the number of documents so far.

The prefix scan has two levels, over GROUP blocks each and then over the groups of a file, so that a file that
holds a third of all blocks doesn't end in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs  # noqa: F401  pa.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_rows, stored

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens of a block, and blocks of a group.
BLOCK, GROUP = 1 << 16, 1024
KINDS = "file long, block long, ordinal long, name {kind}, data binary"


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in a rank file, without special tokens: the next free id is the separator."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """The token files of docs as blocks, and beside them the names of the documents, in a table in the shared folder.

    A task writes one file: uint16 ids, or uint32 for a vocabulary of 65,535 or more. Block rows have data;
    name rows have ordinal and name. Null and empty texts are documents without tokens. The table is written
    once, so that a later loss of an executor can't deal the documents to other files.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(f"`{id_col}`").alias("name"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["name"].dataType
    schema = KINDS.format(kind=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = encoding(path), TaskContext.get().partitionId()
        separator = np.array([own.n_vocab])
        store = np.uint16 if own.n_vocab < 65_536 else np.uint32
        parts, held, block, ordinal = [], 0, 0, 0

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal parts, held, block
            if held < least or not held:
                return
            flat = np.concatenate(parts)
            whole = len(flat) // BLOCK * BLOCK if least > 1 else len(flat)
            data = [flat[k : min(k + BLOCK, whole)].tobytes() for k in range(0, whole, BLOCK)]
            parts, held = [flat[whole:]], len(flat) - whole
            yield blocks(file, range(block, block + len(data)), data)
            block += len(data)

        def blocks(file: int, numbers: range, data: list[bytes]) -> pa.RecordBatch:
            n = len(data)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, name_type), pa.array(data, pa.binary())], names=["file", "block", "ordinal", "name", "data"])

        for batch in batches:
            n, name_type = batch.num_rows, batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0), pa.nulls(n, pa.binary())], names=["file", "block", "ordinal", "name", "data"])
            ordinal += n
            for text in batch.column(1):
                ids = own.encode_to_numpy(text.as_py() or "", disallowed_special=())
                parts += [ids.astype(store), separator.astype(store)]
                held += len(ids) + 1
                yield from cut(8 * BLOCK)
        yield from cut(1)

    return stored(arrow_rows(rows, run, schema), compression="zstd")


def flat_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Flat, unindexed token files under path as blocks (file, block, data), for scan_blocks and stitch: each task reads byte ranges.

    Spark lists the files without reading them; a range of `block` ids is one row, opened and read where it is
    scanned by the file system library's handler of the path's scheme (file, hdfs, s3, gs, abfs). file numbers
    the files in the order of their paths' hashes. Bytes after the last whole id are an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length"))
    step = width * block
    ranges = files.where(F.col("length") > 0).select("path", "length", F.xxhash64("path").alias("file"), F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, file, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{name} is cut within an id")
                system, place = pa.fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as opened:
                    data = opened.read_at(min(step, length - number * step), number * step)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return arrow_rows(ranges.repartition("file", "block"), run, "file long, block long, data binary")


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """A summary of each block (file, block, data): n, n_separators, head, tail and inner (counts between separators).

    head: tokens before the first separator, tail: after the last; without one, head is n and tail 0.
    """
    store = np.uint16 if width == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", store)
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(at), at[0] if len(at) else len(ids), len(ids) - 1 - at[-1] if len(at) else 0, np.diff(at) - 1))
            inner = [r[4] for r in rows]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in inner]))).astype(np.int32)), pa.array(np.concatenate(inner).astype(np.int64) if inner else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(4)), lists], names=["file", "block", "n", "n_separators", "head", "tail", "inner"])

    return arrow_rows(blocks.select("file", "block", "data"), run, "file long, block long, n long, n_separators long, head long, tail long, inner array<bigint>")


def stitch(summaries: DataFrame) -> DataFrame:
    """Documents of all files: file, ordinal (from 0), n_tokens, closed (false for what follows a file's last separator).

    Exclusive prefix sums of tokens and separators and the last separator's place give what is open at the
    start of a block. Two levels: within groups of blocks, and over the groups of a file.
    """
    s = summaries.withColumn("group", F.expr(f"block div {GROUP}"))
    own = Window.partitionBy("file", "group").orderBy("block")
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    end = F.when(F.col("n_separators") > 0, F.sum("n").over(so_far) - F.col("tail"))
    s = s.withColumns({"n_before": F.coalesce(F.sum("n").over(before), zero), "docs_before": F.coalesce(F.sum("n_separators").over(before), zero), "end": end})
    s = s.withColumn("end_before", F.max("end").over(before))
    groups = s.groupBy("file", "group").agg(F.sum("n").alias("g_n"), F.sum("n_separators").alias("g_docs"), F.max("end").alias("g_end"))
    over = Window.partitionBy("file").orderBy("group")
    over_before, over_so_far = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.select("file", "group", F.coalesce(F.sum("g_n").over(over_before), zero).alias("f_n"), F.coalesce(F.sum("g_docs").over(over_before), zero).alias("f_docs"), (F.sum("g_n").over(over_so_far) - F.col("g_n") + F.col("g_end")).alias("f_end"))
    groups = groups.withColumn("f_end", F.max("f_end").over(over_before))
    s = s.join(groups, ["file", "group"])
    last = F.coalesce(F.col("f_n") + F.col("end_before"), F.col("f_end"), zero)
    carried = F.col("f_n") + F.col("n_before") - last
    closed = s.where(F.col("n_separators") > 0).select("file", (F.col("f_docs") + F.col("docs_before")).alias("first"), F.posexplode(F.concat(F.array(carried + F.col("head")), "inner")).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    ends = s.groupBy("file").agg(F.sum("n").alias("n"), F.sum("n_separators").alias("ordinal"), F.max(F.col("f_n") + F.col("end")).alias("end"))
    rest = ends.select("file", "ordinal", (F.col("n") - F.coalesce("end", zero)).alias("n_tokens"), F.lit(False).alias("closed")).where(F.col("n_tokens") > 0)
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token files of docs, scanned: id_col, n_tokens, file, ordinal; a row for each document, repeated rows included.

    Null, empty: 0 tokens. An empty table gives no row. Other columns aren't read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    separator = encoding(path).n_vocab
    table = write_token_files(docs, id_col, text_col, path)
    # The summaries are written once: the prefix scan reads them three times.
    counted = stitch(stored(scan_blocks(table.where(F.col("data").isNotNull()), separator, 2 if separator < 65_536 else 4)))
    names = table.where(F.col("data").isNull()).select("file", "ordinal", F.col("name").alias(id_col))
    return names.join(counted, ["file", "ordinal"]).select(id_col, "n_tokens", "file", "ordinal")

