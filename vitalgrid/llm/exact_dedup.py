"""Exact deduplication by a distributed sort of the normalised content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.session import materialize

#: Bytes of the normalised content that splitters carry; digest and identifier break ties.
HEAD = 64


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalise (A-Z lower-cased, null as empty), add the digest and the sort head."""
    for batch in batches:
        norm = pc.cast(pc.ascii_lower(pc.fill_null(batch.column("_text"), "")), pa.binary())
        raw = norm.to_pylist()
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names]
            + [norm, pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
               pa.array([x[:HEAD] for x in raw], pa.binary())], [*names, "_norm", "_sha", "_head"])


def _runs(carried: list[str]):
    """Sorted rows of a partition -> the same rows with the run of equal
    contents each belongs to, found by comparing whole neighbours. Only the
    identifiers of the run in progress are held (the carried columns of one
    Arrow batch at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, run_no, seen, keep_id = None, -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            norm, ids = batch.column("_norm"), batch.column("_id")
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or norm[0] != last
            starts = np.flatnonzero(fresh)
            number = run_no + np.cumsum(fresh)
            bounds = np.concatenate(([0] if not len(starts) or starts[0] else [], starts, [n])).astype(int)
            rank = np.empty(n, np.int64)
            keep = []
            id_list = ids.to_pylist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if fresh[lo]:
                    seen, keep_id = 0, id_list[lo]
                rank[lo:hi] = np.arange(seen, seen + hi - lo)
                seen += hi - lo
                keep += [keep_id] * (hi - lo)
            last, run_no = norm[n - 1], int(number[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried]
                + [ids, batch.column("_sha"), pa.array(np.full(n, part), pa.int32()), pa.array(number, pa.int64()),
                   pa.array(rank, pa.int64()), pa.array(keep, pa.int64())],
                [*carried, "_id", "_sha", "_part", "_run", "_rank", "_keep"])

    return run


def _sorted_groups(docs: DataFrame, doc_id: str, text: str, keep: str,
                   carry: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Groups of equal contents by sorting them.

    Contents are equal when identical after lower-casing A-Z; null counts as
    empty. Sampled splitters range-partition the rows by (first ``HEAD`` bytes
    of the normalised content, its digest, identifier): a splitter stays small
    however long the texts are, and a group of copies that holds a third of all
    rows is split by identifier over many partitions. Each partition is sorted
    externally, equal contents come to lie side by side, and whole neighbours
    are compared. Only the first and the last run of a partition can go on in
    another one: those, at most two per partition, are put together by digest.

    ``keep`` is ``smallest`` or ``largest`` and names the identifier that stays.
    Rows that repeat an identifier and its text are copies of each other: one
    of them is kept. A null identifier is sorted behind all others. An empty
    table gives an empty result. Columns that are not carried are never read,
    and carried ones travel under names of their own.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    largest = keep == "largest"
    names = {c: f"_c{i}" for i, c in enumerate(carry)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(doc_id).cast("long").alias("_id"),
                       F.col(text).cast("string").alias("_text"))
    extra = [f for f in rows.schema.fields if f.name.startswith("_c")]
    key = T.StructType([*extra, T.StructField("_id", T.LongType()), T.StructField("_norm", T.BinaryType()),
                        T.StructField("_sha", T.BinaryType()), T.StructField("_head", T.BinaryType())])
    order = [F.col("_head"), F.col("_sha"), F.col("_id").desc_nulls_last() if largest else F.col("_id").asc_nulls_last()]
    rows = rows.mapInArrow(_keyed, key).repartitionByRange(*order).sortWithinPartitions(*order)
    found = T.StructType([*extra, T.StructField("_id", T.LongType()), T.StructField("_sha", T.BinaryType()),
                          T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()),
                          T.StructField("_rank", T.LongType()), T.StructField("_keep", T.LongType())])
    runs = materialize(rows.mapInArrow(_runs([f.name for f in extra]), found), "sorted-runs")
    return _resolve(runs, largest), names


def content_sort(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups of equal contents, found by sorting them (see ``_sorted_groups``).

    Returns one row per input row: ``doc_id, keep_id`` (the identifier that
    stays), ``group_size, kept, text_sha256`` (of the normalised content). All
    other columns are ignored.
    """
    rows, _ = _sorted_groups(docs, doc_id, text, keep, [])
    return rows.select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"),
                       F.col("_size").alias("group_size"), F.col("_kept").alias("kept"),
                       F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per content."""
    rows, names = _sorted_groups(docs, doc_id, text, keep, docs.columns)
    return rows.filter("_kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def _resolve(runs: DataFrame, largest: bool) -> DataFrame:
    """Sizes of runs, and the runs that a partition bound cuts put together."""
    best = F.max if largest else F.min
    sizes = runs.groupBy("_part", "_run").agg(F.count("*").alias("_n"), F.first("_keep").alias("_k"),
                                              F.first("_sha").alias("_d"))
    ends = runs.groupBy("_part").agg(F.min("_run").alias("_lo"), F.max("_run").alias("_hi"))
    edge = sizes.join(F.broadcast(ends), "_part").filter((F.col("_run") == F.col("_lo")) | (F.col("_run") == F.col("_hi")))
    whole = edge.groupBy("_d").agg(F.sum("_n").alias("_wn"), best("_k").alias("_wk"),
                                   F.min(F.struct(F.col("_k").isNull(), (F.col("_k") * (-1 if largest else 1)),
                                                  F.col("_part"))).getField("_part").alias("_wp"),
                                   F.collect_list(F.struct("_part", "_run")).alias("_in"))
    cut = whole.select(F.explode("_in").alias("_at"), "_wn", "_wk", "_wp").select("_at._part", "_at._run", "_wn", "_wk", "_wp")
    sizes = materialize(sizes.filter("_n > 1").select("_part", "_run", "_n"), "run-sizes")
    out = runs.join(F.broadcast(cut), ["_part", "_run"], "left").join(sizes, ["_part", "_run"], "left")
    mine = (F.col("_rank") == 0) & F.coalesce(F.col("_wp") == F.col("_part"), F.lit(True))
    return out.select(*[c for c in runs.columns if c.startswith("_c")], "_id", "_sha",
                      F.when(F.col("_wn").isNull(), F.col("_keep")).otherwise(F.col("_wk")).alias("_keep_id"),
                      F.coalesce("_wn", "_n", F.lit(1)).cast("long").alias("_size"), mine.alias("_kept"))
