"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.components import connected_components
from vitalgrid.llm.workers import small_batches, tidy
from vitalgrid.session import materialize

BITS = 64
#: Segments of the ring; with fewer segments keys are longer and buckets smaller, but more keys are probed.
SEGMENTS = 3
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time, so that a very long text needs bounded memory for its bits.
_CHUNK = 65536


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text`` (A-Z lower-cased,
    repeats count; fewer words than ``width``: one shingle of all; none: 0).
    A bit is 1 if it is set in more than half of the shingle hashes."""
    if not text:
        return 0
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - width + 1)
    starts = [0, *ends]
    stops = ends[min(width, len(words)) - 1:]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        hashes = np.array([digest(line[a:b - 1], seed) for a, b in
                           zip(starts[lo:min(n, lo + _CHUNK)], stops[lo:lo + _CHUNK], strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width, seed) for t in batch.column("text")]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed, pa.int64())], ["doc_id", "fp"])

    return run


def _segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each segment, as even as possible."""
    cut = [i * BITS // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def _mask(lo: int, n: int) -> int:
    value = ((1 << n) - 1) << lo
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_pairs(prints: DataFrame, max_bits: int, segments: int = SEGMENTS) -> DataFrame:
    """All pairs of different fingerprints (column ``fp``, distinct) at most
    ``max_bits`` apart: ``fp_a < fp_b`` as signed numbers.

    Pigeonring: the bits are cut into ``segments`` on a ring. If two
    fingerprints differ in at most ``max_bits`` bits, then for some segment
    every chain of l consecutive segments from it on differs in at most
    floor(l * max_bits / segments) bits in all. Candidates therefore agree in
    a segment up to its budget for l = 1: one side is indexed by segment value,
    the other probes every value within that budget. Candidates are checked
    chain by chain, and only then by the full Hamming distance, inside the
    join, so that only links leave it. Fingerprints are distinct, so a
    fingerprint has a bounded number of links however many copies there are;
    a frequent segment value is a skewed join key, which adaptive execution splits.
    Spark sizes both sides by ``prints`` alone, without the rows that the keys
    make of each (67 a fingerprint with 3 segments and 4 bits), and would send
    them to the driver, so neither side is broadcast.
    """
    ring = _segments(segments)
    budget = [(i + 1) * max_bits // segments for i in range(segments)]
    index, probe = [], []
    for s, (lo, n) in enumerate(ring):
        value = F.col("fp").bitwiseAND(F.lit(_mask(lo, n)))
        flips = _flips(lo, n, budget[0])
        index.append(F.struct(F.lit(s).alias("s"), value.alias("v")))
        probe += [F.struct(F.lit(s).alias("s"), value.bitwiseXOR(F.lit(x)).alias("v")) for x in flips]
    left = prints.select(F.col("fp").alias("fp_a"), F.explode(F.array(*index)).alias("k")).select("fp_a", "k.s", "k.v")
    right = prints.select(F.col("fp").alias("fp_b"), F.explode(F.array(*probe)).alias("k")).select("fp_b", "k.s", "k.v")
    diff = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    chains = F.lit(False)
    for s in range(segments):
        chain = F.col("l.s") == s
        for length in range(1, segments):
            mask = 0
            for k in range(length):
                mask |= _mask(*ring[(s + k) % segments]) & ((1 << BITS) - 1)
            mask -= (1 << BITS) if mask >> (BITS - 1) else 0
            chain = chain & (F.bit_count(diff.bitwiseAND(F.lit(mask))) <= budget[length - 1])
        chains = chains | chain
    on = ((F.col("l.s") == F.col("r.s")) & (F.col("l.v") == F.col("r.v")) & (F.col("fp_a") < F.col("fp_b"))
          & chains & (F.bit_count(diff) <= max_bits))
    return left.alias("l").hint("merge").join(right.alias("r").hint("merge"), on).select("fp_a", "fp_b")


def _flips(lo: int, n: int, most: int) -> list[int]:
    """Every difference of at most ``most`` bits within a segment, as signed 64-bit masks."""
    level, out = {0}, {0}
    for _ in range(most):
        level = {x | 1 << b for x in level for b in range(lo, lo + n) if not x >> b & 1}
        out |= level
    return sorted(x - (1 << BITS) if x >> (BITS - 1) else x for x in out)


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4,
                   seed: int = 42, segments: int = SEGMENTS) -> DataFrame:
    """SimHash fingerprint of every document and the component it is linked into.

    Documents are linked when their fingerprints differ in at most ``max_bits``
    bits. Equal fingerprints are put together first, so copies of any number
    count as one in the candidate search; components are then formed over
    distinct fingerprints, each standing for its smallest document.

    Returns one row per input row: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (smallest identifier reachable, itself included). Null,
    empty and blank texts have fingerprint 0 and are linked like any other;
    repeated rows get the same result; a null identifier is linked but never
    names a component unless nothing else is in it (then null). An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    prints = materialize(rows.mapInArrow(tidy(_fingerprints(width, seed)), "doc_id long, fp long"), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    links = near_pairs(nodes.select("fp"), max_bits, segments)
    groups = connected_components(links, "fp_a", "fp_b").withColumnRenamed("node", "fp")
    least = nodes.join(groups, "fp").groupBy("component").agg(F.min("rep").alias("least"))
    named = materialize(groups.join(least, "component").select("fp", "least"), "simhash-names")
    label = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    # a file of few fingerprints is far smaller than its rows are in memory
    return prints.hint("merge").join(label, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose document names its component (all columns)."""
    groups = simhash_groups(docs, doc_id, text, **how)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone"))
    gone = materialize(gone.distinct(), "simhash-gone")
    return docs.join(gone, docs[doc_id].cast("long") == F.col("_gone"), "left_anti")
