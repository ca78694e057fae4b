"""Best-fit packing of tokenised documents, certified by dual-feasible bounds."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.workers import small_batches, tidy
from vitalgrid.session import materialize

#: Pieces per partition that is packed on its own, and rounds of exchange between partitions.
PARTITION_PIECES = 16384
ROUNDS = 3
#: Parts of words that a task remembers, and bytes of text whose parts are numbered together.
KNOWN, TEXT_BYTES = 200_000, 2 << 20
#: Blanks at which a text may be cut into words without changing its tokens.
_BLANKS = re.compile(r"[ \t\n\r]+")
# str.split also cuts at four control characters that the tokenizer takes for signs
_CONTROL = re.compile("[\x1c-\x1f]")
#: Plain characters are in composed form and have a lower case of one character each.
_PLAIN = "!-~\u00a1-\u012f\u0131-\u017f"
_PLAIN_WORD, _OTHER = re.compile(f"[{_PLAIN}]+"), re.compile(f"[^{_PLAIN} \\t\\n\\r]|<[|]")
# Fixed value: the pattern by which the tokenizer cuts a text,
# 's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+ , for plain characters.
_LETTER, _NUMBER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ \\t\\n\\r{_LETTER}{_NUMBER}]+")


class WordTokens:
    """Token ids of whole texts, by the parts (letter runs, digits, signs) into
    which the tokenizer cuts them: it drops white space and never joins tokens
    over parts, so a text's ids are those of its parts in a row. Plain Latin
    text is cut here by the tokenizer's own pattern; of other text the plain
    words are, and each other word is one part that goes through the whole
    tokenizer. The parts of a few megabytes of text are numbered by Arrow, only
    the different ones are looked up, and new ones go to the BPE model many to a
    line. A task remembers the ids (little-endian, 32 bits) of at most ``KNOWN``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bytes = _ByteCharacters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def learn(self, missing: list[str], known: dict[str, bytes]) -> None:
        """Adds the ids of ``missing`` to ``known``."""
        self._parts([p for p in missing if p[0] != " "], known)
        other = [p for p in missing if p[0] == " "]
        for word, ids in zip(other, self._encode(self.tokenizer, [w[1:] for w in other]), strict=True):
            known[word] = np.array(ids, dtype="<u4").tobytes()

    def _parts(self, parts: list[str], known: dict[str, bytes]) -> None:
        """Ids of plain parts; a line of parts is cut after the tokens that end one."""
        lines = [parts[i:i + 64] for i in range(0, len(parts), 64)]
        shown = [" ".join([p if p.isascii() else p.translate(self.bytes) for p in line]) for line in lines]
        for line, got in zip(lines, self._encode(self.model, shown), strict=True):
            ids = np.array(got, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(line):
                raise ValueError("the vocabulary does not mark the end of every word")
            raw, stops = ids.tobytes(), (4 * stops).tolist()
            for part, a, b in zip(line, [0, *stops[:-1]], stops, strict=True):
                known[part] = raw[a:b]

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    @staticmethod
    def cut(text: str) -> list[str]:
        """Parts of a text; a word of other than plain characters is one part, marked by a blank in front."""
        if not _OTHER.search(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for word in _BLANKS.split(text) if _CONTROL.search(text) else text.split():
            if _PLAIN_WORD.fullmatch(word) and "<|" not in word:
                out.extend(_PARTS.findall(word.lower()))
            elif word:
                out.append(f" {word}")
        return out

    def ids(self, texts: list[str], known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin (and the last ones end), and all ids."""
        cut = [self.cut(t) for t in texts]
        flat = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = words
        self.learn(new, known)
        found = [known[w] for w in words]
        values, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        begin, taken = (np.cumsum(sizes) - sizes)[index], sizes[index]
        upto = np.concatenate([[0], np.cumsum(taken)])
        out = values[np.repeat((begin - upto[:-1]).astype(np.int32), taken) + np.arange(upto[-1], dtype=np.int32)]
        return upto[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)], out


class _ByteCharacters(dict):
    """Code point -> the characters that stand for its UTF-8 bytes in a byte-level vocabulary."""

    def __init__(self, level):
        super().__init__()
        self.level = level

    def __missing__(self, code: int) -> str:
        self[code] = shown = self.level.pre_tokenize_str(chr(code))[0][0]
        return shown


@lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _ranges(texts: pa.Array, weight: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``weight`` bytes (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + weight, "right")))
        yield at, end
        at = end


def _pieces(path: str, size: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = _tokens(path), {}
        for batch in batches:
            for at, stop in _ranges(batch.column("_text")):
                some = batch.column("_text").slice(at, stop - at).to_pylist()
                begin, ids = tokens.ids([t or "" for t in some], known)
                out: list[tuple] = []
                for i in range(stop - at):
                    raw = ids[begin[i]:begin[i + 1]].tobytes() + end
                    for k, lo in enumerate(range(0, len(raw), 4 * size)):
                        cut = raw[lo:lo + 4 * size]
                        out.append((at + i, k, lo // 4, len(cut) // 4, zlib.crc32(cut)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (longest first, each into the fullest bin
    that still holds it, else a new one), and the fill of each bin. The free
    space of open bins is a bit set, so the best bin is one shift away."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    open_, fill = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            space = n + ((fits & -fits).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                open_ &= ~(1 << space)
        else:
            b, space = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := space - n:
            free[left].append(b)
            open_ |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def bin_lower_bound(lengths: np.ndarray, size: int, thresholds: int = 64) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible
    functions. u_k rounds x = length / size to floor((k+1) x) / k (x itself if
    (k+1) x is whole); the threshold family counts pieces over size - t as
    whole bins and drops those below t."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)
    n = np.arange(size + 1)
    best = -(-int((count * n).sum()) // size)
    for k in range(1, 21):
        scaled = (k + 1) * n
        u = np.where(scaled % size == 0, k * n, (scaled // size) * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    for t in np.unique(np.linspace(1, size // 2, thresholds).astype(int)):
        f = np.where(n > size - t, size, np.where(n < t, 0, n))
        best = max(best, -(-int((count * f).sum()) // size))
    return best


def _packed(size: int, tag: int):
    """One partition packed: every piece with its sequence and place, whether
    the bound certifies the partition, and the rank of its bin from the
    emptiest on (the bins that are given up for exchange come first)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "start"], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, size)
        rank = np.empty(len(fill), np.int64)
        rank[np.argsort(fill, kind="stable")] = np.arange(len(fill))
        bound = bin_lower_bound(lengths, size)
        return frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=(tag << 52) + (int(frame["bucket"].iloc[0]) << 20) + bins, offset=offsets,
            n_bins=len(fill), bound=bound, bin_rank=rank[bins])

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, n_bins long, bound long, bin_rank long"


def _pack_once(pieces: DataFrame, count: int, size: int, tag: int, partition_pieces: int) -> DataFrame:
    buckets = max(1, round(count / partition_pieces))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(tag)), F.lit(buckets)))
    return materialize(dealt.groupBy("bucket").applyInPandas(_packed(size, tag), _PLACED), f"packed-{tag}")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096,
         end_id: int = 1, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Tokenised documents packed into sequences of at most ``size`` tokens.

    A document's ids are the tokenizer's (file ``tokenizer``, no special
    tokens) and then ``end_id``; null counts as an empty text. Documents longer
    than ``size`` are cut into pieces of ``size``, the last one may be shorter.
    Pieces are dealt evenly over partitions of about ``partition_pieces`` and
    packed there by best-fit decreasing. Dual-feasible lower bounds certify a
    partition whose bins cannot be fewer. Partitions with a gap give up their
    emptiest quarter of bins (two at least); those documents are exchanged,
    dealt into new partitions and packed again, and the result is taken if it
    needs fewer sequences. At most ``rounds`` rounds.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. Repeated rows are packed once each. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    small_batches(docs.sparkSession)
    pieces = materialize(rows.mapInArrow(tidy(_pieces(tokenizer, size, end_id)), _PIECE), "pieces")
    placed = _pack_once(pieces, pieces.count(), size, 0, partition_pieces)
    done = []
    for tag in range(1, rounds + 1):
        given = F.greatest(F.lit(2), F.ceil(F.col("n_bins") / 4))
        out = (F.col("n_bins") > F.col("bound")) & (F.col("bin_rank") < given)
        freed = placed.filter(out)
        n, bins = freed.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if bins < 2:
            break
        again = _pack_once(freed.select("doc_id", "piece", "start", "length", "ids_crc32"), n, size, tag,
                           partition_pieces)
        if again.select("sequence_id").distinct().count() >= bins:
            break
        done.append(placed.filter(~out))
        placed = again
    for part in done:
        placed = placed.unionByName(part)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
