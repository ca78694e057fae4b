"""Byte-level BPE by recursive queries: DuckDB contracts the token rows of each partition's words."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.workers import small_batches, tidy

#: Bytes of a word up to which one pair a step is contracted; longer words take all safe pairs of a rank at once.
SHORT = 64
#: Token rows that one query starts from, and rows that one recursion may hold.
ROWS, HELD = 200_000, 3_000_000
#: Bytes of text, and tokens, that are worked on at a time.
TEXT_BYTES, DECODE_TOKENS = 4 << 20, 500_000
#: Words a task remembers.
KNOWN = 400_000

# Token rows (w word, p byte position, np that of the next row, tok, nxt next token or null). A step finds each word's
# minimum-rank pair, leftmost first, and contracts it: the row of its left token goes, that of its right token ("hole")
# takes the merged token and the left one's position, and the row before sees the merged token next. Words without a
# pair leave the recursion; a word's last rows are its tokens.
CONTRACT = """
WITH RECURSIVE t AS (
  SELECT w, p, np, tok, nxt, m, 0 AS step FROM rows_in LEFT JOIN merges ON pair = (tok << 32) | nxt
  UNION ALL
  SELECT w, p, np, s.tok, s.nxt, merges.m, step FROM (
    SELECT t.w, t.np, t.step + 1 AS step,
           CASE WHEN t.p = h.hole THEN h.least & 4294967295 ELSE t.p END AS p,
           CASE WHEN t.p = h.hole THEN h.least >> 32 ELSE t.tok END AS tok,
           CASE WHEN t.np = (h.least & 4294967295) THEN h.least >> 32 ELSE t.nxt END AS nxt
    FROM t JOIN (SELECT w, min((m << 32) | p) AS least, arg_min(np, (m << 32) | p) AS hole
                 FROM t WHERE m IS NOT NULL GROUP BY w) h ON t.w = h.w
    WHERE t.p <> (h.least & 4294967295)
  ) s LEFT JOIN merges ON pair = (s.tok << 32) | s.nxt)
SELECT w, tok, false AS more FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, p"""

# The same for long words, with every pair of the word's minimum rank in one step where that is safe: no vocabulary
# entry of that or a lower rank begins or ends with the merged token, so contracting one pair cannot make another one
# come first. Of a run of overlapping pairs (x x x) every second one is taken, from the left. Stops after $steps steps;
# "more" says that a word has pairs left.
CONTRACT_LONG = """
WITH RECURSIVE t AS (
  SELECT w, p, tok, nxt, m, safe, 0 AS step FROM rows_in LEFT JOIN merges ON pair = (tok << 32) | nxt
  UNION ALL
  SELECT w, p, s.tok, s.nxt, merges.m, merges.safe, step FROM (
    SELECT w, p, tok, step, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nxt FROM (
      SELECT w, p, step, CASE WHEN hit THEN m ELSE tok END AS tok,
             coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM (
        SELECT w, p, tok, m, step, coalesce(m = best AND CASE
                 WHEN p = first THEN true WHEN NOT safe THEN false WHEN tok <> nxt THEN true
                 ELSE (i - coalesce(max(CASE WHEN m IS DISTINCT FROM best THEN i END)
                                      OVER (PARTITION BY w ORDER BY i), 0)) % 2 = 1 END, false) AS hit
        FROM (SELECT t.w, t.p, t.tok, t.nxt, t.m, t.safe, t.step + 1 AS step, least >> 32 AS best,
                     least & 4294967295 AS first, row_number() OVER (PARTITION BY t.w ORDER BY t.p) AS i
              FROM t JOIN (SELECT w, min((m << 32) | p) AS least FROM t WHERE m IS NOT NULL GROUP BY w) x ON t.w = x.w))
    ) WHERE NOT gone
  ) s LEFT JOIN merges ON pair = (s.tok << 32) | s.nxt
  WHERE step <= $steps)
SELECT w, tok, max(m IS NOT NULL) OVER (PARTITION BY w) AS more
FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, p"""

DECODE = """
SELECT part, unhex(string_agg(piece, '' ORDER BY pos)) AS bytes FROM ids_in JOIN vocabulary USING (id)
GROUP BY part ORDER BY part"""


class _Vocabulary:
    """The rank file as two tables of an in-memory DuckDB: ``merges`` has a row
    for every cut of an entry into two entries, ``vocabulary`` the bytes."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        cuts = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t))
                if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
        unsafe = np.union1d(left[merged <= left], right[merged <= right])
        self.cut, self.whole = regex.compile(pattern), {t: np.uint32(i).tobytes() for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # no spill folder: what a query holds is bounded by ROWS, HELD and DECODE_TOKENS
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("merges", {"pair": left << 32 | right, "m": merged, "safe": ~np.isin(merged, unsafe)})
        self._table("vocabulary", {"id": np.array(list(ranks.values()), np.int64), "piece": [t.hex() for t in ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, name: str, rows: dict, sql: str, **params) -> pa.Table:
        self.db.register(name, pa.table(rows))
        try:
            return self.db.sql(sql, params=params or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _rows(self, w: np.ndarray, tok: np.ndarray) -> dict:
        """Token rows of words given one after the other."""
        first = np.flatnonzero(np.diff(w, prepend=-1))
        p = np.arange(len(w)) - np.repeat(first, np.diff(first, append=len(w)))
        last = np.diff(w, append=-1) != 0
        return {"w": w, "p": p, "np": p + 1, "tok": tok,
                "nxt": pa.array(np.append(tok[1:], 0), mask=last)}

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Token ids (32-bit) of each word, by one run of the recursive query (long words: until no pair is left)."""
        sizes = np.array([len(x) for x in words])
        tok = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        w, out = np.repeat(np.arange(len(words)), sizes), [b""] * len(words)
        long = sizes.max() > SHORT
        while len(w):
            sql, steps = (CONTRACT_LONG, {"steps": max(4, HELD // len(w))}) if long else (CONTRACT, {})
            got = self._query("rows_in", self._rows(w, tok), sql, **steps)
            w, tok = got["w"].to_numpy(), got["tok"].to_numpy()
            more = got["more"].to_numpy()
            done_w, raw = w[~more], tok[~more].astype("<u4").tobytes()
            first = np.flatnonzero(np.diff(done_w, prepend=-1))
            ends = np.append(first, len(done_w))[1:]
            for i, a, b in zip(done_w[first].tolist(), first.tolist(), ends.tolist(), strict=True):
                out[i] = raw[4 * a:4 * b]
            w, tok = w[more], tok[more]
        return out

    def learn(self, words: list[str], known: dict[str, bytes]) -> None:
        """Adds the token ids of ``words`` to ``known``: a vocabulary entry is one
        token as it stands; the others are contracted, short words apart from long ones."""
        raw = []
        for word in words:
            x = word.encode()
            if x in self.whole:
                known[word] = self.whole[x]
            else:
                raw.append((len(x), x, word))
        for some in ([r for r in raw if r[0] <= SHORT], [r for r in raw if r[0] > SHORT]):
            at = 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and (end == at or size + some[end][0] <= ROWS):
                    size, end = size + some[end][0], end + 1
                got = self._contract([x for _, x, _ in some[at:end]])
                known.update(zip((word for _, _, word in some[at:end]), got, strict=True))
                at = end

    def encode(self, texts: list[str], known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the end of the last), and all ids."""
        cut = [self.cut.findall(t) for t in texts]
        flat = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        new = [word for word in words if word not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = words
        self.learn(new, known)
        ids = [known[word] for word in words]
        values, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        begin, taken = (np.cumsum(sizes) - sizes)[index], sizes[index]
        upto = np.concatenate([[0], np.cumsum(taken)])
        out = values[np.repeat((begin - upto[:-1]).astype(np.int32), taken) + np.arange(upto[-1], dtype=np.int32)]
        return upto[np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)], out

    def decode(self, begin: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids: pieces of a row in their order, by slices of bounded size."""
        if not len(ids):
            return [b""] * (len(begin) - 1)
        row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        out: list[list[bytes]] = [[] for _ in range(len(begin) - 1)]
        for lo in range(0, len(ids), DECODE_TOKENS):
            part = row[lo:lo + DECODE_TOKENS]
            got = self._query("ids_in", {"part": part, "pos": np.arange(lo, lo + len(part)),
                                         "id": ids[lo:lo + DECODE_TOKENS].astype(np.int64)}, DECODE)
            for i, x in zip(got["part"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                out[i].append(x)
        return [b"".join(x) for x in out]


@lru_cache(maxsize=1)
def _vocabulary(path: str, pattern: str) -> _Vocabulary:
    return _Vocabulary(path, pattern)


def _some(column: pa.Array, weight: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``weight`` bytes (one row at least)."""
    ends = np.cumsum([(x.as_buffer().size if x.is_valid else 0) for x in column.cast(pa.large_binary())])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + weight, "right")))
        yield at, end
        at = end


def _lists(begin: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))


def _encoder(path: str, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = _vocabulary(path, pattern), {}
        for batch in batches:
            texts = batch.column("_text")
            for at, end in _some(texts, TEXT_BYTES):
                begin, ids = vocabulary.encode([x or "" for x in texts.slice(at, end - at).to_pylist()], known)
                out = [batch.column("_id").slice(at, end - at), _lists(begin, ids)]
                if decoded:
                    out.append(pa.array(vocabulary.decode(begin, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["_id", "ids", "decoded"][:len(out)])

    return run


def _rows(docs: DataFrame, doc_id: str, other: str, name: str, kind: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(other).cast(kind).alias(name))
    small_batches(docs.sparkSession)
    return rows, f"_id {rows.schema['_id'].dataType.simpleString()}"


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """Token ids of every whole text by the byte pairs of a rank file.

    ``ranks`` is a vocabulary file of lines "base64 rank", the same on every
    machine; ``pattern`` cuts a text into words, and text that it does not
    match is left out. Of each word's bytes the pair whose joined bytes have the
    lowest rank is contracted, the leftmost first, until no pair is in the
    vocabulary: token-position rows of the distinct words of a few megabytes of
    text meet the merge table in a recursive DuckDB query inside the task. A
    word that is itself in the vocabulary is that one token. No special tokens. One narrow stage, no shuffle.

    Returns one row per row of ``docs``: ``doc_id, ids`` (array of int) and with
    ``decoded`` also ``decoded``, the bytes that ``decode`` gives for the ids.
    Null and empty texts have no ids; repeated rows give equal rows; an empty
    table gives an empty result; other columns are ignored, whatever their
    names.
    """
    rows, kind = _rows(docs, doc_id, text, "_text", "string")
    out = rows.mapInArrow(tidy(_encoder(ranks, pattern, decoded)),
                          f"{kind}, ids array<int>" + (", decoded binary" if decoded else ""))
    return out.withColumnRenamed("_id", doc_id)


def decode(rows: DataFrame, ranks: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of every row of token ids, joined in the order of the ids.

    Ids and vocabulary meet in a DuckDB query inside the task, whose ordered
    aggregation puts the pieces together. Returns ``doc_id, decoded`` (binary)
    for each row; null and empty arrays give empty bytes, null or unknown ids
    within an array raise. An empty table gives an empty result; other columns
    are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, "")
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("_ids").to_pylist()]
            every = np.concatenate([np.empty(0, np.int64), *lists])
            if not np.isin(every, vocabulary.db.sql("SELECT id FROM vocabulary").fetchnumpy()["id"]).all():
                raise ValueError("an id is not in the vocabulary")
            begin = np.cumsum([0, *[len(x) for x in lists]])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(vocabulary.decode(begin, every), pa.binary())],
                                             ["_id", "decoded"])

    some, kind = _rows(rows, doc_id, ids, "_ids", "array<int>")
    return some.mapInArrow(tidy(run), f"{kind}, decoded binary").withColumnRenamed("_id", doc_id)
