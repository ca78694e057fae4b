"""Language identification by segmentation-marginalised unigram models."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalgrid.llm.workers import small_batches, tidy
from vitalgrid.session import materialize

#: Documents per language that a model is fitted on, at most (about; chosen by hash), and rounds of EM.
TRAIN_DOCS = 400
EM_ROUNDS = 2
#: Longest piece considered, entries of a worker's cache of word scores.
MAX_PIECE = 16
CACHE = 300_000
#: Words that are scored side by side, and kinds of characters they may have (at most 256).
WORDS = 5_000
CHARS = 96
#: Probability of a character that no piece covers, of every piece in the first round, and the weight of even counts
#: in smoothing.
UNSEEN = 1e-7
EVEN = 1e-3
SMOOTH = 0.05
_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def vocabulary(path: str) -> list[str]:
    """Pieces of a public sentencepiece vocabulary that can occur inside a
    lower-cased word (▁ marks its start), plus all single characters of theirs."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    kept = {p for p in pieces if 0 < len(p) <= MAX_PIECE and _LETTERS.fullmatch(p.removeprefix("▁") or "a")}
    return sorted(kept | {c for p in kept for c in p})


def held_out(doc_id: Column) -> Column:
    """crc32 of the identifier as text leaves 1 when divided by 3; null: false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _expected(langs: list[str], table: dict[str, np.ndarray], first: bool):
    """E-step: expected piece counts of each language over all segmentations of
    its words (forward-backward). In the first round pieces weigh alike."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], float] = {}
        for frame in frames:
            for lang, word, n in zip(frame["lang"], frame["word"], frame["n"], strict=True):
                w, at = "▁" + word, place[lang]
                size = len(w)
                arcs = []
                for i in range(size):
                    for j in range(i + 1, min(size, i + MAX_PIECE) + 1):
                        p = table.get(w[i:j])
                        if p is not None:
                            arcs.append((i, j, EVEN if first else float(p[at])))
                        elif j == i + 1:
                            arcs.append((i, j, UNSEEN))
                fwd, bwd = [1.0] + [0.0] * size, [0.0] * size + [1.0]
                for i, j, p in arcs:
                    fwd[j] += fwd[i] * p
                for i, j, p in reversed(arcs):
                    bwd[i] += p * bwd[j]
                if fwd[size] <= 0:
                    continue
                for i, j, p in arcs:
                    piece = w[i:j]
                    if piece in table:
                        key = (lang, piece)
                        counts[key] = counts.get(key, 0.0) + n * fwd[i] * p * bwd[j] / fwd[size]
        yield pd.DataFrame([(k[0], k[1], c) for k, c in counts.items()], columns=["lang", "piece", "n"])

    return run


def fit(train: DataFrame, vocab_path: str, lang: str = "lang", text: str = "text", doc_id: str = "doc_id",
        train_docs: int = TRAIN_DOCS, em_rounds: int = EM_ROUNDS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Piece probabilities of every language among the rows of ``train`` with a
    non-null language: ``(languages, piece -> probability per language)``.

    A language with more than ``train_docs`` rows is fitted on about that many,
    chosen by a hash of identifier and text; word counts and expected piece
    counts are summed in Spark. The driver gets one number per piece and
    language, a size that does not grow with the corpus. No labelled row: no
    language.
    """
    rows = train.filter(F.col(lang).isNotNull())
    count = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).cast("string").alias("lang"))
             .agg(F.count("*").alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return [], {}
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_docs / count[k])))])
    chance = F.pmod(F.xxhash64(F.lit("train"), F.col(doc_id).cast("string")), F.lit(1_000_003)) / 1_000_003
    picked = rows.filter(chance < share[F.col(lang).cast("string")]).select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for label, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word in words(value):
                    found[label, word] = found.get((label, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()),
                                              pa.array([k[1] for k in found], pa.string()),
                                              pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = materialize(picked.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word")
                          .agg(F.sum("n").alias("n")).repartition(picked.sparkSession.sparkContext.defaultParallelism),
                          "lang-words")
    pieces = vocabulary(vocab_path)
    table = {p: np.full(len(langs), 1.0 / len(pieces)) for p in pieces}
    for step in range(em_rounds):
        shared = picked.sparkSession.sparkContext.broadcast(table)
        got = counted.mapInPandas(_lazy(langs, shared, step == 0), "lang string, piece string, n double") \
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros((len(pieces), len(langs)))
        row = {p: i for i, p in enumerate(pieces)}
        for r in got:
            expected[row[r["piece"]], langs.index(r["lang"])] = r["n"]
        expected += SMOOTH
        expected /= expected.sum(axis=0)
        table = {p: expected[i] for i, p in enumerate(pieces)}
        shared.unpersist()
    return langs, table


def _lazy(langs, shared, first):
    def run(frames):
        yield from _expected(langs, shared.value, first)(frames)

    return run


def word_score(word: str, table: dict[str, tuple[float, ...]], n_langs: int) -> list[float]:
    """Log-probability of a word per language, summed over all its
    segmentations into pieces by the forward algorithm (rescaled, so that very
    long words do not underflow)."""
    w = "▁" + word
    size = len(w)
    out = []
    unseen = (UNSEEN,) * n_langs
    arcs = []
    for j in range(1, size + 1):
        into = []
        for i in range(max(0, j - MAX_PIECE), j):
            p = table.get(w[i:j])
            if p is not None:
                into.append((i, p))
            elif i == j - 1:
                into.append((i, unseen))
        arcs.append(into)
    for lang in range(n_langs):
        fwd, log = [1.0] + [0.0] * size, 0.0
        for j, into in enumerate(arcs, 1):
            total = 0.0
            for i, p in into:
                total += fwd[i] * p[lang]
            fwd[j] = total
            if total < 1e-200:
                top = max(fwd[max(0, j - MAX_PIECE):j + 1])
                if top <= 0.0:
                    top = 1e-300
                for k in range(max(0, j - MAX_PIECE), j + 1):
                    fwd[k] /= top
                log += math.log(top)
        out.append(log + math.log(max(fwd[size], 1e-300)))
    return out


class Pieces:
    """The pieces of ``table`` as a tree of characters in arrays, to score many words side by side.

    ``step[node * CHARS + kind]`` is the node after a further character (0: none), ``row[node]`` the row of ``probs`` of
    the piece that ends there (0: none; row 1: a character that no piece covers). ``kind`` numbers the ``CHARS - 2``
    most frequent characters of the pieces; 0 is a character of no piece, ``CHARS - 1`` any other one."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.table = {p: tuple(v.tolist()) for p, v in table.items()}
        self.probs = np.array([np.zeros_like(p := next(iter(table.values()))), np.full_like(p, UNSEEN), *table.values()])
        often = Counter(c for p in table for c in p)
        kind = {c: CHARS - 1 for c in often} | {c: k for k, (c, _) in enumerate(often.most_common(CHARS - 2), 1)}
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[ord(c) for c in kind]] = list(kind.values())
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for row, piece in enumerate(table, 2):
            at = 0
            for c in piece:
                at = nodes.setdefault((at, kind[c]), len(nodes) + 1) if kind[c] < CHARS - 1 else -1
                if at < 0:
                    break
            if at > 0:
                ends[at] = row
        # node 0 is no node: its steps lead nowhere, and the first steps are kept apart
        self.step = np.zeros((len(nodes) + 1) * CHARS, np.int32)
        self.step[[at * CHARS + c for at, c in nodes]] = list(nodes.values())
        self.first, self.step[:CHARS] = self.step[:CHARS].copy(), 0
        self.row = np.zeros(len(nodes) + 1, np.int32)
        self.row[list(ends)] = list(ends.values())
        #: Longest word, its mark included, whose probability is a normal number.
        self.safe = int(-199 / math.log10(min(1e-3, max(1e-300, self.probs[1:].min()))))

    def scores(self, found: list[str]) -> np.ndarray:
        """``word_score`` of every word, to the last digit. Words of a length go through the forward algorithm side by
        side; long words that might underflow and words with rare characters go one by one."""
        n_langs = self.probs.shape[1]
        out = np.empty((len(found), n_langs))
        lengths: dict[int, list[int]] = {}
        for k, word in enumerate(found):
            lengths.setdefault(len(word) + 1, []).append(k)
        for size, members in lengths.items():
            for lo in range(0, len(members), WORDS):
                part = np.array(members[lo:lo + WORDS])
                single = np.ones(len(part), bool)
                if size <= self.safe:
                    text = "".join("▁" + found[k] for k in part)
                    kinds = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(-1, size)
                    single = (kinds == CHARS - 1).any(axis=1)
                    logs = [[math.log(p) for p in chance] for chance in self._forward(kinds[~single].T).tolist()]
                    out[part[~single]] = np.array(logs).reshape(-1, n_langs)
                for k in part[single]:
                    out[k] = word_score(found[k], self.table, n_langs)
        return out

    def _forward(self, kinds: np.ndarray) -> np.ndarray:
        """Probabilities (words x languages) of words given by the kinds of their characters (characters x words)."""
        size, n = kinds.shape
        kinds = np.ascontiguousarray(kinds)
        fwd = np.zeros((size + 1, n, self.probs.shape[1]))
        fwd[0] = 1.0
        for i in range(size):
            node = self.first[kinds[i]]
            row = self.row[node]
            fwd[i + 1] += fwd[i] * self.probs[np.where(row > 0, row, 1)]
            live = np.arange(n)
            for j in range(i + 1, min(size, i + MAX_PIECE)):
                node = self.step[node * CHARS + kinds[j][live]]
                on = np.flatnonzero(node)
                live, node = live[on], node[on]
                if not len(live):
                    break
                row = self.row[node]
                ends = np.flatnonzero(row)
                fwd[j + 1][live[ends]] += fwd[i][live[ends]] * self.probs[row[ends]]
        return fwd[size]


def _parts(column: pa.Array) -> Iterator[list[tuple[int, list[str]]]]:
    """(row, words) of a column of texts, long texts in several pieces, grouped to about ``CACHE // 4`` words."""
    held, size = [], 0
    for at, value in enumerate(column):
        found = words(value.as_py() or "")
        for lo in range(0, len(found), CACHE // 4):
            part = found[lo:lo + CACHE // 4]
            if size + len(part) > CACHE // 4:
                yield held
                held, size = [], 0
            held.append((at, part))
            size += len(part)
    if held:
        yield held


def _predict(langs: list[str], shared, text: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value) if langs else None
        index: dict[str, int] = {}
        scores = np.zeros((CACHE, max(1, len(langs))))
        for batch in batches:
            best, score = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            totals: dict[int, np.ndarray] = {}
            for parts in _parts(batch.column(text)) if langs else ():
                seen = set().union(*(part for _, part in parts))
                new = [x for x in seen if x not in index]
                if len(index) + len(new) > CACHE:
                    index.clear()
                    new = list(seen)
                scores[len(index):len(index) + len(new)] = pieces.scores(new)
                index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                for at, part in parts:
                    total = scores[[index[x] for x in part]].sum(axis=0)
                    totals[at] = totals[at] + total if at in totals else total
            for at, total in totals.items():
                total = total - total.max()
                chance = np.exp(total)
                chance /= chance.sum()
                k = int(chance.argmax())
                best[at], score[at] = langs[k], float(chance[k])
            kept = [n for n in batch.schema.names if keep_text or n != text]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(best, pa.string()),
                                              pa.array(score, pa.float64())], [*kept, "_lang", "_score"])

    return run


def identify(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             keep_columns: bool = False, **how) -> DataFrame:
    """Language of every document's whole text.

    Models are fitted on the labelled rows that are not held out (see
    ``held_out`` and ``fit``). A text is cut into lower-cased runs of letters;
    its score under a language is the product over its words of the probability
    summed over all segmentations of the word into pieces of a fixed public
    vocabulary. The prediction is the language with the highest score (the
    first by name in a tie) and ``score`` its share among all languages.

    Returns ``doc_id, held_out, lang_pred, score``, one row per input row, or
    with ``keep_columns`` all columns of ``docs`` and ``_lang, _score``. A text
    that is null or has no letter, and any text when no language was learned,
    gives ``und`` and 0. Language labels, sources and identifiers play no part
    in a prediction. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    langs, table = fit(docs.filter(~held_out(F.col(doc_id))), vocab_path, lang, text, doc_id, **how)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    if keep_columns:
        names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
        rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
        schema = StructType(list(rows.schema.fields)).add("_lang", "string").add("_score", "double")
        out = rows.mapInArrow(tidy(_predict(langs, shared, names[text], True)), schema)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()], "_lang", "_score")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    schema = rows.drop("text").schema.add("_lang", "string").add("_score", "double")
    return rows.mapInArrow(tidy(_predict(langs, shared, "text", False)), schema).select(
        "doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
