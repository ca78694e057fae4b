"""Licence recognition: known sentences, and ordered rules over their identifiers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences (normalised form) and their identifiers. A "#" stands for a version number and
# becomes part of the identifier; "@" stands for any run of words.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "this software is released under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "licensed under the apache license version #": "ApacheRef",
    "licensed under the apache license version # the license": "ApacheRef",
    "this project is licensed under the apache license version # the license": "ApacheRef",
    "this project is licensed under the apache license version #": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at @": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
    "an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version #": "GPLref",
    "this program is licensed under the gnu general public license version #": "GPLref",
    "licensed under the gnu general public license version #": "GPLref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version # of the license or at your option any later "
    "version": "GPLgrantOrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license version # as published by the free software foundation": "GPLgrant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "GPLnowarranty",
    "see the gnu general public license for more details": "GPLsee",
    "licensed under the gnu lesser general public license version #": "LGPLref",
    "licensed under the gnu affero general public license version #": "AGPLref",
    "licensed under the mozilla public license version #": "MPLref",
    "this source code form is subject to the terms of the mozilla public license v #": "MPLref",
    "licensed under cc by #": "CCBYref",
    "licensed under cc by sa #": "CCBYSAref",
    "licensed under cc by nc #": "CCBYNCref",
    "licensed under cc by nd #": "CCBYNDref",
    "licensed under cc by nc sa #": "CCBYNCSAref",
    "licensed under cc by nc nd #": "CCBYNCNDref",
    "this work is licensed under a creative commons attribution # international license": "CCBYref",
    "this work is licensed under a creative commons attribution sharealike # international license": "CCBYSAref",
    "this work is licensed under a creative commons attribution noncommercial # international license": "CCBYNCref",
    "this work is dedicated to the public domain": "PublicDomain",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of @ nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission": "BSDendorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed": "BSDasis",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "all rights reserved": "AllRights",
}
# Licence rules, tried in this order at each place; "?" marks an identifier that may be missing. The
# copyright line of BSD headers ends in "All rights reserved".
RULES = [
    ("BSD-3-Clause", ["AllRights?", "BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis?"]),
    ("BSD-2-Clause", ["AllRights?", "BSDgrant", "BSDsource", "BSDbinary", "BSDasis?"]),
    ("MIT", ["MITref?", "MITgrant", "MITnotice?", "MITasis?"]),
    ("GPL-#-or-later", ["GPLgrantOrLater-#", "GPLnowarranty?", "GPLsee?"]),
    ("GPL-#-only", ["GPLgrant-#", "GPLnowarranty?", "GPLsee?"]),
    ("Apache-#", ["ApacheRef-#", "ApacheUse?", "ApacheCopy?", "ApacheAsis?", "ApacheSee?"]),
    ("GPL-#", ["GPLref-#"]),
    ("LGPL-#", ["LGPLref-#"]),
    ("AGPL-#", ["AGPLref-#"]),
    ("MPL-#", ["MPLref-#"]),
    ("CC-BY-NC-SA-#", ["CCBYNCSAref-#"]),
    ("CC-BY-NC-ND-#", ["CCBYNCNDref-#"]),
    ("CC-BY-NC-#", ["CCBYNCref-#"]),
    ("CC-BY-ND-#", ["CCBYNDref-#"]),
    ("CC-BY-SA-#", ["CCBYSAref-#"]),
    ("CC-BY-#", ["CCBYref-#"]),
    ("ISC", ["ISCgrant", "MITasis?"]),
    ("MIT", ["MITref"]),
    ("Public-Domain", ["PublicDomain"]),
    ("Proprietary", ["AllRights"]),
]
#: A text is looked at only if it holds one of these, which every known sentence does. Single words, since line ends
#: and comment marks may stand between two.
CUES = ("license", "licence", "licensed", "permission", "copyright", "redistribut", "warrant", "public", "rights",
        "apache", "gnu", "neither")

#: Places where a known sentence may begin or end; it may also run over them.
_CUT = re.compile(r"(?<=[.!?;:])\s+|[\r\n]+|\*\s+|(?<!:)//+|#+\s")
_PARAGRAPH = re.compile(r"\n\s*\n")
_URL = re.compile(r"https?://\S+")
_VERSION = re.compile(r"\d+(?:\.\d+)*")
_WORD = re.compile(r"[a-z0-9.]+")


def words_of(piece: str) -> list[str]:
    """Lower-cased words and version numbers; everything else goes."""
    out = []
    for word in _WORD.findall(piece.lower()):
        word = word.strip(".")
        if "." in word and not _VERSION.fullmatch(word):
            out += [x for x in word.split(".") if x]
        elif word:
            out.append(word)
    return out


class Words:
    """The words of a text, the places between them where it may be cut into
    sentences (line ends, sentence marks, comment marks, ends of addresses) and
    the place where the paragraph of each cut ends."""

    def __init__(self, text: str):
        self.words: list[str] = []
        self.cuts: list[int] = []  # word numbers, rising; the last is the number of words
        self.paragraphs: list[int] = []
        for paragraph in _PARAGRAPH.split(_URL.sub(lambda m: m[0] + "\n", text)):
            for piece in _CUT.split(paragraph):
                got = words_of(piece)
                if got:
                    self.cuts.append(len(self.words))
                    self.words += got
            self.paragraphs.append(len(self.words))
        self.cuts.append(len(self.words))
        self.ends = set(self.cuts)
        self.tried: dict[int, tuple[int, list[int]]] = {}  # open node: places tried, those from which it goes on


class Recogniser:
    """Texts -> identifiers of known sentences, and identifier sequences -> licences."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None):
        self.tree: dict = {}  # word -> the words that may follow; "" -> identifier of the sentence that ends here
        for known, name in (sentences or SENTENCES).items():
            node = self.tree
            for word in known.split():
                node = node.setdefault(word, {})
            node[""] = name
        self.rules = rules or RULES

    def match(self, doc: Words, at: int, node: dict, version: str = "") -> tuple[int, str] | None:
        """(end, identifier) of the longest known sentence whose words go on from
        word ``at`` and that ends at a cut; its version number follows after a hyphen."""
        best = None
        while True:
            if "" in node and at in doc.ends:
                best = at, node[""] + (f"-{version}" if version else "")
            if "@" in node:
                best = self.open_match(doc, at, node["@"], version) or best
            word = doc.words[at] if at < len(doc.words) else ""
            if word in node and word:
                node = node[word]
            elif "#" in node and _VERSION.fullmatch(word):
                node, version = node["#"], word
            else:
                return best
            at += 1

    def open_match(self, doc: Words, at: int, node: dict, version: str) -> tuple[int, str] | None:
        """As ``match``, after a run of one word or more: up to the next cut if
        the known sentence ends with the run, else up to its further words in the paragraph."""
        if "" in node:
            end = bisect_right(doc.cuts, at)
            return (doc.cuts[end], node[""] + (f"-{version}" if version else "")) if end < len(doc.cuts) else None
        last = doc.paragraphs[min(bisect_right(doc.paragraphs, at), len(doc.paragraphs) - 1)]
        # every place is tried once for a node, whatever place the run began at
        tried, hits = doc.tried.get(id(node), (0, []))
        known = bisect_right(hits, at)
        if known == len(hits):
            for start in range(tried, last):
                tried = start + 1
                if doc.words[start] in node and self.match(doc, start, node, version):
                    hits.append(start)
                    if start > at:
                        break
            doc.tried[id(node)] = tried, hits
        return self.match(doc, hits[known], node, version) if known < len(hits) and hits[known] < last else None

    def sentences(self, text: str) -> list[str]:
        """Identifiers of the known sentences of a text, in order. A sentence
        begins and ends at a cut and may run over others, so it may stand in
        several lines, hold sentence marks, or fill one line without any."""
        low = text.lower()
        if not any(c in low for c in CUES):
            return []
        doc, found, free = Words(text), [], 0
        for at in doc.cuts[:-1]:
            if at >= free and doc.words[at] in self.tree and (got := self.match(doc, at, self.tree)):
                free = got[0]
                found.append(got[1])
        return found

    def licences(self, ids: list[str]) -> tuple[list[str], int]:
        """(licences in order, identifiers that no rule explains): at each place
        the first rule that matches there takes its identifiers."""
        out, left, i = [], 0, 0
        while i < len(ids):
            for name, wanted in self.rules:
                at, version, hit = i, "", True
                for want in wanted:
                    maybe, want = want.endswith("?"), want.rstrip("?")
                    got = ids[at] if at < len(ids) else ""
                    base, _, tail = got.rpartition("-")
                    if got == want or (want.endswith("-#") and base == want[:-2]):
                        version = tail if want.endswith("-#") else version
                        at += 1
                    elif not maybe:
                        hit = False
                        break
                if hit and at > i:
                    out.append(name.replace("#", version))
                    i = at
                    break
            else:
                left += 1
                i += 1
        return out, left


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Recogniser()
    for batch in batches:
        ids = [known.sentences(t.as_py() or "") for t in batch.column("text")]
        got = [known.licences(x) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([",".join(dict.fromkeys(g[0])) for g in got], pa.string()),
             pa.array([",".join(x) for x in ids], pa.string()), pa.array([len(x) for x in ids], pa.int32()),
             pa.array([g[1] for g in got], pa.int32())],
            ["doc_id", "licenses", "sentence_ids", "n_sentences", "n_unmatched"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences named in every document's whole text.

    Known licence sentences are looked up word by word from every place where
    a sentence may begin (after sentence marks, line ends and comment marks) to
    every place where one may end, whatever marks and line ends lie between.
    The identifiers found, in their order, are matched against ordered rules.

    Returns ``doc_id, licenses`` (comma-separated, in order of first place,
    empty if none), ``sentence_ids`` (all identifiers in order), ``n_sentences``
    and ``n_unmatched`` (identifiers that no rule explains), one row per input
    row. Null and empty texts have none; repeated rows are judged alike. An
    empty table gives an empty result; other columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = (rows.select("doc_id").schema.add("licenses", "string").add("sentence_ids", "string")
            .add("n_sentences", "integer").add("n_unmatched", "integer"))
    return rows.mapInArrow(_scan, kind)
