"""Open runs in long paragraphs: the same matches as trying every place anew, in linear time."""

import random
import time

from vitalgrid.llm.licenses import SENTENCES, Recogniser, Words


class Plain(Recogniser):
    """Tries every further place from every start."""

    def open_match(self, doc, at, node, version):
        if "" in node:
            return super().open_match(doc, at, node, version)
        last = next(p for p in [*doc.paragraphs, len(doc.words)] if p > at or p == len(doc.words))
        for start in range(at + 1, last):
            if doc.words[start] in node and (got := self.match(doc, start, node, version)):
                return got
        return None


def test_same_matches_as_trying_every_place():
    draw = random.Random(9)
    known = [s.replace("#", "2.0") for s in SENTENCES]
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 14)):
            words = draw.choice(known).split()
            words = [w if w != "@" else " ".join(draw.choices(["acme", "corp", "nor", "the", "names"], k=draw.randrange(1, 4)))
                     for w in words]
            if draw.random() < 0.3:
                words = words[:draw.randrange(1, len(words) + 1)]
            parts.append(" ".join(words) + draw.choice([".", ". ", "\n", "\n\n", ""]))
        text = draw.choice([" ", "\n", ""]).join(parts)
        assert Recogniser().sentences(text) == Plain().sentences(text)


def test_long_paragraphs_take_linear_time():
    known = Recogniser()

    def seconds(line, n):
        text = line * n
        start = time.process_time()
        known.sentences(text)
        return time.process_time() - start

    for line in ("neither the name of x. ", "neither the name of x nor. ", "neither the name of x nor the names of its y. "):
        seconds(line, 200)
        assert seconds(line, 40_000) < 12 * max(seconds(line, 8_000), 0.05)
    assert seconds("neither the name of x nor. ", 400_000) < 60  # 10 MB


def test_words_of_an_empty_text():
    assert Words("").words == [] and Recogniser().sentences("") == []
