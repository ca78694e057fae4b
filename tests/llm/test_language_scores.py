"""Words scored side by side have the scores of words scored one by one."""

import numpy as np

from vitalgrid.llm import language


def test_scores_side_by_side(monkeypatch):
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnop"
    pieces = {"".join(rng.choice(list("▁" + letters), size=rng.integers(1, 6))) for _ in range(2000)}
    pieces |= {*letters, "a" * language.MAX_PIECE} | {chr(0x4E00 + k) for k in range(300)} | {"一b", "▁"}
    table = {p: rng.random(3) ** 6 + 1e-8 for p in sorted(pieces)}
    usual = ["".join(rng.choice(list(letters + "zß"), size=rng.integers(1, 15))) for _ in range(3000)] + ["a" * 20]
    odd = ["zq" * 500, "一b", "".join(chr(0x4E00 + k) for k in range(299)), "𐐨a", "a" * 300]
    plain = {p: tuple(v.tolist()) for p, v in table.items()}
    want = np.array([language.word_score(w, plain, 3) for w in usual + odd])
    alone = []
    one = language.word_score
    monkeypatch.setattr(language, "word_score", lambda w, *rest: alone.append(w) or one(w, *rest))
    got = language.Pieces(table).scores(usual + odd)
    assert (got == want).all() and set(alone) <= set(odd)
    assert language.Pieces(table).scores([]).shape == (0, 3)
