"""Small frames with awkward rows, and brute-force forms of the operators."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, part string"
WORDS = "the of and thing trash render onto heble tion shore anan wither lorem der die und nicht schon".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing", "er", ","]) + str(rnd.randint(0, 9) if rnd.random() < 0.2 else "") for _ in range(n))


def corpus(seed: int = 7, n: int = 40) -> list[tuple]:
    """Texts of all sizes with exact and near copies, shared passages, nulls, empties, repeats and extra columns."""
    rnd = random.Random(seed)
    passage = prose(rnd, 60)
    texts: list = [None, "", " \n\t ", "a", "ÉÀ ñ ß", "x" * 3000, "ab" * 400, "12 34 !!", prose(rnd, 6000)]
    while len(texts) < n:
        text = prose(rnd, rnd.choice([2, 5, 30, 80, 200]))
        texts.append(text)
        if rnd.random() < 0.4:
            texts.append(text)
        if rnd.random() < 0.4:
            words = text.split()
            words[rnd.randrange(len(words))] = "other"
            texts.append(" ".join(words))
        if rnd.random() < 0.3:
            texts.append(prose(rnd, 20) + " " + passage + " " + prose(rnd, 20))
    rows = [(i, t, rnd.choice(["en", "de", None]), "s", len(t or ""), "odd", "odd") for i, t in enumerate(texts)]
    return rows + rows[-3:]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def bag(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)
