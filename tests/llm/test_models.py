import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivepulse.llm import chat_format, language_id, top_k, toxicity
from tests.llm.helpers import DOCS, bag, frame

SYLLABLES = {"en": "the ing tion er and ou th sh".split(), "de": "der ung ein sch keit ü ß lich".split(), "ru": "при ова ний сто ра го".split()}


def words(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def tongues(n=90):
    rnd = random.Random(3)
    return [(i, words(rnd, lang, rnd.randint(3, 60)), lang, "s", 0, "odd", "odd") for i, lang in enumerate(rnd.choice(list(SYLLABLES)) for _ in range(n))]


def test_language_id(spark):
    rnd = random.Random(4)
    rows = tongues()
    docs = frame(spark, rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.label(docs, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows]
    assert sum(right) >= 0.97 * len(right)
    mixed = words(rnd, "en", 12) + ". " + words(rnd, "ru", 20) + " " + words(rnd, "en", 3)
    odd = frame(spark, [(1, mixed, *[None] * 5), (2, None, *[None] * 5), (3, " 12 !!", *[None] * 5), (4, "", *[None] * 5), (1, mixed, *[None] * 5)])
    found = language_id.label(odd, model).collect()
    assert [s.lang for s in found[0].spans] == ["en", "ru", "en"] and found[0].spans[0].start == 0
    assert found[0] == found[4] and found[0].lang_pred == "ru" and 0 < found[0].score < 1
    assert [(r.lang_pred, r.score) for r in found[1:4]] == [("und", 0.0)] * 3
    assert {r.doc_id for r in language_id.keep_languages(odd, model).collect()} == {1}
    assert language_id.keep_languages(odd, model).columns == odd.columns


def test_balanced_documents_stay(spark):
    rnd = random.Random(14)
    model = language_id.fit(frame(spark, tongues()))
    parts = {k: words(rnd, k, 200)[:400].rsplit(" ", 1)[0] for k in SYLLABLES}
    two = " ".join([words(rnd, "en", 60)[:240], words(rnd, "ru", 60)[:235], words(rnd, "de", 8)])
    docs = frame(spark, [(i, t, *[None] * 5) for i, t in enumerate([" ".join(parts.values()), two, "12 34", None])])
    found = {r.doc_id: r for r in language_id.label(docs, model).collect()}
    assert found[0].score < 0.4 and found[1].score < 0.5
    assert sorted(r.doc_id for r in language_id.keep_languages(docs, model).collect()) == [0, 1]


def test_language_id_without_training_rows(spark):
    docs = frame(spark, [(1, "some words", *[None] * 5)])
    assert [r.lang_pred for r in language_id.label(docs, language_id.fit(docs)).collect()] == ["und"]
    empty = spark.createDataFrame([], DOCS)
    assert language_id.label(empty, language_id.fit(empty)).collect() == []


def test_any_number_of_languages(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i // 3) + rnd.randrange(40)) * 2 for _ in range(20)), f"l{i // 3:03}", *[None] * 4) for i in range(900)]
    docs = frame(spark, rows)
    model = language_id.fit(docs, slots=1 << 12)
    assert len(model.languages) > 256
    found = {r.doc_id: r.lang_pred for r in language_id.label(docs.filter("doc_id % 50 = 0"), model).collect()}
    assert sum(found[i] == f"l{i // 3:03}" for i in found) >= 0.9 * len(found)


def test_words_end_where_the_script_changes(spark):
    text = "abcдом日本かな end ñé"
    want = ["abc", "дом", "日本", "かな", "end", "ñé"]
    assert language_id.words_of(text) == want == [text[a:b] for a, b in language_id.places(text)]
    assert language_id.words_of("ﬁnd ªb") == ["ﬁnd", "ªb"]
    rnd = random.Random(7)
    model = language_id.fit(frame(spark, tongues()))
    mixed = words(rnd, "en", 6).replace(" ", "") * 3 + words(rnd, "ru", 6).replace(" ", "") * 3
    row = language_id.label(frame(spark, [(1, mixed, *[None] * 5)]), model).first()
    assert [s.lang for s in row.spans] == ["en", "ru"] and row.spans[0].end == row.spans[1].start


def test_viterbi_against_all_paths():
    from itertools import product

    rnd = np.random.default_rng(1)
    scores = rnd.normal(size=(7, 3)) * 4
    offsets = np.array([0, 4, 4, 7])
    path = language_id.viterbi(scores, offsets, 2.5)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        def worth(p):
            return sum(scores[a + i, k] for i, k in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))

        assert np.isclose(worth(path[a:b].tolist()), max(map(worth, product(range(3), repeat=int(b - a)))))


def test_toxicity(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        toxic = int(rnd.random() < 0.3)
        text = words(rnd, "en", rnd.randint(8, 60)).split()
        for _ in range(toxic * rnd.randint(2, 4)):
            text.insert(rnd.randrange(len(text)), rnd.choice(["vilegrub", "vilegrubs", "rotmuck", "rotmucker"]))
        rows.append((i, " ".join(text), *[None] * 5))
        if rnd.random() < 0.8:
            labels.append((i, None, toxic))
        rows[-1] = (*rows[-1][:6], str(toxic))
    labels += [labels[0], (None, 1, 1), (10**6, 1, 1), (5, 1, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r.doc_id for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()]
    truth = {r[0]: int(r[6]) for r in rows}
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    odd = frame(spark, [(1, None, *[None] * 5), (2, "", *[None] * 5), (None, "12", *[None] * 5), (3, "rotmuck " * 5000, *[None] * 5)])
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(scores) == 4 and scores[1] == scores[2] == scores[None] and scores[3] > 0.7
    assert all(0 <= s <= 1 for s in scores.values())


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "some words", *[None] * 5)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs, none) is None
    assert [(r.score, r.predicted) for r in toxicity.score(docs, None).collect()] == [(0.0, 0)]


def test_ratios_belong_to_one_gram():
    """N-grams that agreed modulo any table size keep their own ratios; others fall back to their context, then to nothing."""
    gram = np.sort(toxicity.grams(["vile", "kind"])[0])
    model = toxicity.Model(gram, np.arange(1, len(gram) + 1, dtype=np.float32), np.array([5]), np.array([7.0]))
    for size in (1_048_573, 262_139, 4096):
        assert np.isnan(toxicity.look_up(model.grams, model.gram, gram + size)).all()
    assert toxicity.look_up(model.grams, model.gram, gram[::-1]).tolist() == list(range(len(gram), 0, -1))
    assert np.isnan(toxicity.look_up(np.zeros(0, np.int64), np.zeros(0), gram)).all()


def test_kneser_ney_sums_to_one():
    """The shared distribution and a class model, over all signs after a context, by hand for a few words."""
    gram, at = toxicity.grams(["ab", "abc"])
    assert at.tolist() == [0, 3, 7]
    assert [hex(int(g)) for g in gram[:3]] == ["0x1001001001061", "0x1001001061062", "0x1001061062002"]


# vectors

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score string, rank string")


def top_brute(rows, asked, k=10):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and ok(v)]
    out = []
    for q, x in whole:
        if q in asked:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q and len(x) == len(y) and x)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("n, block", [(300, 64), (7, 8192)])
def test_top_k(spark, monkeypatch, n, block):
    monkeypatch.setattr(top_k, "ROW_BLOCK", block)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 3)
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=8).tolist(), 0, "odd", "odd") for i in range(n)]
    rows += [(n + i, rows[3][1], 0, None, None) for i in range(12)]  # ties
    rows += [(1000, None, 0, None, None), (1001, [1.0, None] * 4, 0, None, None), (1002, [float("nan")] * 8, 0, None, None),
             (1003, [float("inf")] * 8, 0, None, None), (1004, [0.5], 0, None, None), (1005, [0.0] * 8, 0, None, None), (1006, [], 0, None, None)]
    asked = {0, 3, 5, 1000, 1001, 1003, 1004, 1005, 1006}
    docs = vectors(spark, rows)
    got = top_k.search(docs, docs.filter(F.col("vec_id").isin(*asked))).collect()
    assert bag(got) == bag(top_brute(rows, asked))
    assert top_k.search(docs, docs.limit(0)).collect() == []
    assert top_k.search(docs.limit(0), docs).collect() == []


@pytest.mark.parametrize("copies", [1, 5, 25])
def test_top_k_of_repeated_query_ids(spark, copies):
    rnd = np.random.default_rng(8)
    far = (3 * rnd.normal(size=8)).tolist()
    rows = [(100 + i, rnd.normal(size=8).tolist(), 0, "odd", "odd") for i in range(150)]
    rows += [(0, far, 0, "odd", "odd")] * copies + [(1, (-np.array(far)).tolist(), 0, "odd", "odd")] * copies
    docs = vectors(spark, rows).coalesce(1)
    got = top_k.search(docs, docs.filter("vec_id < 2")).collect()
    assert bag(got) == bag(set(top_brute(rows, {0, 1})))
    assert [r.rank for r in sorted(got)] == [*range(1, 11)] * 2


# chats

def test_chat_windows(spark):
    import hashlib

    rnd = random.Random(6)
    control = "</s>[INST] \\e \\ls> ok [/INST]<s>x</s>\\"
    rows = []
    for conv in range(6):
        turns = [("system", "be kind")] * (conv % 2) + [(rnd.choice(["user", "assistant"]), words(rnd, "en", rnd.choice([1, 40, 300, 900]))) for _ in range(25)]
        rows += [(conv, t, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(10, 0, "user", control), (10, 1, "assistant", control), (11, 0, None, None), (11, None, "assi\nstant</s>", ""), (12, 0, "assistant", None),
             (None, 1, "assistant", "x"), (10, 1, "assistant", control)]
    rnd.shuffle(rows)
    frame_ = spark.createDataFrame([(*r, "odd", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window string, pos int")
    windows = chat_format.format_windows(frame_)
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    wide = {}
    for r in windows.collect():
        wide.setdefault(r.conv_id, []).append(r)
        new = r.formatted.count("<s>") - r.n_repeated
        assert new > 0 and r.formatted.count("<s>") == r.formatted.count("</s>")
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        lines = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(w.formatted) for w in wide[conv])
    assert any(w.n_repeated > 1 for ws in wide.values() for w in ws)
    # Every further window of a conversation with a system turn repeats it first.
    assert all(w.formatted.startswith("<s>system\n") for c in (1, 3, 5) for w in wide[c])
    assert chat_format.digests(chat_format.format_windows(frame_.limit(0))).collect() == []


@pytest.mark.parametrize(("system", "repeated"), [(380, True), (381, False), (5000, False)])
def test_long_system_turns_keep_the_budget(spark, system, repeated):
    rows = [(1, 0, "system", "w " * system)] + [(1, t, ["user", "assistant"][t % 2], "a b c d e f") for t in range(1, 200)]
    windows = chat_format.format_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("window").collect()
    tokens = [chat_format.MARKS * w.formatted.count("</s>") + sum(len(t.split("\n", 1)[1].split()) for t in w.formatted.split("</s>")[:-1]) for w in windows]
    # Only the window of a system turn that is longer than the budget itself goes beyond it.
    assert all(n <= chat_format.BUDGET for w, n in zip(windows, tokens, strict=True) if system < 1000 or "<s>system" not in w.formatted)
    assert sum("<s>system" in w.formatted for w in windows) == (len(windows) if repeated else 1)
    assert len(windows) < 25
    assert sum(len(w.loss) for w in windows) == 100
