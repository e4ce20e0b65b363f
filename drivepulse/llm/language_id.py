"""Language identification of mixed text: scripts, per-word scores and a Viterbi path.

Words are runs of letters, cut where the script changes. Every word has a score for each language: the log-likelihood of its
character n-grams under naive Bayes, spread evenly between the languages so that unknown n-grams say
nothing. The script of a word (a code range) leaves only languages that were learned with this
script. Over the words of a text the Viterbi algorithm then chooses the languages with the highest
total score, less a penalty for every switch; equal neighbours form the labelled spans.

The model is fitted on about ``SAMPLE_ROWS`` rows of each language (those whose hashed id falls below
the share that this number has of the language; all rows, if there are fewer), n-grams hashed to
``SLOTS`` slots: its size is that number times the languages, of which there may be any number. Scoring
reads every word of every text.

Text that is null, empty or without letters has no spans and the language ``und`` with score 0.
The language of a text is the one with most letters in its spans (ties: alphabetical order); its score is its
share of the letters. With no training rows every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivepulse.llm.common import mix, run_sums, slices, texts_of, training_row
from drivepulse.session import bounded_batches

SAMPLE_ROWS = 2_000
SLOTS = 1 << 18
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
# Bytes of text that are labelled together.
STEP_BYTES = 6 << 20
# Different words whose n-grams are held at once.
WORD_STEP = 10_000
UNKNOWN = "und"
LETTERS = r"[^\W\d_]+"
# First code points of script ranges and their names, in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([code for code, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def script_of(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FROM, codes, "right") - 1]


def _alphabets() -> re.Pattern:
    """Runs of one script; letters of no named script belong to the run that they stand in or before."""
    ends = [code for code, _ in SCRIPTS[1:]] + [0x110000]

    def ranges(names: tuple[str, ...]) -> str:
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for (a, kind), b in zip(SCRIPTS, ends, strict=True) if kind in names)

    free = ranges(("other",))
    runs = [f"[{free}]*+[{ranges((name,))}][{ranges((name, 'other'))}]*+" for name in SCRIPT_NAMES if name != "other"]
    return re.compile("|".join([*runs, f"[{free}]+"]))


_LETTERS, _ALPHABETS = re.compile(LETTERS), _alphabets()


def words_of(text: str) -> list[str]:
    """Runs of letters of one script."""
    found = _LETTERS.findall(text)
    if text.isascii():
        return found
    return [part for word in found for part in ((word,) if word.isascii() else _ALPHABETS.findall(word))]


def places(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of every word of ``words_of``."""
    for word in _LETTERS.finditer(text):
        for part in _ALPHABETS.finditer(word[0]):
            yield word.start() + part.start(), word.start() + part.end()


def gram_slots(words: list[str], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of every word (with a boundary sign at both ends) and offsets of the words into them."""
    text = "\n".join(words)
    codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le"), np.uint32).astype(np.uint64)
    breaks = np.flatnonzero(codes == 10)
    before = np.cumsum(codes == 10)
    grams, owner = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = value[: len(codes) - n + 1] * np.uint64(0x10001F) + codes[n - 1 :]
        if n in ORDERS:
            # An n-gram stays in its word: at most its first and its last sign are boundaries.
            begin = np.arange(len(value))
            inner = before[begin + n - 1] - before[begin]
            ends = codes[begin + n - 1] == 10
            fits = ((inner == 0) | ((inner == 1) & ends)) & ((n > 1) | ~ends)
            begin = begin[fits]
            grams.append(mix(value[begin] + np.uint64(n << 58)) % np.uint64(slots))
            owner.append(before[begin] - 1)
    slot, word = np.concatenate(grams).astype(np.int64), np.concatenate(owner)
    order = np.argsort(word, kind="stable")
    return slot[order], np.searchsorted(word[order], np.arange(len(breaks)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slot x language, float32
    scripts: np.ndarray  # script x language, bool


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` training rows of each language (all, if fewer): those whose hashed id is below its share."""
    usable = docs.filter(training_row() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().withColumnsRenamed({"lang": "__lang", "count": "__n"})
    share = F.least(F.lit(1.0), rows / F.col("__n")) * (1 << 20)
    # One row per language, far less than the model itself, which every task gets.
    chosen = usable.join(F.broadcast(sizes), usable.lang == sizes["__lang"]).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    return chosen.select("lang", "text")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, slots: int = SLOTS) -> Model:
    """Naive Bayes weights from the sample; the driver receives at most ``slots`` rows per language."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang in set(batch.column(0).to_pylist()):
                seen, scripts = np.zeros(slots, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text.lower()) if k == lang else []
                    for i in range(0, len(words), WORD_STEP):
                        part = words[i : i + WORD_STEP]
                        np.add.at(seen, gram_slots(part, slots)[0], 1)
                        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
                        scripts += np.bincount(script_of(codes), minlength=len(scripts))
                slot, script = np.flatnonzero(seen), np.flatnonzero(scripts)
                if len(slot):
                    # Scripts count as slots below 0.
                    columns = [pa.array([lang] * (len(slot) + len(script))), pa.array(np.concatenate([slot, -1 - script])), pa.array(np.concatenate([seen[slot], scripts[script]]))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "slot", "n"])

    counted = sample(docs, rows).mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = found.column("lang").unique().to_pylist()
    languages = sorted(names)
    column = np.array([languages.index(x) for x in found.column("lang").to_pylist()], int)
    slot, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros((slots, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)), bool)
    if languages:
        grams = slot >= 0
        counts[slot[grams], column[grams]] = n[grams]
        letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
        letters[-1 - slot[~grams], column[~grams]] = n[~grams]
        # A script belongs to a language that writes a hundredth of its letters with it.
        scripts = letters >= 0.01 * letters.sum(0)
    smooth = 0.5
    logs = np.log((counts + smooth) / (counts.sum(0) + smooth * slots)) if languages else counts
    weights = (logs - logs.mean(1, keepdims=True)) if languages else logs
    # A slot that no language has seen says nothing.
    weights[counts.sum(1) == 0] = 0
    return Model(languages, weights.astype(np.float32), scripts)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Score of every word for every language; languages without the word's script fall out."""
    slot, at = gram_slots(words, len(model.weights))
    sums = np.stack([run_sums(model.weights[slot, k].astype(np.float64), at) for k in range(len(model.languages))], 1)
    first = np.frombuffer("".join(w[0] for w in words).encode("utf-32-le"), np.uint32)
    allowed = model.scripts[script_of(first)]
    return np.where(allowed | ~allowed.any(1, keepdims=True), sums, -1e6)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word of many texts at once; one step per word position of the longest text."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = offsets[:-1][order], sizes[order]
    total, kinds = scores.shape
    stay = np.zeros(total, np.uint64) if kinds <= 64 else None
    came = np.zeros((total, kinds), bool) if stay is None else None
    leader = np.zeros(total, np.int32)
    best = np.zeros((len(order), kinds))
    scores = np.ascontiguousarray(scores)
    bit = (np.uint64(1) << np.arange(min(kinds, 64), dtype=np.uint64))
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")
    for t in range(longest):
        n = live[t]
        at = start[:n] + t
        row = best[:n]
        if t:
            top = row.argmax(1)
            leader[at] = top
            limit = row[np.arange(n), top][:, None] - penalty
            kept = row >= limit
            if stay is None:
                came[at] = kept
            else:
                stay[at] = (kept * bit).sum(1, dtype=np.uint64)
            row = np.maximum(row, limit)
        best[:n] = row + scores[at]
    label = np.zeros(total, np.int32)
    state = best.argmax(1) if len(order) else np.zeros(0, int)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        now = state[:n]
        label[at] = now
        if t:
            kept = came[at, now] if stay is None else (stay[at] >> now.astype(np.uint64)) & np.uint64(1) > 0
            state[:n] = np.where(kept, now, leader[at])
    return label


SPAN = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("letters", pa.int32())])


def judge(texts: list[str | None], model: Model, penalty: float = PENALTY, spans: bool = False) -> tuple[list, np.ndarray, list]:
    """Language, score and (on request) spans of every text."""
    kinds = len(model.languages)
    known: dict[str, int] = {}
    ids, sizes = [np.zeros(0, np.int32)], []
    for text in texts:
        words = words_of((text or "").lower())
        sizes.append(len(words))
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
    flat = np.concatenate(ids)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    path, weight = np.zeros(len(flat), np.int32), np.zeros((len(texts), max(kinds, 1)), np.int64)
    if kinds and known:
        lengths = np.array([len(w) for w in known], np.int64)
        # Different words are scored some at a time; only their scores are kept.
        words = list(known)
        parts = [word_scores(words[i : i + WORD_STEP], model).astype(np.float32) for i in range(0, len(words), WORD_STEP)]
        scores = np.concatenate(parts)
        path = viterbi(scores[flat], offsets, penalty)
        weight = np.stack([run_sums(np.where(path == k, lengths[flat], 0), offsets) for k in range(kinds)], 1)
    total = weight.sum(1)
    best = weight.argmax(1)
    lang = [model.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), total.tolist(), strict=True)]
    score = weight[np.arange(len(texts)), best] / np.maximum(total, 1)
    found = []
    if spans:
        found = [_spans(t or "", path[a:b], model.languages) if kinds else [] for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return lang, score, found


def label(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """Rows ``doc_id, lang_pred, score`` and, on request, ``spans`` (in code points) of every whole text."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double" + (", spans array<struct<lang:string,start:int,end:int,letters:int>>" if spans else "")
    names = ["doc_id", "lang_pred", "score", "spans"][: 4 if spans else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=STEP_BYTES):
            lang, score, found = judge(batch.column(1).to_pylist(), sent.value, penalty, spans)
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(SPAN)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts_of(docs).mapInArrow(run, schema)


def keep_languages(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all columns, whose text has a language, however many others share it."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=STEP_BYTES):
            lang, _, _ = judge(batch.column(at).to_pylist(), sent.value)
            yield batch.filter(pa.array([k != UNKNOWN for k in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _spans(text: str, path: np.ndarray, languages: list[str]) -> list[dict]:
    """Maximal runs of words of one language.

    Places come from the text as it is, so lower-casing that changes its length falls back to the lower-cased text.
    """
    low = text.lower()
    found: list[dict] = []
    for (a, b), k in zip(places(text if len(low) == len(text) else low), path.tolist(), strict=False):
        if found and found[-1]["lang"] == languages[k]:
            found[-1]["end"] = b
            found[-1]["letters"] += b - a
        else:
            found.append({"lang": languages[k], "start": a, "end": b, "letters": b - a})
    return found
