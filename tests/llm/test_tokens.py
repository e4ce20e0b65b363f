import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from drivepulse.llm import byte_bpe, token_files
from drivepulse.llm.common import utf8_parts
from drivepulse.session import shared_dir
from tests.llm.helpers import DOCS, bag, corpus, frame

WORD_FILE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
SIGNS = st.text(st.sampled_from("aAzé É×÷ß'sre<|>\n\x1c\x85 12½漢🙂_ĀſİΣ́.,"), max_size=30)


def words_brute(rows):
    tok, start, out = Tokenizer.from_file(WORD_FILE), 0, []
    for doc, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark):
    rows = [*corpus(), (None, "a null id", None, None, None, None, None)]
    assert bag(token_files.round_trip(frame(spark, rows), WORD_FILE).collect()) == bag(words_brute(rows))


def test_token_files_of_nothing(spark):
    assert token_files.round_trip(spark.createDataFrame([], DOCS), WORD_FILE).collect() == []


def test_any_position_is_read_in_place(spark):
    path = shared_dir(spark, "tokens")
    docs = frame(spark)
    token_files.write(docs, path, WORD_FILE, buckets=3)
    flat = {}
    for r in token_files.documents(spark, path).collect():
        flat |= dict(enumerate(np.frombuffer(r.ids, "<u4").tolist(), r.start))
    wanted = spark.range(len(flat)).withColumnRenamed("id", "position")
    assert {r.position: r.token for r in token_files.tokens_at(spark, path, wanted).collect()} == flat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_levels(ids):
    levels = token_files.Levels(token_files.pack(np.array(ids, np.uint32)))
    assert levels.all().tolist() == ids
    assert [levels.at(i) for i in range(0, len(ids), 7)] == ids[::7]


@settings(max_examples=200, deadline=None)
@given(st.lists(SIGNS, max_size=4))
def test_word_encoder(texts):
    tool = token_files.word_encoder(WORD_FILE)
    ids, at = tool.encode(*utf8_parts(pa.array(texts, pa.string())))
    want = [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def own_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = own_encoding()


@settings(max_examples=200, deadline=None)
@given(SIGNS | st.text(max_size=40))
def test_codec(text):
    tool = byte_bpe.codec(RANKS, P.PATTERN)
    ids = tool.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ENCODING.encode_ordinary(text)
    assert tool.decode(ids) == text.encode()


def test_every_token_alone():
    tool = byte_bpe.codec(RANKS, P.PATTERN)
    words = [t.decode() for t in tool.tokens if t.isascii() and t.isalpha()]
    assert [np.frombuffer(tool.encode(w), "<u4").tolist() for w in words] == [ENCODING.encode_ordinary(w) for w in words]


def test_byte_bpe(spark):
    rows = corpus()
    want = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        ids = np.array(ENCODING.encode_ordinary(text or ""), "<u4")
        want.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()))
    assert bag(byte_bpe.digests(frame(spark), RANKS, P.PATTERN).collect()) == bag(want)
    encoded = byte_bpe.encode(frame(spark), RANKS, P.PATTERN)
    assert bag(byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()) == bag((r[0], r[1] or "") for r in rows)
    assert byte_bpe.digests(spark.createDataFrame([], DOCS), RANKS, P.PATTERN).collect() == []


def test_long_text_is_read_in_runs():
    tool = byte_bpe.codec(RANKS, P.PATTERN)
    text = "an other word, " * 200_000
    assert np.frombuffer(tool.encode(text), "<u4").tolist() == ENCODING.encode_ordinary(text)


def test_payloads_are_read_back_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "doc_id long, text string")
    token_files.write(docs, path, P.path("word_bpe_49k.json"), buckets=3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_files.segments(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
