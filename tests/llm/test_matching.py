import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drivepulse.llm import decontaminate, ngram_join, secret_scan, suffix_dedup
from tests.llm.helpers import DOCS, bag, corpus, frame, prose

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets_brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ("assign", "access", "hex")
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


def test_secret_scanner_against_expressions():
    rnd = random.Random(1)
    parts = ["token", "=", ":", " ", "secret", "Password", "api_key", "apikey", "API_KEY", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN",
             "0123456789abcdef", "deadbeef" * 4, "é", "x", "abcdefgh", "=abcd", "passwd", "\n", "K", "ſ"]
    tool = secret_scan.scanner(secret_scan.RULES)
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        got = [(s["kind"], s["start"], s["end"]) for s in tool.scan(text.encode()) if s["kind"] in ("assign", "access", "hex")]
        assert got == secrets_brute(text), text


def test_secret_report_and_redaction(spark):
    texts = [None, "", "token = abcdefgh1", "é password: 'hunter2hunter2' " + "0f" * 20, "gh" + "p_" + "aZ" * 20, "token=abc"]
    docs = frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)] + [(2, texts[2], None, None, None, None, None)])
    got = {r.doc_id: r for r in secret_scan.report(docs).collect()}
    for i, text in enumerate(texts):
        base = secrets_brute(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
    assert got[4].spans == "hub:0:44"
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "[secret]" and clean[5] == "token=abc"
    assert clean[3] == "é [secret]' [secret]"
    assert secret_scan.redact(docs).columns == docs.columns
    assert secret_scan.report(spark.createDataFrame([], DOCS)).collect() == []


def test_long_hex_text_needs_little_memory():
    import tracemalloc

    tool = secret_scan.scanner(secret_scan.RULES)
    data = ("é " + "0123456789abcdef" * 60_000 + " token=abcdefgh12").encode()
    tracemalloc.start()
    found = tool.scan(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(s["kind"], s["start"], s["end"]) for s in found] == [("hex", 2, 960_002), ("assign", 960_003, 960_019)]
    assert peak < 3 * len(data)


def test_more_rules_than_bits_of_a_byte():
    rules = tuple(secret_scan.Rule(f"r{k}", f"{chr(97 + k)}[0-9]+") for k in range(20))
    tool = secret_scan.scanner(rules)
    text = "".join(f"é{chr(97 + k)}{k}" for k in range(20)) + "a77"
    got = [(s["kind"], s["start"], s["end"]) for s in tool.scan(text.encode())]
    assert got == sorted(((f"r{k}", m.start(), m.end()) for k in range(20) for m in re.finditer(f"{chr(97 + k)}[0-9]+", text)), key=lambda s: s[1])


def test_pem_blocks_are_covered_whole(spark):
    def block(kind, body, line="\n"):
        return f"-----BEGIN {kind}PRIVATE KEY-----{line}{body}{line}-----END {kind}PRIVATE KEY-----"

    rnd = random.Random(21)
    lines = ["".join(rnd.choices("ABCxyz019+/", k=64)) for _ in range(30)]
    plain, escaped = block("", "\n".join(lines) + "=="), block("EC ", "\\n".join(lines), "\\n")
    coded = block("RSA ", "Proc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-256-CBC,0A1B\r\n\r\n" + "\r\n".join(lines), "\r\n")
    open_ = "-----BEGIN PRIVATE KEY-----"
    texts = [f"é {plain} after", f"{coded}\nsome words between\n{escaped}", f"{open_} and no end", f"{open_}\n{plain}", plain.replace("END", "FIN")]
    docs = frame(spark, [(i, t, *[None] * 5) for i, t in enumerate(texts)])
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in secret_scan.find(docs).collect()}
    want = [[plain], [coded, escaped], [open_], [open_, plain], [open_]]
    assert found == {i: [("pem", x) for x in w] for i, w in enumerate(want)}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[0] == "é [secret] after" and clean[1] == "[secret]\nsome words between\n[secret]"
    assert clean[2] == "[secret] and no end" and clean[3] == "[secret]\n[secret]"


def test_minimal_automaton():
    moves, marks = secret_scan.determinise(["(ab|cb)+", "abcb"], False, False)
    rows = secret_scan.linked(moves, marks)

    def ends(text):
        row = rows[0]
        for b in text.encode():
            row = row[b]
        return row[256]

    assert [ends(t) for t in ("ab", "abcb", "abc", "", "cbabcb")] == [1, 3, 0, 0, 1]
    assert len(np.unique(np.column_stack([moves, marks]), axis=0)) == len(moves)


# decontamination

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= names
        found.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        best, where = 0, None
        for _, text in items:
            x = bench_words(text)
            for i in range(len(w)):
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    if n > best and n >= min(window, len(x)):
                        best, where = n, i
        # The first of equally long ones over all items.
        if best:
            runs = {tuple(x[j : j + best]) for _, text in items for x in [bench_words(text)] for j in range(len(x) - best + 1) if best >= min(window, len(x))}
            where = next(i for i in range(len(w)) if tuple(w[i : i + best]) in runs)
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w), best, where))
    return out


@pytest.mark.parametrize("block, turn, piece", [(1 << 20, 1 << 26, 1 << 19), (300, 1 << 26, 100), (300, 600, 100)])
def test_decontamination(spark, monkeypatch, block, turn, piece):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "ROUND_WORDS", turn)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    rnd = random.Random(5)
    rows = corpus()
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 1000)
    items = [(1, " ".join(long.split()[100:140]).upper()), (10, " ".join(long.split()[120:133])), (2, "heble tion"), (3, ""), (4, None),
             (5, prose(rnd, 30)), (10, "heble tion"), (7, rows[-1][1]), (None, "thing")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = contamination_brute(rows, items)
    assert bag(decontaminate.report(frame(spark), bench).collect()) == bag(want)
    kept = decontaminate.clean(frame(spark), bench)
    assert kept.columns == frame(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[5])
    empty = decontaminate.report(frame(spark), bench.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in empty) and len(empty) == len(rows)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_items_without_id_are_searched(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(15)
    secret, named, odd = (" ".join(f"{w}{i}{k}" for i, w in enumerate(prose(rnd, 20).split())) for k in "abc")
    texts = [f"x {secret} y", f"{secret} {named}", named, odd, "nothing of them"]
    rows = [(i, t, *[None] * 5) for i, t in enumerate(texts)]
    items = [(None, secret), (0, named), (None, odd), (None, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.items, r.contaminated) for r in decontaminate.occurrences(frame(spark, rows), bench).collect()}
    n = {t: len(bench_words(t)) for t in (secret, named, odd)}
    assert got == {0: (n[secret], [], True), 1: (n[secret] + n[named], [0], True), 2: (n[named], [0], True), 3: (n[odd], [], True), 4: (0, [], False)}
    # Hits as the brute force sees all items; names and counts as it sees those with an id.
    hits, names = (contamination_brute(rows, x) for x in (items, [i for i in items if i[0] is not None]))
    want = [(*h[:3], *k[3:5], *h[5:]) for h, k in zip(hits, names, strict=True)]
    assert bag(decontaminate.report(frame(spark, rows), bench).collect()) == bag(want)
    assert [r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()] == [4]
    found = {(r.item_id, r.doc_id, r.n_words) for r in decontaminate.longest_matches(frame(spark, rows), bench).collect() if not r.place}
    assert (0, 1, n[named]) in found and any(i is None for i, *_ in found)


def test_longest_matches(spark):
    rnd = random.Random(9)
    a, b = prose(rnd, 50), prose(rnd, 50)
    docs = frame(spark, [(4, f"x {a}", *[None] * 5), (2, f"{b} {' '.join(a.split()[:20])} y", *[None] * 5)])
    bench = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    got = {r.place: (r.n_words, r.doc_id, r.at) for r in decontaminate.longest_matches(docs, bench).collect()}
    n = len(bench_words(a))
    assert got == {i: (n - i, 4, 1 + i) for i in range(n - 12)}


def test_long_items_in_bounded_memory(spark):
    """An item of 20,000 words that a document repeats, and one word over and over in both."""
    rnd = random.Random(31)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20_000))
    same = "la " * 600
    docs = frame(spark, [(i, t, *[None] * 5) for i, t in enumerate([f"x y {text}", text[200:] + " z", f"x {same}", "x " * 3])])
    bench = spark.createDataFrame([(1, text), (2, "la " * 400)], "item_id bigint, text string")
    words = [len(bench_words(t)) for t in (text, text[200:])]
    got = {r.doc_id: (r.n_hit, r.items, r.longest, r.longest_at) for r in decontaminate.occurrences(docs, bench).collect()}
    cut = text[199] != " "
    assert got == {0: (words[0], [1], words[0], 2), 1: (words[1] - cut, [1], words[1] - cut, int(cut)), 2: (600, [2], 400, 1), 3: (0, [], 0, None)}
    found = {r.place: r for r in decontaminate.longest_matches(docs, bench).filter("item_id = 1 AND place < 100").collect()}
    assert (found[0].n_words, found[0].doc_id, found[0].at) == (words[0], 0, 2) and len(found) == 100


def test_suffix_array():
    rnd = np.random.default_rng(3)
    words = rnd.integers(1, 4, 300).astype(np.uint64)
    order = decontaminate.suffix_array(words, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: words[i:].tolist())


# n-gram join

def links_brute(rows, percent=75):
    sets = []
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    label = {doc: doc for doc, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return [(doc, len(s), find(doc)) for doc, s in sets]


def family(rnd, n, copies, changes):
    base = prose(rnd, n).split()
    for _ in range(copies):
        words = list(base)
        for _ in range(changes):
            words[rnd.randrange(n)] = f"w{rnd.randint(0, 10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("rare", [32, 2])
def test_ngram_join(spark, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rnd = random.Random(11)
    texts = [r[1] for r in corpus()]
    for n, copies, changes in ((60, 25, 2), (200, 12, 5), (12, 10, 1), (30, 12, 1)):
        texts += family(rnd, n, copies, changes)
    rows = [(i, t, *[None] * 5) for i, t in enumerate(texts)]
    got = ngram_join.report(frame(spark, rows)).collect()
    assert bag(got) == bag(links_brute(rows))


def test_ngram_join_of_odd_rows(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, a, *[None] * 5), (3, a, *[None] * 5), (3, b, *[None] * 5), (5, b, *[None] * 5), (5, b, *[None] * 5), (6, None, *[None] * 5)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(frame(spark, rows)).collect()}
    assert got == {(None, 3, None), (3, 3, 3), (3, 2, 3), (5, 2, 3), (6, 0, 6)}
    assert ngram_join.report(spark.createDataFrame([], DOCS)).collect() == []


def test_prefixes_are_sent_in_bounded_parts(monkeypatch):
    """What a task holds does not grow with its documents, and every token and set is sent."""
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 100)) for i in range(60)] + [(60, prose(rnd, 3000)), (61, ""), (61, "one")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    rule = ngram_join.Rule()
    longest = max(rule.missing(n) + int(rule.extension(n)) for n in (len(s) for s in ngram_join.token_sets(batch.column(1), rule)))
    whole = list(ngram_join.prefixes(iter([batch]), rule))
    monkeypatch.setattr(ngram_join, "SENT_TOKENS", 300)
    parts = list(ngram_join.prefixes(iter([batch, batch.slice(0, 0)]), rule))
    pairs = lambda found: [b for b in found if b.num_rows and b.column(2).null_count or not (b.column(3).to_numpy() <= 0).all()]
    assert len(pairs(whole)) == 1 and len(pairs(parts)) > 5
    assert all(b.num_rows <= max(300, longest) * 2 for b in parts)
    sets = lambda found: sorted(tuple(r.values()) for b in found for r in b.to_pylist() if r["n"] <= 0)
    assert sets(parts) == sets(whole) and len(sets(parts)) == len(rows)
    # A pair that is alone or shared: its key is the part where no other is named.
    tokens = lambda found: {(r["part"] if r["key"] is None else r["key"], r["doc"]) for b in found for r in b.to_pylist() if r["n"] > 0 and r["doc"] is not None}
    assert tokens(parts) == tokens(whole)


def test_ngram_join_in_small_parts(spark, monkeypatch):
    rows = corpus(9, 50)
    want = bag(links_brute(rows))
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text").coalesce(1)
    small = docs.mapInArrow(lambda batches: ngram_join.prefixes(batches, ngram_join.Rule()), ngram_join.KEYED)
    assert small.count()
    monkeypatch.setattr(ngram_join, "profile", _profile_in_parts)
    assert bag(ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()) == want


def _profile_in_parts(docs, rule):
    def run(batches):
        ngram_join.SENT_TOKENS = 200
        try:
            yield from ngram_join.prefixes(batches, rule)
        finally:
            ngram_join.SENT_TOKENS = 1 << 19

    return ngram_join.shared_pairs(ngram_join.texts_of(docs).filter("doc_id IS NOT NULL").mapInArrow(run, ngram_join.KEYED))


def test_packed_pairs_are_those_of_the_rows(spark, monkeypatch):
    """Few rows go through the shuffle, a task holds a bounded number of pairs, and the pairs are the same."""
    from drivepulse.llm import common

    rng = np.random.default_rng(4)
    for docs in (np.arange(300), rng.integers(-(2**62), 2**62, 300)):
        sent = [common.keyed_rows(rng.integers(-900, 900, 400), rng.choice(docs, 400)) for _ in range(6)]
        rows = pa.Table.from_batches(sent)
        plain = spark.createDataFrame([tuple(r.values()) for r in rows.to_pylist()], common.KEYED)
        want = bag(common.shared_pairs(plain).collect())
        packed = list(common.packed_parts(iter(sent)))
        assert sum(b.num_rows for b in packed) < rows.num_rows and all(b.num_rows <= common.PARTS for b in packed)
        found = spark.createDataFrame([tuple(r.values()) for r in pa.Table.from_batches(packed).to_pylist()], common.PACKED)
        assert bag(common.shared_packed(found).collect()) == want
        small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        monkeypatch.setattr(common, "HELD_PAIRS", 50)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert bag(common.shared_packed(found).collect()) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)


def test_profile_shuffles_packed_rows(spark):
    docs = spark.createDataFrame(corpus(9, 50), DOCS).select("doc_id", "text")
    plan = ngram_join.profile(docs, ngram_join.Rule())._jdf.queryExecution().executedPlan().toString()
    assert "keys#" in plan and "Sort [part#" in plan


def test_no_pair_is_lost_by_keys():
    rnd = np.random.default_rng(2)
    rule = ngram_join.Rule()
    for _ in range(300):
        n = int(rnd.integers(2, 120))
        x = rnd.choice(10**6, n, replace=False)
        lost = int(rnd.integers(0, n // 4 + 1))
        y = np.concatenate([x[lost:], rnd.integers(10**7, 10**8, int(rnd.integers(0, 4)))])
        inter = n - lost
        if 100 * inter < 75 * (n + len(y) - inter):
            continue
        df = {int(t): int(rnd.choice([2, 3, 100, 200])) for t in {*x.tolist(), *y.tolist()}}
        keys = [set(ngram_join.signatures(len(z), np.array([df[int(t)] for t in z]), np.asarray(z), rule)) for z in (x, y)]
        assert keys[0] & keys[1]


# repeated passages

def repeats_brute(rows):
    seen, out = set(), []
    unique = sorted({(r[0], (r[1] or "").encode()) for r in rows})
    for doc, data in unique:
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, data, (doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return [next(o[2] for o in out if o[0] == r[0] and o[1] == (r[1] or "").encode()) for r in rows]


@pytest.mark.parametrize("group, piece", [(2048, 1 << 20), (2, 700)])
def test_suffix_dedup(spark, monkeypatch, group, piece):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = corpus(n=60)
    rnd = random.Random(4)
    passage = prose(rnd, 40)
    rows += [(100 + i, f"{prose(rnd, 3)} {passage} {prose(rnd, 3)}", *[None] * 5) for i in range(12)]
    assert bag(suffix_dedup.report(frame(spark, rows)).collect()) == bag(repeats_brute(rows))


def test_suffix_dedup_of_odd_ids(spark):
    rnd = random.Random(2)
    a = "".join(rnd.choice("abcdefgh") for _ in range(150))
    docs = frame(spark, [(2, a, *[None] * 5), (1, a + "1", *[None] * 5), (None, a + "0", *[None] * 5), (1, "short", *[None] * 5), (1, "short", *[None] * 5)])
    got = bag((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.report(docs).collect())
    assert got == bag([(None, 151, 0), (1, 151, 150), (1, 5, 0), (1, 5, 0), (2, 150, 150)])
    assert suffix_dedup.report(spark.createDataFrame([], DOCS)).collect() == []


def test_longest_previous_factor():
    rnd = np.random.default_rng(6)
    data = rnd.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(len(data) - 100)
    order, common = suffix_dedup.sorted_starts(data, starts)
    got = suffix_dedup.longest_previous(order, common)
    raw = data.tobytes()

    def lcp(i, j):
        k = 0
        while k < 100 and raw[i + k] == raw[j + k]:
            k += 1
        return k

    assert got.tolist() == [max((lcp(i, j) for j in range(i)), default=0) for i in starts.tolist()]


def test_columns_of_kept_rows(spark):
    assert frame(spark).filter(F.col("doc_id") < 0).columns == [c.split()[0] for c in DOCS.split(", ")]
