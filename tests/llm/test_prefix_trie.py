import hashlib
import random
import re
import zlib

import pytest

from drivepulse.llm import prefix_trie


def trie_brute(rows, rebuild=True):
    """Every node of the trie from rows (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))

    def place(turn):
        t, r, x = turn
        return t is not None, t or 0, r, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()

    own = {c: [(r, x) for _, r, x in sorted(ts, key=place)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    nodes, children = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        todo, below = [p], []
        while todo:
            below.append(todo.pop())
            todo += children.get(below[-1], [])
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])),
                    sum(q not in children for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "odd") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth bigint, block string")


def conversations(seed=4):
    rnd = random.Random(seed)
    says = ["", "a b", "hello there", "x", None, "ab  c\td", "é ß"]
    rows = []
    for c in range(0, 130):
        if c % 7 == 3:
            continue
        if c % 20 == 0 and c % 40 == 0:  # bases that are missing or short
            continue
        n = rnd.choice([1, 1, 2, 3, 4, 5, 8, 9, 40]) if c % 20 else rnd.choice([1, 2, 6])
        for t in range(n):
            rows.append((c, t if rnd.random() < 0.9 else rnd.choice([None, 0]), rnd.choice(["user", "assistant", None]) if rnd.random() < 0.1 else ("user", "assistant")[t % 2],
                         rnd.choice(says[:2] if t < 9 else says)))
    rows += [r for r in rows if r[0] == 5] + [(None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("hot, bits", [(256, 10), (3, 1)])
def test_against_brute_force(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(prefix_trie, "HOT_NODES", hot)
    monkeypatch.setattr(prefix_trie, "SLICE_BITS", bits)
    rows = conversations()
    want = trie_brute(rows)
    got = [tuple(r) for r in prefix_trie.report(frame(spark, rows).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(w[1] for w in want) > 30 and any(w[3] > 5 and w[1] > 2 for w in want)


def test_conversations_as_they_are(spark):
    rows = conversations(9) + [(-7, 0, "user", "a b"), (-7, 1, "assistant", "x")]
    turns = prefix_trie.turn_rows(frame(spark, rows))
    got = [tuple(r) for r in prefix_trie.trie(turns, prefix_trie.members_of(turns)).collect()]
    assert sorted(got, key=str) == sorted(trie_brute(rows, rebuild=False), key=str)


def test_turnless_and_empty(spark):
    # Conversation 1 takes none or all of a base that is missing, and loses its own first turns.
    rows = [(c, 0, "user", "hi") for c in range(1, 19)]
    got = [tuple(r) for r in prefix_trie.report(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(trie_brute(rows), key=str) and len(got) == 2
    assert prefix_trie.report(frame(spark, rows).limit(0)).collect() == []
