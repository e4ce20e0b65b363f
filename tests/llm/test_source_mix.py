import math
import random
import re
from collections import Counter

import pytest

from drivepulse.llm import source_mix
from tests.llm.helpers import frame


def brute_targets(sizes: dict):
    """Targets by sharing again until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        found = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if found[s] > 2 * sizes[s]}
        if not over:
            return found | {s: 2.0 * sizes[s] for s in full}
        full |= over


def brute_rates(sizes: list, target: float):
    """Rates by bisection of the tilt."""
    low, high = -200.0, 200.0
    mean = sum(sizes) / len(sizes)

    def rate(size, tilt):
        z = max(-700.0, min(700.0, tilt * size / mean))
        return 2 / (1 + math.exp(-z))

    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(s * rate(s, middle) for s in sizes) < target else (low, middle)
    return {s: rate(s, low) for s in set(sizes)}


def rows(seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(900):
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "B", "~", "", None, "é", "z1"])
        n = rnd.choice([0, 1, 3, 3, 3, 20, 50, 200, rnd.randint(1, 900)])
        text = None if rnd.random() < 0.02 else " ".join(["w"] * n)
        out.append((i if rnd.random() < 0.95 else None, text, "en", source, 0, "odd", "odd"))
    return out + out[:40] + [(1000, "x y", "en", "twice", 0, "", "")] * 30


def checked(spark, docs, partitions=6):
    out = source_mix.mix(frame(spark, docs).repartition(partitions)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((d[0], d[3], words(d[1])) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += words(d[1])
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size
        assert 0 <= r.copies <= 2
    return out, want


def test_targets_and_copies(spark):
    docs = rows()
    out, want = checked(spark, docs)
    for source, target in want.items():
        mine = [r for r in out if r.source == source and r.size]
        if mine:
            # Whole copies miss by half of one of the smallest documents here.
            assert abs(sum(r.taken for r in mine) - target) <= max(2, 0.5 * min(r.size for r in mine))
        if mine and target < 2 * sum(r.size for r in mine):
            tilted = brute_rates([r.size for r in mine], target)
            # Sizes that many documents share take what the tilted rate says, but for the carried words.
            n = Counter(r.size for r in mine)
            for size, many in n.items():
                took = sum(r.copies for r in mine if r.size == size)
                assert abs(took - many * tilted[size]) <= 1 + 0.5 * max(s for s in n if s >= size) / size
    again, _ = checked(spark, list(reversed(docs)), 3)
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_slices_runs_and_blocks_agree(spark, monkeypatch):
    docs = rows(8)
    plain, _ = checked(spark, docs)
    monkeypatch.setattr(source_mix, "HOT_SIZES", 20)
    monkeypatch.setattr(source_mix, "MANY", 4)
    cut, want = checked(spark, docs)
    totals = lambda out: Counter((r.source, r.size, r.copies) for r in out)
    assert totals(cut) == totals(plain)
    monkeypatch.setattr(source_mix, "FIRST", 3)
    few, _ = checked(spark, docs)
    for source, target in want.items():
        mine = [r for r in few if r.source == source]
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)


def test_small_tables(spark):
    assert checked(spark, [(1, None, "en", "a", 0, "", "")])[0][0].taken == 0
    one = checked(spark, [(1, "a b c d", "en", None, 0, "", "")])[0]
    assert one[0].target == 6.0 and one[0].taken in (4, 8)
    assert source_mix.mix(frame(spark, [])).collect() == []
