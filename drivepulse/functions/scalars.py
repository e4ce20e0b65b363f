"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, LABEL_IDS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    The optimizer may copy a column's definition into a lambda, where it would be
    recomputed for every element; a bound variable keeps it outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(value: Column, digits: int) -> Column:
    """Round half upwards in plain IEEE steps, so any SQL engine agrees bit for bit."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def hash_word(*parts: Column | str) -> Column:
    """First 32 bits of SHA-256 over the parts joined by ``|``, as a long."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def with_mix32(df: DataFrame, out: str, word: Column) -> DataFrame:
    """Integer mixing of a 32-bit word: cheap enough for one call per simulated draw.

    Each round is a column of its own; as one expression it would be written out
    many times over, since every round uses its input twice.
    """
    def fold(name: str) -> Column:
        return F.shiftright(name, 16).bitwiseXOR(F.col(name))

    mask, factor = F.lit(0xFFFFFFFF), F.lit(0x45D9F3B).cast("long")
    first = df.withColumn("_mix0", word.cast("long"))
    second = first.withColumn("_mix1", (fold("_mix0") * factor).bitwiseAND(mask))
    third = second.withColumn("_mix2", (fold("_mix1") * factor).bitwiseAND(mask))
    return third.withColumn(out, fold("_mix2")).drop("_mix0", "_mix1", "_mix2")


def hash_bucket(n: int, *parts: Column | str) -> Column:
    return hash_word(*parts) % F.lit(n)


def lookup(mapping: Mapping, key: Column, default=None) -> Column:
    """Dictionary lookup over a small literal map."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def pick(names: Sequence[str], index: Column) -> Column:
    """Name at a 0-based index, null outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def encode_label(name: Column, strict: bool = True) -> Column:
    """Class name to id, case-insensitive; unknown names fail unless ``strict`` is off."""
    code = lookup(LABEL_IDS, F.upper(name))
    if not strict:
        return code
    return F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown fault class: "), name))).otherwise(code)


def decode_label(code: Column) -> Column:
    return pick(CLASSES, code)


def softmax(logits: Column) -> Column:
    """Max-shifted softmax over an array column."""
    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda s: F.transform(exps, lambda v: v / s))

    return let(
        logits, lambda x: let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp(v - top)), shares))
    )


def argmax0(values: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - F.lit(1)


def argmax_name(names: Sequence[str], values: Column, default: str) -> Column:
    return F.coalesce(pick(names, argmax0(values)), F.lit(default))


def fit_length(values: Column, n: int) -> Column:
    """Zero-pad on the right or truncate so that the array has exactly ``n`` entries."""
    if n <= 0:
        raise ValueError(f"target length must be positive, got {n}")
    missing = F.greatest(F.lit(n) - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), missing)), 1, n)


def length_action(size: Column, n: int) -> Column:
    return F.when(size < n, F.lit("pad")).when(size > n, F.lit("truncate")).otherwise(F.lit("no_op"))


def renormalise(parts: Iterable[Column]) -> list[Column]:
    """Shares of the parts in their sum; a zero sum counts as one."""
    parts = list(parts)
    total = sum(parts[1:], parts[0])
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return [p / total for p in parts]


def ladder(value: Column, steps: Sequence[tuple[str, float, str]], last: str) -> Column:
    """Named bands: the first ``(operator, limit, name)`` that holds wins."""
    tests = {"<": lambda v, x: v < x, "<=": lambda v, x: v <= x, ">": lambda v, x: v > x, ">=": lambda v, x: v >= x}
    out = None
    for op, limit, name in steps:
        hit = tests[op](value, F.lit(limit))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.when(value.isNotNull(), out.otherwise(F.lit(last)))
