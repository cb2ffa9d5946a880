"""Keyed permutations of a key's own domain: every key gets another key of the same form, no two the same one, without a table of keys.

Feistel rounds on a number split into two halves of nearly equal range: each round adds a keyed hash of one half to the other. Whole numbers
below ``size`` are halved by a divisor near its root; the product of the halves' ranges exceeds ``size`` by less than one of them, and a
number that lands there is permuted again until it is below ``size`` (cycle walking), which keeps the map one-to-one. Text keeps its
form: digits, small and capital letters are numbered within their own class, so the halves' ranges are products of 10 and 26; other
characters stay. A value hangs on nothing but the key, the seed and the scope: more keys change none, and a stream is mapped as a table is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.draw import div

ROUNDS = 6
# Letters and digits of a text that are permuted together; a longer text is a chain of such blocks.
BLOCK = 20
LARGEST = 10**17


def halves(size: int) -> tuple[int, int]:
    """Ranges of the two halves: their product is ``size`` or exceeds it by less than the first."""
    left = math.isqrt(size - 1) + 1 if size > 1 else 1
    return left, -(-size // left)


def walk_steps(size: int) -> int:
    """Steps after which a walk has ended: it meets each number beyond ``size`` once at most, and more than these steps has a chance below 2**-128."""
    left, right = halves(size)
    beyond = left * right - size
    return 0 if not beyond else min(beyond, math.ceil(128 / math.log2(left * right / beyond)))


def _hash(prefix: Column, i: Column, half: Column) -> Column:
    digest = F.md5(F.concat(prefix, i.cast("string"), F.lit("|"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _rounds(left: Column, right: Column, left_size: Column, right_size: Column, prefix: Column) -> Column:
    """The two halves, ``l`` and ``r``, after all rounds."""
    pair = lambda l, r: F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r"))
    step = lambda at, i: F.when(i % 2 == 0, pair((at["l"] + _hash(prefix, i, at["r"])) % left_size, at["r"])).otherwise(pair(at["l"], (at["r"] + _hash(prefix, i, at["l"])) % right_size))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(left, right), step)


def permuted(number: Column, size: int, seed: str, scope: str) -> Column:
    """Another number below ``size`` for each number from 0 to below it; null for null, an error for others."""
    if not 1 <= size <= LARGEST:
        raise ValueError(f"a domain has 1 to {LARGEST} numbers, not {size}")
    left, right = halves(size)
    prefix = F.lit(f"{seed}|{scope}|feistel|")

    def once(n: Column) -> Column:
        halved = _rounds(div(n, right), n % F.lit(right), F.lit(left), F.lit(right), prefix)
        return F.element_at(F.transform(F.array(halved), lambda x: x["l"] * F.lit(right) + x["r"]), 1)

    n = number.cast("bigint")
    first, steps = once(n), walk_steps(size)
    if steps:
        again = lambda at, _: F.when(at < size, at).otherwise(once(at))
        end = lambda at: F.when(at < size, at).otherwise(F.raise_error(F.lit("a walk did not end")).cast("bigint"))
        first = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, again, end)
    outside = F.raise_error(F.concat(F.lit(f"{scope}: a key outside of its {size} numbers: "), n.cast("string"))).cast("bigint")
    return F.when(n.between(0, size - 1), first).when(n.isNotNull(), outside)


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).otherwise(26).cast("bigint")


def _first(c: Column) -> Column:
    """Code of the first character of the class of c."""
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65)


def _ranked(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda n, c: n * _radix(c) + F.ascii(c) - _first(c))


def _size(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(1).cast("bigint"), lambda n, c: n * _radix(c))


def _unranked(number: Column, chars: Column) -> Column:
    """The text of a number, in the classes of the characters."""
    pair = lambda rest, out: F.struct(rest.cast("bigint").alias("rest"), out.alias("out"))
    step = lambda at, c: pair(F.call_function("div", at["rest"], _radix(c)), F.concat(F.chr(_first(c) + at["rest"] % _radix(c)), at["out"]))
    return F.aggregate(F.reverse(chars), pair(number, F.lit("")), step, lambda at: at["out"])


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted_text(text: Column, seed: str, scope: str) -> Column:
    """Another text of the same form: letters and digits permuted within their classes, all other characters kept."""
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    own = lambda c: c.rlike("^[0-9A-Za-z]$")
    movable = F.filter(chars, own)

    def block(all_of: Column, j: Column) -> Column:
        some = F.slice(all_of, j * BLOCK + 1, BLOCK)
        # The key of a block holds the text before it, so blocks form one map of the whole text.
        before = F.array_join(F.slice(all_of, F.lit(1), j * BLOCK), "")
        prefix = F.concat(F.lit(f"{seed}|{scope}|"), form, F.lit("|"), before, F.lit("|feistel|"))
        cut = F.ceil(F.size(some) / 2).cast("int")
        parts = F.struct(F.slice(some, F.lit(1), cut).alias("a"), F.slice(some, cut + 1, F.lit(BLOCK)).alias("b"))
        moved = lambda p: _let(_rounds(_ranked(p["a"]), _ranked(p["b"]), _size(p["a"]), _size(p["b"]), prefix), lambda x: F.concat(_unranked(x["l"], p["a"]), _unranked(x["r"], p["b"])))
        return _let(parts, moved)

    blocks = lambda all_of: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / BLOCK).cast("int")), lambda j: block(all_of, j)), "")
    # The new letters and digits take the places of the old ones, in order.
    pair = lambda k, out: F.struct(k.cast("int").alias("k"), out.alias("out"))
    filled = lambda new: F.aggregate(
        chars, pair(F.lit(1), F.lit("")), lambda at, c: F.when(own(c), pair(at["k"] + 1, F.concat(at["out"], F.substr(new, at["k"], F.lit(1))))).otherwise(pair(at["k"], F.concat(at["out"], c))), lambda at: at["out"]
    )
    whole = _let(movable, lambda all_of: F.when(F.size(all_of) > 0, _let(blocks(all_of), filled)).otherwise(text))
    return F.when(text.isNotNull(), whole)
