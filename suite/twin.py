"""DuckDB spelling of draws and value domains, written from the definitions and not from the Spark code."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from veilspark.functions import pools as p

SEED = "42"
PACK_LIMIT = 10**15


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def key(*columns: str) -> str:
    parts = [f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns]
    return parts[0] if len(parts) == 1 else f"concat_ws('|', {', '.join(parts)})"


def digest(scope: str, key_sql: str, k=0) -> str:
    return f"md5({text(f'{SEED}|{scope}|')} || {key_sql} || '|{k}')"


def number(hex_sql: str, digits: int = 15) -> str:
    return f"CAST('0x' || substr({hex_sql}, 1, {digits}) AS BIGINT)"


def h(scope: str, key_sql: str, k=0) -> str:
    return number(digest(scope, key_sql, k))


def hashed(text_sql: str) -> str:
    return number(f"md5({text_sql})", 8)


@dataclass(frozen=True)
class Dom:
    size: int
    render: Callable[[str], str]


def lit(value: str) -> list[Dom]:
    return [Dom(1, lambda i: text(value))]


def pool(values) -> list[Dom]:
    values = list(dict.fromkeys(values))
    return [Dom(len(values), lambda i: f"list_extract({words(values)}, CAST({i} AS INT) + 1)")]


def digits(n: int) -> list[Dom]:
    return [Dom(10**n, lambda i: f"lpad(CAST({i} AS VARCHAR), {n}, '0')")]


def chars(alphabet: str, n: int) -> list[Dom]:
    base, longest, runs = len(alphabet), 1, []
    while longest < n and 1 < base <= 36 and base ** (longest + 1) <= PACK_LIMIT:
        longest += 1
    while n > 0:
        runs.append(_run(alphabet, min(n, longest)))
        n -= longest
    return cat(*runs)


def _run(alphabet: str, n: int) -> list[Dom]:
    base = len(alphabet)
    at = lambda i, j: f"substr({text(alphabet)}, CAST((({i}) // {base ** (n - 1 - j)}) % {base} AS INT) + 1, 1)"
    return [Dom(base**n, lambda i: "(" + " || ".join(at(i, j) for j in range(n)) + ")")]


def ints(low: int, high: int, kind: str = "BIGINT") -> list[Dom]:
    return [Dom(high - low + 1, lambda i: f"CAST({low} + {i} AS {kind})")]


def decs(low: str, high: str, scale: int, kind: str) -> list[Dom]:
    unit = Decimal(10) ** -scale
    a, b = int(Decimal(low) / unit), int(Decimal(high) / unit)
    return [Dom(b - a + 1, lambda i: f"CAST(CAST({a} + {i} AS DECIMAL(20,0)) * {unit:f} AS {kind})")]


def _epoch(t: dt.datetime) -> int:
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp())


def secs(low: dt.datetime, high: dt.datetime) -> list[Dom]:
    a, b = _epoch(low), _epoch(high)
    return [Dom(b - a + 1, lambda i: f"make_timestamp(({a} + {i}) * 1000000)")]


def dates(low: dt.datetime, high: dt.datetime) -> list[Dom]:
    a, b = _epoch(low) // 86400, _epoch(high) // 86400
    return [Dom(b - a + 1, lambda i: f"make_timestamp(({a} + {i}) * 86400000000)")]


def via(dom: list[Dom], change: Callable[[str], str]) -> list[Dom]:
    return [Dom(dom[0].size, lambda i: change(dom[0].render(i)))]


def cat(*pieces) -> list[Dom]:
    flat: list[Dom] = []
    for piece in pieces:
        flat += lit(piece) if isinstance(piece, str) else piece
    groups, size = [[]], 1
    for d in flat:
        if size * d.size > PACK_LIMIT and groups[-1]:
            groups.append([])
            size = 1
        groups[-1].append(d)
        size *= d.size
    return [_packed(g) for g in groups if g]


def _packed(group: list[Dom]) -> Dom:
    if len(group) == 1:
        return group[0]
    total = 1
    for d in group:
        total *= d.size

    def render(i: str) -> str:
        parts, below = [], 1
        for d in group:
            rest = f"(({i}) // {below})" if below > 1 else f"({i})"
            parts.append(d.render(f"({rest} % {d.size})"))
            below *= d.size
        return "(" + " || ".join(parts) + ")"

    return Dom(total, render)


def symbols(pattern: str) -> list[Dom]:
    pieces = []
    for run in re.findall(r"#+|\?+|\*+|[^#?*]+", pattern):
        if run[0] == "#":
            pieces += [digits(len(run[i : i + 15])) for i in range(0, len(run), 15)]
        elif run[0] == "?":
            pieces.append(chars(p.LETTERS_UPPER, len(run)))
        elif run[0] == "*":
            pieces.append(chars(p.DIGITS + p.LETTERS_UPPER, len(run)))
        else:
            pieces.append(run)
    return cat(*pieces)


def drawn(dom: list[Dom], scope: str, key_sql: str, shifted: bool = False) -> str:
    lead = max(range(len(dom)), key=lambda j: dom[j].size)
    parts = []
    for j, d in enumerate(dom):
        i = f"({h(scope, key_sql, j)} % {d.size})"
        if shifted and j == lead:
            i = f"(({i} + 1 + {h(scope, key_sql, 's')} % {d.size - 1}) % {d.size})"
        parts.append(d.render(i))
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def differing(dom: list[Dom], scope: str, key_sql: str, old: str, finish: Callable[[str], str] = lambda v: v, as_text: bool = False) -> str:
    first = finish(drawn(dom, scope, key_sql))
    if max(d.size for d in dom) < 2:
        return first
    second = finish(drawn(dom, scope, key_sql, shifted=True))
    same = f"CAST({first} AS VARCHAR) IS NOT DISTINCT FROM CAST({old} AS VARCHAR)" if as_text else f"{first} IS NOT DISTINCT FROM {old}"
    return f"CASE WHEN {same} THEN {second} ELSE {first} END"


def kept_null(old: str, value: str) -> str:
    return f"CASE WHEN {old} IS NOT NULL THEN {value} END"


# Keyed permutations ---------------------------------------------------------------------------------


def _half(prefix: str, i: int, half: str) -> str:
    return number(f"md5({text(f'{prefix}feistel|{i}|')} || CAST({half} AS VARCHAR))")


def _mixed(inner: str, left_size: int, right_size: int, prefix: str) -> str:
    """Six rounds over columns k, l, r."""
    for i in range(6):
        if i % 2 == 0:
            inner = f"SELECT k, (l + {_half(prefix, i, 'r')}) % {left_size} AS l, r FROM ({inner})"
        else:
            inner = f"SELECT k, l, (r + {_half(prefix, i, 'l')}) % {right_size} AS r FROM ({inner})"
    return inner


def permutation(name: str, source: str, size: int, scope: str) -> str:
    """A common table expression ``name(k, v)`` for a source of k and its number v: permuted below ``size``, again where it is not below."""
    left = next(n for n in range(1, size + 1) if n * n >= size)
    right = -(-size // left)
    once = lambda rows: f"SELECT k, l * {right} + r AS v FROM ({_mixed(f'SELECT k, v // {right} AS l, v % {right} AS r FROM ({rows})', left, right, f'{SEED}|{scope}|')})"
    return (
        f"{name}_walk(k, v) AS ({once(source)} UNION ALL {once(f'SELECT k, v FROM {name}_walk WHERE v >= {size}')}), "
        f"{name}(k, v) AS (SELECT k, v FROM {name}_walk WHERE v < {size})"
    )


def permuted_form(name: str, source: str, column: str, form: str, scope: str) -> str:
    """The same for text of one form (9 digit, a and A letters, others stand for themselves) with at most 20 letters and digits."""
    classes = {"9": (10, 48), "a": (26, 97), "A": (26, 65)}
    places = [i for i, c in enumerate(form) if c in classes]
    cut = -(-len(places) // 2)
    halves = (places[:cut], places[cut:])

    def weights(half):
        out, below = {}, 1
        for i in reversed(half):
            out[i] = below
            below *= classes[form[i]][0]
        return out, below

    (left, left_size), (right, right_size) = map(weights, halves)
    rank = lambda ws: " + ".join(f"CAST(ascii(substr(k, {i + 1}, 1)) - {classes[form[i]][1]} AS BIGINT) * {w}" for i, w in ws.items()) or "0"
    mixed = _mixed(f"SELECT k, CAST({rank(left)} AS BIGINT) AS l, CAST({rank(right)} AS BIGINT) AS r FROM (SELECT DISTINCT {column} AS k FROM {source})", left_size, right_size, f"{SEED}|{scope}|{form}||")
    char = lambda i: f"chr(CAST({classes[form[i]][1]} + ({'l' if i in left else 'r'} // {(left if i in left else right)[i]}) % {classes[form[i]][0]} AS INT))" if i in left or i in right else text(form[i])
    return f"{name}(k, v) AS (SELECT k, {' || '.join(char(i) for i in range(len(form)))} FROM ({mixed}))"


# Shared text domains -------------------------------------------------------------------------------

FIRST = pool(p.FEMALE_NAMES + p.MALE_NAMES)
LAST = pool(p.LAST_NAMES)
FULL = cat(FIRST, " ", LAST)
USER = cat(FIRST, pool([".", "_"]), LAST, digits(2))
COMPANY = cat(pool(p.COMPANY_STEMS), " ", pool(p.COMPANY_FIELDS))
CITY = cat(pool(p.CITY_STEMS), pool(p.CITY_SUFFIXES))
STREET = cat(via(ints(100, 99999), lambda v: f"CAST({v} AS VARCHAR)"), " ", cat(pool(p.STREET_STEMS), " ", pool(p.STREET_SUFFIXES)))
SECOND_LINE = cat(pool(["Apt. ", "Suite "]), digits(3))
FULL_ADDRESS = cat(STREET, ", ", CITY, ", ", pool(p.COUNTRIES))
FILE_STEM = cat(pool(p.WORDS), "_", pool(p.WORDS), "_", pool(p.WORDS))


def sentence() -> list[Dom]:
    return cat(pool(p.SUBJECTS), " ", pool(p.PREDICATES), " ", pool(p.ENDINGS), ".")


def filler(n: int, separator: str = " ") -> list[Dom]:
    pieces = [sentence()]
    for _ in range(n - 1):
        pieces += [separator, sentence()]
    return cat(*pieces)
