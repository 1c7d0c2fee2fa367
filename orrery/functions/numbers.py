"""Numbers and JSON text as Python rounds and writes them: Spark SQL expressions, as text, without Python.

Each function takes the SQL of a value and returns the SQL of the result, to be used as F.expr(fixed("x")) or in a lambda,
F.expr(f"transform(xs, v -> {fixed('v')})"): so long an expression is parsed at once, not built call by call.

A double is rounded by its exact binary value. A product with a power of ten is split into its rounded value and the exact
rest (Veltkamp's and Dekker's error-free product), so that ties are told from values that only look like them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

#: Powers of ten that doubles hold exactly, as an array.
_POWERS = f"array({', '.join(f'1E{k}D' for k in range(23))})"
#: From here on every double is a whole number; what cuts a double into two halves of its bits.
_WHOLE, _CUT = "9007199254740992D", "134217729D"
_names = itertools.count()


def let(value: str, then: Callable[[str], str]) -> str:
    """then(name) with the value evaluated once under that name."""
    name = f"_{next(_names)}"
    return f"get(transform(array({value}), {name} -> {then(name)}), 0)"


def _rest(x: str, p: str, scale: str) -> str:
    """What the product of x and scale has beyond its rounded value p."""
    high = lambda v: f"({_CUT} * {v} - ({_CUT} * {v} - {v}))"
    low = lambda xh, sh: let(f"{x} - {xh}", lambda xl: let(f"{scale} - {sh}", lambda sl: f"((({xh} * {sh} - {p}) + {xh} * {sl}) + {xl} * {sh}) + {xl} * {sl}"))
    return let(high(x), lambda xh: let(high(scale), lambda sh: low(xh, sh)))


def _nearest(x: str, scale: str, p: str) -> str:
    """The whole number (a double) nearest to the exact product of x and scale, ties to even, where p, the rounded product, is below
    _WHOLE. A zero keeps the sign of x. Below half of _WHOLE a product that is no tie itself is rounded right; above it
    is whole, and ties have gone to even."""
    tie = lambda r: let(_rest(x, p, scale), lambda e: f"CASE WHEN {p} > {r} AND {e} > 0 THEN {r} + 1D WHEN {p} < {r} AND {e} < 0 THEN {r} - 1D ELSE {r} END")
    return let(f"rint({p})", lambda r: f"CASE WHEN abs({p} - {r}) = 0.5D THEN {tie(r)} ELSE {r} END")


def rounded(x: str, digits: int) -> str:
    """x to some decimal places, half to even by its exact value, as Python's round. Null, NaN and infinities stay."""
    scale = f"1E{digits}D"
    return let(f"CAST({x} AS DOUBLE)", lambda v: let(f"{v} * {scale}", lambda p: f"CASE WHEN abs({p}) < {_WHOLE} THEN {_nearest(v, scale, p)} / {scale} ELSE {v} END"))


def rounded_away(x: str, digits: int) -> str:
    """x to some decimal places, as DuckDB's round does: its product with the power of ten, a double, to the nearest whole number, ties
    away from zero. Null, NaN, infinities and what has no finite product stay."""
    scale = f"1E{digits}D"
    whole = lambda p: let(f"rint({p})", lambda r: f"CASE WHEN abs({p} - {r}) = 0.5D THEN {p} + signum({p}) * 0.5D ELSE {r} END")
    return let(f"CAST({x} AS DOUBLE)", lambda v: let(f"{v} * {scale}", lambda p: f"CASE WHEN abs({p}) < double('inf') THEN {whole(p)} / {scale} ELSE {v} END"))


def _signed(v: str, special: tuple[str, str], number: str) -> str:
    """A number's text behind its sign, that of zero, too; other texts for NaN and infinities."""
    sign = f"CASE WHEN {v} < 0 OR ({v} = 0 AND startswith(CAST({v} AS STRING), '-')) THEN '-' ELSE '' END"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN isnan({v}) THEN '{special[0]}' ELSE {sign} || CASE WHEN abs({v}) = double('inf') THEN '{special[1]}' ELSE {number} END END"


def fixed(x: str, digits: int = 2) -> str:
    """Text with so many decimal places (1 to 6), as Python formats `.2f`; nan, inf and -inf for what is no number. From 2 ** 123
    on, shortest digits are followed by zeros."""
    unit, scale = 10**digits, f"1E{digits}D"
    joined = lambda whole, part: f"{whole} || '.' || lpad(CAST({part} AS STRING), {digits}, '0')"
    small = lambda m: let(f"CAST(abs({m}) AS BIGINT)", lambda a: joined(f"CAST({a} div {unit} AS STRING)", f"{a} % {unit}"))
    # A larger fraction has few bits, so that its product is exact.
    part = lambda a: let(f"CAST(rint(({a} - CAST(floor({a}) AS DOUBLE)) * {scale}) AS BIGINT)", lambda f: joined(f"CAST(CAST(floor({a}) AS BIGINT) + {f} div {unit} AS STRING)", f"{f} % {unit}"))
    block = f"{1 << 60}"
    long = lambda a: let(f"CAST(floor({a} / {block}D) AS BIGINT)", lambda h: f"CAST(CAST({h} AS DECIMAL(19,0)) * CAST({block} AS DECIMAL(19,0)) + CAST(CAST({a} - CAST({h} AS DOUBLE) * {block}D AS BIGINT) AS DECIMAL(19,0)) AS STRING)")
    large = lambda a: f"CASE WHEN {a} < {_WHOLE} THEN {part(a)} WHEN {a} < {float(1 << 123)!r}D THEN {joined(long(a), '0')} ELSE format_string('%.{digits}f', {a}) END"

    def of(v: str) -> str:
        number = let(f"{v} * {scale}", lambda p: f"CASE WHEN abs({p}) < {_WHOLE} THEN {let(_nearest(v, scale, p), small)} ELSE {let(f'abs({v})', large)} END")
        return _signed(v, ("nan", "inf"), number)

    return let(f"CAST({x} AS DOUBLE)", of)


def _laid_out(s: str, e: str) -> str:
    """Python's layout of a number from its digits (no zeros at the end) and the exponent of the first one."""
    whole = f"rpad(left({s}, {e} + 1), {e} + 1, '0') || '.' || CASE WHEN length({s}) > {e} + 1 THEN substring({s}, {e} + 2) ELSE '0' END"
    part = f"'0.' || repeat('0', -{e} - 1) || {s}"
    power = f"left({s}, 1) || CASE WHEN length({s}) > 1 THEN '.' ELSE '' END || substring({s}, 2) || CASE WHEN {e} < 0 THEN 'e-' ELSE 'e+' END || CASE WHEN abs({e}) < 10 THEN '0' ELSE '' END || CAST(abs({e}) AS STRING)"
    return f"CASE WHEN {e} BETWEEN 0 AND 15 THEN {whole} WHEN {e} BETWEEN -4 AND -1 THEN {part} ELSE {power} END"


def _digits(a: str, e: str) -> str:
    """A whole number that holds the shortest digits that read back as a, from 1e-6 to 1e17, and how many digits it has for the
    exponent e: of 15, 16 or 17 digits, the first that does, rounded from the exact value; of 16 digits the next
    number, too, as a power of two has a wider range above than below."""

    def number(k: str) -> str:
        """The whole number nearest to a times the power k of ten."""
        near = lambda scale, p: f"CASE WHEN {p} >= {_WHOLE} / 2 THEN CAST({p} AS BIGINT) + CAST(rint({_rest(a, p, scale)}) AS BIGINT) ELSE CAST({_nearest(a, scale, p)} AS BIGINT) END"
        return let(f"get({_POWERS}, {k})", lambda scale: let(f"{a} * {scale}", lambda p: near(scale, p)))

    def reads(n: str, k: str) -> str:
        """Whether n times the power -k of ten reads as a; a quotient of two doubles that are exact is rounded as a text is."""
        return f"CASE WHEN {n} <= 9007199254740992 AND {k} >= 0 THEN CAST({n} AS DOUBLE) / get({_POWERS}, {k}) = {a} ELSE CAST(CAST({n} AS STRING) || 'E' || CAST(-{k} AS STRING) AS DOUBLE) = {a} END"

    some = lambda k, back: f"CASE WHEN {k} >= {back} THEN {number(f'{k} - {back}')} ELSE (CAST({a} AS BIGINT) + {10**back // 2}) div {10**back} END"  # noqa: E731  a number of 17 digits is whole
    told = lambda n, count: f"named_struct('n', {n}, 'count', {count})"

    def of(k: str) -> str:
        sixteen = let(some(k, 1), lambda n: f"CASE WHEN {reads(n, f'({k} - 1)')} THEN {told(n, 16)} WHEN {reads(f'({n} + 1)', f'({k} - 1)')} THEN {told(f'{n} + 1', 16)} ELSE {told(number(k), 17)} END")
        return let(some(k, 2), lambda n: f"CASE WHEN {reads(n, f'({k} - 2)')} THEN {told(n, 15)} ELSE {sixteen} END")

    return let(f"16 - {e}", of)


def json_number(x: str) -> str:
    """The shortest text that reads back as the same double, as Python writes it in JSON: 1.0, 1e-05, 1e+16, NaN, Infinity.

    Spark's own text is taken where it has at most 15 digits, as no other text so short reads back the same; else the digits are
    made anew. Below 1e-6 and from 1e17 on, longer digits are those of Spark's text, which may not be the shortest.
    """

    def with_digits(a: str, n: str, e: str) -> str:
        made = let(_digits(a, e), lambda f: let(f"CAST({f}.n AS STRING)", lambda s: f"named_struct('s', rtrim('0', {s}), 'e', {e} + length({s}) - {f}.count)"))
        pair = f"CASE WHEN length({n}) > 15 AND {a} >= 1E-6D AND {a} < 1E17D THEN {made} ELSE named_struct('s', rtrim('0', {n}), 'e', {e}) END"
        return let(pair, lambda f: _laid_out(f"{f}.s", f"{f}.e"))

    def positive(a: str, text: str) -> str:
        mantissa, power = f"substring_index({text}, 'E', 1)", f"CASE WHEN contains({text}, 'E') THEN CAST(substring_index({text}, 'E', -1) AS INT) ELSE 0 END"
        digits = lambda m: let(f"replace({m}, '.', '')", lambda all_: let(f"ltrim('0', {all_})", lambda n: let(f"instr({m}, '.') - 2 - length({all_}) + length({n}) + {power}", lambda e: with_digits(a, n, e))))
        return let(mantissa, digits)

    def of(v: str) -> str:
        short = lambda a, t: f"length({t}) <= 16 AND ({a} >= 1E-3D AND {a} < 1E7D OR {a} = 0)"
        number = let(f"abs({v})", lambda a: let(f"ltrim('-', CAST({v} AS STRING))", lambda t: f"CASE WHEN {short(a, t)} THEN {t} ELSE {positive(a, t)} END"))
        return _signed(v, ("NaN", "Infinity"), number)

    return let(f"CAST({x} AS DOUBLE)", of)


def json_text(x: str) -> str:
    """JSON string of a text in ASCII, as Python writes it: other characters by UTF-16 units, in lower-case hex digits."""
    short = {"0022": r"\"", "005c": r"\\", "000a": r"\n", "000d": r"\r", "0009": r"\t", "000c": r"\f", "0008": r"\b"}
    cases = " ".join(f"WHEN '{u}' THEN r'{text}'" for u, text in short.items())
    unit = f"CASE u {cases} ELSE CASE WHEN u BETWEEN '0020' AND '007e' THEN char(CAST(conv(u, 16, 10) AS BIGINT)) ELSE r'\\u' || u END END"
    plain = r"r'^[ !#-\[\]-~]*\z'"
    return let(x, lambda t: f"""'"' || CASE WHEN {t} RLIKE {plain} THEN {t} ELSE array_join(transform(regexp_extract_all(lower(hex(encode({t}, 'UTF-16BE'))), '(....)', 1), u -> {unit}), '') END || '"'""")
