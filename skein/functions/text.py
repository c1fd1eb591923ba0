"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What people and programs write for a missing value. A bare 无 is an answer, as No is.
STAND_INS = ["null", "none", "nil", "nan", "na", "n/a", "undefined", "empty", "no content", "n.a", "无内容", "空", "void", "missing", "not available", "no data", "sin contenido", "kein inhalt", "leer", "vacío"]
_EDGES = r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def code_key(c: Column) -> Column:
    """A code without outer spaces and in lower case."""
    return F.lower(stripped(c))


def stripped(c: Column) -> Column:
    """A text without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, without any letter or digit, or nothing but a stand-in for a missing value, whatever marks are around it."""
    core = F.lower(F.regexp_replace(c, _EDGES, ""))
    return F.coalesce((core == "") | core.isin(STAND_INS), F.lit(True))


def truncated(c: Column, n: int) -> Column:
    """At most n characters, then three dots."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def abbreviated(c: Column, n: int = 80) -> Column:
    """At most n characters, the dots included; blank and null become empty."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def short_id(c: Column) -> Column:
    """Long identifiers as their first and last six characters."""
    c = c.cast("string")
    return F.when(F.length(c) > 14, F.concat(F.left(c, F.lit(6)), F.lit("..."), F.right(c, F.lit(6)))).otherwise(c)


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def normalised(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def csv_list(c: Column) -> Column:
    """The trimmed parts of a comma-separated text without empty ones."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def json_list(c: Column, schema: str = "array<string>") -> Column:
    """A JSON array, or an empty one if the text is no such array."""
    return F.coalesce(F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, schema)), F.array().cast(schema))


def split_last(c: Column, mark: str = " | ") -> tuple[Column, Column]:
    """What stands before and after the last mark; without a mark all of it and an empty text."""
    tail = F.substring_index(c, mark, -1)
    has = F.contains(c, F.lit(mark))
    return F.when(has, F.left(c, F.length(c) - F.length(tail) - len(mark))).otherwise(c), F.when(has, tail).otherwise("")


def any_contains(columns: list[Column], keyword: str) -> Column:
    """The keyword stands in one of the columns, whatever the case; a blank keyword matches all."""
    if not keyword.strip():
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *[filled(c.cast("string")) for c in columns])), F.lit(keyword.strip().lower()))


def chosen(c: Column, value: str | None) -> Column:
    """Equality that is switched off by null, blank or ALL."""
    return F.lit(True) if value is None or value.strip() in ("", "ALL") else F.coalesce(c.cast("string"), F.lit("")) == value


def label(c: Column, names: dict[str, str], fallback: str) -> Column:
    """The name of a code, else the code itself, else the fallback."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c.cast("string")), filled(c.cast("string")), F.lit(fallback))


def strict_label(c: Column, names: dict[str, str], null_name: str | None = None) -> Column:
    """The name of a code; unknown codes raise an error, and null does too unless it has a name."""
    out = F.when(c.isNull(), F.raise_error(F.lit("no code"))) if null_name is None else F.when(c.isNull(), null_name)
    for code, name in names.items():
        out = out.when(c.cast("string") == code, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown code "), c.cast("string"))))


def number(c: Column) -> Column:
    """A number where null and blank count as 0 and other text is null; only finite values."""
    x = F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(0.0)).otherwise(c.cast("string").try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def file_size(c: Column) -> Column:
    """Bytes with a unit at steps of 1024, one decimal above bytes; nothing for none."""
    out = F.when(c.isNull() | (c <= 0), "-").when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for unit, power in (("KB", 1), ("MB", 2)):
        out = out.when(c < 1024 ** (power + 1), F.concat(F.format_string("%.1f", c / 1024**power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", c / 1024**3), F.lit(" GB")))


def percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def token_estimate(c: Column) -> Column:
    """A token per four characters."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def jwt_payload(c: Column) -> Column:
    """The payload of a signed token as JSON text; null if it has none."""
    part = F.translate(F.get(F.split(c, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, ((F.length(part) + 3) / 4).cast("int") * 4, "=")
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def confidence_band(c: Column) -> Column:
    """none, widen, usable or high, at 0, 0.55 and 0.8."""
    return F.when(c.isNull() | (c <= 0), "none").when(c >= 0.8, "high").when(c >= 0.55, "usable").otherwise("widen")


def duration_level(c: Column, p50: Column, p90: Column, p99: Column) -> Column:
    zero = F.lit(0)
    return F.when(c <= F.coalesce(p50, zero), "excellent").when(c <= F.coalesce(p90, zero), "good").when(c <= F.coalesce(p99, zero), "warning").otherwise("slow")


def tenths(c: Column, unit: int) -> Column:
    """A whole number divided by a unit, to one digit, as the console's toFixed(1) shows the quotient: nearest, and on
    the edge between two digits down only if the floating-point quotient lies below the edge. Digits come from whole
    numbers; the quotient's error comes from its halves of 26 bits, whose products are exact."""
    q = c / F.lit(float(unit))
    high = q * 134217729.0 - (q * 134217729.0 - q)
    below = (high * float(unit) - c) + (q - high) * float(unit) < 0
    rest = F.pmod(c, F.lit(unit))
    up = F.floor((rest * 20 + unit) / (2 * unit)) - F.when((F.pmod(rest * 10, F.lit(unit)) * 2 == unit) & below, 1).otherwise(0)
    n = F.floor((c - rest) / unit) * 10 + up
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many digits behind the point; a dash for none."""
    return F.when(c.isNull() | F.isnan(c), "-").otherwise(F.format_string(f"%.{digits}f", c))


def thousands(c: Column) -> Column:
    """A whole number with a comma between thousands; 0 for none."""
    return F.format_number(F.coalesce(c, F.lit(0)), 0)


def page_window(page: Column, total: Column) -> Column:
    """The page numbers shown beside a page: all of up to seven, else the first, the last and those around, with dots."""
    text = lambda c: c.cast("string")
    join = lambda *parts: F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else text(x) for x in parts])
    every = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), total.cast("bigint")), lambda x: x.cast("string")), " ")
    late = join("1 ...", total - 4, total - 3, total - 2, total - 1, total)
    return F.when(total <= 7, every).when(page <= 4, join("1 2 3 4 5 ...", total)).when(page >= total - 3, late).otherwise(join("1 ...", page - 1, page, page + 1, "...", total))


def allowed(c: Column, codes: list[str]) -> Column:
    """The codes of a list that are in a set, each once, in the order of their first place."""
    known = F.array(*map(F.lit, codes))
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: F.array_contains(known, x)))


def stringified(c: Column, kind: T.DataType) -> Column:
    """The same value with every number in it as text, at every level of structs, arrays and maps."""
    if isinstance(kind, T.StructType):
        return F.struct(*[stringified(c[f.name], f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: stringified(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: stringified(v, kind.valueType))
    return c.cast("string") if isinstance(kind, T.NumericType) else c


def pretty(c: Column, schema: str) -> Column:
    """JSON of a known schema broken into indented lines; what is no such JSON stays as it is."""
    return F.coalesce(F.to_json(F.from_json(c, schema), {"pretty": "true"}), c)
