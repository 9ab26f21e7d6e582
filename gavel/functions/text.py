"""Text helpers whose results match Python's text rules."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.schemas import LABELS

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Answer patterns of math word problems.
NUMBER_PATTERN = r"-?\d[\d,]*(?:\.\d+)?"
FINAL_ANSWER_PATTERN = r"####\s*(-?[\d,]+(?:\.\d+)?)"
# NLI label names in index order.
NLI_LABELS = ("entailment", "contradiction", "neutral")

FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and slashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    """Unicode-aware strip; `trim` scans only the ends, unlike a regex."""
    return F.trim(text, F.lit(WHITESPACE))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH_DIGITS, "0123456789")


def _float_text(value: Column) -> Column:
    """repr(float): plain digits for 1e-4 <= |x| < 1e16, exponent form outside."""
    java = value.cast("string")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(java, r"^-?([\d.]+)E", 1)
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    width = F.length(digits)
    large = F.concat(
        sign,
        F.when(
            width <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))
        ).otherwise(
            F.concat(
                F.substring(digits, F.lit(1), exponent + 1),
                F.lit("."),
                F.substring(digits, exponent + 2, width),
            )
        ),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(
        sign,
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(java == "Infinity", "inf")
        .when(java == "-Infinity", "-inf")
        .when(exponent.isNull(), java)
        .when((exponent >= 0) & (exponent < 16), large)
        .when((exponent < 0) & (exponent >= -4), small)
        .otherwise(scientific)
    )


def py_str(value: Column, dtype: T.DataType) -> Column:
    """str(value): `True`/`False` for booleans, `None` for NULL, repr for floats."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, "True").otherwise("False")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(value.cast("double"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("None")).otherwise(text)


def field_text(df: DataFrame, name: str) -> Column:
    """str(row[name]); an absent column is an error."""
    return py_str(col(name), df.schema[name].dataType)


def value_text(value: Column, dtype: T.DataType) -> Column:
    """Value as prose: NULL is empty, booleans are lower case, nested values are JSON."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    elif isinstance(dtype, T.BooleanType):
        text = value.cast("string")
    else:
        text = py_str(value, dtype)
    return F.when(value.isNull(), "").otherwise(text)


def template_fields(template: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(template) if name is not None]


def fill_template(df: DataFrame, template: str) -> Column:
    """`{field}` template over the row; unknown fields fail while planning."""
    parts: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"unsupported format in template: {template}")
        if name not in df.columns:
            raise KeyError(f"template field not found: {name}")
        parts.append(field_text(df, name))
    return F.concat(*parts) if parts else F.lit("")


def truncate(text: Column, max_chars: int) -> Column:
    """First `max_chars` code points; 0 keeps the whole text."""
    return F.substring(text, 1, max_chars) if max_chars > 0 else text


def numeric_text(value: Column) -> Column:
    """Integral values without a point, others with up to six decimals."""
    decimals = F.when(
        F.abs(value).between(1e-6, 1e30), value.try_cast("decimal(38,6)").cast("string")
    ).otherwise(F.format_string("%.6f", value))
    whole = F.when(
        F.abs(value) < 9e18, value.cast("bigint").cast("string")
    ).otherwise(value.cast("decimal(38,0)").cast("string"))
    fraction = F.rtrim(F.rtrim(decimals, F.lit("0")), F.lit("."))
    return F.when(value == F.floor(value), whole).otherwise(fraction)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def answer_number(answer: Column, declared: Column | None = None) -> Column:
    """Canonical numeric answer: the declared number, else `#### n`, else the last number."""

    def find(text: Column) -> Column:
        final = F.regexp_extract(text, FINAL_ANSWER_PATTERN, 1)
        last = F.try_element_at(
            F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)), F.lit(-1)
        )
        return let(final, lambda f: F.when(f != "", f).otherwise(F.coalesce(last, F.lit(""))))

    def canonical(plain: Column) -> Column:
        missing = F.raise_error(F.lit("numeric answer is missing")).cast("string")
        return F.when(plain == "", missing).otherwise(let(plain.cast("double"), numeric_text))

    raw = let(ascii_digits(F.coalesce(answer, F.lit("None"))), find)
    if declared is not None:
        raw = F.coalesce(declared.cast("string"), raw)
    return let(F.replace(raw, F.lit(","), F.lit("")), canonical)


def answer_index(value: Column, dtype: T.DataType, options: Column) -> Column:
    """Answer value -> option index; the source type decides the reading.

    Booleans and integers are indices already. Text is read as a letter, then a
    1-based number, then a 0-based number, then the option text itself.
    """
    if isinstance(dtype, (T.BooleanType, T.IntegralType)):
        return value.cast("int")
    count = F.size(options)

    def read(text: Column) -> Column:
        letter = F.instr(F.substring(F.lit(LABELS), F.lit(1), count), F.upper(text))
        digits = ascii_digits(text)
        number = F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))
        position = F.array_position(options, text)
        return (
            F.when(letter > 0, letter - 1)
            .when((number >= 1) & (number <= count), number - 1)
            .when((number >= 0) & (number < count), number)
            .when(position > 0, position - 1)
            .otherwise(
                F.raise_error(F.concat(F.lit("cannot map answer to options: "), text)).cast("int")
            )
            .cast("int")
        )

    return let(strip(py_str(value, dtype)), read)


def nli_label(value: Column, dtype: T.DataType) -> Column:
    """NLI label name from an index or a name."""
    names = F.array(*[F.lit(name) for name in NLI_LABELS])
    if isinstance(dtype, T.IntegralType):
        return F.element_at(names, value.cast("int") + 1)
    return py_str(value, dtype)


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """Deterministic order key for seeded shuffles and splits."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def json_text(text: Column) -> Column:
    """A JSON string literal."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
