"""A value as canonical JSON, as column expressions: the text that record digests are made of.

Keys are sorted by code point at every depth, nothing is padded, and all text is ASCII:
other characters become \\uXXXX escapes in lower case, those beyond 16 bits a surrogate
pair.  The form is that of Python's json.dumps(sort_keys=True, separators=(",", ":")), so
digests equal ones made elsewhere.  Whole numbers, flags, text, arrays, structs and maps
with text keys take part; floating-point numbers are written as Python's repr does, from
the digits that the JVM finds, which before version 19 were now and then one too many.
Other types count as their text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The short escapes of JSON, by UTF-16 unit.
ESCAPES = {
    "0022": '\\"', "005c": "\\\\", "0008": "\\b", "0009": "\\t", "000a": "\\n", "000c": "\\f",
    "000d": "\\r",
}
PLAIN = r"^[ !#-\[\]-~]*$"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(text: Column) -> Column:
    """text as a JSON string; what needs escapes is taken apart into its UTF-16 units."""

    def escaped(unit: Column) -> Column:
        shown = F.when((unit >= "007f") | (unit < "0020"), F.concat(F.lit("\\u"), unit))
        short = F.when(unit == "0022", ESCAPES["0022"])
        for at, escape in ESCAPES.items():
            short = short.when(unit == at, escape)
        letter = F.char(F.conv(unit, 16, 10).cast("long"))
        return F.coalesce(short, shown, letter)

    units = F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit("...."), 0)
    taken = F.array_join(F.transform(units, escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(PLAIN), text).otherwise(taken), F.lit('"'))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def number(x: Column) -> Column:
    """A double as Python writes it: positional from 1e-4 up to 1e16, else with an exponent."""
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    part = lambda text, mark, n: F.split_part(text, F.lit(mark), F.lit(n))

    def read(text: Column) -> Column:
        mantissa, power = part(text, "E", 1), F.coalesce(part(text, "E", 2).try_cast("int"), F.lit(0))
        every = F.concat(part(mantissa, ".", 1), part(mantissa, ".", 2))
        leading = F.length(F.regexp_extract(every, "^0*", 0))
        at = F.length(part(mantissa, ".", 1)) + power - leading
        return F.struct(F.regexp_replace(every, "^0+|0+$", "").alias("digits"), at.alias("at"))

    def written(parts: Column) -> Column:
        """The number is 0.digits times ten to the power of at."""
        digits, at = parts["digits"], parts["at"]
        n, power = F.length(digits), (F.abs(at - 1)).cast("string")
        small = F.concat(F.lit("0."), zeros(-at), digits)
        fraction = F.when(n > at, F.substr(digits, at + 1)).otherwise("0")
        large = F.concat(F.substr(digits, F.lit(1), at), zeros(at - n), F.lit("."), fraction)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        mark = F.when(at > 0, "e+").otherwise("e-")
        apart = F.concat(F.left(digits, F.lit(1)), tail, mark, zeros(2 - F.length(power)), power)
        shown = F.when((at > 16) | (at < -3), apart).when(at <= 0, small).otherwise(large)
        return F.when(digits == "", "0.0").otherwise(shown)

    def signed(text: Column) -> Column:
        bare = F.regexp_replace(text, "^-", "")
        return F.concat(F.when(text.startswith("-"), "-").otherwise(""), let(let(bare, read), written))

    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    text = x.cast("double").cast("string")
    return F.when(odd, text).otherwise(let(text, signed))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of a type; null is null, of any type."""
    if isinstance(kind, T.StructType):
        cells = []
        for field in sorted(kind, key=lambda f: f.name):
            cell = canonical_json(value.getField(field.name), field.dataType)
            cells.append(F.concat(F.lit(json.dumps(field.name) + ":"), cell))
        shown = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    elif isinstance(kind, T.MapType):
        cells = F.transform(
            F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)),
            lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType)),
        )
        shown = F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        cells = F.transform(value, lambda x: canonical_json(x, kind.elementType))
        shown = F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))
    elif isinstance(kind, (*WHOLE, T.BooleanType)):
        shown = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = number(value)
    else:
        shown = quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(shown)
