"""Tab-separated files with a strict schema: every value parses or the read fails."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that are booleans.
TRUE_WORDS = ("Y", "yes", "1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("N", "no", "0", "f", "F", "FALSE", "false", "False")
_ZERO = {T.BooleanType(): False, T.StringType(): ""}
_RANGE = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}


def parse_bool(s: Column) -> Column:
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def parse_int(s: Column) -> Column:
    """Whole numbers with base prefixes (0x, 0b, 0o, leading 0: octal) and '_' between digits, as decimal(38,0); null if malformed."""
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    body = F.lower(F.regexp_replace(s, r"^[+-]", ""))
    digits = F.replace(body, F.lit("_"), F.lit(""))
    prefix = F.substring(digits, 1, 2)
    base = F.when(prefix == "0x", 16).when(prefix == "0b", 2).when(prefix == "0o", 8).when(digits.rlike("^0[0-9]"), 8).otherwise(10)
    rest = F.when(prefix.isin("0x", "0b", "0o"), F.substring(digits, 3, 1 << 20)).otherwise(digits)
    underscored = ~body.contains("_") | body.rlike(r"^(0[xbo]?_?)?[0-9a-f]+(_[0-9a-f]+)*$") & body.startswith("0")
    value = F.coalesce(
        *(F.when(base == b, F.when(rest.rlike(f"^[{d}]+$"), F.conv(rest, b, 10).cast("decimal(38,0)"))) for b, d in ((16, "0-9a-f"), (2, "01"), (8, "0-7"))),
        F.when(base == 10, F.when(rest.rlike("^[0-9]+$"), rest.try_cast("decimal(38,0)"))),
    )
    # conv() saturates at 64 bits; longer numbers are out of every range.
    wide = (base == 16) & (F.length(F.regexp_replace(rest, "^0+", "")) > 16) | (base == 8) & (F.length(F.regexp_replace(rest, "^0+", "")) > 21) | (base == 2) & (F.length(F.regexp_replace(rest, "^0+", "")) > 64)
    return F.when(underscored & ~wide, value * sign)


def parse_value(s: Column, kind: T.DataType, fmt: str | None = None, unsigned: int | None = None) -> Column:
    """A text as ``kind``; null where it isn't one.  ``fmt``: x, o, b (base), q (quoted text); ``unsigned``: bits."""
    if isinstance(kind, T.StringType):
        return F.when(s.rlike(r'^".*"$'), F.regexp_replace(F.regexp_replace(s, r'^"|"$', ""), r'\\(["\\])', "$1")) if fmt == "q" else s
    if isinstance(kind, T.BooleanType):
        return parse_bool(s)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = s.try_cast("double")
        infinite = F.lower(F.regexp_replace(s, "^[+-]", "")).isin("inf", "infinity")
        top = 3.4028235677973366e38 if isinstance(kind, T.FloatType) else float("inf")
        return F.when(infinite | F.isnan(x) | (F.abs(x) < top), x).cast(kind)
    if fmt in ("x", "o", "b"):
        base, digits = {"x": (16, "0-9A-Fa-f"), "o": (8, "0-7"), "b": (2, "01")}[fmt]
        n = F.when(s.rlike(f"^[{digits}]+$"), F.conv(s, base, 10).cast("decimal(38,0)"))
    else:
        n = parse_int(s)
    if unsigned:
        return F.when((n >= 0) & (n < F.lit(Decimal(1 << unsigned))), n).cast("decimal(20,0)" if unsigned == 64 else kind)
    bits = _RANGE[kind] - 1
    return F.when((n >= F.lit(Decimal(-(1 << bits)))) & (n < F.lit(Decimal(1 << bits))), n).cast(kind)


def read_tsv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    has_header: bool = False,
    use_header_names: bool = False,
    require_all_columns: bool = False,
    ignore_missing_columns: bool = False,
    formats: dict[str, str] | None = None,
    unsigned: dict[str, int] | None = None,
) -> DataFrame:
    """Rows of ``schema`` from a TSV file, bound by position or by header name.

    A field's metadata may name its column ('name') or leave it out ('skip').
    Missing columns are an error, or zero values with ``ignore_missing_columns``;
    with ``require_all_columns`` columns that no field takes are an error.
    """
    reader = spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "\u0000").option("multiLine", True)
    raw = reader.option("header", use_header_names or has_header).option("inferSchema", False).option("enforceSchema", True).csv(path)
    fields = [f for f in schema.fields if not f.metadata.get("skip")]
    columns: list[Column] = []
    taken = set()
    for i, f in enumerate(fields):
        name = f.metadata.get("name", f.name)
        if use_header_names:
            source = f"`{name}`" if name in raw.columns else None
        else:
            source = f"`{raw.columns[i]}`" if i < len(raw.columns) else None
        if source is None:
            if not (use_header_names and ignore_missing_columns):
                raise ValueError(f"{path} has no column for {name}")
            columns.append(F.lit(_ZERO.get(f.dataType, 0)).cast(f.dataType).alias(f.name))
            continue
        taken.add(source.strip("`"))
        text = F.coalesce(F.col(source), F.lit(""))
        value = parse_value(text, f.dataType, (formats or {}).get(f.name), (unsigned or {}).get(f.name))
        wrong = F.raise_error(F.concat(F.lit(f"bad value in column {name}: "), text)).cast(f.dataType)
        columns.append(F.when(value.isNotNull(), value).otherwise(wrong).alias(f.name) if not isinstance(f.dataType, T.StringType) or (formats or {}).get(f.name) else value.alias(f.name))
    if require_all_columns and (left := [c for c in raw.columns if c not in taken]):
        raise ValueError(f"{path} has columns that no field takes: {left}")
    return raw.select(*columns)


def format_value(c: Column, kind: T.DataType, fmt: str | None = None) -> Column:
    """A value as its TSV text; arrays are joined by commas, floats in their shortest form."""
    if fmt:
        return F.format_string(fmt, c)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: format_value(x, kind.elementType)), ",")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Whole numbers have no decimal point, exponents a sign and two digits.
        text = c.cast("string")
        plain = F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), r"\.0E", "E")
        return F.regexp_replace(F.regexp_replace(plain, r"E(\d+)$", "e+$1"), r"E-?(\d+)$", "e-$1")
    return c.cast("string")


def write_tsv(df: DataFrame, path: str, header: bool = True, formats: dict[str, str] | None = None) -> None:
    """Tab-separated text without any quoting, so tabs and line ends in values don't survive."""
    out = df.select(*(format_value(F.col(f.name), f.dataType, (formats or {}).get(f.name)).alias(f.metadata.get("name", f.name)) for f in df.schema.fields if not f.metadata.get("skip")))
    out.write.option("sep", "\t").option("quote", "\u0000").option("escapeQuotes", False).option("emptyValue", "").option("header", header).csv(path)
