"""Column expressions for single text cells. JVM-side only, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens that count as a missing cell (compared lower-case).
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "-")

# Text tokens that count as boolean (compared lower-case).
BOOLEAN_TOKENS = ("true", "yes", "y", "1", "false", "no", "n", "0")

# The Unicode white-space characters removed from both ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_FLOAT_SHAPE = (
    r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)"
    r"(?:[eE][+-]?\d+(?:_\d+)*)?$|^[+-]?(?i:inf|infinity|nan)$"
)

_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_YMD = r"\d{4}-\d{1,2}-\d{1,2}"

# Cell shape -> datetime patterns tried in order. Shapes are disjoint, so a cell
# is parsed by at most the patterns of one shape instead of by all of them.
_DATE_SHAPES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (rf"^{_YMD}$", ("yyyy-M-d",)),
    (rf"^{_YMD}\s+{_CLOCK}$", ("yyyy-M-d H:m:s",)),
    (rf"^{_YMD}[Tt]{_CLOCK}[Zz]?$", ("yyyy-M-d'T'H:m:s",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("d/M/yyyy", "M/d/yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy", "M-d-yyyy")),
    (r"^\p{L}+\.?\s+\d{1,2},\s*\d{4}$", ("MMMM d, yyyy", "MMM d, yyyy")),
    (r"^\p{L}+\.?\s+\d{4}$", ("MMMM yyyy", "MMM yyyy")),
)

_BUSINESS_DATE_SHAPES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (rf"^{_YMD}$", ("yyyy-M-d",)),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{4}-\d{1,2}$", ("yyyy-M",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("d/M/yyyy", "M/d/yyyy")),
)


def normalize_cell(cell: Column) -> Column:
    """NULL becomes the empty string; surrounding white space goes."""
    return F.coalesce(F.trim(cell.cast("string"), F.lit(WHITESPACE)), F.lit(""))


def is_missing(cell: Column) -> Column:
    return F.lower(normalize_cell(cell)).isin(*MISSING_TOKENS)


def present(cell: Column) -> Column:
    """The normalised text of a cell, or NULL when the cell is missing."""
    return F.when(~is_missing(cell), normalize_cell(cell))


def coerce_float(cell: Column) -> Column:
    """Text to DOUBLE; NULL for missing or non-numeric cells.

    Thousands commas are dropped and digit groups may be joined by ``_``. The
    shape test keeps out JVM-only spellings such as ``1.0d`` or hex floats.
    """
    text = F.trim(F.replace(normalize_cell(cell), F.lit(",")), F.lit(WHITESPACE))
    number = F.replace(text, F.lit("_")).try_cast("double")
    return F.when(~is_missing(cell) & text.rlike(_FLOAT_SHAPE), number)


def is_integral(number: Column) -> Column:
    """True for finite doubles without a fraction."""
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return finite & (number == F.rint(number))


def coerce_int(cell: Column) -> Column:
    number = coerce_float(cell)
    return F.when(is_integral(number), number.try_cast("long"))


def _parse_shapes(cell: Column, shapes) -> Column:
    text = F.regexp_replace(normalize_cell(cell), r"\s+", " ")
    parsed = None
    for shape, patterns in shapes:
        value = F.regexp_replace(F.upper(text), "Z$", "") if "Zz" in shape else text
        attempt = F.coalesce(*(F.try_to_timestamp(value, F.lit(p)) for p in patterns))
        parsed = (
            F.when(text.rlike(shape), attempt)
            if parsed is None
            else parsed.when(text.rlike(shape), attempt)
        )
    return parsed


def parse_date(cell: Column) -> Column:
    """Timestamp from the accepted date spellings; day-first beats month-first."""
    return F.when(~is_missing(cell), _parse_shapes(cell, _DATE_SHAPES))


def parse_business_date(cell: Column) -> Column:
    """The narrower set of date spellings used by the KPI operators."""
    return F.when(~is_missing(cell), _parse_shapes(cell, _BUSINESS_DATE_SHAPES))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def month_name(ts: Column) -> Column:
    return F.date_format(ts, "MMMM")


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding of the decimal spelling of a double."""
    return F.round(value, places)


NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def is_numeric_field(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC_TYPES)


def is_time_field(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def column_ref(name: str) -> Column:
    """A column by exact name, even when the name holds dots or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_of(field: T.StructField) -> Column:
    """The DOUBLE reading of a column: a plain cast if typed, a coercion if text."""
    ref = column_ref(field.name)
    if is_numeric_field(field):
        return ref.cast("double")
    if isinstance(field.dataType, T.BooleanType):
        return ref.cast("int").cast("double")
    if is_time_field(field):
        return F.lit(None).cast("double")
    return coerce_float(ref)


def text_of(field: T.StructField) -> Column:
    """The normalised text of a column, NULL when missing."""
    ref = column_ref(field.name)
    if is_numeric_field(field) or isinstance(field.dataType, T.BooleanType):
        return ref.cast("string")
    if is_time_field(field):
        return F.date_format(ref, "yyyy-MM-dd HH:mm:ss")
    return present(ref)


def timestamp_of(field: T.StructField, business: bool = False) -> Column:
    ref = column_ref(field.name)
    if is_time_field(field):
        return ref.cast("timestamp")
    return parse_business_date(ref) if business else parse_date(ref)


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ValueError(f"Column not found: {name}")


def as_text_table(df: DataFrame) -> DataFrame:
    """All-text view of a table: every column TEXT, blanks as ''."""
    return df.select(
        *(F.coalesce(text_of(f), F.lit("")).alias(f.name) for f in df.schema.fields)
    )

