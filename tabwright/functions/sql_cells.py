"""The cell rules of ``cells`` as SQL functions of a session, for statements over imported text.

They are plain SQL expressions that Catalyst inlines: no Python runs for them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabwright.functions import cells


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _dated(shapes) -> str:
    """A date by the first shape that the cell has, its spellings tried in order."""
    cases = ["WHEN cell_missing(cell) THEN NULL"]
    for shape, patterns in shapes:
        value = "regexp_replace(upper(cell_spaced(cell)), 'Z$', '')" if "Zz" in shape else "cell_spaced(cell)"
        tried = ", ".join(f"try_to_timestamp({value}, {_quoted(p)})" for p in patterns)
        cases.append(f"WHEN cell_spaced(cell) RLIKE {_quoted(shape)} THEN coalesce({tried})")
    return f"CASE {' '.join(cases)} END"


def definitions() -> dict[str, tuple[str, str]]:
    """Function name -> (type, expression over the text ``cell``); later ones use those before them."""
    blank = _quoted(cells.WHITESPACE)
    missing = ", ".join(map(_quoted, cells.MISSING_TOKENS))
    digits = f"trim(BOTH {blank} FROM replace(cell_text(cell), ','))"
    return {
        "cell_text": ("STRING", f"coalesce(trim(BOTH {blank} FROM cell), '')"),
        "cell_spaced": ("STRING", "regexp_replace(cell_text(cell), '\\\\s+', ' ')"),
        "cell_missing": ("BOOLEAN", f"lower(cell_text(cell)) IN ({missing})"),
        "cell_number": (
            "DOUBLE",
            f"CASE WHEN NOT cell_missing(cell) AND {digits} RLIKE {_quoted(cells._FLOAT_SHAPE)} "
            f"THEN try_cast(replace({digits}, '_') AS DOUBLE) END",
        ),
        "cell_whole": (
            "BIGINT",
            "CASE WHEN abs(cell_number(cell)) < double('inf') AND cell_number(cell) = rint(cell_number(cell)) "
            "THEN try_cast(cell_number(cell) AS BIGINT) END",
        ),
        "cell_date": ("TIMESTAMP", _dated(cells._DATE_SHAPES)),
        "cell_month": ("STRING", "date_format(cell_date(cell), 'yyyy-MM')"),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    made = definitions()
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(cell STRING) RETURNS {kind} RETURN {body}")
    return list(made)
