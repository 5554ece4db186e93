"""Column expressions for filename, encoding and content risk rules."""

from __future__ import annotations

from functools import reduce
from operator import add

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions refused anywhere in a name.
BLOCKED_EXTENSIONS = (
    "bat", "bin", "cmd", "com", "dll", "exe", "js", "msi", "ps1", "scr", "sh", "vbs",
)

# Patterns of the content rules. "(?iU)" makes them case-blind and
# Unicode-aware; the leading look-ahead only rejects impossible starts quickly.
SCRIPT_PATTERN = (
    r"(?iU)(?=[<jo])(?:<\s*(?:script|iframe|object|embed)\b|javascript\s*:"
    r"|\bon(?:error|click)\s*=)"
)
COMMAND_PATTERN = (
    r"(?iU)(?=[cpbnw])\b(?:cmd\.exe|powershell|bash\s+-i|nc\s+-e|wget\s+|curl\s+)\b"
)
URL_PATTERN = r"(?iU)https?://[^\s,]+"
BASE64_PATTERN = r"(?U)\b[A-Za-z0-9+/]{80,}={0,2}\b"
DANGEROUS_FORMULAS = r"cmd|hyperlink|webservice|importxml"

LONG_LINE = 100_000
CONTROL_SHARE = 0.05

# Characters that end a line.
_LINE_BREAKS = r"\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029"
_BLANK = rf"[\s&&[^{_LINE_BREAKS}]]"
# A cell starts at the text start, after a comma or after a line break; white
# space, then double quotes, then single quotes are skipped before it.
_FORMULA_CELL = (
    rf"(?iU)(?:^|[,{_LINE_BREAKS}]){_BLANK}*+\"*+'*+{_BLANK}*+"
    rf"(?:={_BLANK}*(?:{DANGEROUS_FORMULAS})\b|[=+\-@])"
)
_UNPRINTABLE = r"[[\p{C}\p{Z}]&&[^ \n\r\t]]"

# Issue texts, their scores, and the advice per status.
ISSUES: dict[str, tuple[str, int]] = {
    "null_bytes": ("File contains null bytes", 100),
    "not_utf8": ("CSV must be valid UTF-8 text", 100),
    "control": ("File contains too many control characters", 100),
    "long_rows": ("File contains unusually long rows", 20),
    "script": ("Potential HTML or JavaScript injection detected", 30),
    "dangerous_formula": ("Dangerous spreadsheet formula detected", 45),
    "formula": ("CSV formula injection pattern detected", 20),
    "command": ("Suspicious command string detected", 40),
    "url": ("Embedded URL detected", 10),
    "base64": ("Embedded base64-looking payload detected", 20),
}
BLOCK_SCORE = 70
ADVICE = {
    "blocked": "Do not analyse this file. Replace it with a clean CSV.",
    "warning": "Review issues before analysis and clean suspicious cells.",
    "safe": "File passed scanner checks and can be analysed.",
}


# A match that white space parts may lie on two lines: how the first ends, how the
# next that is not blank goes on, and the rule that then holds.
_PARTED = (
    (r"<", r"(?:script|iframe|object|embed)\b", "script"),
    (r"javascript", r":", "script"),
    (r"\bon(?:error|click)", r"=", "script"),
    (r"\bbash", r"-i\b", "command"),
    (r"\bnc", r"-e\b", "command"),
    (r"\b(?:wget|curl)", r"\w", "command"),
)
PARTED_RULES = tuple(rule for _, _, rule in _PARTED)

# What every text holds for which a rule can be true, for a linear matcher that knows
# white space and letter case of ASCII alone: white space is any control character or
# one beyond ASCII, and texts with letters that fold to ASCII ones are always candidates.
_GAP = r"[\x00-\x20\x{80}-\x{10ffff}]"
_FOLDED = r"[\x{130}\x{131}\x{17f}\x{212a}]"
_CANDIDATES = {
    "control": r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{a0}\x{ad}\x{250}-\x{10ffff}]",
    "script": rf"(?i:<{_GAP}*(?:script|iframe|object|embed)|javascript{_GAP}*:|on(?:error|click){_GAP}*=)|{_FOLDED}",
    "formula": rf"(?:^|[,\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}])(?:{_GAP}|[\"'])*[=+\-@]",
    "command": rf"(?i:cmd\.exe|powershell|bash{_GAP}+-i|nc{_GAP}+-e|(?:wget|curl){_GAP})|{_FOLDED}",
    "url": rf"(?i:https?://)|{_FOLDED}",
    "base64": r"[A-Za-z0-9+/]{80}",
}


def candidate_rules(text: Column) -> Column:
    """The rules of ``_CANDIDATES`` that may be true for a text, as bits; the others are false or, for a null text, null."""

    @F.arrow_udf("int")
    def bits(texts: pa.Array) -> pa.Array:
        found = pa.array([0] * len(texts), pa.int32())
        for k, pattern in enumerate(_CANDIDATES.values()):
            hit = pc.match_substring_regex(texts, pattern).cast(pa.int32())
            found = pc.bit_wise_or(found, pc.multiply(hit, pa.scalar(1 << k, pa.int32())))
        return found

    # Bytes that are no text are left to the rules.
    return F.when(F.is_valid_utf8(text), bits(text)).otherwise((1 << len(_CANDIDATES)) - 1)


def where_candidate(bits: Column, rule: str, value: Column, other: Column | None = None) -> Column:
    """``value``, worked out only where ``candidate_rules`` names the rule."""
    no = F.lit(False) if other is None else other
    return F.when(bits.bitwiseAND(1 << list(_CANDIDATES).index(rule)) != 0, value).otherwise(no)


def blank_line(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*\z")


def opened(line: Column) -> Column:
    """The number of the parted pattern whose first part ends a line, or -1."""
    number = F.lit(-1)
    for k, (first, _, _) in enumerate(_PARTED):
        number = F.when(line.rlike(rf"(?iU){first}\s*\z"), k).otherwise(number)
    return number


def closed(line: Column) -> Column:
    """The parted patterns whose second part begins a line, as bits."""
    bits = [F.when(line.rlike(rf"(?iU)^\s*{second}"), 1 << k).otherwise(0) for k, (_, second, _) in enumerate(_PARTED)]
    return reduce(add, bits)


def has_script(text: Column) -> Column:
    return text.rlike(SCRIPT_PATTERN)


def has_command(text: Column) -> Column:
    return text.rlike(COMMAND_PATTERN)


def has_url(text: Column) -> Column:
    return text.rlike(URL_PATTERN)


def has_base64_run(text: Column) -> Column:
    return text.rlike(BASE64_PATTERN)


def has_long_line(text: Column) -> Column:
    """Any line above LONG_LINE characters; short texts skip the line split."""
    # That "\r\n" ends two lines here makes none longer.
    lengths = F.transform(F.split(text, rf"[{_LINE_BREAKS}]"), F.length)
    return (F.length(text) > LONG_LINE) & (F.array_max(lengths) > LONG_LINE)


def formula_kind(text: Column) -> Column:
    """'dangerous_formula', 'formula' or NULL by the first formula-like cell."""
    hit = F.regexp_extract(text, _FORMULA_CELL, 0)
    return F.when(hit.rlike(rf"(?i)(?:{DANGEROUS_FORMULAS})$"), "dangerous_formula").when(
        hit != "", "formula"
    )


def has_null_byte(text: Column) -> Column:
    return F.contains(text, F.lit("\x00"))


def unprintable_count(text: Column) -> Column:
    """Control and odd separator characters; tab and line ends are fine."""
    return F.length(text) - F.length(F.regexp_replace(text, _UNPRINTABLE, ""))


def unprintable_share(text: Column) -> Column:
    """Their share of all characters."""
    return F.coalesce(F.try_divide(unprintable_count(text), F.length(text)), F.lit(0.0))


def filename_issue(name: Column) -> Column:
    """The first broken filename rule as text, or NULL for a safe CSV name."""
    stem = F.regexp_replace(F.lower(name), r"^\.+", "")
    suffixes = F.when(stem.endswith("."), F.array().cast("array<string>")).otherwise(
        F.slice(F.split(stem, r"\."), F.lit(2), F.greatest(F.size(F.split(stem, r"\.")), F.lit(1)))
    )
    blocked = F.arrays_overlap(suffixes, F.array(*(F.lit(e) for e in BLOCKED_EXTENSIONS)))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "Filename is required")
        .when(has_null_byte(name), "Filename contains a null byte")
        .when(F.contains(name, F.lit("/")) | (name == "."), "Filename must not contain path separators")
        .when(F.contains(name, F.lit("..")), "Path traversal is not allowed")
        .when(
            (F.size(suffixes) == 0) | (F.element_at(suffixes, -1) != "csv"),
            "Only .csv files are allowed",
        )
        .when(blocked, "Executable or script extensions are blocked")
    )


def clean_filename(name: Column) -> Column:
    """Name reduced to ``[A-Za-z0-9._-]``, ends stripped of ``.`` and ``_``.

    NULL for an unsafe name or one with nothing left.
    """
    cleaned = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(filename_issue(name).isNull() & (cleaned != ""), cleaned)
