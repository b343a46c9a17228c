"""Text expressions shared by the operators, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends that Python's str.splitlines knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: A YAML-like block may stand at the head of a note.
FM_OPEN, FM_CLOSE = "---\n", "\n---\n"


# Fixed value: what Python's str.strip takes off.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(c, F.lit(BLANKS))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def split_lines(c: Column) -> Column:
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def letters_digits(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def percent_decode(c: Column) -> Column:
    """Percent decoding that keeps plus signs and broken escapes."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(c, F.lit("%")), F.url_decode(safe)).otherwise(c)


def frontmatter_end(c: Column) -> Column:
    """Position (1-based) just after a closed head block, 1 without one."""
    at = F.locate(FM_CLOSE, c, 5)
    return F.when(c.startswith(FM_OPEN) & (at > 0), at + 5).otherwise(F.lit(1))


def body(c: Column) -> Column:
    """The text after a closed head block."""
    return F.substring(c, frontmatter_end(c), F.length(c))


def normal_content(c: Column) -> Column:
    """Content for exact comparison: no head block, no trailing blanks, stripped."""
    return strip_ws(F.regexp_replace(body(newlines(c)), r"(?Umd)[\s&&[^\n]]+$", ""))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, without zone arithmetic."""
    s = F.extract(F.lit("SECOND"), c).cast("decimal(8,6)")
    return (
        F.unix_date(F.to_date(c)).cast("bigint") * F.lit(86_400_000_000)
        + F.hour(c).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(c).cast("bigint") * F.lit(60_000_000)
        + (s * F.lit(1_000_000)).cast("bigint")
    )
