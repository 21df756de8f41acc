"""Column helpers that reproduce PostgreSQL/JavaScript value rules in Spark.

All are built-in expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted by PostgreSQL's boolean input (case-insensitive,
# surrounding space ignored, unique prefixes of the words allowed).
PG_TRUE = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
PG_FALSE = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")


def pg_bool(text: Column) -> Column:
    """``text::boolean``: TRUE/FALSE, NULL for NULL input, and NULL for bad text.

    Use :func:`pg_bool_valid` to tell a NULL input from unparseable text.
    """
    t = F.lower(F.trim(text))
    return F.when(t.isin(*PG_TRUE), True).when(t.isin(*PG_FALSE), False)


def pg_bool_valid(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*PG_TRUE, *PG_FALSE)


def pg_int(text: Column) -> Column:
    """``text::int``: integer text with optional sign and surrounding space."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def pg_int_valid(text: Column) -> Column:
    return text.isNull() | pg_int(text).isNotNull()


def nullif_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def nullif_trim(text: Column) -> Column:
    """``nullif(trim(coalesce(x, '')), '')``."""
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))


def pg_text(c: Column) -> Column:
    """Value as PostgreSQL's ``RAISE ... %`` prints it: NULL shows as ``<NULL>``."""
    return F.coalesce(c.cast("string"), F.lit("<NULL>"))


def reservation_code(key: Column) -> Column:
    """``YR-`` + 6 upper-case hex digits.

    The reference draws them from a random uuid; we hash the request id so a
    retried request gets the same code.  Collisions are audited separately.
    """
    return F.concat(F.lit("YR-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6)))


def html_escape(c: Column, quotes: bool = True) -> Column:
    """Escape customer text for HTML: ``&`` first, then ``<``, ``>``, ``"``
    and (staff pages only) ``'``.  NULL becomes ''."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.replace(s, F.lit("&"), F.lit("&amp;"))
    if not quotes:
        # Lookup page order: & " < > (no single quote).
        s = F.replace(s, F.lit('"'), F.lit("&quot;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    s = F.replace(s, F.lit(">"), F.lit("&gt;"))
    if quotes:
        s = F.replace(s, F.lit('"'), F.lit("&quot;"))
        s = F.replace(s, F.lit("'"), F.lit("&#39;"))
    return s


def yen(n: Column) -> Column:
    """``"¥" + n.toLocaleString("ja-JP")``: thousands separated by commas."""
    return F.concat(F.lit("¥"), F.format_number(n.cast("long"), 0))


def safe_asset_name(name: Column) -> Column:
    """Upload file name: every UTF-16 unit outside ``[a-zA-Z0-9._-]`` becomes ``_``.

    JavaScript replaces per UTF-16 unit, so a character outside the BMP (two
    units) becomes two underscores; Java's regex works on code points.
    """
    astral = F.regexp_replace(name, r"[\x{10000}-\x{10FFFF}]", "__")
    return F.regexp_replace(astral, r"[^a-zA-Z0-9._-]", "_")
