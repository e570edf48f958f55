"""Text helpers used while reading rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space including line ends.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_blank(col: Column) -> Column:
    """Trim any white space, line ends included."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def path_basename(col: Column) -> Column:
    """Last component of a path, ignoring trailing slashes; `/` for the root."""
    return F.when(col.rlike("^/+$"), "/").otherwise(F.regexp_extract(col, "([^/]+)/*$", 1))


def format_source(col: Column) -> Column:
    """`image symbol file:line` of a source struct, leaving out what is empty; null if all is."""
    place = F.when(col["line"] > 0, F.concat(col["file"], F.lit(":"), col["line"].cast("string"))).otherwise(col["file"])
    parts = [
        F.nullif(col["image"], F.lit("")),
        F.nullif(col["symbol"], F.lit("")),
        F.when(col["file"] != "", place),
    ]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def split_csv(col: Column) -> Column:
    """Comma-separated text as trimmed, non-empty tokens; null gives an empty array."""
    tokens = F.transform(F.split(col, ","), lambda t: F.regexp_replace(t, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", ""))
    return F.coalesce(F.filter(tokens, lambda t: t != ""), F.array().cast("array<string>"))
