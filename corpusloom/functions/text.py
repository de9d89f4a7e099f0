"""Text functions as Column expressions; all run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def normalize_text(col: Column) -> Column:
    """Join hyphenated line ends, single newlines to spaces, blank lines to one, strip, then collapse blanks: in this order."""
    col = F.regexp_replace(col, r"(?U)(\w)-\n(\w)", "$1$2")
    col = F.regexp_replace(col, r"(?<!\n)\n(?!\n)", " ")
    col = strip(F.regexp_replace(col, r"(?U)\n\s*\n+", "\n\n"))
    return F.regexp_replace(col, r"[ \t]+", " ")


def token_len(col: Column) -> Column:
    """Words and single signs; pass another counter where a model's tokens are wanted."""
    return F.size(F.regexp_extract_all(col, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def sentences(col: Column) -> Column:
    """Stripped, non-blank sentences: cut behind . ! ? and white space."""
    return F.filter(F.transform(F.split(col, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def preview(col: Column, n: int = 80, ellipsis: bool = True) -> Column:
    """One line of at most n characters."""
    one = F.regexp_replace(strip(col), "\n", " ")
    cut = F.substring(one, 1, n)
    return F.when(F.length(one) > n, F.concat(cut, F.lit("…"))).otherwise(one) if ellipsis else cut


def parse_storage_uri(col: Column) -> Column:
    """struct(bucket, path, file_type); null where there is no path."""
    uri = F.regexp_replace(strip(col), "^bucket:", "")
    mark = "/storage/v1/object/"
    stored = F.regexp_extract(uri, mark + r"[^/]*/([^/]*)/", 1), F.split_part(F.regexp_extract(uri, f"(?s){mark}[^/]*/[^/]*/(.*)$", 1), F.lit("?"), F.lit(1))
    plain = F.regexp_extract(uri, r"(?s)^([^/]*)/", 1), F.regexp_extract(uri, r"(?s)^[^/]*/(.*)$", 1)
    is_stored, ok = uri.contains(mark), F.when(uri.contains(mark), uri.rlike(mark + "[^/]*/[^/]*/")).otherwise(uri.contains("/"))
    bucket, path = (F.when(is_stored, a).otherwise(b) for a, b in zip(stored, plain, strict=True))
    kind = F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")
    return F.when(ok, F.struct(bucket.alias("bucket"), path.alias("path"), kind.alias("file_type")))


def sanitize_key(col: Column) -> Column:
    """A storage key: signs and blanks of the stem become single underscores, none at its ends."""
    dot = F.regexp_extract(col, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(col, r"(?s)^(.*)\.([^.]*)$", 2)
    stem, ext = F.when(col.contains("."), dot[0]).otherwise(col), F.when(col.contains("."), dot[1]).otherwise("")
    # Characters that a storage key may not hold.
    stem = F.regexp_replace(stem, r"(?U)[\s\[\](),!@#$%^&+={}|;:'\"<>?]+", "_")
    stem = F.regexp_replace(F.regexp_replace(stem, "_+", "_"), "^_+|_+$", "")
    return F.when(ext != "", F.concat(stem, F.lit("."), ext)).otherwise(stem)


def merge_text(a: Column, b: Column) -> Column:
    """a, and b below it unless a holds it already; nulls are empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((b == "") | a.contains(b), a).when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))


def vtt_seconds(col: Column) -> Column:
    """Seconds of [h+:]mm:ss.mmm (or a comma); null where it is no time."""
    pattern = r"^(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"
    part = lambda k: F.regexp_extract(strip(col), pattern, k)
    hours = F.when(part(1) != "", part(1).cast("double")).otherwise(0.0)
    total = hours * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + part(4).cast("double") / 1000
    return F.when(strip(col).rlike(pattern), total)


def depth_tier(n: Column) -> Column:
    return F.when(n >= 10, "deep").when(n >= 4, "comprehensive").when(n >= 1, "developing").otherwise("foundational")


def numbered_texts(col: Column, label: str, skip_blank: bool = True, glue: str = "\n") -> Column:
    """[label i] text for each of an array of texts, numbered before blanks are dropped."""
    lines = F.transform(col, lambda t, i: F.struct(t.alias("t"), F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("]" + glue), F.coalesce(t, F.lit(""))).alias("line")))
    kept = F.filter(lines, lambda x: strip(F.coalesce(x["t"], F.lit(""))) != "") if skip_blank else lines
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n\n---\n\n")
