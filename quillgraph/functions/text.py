"""Text functions as Column expressions: they stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARRAY_OF_TRIPLES = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,confidence:double,source_text:string>>"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Python's ``strip``: white space by Unicode at both ends; most texts have none, which their ends show."""
    plain = lambda e: F.ascii(e).between(33, 126)
    return F.when(plain(c(x)) & plain(F.right(c(x), F.lit(1))), c(x)).otherwise(F.regexp_replace(c(x), r"(?U)^\s+|\s+$", ""))


def words(x: Column | str) -> Column:
    """tokens between white space (Unicode)."""
    return F.filter(F.split(c(x), r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(words(x))


def tokenize(x: Column | str) -> Column:
    """CJK characters first, then identifiers of two characters or more, in lower case."""
    han = F.regexp_extract_all(c(x), F.lit("[\\u4e00-\\u9fff]"), F.lit(0))
    names = F.transform(F.regexp_extract_all(c(x), F.lit("[a-zA-Z_][a-zA-Z0-9_]{1,}"), F.lit(0)), F.lower)
    return F.concat(han, names)


def normalize_name(x: Column | str) -> Column:
    """F2: lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(c(x)), r"[^\p{L}\p{N}_]", "")


def similarity(a: Column, b: Column) -> Column:
    """one minus edit distance over the longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """R1."""
    return similarity(normalize_name(a), normalize_name(b))


def safe_filename(x: Column | str) -> Column:
    """letters, digits, underscores, dashes; white space becomes one underscore."""
    kept = F.regexp_replace(c(x), r"(?U)[^\p{L}\p{N}_\s-]", "")
    joined = F.regexp_replace(strip(kept), r"(?U)\s+", "_")
    return F.when(joined == "", F.lit("unknown_entity")).otherwise(joined)


def remote_filename(x: Column | str) -> Column:
    """F4, the connector's form: what is neither alphanumeric nor one of `` _-.`` becomes an underscore."""
    return strip(F.regexp_replace(c(x), r"[^\p{L}\p{N} _.-]", "_"))


def source_of_chunk(x: Column | str) -> Column:
    """what stands before the last ``_chunk_``, else before the last ``_row_``, else null."""
    before = lambda mark: F.substring(c(x), F.lit(1), F.length(c(x)) - F.length(F.substring_index(c(x), mark, -1)) - len(mark))
    return F.when(c(x).contains("_chunk_"), before("_chunk_")).when(c(x).contains("_row_"), before("_row_"))


def parse_triples(raw: Column | str) -> Column:
    """the widest bracketed JSON array in an answer; null where there is none or it is broken."""
    return F.from_json(F.nullif(F.regexp_extract(c(raw), r"(?s)\[.*\]", 0), F.lit("")), ARRAY_OF_TRIPLES)


def render_types(types: Column | str) -> Column:
    """F11."""
    return F.array_join(F.array_sort(c(types)), ", ")


def parse_types(x: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(c(x), F.lit("")), r"\s*,\s*"), lambda t: F.trim(t) != "")))


def idf(n: Column, df: Column) -> Column:
    """F12."""
    return F.log((n + 1) / (df + 1)) + 1


def dense_cosine(a: Column, b: Column) -> Column:
    """F13 for arrays: norms are clipped from below."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-10))
    return dot(a, b) / (norm(a) * norm(b))


def shorten(x: Column | str, n: int, tail: str = "") -> Column:
    """the first n characters; the tail where something was cut."""
    return F.when(F.length(c(x)) > n, F.concat(F.substring(c(x), 1, n), F.lit(tail))).otherwise(c(x))


def cypher_quote(x: Column | str) -> Column:
    """F16."""
    return F.replace(F.coalesce(c(x), F.lit("")), F.lit("'"), F.lit("\\'"))


def xml_escape(x: Column | str) -> Column:
    out = F.coalesce(c(x), F.lit(""))
    # XML 1.0 has no control characters but tab and line ends
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_chain(edges: Column | str) -> Column:
    """``u --[R]--> v`` joined by arrows."""
    return F.array_join(F.transform(c(edges), lambda e: F.concat(e["from"], F.lit(" --["), e["relation"], F.lit("]--> "), e["to"])), " → ")


def parse_path_query(text: str) -> tuple[str, str] | None:
    """source and target of ``A > B`` or ``A → B``."""
    parts = text.replace(">", "→").split("→")
    return (parts[0].strip(), parts[1].strip()) if len(parts) == 2 else None


def two_places(x: Column | str) -> Column:
    """A number with two digits after the point, rounded by its exact binary value (ties to even).

    200 x is held as the exact sum of two doubles (the products of its upper 24 bits and of the
    rest) and compared with the odd number at which the last digit changes.
    """
    v = c(x).cast("double")
    a = F.abs(v)
    low = F.floor(a * 100).cast("double")
    upper = a.cast("float").cast("double")
    over = (upper * 200 - (low * 2 + 1)) + (a - upper) * 200
    up = (over > 0) | ((over == 0) & (low % 2 == 1))
    cents = (low + F.when(up, 1.0).otherwise(0.0)).cast("long")
    digits = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    signed = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), digits)
    # beyond this a double has fewer than two digits after the point to round
    return F.when(a < 1e9, signed).otherwise(F.format_string("%.2f", v))


def mime_of(path: Column | str) -> Column:
    """F20."""
    ext = F.lower(F.regexp_extract(c(path), r"\.([^.]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("webp", "bmp", "gif"), F.concat(F.lit("image/"), ext)).otherwise("image/png")
