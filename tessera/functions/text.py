"""Row-local text functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

Name = Column | str


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Name) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def matches(c: Name, one: str) -> Column:
    """How many characters of a text the pattern ``one`` of a single character matches: what is missing without its runs."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"{one}+", ""))


def is_missing(c: Name) -> Column:
    """Null, empty string or empty collection; zero and false are values."""
    return col(c).isNull() | (col(c) == "")


# ---------------------------------------------------------------- line quality


@dataclass(frozen=True)
class QualityConfig:
    symbol_ratio: float = 0.45
    digit_ratio: float = 0.45
    keep_score: float = 0.30
    structured_bonus: float = 0.70


#: What makes a line structured text.
STRUCTURED = (
    r"^\s*[-*•]\s+\S+",
    r"^\s*#{1,6}\s+\S+",
    r"^\s*[A-Za-z0-9_#.\-$ ]{2,80}\s*[:=]\s*\S+",
    r'^\s*"?[A-Za-z0-9_#.\-$ ]+"?\s*:\s*',
    r"^\s*\S.*?\s{2,}\S.*$",
)
#: A word, a number, and lines of nothing but numbers, hexadecimal digits or base64 digits.
WORD = r"[\p{L}\p{Nl}\p{No}]{2,}"
_NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
NUMERIC_ARRAY = rf"^\s*{_NUMBER}(?:[\s,;]+{_NUMBER}){{5,}}\s*$"
HEX_LINE, BASE64_LINE = r"^[0-9a-fA-F\s:,-]{40,}$", r"^[A-Za-z0-9+/=_-]{80,}$"


def looks_structured(c: Name) -> Column:
    c = col(c)
    out = F.lit(False)
    for p in STRUCTURED:
        out = out | c.rlike(p)
    return (F.length(c) <= 300) & out


def char_runs(c: Name) -> Column:
    """How often each distinct character stands in a text: runs of the text's sorted characters."""
    return F.transform(F.regexp_extract_all(F.array_join(F.array_sort(F.split(col(c), "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0)), lambda run: F.length(run))


def entropy_of(runs: Column, n: Column) -> Column:
    """Shannon entropy in bits of counts that sum to ``n``."""
    return F.aggregate(runs, F.lit(0.0), lambda acc, m: acc - m / n * F.log2(m / n))


def char_entropy(c: Name) -> Column:
    """Shannon entropy over characters in bits: the characters are sorted once."""
    return entropy_of(char_runs(c), F.length(col(c)))


@F.pandas_udf(StructType([StructField("entropy", DoubleType()), StructField("n_kinds", LongType())]))
def text_entropy(texts: pd.Series) -> pd.DataFrame:
    """Shannon entropy in bits and number of distinct characters of whole texts; null for null, 0 for empty."""
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None))
            continue
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.bincount(points) if len(points) and points.max() < 1 << 16 else np.unique(points, return_counts=True)[1]
        share = counts[counts > 0] / max(1, len(points))
        rows.append((float(-(share * np.log2(share)).sum()) + 0.0, len(share)))
    return pd.DataFrame(rows, columns=["entropy", "n_kinds"])


def control_ratio(c: Name) -> Column:
    """Share of control characters other than tab, line feed and carriage return."""
    c = col(c)
    return matches(c, r"[\p{C}&&[^\t\n\r]]") / F.greatest(F.length(c), F.lit(1))


def is_encoded_row(c: Name) -> Column:
    """A row of a compressed signal: long, starts with a digit, many letters among its characters."""
    c = col(c)
    dense = F.regexp_replace(c, r"\s+", "")
    return (F.length(c) >= 60) & ~c.rlike(r"^[#$]") & dense.rlike(r"^[0-9][0-9A-Za-z@+\-.]+$") & (matches(dense, r"[\p{L}@]") / F.greatest(F.lit(1), F.length(dense)) >= 0.35)


def is_noisy_payload(c: Name) -> Column:
    """Whether a chunk is mostly encoded rows: three of them with 45 % of its characters, or 65 % where a payload marker stands.

    Each line is judged once; one pass sums what the verdict needs.
    """
    parts = F.split(col(c), r"\r\n|\n|\r")
    start = F.struct(*(F.lit(0).alias(x) for x in ("lines", "chars", "rows", "dense")), F.lit(False).alias("marked"))

    def line(raw: Column) -> Column:
        s = strip(raw)
        return F.struct(F.length(s).alias("n"), is_encoded_row(s).alias("encoded"), F.upper(s).rlike("##XYDATA|##PEAKTABLE").alias("marked"))

    def add(a: Column, x: Column) -> Column:
        full, n = (x["n"] > 0).cast("int"), F.when(x["encoded"], x["n"]).otherwise(0)
        return F.struct((a["lines"] + full).alias("lines"), (a["chars"] + x["n"]).alias("chars"), (a["rows"] + x["encoded"].cast("int")).alias("rows"), (a["dense"] + n).alias("dense"), (a["marked"] | x["marked"]).alias("marked"))

    def verdict(a: Column) -> Column:
        share = a["dense"] / F.greatest(a["chars"], F.lit(1))
        return (a["lines"] >= 3) & (((a["rows"] >= 3) & (share >= 0.45)) | (a["marked"] & (share >= 0.65)))

    return F.coalesce(F.aggregate(F.transform(parts, line), start, add, verdict), F.lit(False))


# ---------------------------------------------------------------- normal forms


def normalise_evidence(c: Name) -> Column:
    """Lower case, single spaces, plain hyphens, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\s+", " "), "[‐-―]", "-"))


def normalise_chunk(c: Name) -> Column:
    """Unix line ends, tabs and controls to spaces, single spaces in lines, no spaces before line ends."""
    c = F.regexp_replace(F.regexp_replace(col(c), "\r\n?", "\n"), "[\\x00-\\x09\\x0B-\\x1F\\x7F]", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), " +\n", "\n"))


def normalise_label(c: Name) -> Column:
    return strip(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9%/+-]+", " "))


def slug(c: Name, limit: int = 64) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(body, 1, limit)


def index_token(c: Name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def escape_query(c: Name) -> Column:
    """Backslashes before characters that a full-text query language reads as operators."""
    return F.regexp_replace(col(c), r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def sanitise_path(c: Name) -> Column:
    return F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_")


# ---------------------------------------------------------------- tokens and values


def terms(c: Name, least: int = 3) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[^a-z0-9]+"), lambda x: F.length(x) >= least)


def search_words(c: Name) -> Column:
    """Lower-cased letters, digits and underscores, as the full-text index takes them."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def query_terms(c: Name, stop: Sequence[str] = ("the", "and", "for", "with", "from", "that", "this", "are", "was")) -> Column:
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9][a-z0-9_-]{2,}"), 0)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*stop)))


#: characters that count as one token where no tokenizer is at hand
CHARS_PER_TOKEN = 4


def estimated_tokens(c: Name) -> Column:
    return F.ceil(F.length(col(c)) / CHARS_PER_TOKEN).cast("long")


def truncate_tokens(c: Name, budget: int, marker: str = " [truncated]") -> Column:
    """At most ``budget`` estimated tokens; cut texts end with ``marker``."""
    c = col(c)
    room = max(0, budget * 4 - len(marker))
    return F.when(estimated_tokens(c) <= budget, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, room), r"\s+$", ""), F.lit(marker)))


def shorten(c: Name, limit: int = 500, marker: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - len(marker)), F.lit(marker))).otherwise(c)


def key_values(c: Name) -> Column:
    """array<struct(key, value)> of ``key = value`` and ``key: value`` lines."""
    line = r"(?m)^[ \t]*([A-Za-z0-9_#.$-]{2,80})[ \t]*[:=][ \t]*(\S[^\r\n]*)$"
    c = col(c)
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(line), 1).alias("key"), F.regexp_extract_all(c, F.lit(line), 2).alias("value"))


NUMBER_IN_TEXT = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def numbers(c: Name) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(NUMBER_IN_TEXT), 0), lambda x: x.try_cast("double"))


def first_number(c: Name) -> Column:
    return F.regexp_extract(col(c), NUMBER_IN_TEXT, 0).try_cast("double")


def range_bounds(c: Name) -> Column:
    """struct(low, high) of ``from a to b``, ``a to b``, ``a .. b``; null where there is none."""
    pattern = rf"(?:from\s+)?({NUMBER_IN_TEXT})\s*(?:to|\.\.|–)\s*({NUMBER_IN_TEXT})"
    a, b = (F.regexp_extract(F.lower(col(c)), pattern, k).try_cast("double") for k in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def first_date(c: Name) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"\b(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b", 1), F.lit(""))


#: Unit by the first needle that the text holds.
UNITS = (("mhz", "MHz"), ("khz", "kHz"), ("hz", "Hz"), ("ppm", "ppm"), ("kelvin", "K"), ("celsius", "°C"), ("percent", "%"), ("%", "%"), ("minute", "min"), ("second", "s"))


def infer_unit(c: Name) -> Column:
    low, out = F.lower(col(c)), F.lit(None).cast("string")
    for needle, unit in reversed(UNITS):
        out = F.when(low.contains(needle), F.lit(unit)).otherwise(out)
    return out


#: Hint names and what raises them.
HINTS = (
    ("activity", r"acquisition|processing|experiment"),
    ("agent", r"instrument|software|device|equipment|sensor"),
    ("condition", r"temperature|solvent|pressure|condition"),
    ("method", r"\b(method|procedure|protocol|plan|sampling)\b"),
    ("quantity", r"frequency|width|count|points|range|axis|threshold"),
    ("resource", r"file|format|download|license"),
)


def semantic_hints(c: Name) -> Column:
    low = F.lower(col(c))
    return F.array_sort(F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in HINTS))))


def ordered_distinct(*parts: Name) -> Column:
    """Parts that aren't empty, in order, joined by spaces; of parts that differ in case alone the first."""
    items = F.filter(F.array(*(strip(F.coalesce(col(p), F.lit(""))) for p in parts)), lambda x: x != "")
    first = F.filter(items, lambda x, k: F.array_position(F.transform(items, F.lower), F.lower(x)) == k + 1)
    return F.array_join(first, " ")


def negated(c: Name, keyword: str, reach: int = 40) -> Column:
    """Whether a negation stands at most ``reach`` characters before the first ``keyword``."""
    low = F.lower(col(c))
    at = F.instr(low, keyword)
    before = F.substring(low, F.greatest(F.lit(1), at - reach), F.least(F.lit(reach), F.greatest(at - 1, F.lit(0))))
    return (at > 0) & before.rlike(r"\b(no|not|without|lacks?|missing|absent)\b")


def context_lines(content: Name, needle: Name, around: int = 2) -> Column:
    """Lines within ``around`` of the one where ``needle`` starts; null where it isn't found."""
    content, needle = col(content), col(needle)
    at = F.instr(content, needle)
    lines = F.split(content, "\n")
    line = F.size(F.split(F.substring(content, F.lit(1), at), "\n"))
    first = F.greatest(F.lit(1), line - around)
    return F.when((at > 0) & (needle != ""), F.array_join(F.slice(lines, first, F.least(F.size(lines), line + around) - first + 1), "\n"))


# ---------------------------------------------------------------- files

#: File types by extension.
FILE_TYPES = {
    "archive": ("zip",),
    "table": ("csv", "xls", "xlsx", "ods"),
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "svg"),
}


def file_extension(path: Name) -> Column:
    path = col(path)
    return F.when(path.contains("."), F.lower(F.element_at(F.split(path, r"\."), -1))).otherwise(F.lit(""))


def file_type(extension: Name) -> Column:
    e = F.lower(F.regexp_replace(col(extension), r"^\.", ""))
    out = F.lit("plain_text")
    for kind, names in FILE_TYPES.items():
        out = F.when(e.isin(*names), F.lit(kind)).otherwise(out)
    return out


def package_id(name: Name, paths: Name) -> Column:
    return F.substring(F.sha2(F.concat(col(name), F.array_join(col(paths), "")), 256), 1, 8)


def chunk_group_id(path: Name) -> Column:
    return F.substring(F.sha2(col(path), 256), 1, 5)


def evidence_id(*parts: Name) -> Column:
    """``ev:`` and 16 hex digits of the SHA-1 over all parts."""
    return F.concat(F.lit("ev:"), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))), 1, 16))
