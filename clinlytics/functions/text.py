"""Text helpers for the retrieval layer, written with built-in functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinlytics.functions.core import strip_ws

# Words that never form a detected patient name (lower case).
NAME_STOPWORDS = (
    "cardiology", "gastroenterology", "hepatology", "medicine", "diagnosis",
    "patient", "show", "what", "which", "find", "list", "how", "who", "are",
    "is", "me", "the", "for", "with", "and", "or", "in", "on",
)
# Formats of the summary text the chunker reads.
HEADER_PREFIX = "PATIENT:"
VISIT_SPLIT = r"\n(?=VISIT [^\n]*\[)"
NAME_RE = r"(?U)PATIENT:\s*([^|]+)"
DATE_RE = r"(?U)\[(\d{4}-\d{2}-\d{2})\]"
ICD_RE = r"(?U)ICD-10:\s*([A-Z]\d+\.?\d*)"
FOLLOWUP_PREFIX = "Follow-up:"
NONBLANK = r"(?U)\S"


def words(text: Column) -> Column:
    """Whitespace-separated words (str.split() with no argument)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _name_word_ok(w: Column) -> Column:
    # array_contains, not isin: inside a lambda an IN list of this size is
    # evaluated as an interpreted set lookup, ten times slower
    stop = F.array(*[F.lit(x) for x in NAME_STOPWORDS])
    return ((F.length(w) > 2) & w.rlike(r"^\p{Lu}")
            & ~F.array_contains(stop, F.lower(w)))


def detect_name(query: Column) -> Column:
    """First pair of adjacent capitalised words (trailing '.,?' removed),
    both longer than 2 characters and not stop words, as 'W1 W2'; else NULL.
    """
    ws = F.transform(words(query), lambda w: F.regexp_replace(w, r"[.,?]+$", ""))
    n = F.size(ws)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(
        F.get(ws, i).alias("w1"), F.get(ws, i + 1).alias("w2")))
    hits = F.filter(pairs, lambda p: _name_word_ok(p["w1"]) & _name_word_ok(p["w2"]))
    first = F.get(hits, 0)
    return F.when(n >= 2, F.concat(first["w1"], F.lit(" "), first["w2"]))


def detect_name_columns(df, query_col: str, out: str = "detected_name"):
    """``detect_name`` as a column of a table of questions."""
    return df.withColumn(out, detect_name(F.col(query_col)))


def last_nonempty(arr: Column) -> Column:
    """Last non-empty string of an array, or '' (the 'last line wins' rule)."""
    return F.coalesce(F.try_element_at(F.filter(arr, lambda x: x != ""), F.lit(-1)), F.lit(""))


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NONBLANK))


def doctor_line(lines: Column) -> Column:
    """Last line that starts with 'Dr' (after whitespace) and has a comma."""
    return F.try_element_at(
        F.filter(lines, lambda line: line.contains(",") & strip_ws(line).startswith("Dr")), F.lit(-1))


def chunk_columns(lines: Column, header: Column, dr_line: Column) -> dict[str, Column]:
    """Metadata of one visit block from its non-blank lines, the header and
    its doctor line (pass ``doctor_line(lines)`` staged as a column)."""
    return {
        "patient_name": strip_ws(F.regexp_extract(header, NAME_RE, 1)),
        "visit_date": last_nonempty(F.transform(F.filter(lines, lambda line: line.contains("[")), lambda line: F.regexp_extract(line, DATE_RE, 1))),
        "department": F.coalesce(strip_ws(F.regexp_extract(dr_line, r"(?s)^[^,]*,(.*)$", 1)), F.lit("")),
        "doctor_name": F.coalesce(strip_ws(F.substring_index(dr_line, ",", 1)), F.lit("")),
        "diagnosis_codes": last_nonempty(F.transform(F.filter(lines, lambda line: line.contains("ICD-10:")), lambda line: F.regexp_extract(line, ICD_RE, 1))),
        "has_followup": F.exists(lines, lambda line: line.startswith(FOLLOWUP_PREFIX)),
    }
