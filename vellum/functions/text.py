"""Text scalar functions as pure Column expressions.

Everything here stays inside the JVM (built-in functions and higher-order array
functions), so the stages keep whole-stage code generation around them and never
ship text to Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# Sentence delimiter: a period followed by one space, or a run of newlines.
SENTENCE_SPLIT = r"\. |\n+"
# A sentence counts only when it has strictly more than this many words.
MIN_SENTENCE_WORDS = 10
# Boilerplate line prefixes, in the reference's order.
BOILERPLATE_PREFIXES = (
    " ",
    "Читайте на РБК Pro",
    "www.adv.rbc.ru",
    "Россия Москва Мир",
    "0 (за сутки)",
    "Читать подробнее",
    "Источник:",
    "Pro",
    "www",
)
# Lines that open the paid / footer section: kept text stops before the first of them.
SECTION_MARKERS = ("Читайте на РБК Pro", "Россия Москва Мир")
# Length of the article id inside a document id.
ARTICLE_ID_LENGTH = 24
# ---------------------------------------------------------------------------

# Python's ``str.split()`` whitespace (every code point with ``isspace()``); Java's
# ``\s`` alone is ASCII-only.
WS_CLASS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{WS_CLASS}]+"
WORD = f"[^{WS_CLASS}]+"
# The same set as characters, built from the rule itself (all lie at or below U+3000).
PY_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P1 ---------------------------------------------------------------------
def article_id(document_id: str | Column, length: int = ARTICLE_ID_LENGTH) -> Column:
    """First ``length`` characters of the id; shorter ids pass through."""
    return F.substring(col_(document_id), 1, length)


# --- T1 ---------------------------------------------------------------------
def text_length(text: str | Column) -> Column:
    """Length in code points (not bytes)."""
    return F.length(col_(text))


# --- T2 / T3 / T4 / A3 --------------------------------------------------------
def sentences(text: str | Column, pattern: str = SENTENCE_SPLIT) -> Column:
    """Split into sentences; delimiters dropped, empty parts kept."""
    return F.split(col_(text), pattern, -1)


def normalize_spaces(s: Column) -> Column:
    """Map every Python whitespace character to U+0020 (one pass, no regex)."""
    return F.translate(s, PY_SPACES, " " * len(PY_SPACES))


def tokens(s: Column) -> Column:
    """Whitespace-separated tokens; runs of spaces leave empty strings between them."""
    return F.split(normalize_spaces(s), " ", -1)


def word_count(s: Column) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``).

    Translating the whitespace set to plain spaces and splitting on one literal
    character is several times faster than a Unicode character-class regex.
    """
    return F.size(F.filter(tokens(s), lambda w: w != ""))


def long_sentence_lengths(text: str | Column, min_words: int = MIN_SENTENCE_WORDS,
                          pattern: str = SENTENCE_SPLIT) -> Column:
    """Word counts of sentences with more than ``min_words`` words, in text order."""
    counts = F.transform(sentences(text, pattern), word_count)
    return F.filter(counts, lambda n: n > F.lit(min_words))


def _length_stats(lens: Column) -> dict[str, Column]:
    """avg / max / min and count of an array of lengths; 0 when it is empty."""
    n = F.size(lens)
    total = F.aggregate(lens, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return {
        "avg_sentence_len": F.when(n > 0, total / n).otherwise(F.lit(0.0)),
        "max_sentence_len": F.coalesce(F.array_max(lens), F.lit(0)),
        "min_sentence_len": F.coalesce(F.array_min(lens), F.lit(0)),
        "n_long_sentences": n.cast("long"),
    }


def sentence_stats(text: str | Column, min_words: int = MIN_SENTENCE_WORDS,
                   pattern: str = SENTENCE_SPLIT) -> dict[str, Column]:
    """avg / max / min words of long sentences; every value is 0 when there is none."""
    return _length_stats(long_sentence_lengths(text, min_words, pattern))


# --- P9 / T5 - T9 -----------------------------------------------------------
#: Prefix lists longer than this are looked up by length instead of chained.
CHAINED_PREFIXES = 32


def starts_with_any(line: Column, prefixes: Sequence[str]) -> Column:
    """Whether a line begins with one of the prefixes (false for an empty list).

    A few are an OR of ``startswith``.  Many are one set lookup per distinct prefix length: the
    line's first characters in a hash set, however many prefixes have that length.
    """
    if len(prefixes) > CHAINED_PREFIXES:
        return starts_with_set(line, prefixes)
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | line.startswith(p)
    return cond


def starts_with_set(line: Column, prefixes: Sequence[str]) -> Column:
    """The same by hash lookup of the line's first characters, one for each prefix length."""
    by_length: dict[int, list[str]] = {}
    for p in sorted(set(prefixes)):
        by_length.setdefault(len(p), []).append(p)
    cond = F.lit(False)
    for n, group in sorted(by_length.items()):
        cond = cond | (line.isNotNull() if n == 0 else F.substring(line, 1, n).isin(group))
    return F.when(line.isNotNull(), cond)


def lines(text: str | Column) -> Column:
    """Split on ``\\n`` exactly; empty lines kept."""
    return F.split(col_(text), "\n", -1)


def is_kept_line(line: Column, prefixes: Sequence[str] = BOILERPLATE_PREFIXES) -> Column:
    """A line survives if it has no boilerplate prefix and more than one token.

    Tokens are taken after trimming spaces (only U+0020) and splitting on single spaces,
    so the line has one token exactly when the trimmed line holds no space.
    """
    one_token = ~F.btrim(line, F.lit(" ")).contains(" ")
    return ~starts_with_any(line, prefixes) & ~one_token


def cleaned_text_features(text: str | Column,
                          prefixes: Sequence[str] = BOILERPLATE_PREFIXES,
                          markers: Sequence[str] = SECTION_MARKERS) -> dict[str, Column]:
    """Boilerplate removal and the cleaned-text lengths / ratio.

    ``full_cleaned_text`` joins every kept line; the "before" text keeps only the lines
    that precede the first marker line (all lines when there is no marker).
    """
    return cleaned_text_features_from_lines(lines(text), prefixes, markers)


# --- T11 --------------------------------------------------------------------
def flatten_once(nested: str | Column) -> Column:
    """List of lists -> list (one level)."""
    return F.flatten(col_(nested))


# --- DataFrame-level helpers: compute each array once per row ---------------
def with_sentence_stats(df, text_col: str = "text", min_words: int = MIN_SENTENCE_WORDS,
                        pattern: str = SENTENCE_SPLIT):
    """Add avg / max / min (and count of) long-sentence word counts.

    The word-count array is a column of its own, so the four statistics read it
    instead of re-splitting the text (the optimizer keeps a non-cheap producer that
    is referenced several times in its own projection).
    """
    lens = "__lens"
    out = df.withColumn(lens, long_sentence_lengths(text_col, min_words, pattern))
    return out.withColumns(_length_stats(F.col(lens))).drop(lens)


def with_cleaned_text(df, text_col: str = "text",
                      prefixes: Sequence[str] = BOILERPLATE_PREFIXES,
                      markers: Sequence[str] = SECTION_MARKERS):
    """Add the four cleaned-text columns; the line array is split once per row.

    An empty text (of an article without a page, so of most) keeps no line: its values are written down.
    """
    ls_name = "__lines"
    out = df.withColumn(ls_name, lines(text_col))
    feats = cleaned_text_features_from_lines(F.col(ls_name), prefixes, markers)
    empty = F.col(text_col) == ""
    return out.withColumns({k: F.when(empty, F.lit(EMPTY_CLEANED[k])).otherwise(v) for k, v in feats.items()}).drop(ls_name)


EMPTY_CLEANED = {"full_cleaned_text": "", "before_pro_text_ratio": 0.0, "cleaned_text_length": 0,
                 "cleaned_text_before_pro_length": 0}


def cleaned_text_features_from_lines(ls: Column, prefixes: Sequence[str] = BOILERPLATE_PREFIXES,
                                     markers: Sequence[str] = SECTION_MARKERS) -> dict[str, Column]:
    if markers:
        marker_pos = F.array_position(F.transform(ls, lambda l: starts_with_any(l, markers)),
                                      True)
        before = F.when(marker_pos == 0, ls).otherwise(F.slice(ls, F.lit(1), marker_pos - 1))
    else:
        before = ls
    keep = lambda l: is_kept_line(l, prefixes)
    full_text = F.concat_ws(" ", F.filter(ls, keep))
    before_len = F.length(F.concat_ws(" ", F.filter(before, keep)))
    full_len = F.length(full_text)
    return {
        "full_cleaned_text": full_text,
        "before_pro_text_ratio": before_len / F.greatest(F.lit(1), full_len),
        "cleaned_text_length": full_len,
        "cleaned_text_before_pro_length": before_len,
    }
