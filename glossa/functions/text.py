"""Column-expression builders for text: lines, tokens, sentences, patterns.

All of these are native Spark expressions (codegen or compiled higher-order
functions); none crosses into Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's libraries for identical results):
# ASCII punctuation used by chrF++ to split a leading/trailing mark off a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Default negation pattern of the error analysis.
NEGATION_PATTERN = r"(.+?) (not) (.+)"
# Sentence boundary: whitespace after a terminal mark.
SENTENCE_SPLIT = r"(?<=[.!?])\s+"
# Token budgets of the preparation step: source 512, target 128.
MAX_SOURCE_LEN = 512
MAX_TARGET_LEN = 128


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text) -> Column:
    """Split on newline, keep lines whose trimmed length is > 0 (0-based array)."""
    return F.filter(F.split(_col(text), "\n"), lambda x: F.length(F.trim(x)) > 0)


def tokens(text) -> Column:
    """Whitespace tokens without empties; empty/blank text gives ``[]``."""
    return F.filter(F.split(F.trim(_col(text)), r"\s+"), lambda x: x != "")


def rouge_tokens(text) -> Column:
    """ROUGE normalisation: lower case, every run outside [a-z0-9] becomes a space."""
    norm = F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " ")
    return F.filter(F.split(norm, " "), lambda x: x != "")


def sentences(text) -> Column:
    """Rule-based sentence split of the stripped text."""
    return F.filter(F.split(F.trim(_col(text)), SENTENCE_SPLIT), lambda x: x != "")


def sentences_joined(text) -> Column:
    return F.array_join(sentences(text), "\n")


def chrf_words(text) -> Column:
    """chrF++ words: whitespace tokens with one trailing (checked first) or
    leading punctuation mark split off; one-character words stay whole."""
    punct = F.lit(PUNCTUATION)

    def split_word(w: Column) -> Column:
        last = F.substring(w, -1, 1)
        first = F.substring(w, 1, 1)
        return (
            F.when(F.length(w) == 1, F.array(w))
            .when(punct.contains(last), F.array(w.substr(F.lit(1), F.length(w) - 1), last))
            .when(punct.contains(first), F.array(first, w.substr(F.lit(2), F.length(w))))
            .otherwise(F.array(w))
        )

    return F.flatten(F.transform(tokens(text), split_word))


def required_literal(pattern: str) -> str | None:
    """The literal every match of a ``(.+?) (word) (.+)`` pattern contains
    (`` word ``), else None. Java's backtracking engine spends O(n²) on a long
    text without a match of such a pattern (every start position expands the
    lazy group to the end); an ``instr`` guard on the literal skips exactly
    those texts, whose result is known to be no match."""
    m = re.fullmatch(r"\(\.\+\?\) \(([A-Za-z]+)\) \(\.\+\)", pattern)
    return f" {m.group(1)} " if m else None


def _guarded(text: Column, pattern: str, expr: Column, empty: Column) -> Column:
    lit = required_literal(pattern)
    return expr if lit is None else F.when(F.instr(text, lit) == 0, empty).otherwise(expr)


def count_matches(text, pattern: str = NEGATION_PATTERN) -> Column:
    """Non-overlapping matches per string (G1). ``(?d)`` restricts Java's line
    terminators to ``\\n`` so ``.`` behaves as in Python ``re``."""
    t = _col(text)
    return _guarded(t, pattern, F.regexp_count(t, F.lit("(?d)" + pattern)), F.lit(0))


def match_group(text, idx: int, pattern: str = NEGATION_PATTERN) -> Column:
    """Capture group ``idx`` of the first match (G2); '' when no match."""
    t = _col(text)
    return _guarded(t, pattern, F.regexp_extract(t, "(?d)" + pattern, idx), F.lit(""))
