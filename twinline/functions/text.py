"""Text column functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that the strip rule counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Line breaks beyond CR and LF that cut a line in two.
EXTRA_LINE_BREAKS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# The special tokens, whose ids are 0 to 3 in this order.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]")
PAD, UNK, SOS, EOS = 0, 1, 2, 3

_SPECIAL = r"\[(?:PAD|UNK|SOS|EOS)\]"
_WORDS = r"(?U)\w+|[^\w\s]+"
_WORDS_OR_SPECIAL = rf"(?U){_SPECIAL}|\w+|(?:(?!{_SPECIAL})[^\w\s])+"

# The replacements of the standard "13a" scoring tokeniser, in order.
_13A_LITERALS = (("<skipped>", ""), ("-\n", ""), ("\n", " "),
                 ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_13A_PATTERNS = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def strip_text(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize(text: Column) -> Column:
    """Lower-case, character by character: a final capital sigma becomes a plain one."""
    return F.lower(F.translate(text, "Σ", "σ"))


def pre_tokenize(text: Column) -> Column:
    """Array of word runs and of runs of other non-space characters."""
    return F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))


def words_for_encoding(text: Column) -> Column:
    """Pre-tokens of raw text, lower-cased, with literal special tokens kept whole.

    The costlier pattern that looks for special tokens runs only on texts that have one.
    """
    raw = F.regexp_extract_all(F.translate(text, "Σ", "σ"), F.lit(_WORDS_OR_SPECIAL), F.lit(0))
    kept = F.transform(raw, lambda w: F.when(w.isin(*SPECIAL_TOKENS), w).otherwise(F.lower(w)))
    has_special = F.lit(False)
    for token in SPECIAL_TOKENS:
        has_special = has_special | F.contains(text, F.lit(token))
    return F.when(has_special, kept).otherwise(pre_tokenize(normalize(text)))


def split_physical_lines(text: Column) -> Column:
    """Array of the lines of a text (CRLF, CR or LF)."""
    return F.split(text, r"\r\n|\r|\n")


def bleu_tokenize_13a(text: Column) -> Column:
    """Array of scoring tokens; case is kept."""
    for old, new in _13A_LITERALS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in _13A_PATTERNS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.split(text, f"[{WHITESPACE}]+"), lambda t: t != "")
