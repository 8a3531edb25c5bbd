"""Text normalisation and tokenising as Column expressions (TX1-TX6, TX8, TX9).

Everything here is a built-in Spark expression, so it runs inside whole-stage
codegen (higher-order array functions run interpreted, still on the JVM).

Tokeniser contract (``stem=False``):

1. every punctuation char (not a Unicode word char or whitespace) and every
   ``\\n``, ``\\t``, ``\\r`` becomes one space;
2. strip spaces at both ends, split on runs of spaces;
3. drop any word with a non-ASCII char (the whole word, no folding);
4. lowercase;
5. drop stop words.

With ``stem=True`` step 4 is lowercase + Porter stem and step 5 runs on the
stemmed form; that path lives in ``operators.postings`` because the stemmer
is applied once per distinct word (see ``functions.porter``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop-word list that must equal the reference's for equal
# tokens (the English list shipped with a common NLP toolkit, plus the empty
# string), in its natural order.
STOP_WORDS = (
    '', 'i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'you', "you're", "you've",
    "you'll", "you'd", 'your', 'yours', 'yourself', 'yourselves', 'he', 'him', 'his', 'himself',
    'she', "she's", 'her', 'hers', 'herself', 'it', "it's", 'its', 'itself', 'they', 'them',
    'their', 'theirs', 'themselves', 'what', 'which', 'who', 'whom', 'this', 'that', "that'll",
    'these', 'those', 'am', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has',
    'had', 'having', 'do', 'does', 'did', 'doing', 'a', 'an', 'the', 'and', 'but', 'if', 'or',
    'because', 'as', 'until', 'while', 'of', 'at', 'by', 'for', 'with', 'about', 'against',
    'between', 'into', 'through', 'during', 'before', 'after', 'above', 'below', 'to', 'from',
    'up', 'down', 'in', 'out', 'on', 'off', 'over', 'under', 'again', 'further', 'then', 'once',
    'here', 'there', 'when', 'where', 'why', 'how', 'all', 'any', 'both', 'each', 'few', 'more',
    'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so', 'than',
    'too', 'very', 's', 't', 'can', 'will', 'just', 'don', "don't", 'should', "should've", 'now',
    'd', 'll', 'm', 'o', 're', 've', 'y', 'ain', 'aren', "aren't", 'couldn', "couldn't", 'didn',
    "didn't", 'doesn', "doesn't", 'hadn', "hadn't", 'hasn', "hasn't", 'haven', "haven't", 'isn',
    "isn't", 'ma', 'mightn', "mightn't", 'mustn', "mustn't", 'needn', "needn't", 'shan', "shan't",
    'shouldn', "shouldn't", 'wasn', "wasn't", 'weren', "weren't", 'won', "won't", 'wouldn',
    "wouldn't",
)

# Python's ``[^\w\s]`` written for Java regex.  ``\w`` is Unicode
# letters, numbers and ``_``; Python's ``\s`` also covers \x1c-\x1f, \x85,
# vertical tab and the Unicode space separators.  The second branch adds the
# three separators the tokeniser turns into spaces.
PUNCT_OR_BREAK = r"[^\p{L}\p{N}_\s\u001c-\u001f\u0085\p{Z}\u000b]|[\n\t\r]"
NON_ASCII = r"[^\x00-\x7F]"
# Runs of the same characters, the frequent letters tested first.
PUNCT_RUNS = r"[^a-zA-Z0-9\p{L}\p{N}_\p{Z}\u000b\u000c\u001c-\u001f\u0085]+"

# The result-page defaults and the snippet length.
NO_TITLE = "No title available"
NO_DESCRIPTION = "No description available"
SNIPPET_CHARS = 200


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_text(c: Column | str) -> Column:
    """TX1: newlines to spaces, space runs to one space, strip spaces only."""
    c = _c(c)
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "\n", " "), " +", " "), F.lit(" "))


def raw_words(c: Column | str) -> Column:
    """TX2+TX3: punctuation and line breaks to spaces, split on space runs.

    Empty text gives ``['']`` (the empty word is a stop word)."""
    c = _c(c)
    return F.split(F.btrim(F.regexp_replace(c, PUNCT_OR_BREAK, " "), F.lit(" ")), " +")


# A word is a maximal run of non-space chars once punctuation is replaced;
# matches start only at a word start (lookbehind), so the scan stays linear.
NON_ASCII_WORD = r"(?<![^ ])[^ ]*[^\x00-\x7F][^ ]*"


def ascii_lower_words(c: Column | str) -> Column:
    """TX4+TX5a: keep all-ASCII words, lowercased (the input to stemming).

    Done on the whole string, so it stays in generated code: after the
    punctuation rewrite, words containing a non-ASCII char are deleted with
    one regex, then the (now ASCII) text is lowercased and split.  Deleting
    before lowercasing matters: a few non-ASCII letters lowercase to ASCII."""
    c = _c(c)
    spaced = F.btrim(F.regexp_replace(c, PUNCT_OR_BREAK, " "), F.lit(" "))
    ascii_only = F.regexp_replace(spaced, NON_ASCII_WORD, "")
    words = F.array_remove(F.split(F.btrim(F.lower(ascii_only), F.lit(" ")), " +"), "")
    # an empty text splits to [''] (a stop word), as the reference's split does
    return F.when(spaced == "", F.array(F.lit(""))).otherwise(words)


def spaced(c: Column | str) -> Column:
    """TX2 for operators that explode the words: runs of punctuation and line
    breaks to one space.  Split at each space (no regex per row); the empty
    words in between are stop words."""
    return F.regexp_replace(_c(c), PUNCT_RUNS, " ")


def is_ascii(w: Column | str) -> Column:
    """TX4 on a single word: one byte per character."""
    w = _c(w)
    return F.octet_length(w) == F.char_length(w)


def is_stop_word(w: Column) -> Column:
    return w.isin(*STOP_WORDS)


def drop_stop_words(words: Column) -> Column:
    """TX6 on an array column."""
    return F.filter(words, lambda w: ~is_stop_word(w))


def tokens(c: Column | str) -> Column:
    """TX2-TX6 with ``stem=False``: array of tokens in text order."""
    return drop_stop_words(ascii_lower_words(c))


def snippet(c: Column | str) -> Column:
    """TX8: longer than 200 chars -> first 200 + '...'."""
    c = _c(c)
    return F.when(F.length(c) > SNIPPET_CHARS,
                  F.concat(F.substring(c, 1, SNIPPET_CHARS), F.lit("..."))).otherwise(c)


def default_if_empty(c: Column | str, default: str) -> Column:
    """TX9: ``''`` -> a fixed text; NULL stays NULL."""
    c = _c(c)
    return F.when(c == "", F.lit(default)).otherwise(c)
