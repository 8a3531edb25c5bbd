"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980)
as Spark column expressions.

The stemmer is meant for a *vocabulary* (distinct lowercase words), not for
every occurrence: ``operators.postings.stem_vocabulary`` applies
``stem_steps`` to the distinct words and joins the result back, so the work
grows with the vocabulary, not with the text.

Measure and letter classes are computed on a consonant/vowel pattern string:
``cv('toy') = 'cvc'``.  ``a e i o u`` are vowels; ``y`` is a vowel when the
letter before it is a consonant; everything else is a consonant.  The pattern
of a prefix is the prefix of the pattern, so one pattern per step serves every
stem test of that step.

Two rule sets, chosen by ``mode``:

* ``'paper'``: the 1980 rules.  Like the author's own published implementation,
  words of one or two letters are left as they are.
* ``'extended'`` (the default): the departures that natural-language libraries
  made the usual default.  A list of irregular words comes first; ``-ies`` and
  ``-ied`` keep an ``e`` in words of four letters and ``-ied`` is a rule of its
  own; final ``y`` turns into ``i`` after a consonant only (*enjoy* and *they* stay,
  so *they* still meets the stop list); ``-bli`` replaces ``-abli``, ``-fulli`` and
  ``-logi`` are added, ``-alli`` goes through step 2 again; and a stem of a vowel
  and a consonant counts as short (*are* keeps its ``e``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rule tables of the 1980 paper, in the paper's order.
STEP2_RULES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP3_RULES = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
VOWELS = ("a", "e", "i", "o", "u")

# What the extended rules add, irregular stems with their words
# and the changes of step 2.
IRREGULAR = (
    ("sky", ("sky", "skies")), ("die", ("dying",)), ("lie", ("lying",)), ("tie", ("tying",)),
    ("news", ("news",)), ("inning", ("innings", "inning")), ("outing", ("outings", "outing")),
    ("canning", ("cannings", "canning")), ("howe", ("howe",)), ("proceed", ("proceed",)),
    ("exceed", ("exceed",)), ("succeed", ("succeed",)),
)
STEP2_EXTENDED = tuple(r for r in STEP2_RULES if r[0] != "abli") + (("bli", "ble"), ("fulli", "ful"), ("logi", "log"))
# the step 2 rules that can follow once -alli has become -al
STEP2_AFTER_ALLI = tuple(r for r in STEP2_RULES if r[0].endswith("al"))
MODES = ("extended", "paper")


# The 25 letters other than 'y' and their class (v = a e i o u).
_LETTERS = "abcdefghijklmnopqrstuvwxz"
_CLASSES = "vcccvcccvcccccvcccccvcccc"


def _cv_by_fold(w: Column) -> Column:
    """'c'/'v' per letter, left to right -- exact for any word."""
    return F.aggregate(
        F.split(w, ""),
        F.lit(""),
        lambda acc, ch: F.concat(
            acc,
            F.when(ch.isin(*VOWELS), F.lit("v"))
            .when((ch == "y") & (F.right(acc, F.lit(1)) == "c"), F.lit("v"))
            .otherwise(F.lit("c")),
        ),
    )


def cv_pattern(w: Column) -> Column:
    """'c'/'v' per letter.  Without 'yy' in the word every 'y' follows a
    non-'y' letter whose class is known, so ``translate`` plus two regex
    rewrites give the pattern (code-generated); words with 'yy' use the
    exact left-to-right fold."""
    classes = F.regexp_replace(F.translate(w, _LETTERS, _CLASSES), "[^cvy]", "c")
    fast = F.regexp_replace(F.regexp_replace(classes, "cy", "cv"), "y", "c")
    return F.when(w.contains("yy"), _cv_by_fold(w)).otherwise(fast)


def _drop(c: Column, k: int) -> Column:
    """``c`` without its last ``k`` chars."""
    if k == 0:
        return c
    return c.substr(F.lit(1), F.length(c) - F.lit(k))


def _measure(p: Column) -> Column:
    """m in [C](VC)^m[V]: the number of vowel->consonant transitions."""
    return F.regexp_count(p, F.lit("vc"))


def _has_vowel(p: Column) -> Column:
    return p.contains("v")


def _ends_double_consonant(w: Column, p: Column) -> Column:
    return (F.length(w) >= 2) & (F.substring(w, -1, 1) == F.substring(w, -2, 1)) & p.endswith("cc")


def _ends_cvc(w: Column, p: Column, extended: bool) -> Column:
    """*o: stem ends consonant-vowel-consonant, the last not w, x or y; by the
    extended rules also a stem that is a vowel and a consonant."""
    short = p.endswith("cvc") & ~F.substring(w, -1, 1).isin("w", "x", "y")
    return short | (p == "vc") if extended else short


def _longest_suffix_rule(w: Column, p: Column, rules, min_measure: int) -> Column:
    """Only the longest matching suffix is tried; if its condition fails the
    word is left as it is (the paper's rule selection)."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    out = None
    for suffix, repl in ordered:
        k = len(suffix)
        # the l of -logi counts for the measure
        stem_p = _drop(p, 3 if suffix == "logi" else k)
        cond = _measure(stem_p) > min_measure
        if suffix == "ion":
            stem_w = _drop(w, k)
            cond = cond & F.substring(stem_w, -1, 1).isin("s", "t")
        new = F.concat(_drop(w, k), F.lit(repl)) if repl else _drop(w, k)
        branch = F.when(cond, new).otherwise(w)
        out = F.when(w.endswith(suffix), branch) if out is None else out.when(w.endswith(suffix), branch)
    return out.otherwise(w)


def _step1a(w: Column, extended: bool) -> Column:
    ies = F.when(F.length(w) == 4, _drop(w, 1)).otherwise(_drop(w, 2)) if extended else _drop(w, 2)
    return (F.when(w.endswith("sses"), _drop(w, 2))
            .when(w.endswith("ies"), ies)
            .when(w.endswith("ss"), w)
            .when(w.endswith("s"), _drop(w, 1))
            .otherwise(w))


def _step1b_strip(w: Column, p: Column, extended: bool) -> tuple[Column, Column]:
    """Returns (new word, whether the -ed/-ing clean-up must run)."""
    eed, ied = w.endswith("eed"), w.endswith("ied") if extended else F.lit(False)
    ed = ~eed & ~ied & w.endswith("ed") & _has_vowel(_drop(p, 2))
    ing = w.endswith("ing") & _has_vowel(_drop(p, 3))
    new = (F.when(eed, F.when(_measure(_drop(p, 3)) > 0, _drop(w, 1)).otherwise(w))
           .when(ied, F.when(F.length(w) == 4, _drop(w, 1)).otherwise(_drop(w, 2)))
           .when(ed, _drop(w, 2))
           .when(ing, _drop(w, 3))
           .otherwise(w))
    return new, (ed | ing)


def _step1b_cleanup(w: Column, p: Column, extended: bool) -> Column:
    last = F.substring(w, -1, 1)
    return (F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
            .when(_ends_double_consonant(w, p) & ~last.isin("l", "s", "z"), _drop(w, 1))
            .when((_measure(p) == 1) & _ends_cvc(w, p, extended), F.concat(w, F.lit("e")))
            .otherwise(w))


def _step1c(w: Column, p: Column, extended: bool) -> Column:
    stem_p = _drop(p, 1)
    turns = (F.length(stem_p) > 1) & stem_p.endswith("c") if extended else _has_vowel(stem_p)
    return F.when(w.endswith("y") & turns, F.concat(_drop(w, 1), F.lit("i"))).otherwise(w)


def _step2(w: Column, p: Column, extended: bool) -> Column:
    if not extended:
        return _longest_suffix_rule(w, p, STEP2_RULES, 0)
    again = _longest_suffix_rule(_drop(w, 2), _drop(p, 2), STEP2_AFTER_ALLI, 0)
    return (F.when(w.endswith("alli") & (_measure(_drop(p, 4)) > 0), again)
            .otherwise(_longest_suffix_rule(w, p, STEP2_EXTENDED, 0)))


def _step5a(w: Column, p: Column, extended: bool) -> Column:
    stem_w, stem_p = _drop(w, 1), _drop(p, 1)
    m = _measure(stem_p)
    drop = (m > 1) | ((m == 1) & ~_ends_cvc(stem_w, stem_p, extended))
    return F.when(w.endswith("e") & drop, stem_w).otherwise(w)


def _step5b(w: Column, p: Column) -> Column:
    return F.when((_measure(p) > 1) & _ends_double_consonant(w, p) & w.endswith("l"),
                  _drop(w, 1)).otherwise(w)


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once: ``x`` is bound to a lambda variable.

    Every step reads its input word many times; binding it keeps the whole
    stemmer a linear expression tree, so optimizer rules that inline aliases
    (predicate and semi/anti-join pushdown through projections) stay cheap."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _patterned(x: Column, f) -> Column:
    """``f(w, cv(w))`` with the word and its pattern each computed once."""
    return _let(x, lambda v: _let(F.struct(v.alias("w"), cv_pattern(v).alias("p")),
                                  lambda s: f(s["w"], s["p"])))


def _step1b(x: Column, extended: bool) -> Column:
    def strip(w: Column, p: Column) -> Column:
        new, fix = _step1b_strip(w, p, extended)
        return F.struct(new.alias("w"), fix.alias("fix"))

    return _let(_patterned(x, strip),
                lambda r: F.when(r["fix"], _patterned(
                    r["w"], lambda a, b: _step1b_cleanup(a, b, extended))).otherwise(r["w"]))


def stem(word: Column | str, mode: str = "extended") -> Column:
    """Porter stem of a lowercase ASCII word of three or more letters, as one
    expression (``stem_steps`` leaves shorter words as they are)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    extended = mode == "extended"
    word = F.col(word) if isinstance(word, str) else word
    step4 = tuple((s, "") for s in STEP4_SUFFIXES)
    w = _let(word, lambda a: _step1a(a, extended))
    w = _step1b(w, extended)
    w = _patterned(w, lambda a, b: _step1c(a, b, extended))
    w = _patterned(w, lambda a, b: _step2(a, b, extended))
    w = _patterned(w, lambda a, b: _longest_suffix_rule(a, b, STEP3_RULES, 0))
    w = _patterned(w, lambda a, b: _longest_suffix_rule(a, b, step4, 1))
    w = _patterned(w, lambda a, b: _step5a(a, b, extended))
    w = _patterned(w, _step5b)
    if not extended:
        return w
    whole = None
    for stem_, words in IRREGULAR:
        whole = F.when(word.isin(*words), stem_) if whole is None else whole.when(word.isin(*words), stem_)
    return whole.otherwise(w)


def stem_steps(df: DataFrame, word: str = "word", out: str = "stem", mode: str = "extended") -> DataFrame:
    """Adds ``out`` = Porter stem of the lowercase ASCII column ``word``;
    meant for a distinct vocabulary."""
    return df.withColumn(out, F.when(F.length(F.col(word)) <= 2, F.col(word)).otherwise(stem(F.col(word), mode)))
