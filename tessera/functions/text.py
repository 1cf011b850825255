"""Text functions, Column to Column.  ``(?U)`` makes white-space and word classes Unicode-aware."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from re import _constants, _parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def display(x: Text) -> Column:
    """Trimmed, white space (no-break spaces too) collapsed, case kept; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), "(?U)\\s+", " "))


def phrase_key(x: Text) -> Column:
    """Lower case, collapsed, without edge characters outside ``a-z 0-9 + # /``."""
    return F.regexp_replace(F.lower(display(x)), "^[^a-z0-9+#/]+|[^a-z0-9+#/]+$", "")


def search_key(x: Text) -> Column:
    """Lower case; every run outside ``a-z 0-9`` is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+", " "))


def skill_label(x: Text) -> Column:
    """Case kept; leading non-alphanumerics go, trailing ones too except ``+ # /``."""
    return F.regexp_replace(F.regexp_replace(display(x), "^[^A-Za-z0-9]+", ""), "[^A-Za-z0-9+#/]+$", "")


def job_skill(x: Text, soft: Sequence[str] = values.SOFT_SKILLS, kept: Sequence[str] = values.KEPT_SKILLS, junk: Sequence[str] = values.JUNK_SKILLS) -> Column:
    """A job's skill as its key: ``&`` spelt out, punctuation gone, junk null, kept phrases as they
    are, any phrase holding a soft skill (first in list order) as that skill, the word "skills" gone."""
    s = F.regexp_replace(F.replace(F.lower(F.trim(col(x))), F.lit("&"), F.lit("and")), "(?U)[^\\w\\s]", "")
    s = F.trim(F.regexp_replace(s, "(?U)\\s+", " "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(s, "\\bskills\\b", ""), "\\s+", " "))
    out = F.when((s == "") | s.isin(*junk), F.lit(None).cast("string")).when(s.isin(*kept), s)
    for core in soft:
        out = out.when(F.contains(s, F.lit(core)), F.lit(core))
    return out.otherwise(F.nullif(plain, F.lit("")))


def named_skill(x: Text, low: int = 2, high: int = 60) -> Column:
    """Whether a list entry names a skill at all."""
    s = F.lower(F.trim(col(x)))
    return F.coalesce(F.length(s).between(low, high) & ~s.rlike("|".join(values.NO_SKILLS)), F.lit(False))


def strip_tags(x: Text) -> Column:
    """Tags to spaces, white space collapsed; entities stay (see ``html.unescape``)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), "<[^>]+>", " "), "\\s+", " "))


def american(x: Text, pairs: Sequence[tuple[str, str]] = values.SPELLINGS) -> Column:
    """Spellings replaced in turn, as substrings."""
    out = col(x)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def no_controls(x: Text) -> Column:
    return F.regexp_replace(col(x), "[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F]", " ")


def _parts(x: Text, pattern: str) -> Column:
    # a lambda, as F.trim itself would be given the place in the list as the characters to trim
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), pattern), lambda s: F.trim(s)), lambda s: s != "")


def chunks(x: Text) -> Column:
    """Pieces between ``. ; :`` before white space, or line ends."""
    return _parts(x, "[.;:]\\s+|\\n+")


def sentences(x: Text) -> Column:
    return _parts(x, "(?<=[.!?])\\s+|\\n+")


def n_words(x: Text) -> Column:
    """Words between white space; 0 for null and blank texts."""
    t = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), "\\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def tokens(x: Text, stop: Sequence[str] = values.STOP_WORDS) -> Column:
    """``search_key`` words without stop words, single characters and numbers."""
    return F.filter(F.split(search_key(x), " "), lambda w: (F.length(w) > 1) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))


def contains_phrase(text: Text, phrase: str, compat: bool = False) -> Column:
    """``phrase`` bounded by non-word characters.  ``compat`` uses plain word boundaries, by which a
    phrase that ends in a symbol is not found before a space.  The pattern is only tried on texts that
    hold the phrase at all."""
    p = re.escape(phrase)
    return F.contains(col(text), F.lit(phrase)) & col(text).rlike(f"\\b{p}\\b" if compat else f"(?<!\\w){p}(?!\\w)")


def _needed(parts) -> list[str]:
    """Strings of which every match of a parsed pattern holds one; none if that is not known."""
    found, run = [], ""
    for op, arg in [*parts, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(arg)
            continue
        found.append([run] if run else [])
        run = ""
        if op is _constants.SUBPATTERN and not (arg[1] or arg[2]):
            found.append(_needed(arg[3]))
        elif op is _constants.BRANCH:
            ways = [_needed(way) for way in arg[1]]
            found.append(sum(ways, []) if all(ways) else [])
    return max(found, key=lambda strings: min(map(len, strings), default=0))


def needed(pattern: str) -> list[str]:
    """``_needed`` of a pattern; one with flags or in a syntax of Java's own needs nothing."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    return [] if parsed.state.flags & ~re.UNICODE else _needed(parsed)


def finds(x: Text, *patterns: str) -> Column:
    """Whether one of the patterns matches.  Texts without a string that a match needs are not searched."""
    hit, strings = col(x).rlike("|".join(patterns)), [needed(p) for p in patterns]
    if not all(strings):
        return hit
    some = [F.contains(col(x), F.lit(s)) for s in dict.fromkeys(sum(strings, []))]
    return reduce(lambda a, b: a | b, some) & hit


def any_phrase(text: Text, phrases: Sequence[str]) -> Column:
    """Whether one of ``phrases`` stands in the text between word bounds."""
    held = [F.contains(col(text), F.lit(p)) for p in phrases] or [F.lit(True)]
    return reduce(lambda a, b: a | b, held) & col(text).rlike("(?<!\\w)(?:" + "|".join(re.escape(p) for p in phrases) + ")(?!\\w)")


def soft_equal(a: Text, b: Text, least: int = 5, prefix: int = 6) -> Column:
    """Equal, or both at least ``least`` long with the same first ``prefix`` characters."""
    a, b = col(a), col(b)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= least) & (F.left(a, F.lit(prefix)) == F.left(b, F.lit(prefix))))


def titled(x: Text, small: Sequence[str] = values.SMALL_WORDS) -> Column:
    """Words capitalised, the rest of them in lower case, but for small words after the first."""
    words = F.split(display(x), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000))))), " ")


def shortened(x: Text, most: int = 420) -> Column:
    t = display(x)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 3))), F.lit("..."))).otherwise(t)


def title_key(x: Text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9\\s]", " "), "\\s+", " "))


def slug(x: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.replace(col(x), F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def experience_mentions(x: Text, patterns: Sequence[str] = values.EXPERIENCE_MENTIONS) -> Column:
    """All mentions as they stand, in pattern order, without repeats whatever their case."""
    from tessera.functions.arrays import first_by_key

    t = F.coalesce(col(x), F.lit(""))
    return first_by_key(*[F.regexp_extract_all(t, F.lit(f"(?i){p}"), 0) for p in patterns])


def grams(words: Text, n: int) -> Column:
    """All runs of n words, in order, repeats included: the runs of n - 1 words, each with the next."""
    w = col(words)
    out = w
    for k in range(1, n):
        rest = F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0)))
        out = F.zip_with(F.slice(out, F.lit(1), F.size(rest)), rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) >= n, out).otherwise(F.array().cast("array<string>"))


def ngrams(words: Text, low: int = 1, high: int = 3) -> Column:
    """Distinct n-grams of an array of words, sorted; they bridge words removed before."""
    from tessera.functions.grams import distinct_ngrams

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return distinct_ngrams(lists, low, high)

    return run(col(words))
