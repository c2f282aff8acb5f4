"""Text functions as columns: tokenisers, normalisers, shingles, checksums. No Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
COMPOUND = r"[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*"
#: fixed values: function words, which carry no content of a claim
STOPWORDS = tuple(
    """a an the and or but if that this these those is are was were be been being it its of in on at to for from with by as so do does did has have
    had having can could will would should when while than then there their they them we you which what who whose how where why also such""".split()
)
#: fixed values: words that queries are stripped of
QUERY_STOPWORDS = tuple("a an and are as at be but by can do does for from has have how i if in is it its my of on or so that the this to was what when where which why will with you your".split())
#: fixed values: digits and signs read as letters
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def lit(value) -> Column:
    return F.lit(value)


def folded(text: Column) -> Column:
    """Case folding: lower case, sharp s as ss."""
    return F.lower(F.replace(F.coalesce(text, lit("")), lit("ß"), lit("ss")))


def words(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), lit(WORD), lit(0))


def compounds(text: Column) -> Column:
    """Lower-case words that may be joined by - or _."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, lit(""))), lit(COMPOUND), lit(0))


def content_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, lit("")), lit(r"\S+"), lit(0)))


def squashed(text: Column) -> Column:
    """Lower case; every run of other than letters and digits is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, lit(""))), r"[^\p{L}\p{N}]+", " "))


def folded_space(text: Column) -> Column:
    """Folded, runs of white space made one blank, trimmed."""
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stem(word: Column) -> Column:
    """Suffix stripping of words of more than three letters: the plural (ies to y, s but not ss), then ing or ed, behind
    which a doubled consonant other than l, s, z is made single, then a last e."""

    def single(w: Column) -> Column:
        return F.when(F.length(w) > 3, F.regexp_replace(w, r"([bcdfghjkmnpqrtv])\1$", "$1")).otherwise(w)

    cut = lambda w, k: F.left(w, F.length(w) - k)
    plural = lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(cut(w, 3), lit("y"))).when(w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w)
    ending = lambda w: F.when((F.length(w) > 5) & w.endswith("ing"), single(cut(w, 3))).when((F.length(w) > 4) & w.endswith("ed"), single(cut(w, 2))).otherwise(w)
    last_e = lambda w: F.when((F.length(w) > 4) & w.endswith("e"), cut(w, 1)).otherwise(w)
    return F.when(F.length(word) <= 3, word).otherwise(let(let(let(word, plural), ending), last_e))


def stemmed(text: Column) -> Column:
    """Stems of the ASCII words of a text; words joined by - or _ are there whole and in parts; stop words are left out."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, lit(""))), lit(r"[a-z0-9]+(?:[-_][a-z0-9]+)*"), lit(0))
    every = F.flatten(F.transform(raw, lambda w: F.when(w.rlike("[-_]"), F.concat(F.array(w), F.split(w, "[-_]"))).otherwise(F.array(w))))
    return F.transform(F.filter(every, lambda w: ~w.isin(*QUERY_STOPWORDS)), stem)


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by a blank; fewer tokens are one shingle, none are none."""
    several = F.transform(F.sequence(lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(several)).when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))


def hash60(text: Column) -> Column:
    """The first 15 hexadecimal digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units."""
    code = F.hex(F.encode(text, "UTF-16BE"))
    units = F.when(F.length(code) > 0, F.transform(F.sequence(lit(1), F.length(code) - 3, lit(4)), lambda i: F.conv(F.substring(code, i, 4), 16, 10).cast("long")))
    units = F.coalesce(units, F.array().cast("array<bigint>"))
    return F.aggregate(units, lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(c)) * 16777619).bitwiseAND(4294967295))


def luhn(digits: Column) -> Column:
    """Whether a run of two digits or more has a valid Luhn checksum."""
    d = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    total = F.aggregate(d, lit(0), lambda a, x: a + x)
    return digits.rlike(r"^[0-9]{2,}$") & (total % 10 == 0)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(parts, lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def unleet(word: Column) -> Column:
    """Signs read as letters, in words that have a letter."""
    return F.when(word.rlike(r"\p{L}"), F.translate(word, "".join(LEET), "".join(LEET.values()))).otherwise(word)


def tokens_estimate(text: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(lit(1), F.ceil(F.length(F.coalesce(text, lit(""))) / 4)).cast("long")


def number_of(text: Column) -> Column:
    """A number with an optional currency sign and thousands in groups of three; else null."""
    bare = F.regexp_replace(F.trim(text), r"^[$€£]\s*", "")
    return F.when(bare.rlike(r"^-?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$"), F.regexp_replace(bare, ",", "").cast("double"))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def date_of(text: Column) -> Column:
    """ISO date from 2024-01-05, Jan 5, 2024 or 5 January 2024; slashes are refused, 29 February is always a day."""
    t = F.lower(F.trim(text))
    iso, us, eu = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([a-z]{3})[a-z]*\.? ([0-9]{1,2}),? ([0-9]{4})$", r"^([0-9]{1,2}) ([a-z]{3})[a-z]*\.? ([0-9]{4})$"
    number = lambda name: F.array_position(F.array(*map(lit, MONTHS)), name).cast("int")
    part = lambda p, k: F.regexp_extract(t, p, k)
    y = F.when(t.rlike(iso), part(iso, 1)).when(t.rlike(us), part(us, 3)).when(t.rlike(eu), part(eu, 3))
    m = F.when(t.rlike(iso), part(iso, 2).try_cast("int")).when(t.rlike(us), number(part(us, 1))).when(t.rlike(eu), number(part(eu, 2)))
    d = F.when(t.rlike(iso), part(iso, 3).try_cast("int")).when(t.rlike(us), part(us, 2).try_cast("int")).when(t.rlike(eu), part(eu, 1).try_cast("int"))
    fits = m.between(1, 12) & (d >= 1) & (d <= F.element_at(F.array(*map(lit, DAYS)), F.greatest(lit(1), F.least(lit(12), m))))
    return F.when(fits, F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))
