"""Text functions as native column expressions. Character classes are spelled out, so that results equal Python's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in Python's str.split, as a Java class body; word and punctuation tokens.
BLANK = "\\s\\x1c-\\x1f"
#: The same characters one by one, for functions without patterns.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"


def canonical(t: Column) -> Column:
    """White-space runs to one space, trimmed, lower case: the form that hashes compare."""
    return F.lower(F.trim(F.regexp_replace(t, "(?U)\\s+", " ")))


def content_hash(t: Column) -> Column:
    return F.sha2(canonical(t), 256)


def hash_tokens(t: Column, most: int | None = None) -> Column:
    """Word runs and single punctuation marks of the canonical form; with a cap, half from the start and the rest from the last 200,000 characters."""
    c = canonical(t)
    all_ = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    if most is None:
        return all_
    if most <= 0:
        return F.array().cast("array<string>")
    head, tail = most // 2, most - most // 2
    last = F.regexp_extract_all(F.right(c, F.lit(200_000)), F.lit(TOKEN), F.lit(0))
    return F.when(F.size(all_) < most, all_).otherwise(F.concat(F.slice(all_, 1, head) if head else F.array().cast("array<string>"), F.slice(last, F.greatest(F.lit(1), F.size(last) - tail + 1), F.lit(tail))))


def segment_pairs(s: Column, within: int) -> Column:
    """The bits of each two of ``within`` + 2 segments of a 64-bit signature: signatures up to ``within`` bits apart share one at its place."""
    from itertools import combinations

    n = within + 2
    ends = [64 * i // n for i in range(n + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    masks = [a | b for a, b in combinations(bits, 2)]
    return F.array(*(s.bitwiseAND(F.lit(m - (m >> 63 << 64))) for m in masks))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sample_ends(t: Column, most: int) -> Column:
    """Texts up to ``most`` characters whole; of longer ones both halves of the allowance, on lines of their own."""
    half = most // 2
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(half)), F.lit("\n"), F.right(t, F.lit(half))))


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[\\p{L}\\p{N}_]+"))


def _without(t: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(t, pattern, ""))


def looks_low_value(t: Column) -> Column:
    """Empty; or under 98 % printable; or long with four characters at most; or long with hardly a letter."""
    n = F.length(t)
    printable = _without(t, "[[\\p{C}\\p{Z}]&&[^ \n]]")
    return (n == 0) | (printable / F.greatest(n, F.lit(1)) < 0.98) | ((n > 80) & (F.size(F.array_distinct(F.split(t, ""))) <= 4)) | ((n > 200) & (_without(t, "[^\\p{L}]") / n < 0.05))


def keep_text(t: Column, least: int = 200) -> Column:
    """Long enough, a fifth letters and 35 % letters or digits of what isn't white space."""
    # Each is made of the one before, so the later patterns meet few characters.
    dense = F.regexp_replace(t, f"(?U)[{BLANK}]+", "")
    known = F.regexp_replace(dense, "[^\\p{L}\\p{N}]+", "")
    solid = F.length(dense)
    ok = (_without(known, "[^\\p{L}]+") >= 0.20 * solid) & (F.length(known) >= 0.35 * solid)
    return (F.length(t) >= least) & (solid > 0) & ok


def normalize_web(t: Column) -> Column:
    """Null to empty, LF line ends, trimmed, horizontal runs to a space, at most one blank line between paragraphs."""
    lf = F.regexp_replace(F.coalesce(t, F.lit("")), "\r\n?", "\n")
    trimmed = F.btrim(lf, F.lit(BLANKS))
    return F.regexp_replace(F.regexp_replace(trimmed, "[ \t\r\f\\x0B]{2,}|[\t\r\f\\x0B]", " "), "\n{3,}", "\n\n")


def web_text(t: Column, least: int = 200) -> Column:
    """The normalised text where it is kept, else null. One value to select: a filter on a normalised column makes Spark normalise again for each use in it."""
    clean = normalize_web(t)
    return F.when(keep_text(clean, least), clean)


def year_of(v: Column) -> Column:
    """An integer as it is, else four leading digits, else null."""
    s = F.trim(v.cast("string"))
    return F.coalesce(F.when(s.rlike("^[+-]?\\d+$"), s.try_cast("bigint")), F.nullif(F.regexp_extract(s, "^(\\d{4})", 1), F.lit("")).try_cast("bigint"))


def allowed(v: Column, names: list[str]) -> Column:
    """Null is never allowed; comparison ignores case."""
    return F.coalesce(F.lower(v.cast("string")).isin([n.lower() for n in names]), F.lit(False))


def allowed_any(v: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(v, lambda x: F.lower(x)), F.array(*(F.lit(n.lower()) for n in names))), F.lit(False))


def record_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s:chunk-%04d", doc_id.cast("string"), index)


def first_id(*candidates: Column) -> Column:
    """First candidate that isn't blank, untrimmed."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in candidates))


def solid_runs(t: Column) -> Column:
    """Runs of what isn't white space."""
    return F.regexp_count(t, F.lit("\\S+"))


def terms(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))


def cut_at_stop(t: Column, stops: list[str]) -> tuple[Column, Column]:
    """The text before the earliest stop string, and whether one was met."""
    at = F.array_min(F.filter(F.array(*(F.locate(s, t) for s in stops if s)), lambda i: i > 0)) if any(stops) else F.lit(None).cast("int")
    return F.when(at.isNull(), t).otherwise(F.substring(t, F.lit(1), at - 1)), at.isNotNull()


def first_words(t: Column, n: int) -> Column:
    """The first n words, space-joined."""
    return F.array_join(F.slice(F.filter(F.split(F.trim(F.regexp_replace(t, "\\s+", " ")), " "), lambda w: w != ""), 1, n), " ")


def article(t: Column) -> Column:
    """Indefinite article for a noun phrase; none where it has a determiner."""
    own = F.lower(F.trim(t))
    first = F.split(own, "\\s+")[0]
    #: Fixed value: determiners.
    return F.when(own == "", "a").when(first.isin("a", "an", "the", "his", "her", "their", "my"), "").when(own.rlike("^[aeiou]"), "an").otherwise("a")


#: Openings of a request for a story.
STORY_OPENINGS = ("write a story about ", "write a tiny story about ", "tell me a story about ", "tell a story about ", "tell me about ")


def story_prompt(t: Column) -> Column:
    """A request for a story as the story's opening sentence; other prompts as they are."""
    flat = F.trim(F.regexp_replace(t, "\\s+", " "))
    size = F.coalesce(*(F.when(F.startswith(F.lower(flat), F.lit(p)), F.lit(len(p))) for p in STORY_OPENINGS))
    subject = F.regexp_replace(F.substring(flat, size + 1, F.length(flat)), "^[ .]+|[ .]+$", "")
    #: The two patterns of a request.
    named = "(?i)\\b(?:(a|an|the)\\s+)?([A-Za-z]+)\\s+named\\s+([A-Za-z][A-Za-z0-9_-]*)"
    lost = "(?i)\\blost\\s+(?:(his|her|their|the)\\s+)?([A-Za-z0-9 -]+)$"
    kind, name, given = F.regexp_extract(subject, named, 2), F.regexp_extract(subject, named, 3), F.regexp_extract(subject, named, 1)
    opening = F.concat(F.lit("Once upon a time, there was "), F.when(given != "", given).otherwise(article(kind)), F.lit(" "), F.lower(kind), F.lit(" named "), name, F.lit("."))
    owner, thing = F.lower(F.regexp_extract(subject, lost, 1)), F.regexp_replace(F.regexp_extract(subject, lost, 2), "^[ .]+|[ .]+$", "")
    indefinite = F.concat(article(thing), F.lit(" "), thing)
    tail = F.concat(F.lit(" "), name, F.lit(" had "), F.when(owner.isin("the", "their"), thing).otherwise(indefinite), F.lit(". One day, "), name, F.lit(" lost "), F.when(owner != "", F.concat(owner, F.lit(" "), thing)).otherwise(indefinite), F.lit("."))
    plain = F.concat(F.lit("Once upon a time, there was "), subject, F.lit("."))
    return F.when(flat == "", flat).when(size.isNull(), t).when(~F.rlike(subject, F.lit(named)), plain).when(thing != "", F.concat(opening, tail)).otherwise(opening)
