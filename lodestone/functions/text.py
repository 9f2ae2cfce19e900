"""String functions as columns: built-ins only, so they stay in generated code and SQL can check them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vectors import let

# Patterns and limits that results depend on.
JOINERS = r"_\-./:@#"
TID = r"^[2-7a-j][2-7a-z]{12}$"
SECRETS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\b(sk|pk|rk)[-_](live|test|proj|ant)?[-_]?[A-Za-z0-9]{16,}",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}",
    r"\bgithub_pat_[A-Za-z0-9_]{30,}",
    r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{15,}\.",
    r"""(?i)\b[\w.-]*(password|passwd|secret|api[_-]?key|access[_-]?key|token)[\w.-]*["']?\s*[:=]\s*["']?[^\s"'`]{8,}""",
    r"\bBearer\s+[A-Za-z0-9._~+/-]{20,}",
]
SKILL_NAME = r"^[a-z0-9]+(-[a-z0-9]+)*$"
MOST_TAGS, TAG_BYTES, TERM_BYTES, TERM_PREFIX = 16, 128, 64, 48


def trim_joiners(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{JOINERS}]+|[{JOINERS}]+$", "")


def camel_split(s: Column) -> Column:
    """Sub-words of an ASCII identifier of two characters or more: case, acronym and digit boundaries, joiners."""
    s = F.regexp_replace(s, r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-rt-z]|[A-Z]s[A-Za-z0-9])", "$1 $2")  # a plural s is no word
    s = F.regexp_replace(F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1 $2"), r"([0-9])([A-Za-z])", "$1 $2")
    parts = F.split(F.regexp_replace(s, f"[{JOINERS}]+", " "), " ")
    return F.filter(F.transform(parts, F.lower), lambda p: F.length(p) >= 2)


def tid(s: Column) -> Column:
    return s.rlike(TID) & s.rlike("[2-7]")


def opaque(s: Column) -> Column:
    """A record key, or 16 ASCII letters and digits or more that are all digits or switch kind three times."""
    switches = F.length(F.regexp_replace(F.regexp_replace(s, "[0-9]+", "0"), "[A-Za-z]+", "a")) - 1
    return tid(s) | (s.rlike("^[A-Za-z0-9]{16,}$") & (s.rlike("^[0-9]+$") | (switches >= 3)))


def first_bytes(s: Column, most: int) -> Column:
    """The longest start of at most `most` bytes in UTF-8 that ends between two characters."""
    raw = s.cast("binary")
    starts = (F.try_validate_utf8(F.substring(raw, 1, most - i).cast("string")) for i in range(4))
    return F.when(F.octet_length(s) <= most, s).otherwise(F.coalesce(*starts, F.substring(s, 1, most // 4)))


def bound_term(s: Column) -> Column:
    """A term of more than 64 bytes: its first 48, whole characters, and 12 digits of its hash."""
    short = F.concat(first_bytes(s, TERM_PREFIX), F.lit("#"), F.substring(F.sha2(s, 256), 1, 12))
    return F.when(F.octet_length(s) > TERM_BYTES, short).otherwise(s)


def embed_text(prefix: str, text: Column, tags: Column, most: int = 24000) -> Column:
    """What the embedder gets: prefix, the text's first `most` bytes (whole characters), the tags."""
    body = F.concat(F.lit(prefix), first_bytes(text, most))
    return F.when(F.size(tags) > 0, F.concat(body, F.lit("\n\nTags: "), F.array_join(tags, ", "))).otherwise(body)


def snippet(text: Column, term: str | Column, width: int = 200) -> Column:
    """A window of `width` characters that starts a quarter of it before the term; null without the term."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(F.lit(1), at - width // 4)
    body = F.substr(text, start, F.lit(width))
    out = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(body), F.when(start + width - 1 < F.length(text), "…").otherwise(""))
    return F.when(at > 0, out)


def shorten(text: Column, most: int) -> Column:
    """Cut at `most` characters, at the last space if that lies beyond 70 % of them."""
    t = F.trim(text)
    cut = F.substring(t, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # characters before the last space
    has = F.instr(cut, " ") > 0
    body = F.when(has & (space > most * 0.7), F.substr(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(body), F.lit("…")))


def chunks(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters that end at line breaks where lines are short enough.

    A piece runs on to the last line break within reach, unless that would leave it shorter than half.
    """
    pattern = rf"[\s\S]{{1,{most}}}\z|[\s\S]{{{-(-most // 2)},{most}}}(?=\n)|[\s\S]{{{most}}}"
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != "")


def looks_secret(text: Column) -> Column:
    return reduce(lambda a, p: a | text.rlike(p), SECRETS[1:], text.rlike(SECRETS[0]))


def sanitize_url(url: Column) -> Column:
    """Without user info, query and fragment; what isn't a URL stays."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1"), "[?#].*$", "")
    return F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), bare).otherwise(url)


def identifiers(text: Column) -> Column:
    """Tokens that a paraphrase must keep: with digits, paths, underscores, dots inside, inner capitals, flags.

    The patterns are fixed values.
    """
    # whole tokens that have such a shape somewhere, or may be a flag: plain words never become elements
    part = "[A-Za-z0-9_./:#@~-]"
    shape = r"[0-9/_]|[A-Za-z0-9_]\.[A-Za-z0-9_]|[a-z][A-Z]"
    raw = F.regexp_extract_all(text, F.lit(f"(?<!{part})(?=-|{part}*?(?:{shape})){part}+"), F.lit(0))

    def core(r: Column) -> Column:
        return F.regexp_replace(r, r"^[^A-Za-z0-9_~/#@]+|[^A-Za-z0-9_/]+$", "")

    def flag(r: Column) -> Column:
        return F.regexp_replace(r, r"[^A-Za-z0-9_]+$", "")

    def by_shape(t: Column) -> Column:
        return F.when((F.length(t) >= 3) & t.rlike(shape), F.lower(t)).otherwise(F.when(F.length(t) < 3, ""))

    def kept(r: Column) -> Column:
        # an empty string: too short; null: no identifier by its shape, but perhaps a flag
        as_flag = F.when(r.startswith("-") & flag(r).rlike(r"(?i)^--?[a-z][A-Za-z0-9_-]{2,}$"), F.lower(flag(r)))
        return F.nullif(F.coalesce(by_shape_once(r), as_flag), F.lit(""))

    def by_shape_once(r: Column) -> Column:
        return let(core(r), by_shape)

    return F.array_distinct(F.filter(F.transform(raw, kept), lambda x: x.isNotNull()))


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{5,})"), F.lit(1)))


def keeps_facts(merged: Column, old: Column) -> Column:
    """A merge keeps nearly all identifiers, most longer words and half the length of what it replaces."""
    ids, words = identifiers(old), long_words(old)
    missing = F.size(F.filter(F.array_except(ids, identifiers(merged)), lambda i: F.instr(F.lower(merged), i) == 0))
    shared = F.size(F.array_intersect(words, long_words(merged)))
    return (missing <= F.floor(F.size(ids) * 0.1)) & ((F.size(words) == 0) | (shared / F.greatest(F.size(words), F.lit(1)) >= 0.6)) & (F.length(merged) >= F.length(old) * 0.5)


def same_text(a: Column, b: Column) -> Column:
    def norm(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    return norm(a) == norm(b)


def clean_tags(tags: Column) -> Column:
    trimmed = F.transform(tags, lambda t: F.trim(t))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda t: (t != "") & (F.octet_length(t) <= TAG_BYTES) & ~looks_secret(t))), 1, MOST_TAGS)


def parse_tags(line: Column) -> Column:
    parts = F.transform(F.split(line, r"[\s,]+"), lambda t: F.regexp_replace(t, "^#+", ""))
    return F.slice(F.filter(parts, lambda t: t != ""), 1, MOST_TAGS)


def identifier_like(s: Column) -> Column:
    """A joiner other than a hyphen, a digit, or a capital after the first letter."""
    return s.rlike(r"[_./:@#0-9]|^.+[A-Z]")


def valid_skill_name(s: Column) -> Column:
    return s.rlike(SKILL_NAME) & (F.length(s) <= 64)


def rendezvous_score(key: Column, node: Column) -> Column:
    """The first eight bytes, as hex, of the hash of key and node: fixed-width, so it orders like the number."""
    return F.substring(F.sha2(F.concat(key, F.lit("\0"), node), 256), 1, 16)


def json_object(answer: Column) -> Column:
    """The outermost {...} of an answer with a fence or prose around it; null if there is none."""
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def clip(s: Column, chars: int, size: int) -> Column:
    """At most `chars` characters and `size` bytes, never cut inside a character."""
    head = F.substring(s, 1, chars)
    # the longest prefix within the bytes: each character takes 1 to 4 of them
    def fits(n: Column) -> Column:
        return F.octet_length(F.substr(head, F.lit(1), n)) <= size

    length = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(F.length(head), F.lit(0))), fits))
    return F.when(F.octet_length(head) <= size, head).otherwise(F.substr(head, F.lit(1), length))


def tid_micros(s: Column) -> Column:
    """Microseconds since 1970 that a record key holds: ten of its base32 digits after the top bit; null if it is none."""
    digits = F.split(s, "")
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: a * 32 + (F.instr(F.lit("234567abcdefghijklmnopqrstuvwxyz"), c) - 1))
    return F.when(s.rlike("^[2-7a-j][2-7a-z]{12}$"), F.shiftright(value, 10))


def skill_header(document: Column) -> Column:
    """The lines between the `---` fences at a document's start; null without them."""
    found = F.regexp_extract(document, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    return F.when(document.rlike(r"(?s)\A---\n.*?\n---(?:\n|\z)"), found)


def skill_field(document: Column, name: str) -> Column:
    """A field of the header, without quotes around it."""
    raw = F.regexp_extract(skill_header(document), rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")


def skill_body(document: Column) -> Column:
    return F.trim(F.regexp_replace(document, r"(?s)\A---\n.*?\n---(?:\n|\z)", ""))


def skill_document(name: Column, description: Column, body: Column) -> Column:
    return F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), description, F.lit("\n---\n\n"), body, F.lit("\n"))


def lenient_time(text: Column, fallback: Column) -> Column:
    """The instant that a text names, or `fallback`.

    Date and time are split by a T, in either case, or by space; the zone is a Z, in either case, an offset with or
    without its colon (also -00:00), or missing, which is UTC; a date alone is its midnight; space around it goes.
    """
    t = F.upper(F.trim(text))
    t = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[T ]+", "$1T")
    t = F.regexp_replace(t, r"([T:.]\d+) *([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    t = F.regexp_replace(t, r"-00:00$", "Z")
    whole = t.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.coalesce(F.when(whole, F.try_to_timestamp(t)), fallback)
