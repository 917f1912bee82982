"""Text cleaning, tokens, labels and addresses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no meaning of their own: fixed values.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "get", "got", "had", "has", "have", "having", "he", "her", "here", "hers", "herself",
    "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "let", "may", "me", "might", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on",
    "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "shall", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "us", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
)


def _folds() -> tuple[str, str]:
    """Letters with accents and their plain letters; then combining marks, which stand for nothing."""
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    letters = [c for c in plain if plain[c] != c]
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(plain[c] for c in letters)


ACCENTED, PLAIN = _folds()


def folded(col: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(col, ACCENTED, PLAIN))


def folded_words(col: Column) -> Column:
    """Runs of letters and digits in order, lower case without accents."""
    return F.regexp_extract_all(folded(col), F.lit(r"([\p{L}\p{N}]+)"))


def query_phrases(query: str) -> list[list[str]]:
    """The words of each part of a query between white space, as ``folded_words`` gives them; parts without any are left
    out and repeated ones count once."""
    plain = query.translate({**str.maketrans(ACCENTED[: len(PLAIN)], PLAIN), **{ord(c): None for c in ACCENTED[len(PLAIN) :]}}).lower()
    words = [tuple("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in part).split()) for part in plain.split()]
    return [list(w) for w in dict.fromkeys(words) if w]


def tokenize(col: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)")))


def upper_words(col: Column) -> Column:
    """Words of two or more capitals, after upper-casing, with an optional apostrophe part."""
    return F.regexp_extract_all(F.upper(col), F.lit("[A-Z]{2,}(?:'[A-Z]+)?"), 0)


def lexical_tokens(col: Column) -> Column:
    """Distinct lower-case words of two or more letters that are not stopwords, in the order of first sight."""
    words = F.regexp_extract_all(F.lower(col), F.lit("([a-z]{2,})"))  # runs: single letters have no second one beside them
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def occurrences(col: Column, word: str, whole: bool = True) -> Column:
    """How often a word occurs, as a whole word or anywhere."""
    pattern = "".join("\\" + c if not c.isalnum() and c != " " else c for c in word)
    return F.regexp_count(col, F.lit(rf"\b{pattern}\b" if whole else pattern))


def slugify(col: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate_words(col: Column, limit: int) -> Column:
    """At most ``limit`` characters; where something is cut, the last word that is left goes too, whole or not, and an
    ellipsis follows.  A single word stays."""
    cut = F.substring(col, 1, limit)
    shorter = F.when(cut.rlike(r"\S\s+\S+\s*\z"), F.regexp_replace(cut, r"\s+\S+\s*\z", "")).otherwise(F.regexp_replace(cut, r"^\s+|\s+\z", ""))
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(shorter, F.lit("…")))


def snippet(col: Column, limit: int = 240) -> Column:
    """White space collapsed, cut after ``limit`` characters with three dots."""
    flat = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("...")))


def preprocess(col: Column) -> Column:
    """Line ends as spaces, words of two or more letters broken by a hyphen rejoined, spaces collapsed."""
    flat = F.replace(F.replace(col, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    joined = F.regexp_replace(flat, r"([A-Za-z]{2,})-\s+([A-Za-z]{2,})", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def sanitize_ocr(col: Column, cap: int = 1500) -> Column:
    """Lines without white space at their ends, less blank ones and garbage: without its white space, a garbage line has a
    run of six equal characters, or eight or more of which the first 80 have under 15 % different ones.  At most ``cap``
    characters, without white space at the end where it was cut; null is empty."""
    space = r"(?U)[\s\x1c-\x1f]"
    lines = F.transform(F.split(col, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, f"^{space}+|{space}+$", ""))
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_replace(x, space, "").alias("bare")))
    head = lambda x: F.substring(x, 1, 80)
    variety = lambda x: F.size(F.array_distinct(F.split(head(x), ""))) / F.length(head(x))
    good = F.filter(marked, lambda x: (x["bare"] != "") & ~x["bare"].rlike(r"(.)\1{5}") & ((F.length(x["bare"]) < 8) | (variety(x["bare"]) >= 0.15)))
    cleaned = F.array_join(F.transform(good, lambda x: x["line"]), "\n")
    cut = F.regexp_replace(F.substring(cleaned, 1, cap), f"{space}+$", "")
    return F.coalesce(F.when(F.length(cleaned) > cap, cut).otherwise(cleaned), F.lit(""))


def box_category(col: Column) -> Column:
    """A box label without its number: ``Eyes (box 3)`` and ``Eyes 3`` are ``eyes``."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(col, r"(?i)\s*\(box\s*\d*\)\s*", ""), r"\s*\d+\s*$", "")))


def collapse_initials(col: Column) -> Column:
    """``T. S. Eliot`` as ``T.S. Eliot``: pairs of initials from the left, so of three the third stays apart."""
    return F.regexp_replace(col, r"([A-Z]\.) +([A-Z]\.)", "$1$2")


def canonical_name(col: Column, overrides: dict[str, str]) -> Column:
    """A name with collapsed initials, or the form that ``overrides`` has for it, whatever its case."""
    name = collapse_initials(col)
    if not overrides:
        return name
    known = F.create_map(*[F.lit(x) for given, form in overrides.items() for x in (given.lower(), form)])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name)


def mention_name(col: Column) -> Column:
    """A mention without its trailing ``[category]``."""
    return F.trim(F.regexp_replace(col, r"\s*\[[^\]]*\]\s*$", ""))


def mention_category(col: Column) -> Column:
    """The trailing ``[category]`` of a mention, or the empty text."""
    return F.regexp_extract(col, r"\[([^\]]*)\]\s*$", 1)


def catalog_id(year: Column, number: Column) -> Column:
    """``JS-{year or 0000}-T{number}``."""
    return F.concat(F.lit("JS-"), F.coalesce(F.lpad(year.cast("string"), 4, "0"), F.lit("0000")), F.lit("-T"), number.cast("string"))


def _plain(number: Column) -> Column:
    """To one decimal, without a trailing ``.0``."""
    return F.regexp_replace(F.format_number(F.round(number, 1), 1), r"\.0$|,", "")


def both_units(inches: Column) -> Column:
    """A length in inches and centimetres, without a trailing ``.0``."""
    return F.concat(_plain(inches), F.lit(" in ("), _plain(inches * 2.54), F.lit(" cm)"))


def dimensions(height: Column, width: Column, extent: Column) -> Column:
    """``h × w in (h × w cm)`` from texts that are numbers, one length where only one is, else the extent as it is."""
    shape = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
    number = lambda c: F.when(c.cast("string").rlike(shape), F.trim(c.cast("string")).try_cast("double"))
    h, w = number(height), number(width)
    both = F.concat(_plain(h), F.lit(" × "), _plain(w), F.lit(" in ("), _plain(h * 2.54), F.lit(" × "), _plain(w * 2.54), F.lit(" cm)"))
    return F.coalesce(both, both_units(F.coalesce(h, w)), F.when(extent != "", extent))


def split_values(col: Column) -> Column:
    """Values of a field: a JSON list, else its lines if there are several, else the text itself."""
    listed = F.from_json(col, "array<string>")
    lines = F.filter(F.transform(F.split(col, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(col.startswith("["), F.coalesce(listed, F.array(col))).when(F.size(lines) > 1, lines).otherwise(F.array(F.trim(col)))


def strip_fences(col: Column) -> Column:
    """An answer without Markdown fences; ``NULL`` is empty."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    return F.when(F.upper(bare) == "NULL", "").otherwise(bare)


def outer_list(col: Column) -> Column:
    """The text from the first opening to the last closing square bracket, or null."""
    found = F.regexp_extract(col, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def data_types(col: Column) -> Column:
    """A list of data types given as JSON or separated by commas."""
    return F.coalesce(F.from_json(col, "array<string>"), F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != ""))


def canonical_url(col: Column, host: str) -> Column:
    """The address on the canonical host."""
    return F.regexp_replace(col, r"^https?://[^/]+", f"https://{host}")


def work_label(medium: Column, support: Column) -> Column:
    """``medium on support``, or the one that is there."""
    return F.concat_ws(" on ", F.when(medium != "", medium), F.when(support != "", support))


def is_noise(col: Column) -> Column:
    """Camera timestamps and media types, which displays leave out."""
    return col.rlike(r"^\d{4}:\d{2}:\d{2} |^\d{4}-\d{2}-\d{2}T|^(image|video|audio|application)/")
