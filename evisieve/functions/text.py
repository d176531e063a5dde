"""Text expressions: tokens, identifier parts, token estimates, similarity and globs. All are JVM-side Columns."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that form CJK runs, those that count as wide in token estimates, and stop words.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
WIDE = "　-〿" + CJK + "＀-￯"
TOKEN = f"[A-Za-z][A-Za-z0-9_$]*|[0-9]+(?:\\.[0-9]+)*|[{CJK}]+"
STOP_WORDS = tuple(
    "the a an of to and or in on for is are be it this that with as by at from we you i not if then else do does can will "
    "was were has have had but so than into via use used using "
    "する した して ある いる これ それ その この ため こと もの など よう から まで です ます ない なる により および または".split()
)
WIDE_A_TOKEN, CHARS_A_TOKEN = 1.05, 3.7


def identifier_parts(word: Column) -> Column:
    """Lower-case parts of snake_case, camelCase and ACRONYMWord identifiers."""
    spaced = F.regexp_replace(word, "[_$]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(spaced), " +"), lambda p: p != "")


def _expanded(word: Column) -> Column:
    low = F.lower(word)
    n = F.length(word)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.array(F.substring(word, i, F.lit(1)), F.substring(word, i, F.lit(2)))).otherwise(F.array(F.substring(word, i, F.lit(1))))))
    none = F.array().cast("array<string>")
    whole = F.when(n >= 2, F.array(low)).otherwise(none)
    # Only words with an inner capital, an underscore or a dollar sign have parts other than themselves.
    parts = F.when((n > 3) & word.rlike("[_$]|.[A-Z]"), F.filter(identifier_parts(word), lambda p: (F.length(p) >= 2) & (p != low))).otherwise(none)
    return F.when(word.rlike(f"^[{CJK}]"), grams).otherwise(F.concat(whole, parts))


#: Tokens of two characters or more, for texts without CJK runs and compound words: shorter ones don't count there.
_PLAIN = r"[A-Za-z][A-Za-z0-9_$]+|[0-9]{2,}(?:\.[0-9]+)*|[0-9](?:\.[0-9]+)+"
_COMPOUND = f"[{CJK}_$]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"


def tokens(text: Column, stop_words: bool = False) -> Column:
    """All tokens of a text in order, duplicates kept; null text: none. stop_words: drop them (query side).

    Most texts hold nothing that breaks into several tokens; for them one expression and one change of case do.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(_PLAIN), 0), " "))
    plain = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))
    found = F.when(text.rlike(_COMPOUND), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), _expanded))).otherwise(plain)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop_words else found


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has; 0 for null and empty texts."""
    wide = F.regexp_count(text, F.lit(f"[{WIDE}]")).cast("double")
    units = F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))  # UTF-16 units
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise((F.ceil(wide * WIDE_A_TOKEN + (units - wide) / CHARS_A_TOKEN) + 1).cast("int"))


#: Edits up to which a name may be meant for another.
MOST_EDITS = 2


def nearest_name(name: Column, known: list[str], most: int = MOST_EDITS) -> Column:
    """The known name within `most` edits (struct of distance and suggestion; null if none): the nearest, then by name."""
    near = [F.when(F.levenshtein(name, F.lit(k)) <= most, F.struct(F.levenshtein(name, F.lit(k)).alias("distance"), F.lit(k).alias("suggestion"))) for k in known]
    return F.array_min(F.array_compact(F.array(*near)))


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def overlap_ratio(terms: Column, words: Column) -> Column:
    """The share of `terms` (distinct) that occur in `words`."""
    return F.when((F.size(terms) > 0) & (F.size(words) > 0), F.size(F.array_intersect(terms, words)) / F.size(terms)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; of two empty ones 0."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both, F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision of two equally long float arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length 1; zero vectors stay."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def glob_regex(glob: str) -> str:
    """A glob (`**/`, `**`, `*`, `?`, `{a,b}`) as an anchored regular expression."""
    rules = [("**/", "(?:[^/]*/)*"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")]
    out, i = [], 0
    while i < len(glob):
        group = re.match(r"\{([^}]*)\}", glob[i:])
        if group:
            out.append("(?:" + "|".join(map(re.escape, group[1].split(","))) + ")")
            i += group.end()
            continue
        key, value = next(((k, v) for k, v in rules if glob.startswith(k, i)), (glob[i], re.escape(glob[i])))
        out.append(value)
        i += len(key)
    return "\\A" + "".join(out) + "\\z"


def any_glob(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """True if one of the globs matches; one alternation, compiled once."""
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


# Plain Python versions, for single query texts on the driver and for sequential operators.

_TOKEN = re.compile(TOKEN)
_IS_CJK = re.compile(f"[{CJK}]")
_DIVIDED = re.compile("[_$]|.[A-Z]")
_STOPPED = frozenset(STOP_WORDS)
_WIDE = re.compile(f"[{WIDE}]")


def py_parts(word: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[_$]+", " ", word))
    return re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", " ", spaced).lower().split()


def word_terms(word: str) -> tuple[str, ...]:
    """Tokens of one match of TOKEN, in order."""
    if _IS_CJK.match(word):
        return tuple(gram for i in range(len(word)) for gram in ((word[i : i + 1], word[i : i + 2]) if i + 1 < len(word) else (word[i],)))
    low = word.lower()
    # Only words with an inner capital, an underscore or a dollar sign have parts other than themselves.
    parts = [p for p in py_parts(word) if len(p) >= 2 and p != low] if len(word) > 3 and _DIVIDED.search(word) else []
    return (low, *parts) if len(word) >= 2 else tuple(parts)


def py_tokens(text: str | None, stop_words: bool = False) -> list[str]:
    out = [t for word in _TOKEN.findall(text or "") for t in word_terms(word)]
    return [t for t in out if t not in STOP_WORDS] if stop_words else out


#: Longer words are broken up each time; of others so many are remembered by a worker.
_SHORT_WORD, _REMEMBERED = 32, 1 << 16
#: Characters of which words are found at a time; a part ends before a space.
_PART = 1 << 20


def _parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = text.find(" ", at + _PART)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


#: What needs letters and dots as they are: inner capitals that begin a part, and numbers with dots.
_AS_IT_IS = re.compile(r"[A-Z](?:(?<=[a-z0-9].)|[A-Z][a-z])|[0-9]\.[0-9]")
#: Bytes that end words become blanks, those of other scripts too; the second table makes lower case and blanks of dots as well.
_INSIDE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.")
_ENDS = bytes(b if b in _INSIDE else 32 for b in range(256))
_LOW_ENDS = _ENDS.lower().replace(b".", b" ")
_CJK_RUN = re.compile(f"[{CJK}]+")


def piece_terms(piece: str) -> tuple[str, ...]:
    """Tokens of what stands between two ends of words, in order."""
    return tuple(term for word in _TOKEN.findall(piece) for term in word_terms(word))


_known_terms = lru_cache(_REMEMBERED)(piece_terms)


def count_terms(counts: dict[str, int], text: str | None, weight: int = 1) -> int:
    """Adds `weight` to each token's count, as often as it occurs in the text; the number of tokens.

    A word is broken up once a text, however often it occurs; most words are a token as they are.
    """
    words = Counter()
    for part in _parts(text or ""):
        words.update(part.encode().translate(_ENDS if _AS_IT_IS.search(part) else _LOW_ENDS).decode().split())
        if not part.isascii():
            words.update(_CJK_RUN.findall(part))
    others = [(piece, words.pop(piece)) for piece in [p for p in words if not (p.islower() and p.isalpha() and len(p) > 1)]]
    if counts or weight != 1:
        for word, n in words.items():
            counts[word] = counts.get(word, 0) + n * weight
    else:
        counts.update(words)
    total = words.total()
    for piece, n in others:
        terms = _known_terms(piece) if len(piece) <= _SHORT_WORD else piece_terms(piece)
        total += n * len(terms)
        for term in terms:
            counts[term] = counts.get(term, 0) + n * weight
    return total


def query_terms(text: str | None) -> dict[str, float]:
    """Weight of each term of a query: how often it occurs, stop words left out."""
    counts: dict[str, int] = {}
    count_terms(counts, text)
    return {t: float(n) for t, n in counts.items() if t not in _STOPPED}


def utf16_length(text: str) -> int:
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def py_token_estimate(text: str | None) -> int:
    if not text:
        return 0
    wide = len(_WIDE.findall(text))
    return math.ceil(wide * WIDE_A_TOKEN + (utf16_length(text) - wide) / CHARS_A_TOKEN) + 1


def truncated(text: str, most: int, mark: str = "\n…(truncated)") -> str:
    """The longest prefix whose estimate is at most `most`, and a mark; whole texts that fit stay as they are."""
    if py_token_estimate(text) <= most:
        return text
    lo, hi = 0, len(text)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if py_token_estimate(text[:mid]) <= most else (lo, mid - 1)
    return text[:lo] + mark
