"""Text cleaning, keyword search and display formats."""

import json
import re
from functools import reduce

from pyspark.sql import Column, functions as F

from adlake import fixed_values as fv

# Unicode white space plus the four ASCII separators that str.split() also treats as space.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"[\p{L}\p{N}_]"


def literal_rows(rows: list[dict[str, str]]) -> Column:
    """A short list of text records as one constant array; folded to a literal when the query is planned."""
    fields = ", ".join(f"{name}: string" for name in rows[0])
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once per row; inside a lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_inside(low: Column, listed: Column) -> Column:
    """The first record of a lookup whose ``key`` occurs in the lower-cased text."""
    return bound(low, lambda text: F.get(F.filter(listed, lambda r: text.contains(r["key"])), F.lit(0)))


def any_of(text: Column, words: list[str]) -> Column:
    """True when the text contains one of the words; null text is null."""
    return reduce(lambda x, y: x | y, [text.contains(w) for w in words], F.lit(False))


def clean_text(text: Column) -> Column:
    """collapse white space, trim, delete NUL, empty becomes null (in that order)."""
    collapsed = F.trim(F.regexp_replace(text, WHITESPACE, " "))
    return F.nullif(F.replace(collapsed, F.lit("\x00"), F.lit("")), F.lit(""))


def truncate_description(text: Column, max_length: int | None = None) -> Column:
    """Collapse white space; where the caller gives a length, cut to it and mark the cut with '...'."""
    collapsed = F.regexp_replace(F.nullif(text, F.lit("")), WHITESPACE, " ")
    if max_length is None:
        return collapsed
    return F.when(
        F.length(collapsed) > max_length, F.concat(F.substring(collapsed, 1, max_length), F.lit("..."))
    ).otherwise(collapsed)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _whole_word(keyword: str) -> str:
    """Regex for a lower-cased keyword between word boundaries, spelled out so that they are Unicode-exact.

    The literal comes first and the look-behind runs back over it: the engine then searches for plain text.
    """
    literal = re.escape(keyword)
    ahead = "(?!" if _is_word(keyword[-1]) else "(?="
    behind = "(?<!" if _is_word(keyword[0]) else "(?<="
    return f"{literal}{ahead}{_WORD}){behind}{_WORD}{literal})"


def whole_word(low: Column) -> Column:
    """The same regex for a column of lower-cased keywords."""
    literal = F.regexp_replace(low, r"([^\p{L}\p{N}_])", r"\\$1")
    ahead = F.when(F.rlike(low, F.lit(_WORD + r"\z")), "(?!").otherwise("(?=")
    behind = F.when(F.rlike(low, F.lit(r"\A" + _WORD)), "(?<!").otherwise("(?<=")
    return F.concat(literal, ahead, F.lit(_WORD + ")"), behind, F.lit(_WORD), literal, F.lit(")"))


def words_of(low: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(low, F.lit(f"({_WORD}+)"))


def folded(text: Column) -> Column:
    """Lower case, with the four letters that ignore-case search equates with i, s and k."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def find_keywords(text: Column, keywords: list[str] = fv.TECHNOLOGY_KEYWORDS) -> Column:
    """Listed keywords that occur as whole words, ignoring case, in list order.

    The text is folded once; a keyword's regex runs only where the plain substring search has found it.
    """
    keywords = list(dict.fromkeys(keywords))
    if not keywords:
        return F.array().cast("array<string>")
    listed = literal_rows([{"name": k, "key": k.lower(), "rx": _whole_word(k.lower())} for k in keywords])

    def hits(folded: Column) -> Column:
        kept = F.filter(listed, lambda k: folded.contains(k["key"]) & F.rlike(folded, k["rx"]))
        return F.transform(kept, lambda k: k["name"])

    return bound(folded(text), hits)


def employment_type(text: Column) -> Column:
    """First group of words found in the lower-cased text, else null."""
    low = F.lower(text)
    out = None
    for label, words in fv.EMPLOYMENT_WORDS:
        hit = any_of(low, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def pln(amount: Column) -> Column:
    """Thousands separators and currency, or N/A."""
    return F.coalesce(F.concat(F.format_number(amount, 0), F.lit(" PLN")), F.lit("N/A"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent as double; null when the whole is zero."""
    return F.try_divide(part.cast("double") * F.lit(100.0).cast("double"), whole.cast("double"))


def title_case(text: Column) -> Column:
    """N15."""
    return F.initcap(text)
