"""Detail pages to field texts by column functions alone: the form of ``detail_page`` without a Python worker (part of X13).

A page becomes an array of tokens. One ``aggregate`` over them keeps the open elements and emits, for every element, the
range of text pieces that it covers. The listed element tests then are filters on that array. No Python worker runs, and a
page never leaves its row.
"""

import json
import re
from functools import cache
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from adlake.operators.detail_page import (
    COMPANY, DESCRIPTION, ENDS, LOCATION, REQUIREMENTS, SALARY, TAG_BOX, TAGS, TITLE, VOID,
)

# The rules by which a start tag ends an open element: first a paragraph, then its like.
_LIKE = {tag: rules[-1] for tag, rules in ENDS.items() if rules[-1][0] != {"p"}}
_ENDS_P = [tag for tag, rules in ENDS.items() if rules[0][0] == {"p"}]
_P_STOPS = {"p"} | ENDS["p"][0][1]
_HIDDEN = "template"  # scripts and styles are single tokens without text

# A quoted value may hold a closing bracket. Beyond 256 attributes of one tag the tag ends at the first bracket, which keeps
# the matcher's stack bounded.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
          rf"|<[a-z][^\s/>]*+[^>=]*+(?:=\s*+{_VALUE}?+[^>=]*+){{0,256}}+>|</?[a-z][^>]*+>|<[!?][^>]*+>|[^<]++|<")
_ATTRIBUTE = rf"""(?is)([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}?+))?+"""
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _padded(values) -> str:
    """Tags as one text, in which a tag between blanks is looked up."""
    return f" {' '.join(sorted(values))} "


@cache
def _names() -> str:
    """Names of characters as the language's own library lists them, shorter ones first, as JSON."""
    return json.dumps(dict(sorted(html5.items(), key=lambda item: (len(item[0]), item[0]))))


@cache
def _loose_names() -> str:
    """A pattern of the names that need no semicolon, longer ones first."""
    return "|".join(sorted((re.escape(n) for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _named() -> Column:
    return F.from_json(F.lit(_names()), "map<string,string>")


def _code_point(digits: Column) -> Column:
    """The character of a number given as x and hex digits or as decimal digits."""
    hexed = F.lower(F.substring(digits, 1, 1)) == "x"
    figures = F.regexp_replace(F.when(hexed, F.substring(digits, 2, 1 << 20)).otherwise(digits), "^0+(?=.)", "")
    number = F.when(F.length(figures) > 8, F.lit(0x110000)).otherwise(
        F.when(hexed, F.conv(figures, 16, 10)).otherwise(figures).cast("bigint"))
    windows = F.from_json(F.lit(json.dumps({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})),
                          "map<string,string>")

    def char(n):
        unusable = (n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF)
        mapped = F.when((n >= 0x80) & (n < 0xA0), F.try_element_at(windows, n.cast("string")))
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(unusable, F.lit(0xFFFD)).otherwise(n)), 8, "0")), "UTF-32")
        return F.coalesce(mapped, plain)

    return _let(number, char)


def decoded(markup: Column) -> Column:
    """Character references as characters: numbers, names, and the names that need no semicolon."""
    def part(p):
        digits = F.regexp_extract(p, "^&#([xX][0-9a-fA-F]+|[0-9]+);?", 1)
        number = F.regexp_extract(p, "^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
        full, short = F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(p, f"^&({_loose_names()})", 1)
        known = F.try_element_at(_named(), full)
        return (F.when(~F.startswith(p, F.lit("&")), p)
                .when(digits != "", F.concat(_code_point(digits), F.substring(p, F.length(number) + 1, F.length(p))))
                .when(known.isNotNull(), F.concat(known, F.substring(p, F.length(full) + 2, F.length(p))))
                .when(short != "", F.concat(F.try_element_at(_named(), short), F.substring(p, F.length(short) + 2, F.length(p))))
                .otherwise(p))

    return F.when(F.contains(markup, F.lit("&")), F.array_join(F.transform(F.split(markup, "(?=&)"), part), "")).otherwise(markup)


def _attribute(tag: Column, name: str) -> Column:
    """The last value of an attribute, empty without one."""
    inner = F.regexp_replace(tag, r"(?i)^<[a-z][^\s/>]*|/?>$", "")
    names, values = (F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(group)) for group in (1, 2))
    pairs = F.filter(F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), v.alias("v"))), lambda p: F.lower(p["n"]) == name)
    value = F.coalesce(_last(pairs)["v"], F.lit(""))
    return F.when(F.lower(tag).contains(name), decoded(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))).otherwise("")


def _token(text: Column, place: Column) -> Column:
    """What the fold and the tests need of a token; ``kind`` is start, end, text or other."""
    none = F.lit(None).cast("string")

    def token(kind, tag=F.lit(""), words=F.lit(""), href=F.lit(""), shown=F.lit(""), opens=F.lit(False), rules=(none, none, none, none)):
        names = ("ends", "stops", "like_ends", "like_stops")
        padded = F.when(words != "", F.concat(F.lit(" "), F.regexp_replace(words, r"(?U)\s+", " "), F.lit(" "))).otherwise("")
        return F.struct(place.alias("i"), F.lit(kind).alias("kind"), tag.alias("tag"), words.alias("class"), padded.alias("words"),
                        href.alias("href"), shown.alias("text"), opens.alias("opens"), *[r.alias(n) for r, n in zip(rules, names)])

    def start(tag):
        like_ends, like_stops = none, none
        for name, (ended, fences) in _LIKE.items():
            like_ends = F.when(tag == name, _padded(ended)).otherwise(like_ends)
            like_stops = F.when(tag == name, _padded(ended | fences)).otherwise(like_stops)
        ends_p, has_like = tag.isin(_ENDS_P), tag.isin(list(_LIKE))
        rules = (F.when(ends_p, _padded(["p"])), F.when(ends_p, _padded(_P_STOPS)), F.when(has_like, like_ends), F.when(has_like, like_stops))
        href = F.when(tag == "a", _attribute(text, "href")).otherwise("")
        return _let(_attribute(text, "class"), lambda words: token(
            "start", tag, words, href, opens=~tag.isin(*sorted(VOID), "script", "style"), rules=rules))

    name = F.lower(F.regexp_extract(text, r"(?i)^</?([a-z][^\s/>]*)", 1))
    return (F.when(text.rlike("^(?:[^<]|<$)"), token("text", shown=decoded(text)))
            .when(text.rlike("(?i)^<[a-z]"), _let(name, start))
            .when(text.rlike("(?i)^</[a-z]"), _let(F.concat(F.lit(" "), name, F.lit(" ")), lambda tag: token("end", rules=(tag, tag, none, none))))
            .otherwise(token("other")))


def tokens(markup: Column) -> Column:
    return F.transform(F.regexp_extract_all(markup, F.lit(_TOKEN), F.lit(0)), _token)


_OPEN = "array<struct<i:int,tag:string,depth:int,since:int,boxed:boolean,inbox:boolean,hidden:boolean>>"
_OUT = "array<struct<i:int,since:int,until:int,boxed:boolean>>"


def _still_open(stack: Column, ends: Column, stops: Column) -> Column:
    """The stack below the last element among ``stops``, if that is one to end."""
    def cut(found):
        return F.when(F.contains(ends, found["tag"]), F.slice(stack, F.lit(1), found["depth"] - 1)).otherwise(stack)

    return F.when(stops.isNull(), stack).otherwise(_let(_last(F.filter(stack, lambda e: F.contains(stops, e["tag"]))), cut))


def _fold(page: Column) -> Column:
    """(i, since, until, boxed) of every element, and of every shown text: pieces ``since`` up to ``until``.

    A step computes its move (the new stack and what it emits) and takes up the emissions of the move before. These wait in
    arrays of a few hundred, so that the whole result is not copied at each tag; ``_let`` copies, so only moves are in one.
    """
    def closed(elements, pieces):
        return F.transform(elements, lambda e: F.struct(e["i"].alias("i"), e["since"].alias("since"), pieces.alias("until"), e["boxed"].alias("boxed")))

    def step(acc, t):
        stack, pieces = acc["move"]["stack"], acc["pieces"]
        shown = (t["kind"] == "text") & ~F.coalesce(_last(stack)["hidden"], F.lit(False))

        def empty_at(boxed):
            return F.array(F.struct(t["i"].alias("i"), pieces.alias("since"), pieces.alias("until"), boxed.alias("boxed")))

        def as_tag(left):
            boxed, hidden = (F.coalesce(_last(left)[c], F.lit(False)) for c in ("inbox", "hidden"))
            is_box = (t["tag"] == TAG_BOX[0]) & t["words"].contains(f" {TAG_BOX[2]} ")
            entry = F.struct(t["i"].alias("i"), F.concat(F.lit(" "), t["tag"], F.lit(" ")).alias("tag"), (F.size(left) + 1).alias("depth"), pieces.alias("since"), boxed.alias("boxed"),
                             (boxed | is_box).alias("inbox"), (hidden | (t["tag"] == _HIDDEN)).alias("hidden"))
            gone = closed(F.slice(stack, F.size(left) + 1, F.size(stack)), pieces)
            return F.struct(F.when(t["opens"], F.concat(left, F.array(entry))).otherwise(left).alias("stack"),
                            F.when((t["kind"] == "start") & ~t["opens"], F.concat(gone, empty_at(boxed))).otherwise(gone).alias("fresh"))

        left = _still_open(_still_open(stack, t["ends"], t["stops"]), t["like_ends"], t["like_stops"])
        move = (F.when(shown, F.struct(stack.alias("stack"), empty_at(F.lit(False)).alias("fresh")))
                .when(t["kind"].isin("start", "end"), _let(left, as_tag))
                .otherwise(F.struct(stack.alias("stack"), F.array().cast(_OUT).alias("fresh"))))
        full = F.size(acc["held"]) >= _CHUNK
        return F.struct(move.alias("move"), F.when(shown, pieces + 1).otherwise(pieces).alias("pieces"),
                        F.when(full, acc["move"]["fresh"]).otherwise(F.concat(acc["held"], acc["move"]["fresh"])).alias("held"),
                        F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]).alias("done"))

    begin = F.expr(f"named_struct('move', named_struct('stack', cast(array() as {_OPEN}), 'fresh', cast(array() as {_OUT})), 'pieces', 0, "
                   f"'held', cast(array() as {_OUT}), 'done', cast(array() as array<{_OUT}>))")
    return F.aggregate(page, begin, step, lambda acc: F.sort_array(
        F.concat(F.flatten(acc["done"]), acc["held"], acc["move"]["fresh"], closed(acc["move"]["stack"], acc["pieces"]))))


def _matching(test: tuple) -> str:
    """The elements that pass a test, as SQL."""
    tag, kind, part = (*test, "", "")[:3]
    conditions = [f"e.tag = '{tag}'"] if tag else []
    if kind:
        conditions.append(f"contains(e.words, ' {part} ')" if kind == "word" else f"contains(e.{kind}, '{part}')")
    return f"filter(_elements, e -> {' AND '.join(conditions)})"


def _text(joiner: str = "") -> str:
    """Text of an element e: its pieces stripped, the empty ones left out."""
    return f"array_join(filter(slice(_stripped, e.since + 1, e.until - e.since), p -> p <> ''), '{joiner}')"


def _first(tests: list, accept: str, joiner: str = "") -> str:
    """Text of the first element of the first test whose text is accepted."""
    each = [f"get(filter(transform(slice({_matching(test)}, 1, 1), e -> {_text(joiner)}), text -> {accept}), 0)" for test in tests]
    return f"coalesce({', '.join(each)})"


def read_fields(pages: DataFrame) -> DataFrame:
    """(page_id, url) with the fields of ``detail_page`` of each page, null where no element qualifies.

    Empty or null pages have an empty text and heading and no tags. Unclosed elements end with the page; an end tag without
    its start is passed over; a page of any length is one row.
    """
    read = pages.select("page_id", "url", tokens(F.coalesce("html", F.lit(""))).alias("_tokens"))
    folded = read.select("*", _fold(F.col("_tokens")).alias("_ranges"))
    outlined = folded.selectExpr("page_id", "url", """transform(_ranges, r -> get(transform(array(get(_tokens, r.i)), t -> struct(
        r.since, r.until, r.boxed, t.kind, t.tag, t.class, t.words, t.href, t.text)), 0)) AS _all""")
    split = outlined.selectExpr("page_id", "url", "filter(_all, e -> e.kind = 'start') AS _elements",
                                "transform(filter(_all, e -> e.kind = 'text'), e -> e.text) AS _pieces")
    ready = split.withColumn("_stripped", F.transform("_pieces", lambda p: F.regexp_replace(p, _STRIP, "")))
    tagged = ", ".join([*map(_matching, TAGS), "filter(_elements, e -> e.tag = 'span' AND e.boxed)"])
    return ready.selectExpr(
        "page_id", "url", "array_join(_pieces, '') AS page_text",
        f"coalesce({_first([('h1',)], 'true')}, '') AS heading",
        f"{_first(TITLE, 'length(text) > 5')} AS title",
        *[f"{_first(tests, given, joiner)} AS {name}" for name, tests, given, joiner in (
            ("company_name", COMPANY, "text <> ''", ""), ("description", DESCRIPTION, "text <> ''", "\\n"),
            ("requirements", REQUIREMENTS, "text <> ''", "\\n"), ("salary", SALARY, "text RLIKE '[0-9]'", ""),
            ("location", LOCATION, "text <> ''", ""))],
        f"array_distinct(filter(transform(concat({tagged}), e -> {_text()}), t -> length(t) > 1)) AS tags")
