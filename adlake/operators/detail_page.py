"""One detail page to its field texts: the only per-row Python step (part of X13).

Spark partitions the pages; this helper sees one page at a time inside mapInArrow.
"""

from html.parser import HTMLParser

# --- fixed values: element tests per field, tried in order ------------------
# (tag or any, attribute, text the attribute contains); "word" asks for a whole class name instead
TITLE = [("h1",), ("h1", "word", "posting-title"), ("", "class", "title")]
COMPANY = [("", "class", "company"), ("a", "href", "/company/"), ("div", "word", "company-name"), ("span", "word", "company")]
DESCRIPTION = [("", "class", "description"), ("", "class", "about"), ("section", "word", "job-description"),
               ("div", "word", "description")]
REQUIREMENTS = [("", "class", "requirement"), ("", "class", "must-have"), ("section", "word", "requirements")]
SALARY = [("", "class", "salary"), ("", "class", "money"), ("span", "word", "salary"), ("div", "word", "salary-range")]
LOCATION = [("", "class", "location"), ("", "class", "city"), ("span", "word", "location"), ("div", "word", "location")]
TAGS = [("", "class", "technology"), ("", "class", "skill"), ("", "class", "tech-"), ("span", "word", "tag")]
TAG_BOX = ("div", "word", "tags")  # all spans inside count, after the tests above
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
# A start tag ends an open element of these, looked for up to the nearest of the fences.
_BLOCKS = ("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
           "nav ol p pre section table ul").split()
_P_FENCE = {"button", "caption", "table", "td", "th"}
ENDS = {
    **{block: [({"p"}, _P_FENCE)] for block in _BLOCKS},
    "li": [({"p"}, _P_FENCE), ({"li"}, {"ul", "ol"})],
    **{tag: [({"p"}, _P_FENCE), ({"dt", "dd"}, {"dl"})] for tag in ("dt", "dd")},
    **{tag: [({"td", "th"}, {"tr", "table"})] for tag in ("td", "th")},
    "tr": [({"tr"}, {"table"})],
    **{tag: [({"thead", "tbody", "tfoot"}, {"table"})] for tag in ("thead", "tbody", "tfoot")},
    "option": [({"option"}, {"select"})],
}
# --- end of fixed values ----------------------------------------------------


def _passes(element, test):
    tag, kind, part = (*test, "", "")[:3]
    if tag and element["tag"] != tag:
        return False
    if kind == "word":
        return part in element["attrs"].get("class", "").split()
    return not kind or part in element["attrs"].get(kind, "")


class _Outline(HTMLParser):
    """Elements in document order, each with the range of text pieces it covers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.elements, self.open, self.hidden = [], [], [], 0
        self.by_tag, self.with_class = {}, []

    def handle_starttag(self, tag, attrs):
        for ended, fences in ENDS.get(tag, ()):
            for element in reversed(self.open):
                if element["tag"] in ended:
                    self.handle_endtag(element["tag"])
                    break
                if element["tag"] in fences:
                    break
        element = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "from": len(self.pieces), "to": len(self.pieces),
                   "boxed": bool(self.open) and (self.open[-1]["boxed"] or _passes(self.open[-1], TAG_BOX))}
        self.elements.append(element)
        self.by_tag.setdefault(tag, []).append(element)
        if element["attrs"].get("class"):
            self.with_class.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not any(e["tag"] == tag for e in self.open):
            return
        while self.open:
            element = self.open.pop()
            element["to"] = len(self.pieces)
            self.hidden -= element["tag"] in HIDDEN
            if element["tag"] == tag:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag(self.open[-1]["tag"])

    def matching(self, test):
        among = self.by_tag.get(test[0], []) if test[0] else self.with_class if test[1] == "class" else self.elements
        return [e for e in among if _passes(e, test)]

    def text(self, element, joiner=""):
        pieces = (p.strip() for p in self.pieces[element["from"]:element["to"]])
        return joiner.join(p for p in pieces if p)

    def first(self, tests, accept, joiner=""):
        """Text of the first element of the first test whose text is accepted."""
        for test in tests:
            found = self.matching(test)
            if found:
                text = self.text(found[0], joiner)
                if accept(text):
                    return text
        return None


FIELDS = ("page_text", "heading", "title", "company_name", "description", "requirements", "salary", "location", "tags")


def read_fields(html):
    """Field texts of one page, in FIELDS order; null where no element qualifies."""
    page = _Outline()
    page.feed(html or "")
    page.close()
    headings = page.matching(("h1",))
    tag_elements = [e for test in TAGS for e in page.matching(test)]
    tag_elements += [e for e in page.elements if e["tag"] == "span" and e["boxed"]]
    tags = list(dict.fromkeys(t for t in map(page.text, tag_elements) if len(t) > 1))
    return (
        "".join(page.pieces),
        page.text(headings[0]) if headings else "",
        page.first(TITLE, lambda t: len(t) > 5),
        page.first(COMPANY, bool),
        page.first(DESCRIPTION, bool, "\n"),
        page.first(REQUIREMENTS, bool, "\n"),
        page.first(SALARY, lambda t: any("0" <= c <= "9" for c in t)),
        page.first(LOCATION, bool),
        tags,
    )
