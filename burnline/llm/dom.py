"""A small DOM: parsing, the parts of a page that are not its article, and the blocks of text of a region."""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

# HTML elements by their role, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead title tr ul""".split())
NOT_TEXT = frozenset("""head title script style noscript template iframe object svg math canvas audio video map form button
    select textarea input datalist nav menu aside footer dialog search""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset("""ad ads advert advertisement adverts sponsor sponsored promo promotion sidebar nav navbar navigation menu
    breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social
    related recommended comment comments disqus respond replies toolbar pagination""".split())
OUTER_WORDS = frozenset("header masthead banner topbar".split())  # outside the article only
STATES = frozenset("no not has have with without is open closed enabled disabled".split())  # "no-sidebar" is no sidebar
WHOLE = frozenset("html body main article".split())  # whose names say nothing about their text
# Within an article, a name of several words decides only if all are of WORDS or of these,
PLACES = frozenset("""box bar list link links button buttons post posts block section widget wrapper container wrap area form
    signup item items banner top bottom left right inner outer slot unit panel icon icons thread count text""".split())
# and on the elements an article's text is made of, only those of ADVERTS.
PROSE = frozenset("a b blockquote caption cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q small strong td th u".split())
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}}

TEXT = "#text"


class Dom(HTMLParser):
    """Nodes in page order: ``tag`` (TEXT for text), ``parent``, ``text``, ``role``, ``names`` (class and id) and
    ``words``, the words of names of several words."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.text, self.role = ["#page"], [-1], [""], [""]
        self.names, self.words = [frozenset()], [frozenset()]
        self._open, self._n_open = [0], defaultdict(int)  # and how many are open of each tag
        self.feed(html)
        self.close()
        self.children: list[list[int]] = [[] for _ in self.tag]
        for i, p in enumerate(self.parent[1:], 1):
            self.children[p].append(i)

    def _add(self, tag: str, text: str = "", role: str = "", names: frozenset = frozenset(), words: frozenset = frozenset()) -> int:
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.text.append(text)
        self.role.append(role)
        self.names.append(names)
        self.words.append(words)
        return len(self.tag) - 1

    def _end(self, tags: set[str], scope: set[str] | frozenset[str]) -> None:
        n_open = self._n_open
        for tag in tags:
            if n_open[tag]:
                break
        else:
            return
        for at in range(len(self._open) - 1, 0, -1):
            if (tag := self.tag[self._open[at]]) in tags:
                for i in self._open[at:]:
                    self._n_open[self.tag[i]] -= 1
                del self._open[at:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:  # a block ends an open paragraph
            self._end({"p"}, BLOCK - {"p"})
        if tag in CLOSED_BY:
            self._end(CLOSED_BY[tag], SCOPE[tag])
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        names, words = frozenset(f"{named.get('class', '')} {named.get('id', '')}".lower().split()), set()
        for name in names:
            parts = re.findall(r"[^\W_]+", name)
            if STATES.isdisjoint(parts):
                words.update(parts)
        node = self._add(tag, "", named.get("role", "").strip().lower(), names, frozenset(words))
        if tag not in VOID:
            self._open.append(node)
            self._n_open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end({tag}, set() if tag in BLOCK or tag in NOT_TEXT else BLOCK)

    def handle_data(self, data: str) -> None:
        if data:
            self._add(TEXT, data)

    def unknown_decl(self, data: str) -> None:  # <![CDATA[...]]> in HTML is a comment
        pass

    def outside(self, named: bool = True) -> list[bool]:
        """Which nodes lie in parts that are not the article: by element, role, or (if ``named``) class or id.

        A name of one word decides; a word of a longer name only if the element neither holds an ``article`` or
        ``main`` nor over half of the page's text, nor lies within one of those and has a name of which a word is
        neither of ``WORDS`` nor of ``PLACES`` ("share-prices"). Within an ``article`` or ``main``, names of ``PROSE``
        elements decide only if of ``ADVERTS``, and names of ``WHOLE`` elements decide nothing anywhere."""
        out, inner = [False] * len(self.tag), [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            p, tag = self.parent[i], self.tag[i]
            inner[i] = inner[p] or tag in ("article", "main")
            out[i] = (out[p] or tag in NOT_TEXT or self.role[i] in ROLES or not inner[i] and tag == "header")
        if not named:
            return out
        some = [i for i in range(1, len(self.tag)) if self.words[i] and self.tag[i] not in WHOLE
                and not (WORDS.isdisjoint(self.words[i]) and OUTER_WORDS.isdisjoint(self.words[i]))]
        if not some:
            return out
        holds: set[int] = set()
        if any(self.words[i] - self.names[i] for i in some):
            holds = self._holders(out)
        by_name = set()
        for i in some:
            words = self.names[i] if i in holds else self.words[i]
            if inner[i]:
                words = self._inner_words(i, words)
            if words & WORDS or not inner[i] and words & OUTER_WORDS:
                by_name.add(i)
        for i in range(1, len(self.tag)):
            out[i] = out[i] or i in by_name or out[self.parent[i]]
        return out

    def _inner_words(self, i: int, words: frozenset) -> set[str]:
        """Those of the words of element ``i``, which lies within an article, that may decide."""
        clear = set(self.names[i] & words)
        for name in self.names[i]:
            parts = set(re.findall(r"[^\W\d_]+", name))
            if parts <= words and parts <= WORDS | PLACES:
                clear |= parts
        return clear & ADVERTS if self.tag[i] in PROSE else clear

    def _holders(self, out: list[bool]) -> set[int]:
        """Elements that hold an ``article`` or ``main``, or over half of the text that is not ``out``."""
        mass = [len(self.text[i].strip()) if t == TEXT and not out[i] else 0 for i, t in enumerate(self.tag)]
        body = [False] * len(mass)
        for i in range(len(mass) - 1, 0, -1):
            p = self.parent[i]
            mass[p] += mass[i]
            body[p] = body[p] or body[i] or self.tag[i] in ("article", "main")
        return {i for i, m in enumerate(mass) if body[i] or 2 * m > mass[0]}

    def blocks(self, regions: list[int], skip: list[bool]) -> list[str]:
        """The blocks of text below the regions, in page order, without the skipped nodes."""
        inside = [False] * len(self.tag)
        found: list[list[str]] = [[]]
        owner = -1
        for i in regions:
            inside[i] = True
        block_of = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            inside[i] = inside[i] or inside[p]
            block_of[i] = i if self.tag[i] in BLOCK else block_of[p]
            if not inside[i] or skip[i]:
                continue
            if self.tag[i] == "br":
                found[-1].append(" ")
            if self.tag[i] == TEXT:
                if block_of[i] != owner or self._broken(i, block_of):
                    found.append([])
                    owner = block_of[i]
                found[-1].append(self.text[i])
        texts = (" ".join("".join(b).split()) for b in found)
        return [t for t in texts if t]

    def _broken(self, i: int, block_of: list[int]) -> bool:
        """Whether a block element stands between text ``i`` and the text before it in the same block."""
        j = i - 1
        while j > 0 and self.tag[j] != TEXT:
            if self.tag[j] in BLOCK and j != block_of[i]:
                return True
            j -= 1
        return j > 0 and block_of[j] != block_of[i]
