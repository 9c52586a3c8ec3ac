"""Reading HTML as a tree, and what its element names and classes say.

The reader is tolerant: unclosed and wrongly nested elements, bare ``<`` and cut off pages are read
as browsers read them, as far as the text is concerned.
"""

from __future__ import annotations

import html
import re

#: A comment, declaration, tag, tag with broken quotes, or what a cut off page ends in.
_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_attribute = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_name = re.compile(r"[a-z0-9]+")
_hump = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Class names that tell what a page has or how it is, such as ``has-sidebar`` or ``comments-open``, say nothing of an element.
_state = re.compile(r"(?:has|no|not|is|with|without)[-_]|.*[-_](?:open|closed|enabled|disabled|active)$", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold text of their own rather than parts of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption dt dd li td th tr caption summary".split())
#: Start tags that end an open paragraph, and those that end an open element of their own kind.
ENDS_P = BLOCK - frozenset("caption head html legend optgroup option tbody td tfoot th thead tr body".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Elements that are never part of an article.
FOREIGN = frozenset("head nav footer aside script style template iframe noscript noembed noframes object svg canvas audio video button select datalist textarea dialog menu search title".split())
#: Parts of class names, ids and roles that tell what surrounds an article.
NOISE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside complementary contentinfo"
    " ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login search"
    " share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations widget widgets"
    " toolbar pagination pager skip copyright legal disclaimer".split())
MAIN = frozenset(["article", "main"])


class Page:
    """The tree of a page: parallel lists over elements, and the events of walking it.

    An event is a text, ``n`` where element ``n`` opens and ``-n`` where it closes; elements count
    from 1. ``None`` is the end of a line of text.
    """

    __slots__ = ("tag", "parent", "tokens", "main", "events", "count")

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.main, self.events = [""], [0], [frozenset()], [False], []
        #: Open elements of each name.
        self.count: dict[str, int] = {}
        self._read(source)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        self.tag.append(tag)
        self.parent.append(stack[-1] if stack else 0)
        tokens, main = frozenset(), tag in MAIN
        if "=" in attributes:
            found = [(m[0].lower(), m[1] or m[2] or m[3]) for m in _attribute.findall(attributes)]
            names = [name for _, value in found for name in value.split() if not _state.match(name)]
            tokens = frozenset(t for name in names for t in _name.findall(_hump.sub(" ", name).lower()))
            main = main or ("role", "main") in found or ("itemprop", "articleBody") in found
        self.tokens.append(tokens)
        self.main.append(main)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.events.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            self.count[self.tag[stack[-1]]] -= 1
            self.events.append(-stack.pop())

    def _read(self, source: str) -> None:
        stack, at, end = [], 0, len(source)
        while at < end:
            found = _token.search(source, at)
            if found is None:
                self.events.append(html.unescape(source[at:]))
                break
            if found.start() > at:
                self.events.append(html.unescape(source[at : found.start()]))
            at = found.end()
            slash, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name or source[at - 1] != ">":
                continue
            name = name.lower()
            if slash:
                self._end(name, stack)
                continue
            if name in ENDS_P:
                self._end("p", stack)
            if name in SIBLINGS:
                self._end_siblings(*SIBLINGS[name], stack)
            if name in VOID:
                if name in ("br", "hr"):
                    self.events.append(None if name == "hr" else " ")
                continue
            if attributes.endswith("/") and name in ("svg", "path", "use"):
                continue
            stack.append(self._open(name, attributes, stack))
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                stop = close.start() if close else end
                if name in ("textarea", "title"):
                    self.events.append(html.unescape(source[at:stop]))
                self._close(stack, len(stack) - 1)
                at = close.end() if close else end
        self._close(stack, 0)

    def _end(self, name: str, stack: list[int]) -> None:
        if not self.count.get(name):
            return
        inline = name not in BLOCK
        for depth in range(len(stack) - 1, -1, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                self._close(stack, depth)
                return
            # inline elements end inside their block, paragraphs and items inside their container
            if (inline and tag in BLOCK) or (name == "p" and tag in BLOCK) or (tag in ("table", "td", "th") and name != "table" and name not in ("tr", "tbody", "thead", "tfoot")):
                return

    def _end_siblings(self, names: set[str], within: set[str], stack: list[int]) -> None:
        if not any(map(self.count.get, names)):
            return
        for depth in range(len(stack) - 1, -1, -1):
            tag = self.tag[stack[depth]]
            if tag in names:
                # a row ends with its cells
                while depth and self.tag[stack[depth - 1]] in names:
                    depth -= 1
                self._close(stack, depth)
                return
            if tag in within:
                return

    def surroundings(self) -> set[int]:
        """Elements whose name, class, id or role says that they are not part of an article."""
        n = len(self.tag)
        noise = [not self.tokens[i].isdisjoint(NOISE) for i in range(n)]
        # a wrapper around an article is kept whatever it is called
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if (self.tag[i] == "h1" or self.main[i]) and not noise[i]:
                holds[i] = True
            if holds[i] and self.tag[i] not in FOREIGN:
                holds[self.parent[i]] = True
        inside = [False] * n
        out = set()
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or (self.main[i] and not noise[i])
            tag = self.tag[i]
            if tag in FOREIGN or (tag == "header" and not inside[i]) or (tag == "form" and not holds[i]) or (noise[i] and not holds[i] and tag not in ("html", "body")):
                out.add(i)
        return out

    def articles(self, gone: set[int]) -> set[int]:
        """The outermost main elements that are not gone, or none."""
        covered, out = [False] * len(self.tag), set()
        for i in range(1, len(self.tag)):
            covered[i] = covered[self.parent[i]] or i in gone
            if not covered[i] and self.main[i]:
                out.add(i)
                covered[i] = True
        return out

    def blocks(self, gone: set[int], articles: set[int]) -> list[str]:
        """The texts of blocks in page order, without elements that are gone; of the articles only, if there are any."""
        out, held, hidden, inside, tags = [], [], 0, 0 if articles else 1, self.tag

        def flush() -> None:
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    out.append(text)

        for event in self.events:
            if event is None:
                flush()
            elif event.__class__ is str:
                if inside and not hidden:
                    held.append(event)
            else:
                i = abs(event)
                step = 1 if event > 0 else -1
                if tags[i] in BLOCK or i in articles:
                    flush()
                if i in gone:
                    hidden += step
                if i in articles:
                    inside += step
        flush()
        return out
