"""Raw HTML as flat text blocks, with what a classifier of blocks needs to know of each.

The reader follows browsers where pages are malformed: unclosed paragraphs, items and cells end
where the next begins, end tags without a start are passed over, the content of scripts, styles and
the like is not text, and comments and tags that are never closed run to the end of the page; a
quote that is never closed ends with its tag. Every character is read a bounded number of times.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

TOKEN = re.compile(r"""<(?:
    !--(?:-?>|(?s:.*?)(?:--!?>|\Z))                                              # a comment
  | [!?][^>]*(?:>|\Z)                                                            # a declaration
  | (?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)
  | /[^A-Za-z][^>]*(?:>|\Z))""", re.X)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("svg template object canvas select button datalist audio video map".split())     # in the line, their content is not text
FRAIL = frozenset("svg select datalist".split())                # these end them:
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 article section main header footer nav aside ul ol li table form blockquote pre".split())
VOID = frozenset("hr img input meta link area base col embed source track wbr br param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter nobr output picture progress q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var img wbr input link meta source".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
OUTER = frozenset("ul ol dl table tbody thead tfoot".split())   # an item's end is not looked for beyond these
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_TAGS = frozenset("nav header footer aside dialog menu fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget ad ads advert adverts advertisement "
    "advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar copyright disclaimer form".split())
REPLY_WORDS = frozenset("comment comments discussion disqus replies reply respond responses".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
UNLESS = frozenset("no has with without".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int         # words inside links
    inside: int         # 2 in an article, 1 in a main part, 0 elsewhere
    aside: bool         # in a menu, header, footer, sidebar, notice, advert, form or among comments
    heading: bool


class Place(NamedTuple):
    name: str
    inside: int
    aside: bool
    form: bool          # in a form; an article inside one is none, as whole pages may stand in a form
    lead: bool          # in the header of an article: its headings are the article's
    hidden: bool
    heading: bool


def place(name: str, rest: str, above: Place) -> Place:
    """What the element ``name`` with the attributes ``rest`` says of the text in it."""
    words: set[str] = set()
    role = ""
    for key, *values in ATTRIBUTE.findall(rest) if "=" in rest else ():
        value = "".join(values).lower()
        if key.lower() == "role":
            role = value.strip()
            continue
        for token in value.split():
            parts = set(re.split(r"[^a-z0-9]+", token))
            if not parts & UNLESS:
                words |= parts
    heading = above.heading or name in HEADING
    hidden = above.hidden or name in HIDDEN
    form = above.form or name == "form" or role == "form"
    replies = bool(words & REPLY_WORDS)
    if name in ("html", "body"):
        return above._replace(name=name)
    if name in ("article", "main") or role in ("article", "main"):
        inside = 2 if name == "article" or role == "article" else max(above.inside, 1)
        return Place(name, inside, above.aside or replies, False, False, hidden, heading)
    marked = bool(words & ASIDE_WORDS) or name in ASIDE_TAGS or role in ASIDE_ROLES
    lead = above.lead or (above.inside > 0 and not above.aside and not replies and (name == "header" or "header" in words))
    if lead:
        aside = replies or not heading
    else:
        aside = above.aside or replies or (marked and name not in HEADING)
    inside = max(above.inside, 1 if words & MAIN_WORDS and not aside else 0)
    return Place(name, inside, aside, form, lead, hidden, heading)


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order: character references decoded, white space folded, empty blocks left out."""
    out: list[Block] = []
    open_: list[Place] = [Place("", 0, False, False, False, False, False)]
    count: dict[str, int] = {}
    pieces: list[str] = []      # text of the block, and of its links
    links: list[str] = []
    at, in_link = 0, False

    def finish() -> None:
        if not pieces or open_[-1].hidden:
            return
        text = " ".join("".join(pieces).split())
        if text:
            here = open_[-1]
            words = text.count(" ") + 1
            out.append(Block(text, words, min(words, len("".join(links).split())), here.inside, here.aside or here.form, here.heading))
        pieces.clear()
        links.clear()

    def add(text: str) -> None:
        if text and not open_[-1].hidden:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                links.append(text)

    def close(name: str) -> None:
        while True:
            gone = open_.pop().name
            count[gone] -= 1
            if gone == name:
                return

    while (token := TOKEN.search(html, at)) is not None:
        if token.start() > at:
            add(html[at:token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if name == "a":
                in_link = False
                links.append(" ")
            elif name == "br":
                add(" ")
            elif name in HIDDEN:
                if count.get(name):
                    close(name)
            elif name not in INLINE and name not in RAW:
                finish()
                if count.get(name):
                    close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else len(html)
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = True
            links.append(" ")
        elif name in HIDDEN:
            open_.append(place(name, token["rest"], open_[-1]))
            count[name] = count.get(name, 0) + 1
        elif name not in INLINE and (not open_[-1].hidden or open_[-1].name in FRAIL and name in BREAKS):
            while open_[-1].name in FRAIL:
                close(open_[-1].name)
            finish()
            in_link = in_link and name not in ("li", "td", "th", "article", "section", "nav", "footer", "p")
            if open_[-1].name == "p":
                close("p")
            if name in VOID:
                continue
            for item in range(len(open_) - 1, 0, -1) if name in ENDS else ():
                if open_[item].name in ENDS[name]:
                    close(open_[item].name)
                elif open_[item].name in OUTER:
                    break
            open_.append(place(name, token["rest"], open_[-1]))
            count[name] = count.get(name, 0) + 1
    add(html[at:])
    finish()
    return out
