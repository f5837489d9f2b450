"""Blocks of a web page: a tolerant reader of tags that keeps paths, roles and text."""

from __future__ import annotations

import re
from html import unescape

# --- fixed values: element and attribute names as public HTML and common practice have them ---
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg canvas textarea select title".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = set("nav footer aside menu dialog button head frameset applet audio video".split())
CONTENT_TAGS = set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption"
    " figure figcaption section div address hgroup header".split()
)
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar"
    " cookie cookies consent notice notices alert popup modal overlay newsletter subscribe"
    " subscription share sharing social related recommended recommendations comment comments"
    " disqus respond reply replies widget login signup search pagination pager tags".split()
)
#: Names of what readers wrote: no such branch is a page's article, whatever it holds.
READER_WORDS = set("comment comments disqus respond reply replies".split())
#: Parts that a noise name may have beside noise words.
NEUTRAL_WORDS = set(
    "site global bar list slot box area section block container wrapper wrap panel item items"
    " thread form inner outer".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary alert dialog menu".split())
#: As names: these count only for a branch that is not the page itself.
NAME_TAGS, NAME_ROLES = {"form"}, {"search", "form"}
#: An open element of the first kind ends where one of the second kind starts.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}
# -----------------------------------------------------------------------------------------------

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
    re.I,
)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_NAME = re.compile(r"[a-z]+")

Block = tuple[str, str, bool, str]  # path, inline style, noise by role, text


def _is_noise_name(token: str, in_article: bool) -> bool:
    """Whether a class or id as a whole names noise: "cookie-bar", not "has-sidebar"."""
    words = set(_NAME.findall(token)) - NEUTRAL_WORDS
    return bool(words) and words <= (NOISE_WORDS if in_article else NOISE_WORDS | {"header"})


def _is_reader_name(token: str) -> bool:
    """Whether a class or id as a whole names reader comments: "comment-list"."""
    words = set(_NAME.findall(token)) - NEUTRAL_WORDS
    return bool(words) and words <= READER_WORDS


def _names(attributes: str, in_article: bool) -> tuple[str, bool, bool, bool]:
    """Signature of class and id (digits dropped), whether role or style mark the element as
    noise, whether a name does, and whether it names reader comments."""
    signature, noise, named, readers = [], False, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            signature += _NAME.findall(value)
            named |= any(_is_noise_name(token, in_article) for token in value.split())
            readers |= any(map(_is_reader_name, value.split()))
        elif name == "role":
            noise |= value in NOISE_ROLES
            named |= value in NAME_ROLES
        elif name == "style":
            noise |= "display:none" in value.replace(" ", "")
        else:
            noise |= value != "false"
    return ".".join(signature), noise, named, readers


def blocks(html: str) -> list[Block]:
    """Blocks with text, in page order; of the article if the page marks one, else of its main
    part, else of its body. Noise by role is there too, marked.

    A noise name counts only if its branch holds no article or main part and at most half of the
    page's text, and only on pages that have text besides. A branch that names reader comments
    counts however long it is, and an article in it is a comment; only a main part protects it.
    Inline elements belong to the block around them; an unclosed one ends with it.
    """
    out: list[tuple[int, tuple[int, ...], Block]] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, path, noise, named branches
    held: list[int] = []  # characters of each named branch
    whole: set[int] = set()  # named branches with an article or main part
    reader: set[int] = set()  # named branches of reader comments
    words: list[str] = []
    styles: set[str] = set()
    zone_of = {"article": 2, "main": 1}
    at, end = 0, len(html)

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            path = stack[-1][1] if stack else "body"
            noise = bool(stack) and stack[-1][2]
            branches = stack[-1][3] if stack else ()
            zone = max(
                (zone_of.get(s[0], 0) for s in stack if s[0] == "main" or reader.isdisjoint(s[3])),
                default=0,
            )
            out.append((zone, branches, (path, " ".join(sorted(styles)), noise, text)))
            if not noise:
                for n in branches:
                    held[n] += len(text)
        styles.clear()

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            words.append(unescape(html[at:]))
            break
        if m.start() > at:
            words.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue  # a comment or declaration
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in INLINE and not any(s[0] == tag for s in stack):
                continue
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    flush()
                    del stack[n:]
                    break
            continue
        if tag in RAW:
            if tag not in ("title",):
                words.append(" ")
            if not attributes.endswith("/"):
                closed = _RAW_END[tag].search(html, at)
                at = closed.end() if closed else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        in_article = any(s[0] == "article" for s in stack)
        signature, noise, named, readers = (
            _names(attributes, in_article) if attributes else ("", False, False, False)
        )
        if tag in INLINE:
            styles.add(tag)
            if noise or named:  # an inline element is kept open only to leave out what it holds
                flush()
                noise |= bool(stack) and stack[-1][2]
                branches = stack[-1][3] if stack else ()
                if named:
                    if readers:
                        reader.add(len(held))
                    branches += (len(held),)
                    held.append(0)
                path = (stack[-1][1] if stack else "body") + f">{tag}.{signature}"
                stack.append((tag, path, noise, branches))
            continue
        if tag in ("html", "body"):
            flush()
            continue
        flush()
        while stack and (stack[-1][0] == "p" or tag in ENDS.get(stack[-1][0], ())):
            stack.pop()
        noise |= tag in NOISE_TAGS or (tag == "header" and not in_article)
        named |= tag in NAME_TAGS
        path = (stack[-1][1] if stack else "body") + ">" + tag + (f".{signature}" if signature else "")
        noise |= bool(stack) and stack[-1][2]
        if tag == "body" or attributes.endswith("/"):
            continue
        branches = stack[-1][3] if stack else ()
        if named:
            if readers:
                reader.add(len(held))
            branches += (len(held),)
            held.append(0)
        if tag in zone_of and not noise:
            # An article among comments is one of them: it keeps no branch, a main part does.
            if tag == "main" or reader.isdisjoint(branches):
                whole.update(branches)
        stack.append((tag, path, noise, branches))
    flush()
    said = reader - whole
    total = sum(len(b[3]) for _, _, b in out if not b[2])
    cut = {
        n for n, size in enumerate(held) if n in said or (n not in whole and 2 * size <= total)
    }
    if all(b[2] or cut.intersection(branches) for _, branches, b in out):
        cut = set()
    found = [
        (zone, (*b[:2], b[2] or bool(cut.intersection(branches)), b[3])) for zone, branches, b in out
    ]
    best = max((zone for zone, b in found if not b[2]), default=0)
    return [b if zone == best or b[2] else (b[0], b[1], True, b[3]) for zone, b in found]


def is_plain_article(path: str) -> bool:
    """Whether a path below an article has only content elements without class or id."""
    parts = path.split(">")
    for n, part in enumerate(parts):
        if part.split(".")[0] in ("article", "main"):
            return all(p in CONTENT_TAGS for p in parts[n + 1 :])
    return False
