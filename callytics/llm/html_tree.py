"""Pages as trees of blocks, and simple tree matching of two such trees.

A block element becomes a node, and each run of text between block tags a leaf; inline elements leave their text
only. Menus, adverts, forms and the like are told by their tags, roles and class names and are left out, unless the
article lies inside them.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

# Elements of HTML, and class words in common use.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hgroup hr center fieldset legend "
    "nav header footer aside form dialog menu".split()
)
NEVER = frozenset(
    "head nav footer aside form dialog menu button select datalist object audio video canvas map fieldset".split()
)
#: Of these, those that can also be wrapped around a page's own text.
WRAPPERS = frozenset(("form", "fieldset"))
#: A block of one of these that is a link as a whole is still text if it is as long as a sentence.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
SENTENCE_WORDS = 6
RAW = frozenset("script style title textarea noscript template iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "thead", "tbody", "tfoot")),
    "td": ("td th", ("tr",)),
    "th": ("td th", ("tr",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification newsletter subscribe subscription popup modal overlay paywall sidebar "
    "comment comments disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs "
    "menu nav navbar navigation footer copyright widget login signup pagination pager toolbar skip hidden".split()
)
#: Of these, words that also name parts of the page's own text or layout.
LAYOUT_WORDS = frozenset(
    "sidebar share sharing social related recommended widget notice notices notification promo promotion banner toolbar skip hidden".split()
)
#: Class names such as no-sidebar tell what a part has or lacks, not what it is.
ABOUT = ("no-", "has-", "with-", "without-", "no_", "has_", "with_", "without_")
#: Left out only outside the article, where they can be its heading.
HEADS = frozenset("header masthead topbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "label", "children", "kind")

    def __init__(self, tag: str, label: str, kind: str):
        self.tag, self.label, self.kind, self.children = tag, label, kind, []


class Leaf:
    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: bool):
        self.text, self.linked = text, linked


def _kind(tag: str, attributes: str) -> tuple[str, str]:
    """What an element is by its tag and attributes ('main', 'out', 'head' or ''), and its class. 'maybe' is out unless it
    holds most of the text."""
    if not attributes or attributes.isspace():
        values = {}
    else:
        values = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)}
    named = values.get("class", "")
    role = values.get("role", "").lower()
    if tag in NEVER and tag not in WRAPPERS or role in ROLES:
        return "out", named
    style = values.get("style", "").replace(" ", "").lower()
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return "out", named
    names = [n for n in f"{named} {values.get('id', '')}".split() if not n.lower().startswith(ABOUT)]
    words = {w.lower() for w in _WORDS.findall(" ".join(names))}
    if words & WORDS and tag not in ("html", "body", "main"):
        return ("maybe" if words & WORDS <= LAYOUT_WORDS else "out"), named
    if tag in WRAPPERS:
        return "maybe", named
    if tag == "article" or tag == "main" or role in ("main", "article") or "articleBody" in values.get("itemprop", ""):
        return "main", named
    if tag == "header" or words & HEADS:
        return "head", named
    return "", named


def parse(html: str | None) -> Node:
    """The tree of blocks of a page. Broken markup is read like browsers do it: open elements end with their parent."""
    root = Node("", "", "")
    if not html:
        return root
    stack, text, plain, linked, at = [root], [], 0, 0, 0

    def flush() -> None:
        nonlocal plain, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                sentence = stack[-1].tag in PARAGRAPHS and joined.count(" ") + 1 >= SENTENCE_WORDS
                stack[-1].children.append(Leaf(joined, 2 * linked > plain + linked and not sentence))
            text.clear()
            plain = linked = 0

    def pop_to(i: int) -> None:
        del stack[i:]

    in_link, search, n = False, _TAG.search, len(html)
    while at < n:
        m = search(html, at)
        end = m.start() if m else n
        if end > at:
            piece = html[at:end]
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            size = len(piece) if not piece.isspace() else 0
            if in_link:
                linked += size
            else:
                plain += size
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = False
            elif tag in BLOCKS or tag in NEVER:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        flush()
                        pop_to(i)
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = True
        elif tag == "hr":
            flush()
        elif tag in BLOCKS or tag in NEVER:
            flush()
            in_link = False
            if stack[-1].tag == "p" or re.fullmatch("h[1-6]", stack[-1].tag) and stack[-1].tag != tag and tag == "p":
                stack.pop()
            if tag in CLOSED_BY:
                closed, within = CLOSED_BY[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in closed.split():
                        pop_to(i)
                        break
            kind, named = _kind(tag, m.group(3))
            node = Node(tag, f"{tag}.{named}" if named else tag, kind)
            stack[-1].children.append(node)
            if tag not in VOID:
                stack.append(node)
        # Other tags are inline: their text belongs to the block around them.
    flush()
    return root


def _sizes(root: Node) -> dict[Node, int]:
    """Characters of the text below each node, without blocks that are links."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if isinstance(c, Node))
    total: dict[Node, int] = {}
    for x in reversed(order):
        total[x] = sum(total[c] if isinstance(c, Node) else 0 if c.linked else len(c.text) for c in x.children)
    return total


def content(root: Node) -> tuple[Node, bool]:
    """The part of the tree that can be the main text, and whether the page names it itself (article, main).

    Articles inside a main part are the text if they hold half of it, else all of the main part is. Of several articles the
    one with most text counts, with the articles beside it. What only its form tag or a word of the layout marks as no text
    is kept if it holds most of the text.
    """
    order, parents = [], {}
    todo = [root]
    while todo:
        x = todo.pop()
        order.append(x)
        for c in x.children:
            if isinstance(c, Node):
                parents[c] = x
                todo.append(c)
    landmarks = {x for x in order if x.kind == "main"}
    around = set()  # what has the article inside isn't left out
    for x in landmarks:
        while x in parents and parents[x] not in around:
            x = parents[x]
            around.add(x)

    def prune(node: Node, drops) -> None:
        todo = [node]
        while todo:
            x = todo.pop()
            x.children = [c for c in x.children if isinstance(c, Leaf) or c in around or not drops(c)]
            todo.extend(c for c in x.children if isinstance(c, Node))

    prune(root, lambda c: c.kind == "out")
    sizes = _sizes(root)
    inside = [x for x in order if x.kind == "main" and x in sizes]
    unmarked = [x for x in inside if not _marked(x, parents)]
    inside = unmarked or inside
    articles = [x for x in inside if x.tag == "article" and not _has_parent(x, parents, "article")]
    chosen, named = root, False
    if inside:
        chosen, named = max(articles or inside, key=sizes.get), True
        beside = [x for x in parents[chosen].children if x in set(articles)]
        wider = [x for x in inside if x.tag != "article" and any(_inside(a, x, parents) for a in beside)]
        outer = max(wider, key=sizes.get, default=None)
        if outer is not None and 2 * sum(sizes[a] for a in beside if _inside(a, outer, parents)) < sizes[outer]:
            chosen = outer
        elif len(beside) > 1:
            chosen = Node("", "", "")
            chosen.children = beside
    if not named:
        prune(root, lambda c: c.kind == "head")
    sizes = _sizes(chosen)
    most = sizes[chosen]
    prune(chosen, lambda c: c.kind == "maybe" and 2 * sizes[c] <= most)
    return chosen, named


def _marked(node: Node, parents: dict) -> bool:
    """Whether something around the node is marked as no part of the text."""
    while node in parents:
        node = parents[node]
        if node.kind in ("out", "maybe") and node.tag not in WRAPPERS:
            return True
    return False


def _inside(node: Node, outer: Node, parents: dict) -> bool:
    while node in parents:
        node = parents[node]
        if node is outer:
            return True
    return False


def _has_parent(node: Node, parents: dict, tag: str) -> bool:
    while node in parents:
        node = parents[node]
        if node.tag == tag:
            return True
    return False


def leaves(tree: Node, named: bool) -> list[str]:
    """Texts of the blocks in page order. Where the page doesn't name its article, blocks mostly of links are menus."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, Leaf):
            if named or not x.linked:
                out.append(x.text)
        else:
            todo.extend(reversed(x.children))
    return out


def skeleton(tree: Node, named: bool) -> tuple[list, int]:
    """The tree for matching, and its number of nodes: [label, children] and for a leaf [label, number, hash of the
    text]. A block with one text only is a leaf itself. Numbers follow `leaves`."""
    number = count = 0
    done: list = []
    # Children first, without recursion: pages may be nested as deep as they like.
    todo: list = [(tree, done)]
    while todo:
        x, into = todo.pop()
        if isinstance(x, Leaf):
            if named or not x.linked:
                into.append(["#", number, xxhash.xxh32_intdigest(x.text)])
                number += 1
                count += 1
            continue
        count += 1
        if len(x.children) == 1 and isinstance(x.children[0], Leaf):
            leaf = x.children[0]
            if named or not leaf.linked:
                into.append([x.label, number, xxhash.xxh32_intdigest(leaf.text)])
                number += 1
            continue
        below: list = []
        into.append([x.label, below])
        todo.extend((c, below) for c in reversed(x.children))
    return (done[0] if done else ["", []]), count


def match(a: list, b: list) -> list[tuple[int, int, bool]]:
    """Simple tree matching of two skeletons: matched leaves (number in a, number in b, same text).

    Nodes match if their labels do; children keep their order; the matching with most nodes is taken, a leaf of the same
    text counting twice. Where a node stands in only one tree, what is below it stays unmatched.
    """
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def leaf(x: list) -> bool:
        return len(x) == 3

    def weigh(x: list, y: list) -> int:
        if x[0] != y[0] or leaf(x) != leaf(y):
            return 0
        if leaf(x):
            return 2 if x[2] == y[2] else 1
        return memo[id(x), id(y)][0]

    # Pairs of inner nodes that can meet, by depth; the deepest are solved first.
    level, levels = [(a, b)] if a[0] == b[0] and not leaf(a) and not leaf(b) else [], []
    while level:
        levels.append(level)
        level = [
            (x, y) for p, q in level for x in p[1] if not leaf(x) for y in q[1] if not leaf(y) and x[0] == y[0]
        ]
    for level in reversed(levels):
        for p, q in level:
            memo[id(p), id(q)] = _children(p[1], q[1], weigh)
    out = []
    if leaf(a) and leaf(b) and a[0] == b[0]:
        return [(a[1], b[1], a[2] == b[2])]
    todo = [(a, b)] if levels else []
    while todo:
        p, q = todo.pop()
        for x, y in memo[id(p), id(q)][1]:
            if leaf(x):
                out.append((x[1], y[1], x[2] == y[2]))
            else:
                todo.append((x, y))
    return out


def _children(xs: list, ys: list, weigh) -> tuple[int, list]:
    """The heaviest matching in order of two lists of children, and its pairs."""
    m, n = len(xs), len(ys)
    rows = [[0] * (n + 1)]
    for x in xs:
        last, row = rows[-1], [0] * (n + 1)
        for j, y in enumerate(ys):
            best = last[j + 1] if last[j + 1] >= row[j] else row[j]
            if x[0] == y[0]:
                w = weigh(x, y)
                if w and last[j] + w > best:
                    best = last[j] + w
            row[j + 1] = best
        rows.append(row)
    pairs, i, j = [], m, n
    while i and j:
        here = rows[i][j]
        if here == rows[i - 1][j]:
            i -= 1
        elif here == rows[i][j - 1]:
            j -= 1
        else:
            pairs.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
    return rows[m][n] + 1, pairs
