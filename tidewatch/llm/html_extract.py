"""HTML extraction with wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over block-level tags: a sequence of elements, any
of them optional or repeated, with slots for text. It starts as the first page of a host; each
further page is aligned with it, and mismatches become optional elements, repeated groups or slots
of text. Aligning two wrappers works the same way, so each task folds the pages of a host into one
wrapper, and wrappers of tasks are folded one after the other, in two steps. Names leave out ids and
numbers, and a wrapper that grows large is folded further, so its size is bounded whatever the pages are.

A slot whose text is the same on all pages of a host is template, one that varies is content; repeated
slots vary. Blocks that most pages of a host share are template too. Elements that HTML itself sets
apart (nav, aside, footer and the like) are never content; names in class and id only break ties: they
say which of the varying slots are menus or comments, and where the article is if no element says so.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_name, load, release, written

#: The rest of a start tag: a quote counts as one only where a value begins. Possessive, so it never steps back.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=|"|')*+)>""")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is raw text up to their end tag.
_RAW = {t: re.compile(f"</{t}(?![^\\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
#: Elements that are no text of the page; left open, they end with the element around them.
_SKIPPED = frozenset("noscript template svg select button object".split())
#: Elements that belong to the text around them; all others are blocks.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr input area base link meta col embed param track".split())
_VOID = frozenset("br hr img input area base link meta col embed param source track wbr".split())
#: Elements whose start ends an open one of the listed kinds.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPES = frozenset("article main section div body table ul ol nav aside footer header form blockquote td th".split())
_CHROME = frozenset("head nav aside footer form menu dialog".split())
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside a word of chrome in its name without changing what it says.
_NEUTRAL = frozenset("area bar block bottom box buttons container global group item items left links list main middle page primary right secondary section site top unit wrap wrapper".split())
#: Elements without text of the article, whatever they are named.
_NO_TEXT = _CHROME | _SKIPPED | frozenset(_RAW)
_MAIN_WORDS = frozenset("article content entry main post story".split())
#: Words like has-comments or comments-open say what state a page is in, not what an element is.
_STATE = re.compile(r"(?:no|has|is|with|without)[-_].*|.*[-_](?:open|closed|enabled|disabled)", re.I)
#: So many different pages have to agree before a text counts as template; fewer show nothing.
LEAST_PAGES = 4
#: Elements below this depth stand as neighbours at it; wrappers of more nodes than that are folded by tag.
DEPTH, NODES = 40, 4000


@lru_cache(100_000)
def _parts(mark: str) -> tuple[str, ...]:
    return tuple(p for p in re.split(r"[^a-z0-9]+", mark.lower()) if p)


def _is_chrome_name(mark: str) -> bool:
    """Whether a class, id or role as a whole is a name of chrome: sidebar, site-header, post-comments; not entry-header or has-sidebar."""
    parts = [p.rstrip("0123456789") for p in _parts(mark) if p.rstrip("0123456789")]
    chrome = [p for p in parts if p in _CHROME_WORDS]
    if not chrome or _STATE.fullmatch(mark) or any(p not in _CHROME_WORDS | _NEUTRAL | _MAIN_WORDS for p in parts):
        return False
    return not (set(parts) & _MAIN_WORDS and set(chrome) == {"header"})


def _name(tag: str, attributes: str) -> str:
    """The tag, "~" if a class, id or role is a name of chrome, else "!" if one says it is the main element, "?" if it may be,
    and the first word of the first class. html and body have only their tag, article and main no "~"."""
    if not attributes or tag in ("html", "body"):
        return tag
    marks = [(k.lower(), word) for k, *values in _MARK.findall(attributes) for word in "".join(values).split()]
    out = tag
    if tag != "main" and any(_is_chrome_name(word) for _, word in marks):
        out += " ~"
    elif tag not in ("main", "article"):
        if any(k == "role" and word.lower() == "main" or k == "id" and _parts(word) and set(_parts(word)) <= _MAIN_WORDS for k, word in marks):
            out += " !"
        elif any(set(_parts(word)) & _MAIN_WORDS and not _STATE.fullmatch(word) and not set(_parts(word)) & _CHROME_WORDS for _, word in marks):
            out += " ?"
    first = [p for k, word in marks if k == "class" for p in _parts(word)[:1] if p.isalpha()][:1]
    return f"{out} {first[0]}" if first and len(first[0]) <= 30 else out


def _tag(name: str) -> str:
    return name.partition(" ")[0]


def _is_text(child: list) -> bool:
    return not isinstance(child[1], list)


def _tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end) of each piece; the consumer may send where to go on. Linear in the page."""
    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            yield "text", page[pos:], "", n
            return
        if at > pos:
            yield "text", page[pos:at], "", at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
        elif m := _TAG.match(page, at):
            if m.group(1):
                end = page.find(">", m.end())
                if end < 0:
                    return
                pos = end + 1
                yield "end", m.group(2).lower(), "", pos
            else:
                rest = _REST.match(page, m.end()) if page.find(">", m.end()) >= 0 else None
                if rest is None:  # a tag that never ends is no text
                    return
                pos = rest.end()
                went = yield "start", m.group(2).lower(), rest.group(1), pos
                if went is not None:
                    pos = went
        elif page.startswith(("<!", "<?", "</"), at):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
        else:
            yield "text", "<", "", at + 1
            pos = at + 1


def page_tree(page: str | None) -> list:
    """The page as [name, children]; a child is an element, or [text, inside a link] of one piece of text.

    Tags that are never closed end with the element around them or where HTML ends them. What stands deeper than
    DEPTH is hung up there in the order of the page, under the name of the chrome or article it stands in.
    """
    root: list = ["", []]
    stack, tags, names, open_tags, links = [root], [""], [""], {}, 0
    page = page or ""
    pieces, go_on = _tokens(page), None

    def close(to: int) -> None:
        for t in tags[to:]:
            open_tags[t] -= 1
        del stack[to:], tags[to:], names[to:]

    def place() -> list:
        """Where text goes now: the open element, or at the greatest depth the last one hung up."""
        if len(stack) <= DEPTH:
            return stack[-1][1]
        kids = stack[DEPTH - 1][1]
        if not kids or kids[-1] is not stack[-1]:
            stack[-1] = [names[-1], []]
            kids.append(stack[-1])
        return stack[-1][1]

    while True:
        try:
            kind, tag, attributes, pos = pieces.send(go_on)
        except StopIteration:
            break
        go_on = None
        if kind == "text":
            place().append([tag, links > 0])
            continue
        if kind == "end":
            if tag == "a":
                links = max(0, links - 1)
            if tag not in _INLINE and open_tags.get(tag):
                at = len(tags) - 1
                while tags[at] != tag:
                    at -= 1
                # An end tag closes what is open inside, but doesn't reach out of an article for a stray p.
                if tag in _SCOPES or tag in _SKIPPED or not _SCOPES.intersection(tags[at + 1 :]):
                    close(at)
            continue
        if tag in _RAW:
            if not (open_tags.get("svg") and attributes.endswith("/")):  # only inside an svg these close themselves
                end = _RAW[tag].search(page, pos)
                go_on = end.start() if end else len(page)
            place().append([tag, []])
            continue
        if tag in _INLINE:
            if tag == "a":
                links += 1
            elif tag == "br":
                place().append([" ", False])
            continue
        ends = _ENDS.get(tag, ()) or (("p",) if tag in _ENDS_P else ())
        if any(open_tags.get(t) for t in ends):
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in ends:
                    close(i)
                    break
                if tags[i] in _SCOPES or tags[i] in _SKIPPED:
                    break
        name = _name(tag, attributes)
        if len(stack) > DEPTH and (_is_chrome(names[-1], False) or _is_main(names[-1]) and not _is_chrome(name, True)):
            name = names[-1]
        node: list = [name, []]
        if len(stack) < DEPTH:
            stack[-1][1].append(node)
        else:
            stack[DEPTH - 1][1].append(node)
        if tag not in _VOID and not attributes.endswith("/"):
            stack.append(node)
            tags.append(tag)
            names.append(name)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            links = 0 if tag in _SCOPES else links
    _free_article(root)
    return root


def _free_article(root: list) -> None:
    """Take "~" off the article, and off what holds the article together with half of the page's letters.

    The article is the first article element that isn't in chrome, or one with half of the letters.
    """
    size: dict[int, int] = {}
    holds: set[int] = set()

    def measure(node: list) -> int:
        total = 0
        for child in node[1]:
            if _is_text(child):
                total += len(child[0].strip())
            elif _tag(child[0]) not in _NO_TEXT:
                total += measure(child)
                if id(child) in holds:
                    holds.add(id(node))
        if _is_firm(node[0]):
            holds.add(id(node))
        size[id(node)] = total
        return total

    whole, seen = measure(root), False

    def visit(node: list) -> None:
        nonlocal seen
        tag = _tag(node[0])
        if tag in _NO_TEXT:
            return
        if " ~" in node[0]:
            large = id(node) in holds and 2 * size[id(node)] >= whole
            if not (tag == "article" and not seen or large and (tag == "article" or not seen)):
                return
            node[0] = node[0].replace(" ~", "")
        seen = seen or tag == "article"
        for child in node[1]:
            if not _is_text(child):
                visit(child)

    if holds:
        visit(root)


def _squeezed(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


# A wrapper node is {"n": name, "k": [nodes], "o": optional, "r": repeated, "t": slot or None}; a group of nodes that
# repeat together has the name "(" + its names + ")". A slot is [pages, letters, letters in links, digest of the text
# or None if it varies].


def wrapper_of(tree: list) -> dict:
    """The wrapper that one page is an instance of. Trees are at most DEPTH deep."""
    if _tag(tree[0]) in _SKIPPED:
        return {"n": tree[0], "k": [], "o": False, "r": False, "t": None}
    texts = [c for c in tree[1] if _is_text(c)]
    kids = [wrapper_of(c) for c in tree[1] if not _is_text(c)]
    text = _squeezed([c[0] for c in texts])
    slot = [1, len(text), len(_squeezed([c[0] for c in texts if c[1]])), _digest(text)] if text else None
    return {"n": tree[0], "k": fold_repeats(kids), "o": False, "r": False, "t": slot}


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def _merge_slots(a: list | None, b: list | None) -> list | None:
    if not a or not b:
        return a or b
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else None]


def merge(a: dict, b: dict) -> dict:
    """The least wrapper of this kind that holds both; their names are equal."""
    return {"n": a["n"], "k": fold_repeats(align(a["k"], b["k"])), "o": a["o"] or b["o"], "r": a["r"] or b["r"], "t": _merge_slots(a["t"], b["t"])}


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """Longest common sequence by name; what has no partner becomes optional. Very long sequences are taken as sets."""
    if [x["n"] for x in a] == [x["n"] for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    if len(a) * len(b) > 40_000:
        return _by_name([*a, *b])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["n"] == b[j]["n"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i]["n"] == b[j]["n"]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append({**a[i], "o": True})
            i += 1
        else:
            out.append({**b[j], "o": True})
            j += 1
    return out + [{**x, "o": True} for x in a[i:] + b[j:]]


def _by_name(nodes: list[dict], plain: bool = False) -> list[dict]:
    """One optional, repeated node for each name, or with plain for each tag."""
    found: dict[str, dict] = {}
    for node in nodes:
        name = _tag(node["n"]) if plain and not node["n"].startswith("(") else node["n"]
        node = {**node, "n": name, "o": True, "r": True}
        if plain:
            node["k"] = _by_name(node["k"], True)
        if name in found:
            old = found[name]
            found[name] = {**old, "k": _by_name([*old["k"], *node["k"]], plain), "t": _merge_slots(old["t"], node["t"])}
        else:
            found[name] = node
    return list(found.values())


def _count(node: dict) -> int:
    return 1 + sum(map(_count, node["k"]))


def bounded(wrapper: dict) -> dict:
    """The wrapper, or if it has more than NODES nodes the one in which the elements below a node are one for each tag."""
    return wrapper if _count(wrapper) <= NODES else {**wrapper, "k": _by_name(wrapper["k"], True)}


def fold_repeats(nodes: list[dict], longest: int = 4) -> list[dict]:
    """Neighbours with equal names become one repeated node, equal neighbouring runs of up to `longest` one repeated group."""
    out: list[dict] = []
    for node in nodes:
        if out and out[-1]["n"] == node["n"]:
            out[-1] = {**merge(out[-1], node), "r": True}
        else:
            out.append(node)
    for size in range(2, longest + 1):
        i = 0
        while i + 2 * size <= len(out):
            one, two = out[i : i + size], out[i + size : i + 2 * size]
            names = [x["n"] for x in one]
            if names == [x["n"] for x in two]:
                group = {"n": "(" + " ".join(names) + ")", "k": [merge(x, y) for x, y in zip(one, two)], "o": False, "r": True, "t": None}
                out[i : i + 2 * size] = [group]
            elif out[i]["n"] == "(" + " ".join(x["n"] for x in out[i + 1 : i + 1 + size]) + ")":
                merged = {**out[i], "k": [merge(x, y) for x, y in zip(out[i]["k"], out[i + 1 : i + 1 + size])]}
                out[i : i + 1 + size] = [merged]
            else:
                i += 1
    return out


def expression(node: dict) -> str:
    """The wrapper as a regular expression, e.g. body(nav(#) article(h1(#) p(#)+))."""
    inner = ([] if not node["t"] else ["#"]) + [expression(k) for k in node["k"]]
    name = "" if node["n"].startswith("(") else node["n"]
    return f"{name}({' '.join(inner)})" + ("+" if node["r"] else "") + ("?" if node["o"] else "")


def slots(node: dict, path: tuple = ()) -> Iterator[tuple[tuple, list]]:
    """(path of names, slot) of each slot; groups are not part of a path."""
    path = path if node["n"].startswith("(") or not node["n"] else (*path, node["n"])
    if node["t"]:
        yield path, node["t"]
    for k in node["k"]:
        yield from slots(k, path)


@lru_cache(100_000)
def _is_firm(name: str) -> bool:
    """An article or main element, or one whose id or role says so."""
    return _tag(name) in ("article", "main") or " !" in name


@lru_cache(100_000)
def _is_chrome(name: str, inside_main: bool) -> bool:
    tag = _tag(name)
    return tag in _NO_TEXT or (tag == "header" and not inside_main) or " ~" in name


@lru_cache(100_000)
def _is_main(name: str) -> bool:
    return _is_firm(name) or " ?" in name


@lru_cache(100_000)
def _level(path: tuple) -> int | None:
    """How firmly a path stands for the article: 0 in an article element, 1 in a main element, 2 under a name like that, 3 elsewhere; None for chrome."""
    main = False
    for name in path:
        main = main or _is_main(name)
        if _is_chrome(name, main):
            return None
    tags = {_tag(name) for name in path}
    return 0 if "article" in tags else 1 if "main" in tags else 2 if main else 3


def template_paths(wrapper: dict) -> list[tuple]:
    """Paths of the slots that are no content: the same text on all of LEAST_PAGES pages or more, or outside of any article mostly links.

    A wrapper in which no slot varies is of copies of one page and shows nothing.
    """
    known: dict[tuple, list] = {}
    varies = False
    for path, slot in slots(wrapper):
        known[path] = _merge_slots(known.get(path), slot)
        varies = varies or slot[3] is None
    constant = {path for path, slot in known.items() if varies and slot[3] is not None and slot[0] >= LEAST_PAGES}
    linked = {path for path, slot in known.items() if _level(path) == 3 and 2 * slot[2] > slot[1]}
    return sorted(path for path in constant | linked if _level(path) is not None)


def _blocks(page: str | None) -> list[tuple[int, tuple, str]]:
    """(level, path, text) of the page's blocks, but for chrome, in the order of the page."""
    blocks: list[tuple[int, tuple, str]] = []

    def visit(node: list, path: tuple) -> None:
        path = (*path, node[0]) if node[0] else path
        level, pieces = _level(path), []
        for child in [*node[1], None]:
            if child is not None and _is_text(child):
                pieces.append(child[0])
                continue
            if level is not None and pieces and (text := _squeezed(pieces)):
                blocks.append((level, path, text))
            pieces = []
            if child is not None:
                visit(child, path)

    visit(page_tree(page), ())
    return blocks


def _key(path: tuple, text: str) -> str:
    return hashlib.blake2b(repr((path, text)).encode("utf-8", "replace"), digest_size=12).hexdigest()


def article_text(page: str | None, template: set[tuple] | frozenset = frozenset(), shared: set | frozenset = frozenset()) -> str:
    """Blocks of the page's firmest level, joined by newlines, but for the template.

    template: paths of template slots; shared: keys of blocks that most pages have, which are left out at the
    last level. Inside an article or main element the template is only taken off if it is less than half of
    the text: pages that agree in most of their text are copies, which says nothing of a template.
    """
    blocks = _blocks(page)
    plain = [b for b in blocks if b[1] not in template and not (b[0] == 3 and _key(b[1], b[2]) in shared)]
    firmest = min((level for level, _, _ in blocks if level < 3), default=None)
    if firmest is None:
        return "\n".join(text for _, _, text in plain)
    own, left = [text for level, _, text in blocks if level == firmest], [text for level, _, text in plain if level == firmest]
    return "\n".join(left if 2 * sum(map(len, left)) > sum(map(len, own)) else own)


def loose_keys(page: str | None) -> list[str]:
    """Keys of the blocks of a page that has no text above the last level; none for other pages."""
    blocks = _blocks(page)
    return [] if any(level < 3 for level, _, _ in blocks) else sorted({_key(path, text) for _, path, text in blocks})


def host_of(url: Column) -> Column:
    """Host in lower case; an address without one, or a null one, is the host of no name."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", most_hosts: int = 500, salts: int = 64) -> DataFrame:
    """(host, n_pages, wrapper as JSON, expression, template paths as JSON), one row for each host.

    most_hosts: wrappers that a task holds at once; beyond it hands them on and begins anew. Wrappers of one
    host are folded as they come, in `salts` tasks and then in one, so no task holds more than one of a host.
    """
    names = ["host", "n_pages", "wrapper"]

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[dict, int]] = {}
        out = lambda: pd.DataFrame([(h, n, json.dumps(w)) for h, (w, n) in found.items()], columns=names)
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                one = bounded(wrapper_of(page_tree(page)))
                if host in found:
                    old, n = found[host]
                    found[host] = bounded(merge(old, one)), n + 1
                else:
                    found[host] = one, 1
                if len(found) >= most_hosts:
                    yield out()
                    found.clear()
        if found:
            yield out()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by host."""
        host, whole, total = None, None, 0
        for batch in batches:
            done = []
            for h, n, text in zip(batch["host"], batch["n_pages"], batch["wrapper"]):
                one = json.loads(text)
                if h == host:
                    whole, total = bounded(merge(whole, one)), total + int(n)
                    continue
                if host is not None:
                    done.append((host, total, json.dumps(whole)))
                host, whole, total = h, one, int(n)
            if done:
                yield pd.DataFrame(done, columns=names)
        if host is not None:
            yield pd.DataFrame([(host, total, json.dumps(whole))], columns=names)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = [json.loads(w) for w in batch["wrapper"]]
            yield batch.assign(expression=[expression(t) for t in trees], template=[json.dumps(template_paths(t)) for t in trees])

    kind = "host string, n_pages long, wrapper string"
    parts = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).mapInPandas(of_pages, kind)
    parts = parts.withColumn("salt", F.spark_partition_id() % salts).repartition("host", "salt").sortWithinPartitions("host", "salt").drop("salt").mapInPandas(fold, kind)
    whole = parts.repartition("host").sortWithinPartitions("host").mapInPandas(fold, kind)
    return written(whole.mapInPandas(finish, kind + ", expression string, template string"), "wrappers")


def shared_blocks(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, shared): keys of the blocks that most of the different pages of a host have, of pages without an article or the like.

    Copies of a page count once. A page has few blocks that most pages have, so the lists are as short as a page.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(key=[[*keys, ""] if (keys := loose_keys(page)) else [] for page in batch["html"]])[["host", "page", "key"]]
            yield batch[batch["key"].map(len) > 0].explode("key")

    named = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.md5(F.col(f"`{html_col}`").cast("binary")).alias("page"), F.col(f"`{html_col}`").alias("html"))
    # The empty key counts the pages themselves.
    counts = named.mapInPandas(rows, "host string, page string, key string").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    counts = written(counts.filter(F.col("n") >= LEAST_PAGES), "blocks")
    whole = counts.filter("key = ''").select("host", F.col("n").alias("pages"))
    most = counts.filter("key <> ''").join(whole, "host").filter("2 * n > pages")
    out = written(most.groupBy("host").agg(F.collect_list("key").alias("shared")), "shared")
    release(counts)
    return out


#: Wrappers are broadcast to the pages up to so many letters; beyond, pages meet them by a join on host and part.
MOST_LETTERS, PARTS = 30_000_000, 64


def extract_articles(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row of pages, but for the html, with text (empty if none) and n_chars, its code points.

    A null or empty page has no text; no rows give no rows. Pages whose address is null or has no host are one
    host. Repeated rows are extracted alike. Columns that clash with the made ones, in any case of letters, are
    replaced.
    """
    wrappers = infer_wrappers(pages, url_col, html_col)
    shared = shared_blocks(pages, url_col, html_col)
    rules = wrappers.join(shared, "host", "left").select("host", "template", "shared").filter("template <> '[]' OR shared IS NOT NULL")
    rules = written(rules, "rules")
    release(wrappers, shared)
    size = rules.agg(F.sum(F.length("template") + 30 * F.coalesce(F.size("shared"), F.lit(0)))).first()[0] or 0
    of, part = free_name(pages.columns, "of"), free_name(pages.columns, "part")
    keys = {of: F.col("host"), part: F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))) if size > MOST_LETTERS else F.lit(0)}
    rules = rules.select(*[c.alias(k) for k, c in keys.items()], F.struct("template", "shared").alias("rules_"))
    rules = rules if size > MOST_LETTERS else F.broadcast(rules)
    made = free_name(pages.columns, "rules")
    number = F.pmod(F.xxhash64(f"`{html_col}`"), F.lit(PARTS)).cast("int") if size > MOST_LETTERS else F.lit(0)
    joined = pages.withColumns({of: host_of(F.col(f"`{url_col}`")), part: number}).join(rules.withColumnRenamed("rules_", made), [of, part], "left")

    def texts(html: pd.Series, template: pd.Series, shared: pd.Series) -> pd.Series:
        known: dict[str, frozenset] = {}
        out = []
        for page, listed, left_out in zip(html, template, shared):
            if listed not in known:
                known[listed] = frozenset(tuple(p) for p in json.loads(listed)) if listed else frozenset()
            out.append(article_text(page, known[listed], frozenset(left_out) if left_out is not None else frozenset()))
        return pd.Series(out, dtype=object)

    keep = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    text = F.pandas_udf(texts, "string")(F.col(f"`{html_col}`"), F.col(f"{made}.template"), F.col(f"{made}.shared")).alias("text")
    return joined.select(*[F.col(f"`{c}`") for c in keep], text).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
