"""Main text of web pages by equivalence-class template deduction.

Markup tokens are start tags told apart by their path of open containers and their order among those of one name. A token's occurrence vector over the pages of
its host is its count in each page; tokens with the same vector make an equivalence class. The class of tokens that
occur once in (nearly) every page is the site's template, where nesting holds: a token stays only when its parent is in
the class too. The other classes (list items, paragraphs) repeat inside the template's slots. A slot that holds the
same text on every page is template text. Of the remaining slots, those of menus, adverts and the like are
told by their tags and names. The text is that of the <article> and <main> containers where these hold most of it, else
that of all slots that are left, however little each of them holds.

Vectors are never gathered: a vector is named by a sum of hashes over pages, so a task sends one row per host and
token, however many pages the host has. Host templates are joined to pages by Spark, which broadcasts them only
below its threshold.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import stored

# A template needs a token on this share of a host's pages; constant text counts from this many pages on.
SUPPORT, LEAST_PAGES = 0.9, 5
# Share of a host's text that its article and main containers must hold to be those of the article, and that a container
# must hold not to be dropped for its name.
NAMED_SHARE, OVERRULING_SHARE = 0.5, 0.8
BATCH_PAGES = 500

# Fixed values of HTML.
RAW = "script style textarea title noscript iframe".split()
HIDDEN = frozenset("template svg math select datalist option button object".split())
# Hidden elements that hold no other of their kind, and those that block elements end.
UNNESTED, FOREIGN = frozenset("select datalist option button".split()), frozenset(["svg", "math"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div header footer nav aside form ul ol dl table tbody thead tfoot figure blockquote fieldset details center".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre address figcaption caption legend summary hr".split())
# Tags, roles and name parts of what is not article text.
DROPPED_TAGS = frozenset("nav footer aside head menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup "
    "comment comments commentlist reply replies disqus share sharing social related recommended popup modal overlay login search skip copyright".split())
# A class or id counts when all its parts are among those names or these words, one at least among those.
BESIDE_NAMES = frozenset(
    "main top bottom left right site page primary secondary global mobile desktop bar box list block area section wrap wrapper "
    "container inner outer widget item items link links button buttons icon icons form x to body thread threads slot slots unit units "
    "card cards cta user users post posts reader readers google".split())
# Headers of a site, as whole names; those of an article hold its title.
SITE_HEADERS = frozenset("header site-header main-header top-header global-header header-top header-main header-wrapper header-inner header-container".split())
# Names that say something else of a paragraph, heading or list item, and those that do of a part of an article.
NOT_OF_LEAVES = frozenset("notice notices promotion banner aside footer masthead navigation menu menus reply replies social related recommended search login".split())
# Sections of an article have ids of their own words, so only these count among ids inside an article.
IDS_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo newsletter sidebar cookie cookies consent gdpr "
    "comment comments commentlist disqus".split())
# Names of a part that is reader comments only where it holds a row of like, named containers.
THREADS = frozenset("discussion discussions responses answers reviews feedback conversation".split())
# A form is one by its fields: below the first number of characters a field it goes, below the second it is marked.
FORM_GOES, FORM_MARKED = 40, 200
MARK = "!"  # before the label of a container with a dropped name, which the template may overrule

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
FORM_END, ARTICLE = re.compile(r"</form(?=[\s/>])", re.I), re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
FIELD = re.compile(r"<(?:input(?![^>]*type\s*=\s*[\"']?hidden)|select|textarea|button)(?=[\s/>])", re.I)
ENDS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in HIDDEN}


def has_end(html: str, at: int, tag: str) -> bool:
    """Whether a hidden element that opens before `at` has an end tag of its own, as one without hides nothing."""
    if tag in UNNESTED:
        found = ENDS[tag].search(html, at)
        return bool(found and found[1])
    return any(found[1] for found in ENDS[tag].finditer(html, at))


def is_dropped(value: str, names: frozenset) -> bool:
    """Whether one of the names in a class or id is made of dropped names as a whole."""
    for name in value.split():
        parts = re.findall(r"[a-z]+", name)
        if len(parts) > 1 and parts[-1] == "content":
            parts.pop()  # of a sidebar; before other parts it is the layout of both
        if not names.isdisjoint(parts) and all(p in names or p in BESIDE_NAMES for p in parts):
            return True
    return False


def form_kind(html: str, at: int) -> int:
    """Of a form that opens before `at`: 2 where it is little but fields, 1 where fields share it with some text, 0 where
    it is only wrapped around a text."""
    end = FORM_END.search(html, at)
    inside = html[at:end.start() if end else len(html)]
    if ARTICLE.search(inside):
        return 0
    fields = sum(1 for _ in FIELD.finditer(inside))
    chars = len(" ".join(TOKEN.sub(" ", inside).split()))
    return 2 if chars < FORM_GOES * fields else 1 if chars < FORM_MARKED * fields else 0


def parse(html: str) -> tuple[list[tuple[str, str]], Counter]:
    """The text blocks `(path, text)` of a page without dropped parts, in order, and how often each container path occurs.
    Containers with a dropped name are marked in the path and not dropped yet.

    Tolerates missing and misplaced end tags. <br> is white space inside a block; other inline tags are nothing.
    """
    stack: list[tuple[str, str, bool]] = []  # (tag, path, dropped) of open containers and dropped elements
    blocks, paths, order, text, threads = [], Counter(), Counter(), [], []
    at = 0

    def close_block():
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                blocks.append((stack[-1][1] if stack else "", " ".join(words)))
            text.clear()

    for m in TOKEN.finditer(html):
        if m.start() > at and not (stack and stack[-1][2]):
            text.append(html[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue  # comments, declarations and elements whose content is no text
        tag = tag.lower()
        if m[2]:
            if tag in LEAVES:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[0] in CONTAINERS or s[0] in LEAVES for s in stack[i:]):
                        close_block()
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "body") and tag not in ("article", "body", "html", "main"):
                    break  # a stray end tag does not end the article
            continue
        if tag == "br":
            text.append(" ")
            continue
        container = tag in CONTAINERS
        if container or tag in LEAVES:
            close_block()
        if tag in LEAVES and stack and stack[-1][0] in LEAVES and stack[-1][2]:
            stack.pop()  # a dropped paragraph without an end tag
        if (container or tag in LEAVES) and stack and stack[-1][0] in FOREIGN:
            stack.pop()  # as browsers do
        if tag in HIDDEN and not m[4].endswith("/") and not has_end(html, at, tag):
            continue
        if tag in VOID or (m[4].endswith("/") and not container and tag not in LEAVES):
            continue
        names, role, classes, ids = [], "", "", ""
        if "=" in m[4]:
            for kind, a, b, c in NAMES.findall(m[4]):
                value = (a or b or c).lower()
                if kind.lower() == "role":
                    role = value
                else:
                    names += re.findall(r"[a-z]+", value)
                    if kind.lower() == "class":
                        classes += " " + value
                    else:
                        ids += " " + value
        above = stack[-1] if stack else ("", "", False)
        inside = any(s[0] in ("article", "main") for s in stack)
        dropped = tag in DROPPED_TAGS or tag in HIDDEN or role in DROPPED_ROLES or tag == "header" and not inside
        told = False
        if tag == "form" and not above[2]:
            kind = form_kind(html, at)
            dropped, told = dropped or kind == 2, kind == 1
        if not inside and container and tag not in ("html", "body", "article", "main") and not SITE_HEADERS.isdisjoint((classes + " " + ids).split()):
            told = True
        if names and tag not in ("html", "body", "article", "main") and not DROPPED_NAMES.isdisjoint(names):
            if container:
                told = told or is_dropped(classes, DROPPED_NAMES) or is_dropped(ids, IDS_INSIDE if inside else DROPPED_NAMES)
            else:
                dropped = dropped or is_dropped(classes, DROPPED_NAMES - NOT_OF_LEAVES)
        if container or dropped:
            path = above[1]
            if container:
                label = MARK * told + ".".join([tag, *sorted(set(names))])
                path = f"{path}>{label}" if path else label
                # Containers of one name below one parent have different roles by their order.
                order[path] += 1
                if order[path] > 1:
                    path = f"{path}#{order[path]}"
                paths[path] += 1
                if not told and not THREADS.isdisjoint(names):
                    threads.append(path)
            stack.append((tag, path if container else above[1], above[2] or dropped))
    if at < len(html) and not (stack and stack[-1][2]):
        tail = html[at:]
        text.append(tail[:tail.rfind("<")] if re.search(r"<[a-zA-Z/][^>]*\Z", tail) else tail)  # a tag that was cut off
    close_block()
    for path in threads:
        # Repeated sibling blocks of one name.
        if any(p.startswith(path + ">") and re.fullmatch(r"[^>]*\.[^>]*#\d+", p[len(path) + 1:]) for p in paths):
            outer, _, label = path.rpartition(">")
            new = f"{outer}>{MARK}{label}" if outer else MARK + label
            blocks = [(new + p[len(path):] if within(p, path) else p, t) for p, t in blocks]
            paths = Counter({new + p[len(path):] if within(p, path) else p: n for p, n in paths.items()})
            threads[:] = [new + p[len(path):] if within(p, path) else p for p in threads]
    return blocks, paths


def ancestors(path: str):
    """The path itself and those around it."""
    while path:
        yield path
        path = path.rpartition(">")[0]


def marked(path: str) -> bool:
    """Whether the container itself has a dropped name."""
    return path.rpartition(">")[2].startswith(MARK)


def page_tokens(html: str) -> dict[str, tuple[int, int, int]]:
    """For each container path: its count, the characters below it and a hash of their text. Text in a marked container
    does not count for those around it."""
    blocks, paths = parse(html)
    chars, below = Counter(), defaultdict(xxhash.xxh3_64)
    for path, text in blocks:
        for p in ancestors(path):
            chars[p] += len(text)
            below[p].update(text)
            if marked(p):
                break
    return {p: (n, chars[p], below[p].intdigest() >> 1 if p in below else 0) for p, n in paths.items()}


STATS = "host string, path string, pages long, vector long, ones long, chars long, low long, high long"


def token_rows(batches):
    """Per host and token of a task: pages, the vector's name, pages with one occurrence, characters, least and greatest text hash."""
    for batch in batches:
        held = {}
        for page, host, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            mark = f"{page}"
            for path, (n, chars, below) in page_tokens(html).items():
                name = xxhash.xxh3_64_intdigest(f"{mark}:{n}") >> 24  # sums of 40-bit numbers fit a long
                row = held.get((host, path))
                if row is None:
                    held[host, path] = [1, name, int(n == 1), chars, below, below]
                else:
                    row[0] += 1
                    row[1] += name
                    row[2] += n == 1
                    row[3] += chars
                    row[4], row[5] = min(row[4], below), max(row[5], below)
            name_all = xxhash.xxh3_64_intdigest(f"{mark}:1") >> 24
            row = held.setdefault((host, ""), [0, 0, 0, 0, 0, 0])  # the host itself: the vector of ones
            row[0] += 1
            row[1] += name_all
            row[2] += 1
        keys, rows = list(held), list(held.values())
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                names=["host", "path", "pages", "vector", "ones", "chars", "low", "high"])


def template_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens of `token_rows` summed by host and path: those that a template can have, and each host's own row. Paths of
    single pages (of generated names) stay out, so a host's rows are bounded by its template."""
    sums = [F.sum(c).alias(c) for c in ("pages", "vector", "ones", "chars")]
    stats = stored(tokens.groupBy("host", "path").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")), "page-tokens")
    hosts = stats.filter("path = ''").select("host", F.col("pages").alias("all_pages"), F.col("vector").alias("all_vector"))
    can = (F.col("ones") >= SUPPORT * F.col("all_pages")) | (F.col("pages") == F.col("all_pages")) & (F.col("vector") == F.col("all_vector"))
    return stats.join(hosts, "host").filter(can).select(*stats.columns)


def within(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + ">")


def deduce(tokens: list[tuple[str, int, int, int, int, int, int]]) -> tuple[list[str], list[str], list[str]]:
    """From a host's tokens `(path, pages, vector, ones, chars, low, high)`: the article's containers (none: the whole
    page), the containers of constant text and the marked containers that stay."""
    by_path = {t[0]: t for t in tokens}
    whole = by_path[""]
    classes = defaultdict(set)
    for path, pages, vector, *_ in tokens:
        classes[pages, vector].add(path)
    # The class of the vector of ones, and tokens that miss it on a few pages only.
    template = set(classes[whole[1], whole[2]])
    template |= {t[0] for t in tokens if t[3] >= SUPPORT * whole[1]}
    nested = {""}
    for path in sorted(template, key=lambda p: p.count(">")):
        if path and path.rpartition(">")[0] in nested:
            nested.add(path)
    nested.discard("")
    chars = {p: by_path[p][4] for p in nested}

    def top() -> int:
        return sum(chars[p] for p in nested if ">" not in p and (not marked(p) or p in stays))

    def seen(path: str) -> bool:
        return all(p in stays for p in ancestors(path) if marked(p))

    # A marked container stays when it holds the article or nearly all text; its text then counts for those around it.
    stays: set[str] = set()
    articles = [p for p in nested if re.match(r"(article|main)\b", p.rpartition(">")[2]) and chars[p]]
    suspects = sorted((p for p in nested if marked(p)), key=lambda p: (-p.count(">"), p))
    everything = top() + sum(chars[p] for p in suspects)
    hidden = not any(seen(p) for p in articles)
    for p in suspects:
        holds = any(within(q, p) and all(m in stays or not within(m, p) or m == p for m in ancestors(q) if marked(m)) for q in articles)
        if chars[p] and (holds and (hidden or chars[p] >= NAMED_SHARE * everything) or chars[p] >= OVERRULING_SHARE * everything):
            stays.add(p)
            for outer in list(ancestors(p))[1:]:
                chars[outer] += chars[p]
                if marked(outer):
                    break
    named = []
    for p in sorted(articles, key=lambda p: (p.count(">"), p)):
        if seen(p) and not any(within(p, q) for q in named):
            named.append(p)
    main = named if named and sum(chars[p] for p in named) >= NAMED_SHARE * top() else []
    same = {p for p in nested if by_path[p][4] and by_path[p][5] == by_path[p][6] and by_path[p][1] == whole[1] and not any(p != q and within(q, p) for q in stays)}
    constant = []
    # On a host whose pages all have the same text nothing tells the template's text.
    if whole[1] >= LEAST_PAGES and not same.issuperset(main or [p for p in nested if ">" not in p]):
        constant = sorted(p for p in same if not main or any(within(p, q) for q in main))
    return main, constant, sorted(stays)


def extract(html: str, main: list[str], constant: list[str], stays: list[str]) -> str:
    """The text of a page by its host's template; by its own tokens where the page lacks the template's container or would
    have no text."""
    blocks, paths = parse(html)

    def kept() -> list[str]:
        wanted, gone, known = set(main), set(constant), set(stays)
        out = []
        for path, text in blocks:
            around = list(ancestors(path))
            if (not wanted or not wanted.isdisjoint(around)) and gone.isdisjoint(around) and all(p in known for p in around if marked(p)):
                out.append(text)
        return out

    found = [] if main and not any(paths[p] for p in main) else kept()
    if blocks and not found:
        own = [("", 1, 0, 1, 0, 0, 0)]
        own += [(p, 1, int(n != 1), int(n == 1), chars, below, below) for p, (n, chars, below) in page_tokens(html).items()]
        main, _, stays = deduce(own)  # the host's constant text is no page's own
        found = kept()
    return "\n\n".join(found)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Blocks are in page order, joined by two line feeds, with character references decoded and white space as one space.
    A form goes where it is little but fields; one around a page's text is a wrapper. Null html counts as empty and gives
    an empty text; pages of a null url (or one without a host) count as one host; repeated rows are pages of their own;
    an empty table gives no rows. Very long pages are read whole, one at a time in a task.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    tokens = rows.select(F.xxhash64("page_id", "url").alias("page"), "host", "html").mapInArrow(token_rows, STATS)

    def templates(table: pa.Table) -> pa.Table:
        names = ["path", "pages", "vector", "ones", "chars", "low", "high"]
        main, constant, stays = deduce(list(zip(*(table.column(c).to_pylist() for c in names))))
        lists = {n: pa.array([x], pa.list_(pa.string())) for n, x in (("main", main), ("constant", constant), ("stays", stays))}
        return pa.table({"host": table.column("host").slice(0, 1), **lists})

    found = stored(template_tokens(tokens).groupBy("host").applyInArrow(templates, "host string, main array<string>, constant array<string>, stays array<string>"), "templates")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(at, BATCH_PAGES)
                cells = (part.column(c).to_pylist() for c in ("html", "main", "constant", "stays"))
                out = [extract(html, *(x or [] for x in lists)) for html, *lists in zip(*cells)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "main", "constant", "stays")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
