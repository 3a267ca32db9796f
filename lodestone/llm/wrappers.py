"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and text slots (inline markup belongs to the slot).  Its skeleton is the regular expression of
the stream alone: equal neighbours are folded into a repeated item, and where items recur with others between, that stretch
becomes a repeated group whose items may be missing.  The different skeletons of a host are then aligned one after another: items
that match are merged, the others become optional, and an order that differs from page to page becomes a repeated group.  So no
alternative is ever needed, and an expression holds every kind of item of an element once.

Slots of the finished wrapper are judged by what all pages of the host hold there (text, link text, how often it changes) and by
the names on their path; the slots of the article give the text.  Pages are first reduced to different skeletons, which are
merged in hash groups of bounded size over several rounds, so a host with a third of all pages is no larger task than another.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep, scratch
from lodestone.session import write_table

# Names of HTML elements and attributes, and words by which sites name parts of a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math object".split())
IGNORED = frozenset("html head body".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
    "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog select button fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert advertisement adverts banner promo "
    "promotion sponsor sponsored cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social "
    "comment comments respond disqus discussion reply replies related recommended widget pagination pager toolbar search form skip".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DEPTH = 64  # deeper elements still part blocks, but are not levels of their own
SLOT, GROUP = "#", "("
OPTIONAL, REPEATED = 1, 2
ALIKE = 0.5  # share of child names that makes two elements of one name the same kind
FAN_IN = 64  # skeletons merged by one group
TEMPLATE_PAGES = 20  # pages that show whether a slot never changes

# An item is (label, flags, content); content is a tuple of items.  A slot's content is empty.
Item = tuple[str, int, tuple]


class _Element:
    __slots__ = ("name", "label", "kids")

    def __init__(self, name: str, label: str):
        self.name, self.label, self.kids = name, label, []


class _Slot:
    __slots__ = ("parts", "text", "links")

    def __init__(self):
        self.parts: list[tuple[str, bool]] = []


def _label(name: str, attributes: str) -> str:
    if "=" not in attributes:
        return name
    words = set()
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        words.update(("@" if kind.lower() == "role" else "") + re.sub(r"\d+", "", w) for w in value.split())
    words.discard("")
    return ".".join([name, *sorted(words)])


def tree(page: str) -> _Element:
    """The page's blocks and slots, with end tags that HTML implies."""
    root = _Element("", "")
    stack, fresh, link = [root], False, False

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        kids = stack[-1].kids
        if fresh or not kids or not isinstance(kids[-1], _Slot):
            if raw.isspace():
                return
            kids.append(_Slot())
            fresh = False
        kids[-1].parts.append((raw, link))

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:] if "<" not in page[at:] or not re.search(r"<[/!?A-Za-z][^>]*\Z", page[at:]) else re.sub(r"<[/!?A-Za-z][^<>]*\Z", "", page[at:]))
            break
        text(page[at:tag.start()])
        at = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            text(tag[1] or "")
            continue
        if name in RAW and not tag[2]:
            if not tag[4].endswith("/"):
                close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name in INLINE:
            if name == "a":
                link = not tag[2]
            elif name == "br":
                text(" ")
            continue
        fresh, link = True, False
        if name in IGNORED:
            continue
        if tag[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if stack[-1].name == "p":
            stack.pop()
        if name in CLOSES:
            ends, within = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in within:
                    break
                if stack[i].name in ends.split():
                    del stack[i:]
        if name in VOID or len(stack) > DEPTH:
            continue
        node = _Element(name, _label(name, tag[4]))
        stack[-1].kids.append(node)
        stack.append(node)
    return root


def _finish(slot: _Slot) -> None:
    """White space to single spaces, references decoded; ``links`` counts the characters of link text."""
    slot.text = " ".join(entities.unescape("".join(p for p, _ in slot.parts)).split())
    slot.links = len(" ".join(entities.unescape(" ".join(p for p, linked in slot.parts if linked)).split())) if any(x for _, x in slot.parts) else 0


def _names(content: tuple) -> frozenset:
    return frozenset(label for label, _, _ in flat(content))


def flat(content: tuple) -> list[Item]:
    """Items with those of groups in their place; a place in a wrapper is a path of these numbers."""
    out = []
    for item in content:
        out.extend(item[2] if item[0] == GROUP else (item,))
    return out


def _likeness(a: Item, b: Item) -> float:
    if a[0] != b[0]:
        return 0.0
    x, y = _names(a[2]), _names(b[2])
    return 1.0 if not x or not y else len(x & y) / len(x | y)


def _joined(a: Item, b: Item, flags: int) -> Item:
    return (a[0], a[1] | b[1] | flags, aligned(a[2], b[2]))


def _collapsed(items: list[Item], spans: list[tuple[int, int]]) -> tuple:
    """``items`` as an expression: equal neighbours become repeated, stretches with recurring items and ``spans`` become groups."""
    kinds: list[list[int]] = []  # places of each kind
    by_label: dict[str, list[int]] = {}
    kind_of: list[int] = []
    shown: list[Item] = []
    for i, item in enumerate(items):
        best = max(((_likeness(shown[k], item), -k) for k in by_label.get(item[0], ())), default=(0.0, 0))
        if best[0] >= ALIKE:
            kind = -best[1]
            shown[kind] = item if shown[kind][2] == item[2] else (item[0], 0, aligned(shown[kind][2], item[2]))
            kinds[kind].append(i)
        else:
            kind = len(kinds)
            kinds.append([i])
            shown.append(item)
            by_label.setdefault(item[0], []).append(kind)
        kind_of.append(kind)
    all_spans = spans + [(p[0], p[-1]) for p in kinds if p[-1] > p[0]]
    all_spans.sort()
    united: list[list[int]] = []
    for a, b in all_spans:
        if united and a <= united[-1][1]:
            united[-1][1] = max(united[-1][1], b)
        else:
            united.append([a, b])
    out, at = [], 0
    for a, b in [*united, [len(items), len(items)]]:
        out.extend(items[at:a])
        if a == len(items):
            break
        order: list[int] = []
        for i in range(a, b + 1):
            if kind_of[i] not in order:
                order.append(kind_of[i])
        flags = {k: 0 for k in order}
        for i in range(a, b + 1):
            flags[kind_of[i]] |= items[i][1]
        if len(order) == 1:
            k = order[0]
            out.append((shown[k][0], flags[k] | REPEATED, shown[k][2]))
        else:
            # An iteration ends where an item does not come after the one before it.
            turns, seen, last = [], set(), -1
            for i in range(a, b + 1):
                place = order.index(kind_of[i])
                if place < last or (place == last and not flags[kind_of[i]] & REPEATED and kind_of[i] in seen):
                    turns.append(seen)
                    seen = set()
                seen.add(kind_of[i])
                last = place
            turns.append(seen)
            out.append((GROUP, REPEATED, tuple(
                (shown[k][0], flags[k] | (0 if all(k in t for t in turns) else OPTIONAL), shown[k][2]) for k in order)))
        at = b + 1
    return tuple(out)


def aligned(a: tuple, b: tuple) -> tuple:
    """The expression that holds both: matching items are merged, the others become optional."""
    if a == b:
        return a
    x, y = flat(a), flat(b)
    score = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    like = [[_likeness(p, q) for q in y] for p in x]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            take = score[i + 1][j + 1] + like[i][j] if like[i][j] >= ALIKE else -1.0
            score[i][j] = max(score[i + 1][j], score[i][j + 1], take)
    items, from_x, from_y = [], {}, {}
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and like[i][j] >= ALIKE and score[i][j] == score[i + 1][j + 1] + like[i][j]:
            from_x[i], from_y[j] = len(items), len(items)
            items.append(_joined(x[i], y[j], 0))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and score[i][j] == score[i + 1][j]):
            from_x[i] = len(items)
            items.append((x[i][0], x[i][1] | OPTIONAL, x[i][2]))
            i += 1
        else:
            from_y[j] = len(items)
            items.append((y[j][0], y[j][1] | OPTIONAL, y[j][2]))
            j += 1
    spans = []
    for content, place in ((a, from_x), (b, from_y)):
        at = 0
        for item in content:
            if item[0] == GROUP:
                spans.append((place[at], place[at + len(item[2]) - 1]))
                at += len(item[2])
            else:
                at += 1
    return _collapsed(items, spans)


def skeleton(element: _Element) -> tuple:
    """The expression of one element's content; empty elements and slots are left out."""
    items: list[Item] = []
    kids = []
    for kid in element.kids:
        if isinstance(kid, _Slot):
            _finish(kid)
            if kid.text:
                items.append((SLOT, 0, ()))
                kids.append(kid)
        else:
            content = skeleton(kid)
            if content:
                items.append((kid.label, 0, content))
                kids.append(kid)
    element.kids = kids
    return _collapsed(items, [])


def _place(item: Item, options: list[Item]) -> int:
    """The number of the item among ``options`` that is of its kind."""
    best = max(((o[0] == item[0], _likeness(item, o), -i) for i, o in enumerate(options)), default=(False, 0.0, 0))
    return -best[2] if best[0] else -1


def slots(element: _Element, content: tuple, path: str = "") -> Iterator[tuple[str, _Slot]]:
    """Slots of a page with their place in its own skeleton."""
    options = flat(content)
    for kid in element.kids:
        if isinstance(kid, _Slot):
            i = _place((SLOT, 0, ()), options)
            yield f"{path}{i}", kid
        else:
            i = _place((kid.label, 0, tuple((k.label if isinstance(k, _Element) else SLOT, 0, ()) for k in kid.kids)), options)
            yield from slots(kid, options[i][2], f"{path}{i}.")


def located(content: tuple, wrapper: tuple, path: str = "", to: str = "") -> Iterator[tuple[str, str]]:
    """(place in a skeleton, place in the wrapper) of every slot; a slot the wrapper lacks has no place there."""
    options = flat(wrapper)
    for i, item in enumerate(flat(content)):
        j = _place(item, options) if options else -1
        if item[0] == SLOT:
            yield f"{path}{i}", f"{to}{j}" if j >= 0 else ""
        else:
            yield from located(item[2], options[j][2] if j >= 0 else (), f"{path}{i}.", f"{to}{j}.")


def loaded(text: str) -> tuple:
    def items(rows) -> tuple:
        return tuple((label, flags, items(content)) for label, flags, content in rows)
    return items(json.loads(text))


def regex(content: tuple) -> str:
    """The expression in the usual notation."""
    out = []
    for label, flags, inner in content:
        body = "TEXT" if label == SLOT else f"({regex(inner)})" if label == GROUP else f"<{label}>{regex(inner)}</{label.split('.')[0]}>"
        mark = ("", "?", "+", "*")[flags]
        out.append(f"({body}){mark}" if mark and label not in (SLOT, GROUP) else body + mark)
    return "".join(out)


def _outside(label: str, within: bool) -> bool:
    """Whether an element's name puts it outside the article; ``within``: it lies in one."""
    name, *words = label.split(".")
    if name in OUTSIDE_TAGS or (name == "header" and not within):
        return True
    for w in words:
        if w.startswith("@"):
            if w[1:] in OUTSIDE_ROLES:
                return True
        elif w in OUTSIDE_WORDS or any(p in OUTSIDE_WORDS for p in re.split(r"[-_]+", w)) and not any(p in ARTICLE_WORDS for p in re.split(r"[-_]+", w)):
            return True
    return False


def chosen(wrapper: tuple, facts: dict[str, tuple[int, int, int, int, bool]], pages: int) -> set[str]:
    """Places of the article's slots.  ``facts``: pages, blocks, characters, link characters, one text only, by place."""
    leaves: list[tuple[str, tuple[str, ...], bool]] = []  # place, labels on the path, in a repeated item

    def walk(content: tuple, path: str, labels: tuple[str, ...], again: bool) -> None:
        groups = [bool(i[1] & REPEATED) for i in content for _ in (i[2] if i[0] == GROUP else (i,))]
        for i, (label, flags, inner) in enumerate(flat(content)):
            more = again or groups[i] or bool(flags & REPEATED)
            if label == SLOT:
                if f"{path}{i}" in facts:
                    leaves.append((f"{path}{i}", labels, more))
            else:
                walk(inner, f"{path}{i}.", (*labels, label), more)

    walk(wrapper, "", (), False)

    def inside(labels: tuple[str, ...], start: int = 0) -> bool:
        return not any(_outside(label, start > 0 or "article" in (x.split(".")[0] for x in labels[:k])) for k, label in enumerate(labels) if k >= start)

    def below(test) -> list[tuple[str, tuple[str, ...], bool]]:
        """Leaves under the outermost element that passes, with nothing outside the article on the whole path."""
        return [leaf for leaf in leaves if any(test(x) for x in leaf[1]) and inside(leaf[1])]

    def words(label: str) -> set[str]:
        return {p for w in label.split(".")[1:] if not w.startswith("@") for p in re.split(r"[-_]+", w)}

    found = below(lambda x: x.split(".")[0] == "article" or "@article" in x.split("."))
    sure = bool(found)
    if not found:
        found = below(lambda x: x.split(".")[0] == "main" or "@main" in x.split("."))
    if not found:
        found = below(lambda x: bool(words(x) & ARTICLE_WORDS))
    if not found:
        rest = [leaf for leaf in leaves if inside(leaf[1]) and not _mostly_links(facts[leaf[0]])]
        # Down to the element that still holds most of the text.
        depth = 0
        while rest:
            weights: dict[str, int] = {}
            for place, labels, _ in rest:
                if len(labels) > depth + 1:
                    head = ".".join(place.split(".")[:depth + 1])
                    weights[head] = weights.get(head, 0) + facts[place][2]
            total = sum(facts[place][2] for place, _, _ in rest)
            head = max(weights, key=lambda h: (weights[h], h), default=None)
            if head is None or weights[head] < 0.6 * total:
                break
            rest = [leaf for leaf in rest if f"{leaf[0]}.".startswith(f"{head}.")]
            depth += 1
        found = rest
    out = set()
    for place, labels, again in found:
        at = facts[place]
        name = labels[-1].split(".")[0] if labels else ""
        in_header = any(x.split(".")[0] == "header" for x in labels)
        if in_header and name not in HEADINGS:
            continue
        if _mostly_links(at) and name not in HEADINGS and not (sure and name == "p"):
            continue
        out.add(place)
    changing = any(not facts[p][4] for p in out)
    fixed = {p for p, _, again in found if p in out and changing and not again and facts[p][4] and facts[p][0] >= TEMPLATE_PAGES and 2 * facts[p][0] >= pages}
    return out - fixed


def _mostly_links(fact: tuple) -> bool:
    return 2 * fact[3] > fact[2]


BLOCKS = "array<struct<place string, first boolean, text string, links int>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("place", pa.string()), ("first", pa.bool_()), ("text", pa.string()), ("links", pa.int32())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = batch.slice(lo, 512)
            keys, skeletons, found = [], [], []
            for page in rows.column("html").to_pylist():
                root = tree(page or "")
                content = skeleton(root)
                body = json.dumps(content, ensure_ascii=False, separators=(",", ":"))
                seen: set[str] = set()
                blocks = []
                for place, slot in slots(root, content):
                    blocks.append((place, place not in seen, slot.text, slot.links))
                    seen.add(place)
                keys.append(hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()[:32])
                skeletons.append(body)
                found.append([dict(zip(("place", "first", "text", "links"), b)) for b in blocks])
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("url"), rows.column("host"), pa.array(keys, pa.string()), pa.array(skeletons, pa.string()), pa.array(found, kind)],
                ["id", "url", "host", "key", "skeleton", "blocks"])


def _merged(key, rows):
    """One expression for the skeletons of a group, aligned in the order of their text."""
    texts = sorted(rows.column("skeleton").to_pylist())
    whole = loaded(texts[0])
    for text in texts[1:]:
        whole = aligned(whole, loaded(text))
    return pa.table({"host": [key[0].as_py()], "skeleton": [json.dumps(whole, ensure_ascii=False, separators=(",", ":"))]})


def wrappers(skeletons: DataFrame) -> DataFrame:
    """(host, wrapper) from different (host, skeleton): merged by hash groups until each host has one expression."""
    left = skeletons.select("host", "skeleton")
    while True:
        sizes = left.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        group = F.pmod(F.xxhash64("skeleton"), F.ceil(F.col("n") / FAN_IN)).cast("int")
        dealt = left.join(sizes, "host").select("host", "skeleton", group.alias("part"))
        left = keep(dealt.groupBy("host", "part").applyInArrow(_merged, "host string, skeleton string"), "merged")
        if most <= FAN_IN:
            return left.withColumnRenamed("skeleton", "wrapper")
        left = left.distinct()


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, last, wrapper = [], None, ()
        for text, whole in zip(batch.column("skeleton").to_pylist(), batch.column("wrapper").to_pylist()):
            if whole != last:
                last, wrapper = whole, loaded(whole)
            places.append([{"place": a, "slot": b} for a, b in located(loaded(text), wrapper)])
        kind = pa.list_(pa.struct([("place", pa.string()), ("slot", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(places, kind)], ["host", "key", "places"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, last, best = [], None, set()
        for host, whole, places, facts, pages in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "places", "facts", "pages"))):
            by_slot = {f["slot"]: (f["pages"], f["blocks"], f["chars"], f["links"], f["fixed"]) for f in facts or [] if f["slot"]}
            wrapper = loaded(whole)
            if (host, whole) != last:
                last, best = (host, whole), chosen(wrapper, by_slot, pages)
            own = {p["slot"] for p in places}
            kept = best & own or chosen(wrapper, {s: f for s, f in by_slot.items() if s in own}, pages)
            out.append([p["place"] for p in places if p["slot"] in kept])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(out, pa.list_(pa.string()))], ["host", "key", "kept"])


def host(url: Column) -> Column:
    """Host of a URL in lower case without its port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _extracted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = keep(pages.mapInArrow(_parsed, f"id long, url string, host string, key string, skeleton string, blocks {BLOCKS}"), "blocks", "zstd")
    skeletons = keep(parsed.groupBy("host", "key", "skeleton").agg(F.count("*").alias("n")), "skeletons")
    found = wrappers(skeletons)
    mapped = keep(skeletons.join(found, "host").mapInArrow(_located, "host string, key string, places array<struct<place string, slot string>>"), "mapped")
    each = parsed.select("host", "key", F.explode("blocks").alias("b"))
    digest = F.xxhash64("b.text")
    counted = each.groupBy("host", "key", "b.place").agg(
        F.count_if("b.first").alias("pages"), F.count("*").alias("blocks"), F.sum(F.length("b.text")).alias("chars"), F.sum("b.links").alias("links"),
        F.min(digest).alias("low"), F.max(digest).alias("high"))
    slot = mapped.select("host", "key", F.explode("places").alias("p")).select("host", "key", "p.place", "p.slot")
    facts = counted.join(slot, ["host", "key", "place"]).groupBy("host", "slot").agg(
        *(F.sum(c).alias(c) for c in ("pages", "blocks", "chars", "links")), (F.min("low") == F.max("high")).alias("fixed"))
    facts = facts.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "blocks", "chars", "links", "fixed")).alias("facts"))  # slots of one wrapper
    totals = skeletons.groupBy("host").agg(F.sum("n").alias("pages"))
    judged = mapped.join(found, "host").join(totals, "host").join(facts, "host", "left")
    decided = keep(judged.select("host", "key", "wrapper", "places", "facts", "pages").mapInArrow(_chosen, "host string, key string, kept array<string>"), "decided")
    rows = parsed.select("id", "url", "host", "key", "blocks").join(decided, ["host", "key"], "left")
    own = F.filter("blocks", lambda b: F.array_contains(F.coalesce("kept", F.array().cast("array<string>")), b["place"]))
    text = F.array_join(F.transform(own, lambda b: b["text"]), "\n")
    return rows.select("id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars")), found


def main_texts(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row: the article's blocks, one per line.

    Null and empty pages, and pages without an article, have an empty text.  Pages without a host in their URL are judged together.
    Rows with the same or a null id are rows of their own; extra columns are ignored.  Elements nested deeper than ``DEPTH`` part
    blocks, but count as content of the one above them.
    """
    pages = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), host(F.col(url_column)).alias("host"), F.col(html_column).alias("html"))
    with scratch(df.sparkSession):
        return write_table(_extracted(pages)[0], "texts", compression="zstd").withColumnsRenamed({"id": id_column, "url": url_column})


def host_wrappers(df: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, wrapper): each host's expression in the usual notation of regular expressions."""
    pages = df.select(F.lit(0).cast("long").alias("id"), F.col(url_column).alias("url"), host(F.col(url_column)).alias("host"), F.col(html_column).alias("html"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [regex(loaded(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(texts, pa.string())], ["host", "wrapper"])

    with scratch(df.sparkSession):
        return write_table(_extracted(pages)[1].mapInArrow(written, "host string, wrapper string"), "wrappers")
