"""Main text of web pages by equivalence classes of their tokens across pages of one host.

Tokens are the elements of a page, told apart by their path, names (class, id, role; digits left out) and number among
equal siblings, and its blocks of text, told apart by the element they stand in. The occurrence vector of a token says
on which pages of the host it stands; tokens with one vector form an equivalence class. Classes of CLASS tokens or
more, on MIN_PAGES pages or more and on a hundredth of the host's, are kept, and are valid if they nest: the element
around each of their elements is of a valid class itself, which stands on the same pages or more. Valid classes, nested,
are the host's template; several layouts give classes beside each other. A block in the class of its own element
is fixed text of the template; what the template doesn't fix is left in the slots between its elements.

Of the remaining slots the page's main text is in the deepest one that holds most of what remains, reached from the
page's root over elements that have no varying text of their own beside it; elements of the template that hold mostly
links are left out, and so are fixed blocks. Markup that states what it is goes first where there is any: navigation,
forms, adverts and the like by tag or name are no text of any slot, an article or main element around or in the slot
is taken whole, and without a template (a host of fewer than MIN_PAGES pages) such elements are the main text.

Occurrence vectors are never gathered: sums of a 36-bit hash of the page stand for them, added up in each batch before
the shuffle, so a host with a third of all pages costs one small row for each token and batch. A template has at most a
hundred times the tokens of a mean page.

Defined cases: null, empty and tag-less pages count (plain text is its own text); repeated pages are extracted alike,
and a host whose pages hardly differ has no fixed text; equal slots: the first on the page; very long and very deep
pages are read whole, in time linear in their length; broken and cut-off markup ends at the end of the page; an empty
table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shared import stored
from gleaner.llm.url_filter import host_of

#: Elements that are never content, that end a block, that have no end tag, that end an open one of their own.
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select option input label fieldset head title".split())
RAW_TAGS = "script|style|noscript|template|textarea|iframe"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_ENDING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SLOT_TAGS = frozenset("html body div section article main header footer aside nav form table ul ol td tr tbody figure details dialog".split())
#: Words of a class, id or role that mark navigation, adverts, notices, forms or comments; and those that
#: mark the page's own header, unless they stand within the article.
NOISE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|advert|advertisement|advertising|adsense|adsbygoogle|adslot|adbox|banner|sponsor|sponsored|promo|promotion|outbrain|taboola|cookie|consent|gdpr|notice|alert|disclaimer|paywall"
    r"|popup|modal|overlay|toast|newsletter|subscribe|subscription|signup|login|search|searchbox|nav|navbar|navigation|menu|breadcrumb|sidebar|side|complementary|footer|foot|contentinfo|masthead|topbar|toolbar"
    r"|share|sharing|social|related|recommended|recommendation|widget|comment|respond|disqus|replies|reply|pagination|pager|skip|copyright|hidden)s?(?:$|[-_ ])",
    re.I,
)
OUTER_NAMES = re.compile(r"(?:^|[-_ ])(?:header|hdr|logo|branding|tagline|languages?|bottom)(?:$|[-_ ])", re.I)
#: Tokens of a class; pages it stands on, and hundredths of the host's; share of what remains that the slot holds;
#: share of a slot's text that may stand beside it, or in an equal sibling; share of links; least share that isn't fixed.
CLASS, MIN_PAGES, HUNDREDTHS, MOST, BESIDE, RIVAL, LINKY, VARYING = 2, 3, 1, 0.6, 0.01, 0.15, 0.6, 0.2
#: Longs of all templates together that are broadcast (4 MB).
BROADCAST_LONGS = 500_000
_CONTAINERS = frozenset("html body div section article main td tr tbody table".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TAGS})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAME = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _named(rest: str) -> str:
    """Class, id and role of a tag, camel case cut at its humps; `hidden` if the element isn't shown."""
    if not rest:
        return ""
    names = " ".join(a or b or c for a, b, c in _NAME.findall(rest))
    return re.sub("([a-z])([A-Z])", r"\1-\2", names) + (" hidden" if _HIDDEN.search(rest) else "")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('open', tag, names), ('close', tag, ''), ('text', decoded text, ''), ('br', '', ''): open elements are always closed."""
    stack: list[str] = []
    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if (text := m["text"]) is not None:
            yield "text", html_lib.unescape(text), ""
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                if tag in stack:
                    while stack:
                        top = stack.pop()
                        yield "close", top, ""
                        if top == tag:
                            break
                elif tag == "p":
                    yield "break", "p", ""
            elif tag in VOID_TAGS:
                yield ("break" if tag == "hr" else "br"), tag, ""
            else:
                ends = SELF_ENDING.get(tag, ())
                if not ends and tag in BLOCK_TAGS and "p" in stack:
                    ends = ("p",)
                if ends:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i] in ends:
                            while len(stack) > i:
                                yield "close", stack.pop(), ""
                            break
                        if stack[i] in SLOT_TAGS and stack[i] not in ends:
                            break
                stack.append(tag)
                yield "open", tag, _named(m["rest"])
        elif kind is not None and m["raw"]:
            yield "break" if m["raw"].lower() in BLOCK_TAGS else "br", "", ""
    while stack:
        yield "close", stack.pop(), ""


@lru_cache(maxsize=20_000)
def _noise(tag: str, names: str, inside_article: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not inside_article):
        return True
    if not names or tag in ("html", "body"):
        return False
    if tag in ("article", "main"):
        return bool(re.search("comment|reply|teaser|promo|hidden", names, re.I))
    return bool(NOISE_NAMES.search(names)) or (not inside_article and bool(OUTER_NAMES.search(names)))


@lru_cache(maxsize=20_000)
def _plain(names: str) -> str:
    return ".".join(sorted(set(re.sub(r"\d+", "", names.lower()).split())))


@lru_cache(maxsize=50_000)
def _token(parent: int, tag: str, plain: str, number: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{tag}.{plain}#{number}") >> 1


def _block_token(parent: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, parent & 0xFFFFFFFF) >> 1


class Element(NamedTuple):
    """A slot element; blocks[first:end] stand in it. up: index of the one around it; group: equal siblings share it."""

    token: int
    up: int
    group: int
    tag: str
    first: int
    end: int
    chars: int  # of text that is no link
    own: int  # of it, in no other element within
    link: int


def read(page: str) -> tuple[list[Element], list[tuple[str, int]]]:
    """Elements in order of their end tags' opening (the page itself first, with token 0) and blocks (text, index of the element)."""
    made: list[list] = [[0, -1, 0, "", 0, 0, 0, 0, 0]]
    numbers: list[dict] = [{}]
    blocks: list[tuple[str, int]] = []
    open_: list[tuple[bool, bool, bool, bool]] = []  # (noise, article or main, link, has an entry in made)
    at = bad = inside = links = linked = 0
    run: list[str] = []

    def end() -> None:
        nonlocal linked
        if run:
            if block := " ".join("".join(run).split()):
                blocks.append((block, at))
                plain = max(0, len(block) - linked)
                row = made[at]
                row[6] += plain
                row[7] += plain
                row[8] += len(block) - plain
            run.clear()
            linked = 0

    for kind, a, names in events(page):
        if kind == "text":
            if not bad:
                run.append(a)
                if links:
                    linked += len(a.strip())
        elif kind == "br":
            if run:
                run.append(" ")
        elif kind == "break":
            end()
        elif kind == "open":
            if a in BLOCK_TAGS:
                end()
            noise, article = _noise(a, names, inside > 0), a in ("article", "main")
            entry = a in SLOT_TAGS and not noise and not bad
            if entry:
                up, count, plain = made[at][0], numbers[at], _plain(names) if names else ""
                number = count[a, plain] = count.get((a, plain), 0) + 1
                made.append([_token(up, a, plain, number), at, _token(up, a, plain, 0), a, len(blocks), 0, 0, 0, 0])
                numbers.append({})
                at = len(made) - 1
            open_.append((noise, article, a == "a", entry))
            bad += noise
            inside += article
            links += a == "a"
        else:
            if a in BLOCK_TAGS:
                end()
            noise, article, link, entry = open_.pop()
            bad -= noise
            inside -= article
            links -= link
            if entry:
                row = made[at]
                row[5] = len(blocks)
                at = row[1]
                made[at][6] += row[6]
                made[at][8] += row[8]
    end()
    made[0][5] = len(blocks)
    return [Element(*x) for x in made], blocks


#: host, token, then sums over pages; up, group and tag are the token's own. kind 1: a block of text.
_COLUMNS = {"host": "long", "token": "long", "up": "long", "group": "long", "kind": "int", "tag": "string", "pages": "long", "vector": "long", "chars": "long", "own": "long", "link": "long", "whole": "long"}


def tokens(pages: DataFrame) -> DataFrame:
    """A row for each token of a host that stands on MIN_PAGES pages or more. pages: (host long, html). Pages are parsed once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, int], list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = page.as_py() or ""
                key = xxhash.xxh3_64_intdigest(page) >> 28
                elements, blocks = read(page)
                whole = elements[0].chars
                rows = {(host, e.token): (elements[e.up].token, e.group, 0, e.tag, 1, key, e.chars, e.own, e.link, whole) for e in elements}
                for text, at in blocks:
                    up = elements[at].token
                    rows.setdefault((host, _block_token(up, text)), (up, 0, 1, "", 1, key, len(text), 0, 0, 0))
                for k, row in rows.items():
                    if (old := sums.get(k)) is None:
                        sums[k] = list(row)
                    else:
                        for i in range(4, 10):
                            old[i] += row[i]
            columns = list(zip(*((*k, *row) for k, row in sums.items()), strict=True)) or [()] * len(_COLUMNS)
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, _COLUMNS.values(), strict=True)], list(_COLUMNS))

    seen = pages.mapInArrow(work, ", ".join(f"`{n}` {t}" for n, t in _COLUMNS.items()))
    same = [F.min(n).alias(n) for n in ("up", "group", "kind", "tag")]
    return seen.groupBy("host", "token").agg(*same, *[F.sum(n).alias(n) for n in list(_COLUMNS)[6:]]).filter(F.col("pages") >= MIN_PAGES)


def template(rows: list[dict]) -> tuple[list[int], list[int], list[int]]:
    """(slots on the way to the main text, elements left out, fixed blocks) of a host, from its tokens."""
    classes: dict[tuple[int, int], list[dict]] = {}
    for r in rows:
        classes.setdefault((r["vector"], r["pages"]), []).append(r)
    frequent = {r["token"]: r for group in classes.values() if len(group) >= CLASS for r in group}
    elements = {r["token"]: r for r in rows if not r["token"]} | {t: r for t, r in frequent.items() if not r["kind"]}
    below: dict[int, list[int]] = {}
    for t, r in elements.items():
        if t:
            below.setdefault(r["up"], []).append(t)
    order = [0]  # valid: what is reached from the root over classes that are valid themselves
    for t in order:
        order += sorted(below.get(t, ()))
    valid = {t: elements[t] for t in order}
    fixed = {t: r for t, r in frequent.items() if r["kind"] and (up := valid.get(r["up"])) and (up["vector"], up["pages"]) == (r["vector"], r["pages"])}
    remains, own = {t: r["chars"] for t, r in valid.items()}, {t: r["own"] for t, r in valid.items()}
    for r in fixed.values():
        t = r["up"]
        own[t] = max(0, own[t] - r["chars"])
        while True:
            remains[t] = max(0, remains[t] - r["chars"])
            if not t:
                break
            t = valid[t]["up"]
    root = valid[0]
    if remains[0] < VARYING * root["chars"]:  # copies of one page: their text isn't a template's
        fixed, remains, own = {}, {t: r["chars"] for t, r in valid.items()}, {t: r["own"] for t, r in valid.items()}
    least = remains[0] / root["chars"] if root["chars"] else 0.0
    dull = {t for t, r in valid.items() if r["tag"] not in ("", "html", "body", "article", "main") and r["link"] > LINKY * max(1, remains[t] + r["link"])}
    groups: dict[int, list[int]] = {}
    for t, r in valid.items():
        groups.setdefault(r["group"], []).append(t)
    good = {0}
    for t in order[1:]:
        r = valid[t]
        up = r["up"]
        rival = max((remains[o] for o in groups[r["group"]] if o != t), default=0)
        if up in good and t not in dull and r["tag"] in _CONTAINERS and remains[t] > 0 and own[up] <= BESIDE * remains[up] and remains[t] >= MOST * least * r["whole"] and rival <= RIVAL * remains[t]:
            good.add(t)
    return sorted(good - {0}), sorted(dull), sorted(fixed)


def main_text(page: str, good: frozenset[int] = frozenset(), dull: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text in page order."""
    elements, blocks = read(page)
    stated = [None] * len(elements)  # nearest article or main element around, itself included
    depth, slot, deepest = [0] * len(elements), 0, 0
    tops: list[int] = []
    for i, e in enumerate(elements[1:], 1):
        stated[i] = i if e.tag in ("article", "main") else stated[e.up]
        if stated[i] == i and stated[e.up] is None:
            tops.append(i)
        if e.token in good:
            depth[i] = depth[e.up] + 1
            if depth[i] > deepest:
                slot, deepest = i, depth[i]
    if stated[slot] is not None:
        taken = [stated[slot]]
    else:
        taken = [i for i in tops if elements[slot].first <= elements[i].first and elements[i].end <= elements[slot].end and elements[i].end > elements[i].first] or [slot]
    out: list[str] = []
    lost = [False] * len(elements)  # in an element left out
    for i, e in enumerate(elements):
        lost[i] = i > 0 and stated[i] is None and (lost[e.up] or e.token in dull)
    for i in taken:
        for text, at in blocks[elements[i].first : elements[i].end]:
            if stated[at] is not None or not (lost[at] or (fixed and _block_token(elements[at].token, text) in fixed)):
                out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ("page_id", "url"), salt: int = 64) -> DataFrame:
    """`keep` and text for each row. Templates are broadcast up to a bound of their counted longs; beyond it they are
    joined by host and one of `salt` numbers, so that a hot host's pages are dealt over as many tasks."""
    host = F.xxhash64(host_of(F.coalesce(F.col(url_col), F.lit(""))))
    base = pages.select(*keep, host.alias("__host"), F.col(html_col).alias("__html"))
    seen = stored(tokens(base.select("__host", "__html")), "html-tokens")
    whole = seen.filter("token = 0").select("host", F.col("pages").alias("all"))
    often = seen.join(whole, "host").filter(F.col("pages") * 100 >= HUNDREDTHS * F.col("all"))
    row = F.struct(*[c for c in _COLUMNS if c != "host"])
    by_host = often.groupBy("host").agg(F.collect_list(row).alias("rows"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template(rows) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in range(3))], ["__host", "__good", "__dull", "__fixed"])

    known = stored(by_host.mapInArrow(judged, "__host long, __good array<long>, __dull array<long>, __fixed array<long>"), "html-templates")
    longs = known.agg(F.sum(2 + F.size("__good") + F.size("__dull") + F.size("__fixed"))).first()[0] or 0
    on = ["__host"]
    if longs <= BROADCAST_LONGS:
        known = F.broadcast(known)
    else:
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        base = base.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(salt)).cast("int"))
        on = ["__host", "__salt"]
    joined = base.join(known, on, "left").select(*keep, "__html", "__good", "__dull", "__fixed")
    fields = [f for f in joined.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, *sets = (batch.column(batch.schema.get_field_index(c)) for c in ("__html", "__good", "__dull", "__fixed"))
            memo: dict[bytes, frozenset[int]] = {}

            def told(values: pa.Array) -> frozenset[int]:
                if not values.is_valid:
                    return frozenset()
                found = values.values.to_numpy()
                if (known := memo.get(key := found.tobytes())) is None:
                    known = memo[key] = frozenset(found.tolist())
                return known

            texts = [main_text(p.as_py() or "", *map(told, s)) for p, *s in zip(page, *sets, strict=True)]
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(texts, pa.string())], [*names, "text"])

    return joined.mapInArrow(work, schema)


def report(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.length("text").cast("long"))
