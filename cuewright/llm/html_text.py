"""Main text of web pages: structure first, and a host's repeated runs by suffix arrays.

A page is cut into blocks at block-level marks. Blocks in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments go by structure. What is left is weighed by
text mass: the outermost articles and main parts, and what stands outside of them; the heaviest makes the page's text, so
a teaser in an article mark doesn't stand for a story in a plain division.

Names and marks only propose. What a host repeats decides on the rest, on every page: in an article the blocks of lesser
divisions with a class or id of their own, which is where a template puts its parts, and on a page without one all blocks. A block
mostly covered by runs of RUN or more tokens that stand in MIN_PAGES distinct pages of the
host is boilerplate; unique runs stay. Paragraphs, headings and quotes that stand in the article's own flow are never judged by
repetition, since articles of one host quote the same passages.

The runs come from suffix arrays. A host's token streams may be larger than a task, so they are
cut into stretches: all runs of RUN tokens whose least GRAM-gram hash is at one place form one
stretch, and stretches go to the task of that hash. Equal runs have equal least hashes, so every
copy of a run meets in one task, whatever the host's size, and only RUN - 1 tokens of overlap are
sent twice. There the stretches are joined to one stream, sorted as a suffix array, and the
intervals of common prefixes (LCP) with enough distinct pages are the repeated runs.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions

RUN = 8
GRAM = 3
COVER = 0.5
MIN_PAGES = 3
#: Different stretches that a task holds before it sends them on.
HOLD = 100_000

# fixed values: element and name lists of HTML
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROP = frozenset("aside audio button canvas datalist dialog footer form head header iframe input map menu nav noscript object option script select style svg template textarea title video".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())

#: Words that may stand beside one of NAMES in a class or id without giving it another meaning.
BESIDE = frozenset("article articles button buttons count feed form icon icons news optin reader readers stories story thread threads user users area bar block body bottom box container content desktop element foot global group head inline inner item items layout left link links list main mobile module outer page panel posts post primary region right row secondary section site slot small sticky top unit wrap wrapper".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
PART = re.compile(r"[^a-z0-9]+")
SIZE = re.compile(r"v?\d+(?:x\d+)?")
#: Divisions that can be a template's part of an article, if they have a class or id.
DIVISIONS = frozenset("center dd details dialog div dl dt fieldset ol section table ul".split())
OWN = re.compile(r"(?:^|[\s\"'])(?:class|id)\s*=\s*[\"']?[^\s\"'>]", re.I)
#: What stands outside all articles is the page's text if it is so many times as heavy as the heaviest.
OUTSIDE = 3


def _named(value: str, inside: bool) -> bool:
    """Whether one class or id names an unwanted part: some word of NAMES, and nothing that means another."""
    parts = [x for x in PART.split(value) if x]
    hit = [x for x in parts if x in NAMES and not (inside and x == "header")]
    return bool(hit) and all(x in NAMES or x in BESIDE or SIZE.fullmatch(x) for x in parts)


def _unwanted(name: str, attrs: str, inside: bool) -> bool:
    if name in DROP:
        return not (inside and name == "header")
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in ("html", "body", "main") and any(_named(v, inside) for v in value.split()):
            return True
    return False


class _Open:
    """The open containers: (name, unwanted, box, part, muted inline), with counts by name.

    ``box`` numbers the outermost article or main part, ``part`` the nearest division with a class or id in it; 0 is none.
    """

    def __init__(self):
        self.stack: list[tuple[str, bool, int, int, bool]] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str, bad: bool, box: int, part: int, muted: bool = False):
        self.stack.append((name, bad, box, part, muted))
        self.count[name] += 1

    def close(self, name: str) -> bool:
        """Closes the nearest ``name`` and all in it; a mark that closes nothing is ignored."""
        if not self.count[name]:
            return False
        while True:
            top = self.stack.pop()[0]
            self.count[top] -= 1
            if top == name:
                return True

    @property
    def top(self) -> tuple[str, bool, int, int, bool]:
        return self.stack[-1] if self.stack else ("", False, 0, 0, False)


Block = tuple[str, bool, int, int]


class Page(list[Block]):
    """A page's blocks; ``up`` has for every part the one around it (0: none), numbered from outside in."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.how: list[int] | None = None  # what settle found


def blocks(page: str | None) -> Page:
    """(text, unwanted, box, part) of the non-empty blocks of a whole page, in order.

    References are decoded, white space is one space, marks and comments give nothing. Unwanted
    inline parts leave their block whole. Unclosed and misplaced marks end with the nearest open
    container; any nesting takes linear time. Null and empty pages have no blocks.
    """
    page = page or ""
    out = Page()
    at_ = _Open()
    text: list[str] = []
    at = numbers = 0

    def flush():
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if t:
                _, bad, box, part, _ = at_.top
                out.append((t, bad, box, part))

    while at < len(page):
        lt = page.find("<", at)
        muted = at_.top[4]
        if lt != at and not muted:
            text.append(page[at : lt if lt >= 0 else len(page)])
        if lt < 0:
            break
        m = TAG.match(page, lt)
        if not m:  # a lone mark is text
            if not muted:
                text.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCK and name not in DROP:
            # inline: an unwanted one mutes its text, within it inner ones of its name are counted too
            if m[1]:
                at_.close(name)
            elif name not in VOID and not m[0].endswith("/>"):
                if muted and at_.top[0] == name or m[3] and _unwanted(name, m[3], at_.top[2] > 0):
                    _, bad, box, part, _ = at_.top
                    at_.push(name, bad, box, part, True)
            continue
        if name in RAW and not m[1] and not m[0].rstrip(">").endswith("/"):
            # its content is no text; one that stands inside a block is cut out of it
            end = ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        flush()
        if m[1]:
            at_.close(name)
            continue
        if at_.count["p"]:
            at_.close("p")
        if name in VOID or name in DROP and m[0].endswith("/>"):
            continue
        _, bad, box, part, muted = at_.top
        # a block in a muted inline part is unwanted as a whole
        bad = bad or muted or _unwanted(name, m[3], box > 0)
        numbers += 1
        if not box and name in ("article", "main"):
            box = numbers
        elif box and name in DIVISIONS and OWN.search(m[3]):
            out.up[numbers] = part
            part = numbers
        at_.push(name, bad, box, part)
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes of ``tokens`` sorted by prefix doubling, and each one's common prefix with the one before."""
    n = len(tokens)
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < n and n and rank.max() < n - 1:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:-depth] = rank[depth:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, dtype=np.int64)
    a, b, live = order[:-1], order[1:], np.arange(1, n)
    for d in range(n):
        ok = (a + d < n) & (b + d < n)
        ok[ok] = tokens[a[ok] + d] == tokens[b[ok] + d]
        a, b, live = a[ok], b[ok], live[ok]
        if not len(live):
            break
        lcp[live] = d + 1
    return order, lcp


def repeated_starts(tokens: np.ndarray, part: np.ndarray, page: np.ndarray, run: int, min_pages: int) -> np.ndarray:
    """Starts of runs of at least ``run`` tokens that stand in ``min_pages`` distinct pages.

    ``tokens`` joins parts of pages; ``part`` and ``page`` number the part and page of each token.
    A run lies in one part. Intervals of the suffix array whose common prefix is ``run`` or longer
    are the repeated runs with all their extensions.
    """
    if len(tokens) < run:
        return np.zeros(0, dtype=np.int64)
    # a mark of its own after each part ends every common prefix there
    last = np.flatnonzero(np.r_[part[1:] != part[:-1], True])
    place = np.arange(len(tokens)) + np.searchsorted(last, np.arange(len(tokens)))
    stream = -1 - np.arange(len(tokens) + len(last), dtype=np.int64)
    stream[place] = tokens
    back = np.full(len(stream), -1, dtype=np.int64)
    back[place] = np.arange(len(tokens))
    order, lcp = suffix_array(stream)
    group = np.cumsum(lcp < run) - 1
    at = back[order]
    long = (np.bincount(group)[group] >= min_pages) & (at >= 0)
    at, group = at[long], group[long]
    pages = np.unique(np.c_[group, page[at]], axis=0)[:, 0]
    count = np.bincount(pages, minlength=int(group.max()) + 1 if len(group) else 1)
    return np.sort(at[count[group] >= min_pages])


def repeated(tokens: np.ndarray, page: np.ndarray, run: int, min_pages: int) -> np.ndarray:
    """True for tokens inside a run of ``run`` tokens of one page that stands in ``min_pages`` pages."""
    return covered_by(repeated_starts(tokens, page, page, run, min_pages), len(tokens), run)


def covered_by(hit: np.ndarray, n: int, run: int) -> np.ndarray:
    """True for the tokens of a stream of ``n`` inside a run that starts at ``hit``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + run, -1)
    return np.cumsum(edge[:-1]) > 0


def stretches(tokens: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """(start, end, least hash): tokens [start, end) hold neighbouring runs with one least GRAM-gram."""
    n = len(tokens) - run + 1
    if n < 1:
        return []
    gram = min(GRAM, run)
    g = len(tokens) - gram + 1
    h = np.zeros(g, dtype=np.uint64)
    for k in range(gram):
        h = (h ^ tokens[k : k + g].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    least, where = h[:n].copy(), np.arange(n)
    for k in range(1, run - gram + 1):
        lower = h[k : k + n] < least
        least[lower], where[lower] = h[k : k + n][lower], np.flatnonzero(lower) + k
    cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    ends = np.r_[cut[1:], n] + run - 1
    return list(zip(cut.tolist(), ends.tolist(), least[cut].view(np.int64).tolist()))


KEEP, JUDGE, LEAVE = 0, 1, 2


def settle(page: Page) -> list[int]:
    """Per block whether it is text (KEEP), isn't (LEAVE), or is for the host's runs to judge (JUDGE): it stands outside of
    articles, or in a division that holds less than half of its article's text."""
    if page.how is not None:
        return page.how
    mass: Counter[int] = Counter()
    within: Counter[int] = Counter()
    home: dict[int, int] = {}
    for t, bad, box, part in page:
        if not bad:
            mass[box] += len(t)
            within[part] += len(t)
        home[part] = box
    for part in sorted(page.up, reverse=True):
        within[page.up[part]] += within[part]
        home.setdefault(page.up[part], home.get(part, 0))
    minor = {0: False}
    for part in sorted(page.up):
        minor[part] = minor[page.up[part]] or 2 * within[part] < mass[home.get(part, 0)]
    best = max((n for b, n in mass.items() if b), default=0)
    boxes = {b for b, n in mass.items() if b and 2 * n >= best} if best and mass[0] <= OUTSIDE * best else {0}
    page.how = [LEAVE if bad or box not in boxes else JUDGE if not box or minor[part] else KEEP for _, bad, box, part in page]
    return page.how


def stream_of(parts: Page, host: int) -> np.ndarray:
    """Token hashes of all blocks but the kept ones, seeded by the host, so equal runs of two hosts never meet."""
    words = [w for (t, *_), how in zip(parts, settle(parts)) if how != KEEP for w in t.split()]
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), host) & 0xFFFFFFFF for w in words], dtype=np.uint32)


def wanted_blocks(parts: Page) -> list[tuple[str, int, int]]:
    """(text, first token in the stream, tokens) of the blocks that may be text; a kept one has no token."""
    out, at = [], 0
    for (t, *_), how in zip(parts, settle(parts)):
        n = 0 if how == KEEP else t.count(" ") + 1
        if how != LEAVE:
            out.append((t, at, n))
        at += n
    return out


def is_open(parts: Page) -> bool:
    """Whether some block of the page is for the runs to judge."""
    return JUDGE in settle(parts)


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


def _judged(batches, run: int, min_pages: int):
    """Per stretch the places (a bit each) where repeated runs start; rows come sorted by host, shard and stretch.

    Of equal stretches ``min_pages`` distinct pages are enough to count, so a hot one stays small.
    Whole (host, shard) groups are judged; the open one is carried to the next batch.
    """
    rest = None
    for b in batches_and_end(batches):
        if b is not None:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest = rest.drop_duplicates(["host", "shard", "tokens", "key"])
            rest = rest[rest.groupby(["host", "shard", "tokens"], sort=False).cumcount() < min_pages]
        if rest is None or not len(rest):
            continue
        host, shard = rest["host"].to_numpy(), rest["shard"].to_numpy()
        done = np.ones(len(rest), bool) if b is None else (host != host[-1]) | (shard != shard[-1])
        part, rest = rest[done], rest[~done]
        if len(part):
            raw = part["tokens"].tolist()
            size = np.array([len(t) // 4 for t in raw], dtype=np.int64)
            tokens = np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(raw)), size)
            page = np.unique(part["key"].to_numpy(), return_inverse=True)[1]
            hit = repeated_starts(tokens, owner, page[owner], run, min_pages)
            if len(hit):
                at = hit - (np.cumsum(size) - size)[owner[hit]]
                bits = np.zeros(len(raw), dtype=np.int64)
                np.bitwise_or.at(bits, owner[hit], np.int64(1) << at)
                some = np.flatnonzero(bits)
                ids = [stretch_id(raw[i]) for i in some]
                yield pd.DataFrame({"stretch": ids, "starts": bits[some]}).drop_duplicates("stretch")


def batches_and_end(batches):
    yield from batches
    yield None


def stretch_id(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64))


def boilerplate(pages: DataFrame, url_col: str = "url", html_col: str = "html", run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (key, at): for pages with blocks to judge, by page key, where runs start that repeat on their host."""
    src = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), page_key(url_col, html_col).alias("key"), F.col(html_col).cast("string").alias("html"))

    def cut(batches):
        seen: dict[tuple[int, bytes], tuple[int, set[int]]] = {}

        def sent():
            rows = [(host, shard, raw, k) for (host, raw), (shard, keys) in seen.items() for k in keys]
            seen.clear()
            return pd.DataFrame(rows, columns=["host", "shard", "tokens", "key"])

        for b in batches:
            for host, key, page in zip(b["host"].tolist(), b["key"].tolist(), b["html"]):
                tok = stream_of(blocks(page), host & 0xFFFFFFFFFFFFFFFF)
                for a, z, shard in stretches(tok, run):
                    keys = seen.setdefault((host, tok[a:z].tobytes()), (shard, set()))[1]
                    if len(keys) < min_pages:
                        keys.add(key)
                if len(seen) >= HOLD:
                    yield sent()
        if seen:
            yield sent()

    def placed(batches):
        for b in batches:
            ids, keys, at = [], [], []
            for host, key, page in zip(b["host"].tolist(), b["key"].tolist(), b["html"]):
                parts = blocks(page)
                if is_open(parts):
                    tok = stream_of(parts, host & 0xFFFFFFFFFFFFFFFF)
                    for a, z, _ in stretches(tok, run):
                        ids.append(stretch_id(tok[a:z].tobytes()))
                        keys.append(key)
                        at.append(a)
            yield pd.DataFrame({"stretch": ids, "key": keys, "at": at}, dtype="int64")

    sent = src.mapInPandas(cut, "host long, shard long, tokens binary, key long").repartition(partitions(pages.sparkSession), "host", "shard")
    judge = lambda batches: _judged(batches, run, min_pages)
    found = sent.sortWithinPartitions("host", "shard", "tokens").mapInPandas(judge, "stretch long, starts long")
    hits = src.mapInPandas(placed, "stretch long, key long, at long").distinct().join(found, "stretch")
    return hits.groupBy("key").agg(F.collect_list(F.struct("at", "starts")).alias("at"))


def page_key(url_col: str, html_col: str):
    """A page's host and content: copies on one host are one page."""
    return F.xxhash64(host_of(F.col(url_col)), F.coalesce(F.col(html_col), F.lit("")))


def kept_blocks(text: list[str], first: list[int], n: list[int], at, run: int = RUN) -> str:
    """The blocks of a page that may be text and that no repeated runs mostly cover; those without tokens aren't judged."""
    size = max([a + k for a, k in zip(first, n)], default=0)
    hit = [x["at"] + j for x in (at if at is not None else ()) for j in range(64) if x["starts"] >> j & 1]
    cover = np.r_[0, np.cumsum(covered_by(np.array([h for h in hit if h < size], dtype=np.int64), size + run, run))] if hit else None
    return "\n\n".join(t for t, a, k in zip(text, first, n) if cover is None or not k or cover[a + k] - cover[a] < COVER * k)


def settled_text(parts: Page) -> str:
    """The text by structure alone: what may be text, whether or not a host repeats it."""
    return "\n\n".join(t for (t, *_), how in zip(parts, settle(parts)) if how != LEAVE)


def main_text(page: str | None) -> str:
    return settled_text(blocks(page))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` for its html column, one row per input row.

    Null and empty pages give an empty text. Repeated rows are judged alike. Columns named text
    or n_chars are replaced. An empty table gives an empty one. Html columns stay out of the result.
    Pages without a block to judge are read in place; the others meet their host's runs.
    """
    runs = boilerplate(pages, url_col, html_col)
    rest = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    key, parsed, starts = (fresh(c, pages.columns) for c in ("__key", "__parsed", "__at"))

    @F.pandas_udf("struct<text:string,open:boolean,blocks:array<string>,first:array<int>,n:array<int>>")
    def parse(h: pd.Series) -> pd.DataFrame:
        rows = []
        for page in h:
            parts = blocks(page)
            wanted = wanted_blocks(parts) if is_open(parts) else []
            rows.append((None, True, *map(list, zip(*wanted))) if wanted else (settled_text(parts), False, None, None, None))
        return pd.DataFrame(rows, columns=["text", "open", "blocks", "first", "n"])

    parse = parse.asNondeterministic()  # read once: not repeated in the filter above it

    @F.pandas_udf("string")
    def keep(text: pd.Series, first: pd.Series, n: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([kept_blocks(list(t), list(f), list(k), a) for t, f, k, a in zip(text, first, n, at)], dtype=object)

    x = pages.select(*rest, page_key(url_col, html_col).alias(key), parse(F.col(html_col).cast("string")).alias(parsed))
    settled = x.where(~F.col(f"{parsed}.open")).select(*rest, F.col(f"{parsed}.text").alias("text"))
    doubtful = x.where(F.col(f"{parsed}.open")).join(runs.withColumnsRenamed({"key": key, "at": starts}), key, "left")
    judged = doubtful.select(*rest, keep(f"{parsed}.blocks", f"{parsed}.first", f"{parsed}.n", starts).alias("text"))
    return settled.unionByName(judged).withColumn("n_chars", F.length("text").cast("long"))
