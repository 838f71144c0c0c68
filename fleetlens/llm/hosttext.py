"""Main text of web pages, by markup and by a suffix array over each host.

Markup decides first. A page is read into blocks; blocks below elements that hold menus, headers,
footers, sidebars, notices, adverts, forms or reader comments are marked, by element, role, class or
id. A class or id never marks an article or what holds one, comments and related pages apart. Where a
page has an article (or else a main element), the unmarked blocks in it are its text.
Repeats on a few pages cannot decide there: copies of an article repeat as menus do, and are text
all the same. Those on many can: the articles' words of a host form token streams of their own, and a
block of an article that is covered by substrings which stand on ``most_share`` of the host's
different articles, and on ``min_articles`` at least, is a notice without a mark, and goes. An article
that would lose half of its characters or more is a near copy of others, and stays. Suffixes are counted in two steps. First their hashes, cut to
``CELL_BITS`` bits and sorted, meet by value, so that a bit filter can tell which may stand on
``min_articles`` pages; then those that it lets through are counted by their whole hashes.

Where a page has neither, repeats decide. The blocks outside articles of all pages, marked ones
included, form one token stream per page. Its suffixes, cut at ``min_run`` tokens, are put in order
with those of all pages of the host; suffixes that agree in that many tokens on ``min_pages`` pages
or more are repeated substrings (longer ones are runs of overlapping ones). Blocks of unmarked text
that such substrings cover are boilerplate; the others are kept. A suffix counts once a page, counts
are summed before the shuffle, and only suffixes of pages without an article go back to their pages.

Copies are one page to the counts: of the pages of a host that have the same text by markup, or whose
longest unmarked block is the same, one counts. On a host with many such pages a repeat must stand on
``least_share`` of them, so that common phrases are none. Where a host has fewer than ``min_pages``
of them, nothing tells boilerplate from text, and all unmarked blocks stay.

Defined cases: a null html is an empty page; a null url is a host of its own; pages with the same
identifier are pages of their own; pages of any length are read whole; an empty table gives an empty
result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared
from fleetlens.llm.collocations import BitFilter, Mining, bit_filter, language_key, phrase_keys
from fleetlens.llm.words import ByteWords, shingles

# Elements whose content is never text of the page, then those that are marked whole.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title")
MARKED = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
# Words of a class or an id that say what a container is for.
PURPOSES = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices notification popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead
    comment comments respond disqus share sharing social related recommended newsletter subscribe subscription signup login
    pagination pager widget toolbar skip""".split()
)
# Those whose articles are not the page's.
OTHERS = {"comment", "comments", "respond", "disqus", "related", "recommended"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set(
    """address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form
    header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
# A start of one of these ends an open one of the same kind, as authors leave out the end.
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!(?:svg|math)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>)"  # these may be empty
    rf"({'|'.join(RAW)})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|\Z)", re.I)
NAME_WORD = re.compile(r"[a-z]+")
CELL_BITS = 36
CELLS_HELD = 1 << 21


def marks(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds something other than the page's text; 2: unless it holds an article."""
    if name in MARKED or (name == "header" and not in_article):
        return 1
    if not attributes or name in ("html", "body", "main"):
        return 0
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            if value in ROLES:
                return 1
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 1
        elif key == "style":
            if "display:none" in value.replace(" ", ""):
                return 1
        elif not PURPOSES.isdisjoint(words := NAME_WORD.findall(value)):
            if not OTHERS.isdisjoint(words):
                return 1
            found = 0 if name == "article" else 2
    return found


def blocks(page: str) -> list[tuple[str, bool, bool, bool]]:
    """Blocks in page order: text, in an article, in main, marked."""
    out: list[tuple[str, bool, bool, bool]] = []
    open_: list[tuple[str, int]] = []  # name, and how the element is marked
    parts: list[str] = []
    article = main = marked = heading = header = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            # In an article's own header the headings are text, the rest is not.
            out.append((text, article > 0, main > 0, marked > 0 or (header > 0 and heading == 0)))

    def count(name: str, mark: int, by: int) -> None:
        nonlocal article, main, marked, heading, header
        marked += by * (mark > 0)
        if name == "article":
            article += by
        elif name == "main":
            main += by
        elif name == "header":
            header += by
        elif name in HEADINGS:
            heading += by

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
        if m[2]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    for was in open_[i:]:
                        count(*was, -1)
                    del open_[i:]
                    break
        elif name not in EMPTY and not m[4].endswith("/"):
            if name in SELF_ENDING and open_ and open_[-1][0] == name:
                count(*open_.pop(), -1)
            element = (name, marks(name, m[4], article > 0))
            if name == "article" and not element[1] and marked and all(m != 1 for _, m in open_):
                open_[:] = [(n, 0) for n, _ in open_]
                marked = 0
            open_.append(element)
            count(*element, 1)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def main_text(page: str) -> tuple[list[str] | None, list[str], list[bool]]:
    """The blocks of text where markup tells them (else none); all other blocks and which of them are marked."""
    found = blocks(page)
    for place in (1, 2):
        if own := [b[0] for b in found if b[place] and not b[3]]:
            rest = [b for b in found if not b[place]]
            return own, [b[0] for b in rest], [True] * len(rest)
    return None, [b[0] for b in found], [b[3] for b in found]


def extract(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_run: int = 6,
    min_pages: int = 3,
    least_share: float = 0.01,
    min_articles: int = 10,
    most_share: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others, flags = [], [], []
            for page in batch.column("html"):
                own, rest, marked = main_text(page.as_py())
                texts.append(own)
                others.append(rest)
                flags.append(marked)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.list_(pa.string())),
                 pa.array(others, pa.list_(pa.string())), pa.array(flags, pa.list_(pa.bool_()))],
                names=["page_id", "url", "own", "blocks", "marked"],
            )

    parsed = rows.mapInArrow(read, "page_id long, url string, own array<string>, blocks array<string>, marked array<boolean>")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parsed = shared.written(parsed.withColumns({"host": F.coalesce(host, F.lit("")), "row": F.monotonically_increasing_id()}), "pages-read", "zstd")

    told = parsed.filter("own is not null").select("row", "page_id", "url", "own")
    told = told.join(notices(parsed, min_run, min_articles, most_share), "row", "left")
    others = F.filter("own", lambda b, i: ~F.coalesce(F.array_contains("covered", i), F.lit(False)))
    left, whole = (F.aggregate(x, F.lit(0), lambda n, b: n + F.length(b)) for x in (others, F.col("own")))
    told = told.select("page_id", "url", F.array_join(F.when(left * 2 > whole, others).otherwise(F.col("own")), " ").alias("text"))
    untold = parsed.filter("own is null").select("row", "page_id", "url", "blocks", "marked")
    kept = unique_blocks(parsed, min_run, min_pages, least_share)
    # Block numbers that repeats cover, by page; the rest of the unmarked blocks is the text.
    texts = untold.join(kept, "row", "left")
    numbered = F.transform("blocks", lambda b, i: F.struct(b.alias("b"), i.alias("i"), F.element_at("marked", i + 1).alias("m")))
    stays = F.filter(numbered, lambda x: ~x["m"] & ~F.coalesce(F.array_contains("covered", x["i"]), F.lit(False)))
    texts = texts.select("page_id", "url", F.array_join(F.transform(stays, lambda x: x["b"]), " ").alias("text"))
    return told.unionByName(texts).withColumn("n_chars", F.length("text").cast("long"))


def different_pages(parsed: DataFrame) -> DataFrame:
    """host, row: of the pages of a host with equal content, the one that counts."""
    sized = F.transform("blocks", lambda b, i: F.struct(F.when(F.element_at("marked", i + 1), -1).otherwise(F.length(b)).alias("n"), b.alias("b")))
    longest = F.array_max(sized)
    own = F.coalesce(F.array_join("own", " "), F.when(longest["n"] >= 0, longest["b"]), F.lit(""))
    content = parsed.select("host", "row", F.xxhash64(own).alias("content"))
    return content.groupBy("host", "content").agg(F.min("row").alias("row")).drop("content")


def unique_blocks(parsed: DataFrame, min_run: int, min_pages: int, least_share: float) -> DataFrame:
    """Per page without an article: the numbers of the blocks that the host's repeats cover whole."""
    pages = parsed.select("row", "host", "blocks", F.col("own").isNull().alias("untold"))
    different = shared.written(different_pages(parsed), "different-pages")
    tokens = F.flatten(F.transform("blocks", lambda b, i: F.transform(F.split(b, " "), lambda t: F.struct(t.alias("t"), i.alias("i")))))
    stream = pages.select("row", "host", "untold", tokens.alias("tokens")).filter(F.size("tokens") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("tokens") - (min_run - 1), F.lit(1)))

    def suffix(place):
        return F.array_join(F.transform(F.slice("tokens", place, min_run), lambda x: x["t"]), " ")

    counted = stream.join(different.select("row"), "row", "left_semi")
    suffixes = counted.select("host", F.explode(F.array_distinct(F.transform(places, suffix))).alias("suffix"))
    repeated = suffixes.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    # Only large hosts ask for more than min_pages.
    least = different.groupBy("host").agg(F.ceil(F.count(F.lit(1)) * F.lit(least_share)).alias("least")).filter(F.col("least") > min_pages)
    repeated = repeated.join(shared.written(least, "large-hosts"), "host", "left").filter(F.col("least").isNull() | (F.col("pages") >= F.col("least")))
    repeated = repeated.select("host", "suffix")
    repeated = shared.written(repeated, "host-repeats")
    asked = stream.filter("untold").select("row", "host", "tokens", F.explode(places).alias("place"))
    asked = asked.select("row", "host", "place", suffix(F.col("place")).alias("suffix"), F.size("tokens").alias("n"))
    found = asked.join(repeated, ["host", "suffix"])
    covers = F.sequence(F.col("place"), F.least(F.col("place") + (min_run - 1), F.col("n")))
    covered = found.select("row", F.explode(covers).alias("place")).groupBy("row").agg(F.collect_set("place").alias("places"))
    page = stream.filter("untold").join(covered, "row")
    free = F.filter(
        F.transform("tokens", lambda x, i: F.struct(x["i"].alias("i"), (i + 1).alias("p"))), lambda x: ~F.array_contains("places", x["p"])
    )
    numbers = F.transform("tokens", lambda x: x["i"])
    return page.select("row", F.array_except(F.array_distinct(numbers), F.transform(free, lambda x: x["i"])).alias("covered"))


def notices(parsed: DataFrame, min_run: int, min_articles: int, most_share: float) -> DataFrame:
    """Per page with an article: the numbers of its blocks that repeats on most articles of the host cover whole."""
    longest = F.array_max(F.transform("own", lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))["b"]
    # Articles with the same longest block are copies, exact or near, and count as one.
    articles = parsed.filter("own is not null").select("row", "host", "own", F.xxhash64("host", longest).alias("content"))
    hosts = articles.groupBy("host").agg(F.countDistinct("content").alias("n")).filter(F.col("n") >= min_articles)
    least = F.greatest(F.ceil(F.col("n") * F.lit(most_share)), F.lit(min_articles)).cast("long")
    articles = articles.join(shared.written(hosts.select("host", least.alias("least")), "hosts"), "host")
    asked = "row long, suffix long, least long, content long, block int, size int, first int, last int"
    hot = shared.written(crowded_cells(articles, min_run), "crowded-cells")
    table = articles.sparkSession.sparkContext.broadcast(bit_filter(hot, Mining()))
    key = language_key("")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = ByteWords(), BitFilter(np.frombuffer(table.value[0], np.uint8), table.value[1])
        names = [c.split()[0] for c in asked.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 4
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for row, host, own, least, content in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "own", "least", "content")), strict=True):
                suffixes, edges = article_suffixes(words, host, own, min_run)
                places = np.flatnonzero(known.has(phrase_keys(key, [suffixes >> np.uint64(64 - CELL_BITS)])))
                if not len(places):
                    continue
                hit = suffixes[places].view(np.int64)
                # All are counted; those of blocks that they may cover whole also come with their places.
                for suffix in np.unique(hit).tolist():
                    for column, value in zip(rows, (None, suffix, least, content, None, None, None, None), strict=True):
                        column.append(value)
                ends = np.minimum(places + min_run, edges[-1])
                depth = np.zeros(edges[-1] + 1, np.int64)
                np.add.at(depth, places, 1)
                np.add.at(depth, ends, -1)
                free = np.append(0, np.cumsum(np.cumsum(depth[:-1]) == 0))
                for block in np.flatnonzero(free[edges[1:]] == free[edges[:-1]]).tolist():
                    lo, hi = int(edges[block]), int(edges[block + 1])
                    for i in np.flatnonzero((places < hi) & (ends > lo)).tolist():
                        at = (max(int(places[i]), lo) - lo, min(int(ends[i]), hi) - lo - 1)
                        for column, value in zip(rows, (row, int(hit[i]), None, None, block, hi - lo, *at), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    found = shared.written(articles.mapInArrow(look_up, asked), "article-suffixes")
    repeated = found.filter("row is null").groupBy("suffix", "least").agg(F.countDistinct("content").alias("n")).filter(F.col("n") >= F.col("least"))
    covers = found.filter("row is not null").drop("least").join(repeated.select("suffix"), "suffix")
    covers = covers.select("row", "block", "size", F.explode(F.sequence("first", "last")).alias("at"))
    covered = covers.groupBy("row", "block", "size").agg(F.countDistinct("at").alias("covered")).filter(F.col("covered") == F.col("size"))
    return covered.groupBy("row").agg(F.collect_set("block").alias("covered"))


def article_suffixes(words: ByteWords, host: str, own: list[str], min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first ``min_run`` tokens of each suffix of an article, with its host; the token each block begins at, and the end."""
    ids, first = words.of_texts(own)
    return phrase_keys(language_key(host), [shingles(ids, min_run)]), first


def crowded_cells(articles: DataFrame, min_run: int) -> DataFrame:
    """lang (empty), phrase (eight bytes): the cells that may hold a suffix which stands on ``least`` different articles.

    Cells are counted apart by the power of two below ``least``, which is what they have to reach; copies that
    no task sees together count again, so that a count is never too low.
    """
    slices = shared.pieces_of_a_group(articles.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = ByteWords(), 0
        held: dict[tuple[int, int], np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for power in {p for p, _ in held}:
                cells = np.sort(np.concatenate([found for (p, _), found in held.items() if p == power]))
                number = (cells * np.uint64(slices) >> np.uint64(CELL_BITS)).astype(np.int64)
                edges = np.flatnonzero(np.append(len(cells) > 0, number[1:] != number[:-1]))
                steps = []
                for lo, hi in zip(edges.tolist(), np.append(edges, len(cells))[1:].tolist(), strict=True):
                    # The first cell, and the steps from each to the next, as many bytes as the widest has, byte by byte.
                    step = np.diff(cells[lo:hi]).astype("<u8").view(np.uint8).reshape(-1, 8)
                    width = int(np.flatnonzero(step.any(axis=0)).max(initial=0)) + 1
                    steps.append(cells[lo : lo + 1].tobytes() + bytes([width]) + np.ascontiguousarray(step[:, :width].T).tobytes())
                columns = [pa.array(number[edges]), pa.array([power] * len(steps), pa.int32()), pa.array(steps, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "power", "steps"])
            held.clear()

        for batch in batches:
            for host, own, least, content in zip(*(batch.column(c).to_pylist() for c in ("host", "own", "least", "content")), strict=True):
                cells = np.unique(article_suffixes(words, host, own, min_run)[0] >> np.uint64(64 - CELL_BITS))
                key = (least.bit_length() - 1, content)
                before = held.get(key, cells[:0])
                held[key] = np.union1d(before, cells) if len(before) else cells
                n += len(held[key]) - len(before)
                if n >= CELLS_HELD:
                    yield from rows()
                    n = 0
        yield from rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for number, power, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = raw[8]
                step = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1)
                wide = np.zeros((step.shape[1] + 1, 8), np.uint8)
                wide[1:, :width] = step.T
                wide[0] = np.frombuffer(raw, np.uint8, 8)
                found.setdefault((number, power), []).append(np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64))
        for (_, power), some in found.items():
            cells = np.sort(np.concatenate(some))
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            crowded = cells[starts[np.diff(np.append(starts, len(cells))) >= 1 << power]].astype(">u8").tobytes()
            phrases = [crowded[i : i + 8] for i in range(0, len(crowded), 8)]
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(phrases), pa.string()), pa.array(phrases, pa.binary())], names=["lang", "phrase"])

    dealt = articles.select("host", "own", "least", "content").mapInArrow(cut, "slice long, power int, steps binary").repartition("slice")
    return dealt.mapInArrow(merge, "lang string, phrase binary")
