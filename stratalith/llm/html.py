"""Main text of web pages by differencing with the page of the nearest URL.

A page is cut into lines (blocks of text in page order), menus and all. The pages of a host are put in the order of their
paths; each is held against the neighbour with the longer common path. Their lines are aligned by a longest common
subsequence, and shared lines are deleted, wherever they stand: what two neighbouring pages share is the site's, not the
article's. A page with the same lines is a copy and says nothing about the site, so the next one with other lines is the
neighbour; nor does a page that shares `copied` or more of the characters of both outside menus and the like, a near
copy, so the neighbour on the other side is taken then, if it is none.

After that, lines inside a menu, header, footer, sidebar, advert, form or comment section go that no neighbour showed to
be the site's: those of pages alone on their host, and those that a site makes anew for each page.

Only a hash and a length of each line are shuffled to find neighbours: distinct (host, path, lines) are put into ranges of
like size, where one pass over the sorted rows sees both neighbours. What lies at the end of a range is passed on to the
next ones, so a host may have any number of pages. The texts meet the numbers of their deleted lines in one join.

Defined cases: a null or empty html gives an empty text, and so does a page without text; pages without url, alone on
their host or only with copies and pages without text there have no neighbour and keep all lines; ties between neighbours
go to the next page; unclosed elements run to the end of their parent or page; comments, scripts and styles never give
text; tags with thousands of attributes are read up to their first >; repeated rows are pages of their own; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.shared import dealt_join, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]{0,20000}\"|'[^']{0,20000}'){0,2000}+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)", re.S
)
_NO_TEXT = frozenset("script style title noscript template textarea select option button svg iframe object canvas audio video".split())
_RAW = frozenset(["script", "style", "title", "textarea", "noscript", "iframe"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q s samp small span strike strong sub sup time tt u var wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_MARKED = frozenset(["article", "main"])
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SITE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation sidebar breadcrumb breadcrumbs "
    "cookie cookies consent notice notices popup modal overlay comment comments disqus replies footer header masthead related share sharing social newsletter subscribe pagination contentinfo complementary".split()
)

def _is_site(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _ASIDE or (tag == "header" and not in_article):
        return True
    if "=" not in attributes or tag in ("body", "html", *_MARKED):
        return False
    names = {w for v in _NAMED.findall(attributes) for w in re.split(r"[^a-z]+", v.lower())}
    return bool(names & (_SITE - {"header", "footer"} if in_article else _SITE))


def page_blocks(html: str | None) -> list[tuple[str, bool]]:
    """The lines of a page, each with whether it stands inside a menu or the like."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    marked, skipped, depth, site, open_sites, at = 0, "", 0, "", 0, 0

    def close() -> None:
        if text := " ".join(unescape("".join(parts)).split()):
            out.append((text, bool(site)))
        parts.clear()

    html = html or ""
    while m := _TOKEN.search(html, at):
        if not skipped and m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        single = tag in _VOID or attributes.endswith("/")
        if skipped:
            if tag == skipped and not single:
                depth += -1 if closing else 1
                skipped = skipped if depth else ""
            continue
        if tag not in _INLINE or tag == site:
            close()
        elif tag == "br":
            parts.append(" ")
        if site and tag == site and not single:
            open_sites += -1 if closing else 1
            site = site if open_sites else ""
        elif closing:
            marked = max(0, marked - (tag in _MARKED and not site))
        elif tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not single and tag in _NO_TEXT:
            close()
            skipped, depth = tag, 1
        elif not single and not site:
            if _is_site(tag, attributes, marked > 0):
                close()
                site, open_sites = tag, 1
            else:
                marked += tag in _MARKED
    if not skipped:
        parts.append(html[at:])
    close()
    return out


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b (bit-parallel: one long integer for each line of a)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full, rows, row = (1 << len(b)) - 1, [], (1 << len(b)) - 1
    for x in a:
        u = row & places.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    found, j = set(), len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else full
        while j >= 0 and rows[i] >> j & 1:  # b's line j adds nothing here
            j -= 1
        if j < 0:
            break
        if above >> j & 1:  # it is line i of a that makes the common part longer
            found.add(i)
            j -= 1
    return found


def _prefix(a: str | None, b: str | None) -> int:
    n = 0
    for x, y in zip(a or "", b or "", strict=False):
        if x != y:
            break
        n += 1
    return n


Page = tuple  # host, sig, path, hashes, sizes


def own_lines(page: Page, last: Page | None, following: Page | None, copied: float) -> list[int] | None:
    """Lines of page that it shares with its neighbour, None without one; last and following are of the same host or None."""
    sides = [x for x in (following, last) if x is not None]
    if len(sides) == 2 and _prefix(page[2], last[2]) > _prefix(page[2], following[2]):
        sides.reverse()
    for other in sides:
        gone = shared_lines(page[3], other[3])
        if sum(page[4][i] for i in gone) < copied * max(sum(page[4]), sum(other[4])):
            return sorted(gone)
    return None


def _searched(placed: DataFrame, copied: float) -> DataFrame:
    """Rows sorted by (host, path, sig) in ranges: kind 0 has the deleted lines, kind 1 waits for what lies beyond its range.

    Rows of kind 2 are the first and the last of each range, with the row beyond the run of copies they begin or end.
    """
    names = ["kind", "part", "host", "path", "sig", "n", "hashes", "sizes", "gone", "at_begin", "at_end", "other"]
    other = "struct<host:string,sig:string,path:string,hashes:array<bigint>,sizes:array<int>>"
    schema = f"kind int, part int, host string, path string, sig string, n long, hashes array<bigint>, sizes array<int>, gone array<int>, at_begin boolean, at_end boolean, other {other}"
    kinds = placed.sparkSession.createDataFrame([], schema).schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        part, arrow = TaskContext.get().partitionId(), to_arrow_schema(kinds)
        rows: list[tuple] = []
        before: Page | None = None  # last row of the run before the open one
        run: list[tuple[Page, int]] = []  # the open run of copies: equal host and lines
        n_runs, begin_row = 0, None

        def row(kind: int, page: Page, n: int, gone=None, at_begin=False, at_end=False, beyond: Page | None = None) -> tuple:
            wide = kind == 1 or kind == 2
            return (kind, part, page[0], page[2], page[1], n, page[3] if wide else None, page[4] if wide else None, gone, at_begin, at_end, None if beyond is None else dict(zip(("host", "sig", "path", "hashes", "sizes"), beyond, strict=True)))

        def same_host(a: Page | None, b: Page) -> Page | None:
            return a if a is not None and a[0] == b[0] else None

        def close(after: Page | None, at_end: bool) -> None:
            at_begin = n_runs == 1
            for page, n in run:
                if at_begin or at_end:
                    known = after if at_begin and not at_end else before if at_end and not at_begin else None
                    rows.append(row(1, page, n, None, at_begin, at_end, known))
                else:
                    rows.append(row(0, page, n, own_lines(page, same_host(before, page), same_host(after, page), copied)))
            if at_begin:
                rows.append(row(2, run[0][0], 0, None, True, at_end, after))
            if at_end:
                rows.append(row(2, run[-1][0], 0, None, at_begin and False, True, before))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(names))], names=names)
            rows.clear()
            return out

        for b in batches:
            for r in b.to_pylist():
                page = (r["host"], r["sig"], r["path"], r["hashes"], r["sizes"])
                if run and run[0][0][:2] != page[:2]:
                    close(page, False)
                    before, run = run[-1][0], []
                if not run:
                    n_runs += 1
                run.append((page if not run else (*page[:3], *run[0][0][3:]), r["n"]))
                if len(rows) >= 512:
                    yield batch()
        if run:
            close(None, True)
            yield batch()

    return placed.mapInArrow(search, schema)


def _beyond(edges: list) -> dict[tuple[int, str], Page]:
    """(range, side) -> the nearest row outside the range with other lines; from the two end rows of each range."""
    page = lambda r: (r["host"], r["sig"], r["path"], r["hashes"], r["sizes"])
    first, end = {r["part"]: r for r in edges if r["at_begin"]}, {r["part"]: r for r in edges if not r["at_begin"]}
    out, parts = {}, sorted(first)
    for side, mine, far, order in (("last", first, end, parts), ("next", end, first, parts[::-1])):
        for i, p in enumerate(order):
            for q in reversed(order[:i]):  # a run of copies may cover whole ranges
                other = far[q] if page(far[q])[:2] != page(mine[p])[:2] else far[q]["other"]
                if other is not None:
                    out[p, side] = page(other)
                    break
    return out


def deleted_lines(described: DataFrame, copied: float) -> DataFrame:
    """(host, path, sig, n, gone) of distinct pages with lines to delete; described has host, path, sig, n, hashes, sizes."""
    key = ["host", "path", "sig"]
    found = written(_searched(described.repartitionByRange(*key).sortWithinPartitions(*key), copied))
    edges = found.filter("kind = 2").collect()
    sent = described.sparkSession.sparkContext.broadcast(_beyond(edges))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for r in b.to_pylist():
                page = (r["host"], r["sig"], r["path"], r["hashes"], r["sizes"])
                known = tuple(r["other"].values()) if r["other"] else None
                last = sent.value.get((r["part"], "last")) if r["at_begin"] else known
                after = sent.value.get((r["part"], "next")) if r["at_end"] else known
                gone.append(own_lines(page, *(x if x is not None and x[0] == page[0] else None for x in (last, after)), copied))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in (*key, "n")), pa.array(gone, pa.list_(pa.int32()))], names=[*key, "n", "gone"])

    waiting = found.filter("kind = 1").mapInArrow(resolve, "host string, path string, sig string, n long, gone array<int>")
    return found.filter("kind = 0").select(*key, "n", "gone").unionByName(waiting).filter("size(gone) > 0")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", copied: float = 0.8) -> DataFrame:
    """page_id, url, text, n_lines, n_deleted (shared with the neighbour), n_listed (inside menus and the like, not shared)."""
    given = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):  # a few pages at a time
                part = b.slice(i, 64)
                blocks = [page_blocks(x) for x in part.column(2).to_pylist()]
                texts = pa.array(["\n".join(t for t, _ in x) for x in blocks], pa.string())
                listed = pa.array([[n for n, (_, site) in enumerate(x) if site] for x in blocks], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, listed], names=["page_id", "url", "lines", "listed"])

    url_part = lambda group: F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", group), F.lit(""))
    lined = given.mapInArrow(cut, f"page_id {dict(given.dtypes)['page_id']}, url string, lines string, listed array<int>")
    sig = F.md5(F.concat_ws("\n", "lines", F.array_join("listed", ",")))
    keyed = lined.withColumns({"host": F.lower(url_part(1)), "path": url_part(2), "sig": sig})
    each = F.split("lines", "\n")
    sizes = F.transform(each, lambda x, i: F.when(F.array_contains("listed", i), 0).otherwise(F.length(x)))
    shape = [F.transform(each, lambda x: F.xxhash64(x)).alias("hashes"), sizes.alias("sizes")]
    shapes = keyed.filter("host <> '' AND lines <> ''").select("host", "path", "sig", *shape)
    distinct = shapes.groupBy("host", "path", "sig").agg(F.count(F.lit(1)).alias("n"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))
    return _without(keyed, deleted_lines(written(distinct), copied))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The pages' texts without their deleted lines, and without those inside menus and the like that the neighbour did not show."""
    joined = dealt_join(keyed, written(gone), ["host", "path", "sig"], "n", ["page_id"])
    lines = F.when(F.col("lines") == "", F.array().cast("array<string>")).otherwise(F.split("lines", "\n"))
    none = F.array().cast("array<int>")
    cut = joined.withColumns({"gone": F.coalesce("gone", none), "lines": lines}).withColumn("listed", F.array_except("listed", "gone"))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i) & ~F.array_contains("listed", i))
    count = lambda c: F.size(c).cast("long")
    return cut.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"), count(kept).alias("n_lines"), count("gone").alias("n_deleted"), count("listed").alias("n_listed"))


def op9_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_deleted", "n_listed")


SQL: dict[str, str] = {}
QUERIES = {"op9_url_differencing": op9_url_differencing}
