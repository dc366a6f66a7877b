"""Main text of pages: the whole query against brute force, over many ranges, with copies, near copies, ties and hostile pages."""

import hashlib
import re

import numpy as np
import pytest
from compare import DATA

from stratalith.llm import html


def md5(blocks):
    listed = ",".join(str(i) for i, (_, site) in enumerate(blocks) if site)
    return hashlib.md5("\n".join([*(t for t, _ in blocks), listed]).encode()).hexdigest()


def expected(rows, copied=0.8):
    """text of each row, by a plain search for the nearest rows before and after with other lines."""
    cut = [html.page_blocks(r[2]) for r in rows]
    place = [re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", r[1] or "") for r in rows]
    keys = [(m[1].lower(), m[2]) if m else ("", "") for m in place]
    order = sorted({(*k, md5(lines), tuple(lines)) for k, lines in zip(keys, cut, strict=True) if k[0] and lines})
    size = lambda lines: sum(len(t) for t, site in lines if not site)
    out = []
    for k, lines in zip(keys, cut, strict=True):
        me = (*k, md5(lines), tuple(lines))
        gone = set()
        if me in order:
            at = order.index(me)
            other = lambda x: x[0] == me[0] and x[3] != me[3]
            after = next((x for x in order[at:] if x[0] != me[0] or x[3] != me[3]), None)
            last = next((x for x in order[at::-1] if x[0] != me[0] or x[3] != me[3]), None)
            common = lambda x: len([1 for i in range(min(len(x[1]), len(me[1]))) if x[1][: i + 1] == me[1][: i + 1]])
            sides = [x for x in (after, last) if x and other(x)]
            sides.sort(key=common, reverse=True)
            for x in sides:
                found = html.shared_lines([t for t, _ in lines], [t for t, _ in x[3]])
                if size(lines[i] for i in found) < copied * max(size(lines), size(x[3])):
                    gone = found
                    break
        out.append("\n\n".join(t for i, (t, site) in enumerate(lines) if i not in gone and not site))
    return out


@pytest.mark.parametrize("parts", ["2", "7"])
def test_query_against_brute_force(spark, parts):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        own = [f"own {x} of page" for x in rng.integers(0, 60, rng.integers(0, 5))]
        site = [f"site line {x}" for x in rng.integers(0, 3, rng.integers(0, 4))]
        lines = [str(x) for x in rng.permutation([*own, *site])]
        lines += ["</p><nav><p>" + site[0] + f"<p>menu {i % 7}</nav><p>"] if site else []
        rows.append((int(i), f"https://Host{rng.integers(0, 3)}.org/{'ab'[rng.integers(0, 2)]}/{rng.integers(0, 40)}?q={i}", "".join(f"<p>{x}</p>" for x in lines)))
    rows += [(i, "https://host1.org/b/copies/" + str(i % 9), "<p>one and the same text of many pages</p><p>site line 1</p>") for i in range(200, 260)] + rows[:5] + [(400, None, "<p>x</p>"), (401, "https://host1.org/", None)]
    before, width = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sorted((r["page_id"], r["text"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", width)
    assert out == sorted((r[0], t) for r, t in zip(rows, expected(rows), strict=True))


def test_registered_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    out = {r["page_id"]: r["text"] for r in html.op9_url_differencing(spark, f"{DATA}/sf0.01").collect()}
    assert out == {r[0]: t for r, t in zip(rows, expected(rows), strict=True)}


def test_neighbours_decide_the_text(spark):
    """Lines of a site stay only where no neighbour shows that they are the site's."""
    page = "<div>Every page says this</div><article><p>Own words of page {0} and more</p></article>"
    rows = [(i, f"https://h.org/{i}", page.format(i)) for i in range(3)]
    alone = [(i, f"https://h{i}.org/{i}", page.format(i)) for i in range(3)]
    for given, kept in ((rows, False), (alone, True)):
        out = html.main_text(spark.createDataFrame(given, "page_id long, url string, html string")).collect()
        assert all(("Every page" in r["text"]) == kept and "Own words" in r["text"] for r in out)


def test_near_copies_keep_their_text(spark):
    body = "".join(f"<p>paragraph {i} of a long article that was copied</p>" for i in range(12))
    rows = [(1, "https://h.org/a/1", body + "<p>first</p>"), (2, "https://h.org/a/2", body + "<p>second</p>")]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["n_deleted"] == 0 and r["text"].count("paragraph") == 12 for r in out)


#: Pages as people write them, with the text that a reader would call the article.
HAND_MADE = [
    ('<html><body><header>Daily News</header><nav><a href="/">Home</a></nav><main><h1>Rain in the north</h1><p>It rained &amp; rained.</p><ul><li>Monday: wet</li></ul></main><aside>Most read</aside><footer>Imprint</footer></body></html>', "Rain in the north\n\nIt rained & rained.\n\nMonday: wet"),
    ('<body><div class="top-nav">Home | Shop</div><div id="content"><h2>Soup</h2><p>Boil   water.<br>Add salt.</p></div><div class="comments"><p>Great!</p></div><script>var a="<p>no</p>"</script></body>', "Soup\n\nBoil water. Add salt."),
    ('<body><div role="navigation">Menu</div><article><header><h1>Title</h1></header><p>Text <b>bold</b> and <i>more</i>.</p><div class="advert">Buy</div><p>End</p></article><form><p>Subscribe</p></form></body>', "Title\n\nText bold and more.\n\nEnd"),
    ('<body><p>Unclosed <p>paragraphs <div class="cookie-notice">We use cookies</div><style>p{}</style><!-- <p>hidden</p> --><p>Last &#8212; line', "Unclosed\n\nparagraphs\n\nLast — line"),
]


def test_hand_made_pages(spark):
    rows = [(i, f"https://site{i}.org/x", page) for i, (page, _) in enumerate(HAND_MADE)]
    out = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: text for i, (_, text) in enumerate(HAND_MADE)}


def test_long_and_hostile_pages(spark):
    long = "".join(f"<p>line {i}</p>" for i in range(20_000))
    rows = [(1, "https://h/1", long), (2, "https://h/2", "<b \"'>" * 20_000), (3, "https://h/3", "<div>" * 5000 + "deep"), (4, "https://h/4", long.replace("line", "row"))]
    out = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].count("line") == 20_000 and out[3] == "deep" and out[2] == ""


def shop_pages():
    """(url, html, article lines, site lines) of hosts whose sites repeat some lines, name some blocks and make some anew."""
    rng = np.random.default_rng(11)
    out = []
    for h in range(6):
        menu, foot = [f"menu of host {h} entry {k}" for k in range(4)], f"imprint of host {h}"
        box = [f"follow host {h} on channel {k}" for k in range(3)]  # in an element that no list knows
        for i in range(12):
            own = [f"article {h} {i} sentence {k} with {rng.integers(0, 10**6)} words" for k in range(rng.integers(3, 9))]
            fresh = [f"advert {rng.integers(0, 10**9)}"]
            page = f"<ul class=top>{''.join(f'<li>{m}</li>' for m in menu)}</ul><div class=advert>{fresh[0]}</div><div>{''.join(f'<p>{t}</p>' for t in own)}</div><section><p>{'<p>'.join(box)}</section><footer>{foot}</footer>"
            out.append((f"https://shop{h}.org/{'abc'[i % 3]}/{i}", page, own, [*menu, *fresh, *box, foot]))
    return out


def test_precision_and_recall_of_both_parts(spark):
    """The differencing finds what sites repeat, named or not; the list only what they make anew, and all on lone pages."""
    made = shop_pages()
    rows = [(i, url, page) for i, (url, page, _, _) in enumerate(made)]
    alone = [(i, f"https://lone{i}.org/x", page) for i, (_, page, _, _) in enumerate(made)]
    count = lambda rs, c: sum(r[c] for r in rs)
    figures = {}
    for name, given in (("hosts", rows), ("alone", alone)):
        got = html.main_text(spark.createDataFrame(given, "page_id long, url string, html string")).collect()
        kept = {r["page_id"]: set(r["text"].split("\n\n")) for r in got}
        site, own = sum(len(m[3]) for m in made), sum(len(m[2]) for m in made)
        gone_site = sum(len(set(m[3]) - kept[i]) for i, m in enumerate(made))
        gone_own = sum(len(set(m[2]) - kept[i]) for i, m in enumerate(made))
        figures[name] = {"differencing": count(got, "n_deleted"), "list": count(got, "n_listed"), "recall": gone_site / site, "precision": gone_site / (gone_site + gone_own), "own": own}
    assert figures["hosts"]["precision"] == figures["hosts"]["recall"] == 1
    assert figures["hosts"]["differencing"] == 8 * len(made) and figures["hosts"]["list"] == len(made)
    assert figures["alone"]["differencing"] == 0 and figures["alone"]["precision"] == 1 and 0.2 < figures["alone"]["recall"] < 0.3
