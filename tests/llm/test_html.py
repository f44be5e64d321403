"""Pages with awkward attributes and tags, and repeats against a plain search for them."""

import random
from collections import defaultdict

from tideline.llm import html_extraction as html


def kept(page):
    return [t for r, _, t in html.read_blocks(page) if r == html.ARTICLE]


def test_attribute_values_of_any_length():
    for n in (4000, 4001, 300_000):
        for quote in "\"'":
            page = f"<nav data-x={quote}{'<b>' * (n // 3)}{'x' * (n % 3)}{quote}>menu</nav><article data-y={quote}{'y>' * n}{quote}><p>Text</p></article>"
            assert [(r, t) for r, _, t in html.read_blocks(page)] == [(html.DROPPED, "menu"), (html.ARTICLE, "Text")]


def test_attribute_names_are_read_exactly():
    for other in ('title="A hidden gem"', 'data-id="footer"', 'data-role="navigation"', "data-state='hidden now'", 'data-class="ad"', 'alt="class=ad"', 'title="x style=display:none y"'):
        assert kept(f"<article><p {other}>Text</p> <a {other}>link</a></article>") == ["Text", "link"], other
    for gone in ('class="ad"', "ID=sidebar", 'data-x="1"class="promo"', "hidden", "role = 'navigation'", 'style="color:red;display : none"', "aria-hidden=true"):
        assert kept(f"<article><p>Text</p><div {gone}>no</div></article>") == ["Text"], gone


def test_class_words_inside_an_article():
    for own in ('<p class="share">Text</p>', '<blockquote class="related">Text</blockquote>', '<section id="comments-on-law"><p>Text</p></section>', '<div class="social-history">Text</div>', '<h2 id="menu">Text</h2>', '<ul class="ad-hoc"><li class="reply">Text</li></ul>', '<div><span class="ad">Text</span></div>'):
        assert kept(f"<article><p>First</p>{own}</article>") == ["First", "Text"], own
    for gone in ('<div class="x comments">no</div>', '<section id="related"><p>no</p></section>', '<ul class="share">no</ul>', "<aside>no</aside>", '<p role="alert">no</p>', '<article class="comment"><p>no</p></article>'):
        assert kept(f"<article><p>First</p>{gone}</article>") == ["First"], gone
    assert [r for r, _, _ in html.read_blocks('<p class="site-menu">no</p>')] == [html.DROPPED]


def test_tags_without_their_ends():
    assert kept("<head><title>t</title><body><article><p>Text</article>") == ["Text"]
    assert kept("<body><noscript><article><p>Text</p></article>") == ["Text"]
    assert kept("<article><p>Text</p><noscript><p>no</p></noscript><svg><text>no</text></svg><p>More</p></article>") == ["Text", "More"]
    assert kept("<article><p>Text</p></article><script>if (a < b) {'</p>'}") == ["Text"]


def plain(pages):
    """The same judgement by comparing every substring of a page's open blocks with all other pages of the host."""
    read = [(i, u, html.host_of(u), html.read_blocks(h or "")) for i, u, h in pages]
    holds = defaultdict(set)
    for i, u, host, blocks in read:
        content = "\n".join(t for r, _, t in blocks if r != html.DROPPED)
        for _, _, t in blocks:
            w = t.lower().split()
            for n in {html.DEPTH, html.LONG, len(w) if len(w) < html.DEPTH else html.DEPTH}:
                if n <= len(w) and (n >= html.DEPTH or n == len(w)):
                    for k in range(len(w) - n + 1):
                        holds[host, tuple(w[k : k + n])].add((u or f"#{i}", content))
    repeated = {k for k, v in holds.items() if any(a[0] != b[0] and a[1] != b[1] for a in v for b in v)}
    out = {}
    for i, _, host, blocks in read:
        best = max((b[0] for b in blocks), default=0)
        own = [t for r, link, t in blocks if r == best and best and not (r == html.OPEN and link)]
        if best == html.OPEN:
            left = []
            for t in own:
                w, short, long = t.split(), set(), set()
                low = [x.lower() for x in w]
                for n, marks in ((min(html.DEPTH, len(w)), short), (html.LONG, long)):
                    for k in range(len(w) - n + 1):
                        if (host, tuple(low[k : k + n])) in repeated:
                            marks |= set(range(k, k + n))
                short |= long
                if len(short) < len(w):
                    left.append(" ".join(x for k, x in enumerate(w) if k not in long))
            own = [x for x in left if x] or own
        out[i] = "\n\n".join(own)
    return out


def test_repeats_against_a_plain_search(spark):
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    notice, menu, short = words(25), words(7), "Share this page"
    pages = []
    for i in range(40):
        parts = [menu, short, f"Hi {words(r.randrange(1, 4))}, {notice} {words(r.randrange(4))}", words(30), " ".join(notice.split()[: r.randrange(4, 25)]) + " " + words(5)]
        r.shuffle(parts)
        body = "".join(f"<p>{p}</p>" for p in parts) if i % 5 else f"<article>{notice} {words(9)}</article><div>{menu}</div>"
        pages.append((i, f"http://h{i % 3}.example/{i}", body))
    pages += [(40, pages[1][1], pages[1][2] + "<p>x</p>"), (41, "http://h1.example/copy", pages[1][2]), (42, None, "<p>alone here</p>"), (43, "http://h1.example/n", f"<p>{menu}</p>"), (44, "u", None)]
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()
    assert len(found) == len(pages) and {x.page_id: x.text for x in found} == plain(pages)
    first = next(x for x in found if x.page_id == 4)
    assert not first.by_markup and short not in first.text and menu not in first.text and "Hi " in first.text and notice not in first.text


def test_few_slots_change_nothing(spark, monkeypatch):
    pages = [(i, f"http://h.example/{i}", f"<p>one two three four five six</p><p>own{i} text{i} here{i}</p>") for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    monkeypatch.setattr(html, "FILTER_BITS", 1)
    assert {x.page_id: x.text for x in html.extract(df).collect()} == {i: f"own{i} text{i} here{i}" for i in range(5)}
