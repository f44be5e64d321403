"""Blocks that markup leaves open: beside an article, or made of links alone, they are judged by the host's repeats."""

import random
from collections import defaultdict

from tideline.llm import html_extraction as html


def texts(spark, pages):
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert len(found) == len(pages)
    return {x.page_id: x.text for x in found}


def test_links_are_no_menu_by_themselves(spark):
    offer = "<p><a href='/o'>See what we offer all day long</a></p>"
    pages = [(i, f"http://h.example/{i}", f"{offer}<h1><a href='/{i}'>Title{i} of this page</a></h1><p><a>first{i}</a> <a>second{i} words</a></p>") for i in range(4)]
    menu = "<ul><li><a>Home</a></li><li><a>News</a><dl><dt><a>Old</a></dl></ul>"
    pages += [(9, "http://alone.example/", f"{menu}<div><a>The whole text is a link</a></div><ul><li><a>One source</a></ul>"), (10, "http://alone.example/m", menu)]
    found = texts(spark, pages)
    assert [found[i] for i in range(4)] == [f"Title{i} of this page\n\nfirst{i} second{i} words" for i in range(4)]
    assert found[9] == "The whole text is a link\n\nOne source" and found[10] == ""


def test_what_stands_beside_an_article(spark):
    notice = "<div>Subscribe to our paper for a full year</div>"
    page = "<body>{0}<main><h1>Heading number{1}</h1>{0}<article><p>Body</p><p>Subscribe to our paper for a full year</p></article><p>Closing{1} words</p></main><div>After{1} all</div>{0}"
    found = texts(spark, [(i, f"http://h.example/{i}", page.format(notice, i)) for i in range(3)])
    assert found == {i: f"Heading number{i}\n\nBody\n\nSubscribe to our paper for a full year\n\nClosing{i} words\n\nAfter{i} all" for i in range(3)}


def test_only_repeated_blocks_beside_an_article(spark):
    pages = [(i, f"http://h.example/{i}", f"<div>About us and our work</div><article>own{i}</article>") for i in range(3)]
    assert texts(spark, pages) == {i: f"own{i}" for i in range(3)}


def plain(pages):
    """The same by comparing every substring of all blocks of a host."""
    read = [(i, u, html.host_of(u), html.read_blocks(h)) for i, u, h in pages]
    holds = defaultdict(set)
    sizes = lambda w: {n for n in (html.DEPTH, html.LONG) if n <= len(w)} or {len(w)}
    for _, u, host, blocks in read:
        content = "\n".join(t for r, _, t in blocks if r != html.DROPPED)
        for _, _, t in blocks:
            w = t.split()
            for n in sizes(w):
                for k in range(len(w) - n + 1):
                    holds[host, tuple(w[k : k + n])].add((u, content))
    repeated = {k for k, v in holds.items() if any(a[0] != b[0] and a[1] != b[1] for a in v for b in v)}
    out = {}
    for i, _, host, blocks in read:
        best = max(r for r, _, _ in blocks)
        own = []
        for r, _, t in blocks:
            w, marks = t.split(), {html.LONG: set()}
            for n in sizes(w):
                marks[n] = {j for k in range(len(w) - n + 1) if (host, tuple(w[k : k + n])) in repeated for j in range(k, k + n)}
            if r == best > html.OPEN:
                own.append(t)
            elif r != html.DROPPED and len(set().union(*marks.values())) < len(w):
                own.append(" ".join(x for k, x in enumerate(w) if k not in marks[html.LONG]))
        out[i] = "\n\n".join(x for x in own if x) or "\n\n".join(t for r, _, t in blocks if r != html.DROPPED)
    return out


def test_mixed_pages_against_a_plain_search(spark):
    r = random.Random(11)
    words = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    shared = [words(n) for n in (2, 4, 6, 14, 30)]
    pages = []
    for i in range(45):
        blocks = [*r.sample(shared, 3), words(r.randrange(1, 5)), f"{words(3)} {r.choice(shared)} {words(2)}", words(25)]
        r.shuffle(blocks)
        tags = [r.choice(["<p>{}</p>", "<p><a href='/x'>{}</a></p>", "<div class=ad>{}</div>", "<h2>{}</h2>"] + ["<article>{}</article>", "<main>{}</main>"] * (i % 3 > 0)) for _ in blocks]
        pages.append((i, f"http://h{i % 2}.example/{i}", "".join(t.format(b) for t, b in zip(tags, blocks, strict=True))))
    assert texts(spark, pages) == plain(pages)


def test_forgotten_words_keep_their_numbers(monkeypatch):
    blocks = ["a b c d e a", "", "b f g a", "h i"]
    whole = [x.tolist() for x in html.numbered_tokens(blocks)]
    monkeypatch.setattr(html, "WORDS_HELD", 2)
    monkeypatch.setattr(html, "NUMBERS", html.WordNumbers())
    assert [x.tolist() for x in html.numbered_tokens(blocks)] == whole and len(html.NUMBERS) <= 2
    assert whole[1:] == [[6, 0, 4, 2], [0, 6, 6, 10]] and len(set(whole[0])) == 9 and all(x % 2 for x in whole[0])


def test_the_filter_grows_with_what_is_wanted(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) AS key")
    table, bits = html.slots_of(keys)
    slots = {x.key % (1 << bits) for x in keys.collect()}
    assert bits == 15 and {i * 64 + b for i, word in enumerate(table.tolist()) for b in range(64) if word >> b & 1} == slots
