"""Runs of the sorted suffixes against a plain count of every beginning, whole and cut into batches."""

import random
from collections import defaultdict

import numpy as np

from tideline.llm import html_extraction as html


def suffix_rows(pages):
    """Sorted distinct suffixes of all pages with their state, and the beginnings that two distinct pages share."""
    rows, holds = {}, defaultdict(set)
    for address, content, host, texts in pages:
        flat, sizes, starts = html.numbered_tokens(texts)
        key, block, at, _ = html.windows(host, flat, sizes, starts)
        for k in key.tolist():
            holds[k].add((address, content))
        for row in html.suffixes(host, flat, sizes, starts, block, at).tolist():
            s = rows.setdefault(tuple(row), [address, address, content, content])
            rows[tuple(row)] = [min(s[0], address), max(s[1], address), min(s[2], content), max(s[3], content)]
    order = sorted(rows)
    want = {k for k, v in holds.items() if any(a[0] != b[0] and a[1] != b[1] for a in v for b in v)}
    return np.array(order, dtype=np.uint64), np.array([rows[r] for r in order], dtype=np.int64), want


def test_runs_of_neighbours_are_the_repeats():
    r = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    pages = []
    for i in range(25):
        a = r.randrange(20)
        texts = [" ".join(passage[a : a + r.randrange(3, 15)] + [f"w{r.randrange(40)}" for _ in range(r.randrange(6))]) for _ in range(4)] + [r.choice(["Share this page", "one two three four", "two three four"])]
        pages.append((i // 2, i % 5, f"h{i % 2}", texts))
    cells, state, want = suffix_rows(pages)
    assert 50 < len(want) and len(cells) > 300
    for size in (len(cells), 7, 1):
        parts = defaultdict(list)
        for i in range(0, len(cells), size):
            for k, s in zip(*(x.tolist() for x in html.runs_of_array(cells[i : i + size], state[i : i + size])), strict=True):
                parts[k].append(s)
        found = {k for k, v in parts.items() if min(s[0] for s in v) != max(s[1] for s in v) and min(s[2] for s in v) != max(s[3] for s in v)}
        assert found == want


def test_bytes_sort_as_their_numbers():
    cells = np.array([[1, 2**63 + 1, 0], [1, 255, 7], [1, 256, 0], [0, 9, 9]], dtype=np.uint64)
    assert sorted(html.as_bytes(cells).to_pylist()) == [html.as_bytes(cells[[i]]).to_pylist()[0] for i in (3, 1, 2, 0)]


def test_names_of_ad_slots():
    for name in ("ad-slot", "x adUnit", "ad_box_2", "sponsored-container"):
        assert html.names_ad_slot(name), name
    for name in ("ad", "ad-hoc", "slot", "box unit", "ad slot", "shadow-box", "advert-history-box"):
        assert not html.names_ad_slot(name), name
