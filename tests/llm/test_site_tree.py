"""The style tree against a brute-force version, and pages on which only the tree can tell."""

import math
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import site_tree

SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows, schema=SCHEMA):
    return {r.page_id: r.text for r in site_tree.extract_main_text(spark.createDataFrame(rows, schema).repartition(3)).collect()}


def page(k, notice="All prices without tax.", extra=""):
    body = "".join(f"<p>Paragraph {k} {j} tells something new</p>" for j in range(1 + k % 4))
    return f"<html><body><div class='x{k}'><div class='b'>{notice}</div>{extra}<div class='t'><h2>Head {k}</h2>{body}</div></div></body></html>"


def text_of(k):
    return f"Head {k} " + " ".join(f"Paragraph {k} {j} tells something new" for j in range(1 + k % 4))


def test_only_the_tree_can_tell(spark):
    rows = [(k, f"http://a.org/{k}", page(k)) for k in range(12)]
    rows += [(50 + k, f"http://b.org/{k}", page(k, f"Notice {k * k} is told once")) for k in range(12)]
    found = extracted(spark, rows)
    assert all(found[k] == text_of(k) for k in range(12))
    assert all(found[50 + k] == f"Notice {k * k} is told once {text_of(k)}" for k in range(12))


def test_copies_of_a_page_are_no_evidence(spark):
    rows = [(k, "http://a.org/same", page(3)) for k in range(12)]
    assert set(extracted(spark, rows).values()) == {"All prices without tax. " + text_of(3)}


def test_branches_go_with_what_little_they_hold(spark):
    side = "<div class='s'><ul>" + "".join(f"<li>Section number {j} of this place</li>" for j in range(9)) + "</ul><i>{}</i></div>"
    rows = [(k, "http://a.org", page(k, extra=side.format(k))) for k in range(12)]
    assert all(text == text_of(k) for k, text in extracted(spark, rows).items())


def test_names_weigh_in(spark):
    html = "<article><p>one</p><div class='related-work'><p>two</p></div><section class='discussion'><p>three</p></section><div class='main comment-list'><p>four</p></div><div id='cookie-banner-3'>five</div></article>"
    assert extracted(spark, [(1, "http://a.org", html)]) == {1: "one two three"}
    # An ambiguous name and an almost constant text go together.
    rows = [(k, "http://a.org", f"<article><p>Text {k}</p><div class='related'>See list {k % 3}</div></article>") for k in range(12)]
    assert all(text == f"Text {k}" for k, text in extracted(spark, rows).items())


def brute_tree(pages):
    """host -> node path -> (content, presentation, pages that have it), for pages given as nested (label, [text or node])."""
    out = {}
    for host, own in pages.items():
        children, texts, have = defaultdict(Counter), defaultdict(Counter), Counter()
        rests = defaultdict(set)
        for tree in own:
            paths, found = set(), []

            def walk(node, above):
                path = (*above, node[0])
                paths.add(path)
                children[path][tuple(c[0] for c in node[1] if not isinstance(c, str))] += 1
                for c in node[1]:
                    found.append((path, c)) if isinstance(c, str) else walk(c, path)

            walk(tree, ())
            have.update(paths)
            for path, text in set(found):
                others = {t for _, t in found if t != text} or {text}
                texts[path][text] += 1
                rests[path, text].add((min(others, key=lambda t: (-len(t), site_tree.hashed(t))), min(others, key=site_tree.hashed)))
        m, out[host] = len(own), {}
        for path in have:
            n = sum(texts[path].values())
            content = 1 - sum(c * math.log(len(rests[path, t])) for t, c in texts[path].items()) / n / math.log(m + 3) if n else None
            shares = [c / have[path] for c in children[path].values()]
            out[host][path] = (content, 1 - math.exp(sum(p * math.log(p) for p in shares)), have[path])
    return out


def as_html(node):
    tag, _, name = node[0].partition(".")
    inner = "".join(c if isinstance(c, str) else as_html(c) for c in node[1])
    return f"<{tag}{f' class={name}9' if name else ''}>{inner}</{tag}>"


def test_tree_by_brute_force(spark):
    pages = {}
    for host, m in (("a.org", 1), ("b.org", 2), ("c.org", 15)):
        pages[host] = []
        for k in range(m):
            foot = ("div.foot", [f"foot {k % 3}"])
            body = ("div.text", [("p", [f"text {k} {j}" if j else "hello"]) for j in range(1)] + [("ul", [("li", [f"item {k % 2}"])])] * (k % 2))
            pages[host].append(("html", [("body", [("div.top", ["always the same"]), body, foot])]))
    rows = [(k, f"http://{host.upper()}/x", as_html(tree)) for host, own in pages.items() for k, tree in enumerate(own)]
    found = {(r.host, r.node): r for r in site_tree.style_tree(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    expected = brute_tree(pages)
    assert len(found) == sum(map(len, expected.values()))
    for host, nodes in expected.items():
        for path, (content, presentation, have) in nodes.items():
            node = 0
            for label in path:
                node = site_tree.hashed(" ".join(label.split(".")), node)
            r = found[host, node]
            assert r.content == (None if content is None else pytest.approx(content))
            assert r.presentation == pytest.approx(presentation, abs=1e-9)
            assert (r.pages, r.node_pages) == (len(pages[host]), have)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div>" * 50_000 + "x", "x"),
        ("<a " * 50_000, ""),
        ('<a x=">" ' * 20_000, ""),
        ("<!x " * 30_000, ""),
        ("<b>" * 30_000 + "<p>x" * 3, "x x x"),
        ("<div>" * 30_000 + "</span>" * 30_000 + "z", "z"),
    ],
)
def test_deep_and_broken_pages_in_linear_time(html, text):
    tracemalloc.start()
    begin = time.monotonic()
    assert site_tree.main_text(html) == text
    assert time.monotonic() - begin < 20 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_odd_rows_and_columns(spark):
    rows = [(1, None, None, "n"), (1, None, "", "n"), (2, "no url", "<p>a", None), (2, "no url", "<p>a", None), (None, "http://x", "<p>b</p>" + "<p>c</p>" * 5000, "")]
    schema = SCHEMA + ", nodes string, `low host` string, host string"
    frame = spark.createDataFrame([(*r, r[3], r[3]) for r in rows], schema)
    found = sorted((r.page_id or 0, r.url or "", r.text) for r in site_tree.extract_main_text(frame).collect())
    assert found == [(0, "http://x", "b" + " c" * 5000), (1, "", ""), (1, "", ""), (2, "no url", "a"), (2, "no url", "a")]
    kept = site_tree.extract_main_text(frame, keep=("nodes", "host", "page_id"))
    assert kept.columns == ["nodes", "host", "page_id", "text"] and kept.count() == 5
    assert site_tree.extract_main_text(frame.limit(0)).count() == 0 and site_tree.style_tree(frame.limit(0)).count() == 0


def test_shuffled_nodes_give_the_same(spark, monkeypatch):
    rows = [(k, f"http://{'ab'[k % 2]}.org/{k}", page(k)) for k in range(24)]
    expected = extracted(spark, rows)
    monkeypatch.setattr(site_tree, "BROADCAST_NODES", 0)
    assert extracted(spark, rows) == expected
