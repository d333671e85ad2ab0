"""Main text: densities and the choice of subtrees by their definition, and pages whose article no element names."""

import math
import random

import pytest

from terraspark.llm import html_density as H


def random_page(rng, depth=0):
    if depth > 4 or rng.random() < 0.25:
        return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 25)))
    tag = rng.choice(["div", "p", "a", "span", "section", "article", "b"])
    return f"<{tag}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


def by_definition(tree):
    """Characters per tag, weighed by links, of every node; and the sums of children's densities, own texts counting as children."""
    n = len(tree.tag)
    below = [{i} for i in range(n)]
    for i in range(n - 1, 0, -1):
        below[tree.parent[i]] |= below[i]
    own = [[len(t.strip()) for k, _, t in tree.texts if k == i and t.strip()] for i in range(n)]
    chars = [sum(sum(own[k]) for k in below[i]) for i in range(n)]
    linked = [any(tree.tag[k] == "a" and i in below[k] for k in range(n)) for i in range(n)]
    link_chars = [sum(sum(own[k]) for k in below[i] if any(tree.tag[j] == "a" and j in below[i] and k in below[j] for j in range(n))) for i in range(n)]
    tags = [sum(1 for k in below[i] - {i} if chars[k]) for i in range(n)]
    link_tags = [sum(1 for k in below[i] if tree.tag[k] == "a" and (k == i or chars[k])) for i in range(n)]
    share = link_chars[0] / max(chars[0], 1)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        t = max(t, 1)
        up = math.log(max(c / max(lc, 1) * (t / max(lt, 1)), 1.0))
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * (up / math.log(max(base, 1.0001)) if base > 1.0001 else up)

    d = [density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
    s = [sum(d[k] for k in range(1, n) if tree.parent[k] == i) + sum(density(c, 1, c if tree.tag[i] == "a" else 0, int(tree.tag[i] == "a")) for c in own[i]) for i in range(n)]
    return d, s, linked


def test_densities_by_definition():
    rng = random.Random(1)
    for _ in range(150):
        tree = H.Tree("<body>" + "".join(random_page(rng) for _ in range(3)) + "</body>")
        d, s, _ = by_definition(tree)
        got = H.densities(tree)
        assert got[0] == pytest.approx(d) and got[1] == pytest.approx(s)


def test_choice_by_definition():
    rng = random.Random(2)
    for _ in range(150):
        tree = H.Tree("<body>" + "".join(random_page(rng) for _ in range(3)) + "</body>")
        d, s, _ = by_definition(tree)
        d, s = ([round(v, 9) for v in x] for x in (d, s))
        n = len(d)
        if not any(v > 0 for v in s) or len(set(s)) < n - s.count(0.0):
            continue  # without ties the order of additions cannot matter
        under = lambda i, j: i == j or (i > 0 and under(tree.parent[i], j))
        best = max(range(n), key=lambda i: (s[i], -i))
        path = [j for j in range(n) if under(best, j)]
        threshold = min(d[j] for j in path)
        roots = {best}
        for j in range(n):
            if all(d[k] > 0 and d[k] >= threshold for k in range(n) if under(j, k)):
                roots.add(max((i for i in range(n) if under(i, j)), key=lambda i: (s[i], -i)))
        assert H._choose(tree) == [any(under(i, r) for r in roots) for i in range(n)]


TEXT = "The article is long enough, with commas and words, to stand out from what surrounds it on the page."


@pytest.mark.parametrize("tag", ["article", "main", "section", "div", "td"])
def test_no_element_names_the_article(tag):
    page = f"<body><div><a href=/>one</a><a href=/>two</a><a href=/>three</a></div><{tag}><p>{TEXT}</p><p>{TEXT}</p></{tag}></body>"
    assert H.main_text(page) == f"{TEXT} {TEXT}"


def test_repeated_blocks_and_ties():
    block = f"<div><p>{TEXT}</p></div>"
    assert H.main_text(f"<body>{block}{block}{block}</body>") == " ".join([TEXT] * 3)
    assert H.main_text("<body><p></p><p> </p></body>") == ""


def test_table_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{TEXT}</p>", "t", 5)] * 2 + [(None, None, None, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r["n_chars"] for r in got.collect()) == [0, len(TEXT), len(TEXT)]
