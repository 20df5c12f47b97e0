import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import divergence, registry
from sparkloom.llm.common import documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, least=10, top=10):
    """Rows (lang, source, part, item, value, rank) for rows (text, lang, source)."""
    groups, in_docs = {}, Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault((lang, source), Counter()).update(terms)
        in_docs.update((lang, t) for t in set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in in_docs.items() if g == lang and n >= least)
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_skyband_holds_what_few_dominate():
    draw = np.random.default_rng(2)
    for n, values in ((0, 3), (5, 3), (700, 4), (900, 60), (1500, 2000)):
        up, down, place = draw.integers(0, values, n), draw.integers(0, values, n), draw.permutation(n)
        dominated = ((up[None] >= up[:, None]) & (down[None] <= down[:, None]) & (place[None] < place[:, None])).sum(axis=1)
        for k in (1, 3, 10):
            assert sorted(divergence.skyband(up, down, place, k)) == np.flatnonzero(dominated < k).tolist()


def test_op13(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in documents(spark, sf_dir).collect()]
    found = registry.op13_source_divergence(spark, sf_dir)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, found.collect())) == brute_force(rows)


@pytest.mark.parametrize("sizes", [divergence.Sizes(), divergence.Sizes(entries=5, cells=7, tile=2, tiles=1)])
def test_odd_rows_in_any_blocks(spark, sizes):
    draw = random.Random(4)
    vocabulary = ["ab", "Ab", "É", "é", "zz", "日本", "y", "x́"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(draw.choice(vocabulary[: draw.randrange(2, 28)]) for _ in range(draw.randrange(40))), draw.choice(["a", "b", None]), draw.choice(["s", "t", "u", "v", None, "w"])) for _ in range(400)]
    rows += [(None, "a", "only nulls"), ("", "c", "one"), ("once", "d", "p"), ("else", "d", "q"), ("long " * 100_000, "a", "s")] + [("ab", "e", "r")] * 12
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, source string, term string, n int, value int").repartition(5)
    assert sorted(map(tuple, divergence.divergence_audit(docs, sizes=sizes).collect())) == brute_force(rows)
    assert divergence.divergence_audit(docs.limit(0), sizes=sizes).count() == 0


def test_shares_stay_exact():
    n = np.array([0, 9_000_000_001, 10**15], np.int64)
    assert divergence.shares(n, 10**16).tolist() == [1 + 10**9 * (int(x) + 2) // 10**16 for x in n]
