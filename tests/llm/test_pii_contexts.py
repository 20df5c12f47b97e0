"""Bootstrapped contexts against a plain version of the graph, and texts with very many matches."""

import math
import random
import re
import time
from collections import Counter, defaultdict

from sparkloom.llm import pii


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (pattern, holds) in enumerate(rules) for m in re.finditer(pattern, text) if holds(m.group()))


def luhn(digits):
    return sum(int(c) if at % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for at, c in enumerate(reversed(digits))) % 10 == 0


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def found_spans(docs):
    """doc_id -> list of (kind, text) that the method added."""
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = {}
    for r in pii.personal_spans(docs).collect():
        text = texts[r["kept 0"]]
        out[r["kept 0"]] = [(pii.KINDS[s["kind"]], text[s["start"] : s["end"]]) for s in r.spans if s not in r.base]
    return out


def luhn_card(k):
    return next(d for d in (f"4{k:014d}{last}" for last in range(10)) if luhn(d))


def test_grouped_and_failed_identifiers(spark):
    texts = [f"my card number is {luhn_card(k * 7919)} for orders" for k in range(9)]
    texts += [f"please call me at +1 212 555 {1000 + k} after noon" for k in range(9)]
    texts += [f"the server at address 10.0.0.{k} was down" for k in range(9)]
    new = [
        "my card number is 4111 1111 1111 1112 for orders",  # fails the test of its digits
        "my card number is 4111.1111.1111.1111 for orders",
        "please call me at (555) 123 4567 after noon",
        "please call me at 0171-555-0199, after noon",
        "the server at address 300.1.1.12 was down",
        "my card number is wrong for orders",
        "version 300.1.1.12 at (555) 123 4567 and 4111 1111 1111 1112 elsewhere",
        "the total of 4111 1111 1111 1113 pieces",
    ]
    found = found_spans(frame(spark, texts + new))
    at = len(texts)
    assert [found[k] for k in range(at, at + 6)] == [[("card", "4111 1111 1111 1112")], [("card", "4111.1111.1111.1111")], [("phone", "(555) 123 4567")], [("phone", "0171-555-0199")], [("ip", "300.1.1.12")], []]
    # An instance is an instance wherever it stands.
    assert found[at + 6] == [("ip", "300.1.1.12"), ("phone", "(555) 123 4567"), ("card", "4111 1111 1111 1112")]
    assert found[at + 7] == [] and all(found[k] == [] for k in range(at))


def test_rounds_go_on_to_a_fixed_point(spark):
    """Each link of a chain is named by a pattern that only the one before makes reliable."""
    texts = [f"c0 user{k}@host{k}.example.com d0" for k in range(20)]
    for step in range(5):
        for name in [f"n{step}x{k}@inner" for k in range(4)]:
            texts += [f"c{step} {name} d{step}"] + [f"c{step + 1} {name} d{step + 1}"] * 6
    texts += ["c5 far7@inner d5", "c9 far8@inner d9"]
    found = found_spans(frame(spark, texts))
    assert found[len(texts) - 2] == [("email", "far7@inner")] and found[len(texts) - 1] == []


def plain_bootstrap(rows):
    """(value, kind) named, by rounds over the whole graph."""
    edges = Counter()
    for r in rows:
        for m in [*r.base, *r.other]:
            for pattern in {f"l:{m.left}", f"r:{m.right}"} - {"l:", "r:"} | ({f"lr\t{m.left}\t{m.right}"} - {"lr\t\t"}):
                edges[pattern, m.value.lower(), m.kind] += 1
    import regex

    total, seeds, hits, unknown = Counter(), defaultdict(set), Counter(), defaultdict(Counter)
    for (pattern, value, kind), n in edges.items():
        total[pattern] += n
        if kind is not None:
            seeds[pattern, kind].add(value)
            hits[pattern, kind] += n
        else:
            for k, name in enumerate(pii.KINDS):
                if regex.search(pii.SHAPES[name], value):
                    unknown[value, k][pattern] += n
    held = {}
    while True:
        confidence = {}
        for pattern, kind in {(p, k) for (_, k), ps in unknown.items() for p in ps} | set(seeds):
            own = [(v, ps[pattern]) for (v, k), ps in unknown.items() if k == kind and (v, k) in held and pattern in ps]
            score = (hits[pattern, kind] + sum(n * held[v, kind] for v, n in own)) / total[pattern]
            if len(seeds[pattern, kind]) + len(own) >= pii.LEAST_SEEDS and score >= pii.PATTERN_CONFIDENCE:
                confidence[pattern, kind] = score
        new = {}
        for (value, kind), patterns in unknown.items():
            score = 1 - math.prod(1 - min(confidence[p, kind], 0.999999) for p in patterns if (p, kind) in confidence)
            if score >= pii.INSTANCE_CONFIDENCE:
                new[value, kind] = score
        if len(new) == len(held):
            break
        held = new
    best = {}
    for (value, kind), score in new.items():
        best[value] = max(best.get(value, (0, -9)), (score, -kind))
    return sorted((v, -k) for v, (_, k) in best.items())


def test_bootstrap_by_brute_force(spark):
    draw = random.Random(4)
    makers = [lambda: f"u{draw.randrange(40)}@h{draw.randrange(9)}.org", lambda: f"u{draw.randrange(12)}@local", lambda: f"10.0.{draw.randrange(20)}.{draw.randrange(300)}", lambda: f"0{draw.randrange(10**8, 10**9)}", lambda: f"+49 30 {draw.randrange(10**6, 10**7)}", lambda: f"room{draw.randrange(30)}"]
    liked = ["mail", "host", "call", "see"]
    texts = []
    for _ in range(1200):
        kind = draw.choices(range(6), (20, 3, 20, 3, 20, 6))[0]
        word = liked[(0, 0, 1, 2, 2, 3)[kind]] if draw.random() < 0.96 else draw.choice(liked)
        texts.append(f"{draw.choice('abcdefg')} {word} {makers[kind]()} {word if draw.random() < 0.8 else draw.choice('uvw')}")
    found = pii.base_mentions(frame(spark, texts)).cache()
    expected = plain_bootstrap(found.collect())
    assert len(expected) > 20
    assert sorted((r.value, r.kind) for r in pii.bootstrap(found).collect()) == expected


def test_context_words_of_any_length(spark):
    long_ = "x" * 500
    texts = [f"{long_} user{k}@host{k}.org {'y' * 300}" for k in range(5)] + [f"{long_} admin7@localhost {'y' * 300}", f"{long_}x admin8@localhost {'y' * 301}"]
    found = found_spans(frame(spark, texts))
    assert found[5] == [("email", "admin7@localhost")] and found[6] == []


def test_many_matches_in_one_text_take_linear_time(spark):
    def text(n):
        return "é " + " ".join(f"user{k}@host{k}.example.org 10.0.{k % 256}.9 id{k}" for k in range(n))

    begin = time.monotonic()
    docs = frame(spark, [text(16_000), None])
    rows = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.monotonic() - begin < 90
    assert rows[0] == "é " + " ".join(f"[EMAIL] [IP] id{k}" for k in range(16_000)) and rows[1] is None


def test_redaction_by_brute_force(spark):
    draw = random.Random(6)
    parts = ["a.b@c.org", "+1 (212) 555-0100", "4111 1111 1111 1111", "10.1.2.3", "1.2.3.4.5", "é😀", "\n", " ", "word", "7@7.7.7.7", "+12 4111111111111111 3"]
    texts = ["".join(draw.choice(parts) + draw.choice(["", " ", " "]) for _ in range(draw.randrange(1, 200))) for _ in range(40)]
    docs = frame(spark, texts)
    assert all(x == [] for x in found_spans(docs).values())
    for r in pii.redact(docs).collect():
        text, out, at = texts[r.doc_id], "", 0
        for start, kind, end in brute_spans(text):
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert r.text == out + text[at:]
    assert pii.redact(docs.limit(0)).count() == 0
