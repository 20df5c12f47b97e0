"""Each operator against a brute-force version on small and on odd rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from sparkloom.llm import bpe_fst, grammar_files, media_ts, mixing, pii, quality, registry, simhash, site_tree, suffix_dedup, token_counts

TIKTOKEN = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fingerprint string, kept string"
EMAIL = "bob.smith@mail.example.com"
LONG = " ".join(f"word{k * 7919 % 100003}" for k in range(30_000))
TEXTS = [
    None, "", " ", "one", "two words", "a\n \nb  c\t d   e", "naïve café 日本語 😀 text's we'll", EMAIL + " and 10.0.0.1, 4111 1111 1111 1111 or +1 (212) 555-0100.",
    "the quick brown fox jumps over the lazy dog " * 12, LONG, "z" * 20_000, "1." * 3000, "x" * 49, "x" * 50, "<|endoftext|> in a text <|startoftext|>",
]
ROWS = [(k, t, "en", "s" + str(k % 3), len(t or ""), "clash", "clash", "clash") for k, t in enumerate(TEXTS)]
ROWS += [(3, "one", None, None, None, None, None, None), (None, "two words", None, None, None, None, None, None), (40, TEXTS[8], "en", "s1", 0, "", "", ""), (41, LONG, "en", None, 0, "", "", ""), (42, None, None, None, None, None, None, None), (3, "one", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def body(row):
    return (row[1] or "").encode()


def key(value):
    return (value is None, value)


def same(found, expected):
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: [key(x) for x in r])
    assert order(found) == order(expected)


# 1


def test_transport_stream_rows(docs, empty):
    found = media_ts.stream_features(media_ts.store_texts(docs), keep=("n_bytes",)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    expected = []
    for row in ROWS:
        b = body(row)
        p = b + bytes(-len(b) % 64 if b else 64)
        expected.append((row[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    same(found, expected)
    assert media_ts.stream_features(media_ts.store_texts(empty)).count() == 0


def test_transport_stream_units(spark):
    payload = os.urandom(20_000)
    stream = spark.createDataFrame([(1, bytearray(media_ts.mux(payload))), (2, None)], "doc_id long, media binary")
    rows = media_ts.elementary_packets(stream).orderBy("unit").collect()
    assert b"".join(r.data for r in rows) == payload
    assert [r.pts for r in rows] == [90_000 + 3600 * k for k in range(5)]
    assert [r.random_access for r in rows] == [True, False, False, False, False]
    assert {(r.pid, r.stream_type) for r in rows} == {(256, 6)}
    assert media_ts.stream_features(stream).where("media_bytes is null").count() == 1


def test_transport_stream_damage():
    payload = os.urandom(50_000)
    stream = media_ts.mux(payload)
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    lost = media_ts.demux(b"".join(packets[:20] + packets[21:]))
    assert lost.continuity_errors == 1 and len(lost.units) == len(media_ts.demux(stream).units) - 1
    repeated = media_ts.demux(b"".join(packets[:20] + [packets[19]] + packets[20:]))
    assert repeated.continuity_errors == 0 and repeated.repeated == 1
    assert b"".join(u.data for u in repeated.units) == payload
    shifted = media_ts.demux(b"junk" + stream)
    assert shifted.damaged >= 1 and b"".join(u.data for u in shifted.units) == payload
    cut = media_ts.demux(stream[:-50])  # the unit is unfinished, and part of a packet is left
    assert cut.damaged == media_ts.demux(stream[:-188]).damaged + 1 and media_ts.demux(stream).damaged == 0
    broken = bytearray(stream)
    broken[10] ^= 1
    assert media_ts.demux(bytes(broken)).bad_tables == 1


# 2


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_fst.read_ranks(TIKTOKEN), special_tokens={})


def test_bpe_rows(docs, empty):
    encoding = reference_encoding()
    found = bpe_fst.encoding_digests(docs, TIKTOKEN, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip").collect()
    expected = []
    for row in ROWS:
        ids = encoding.encode_ordinary(row[1] or "")
        expected.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(body(row)).hexdigest(), True))
    same(found, expected)
    assert bpe_fst.encoding_digests(empty, TIKTOKEN, public_tokenizers.PATTERN).count() == 0


def test_bpe_encode_then_decode(docs):
    tokens = bpe_fst.encode_texts(docs, TIKTOKEN, public_tokenizers.PATTERN)
    same(bpe_fst.decode_ids(tokens, TIKTOKEN, public_tokenizers.PATTERN).collect(), [(r[0], r[1] or "") for r in ROWS])


def test_transducer_on_random_pieces():
    encoding, codec = reference_encoding(), bpe_fst.Codec(TIKTOKEN, public_tokenizers.PATTERN)
    draw = random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choice("aabcdeehilmnorst   \n'é日.,19") for _ in range(draw.randrange(60)))
        assert codec.encode(text.encode()).tolist() == encoding.encode_ordinary(text)
        assert "".join(codec.decode(codec.encode(text.encode()), block=1)) == text


def test_caches_are_bounded(monkeypatch):
    encoding = reference_encoding()
    monkeypatch.setattr(bpe_fst, "MOST_STATES", 50)
    monkeypatch.setattr(bpe_fst, "CACHE_CHUNKS", 40)
    codec = bpe_fst.Codec(TIKTOKEN, public_tokenizers.PATTERN)
    for k in range(200):
        text = f"some{k} words{k * k} again and again"
        assert codec.encode(text.encode()).tolist() == encoding.encode_ordinary(text)
    assert len(codec.later.held) <= 60 and len(codec.transducer.states) <= 50


def test_tables_stay_bounded_inside_a_piece(monkeypatch):
    monkeypatch.setattr(bpe_fst, "MOST_STATES", 300)
    monkeypatch.setattr(bpe_fst, "MOST_STEPS", 900)
    draw = random.Random(9)
    text = "".join(draw.choice("etaoinshrdlu") for _ in range(20_000))
    codec = bpe_fst.Codec(TIKTOKEN, public_tokenizers.PATTERN)
    assert codec.encode(text.encode()).tolist() == reference_encoding().encode_ordinary(text)
    assert len(codec.transducer.states) <= 300 and len(codec.transducer.steps) <= 900


def test_utf8_machine_in_any_pieces():
    data = "aé日😀z".encode()
    for cut in range(len(data) + 1):
        machine = bpe_fst.Utf8Machine()
        first = machine.feed(data[:cut])
        assert "�" not in first and first + machine.feed(data[cut:]) + machine.finish() == "aé日😀z"


# 3


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sainte_lague_is_by_highest_quotients():
    draw = np.random.default_rng(1)
    for _ in range(300):
        n = int(draw.integers(1, 9))
        votes, caps, seats = draw.integers(0, 50, n).astype(float), draw.integers(0, 12, n), int(draw.integers(0, 60))
        got = np.zeros(n, int)
        for _seat in range(seats):
            open_ = [i for i in range(n) if got[i] < caps[i] and votes[i] > 0]
            if not open_:
                break
            got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, caps).tolist() == got.tolist()


def test_mix_rows(docs, empty):
    found = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(7)).collect()
    pick = lambda rows: [(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows]
    same(pick(found), pick(again))
    same([(r.doc_id, r["size"]) for r in found], [(r[0], len(words_of(r[1]))) for r in ROWS])
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    sizes = {}
    for row in ROWS:
        sizes[row[3]] = sizes.get(row[3], 0) + len(words_of(row[1]))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=key))}
    target, total = {}, 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(w for s, w in weights.items() if s not in target)
        full = [s for s in weights if s not in target and weights[s] * level > 2 * sizes[s]]
        if not full:
            break
        target.update({s: 2 * sizes[s] for s in full})
    target = {s: target.get(s, weights[s] * level) for s in weights}
    for row in found:
        assert row.target == pytest.approx(target[row.source]) and row.source_size == sizes[row.source]
    for source in sizes:
        taken = sum(r.taken for r in found if r.source == source)
        assert abs(taken - target[source]) <= max(40, 0.01 * target[source])
    assert mixing.mix_plan(empty).count() == 0


def test_mix_texts_have_the_words_that_are_taken(docs):
    plan = {}
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words_of(r.text))
    assert got == {k: v for k, v in plan.items() if v}


def test_apportionment_down_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FANOUT", 4)
    leaves = spark.createDataFrame([(0, k, float(k % 7), 100) for k in range(30)], "grp long, leaf long, votes double, cap long")
    rows = mixing.apportion(leaves, spark.createDataFrame([(0, 50)], "grp long, seats long"), 30).collect()
    assert sum(r.seats for r in rows) == 50
    assert all(abs(r.seats - r.votes * 50 / sum(x.votes for x in rows)) <= 1.5 for r in rows)


# 4


def brute_fingerprint(text):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    marks = [brute_fingerprint(body(r)) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, row in zip(group, rows):
        least[g] = min(least.get(g, (True, None)), key(row[0]), key=lambda k: (k[0], k[1] or 0))
    return [(row[0], mark, least[g][1]) for row, mark, g in zip(rows, marks, group)]


def test_simhash_rows(docs, empty):
    found = simhash.near_duplicate_groups(docs).collect()
    same([(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found], brute_groups(ROWS))
    assert simhash.near_duplicate_groups(empty).count() == 0


def test_simhash_links_are_all_found(spark):
    draw = random.Random(3)
    values = {draw.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            for _bit in range(draw.randrange(1, 5)):
                v ^= 1 << draw.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()}
    assert found == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_keep_one_of_each_group(docs):
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = brute_groups(ROWS)
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted({key(g[2]) for g in groups})


# 5


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (pattern, holds) in enumerate(rules) for m in re.finditer(pattern, text) if holds(m.group()))


ODD = [
    "a@b.c_d@e.f..x@y.z a@b-.c- @b.c %@a.b", "1.2.3.4.5.6.7.8 01.002.0003.255 256.1.1.1 1.2.3", "é😀 4111-1111-1111-1111 then 4111 1111 1111 1112 0000000000000 4 1 1 1", "++1 212 555 0100 +1) +12345678901234567 +1..(2)--3 4567890", "a@b" + ".c" * 400, "7 " * 500,
    " ".join(f"u{k}@h{k}.org 10.0.{k}.9 +1 (212) 555-{1000 + k}" for k in range(200)),
]


def test_base_spans(spark, docs, empty):
    rows = ROWS + [(100 + k, t, None, None, None, None, None, None) for k, t in enumerate(ODD)]
    found = pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    expected = []
    for row in rows:
        spans = brute_spans(row[1] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        expected.append((row[0], *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), text))
    same(found, expected)
    assert pii.personal_data(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(k, f"please mail to user{k}@host{k}.example.com for help with it") for k in range(12)]
    new = [(50, "please mail to admin7@localhost for help"), (51, "the part7@shelf is broken"), (52, "about 1234567 people came")]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert rows[50].n_email == 0 and rows[50].spans == "email:15:31"
    assert rows[51].spans == "" and rows[52].spans == ""


def test_redaction(spark):
    text = f"é {EMAIL}, call +1 (212) 555-0100."
    rows = pii.redact(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, base string")).collect()
    same(rows, [(1, "é [EMAIL], call [PHONE].", "x"), (2, None, "y"), (3, "clean", "z")])


# 6


def brute_removed(rows, length=50):
    seen = {}
    for row in rows:
        b, at = body(row), key(row[0])
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            seen[s] = min(seen.get(s, at), at, key=lambda x: (x[0], x[1] or 0))
    out = []
    for row in rows:
        b, at = body(row), key(row[0])
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            low = seen[b[k : k + length]]
            if (low[0], low[1] or 0) < (at[0], at[1] or 0):
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((row[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeated_strings(spark, docs, empty):
    same(suffix_dedup.removed_strings(docs).collect(), brute_removed(ROWS))
    assert suffix_dedup.removed_strings(empty).count() == 0
    draw = random.Random(2)
    passages = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(30, 160))) for _ in range(12)]
    rows = []
    for k in range(60):
        parts = [draw.choice(passages) if draw.random() < 0.5 else "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(60))) for _ in range(6)]
        rows.append((draw.randrange(50), "".join(p[draw.randrange(8) :] for p in parts)))
    same(suffix_dedup.removed_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect(), brute_removed(rows))


def test_refined_buckets_are_equal_strings():
    draw = np.random.default_rng(4)
    data = draw.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1200] = data[:200]
    starts = np.arange(len(data) - 49)
    bucket = suffix_dedup.refine(data, starts)
    strings = [data[k : k + 50].tobytes() for k in starts]
    assert len(set(zip(bucket.tolist(), strings))) == len(set(strings)) == len(set(bucket.tolist()))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = os.urandom(5000)
    whole = suffix_dedup.anchor_runs([text])
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    pieces = suffix_dedup.anchor_runs([text])
    spread = lambda runs: sorted((a + k, h) for _, a, n, h in zip(*(c.tolist() for c in runs)) for k in range(n))
    assert spread(whole) == spread(pieces)


# 7


def test_quality_rows(docs, empty):
    found = quality.quality_figures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    expected = []
    for row in ROWS:
        text = row[1] or ""
        w = words_of(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        counts = {x: 0 for x in windows}
        for x in windows:
            counts[x] += 1
        inside = {k + j for k, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        expected.append((row[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    same(found, expected)
    assert quality.quality_figures(empty).count() == 0


def test_bands_reject_repetition_and_noise(spark):
    draw = random.Random(1)
    vocabulary = ["".join(draw.choice("etaoinshrdlucmf") for _ in range(draw.randrange(2, 10))) for _ in range(4000)]
    clean = " ".join(draw.choice(vocabulary[: draw.choice((200, 4000))]) for _ in range(700))
    repeated = " ".join(draw.choice(vocabulary[:30]) for _ in range(900))
    noise = " ".join("".join(chr(draw.randrange(33, 0xFFF)) for _ in range(8)) for k in range(400))
    rows = {r.doc_id: r for r in quality.quality_figures(spark.createDataFrame([(1, clean), (2, repeated), (3, noise)], "doc_id long, text string")).collect()}
    assert rows[1].kept and rows[2].band_failed and not rows[2].base_failed and rows[3].band_failed


def test_rejection_keeps_rows_whole(docs):
    kept = quality.reject_low_quality(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.quality_figures(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good


# 8


def test_token_counts(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = token_counts.load_tokenizer(path)
    expected = [(r[0], len(body(r)), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS]
    same(token_counts.count_tokens(docs, path).collect(), expected)
    assert token_counts.count_tokens(empty, path).count() == 0 and token_counts.frequent_words(empty) == []


# 9

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body>
<header>site</header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">buy</div><!-- <p>c</p> -->
<article><h1>Head {n}</h1><p><b>First {n}<br>line<p>Sec&eacute;ond&nbsp;&amp; {n}   x</p><div class="callout">Same everywhere</div><div class="comments"><p>I agree</p></div><form><p>q</p></form></article>
<aside>side</aside><footer>&copy; host {n}</footer>"""


def test_main_text(spark):
    rows = [(k, "http://a.example.com/" + str(k), PAGE.format(n=k)) for k in range(9)] + [(20, None, None), (21, "x", ""), (22, "http://b.org", "plain &lt; text"), (23, "http://b.org", "<p>one<p>two<li>three")]
    found = {r.page_id: r.text for r in site_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == f"Head {k} First {k} line Secéond & {k} x" for k in range(9))
    assert (found[20], found[21], found[22], found[23]) == ("", "", "plain < text", "one two three")
    assert site_tree.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_an_article_stay(spark):
    rows = [(k, "http://a.example.com/", PAGE.format(n=1)) for k in range(9)]
    found = site_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    # Pages that agree in all are one piece of evidence, so nothing tells the callout from the rest.
    assert {r.text for r in found} == {"Head 1 First 1 line Secéond & 1 x Same everywhere"} and len(found) == 9


# 10


def test_token_files(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_counts.load_tokenizer(path)
    found = grammar_files.token_file_digests(grammar_files.token_files(docs, path, 2)).collect()
    expected, at = [], 0
    for row in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, body(r))):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        expected.append((row[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(found, expected)
    assert grammar_files.token_file_digests(grammar_files.token_files(empty, path, 2)).count() == 0


def test_grammar_round_trip():
    draw = np.random.default_rng(6)
    for n, top in ((1, 5), (2, 3), (5000, 4), (20_000, 60)):
        tokens = draw.integers(0, top, n).astype(np.uint32)
        sizes = np.array([n]) if n < 10 else np.diff(np.r_[0, np.sort(draw.choice(np.arange(1, n), 20, replace=False)), n])
        shard = grammar_files.unpack(grammar_files.pack(grammar_files.compress(tokens, sizes, top)))
        expander = grammar_files.Expander(shard)
        assert expander.expand(shard.symbols).tolist() == tokens.tolist()
        ends, done = np.cumsum(shard.doc_symbols), 0
        for k, size in enumerate(sizes.tolist()):
            own = shard.symbols[ends[k] - shard.doc_symbols[k] : ends[k]]
            assert expander.expand(own).tolist() == tokens[done : done + size].tolist()
            if size > 4:
                assert expander.between(own, 1, size - 1).tolist() == tokens[done + 1 : done + size - 1].tolist()
            done += size


# all


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
