import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from sparkloom.llm import bpe_fst, quality
from sparkloom.llm.common import documents


def test_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "personal data", "mixing", "encoding"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
        if name != "encoding":
            assert seen[-1].columns == columns and dict(seen[-1].dtypes) == dict(docs.dtypes)
    start, good, single, clean, mixed, final = [x.collect() for x in seen]
    bands = quality.Bands()
    import zstandard

    packer = zstandard.ZstdCompressor(level=bands.level)

    def passes(text):
        b = text.encode()
        n, *_, repeats = quality.base_figures(b)
        return n >= 50 and 100 * repeats <= 50 * n and not quality.out_of_band(len(b), *quality.ratios(b, bands, packer), bands)

    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in start if passes(r.text))
    # Near copies: five-word shingles with a similarity of 0.8 or more.
    words_of = {r.doc_id: r.text.lower().split() for r in good}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words_of.items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert sorted(r.doc_id for r in single) == sorted(set(group.values()))
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single)
    before = {r.doc_id: r.text for r in single}
    assert any(r.text != before[r.doc_id] for r in clean) and all(("[" in r.text) or r.text == before[r.doc_id] for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean + mixed)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.02 * words(clean)
    ranks = bpe_fst.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, list(r.ids)) for r in final) == sorted((r.doc_id, encoding.encode_ordinary(r.text)) for r in mixed)
    assert all(r.round_trip for r in final)


CLASHING = ["hash", "node", "bands", "kept 0", "row", "base", "spans", "times", "shard", "mark", "copy", "first", "body of the row", "n_chars"]


def test_stages_on_odd_tables(spark, sf_dir):
    draw = random.Random(1)
    vocabulary = ["".join(draw.choice("etaoinshrdlucmf") for _ in range(draw.randrange(2, 10))) for _ in range(4000)]
    prose = lambda n: " ".join(draw.choice(vocabulary[: draw.choice((200, 4000))]) for _ in range(n))
    long_, clean = prose(3000), prose(200)
    rows = [(1, None, "a"), (2, "", None), (3, long_, "a"), (None, clean, None), (3, long_, "a"), (5, clean + " mail me at a@b.org", "b"), (6, "one", "b")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` {'long' if c == 'n_chars' else 'string'}" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *([c if c != "n_chars" else 1 for c in CLASHING])) for r in rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        found = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert found.columns == docs.columns and empty.columns == docs.columns
            assert all(r[c] == c for r in found.collect() for c in CLASHING if c != "n_chars")
        assert empty.count() == 0 and found.count() > 0
