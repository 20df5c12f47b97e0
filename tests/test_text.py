import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import assets, evaluation
from sparkloom.operators import text as words
from sparkloom.sources import files

#: Words and lines of a public dictionary in its own format, whose results are given by that format.
LEXICON = [("可口", "kě kǒu", "tasty; to taste good"), ("阿公", "ā gōng", "(old) grandfather"), ("面", "miàn", "face/side/surface"), ("面", "miàn", "flour/noodles"), ("行", "háng", "row; line"), ("行", "xíng", "to walk; to go"), ("银行", "yín háng", "bank"), ("口", "kǒu", "mouth"), ("鱼", "Yú", "surname Yu"), ("鱼", "yú", "fish")]


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(column(F.col("s"))).collect()]


def test_tone_marks(spark):
    assert one(spark, "ma1 he2 kou3 gui4 xiu1 lüe4 lu:4 nu:3 Hai3 ma5 r5 m2".split(), T.mark_syllable) == "mā hé kǒu guì xiū lüè lǜ nǚ Hǎi ma r m".split()
    assert one(spark, ["ke3 kou3", "yi1mo2-yi1yang4", "", None], T.mark_pinyin) == ["kě kǒu", "yīmó-yīyàng", "", None]


def test_classes_and_blanks(spark):
    assert one(spark, ["KKM 阿公可口面!", "", None], T.class_only) == ["阿公可口面", "", None]
    assert one(spark, ["　a b\t", "　"], T.strip_blank) == ["a b", ""]
    assert one(spark, ["猪肉米粉 Pork", "银行 行"], T.class_runs) == [["猪肉米粉", " Pork"], ["银行", " ", "行"]]


def test_runs_keep_order(spark):
    rows = words.runs(spark.createDataFrame([(1, "银行 行"), (2, None)], "id int, text string"), "text", keep=("id",)).orderBy("run_no").collect()
    assert [(r.id, r.run_no, r.run, r.in_class) for r in rows] == [(1, 0, "银行", True), (1, 1, " ", False), (1, 2, "行", True)]


def test_segments(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, pinyin string, glosses string")
    assert lexicon.select("word").distinct().count() == 7
    found = words.segment(spark.createDataFrame([("阿公可口面",), ("",)], "run string"), lexicon).orderBy("start").collect()
    assert [(r.start, r.end, r.word) for r in found] == [(0, 2, "阿公"), (2, 4, "可口"), (4, 5, "面")]
    long = spark.createDataFrame([("九个字的词不会匹配",)], "word string")
    assert words.segment(spark.createDataFrame([("九个字的词不会匹配",)], "run string"), long).count() == 9


def test_ranked_entries(spark):
    entries = spark.createDataFrame([(k, *e, w) for k, e in enumerate(LEXICON) for w in {"行": ["xíng"], "鱼": ["yú"], "面": ["miàn"]}.get(e[0], [])], "ord int, word string, pinyin string, glosses string, wanted string")
    ranked = words.rank_entries(entries, "word", "pinyin", "wanted", "ord").orderBy("word", "place").collect()
    by = lambda w: [r.glosses for r in ranked if r.word == w]
    assert by("行") == ["to walk; to go", "row; line"] and by("鱼") == ["fish", "surname Yu"] and by("面")[0].startswith("face")


#: Fixed values, as above.
LINES = [
    "可口 可口 [ke3 kou3] /tasty; to taste good/", "#! version=1", "", "紙 纸 [zhi3] /paper/sheet/(of plans) theory (not practice)/(of shops) invoice/", "帋 纸 [zhi3] /variant of 紙|纸[zhi3]/",
    "行 行 [xing2] /to walk; to go/see also 行[hang2]/", "書 书 [shu1] /book/abbr. for 書經|书经[Shu1 jing1]/", "卡 卡 [ka3] /to block/also pr. [qia3]/", "一模一樣 一模一样 [yi1 mu2 yi1 yang4] /exactly alike/also pr. [yi1mo2-yi1yang4]/",
    "七夕 七夕 [Qi1 xi1] /the night when 牛郎織女|牛郎织女 meet/", "飯 饭 [fan4] /cooked rice/CL:碗[wan3]/meal/", "魚 鱼 [yu2] /fish (CL:條|条[tiao2],尾[wei3])/", "燈 灯 [deng1] /lamp/light/lantern/burner/",
    "鐙 灯 [deng1] /(variant of 灯[deng1]) burner/", "荳 豆 [dou4] /bean/", "豆 豆 [dou4] /bean/legume/",
]


def test_compact_dictionary(spark, tmp_path):
    found = words.compact_dictionary(spark.createDataFrame(list(enumerate(LINES)), "line_no int, line string"))
    files.write_dictionary(found, str(tmp_path / "out"))
    back = files.read_dictionary(spark, str(tmp_path / "out")).collect()
    lines = sorted("\t".join([r.word, r.pinyin, "/".join(r.glosses)]) for r in back)
    assert lines == sorted(
        ["可口\tkě kǒu\ttasty; to taste good", "纸\tzhǐ\tpaper/sheet/(of plans) theory (not practice)", "行\txíng\tto walk; to go", "书\tshū\tbook/abbr. for 书经 (Shū jīng)", "卡\tkǎ\tto block/also pr. [qiǎ]", "一模一样\tyī mú yī yàng\texactly alike/also pr. [yīmó-yīyàng]",
         "七夕\tQī xī\tthe night when 牛郎织女 meet", "饭\tfàn\tcooked rice/meal", "鱼\tyú\tfish", "灯\tdēng\tlamp/light/lantern", "灯\tdēng\tburner", "豆\tdòu\tbean/legume"]
    )


def test_distances(spark):
    pairs = [("面粉粿", "辣椒板面幼面面粉粿"), ("面粉粿", "辣椒板面幼面面粉棵"), ("海鲜伊面", "海鲜面"), ("阿公可口面", "阿公可口"), ("阿公", ""), (None, "x")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.substring_distance("a", "b")).collect()
    assert [r[0] for r in rows] == [0, 1, 1, 1, 2, None]


def test_scores(spark):
    lines = spark.createDataFrame([("f", 0, "辣椒板面"), ("f", 1, "幼面"), ("f", 2, "面粉粿"), ("f", 3, "Ah Gong Koka Noodle"), ("f", 4, "阿公可口")], "fixture string, line_no int, text string")
    labels = spark.createDataFrame([("f", 0, "面粉粿"), ("f", 1, "幼面"), ("f", 2, "阿公可口面"), ("f", 3, "龙虎会")], "fixture string, ord int, label string")
    rows = evaluation.best_matches(labels, lines, ["fixture"], T.CJK).orderBy("ord").collect()
    assert [(r.distance, r.text) for r in rows] == [(0, "面粉粿"), (0, "幼面"), (1, "阿公可口"), (3, "")]
    total = evaluation.summarize(evaluation.best_matches(labels, lines, ["fixture"], T.CJK), ["fixture"]).first()
    assert (total.exact, total.required) == (2, 4) and abs(total.mean_cer - (0.2 + 1) / 4) < 1e-9


def _edits(label, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(label, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != t)))
    return min(row)


def test_edits_in_words_of_bits():
    draw = random.Random(5)
    text = lambda most: "".join(draw.choice("abc面粉😀") for _ in range(draw.randint(0, most)))
    labels = [text(m) for m in (3, 20, 63, 64, 65, 128, 129, 200) for _ in range(25)]
    texts = [text(m) for m in (0, 5, 40, 300) for _ in range(50)]
    texts[::3] = [text(10) + label[: len(label) * 2 // 3] + text(4) + label[len(label) // 2 :] for label in labels[::3]]
    want = [_edits(a, b) for a, b in zip(labels, texts)]
    assert T.substring_edits(labels, texts).tolist() == want
    assert T.substring_edits(labels, texts, together=7, cells=500).tolist() == want
    assert [T._edits_by_rows(a, b) for a, b in zip(labels, texts)] == want
    for words in {(len(a) + 63) // 64 for a in labels} - {0}:
        some = [k for k, a in enumerate(labels) if (len(a) + 63) // 64 == words]
        assert T._edits_in_step([labels[k] for k in some], [texts[k] for k in some], words).tolist() == [want[k] for k in some]


@pytest.mark.parametrize("direct", [0, 1 << 16])
def test_best_matches_by_brute_force(spark, monkeypatch, direct):
    monkeypatch.setattr(evaluation, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(evaluation, "LABELS", 4)
    monkeypatch.setattr(evaluation, "TEXTS", 5)
    draw = random.Random(7)
    text = lambda least, most: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(least, most)))
    lines = [(key, k, text(0, 30)) for key in "pq" for k in range(40)] + [("r", 0, "..")]
    lines += [("q", 40, lines[50][2]), ("p", 41, None)]
    labels = []
    for key, k, line in lines[:81]:
        whole = (line or "")[:12]
        labels += [(key, 2 * k, whole), (key, 2 * k + 1, "".join(c for c in whole if draw.random() < 0.8) + text(0, 2))]
    labels += [("s", 0, "abc"), ("q", 900, "xyz"), ("q", 901, None), ("q", 900, "xyz"), ("p", 902, "ab")]
    found = evaluation.best_matches(spark.createDataFrame(labels, "f string, ord int, label string"), spark.createDataFrame(lines, "f string, line_no int, text string"), ["f"], "a-z").collect()
    want = set()
    for key, at, label in labels:
        if label:
            best = min([(_edits(label, t), n, t) for f, n, t in lines if f == key and t and t != ".."] + [(len(label), -1, "")])
            want.add((key, at, label, best[2] if best[0] < len(label) else "", best[0]))
    assert len(found) == len(want) and {tuple(r)[:5] for r in found} == want


def test_candidates_are_few(spark):
    """Labels one edit away from one of many lines meet few of them, and theirs among these."""
    draw = random.Random(9)
    lines = [("k", n, "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(30))) for n in range(300)]
    labels = [("k", n, line[4:12] + "z" + line[13:22]) for _, n, line in lines]
    pairs = evaluation.candidates(spark.createDataFrame(labels, "f string, ord int, label string"), spark.createDataFrame(lines, "f string, line_no int, text string"), ["f"]).select("ord", "line_no").collect()
    assert {(n, n) for n in range(300)} <= {tuple(r) for r in pairs} and len(pairs) < 300 * 300 / 20


def test_choice(spark):
    schema = "id string, download_mb double, exact int, required int, total_ms double, ord int"
    pick = lambda rows: [r.id for r in evaluation.choose(spark.createDataFrame([(i, m, e, 100, t, k) for k, (i, m, e, t) in enumerate(rows)], schema).withColumn("all", F.lit(1)), ["all"]).collect()]
    assert pick([("big", 31.0, 97, 3000.0), ("sloppy", 6.0, 89, 600.0), ("mid", 21.5, 95, 1900.0), ("small", 20.7, 93, 2400.0)]) == ["mid"]
    assert pick([("edge", 6.0, 90, 700.0)]) == ["edge"] and pick([("sloppy", 6.0, 89, 700.0)]) == []
    assert pick([("large", 26.0, 95, 2000.0), ("lean", 21.0, 95, 2000.0)]) == ["lean"]


def test_upper_median(spark):
    rows = evaluation.upper_median(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)], "k string, v double"), ["k"], "v", "m").collect()
    assert {r.k: r.m for r in rows} == {"a": 3.0, "b": 7.0}


def test_url_parameters(spark):
    pages = spark.createDataFrame([(1, "?img=/x.png&det=v6-small&debug"), (2, ""), (3, None)], "id int, url string")
    rows = files.url_parameters(pages, "url", ["img", "det", "debug"], ["id"]).orderBy("id").collect()
    assert (rows[0].img, rows[0].det, rows[0].debug, rows[0].has_debug) == ("/x.png", "v6-small", None, True)
    assert not any(rows[1][1:]) and not any(rows[2][1:])


def test_labels(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"m.png": {"description": "d", "required": ["面", "粿"], "pinyin": {"面": "miàn"}}}')
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "labels.json")).orderBy("ord").collect()] == [("m.png", 0, "面"), ("m.png", 1, "粿")]


def test_good_lines(spark):
    lines = spark.createDataFrame([(1, "面", 0.5), (2, "　", 0.9), (3, "粿", 0.49), (4, None, 1.0)], "n int, text string, score double")
    assert [r.n for r in words.good_lines(lines).collect()] == [1]


def test_card_views(spark):
    schema = "reading string, entries array<struct<pinyin:string,gloss:string>>, error string"
    rows = words.card_views(spark.createDataFrame([("Xíng", [("xíng", "to walk"), ("háng", "row")], None), ("a", None, None), ("a", [], None), ("a", None, "x")], schema)).collect()
    assert [r.status for r in rows] == ["", "loading", "not found", "unavailable"] and rows[0].shown == [None, "háng"]


def test_report_and_version(spark, tmp_path):
    rows = spark.createDataFrame([("v6 + v6", 97, 104, 0.0171, 998.5)], "config string, exact int, required int, mean_cer double, total_ms double")
    files.write_report(rows, str(tmp_path / "j"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "| v6 + v6 | 97/104 | 0.017 | 999 |"
    version = rows.select(assets.version_of(F.struct("config", "exact"))).first()[0]
    assert version == hashlib.sha256(b'{"config":"v6 + v6","exact":97}').hexdigest()[:12]


def test_stale_caches(spark):
    names = spark.createDataFrame([("app-1",), ("app-2",), ("other",)], "name string")
    assert [r.name for r in assets.stale(names, "name", "app-", "app-2").collect()] == ["app-1"]


def test_readings_by_context(spark, monkeypatch):
    """A character with two readings is read by the words on both sides, where the longest match from the left is wrong."""
    entries = spark.createDataFrame([("ab", 1, "A1 B1"), ("bc", 1, "B2 C2"), ("abc", 1, "A3 B3 C3"), ("cd", 1, "C4 D4"), ("d", 1, "D5"), ("d", 2, "D6"), ("ad", 1, "one")], "word string, ord int, pinyin string")
    costs = spark.createDataFrame([("ab", 10), ("bc", 10), ("abc", 12), ("cd", 10), ("d", 9), ("d", 15), ("ad", 1)], "word string, cost int")
    runs = spark.createDataFrame([("abcd",), ("abc",), ("xabx",), ("dd",), ("",), (None,), ("adad",)], "run string").repartition(3)
    want = {"abcd": ["A1", "B1", "C4", "D4"], "abc": ["A3", "B3", "C3"], "xabx": ["x", "A1", "B1", "x"], "dd": ["D5", "D5"], "adad": ["a", "d", "a", "d"]}
    for most in (500_000, 0):
        monkeypatch.setattr(words, "BROADCAST_WORDS", most)
        assert {r.run: r.readings for r in words.context_readings(runs, entries, costs, 30).collect()} == want
    assert [r.readings for r in words.first_readings(runs.where("run = 'abcd'"), entries).collect()] == [["A3", "B3", "C3", "D5"]]


def test_cheapest_paths_equal_brute_force(spark):
    from itertools import combinations

    draw = random.Random(6)
    pieces = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 5))) for _ in range(14)]
    cost = {w: draw.randrange(3, 9) for w in pieces}
    runs = {"".join(draw.choice("ab") for _ in range(draw.randrange(1, 11))) for _ in range(40)}

    def cheapest(run):
        ways = []
        for n in range(len(run)):
            for inner in combinations(range(1, len(run)), n):
                ends = [*inner, len(run)]
                spans = list(zip([0, *ends], ends))
                if all(run[a:b] in cost or b == a + 1 for a, b in spans):
                    ways.append((sum(cost.get(run[a:b], 7) for a, b in spans), len(spans), [a for a, _ in reversed(spans)], spans))
        return min(ways)[-1]

    table = spark.createDataFrame(list(cost.items()), "word string, cost int")
    found = {}
    for r in words.segment_by_cost(spark.createDataFrame([(r,) for r in runs], "run string"), table, 7).collect():
        found.setdefault(r.run, []).append((r.start, r.end))
    assert {r: sorted(s) for r, s in found.items()} == {r: cheapest(r) for r in runs}


def test_readings_of_small_lexicons_need_no_rows_for_words(spark):
    """A run's readings come from its words within one row: no row a word, no second grouping of the runs; class runs alone are split off."""
    entries = spark.createDataFrame([("ab", 1, "A1 B1"), ("ab", 2, "A2 B2"), ("cd", 1, "one")], "word string, ord int, pinyin string")
    runs = spark.createDataFrame([("abcd",), ("xab",)], "run string")
    for read in (words.first_readings(runs, entries), words.context_readings(runs, entries, entries.selectExpr("word", "3 AS cost"), 5)):
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "Join" not in plan and "Generate" not in plan
        assert {r.run: r.readings for r in read.collect()} == {"abcd": ["A1", "B1", "c", "d"], "xab": ["x", "A1", "B1"]}
    found = words.runs_in_class(spark.createDataFrame([("12ab-cd",), ("34",), (None,), ("",)], "text string"), "text", "a-z")
    assert sorted(r.run for r in found.collect()) == ["ab", "cd"]
