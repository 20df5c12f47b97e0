"""Queries of whole flows: lookup and annotation, boxes of text, crops, taps on quads, app states, messages, labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import geometry as G
from sparkloom.functions import text as T
from sparkloom.operators import layout, raster, recognition, scan, spatial
from sparkloom.operators import text as words
from sparkloom.plans.queries import _CELLS, _LEXICON, _RUNS, _SPANS, LETTERS, _distinct_runs, _prefix_lexicon, _table, query
from sparkloom.storage import materialized
from sparkloom.streaming import messages, ranges, reducer

# Text

#: Three entries for a word that differ in how their reading fits.
_ENTRIES = "entries AS (SELECT word, 1 AS ord, reverse(word) AS pinyin FROM lexicon UNION ALL SELECT word, 2, upper(word) FROM lexicon UNION ALL SELECT word, 3, word FROM lexicon)"


def _entries(lexicon):
    forms = F.array(F.reverse("word"), F.upper("word"), F.col("word"))
    return lexicon.select("word", F.posexplode(forms).alias("k", "pinyin")).select("word", (F.col("k") + 1).alias("ord"), "pinyin", F.array(F.col("pinyin")).alias("glosses"))


@query(
    f"""WITH RECURSIVE {_RUNS}, {_LEXICON}, {_SPANS}, {_ENTRIES},
    taps AS (SELECT run, (n * 7) % (length(run) + 1) AS idx FROM runs),
    hit AS (SELECT t.run, idx, pos - 1 AS start, pos - 1 + size AS stop, substr(t.run, pos, size) AS word FROM taps t LEFT JOIN spans s ON s.run = t.run AND idx >= pos - 1 AND idx < pos - 1 + size),
    ranked AS (SELECT h.*, e.pinyin, CASE WHEN e.pinyin = h.word THEN 0 WHEN lower(e.pinyin) = lower(h.word) THEN 1 ELSE 2 END AS fit, ord FROM hit h LEFT JOIN entries e ON e.word = h.word)
    SELECT run AS tap, word, start::INT AS start, stop::INT AS "end", coalesce(string_agg(pinyin, '/' ORDER BY fit, ord), '') AS entries, CASE WHEN word IS NULL THEN 'no character there' END AS error FROM ranked GROUP BY run, word, start, stop"""
)
def tap_lookup(spark, sf_dir):
    """Taps on the letters of all distinct runs (some beside the run), the word under each and its entries by how well they fit."""
    counted = _distinct_runs(spark, sf_dir)
    lexicon = materialized(_prefix_lexicon(counted))
    taps = counted.select(F.col("run").alias("tap"), "run", (F.col("n") * 7 % (F.length("run") + 1)).cast("int").alias("index"), F.slice(F.split("run", ""), F.lit(1), F.length("run")).alias("readings"))
    found = words.lookup_taps(taps, _entries(lexicon))
    entries = F.array_join(F.transform("entries", lambda e: e["pinyin"]), "/")
    return found.select("tap", "word", "start", "end", F.coalesce(entries, F.lit("")).alias("entries"), "error")


@query(
    f"""WITH RECURSIVE {_RUNS}, {_LEXICON},
    pieces AS (SELECT run, p.pos - 1 AS s, p.pos - 1 + z.size AS e, substr(run, p.pos, z.size) AS word FROM runs, unnest(range(1, length(run) + 1)) AS p(pos), range(1, 9) AS z(size) WHERE p.pos + z.size <= length(run) + 1),
    edges AS (SELECT run, e, list({{'s': s, 'cost': CASE WHEN seen IS NULL THEN 300 ELSE (100 + 4000 // seen)::BIGINT END}}) AS ways FROM pieces LEFT JOIN lexicon USING (word) WHERE seen IS NOT NULL OR e = s + 1 GROUP BY run, e),
    paths(run, e, best) AS (SELECT run, 0::BIGINT, [0::HUGEINT] FROM runs UNION ALL
      SELECT f.run, g.e, list_append(best, list_min(list_transform(ways, lambda x: ((best[x.s + 1] // 1099511627776 + x.cost) * 1048576 + best[x.s + 1] // 1048576 % 1048576 + 1) * 1048576 + x.s))) FROM paths f JOIN edges g ON g.run = f.run AND g.e = f.e + 1),
    back(run, best, e, s) AS (SELECT run, best, e, (best[e + 1] % 1048576)::BIGINT FROM paths WHERE e = length(run) UNION ALL SELECT run, best, s, (best[s + 1] % 1048576)::BIGINT FROM back WHERE s > 0)
    SELECT run, string_agg(substr(run, s + i + 1, 1) || CASE WHEN e - s > 1 THEN (e - s)::VARCHAR ELSE '' END, ' ' ORDER BY s + i) AS readings FROM back, unnest(range(0, e - s)) AS t(i) GROUP BY run"""
)
def context_readings(spark, sf_dir):
    """All distinct letter runs, each letter read by the length of its word in the cheapest way to read the run."""
    counted = _distinct_runs(spark, sf_dir)
    lexicon = materialized(_prefix_lexicon(counted))
    costs = lexicon.select("word", (100 + F.expr("4000 div seen")).alias("cost"))
    letters = F.transform(F.slice(F.split("word", ""), F.lit(1), F.length("word")), lambda c: F.concat(c, F.length("word").cast("string")))
    entries = lexicon.select("word", F.lit(1).alias("ord"), F.array_join(letters, " ").alias("pinyin"))
    read = words.context_readings(counted, entries, costs, 300)
    return read.select("run", F.array_join("readings", " ").alias("readings"))


@query(
    f"""WITH RECURSIVE {_RUNS}, {_LEXICON},
    lines AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS parts FROM conversations WHERE regexp_matches(text, '[A-Za-z]')),
    tokens AS (SELECT conv_id, turn, p.k - 1 AS token_no, parts[p.k] AS run FROM lines, unnest(range(1, len(parts) + 1)) AS p(k)),
    own_runs AS (SELECT DISTINCT run FROM tokens WHERE regexp_matches(run, '^[A-Za-z]')),
    {_SPANS.replace('FROM runs', 'FROM own_runs').replace('JOIN runs', 'JOIN own_runs')},
    readings AS (SELECT run, string_agg(CASE WHEN size = 1 OR ch = upper(ch) THEN '-' ELSE upper(ch) END, '' ORDER BY pos + i) AS shown
      FROM (SELECT run, pos, size, i, substr(run, pos + i, 1) AS ch FROM spans, unnest(range(0, size)) AS t(i)) GROUP BY run)
    SELECT conv_id, turn, token_no::INT AS token_no, t.run AS text, r.run IS NOT NULL AS in_class, coalesce(r.shown, repeat('-', length(t.run))) AS readings FROM tokens t LEFT JOIN readings r ON r.run = t.run"""
)
def annotate_lines(spark, sf_dir):
    """Turns of conversations as lines: their runs, and for each letter its reading (here its capital) where its word has one."""
    counted = _distinct_runs(spark, sf_dir)
    letters = F.array_join(F.split(F.upper("word"), ""), " ")
    lexicon = materialized(_prefix_lexicon(counted)).select("word", F.lit(1).alias("ord"), T.strip_blank(letters).alias("pinyin"))
    lines = _table(spark, sf_dir, "conversations")
    own = words.runs_in_class(lines, "text", LETTERS).distinct()
    annotated = words.annotate_lines(lines, words.first_readings(own, lexicon), ["conv_id", "turn"], LETTERS)
    tokens = annotated.select("conv_id", "turn", F.posexplode("tokens").alias("token_no", "t"))
    shown = F.array_join(F.transform("t.chars", lambda c: F.coalesce(c["reading"], F.lit("-"))), "")
    return tokens.select("conv_id", "turn", "token_no", F.col("t.text").alias("text"), F.col("t.in_class").alias("in_class"), shown.alias("readings"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS parts FROM conversations),
    runs AS (SELECT conv_id, role, turn * 100000 + p.k - 1 AS token_no, parts[p.k] AS run FROM t, unnest(range(1, len(parts) + 1)) AS p(k) WHERE regexp_matches(parts[p.k], '^[A-Za-z]')),
    labels AS (SELECT conv_id, run AS label, row_number() OVER (PARTITION BY conv_id ORDER BY run) AS ord FROM (SELECT DISTINCT conv_id, run FROM runs WHERE role = 'system' AND length(run) >= 3))
    SELECT l.conv_id, ord, label, min(token_no) AS token_no, upper(label) AS readings FROM labels l JOIN runs r ON r.conv_id = l.conv_id AND r.role = 'user' AND contains(r.run, label) GROUP BY ALL"""
)
def contained_labels(spark, sf_dir):
    """Words of a conversation's instructions inside words of its user turns: where each first stands."""
    turns = _table(spark, sf_dir, "conversations")
    runs = words.runs(turns, "text", LETTERS, ("conv_id", "role", "turn")).where("in_class")
    tokens = runs.where("role = 'user'").select("conv_id", (F.col("turn") * 100000 + F.col("run_no")).alias("token_no"), F.col("run").alias("text"), F.transform(F.slice(F.split("run", ""), F.lit(1), F.length("run")), F.upper).alias("readings"))
    labels = runs.where("role = 'system' and length(run) >= 3").select("conv_id", F.col("run").alias("label")).distinct()
    labels = labels.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("label")).cast("long"))
    return words.contained(labels, tokens, ["conv_id"]).withColumn("readings", F.array_join("readings", ""))


# Grids

#: Components, the ends of their rows, the directions of their hulls in order, the least rectangle, its mean, and its quad.
_BOXES_SQL = f"""WITH RECURSIVE {_CELLS.replace('v > 0.1', 'v > 0.05')}, reach(vec_id, pix, root) AS (SELECT vec_id, pix, pix FROM lit UNION
  SELECT r.vec_id, b.pix, r.root FROM reach r JOIN lit a ON a.vec_id = r.vec_id AND a.pix = r.pix JOIN lit b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
low AS (SELECT vec_id, pix, min(root) AS root FROM reach GROUP BY 1, 2),
comps AS (SELECT vec_id, pix, x, y, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS comp FROM low JOIN lit USING (vec_id, pix)),
pts AS (SELECT DISTINCT vec_id, comp, e.x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT vec_id, comp, y, min(x) AS a, max(x) AS b FROM comps WHERE comp <= 4 GROUP BY 1, 2, 3), unnest([a, b]) AS e(x)),
dirs AS (SELECT DISTINCT p.vec_id, p.comp, (q.x - p.x) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS ux, (q.y - p.y) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS uy
  FROM pts p JOIN pts q ON p.vec_id = q.vec_id AND p.comp = q.comp AND (p.x <> q.x OR p.y <> q.y)
  WHERE NOT EXISTS (SELECT 1 FROM pts o WHERE o.vec_id = p.vec_id AND o.comp = p.comp AND (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0)
    AND EXISTS (SELECT 1 FROM pts o WHERE o.vec_id = p.vec_id AND o.comp = p.comp AND (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) > 0)),
spans AS (SELECT vec_id, comp, ux, uy, min(x * ux + y * uy) AS a0, max(x * ux + y * uy) AS a1, min(-x * uy + y * ux) AS b0, max(-x * uy + y * ux) AS b1 FROM dirs JOIN pts USING (vec_id, comp) GROUP BY 1, 2, 3, 4),
rects AS (SELECT *, (a1 - a0) / 2 AS hu, (b1 - b0) / 2 AS hv, (a0 + a1) / 2 * ux - (b0 + b1) / 2 * uy AS cx, (a0 + a1) / 2 * uy + (b0 + b1) / 2 * ux AS cy FROM spans
  QUALIFY row_number() OVER (PARTITION BY vec_id, comp ORDER BY round((a1 - a0) * (b1 - b0), 9), round(atan2(uy, ux), 9) + CASE WHEN round(atan2(uy, ux), 9) > round(-pi() / 2, 9) THEN 0 ELSE 2 * pi() END, ux, uy) = 1),
scored AS (SELECT r.*, coalesce((SELECT avg(v) FROM cells c WHERE c.vec_id = r.vec_id AND abs((c.x - cx) * ux + (c.y - cy) * uy) <= hu + 0.5 + 1e-9 AND abs(-(c.x - cx) * uy + (c.y - cy) * ux) <= hv + 0.5 + 1e-9), 0) AS score FROM rects r WHERE 2 * least(hu, hv) >= 3 - 1e-9),
grown AS (SELECT *, 4 * hu * hv * 1.5 / (4 * (hu + hv)) AS g FROM scored WHERE score >= 0.02),
corners AS (SELECT vec_id, comp, score, s.k, cx + s.a * (hu + g) * ux - s.b * (hv + g) * uy AS x, cy + s.a * (hu + g) * uy + s.b * (hv + g) * ux AS y FROM grown, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) AS s(k, a, b) WHERE 2 * (least(hu, hv) + g) >= 5 - 1e-9),
sided AS (SELECT *, row_number() OVER (PARTITION BY vec_id, comp ORDER BY round(x, 9), k) > 2 AS is_right, row_number() OVER (PARTITION BY vec_id, comp ORDER BY round(x, 9), k) AS nx FROM corners),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id, comp, is_right ORDER BY round(y, 9), nx) AS down FROM sided),
quads AS (SELECT vec_id, comp, any_value(score) AS score, string_agg(least(160, greatest(0, floor(round(x * 20, 9) + 0.5)))::BIGINT || ',' || least(240, greatest(0, floor(round(y * 30, 9) + 0.5)))::BIGINT, ' ' ORDER BY CASE WHEN NOT is_right AND down = 1 THEN 0 WHEN is_right AND down = 1 THEN 1 WHEN is_right THEN 2 ELSE 3 END) AS quad FROM placed GROUP BY 1, 2)
SELECT vec_id, comp::INT AS comp, quad, round(score, 6) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY split_part(split_part(quad, ' ', 1), ',', 2)::BIGINT, split_part(split_part(quad, ' ', 1), ',', 1)::BIGINT, comp) AS place FROM quads"""


@query(_BOXES_SQL)
def grid_boxes(spark, sf_dir):
    """Boxes of the first four components of each embedding as an 8 by 8 map, on an image of 160 by 240."""
    found = raster.text_boxes(_table(spark, sf_dir, "embeddings"), "embedding", 8, ["vec_id"], 0.05, 0.02, 1.5, 4, (160.0, 240.0))
    quad = F.array_join(F.transform("quad", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return found.select("vec_id", "comp", quad.alias("quad"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


_QUADS = """quads AS (SELECT p_partkey, p_brand, p_retailprice AS x, (p_partkey % 97)::DOUBLE AS y, (p_size + 8)::DOUBLE AS w, (p_partkey % 61 + 4)::DOUBLE AS h, (p_partkey % 7)::DOUBLE AS k FROM part)"""


def _quads(spark, sf_dir):
    """Parts as parallelograms that lean by up to six pixels."""
    x, y, w, h, k = F.col("p_retailprice"), F.col("p_partkey") % 97, F.col("p_size") + 8, F.col("p_partkey") % 61 + 4, F.col("p_partkey") % 7
    quad = F.array(G.point(x, y), G.point(x + w, y + k), G.point(x + w - k, y + h + k), G.point(x - k, y + h))
    return _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("ord"), quad.alias("quad"))


@query(
    f"""WITH {_QUADS}, s AS (SELECT *, greatest(1, floor(sqrt(w * w + k * k) + 0.5)) AS wide, greatest(1, floor(sqrt(k * k + h * h) + 0.5)) AS high FROM quads),
    f AS (SELECT *, high >= 1.5 * wide AS vertical FROM s)
    SELECT p_partkey, vertical, (CASE WHEN vertical THEN high ELSE wide END)::INT AS width, (CASE WHEN vertical THEN wide ELSE high END)::INT AS height,
      round(CASE WHEN vertical THEN x + w + 3 * (-k / high) ELSE x + 3 * (w / wide) END, 6) AS x3, round(CASE WHEN vertical THEN y + k + 3 * (h / high) ELSE y + 3 * (k / wide) END, 6) AS y3,
      round(CASE WHEN vertical THEN x + w + 5 * (-k / high) + wide * (-w / wide) ELSE x + 5 * (w / wide) + high * (-k / high) END, 6) AS x5, round(CASE WHEN vertical THEN y + k + 5 * (h / high) + wide * (-k / wide) ELSE y + 5 * (k / wide) + high * (h / high) END, 6) AS y5 FROM f"""
)
def crop_frames(spark, sf_dir):
    """The crops of leaning quads, and where their columns 3 to 5 lie: the first and the third corner."""
    rows = _quads(spark, sf_dir).withColumn("f", G.crop_frame(F.col("quad")))
    rows = rows.withColumn("q", G.frame_quad(F.col("f"), F.lit(3.0), F.lit(5.0)))
    corners = {"x3": ("q", 0, "x"), "y3": ("q", 0, "y"), "x5": ("q", 2, "x"), "y5": ("q", 2, "y")}
    return rows.select("p_partkey", "f.vertical", "f.width", "f.height", *(F.round(F.col(q)[k][c], 6).alias(name) for name, (q, k, c) in corners.items()))


@query(
    f"""WITH {_QUADS}, c AS (SELECT p_partkey, p_brand, w, h, x AS x0, y AS y0, x + w AS x1, y + k AS y1, x + w - k AS x2, y + h + k AS y2, x - k AS x3, y + h AS y3 FROM quads),
    q AS (SELECT *, greatest(22.0, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), sqrt((x3 - x0) * (x3 - x0) + (y3 - y0) * (y3 - y0))) AS far, (x0 + x2) / 2 AS cx, (y0 + y2) / 2 AS cy FROM c),
    p AS (SELECT o_orderkey, 'Brand#' || (o_orderkey % 5 + 1) || (o_custkey % 5 + 1) AS p_brand, 900 + (o_custkey % 1100)::DOUBLE AS px, (o_orderkey % 101)::DOUBLE AS py FROM orders),
    j AS (SELECT o_orderkey, p_partkey, far, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS away, [(x1 - x0) * (py - y0) - (y1 - y0) * (px - x0), (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1), (x3 - x2) * (py - y2) - (y3 - y2) * (px - x2), (x0 - x3) * (py - y3) - (y0 - y3) * (px - x3)] AS s,
      px BETWEEN least(x0, x1, x2, x3) AND greatest(x0, x1, x2, x3) AND py BETWEEN least(y0, y1, y2, y3) AND greatest(y0, y1, y2, y3) AS boxed FROM p JOIN q USING (p_brand) WHERE abs(px - cx) <= far + w + h AND abs(py - cy) <= far + w + h),
    t AS (SELECT *, boxed AND (list_min(s) >= 0 OR list_max(s) <= 0) AS inside FROM j)
    SELECT o_orderkey, p_partkey, inside FROM t WHERE inside OR away <= far QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE away END, p_partkey) = 1"""
)
def quad_taps(spark, sf_dir):
    """Orders as taps on the leaning quads of a brand's parts."""
    brand = F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 5 + 1).cast("string"), (F.col("o_custkey") % 5 + 1).cast("string"))
    points = _table(spark, sf_dir, "orders").select("o_orderkey", brand.alias("p_brand"), (900 + F.col("o_custkey") % 1100).cast("double").alias("x"), (F.col("o_orderkey") % 101).cast("double").alias("y"))
    return spatial.quad_hits(points, _quads(spark, sf_dir), ["p_brand"], "o_orderkey", "p_partkey", 22.0, 32.0).select("o_orderkey", "p_partkey", "inside")


@query(
    f"""WITH {_CELLS}, o AS (SELECT i::INT AS pix, least(7, greatest(0, 1 + (i % 4) * 0.75 - (i // 4) * 0.4))::DOUBLE AS x, least(7, greatest(0, 1.5 + (i % 4) * 0.5 + (i // 4) * 1.2))::DOUBLE AS y FROM unnest(range(0, 20)) AS t(i))
    SELECT c.vec_id, o.pix, round(sum(c.v * greatest(0, 1 - abs(o.x - c.x)) * greatest(0, 1 - abs(o.y - c.y))), 5) AS value FROM cells c, o GROUP BY 1, 2"""
)
def warp_grids(spark, sf_dir):
    """A leaning crop of 4 by 5 cells from each embedding as an 8 by 8 grid, partly outside of it."""
    frame = F.struct(G.point(F.lit(1.0), F.lit(1.5)).alias("origin"), G.point(F.lit(0.75), F.lit(0.5)).alias("r"), G.point(F.lit(-0.4), F.lit(1.2)).alias("a"), F.lit(4).alias("width"), F.lit(5).alias("height"))
    out = raster.warp(_table(spark, sf_dir, "embeddings").withColumn("frame", frame), "embedding", 8, "frame", ("vec_id",))
    return out.select("vec_id", F.col("pix").cast("int").alias("pix"), F.round("value", 5).alias("value"))


@query(
    """WITH p AS (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS b, (p_size * 5 % 256)::DOUBLE AS g, floor(p_retailprice)::BIGINT % 256::DOUBLE AS r FROM part)
    SELECT p_partkey, round((b / 255 - 0.485) / 0.229, 6) AS blue, round((g / 255 - 0.456) / 0.224, 6) AS green, round((r / 255 - 0.406) / 0.225, 6) AS red, round(b / 127.5 - 1, 6) AS rec_blue,
    least(255, greatest(0, round_even((b - 20) * 1.5, 0)))::INT AS stored FROM p"""
)
def pixel_planes(spark, sf_dir):
    """Pixels as the detector and the recogniser take them, and a blended one as it is stored."""
    b, g, r = (F.col("p_partkey") % 256).cast("double"), (F.col("p_size") * 5 % 256).cast("double"), (F.floor("p_retailprice") % 256).cast("double")
    det, rec = raster.detector_planes(b, g, r), raster.recogniser_planes(b, g, r)
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(det[0], 6).alias("blue"), F.round(det[1], 6).alias("green"), F.round(det[2], 6).alias("red"), F.round(rec[0], 6).alias("rec_blue"), raster.to_byte((b - 20) * 1.5).alias("stored"))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS s, -l_extendedprice / 100 AS tx, l_discount * 1000 - 50 AS ty, l_quantity AS z FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(400.0 / 1200 * z, 6) AS live_scale, round(200 - 600 * 400.0 / 1200 * z, 6) AS live_tx, round(s / (400.0 / 1200) * (700.0 / 1200), 6) AS new_scale,
      round(350 - (200 - tx) / s * (s / (400.0 / 1200) * (700.0 / 1200)), 6) AS new_tx, round(30 - (30 - tx) * exp(-ty / 300), 5) AS zoom_tx, round(tx + 7.5, 6) AS pan_tx, round(12 * s + ty, 6) AS screen_y FROM v"""
)
def view_moves(spark, sf_dir):
    """Views that are opened, turned, zoomed by the wheel and moved."""
    s, tx, ty = F.col("l_quantity") / 10, -F.col("l_extendedprice") / 100, F.col("l_discount") * 1000 - 50
    w, h, cw, ch = (F.lit(float(v)) for v in (400, 800, 1200, 900))
    live, turned = G.live_view(w, h, cw, ch, F.col("l_quantity")), G.resize_view(s, tx, ty, w, h, F.lit(700.0), F.lit(900.0), cw, ch)
    zoomed, moved, seen = G.zoom_at(s, tx, ty, G.wheel_factor(ty), F.lit(30.0), F.lit(40.0)), G.pan_by(s, tx, ty, F.lit(7.5), F.lit(0.0)), G.to_screen(s, tx, ty, F.lit(10.0), F.lit(12.0))
    cols = {"live_scale": (live["scale"], 6), "live_tx": (live["tx"], 6), "new_scale": (turned["scale"], 6), "new_tx": (turned["tx"], 6), "zoom_tx": (zoomed["tx"], 5), "pan_tx": (moved["tx"], 6), "screen_y": (seen["y"], 6)}
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, n).alias(name) for name, (c, n) in cols.items()))


# Recognition


def _band_reader():
    """A model that reads the blue of the middle of each step: 0 (or padding) is blank, 100 the first class, 200 the second."""

    def read(tensor):
        middle = np.rint((tensor[:, 0, 24, 3::8].astype(float) + 1) * 127.5)
        kind = np.where(middle == 100, 1, np.where(middle == 200, 2, 0))
        return np.choose(kind[..., None] == np.arange(4), [0.0625, np.array([0.8125, 0.75, 0.5, 0.8125])])

    return read


@query(
    """WITH RECURSIVE b AS (SELECT p_partkey, 12 * (1 + p_partkey % 2 * (1 + p_partkey % 4 // 2 * 2)) AS h, p_size + 3 AS n FROM part),
    bands AS (SELECT p_partkey, h, n, t.k, (p_partkey * (t.k + 1) + t.k) % 3 AS class FROM b, unnest(range(0, n)) AS t(k)),
    islands AS (SELECT *, k - row_number() OVER (PARTITION BY p_partkey, class ORDER BY k) AS island FROM bands),
    chars AS (SELECT p_partkey, any_value(h) AS h, any_value(n) AS n, class, min(k) AS k0, max(k) + 1 AS k1 FROM islands WHERE class > 0 GROUP BY p_partkey, class, island),
    near AS (SELECT *, (k0 + k1) / 2 AS mid, lag((k0 + k1) / 2) OVER w AS before, lead((k0 + k1) / 2) OVER w AS after FROM chars WINDOW w AS (PARTITION BY p_partkey ORDER BY k0)),
    spans AS (SELECT *, h / 3 * greatest(0, CASE WHEN before IS NOT NULL THEN (before + mid) / 2 WHEN after IS NOT NULL THEN mid - (after - mid) / 2 ELSE 0 END) AS x0,
      h / 3 * least(n, CASE WHEN after IS NOT NULL THEN (after + mid) / 2 WHEN before IS NOT NULL THEN mid + (mid - before) / 2 ELSE n END) AS x1 FROM near),
    own AS (SELECT p_partkey, 16 * n AS filled, (ceil(greatest(320, 16 * n) / 64) * 64)::INT AS wide FROM b)
    SELECT p_partkey, any_value(wide) AS wide, any_value(filled)::INT AS filled, string_agg(CASE class WHEN 1 THEN 'a' ELSE 'b' END, '' ORDER BY k0) AS text, round(avg(CASE class WHEN 1 THEN 0.75 ELSE 0.5 END), 9) AS score, round(min(x0), 6) AS first_x, round(max(x1), 6) AS last_x
    FROM spans JOIN own USING (p_partkey) GROUP BY p_partkey"""
)
def recognised_lines(spark, sf_dir):
    """Parts as crops of coloured bands, 12, 24 or 48 pixels high: batched by width class, scaled, padded, read by a model, and decoded."""
    high = (12 * (1 + F.col("p_partkey") % 2 * (1 + F.floor(F.col("p_partkey") % 4 / 2) * 2))).cast("int")
    bands = F.transform(F.sequence(F.lit(0), F.col("p_size") + 2), lambda k: ((F.col("p_partkey") * (k + 1) + k) % 3).cast("int"))
    colours = F.array(F.lit("000000FF"), F.lit("000064FF"), F.lit("0000C8FF"))
    row = F.array_join(F.transform("bands", lambda c: F.repeat(F.element_at(colours, c + 1), (F.col("height") / 3).cast("int"))), "")
    # Rows are small before they are drawn: without a number they would be put together in one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crops = _table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select("p_partkey", high.alias("height"), bands.alias("bands"))
    crops = crops.select("p_partkey", (F.size("bands") * F.col("height") / 3).cast("int").alias("width"), "height", F.unhex(F.repeat(row, F.col("height"))).alias("data"))
    read = materialized(recognition.recognised(crops, ["p_partkey"], recognition.Model("bands", _band_reader, (1, 3, 48, 320)), 4))
    origin, right, down = G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(1.0), F.lit(0.0)), G.point(F.lit(0.0), F.lit(1.0))
    frames = crops.select("p_partkey", F.struct(origin.alias("origin"), right.alias("r"), down.alias("a"), "width", "height", F.lit(False).alias("vertical")).alias("frame"))
    text = scan.lines_of_text(read, frames, ["p_partkey"], ["a", "b"])
    first, last = F.col("chars")[0]["quad"][0]["x"], F.element_at("chars", -1)["quad"][1]["x"]
    return text.join(read.drop("chars"), "p_partkey").select("p_partkey", "wide", "filled", "text", F.round("score", 9).alias("score"), F.round(first, 6).alias("first_x"), F.round(last, 6).alias("last_x"))


# Labels


@query(
    """WITH RECURSIVE lines AS (SELECT p_partkey // 6 AS image, (p_partkey % 6)::INT AS line_no, length(replace(p_name, ' ', '')) AS n, p_size::DOUBLE AS x, (p_partkey % 6 * 97 + p_partkey * 37 % 50)::DOUBLE AS y FROM part),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y, x, line_no) AS k FROM lines),
    tries AS (SELECT t.i AS try, 18::DOUBLE * (1::DOUBLE - 0.05::DOUBLE * (t.i // 2)) AS f, t.i % 2 = 0 AS after FROM range(22) AS t(i)),
    strips AS (SELECT image, k, try, f, n, x, CASE WHEN after THEN y + 40 + 0.15::DOUBLE * f ELSE y - 0.15::DOUBLE * f - 1.2::DOUBLE * f END AS text_y FROM ordered, tries),
    boxes AS (SELECT image, k, try, list_transform(range(n), lambda i: {'x0': x + 30 * i + 15 - (0.6::DOUBLE * f) / 2 - 0.15::DOUBLE * f, 'y0': text_y - 0.15::DOUBLE * f, 'x1': x + 30 * i + 15 - (0.6::DOUBLE * f) / 2 + 0.6::DOUBLE * f + 0.15::DOUBLE * f, 'y1': text_y + 1.2::DOUBLE * f + 0.15::DOUBLE * f}) AS b FROM strips),
    inside AS (SELECT *, len(list_filter(b, lambda s: s.x0 < 0 OR s.y0 < 0 OR s.x1 > 1500 OR s.y1 > 700)) = 0 AS fits FROM boxes),
    free AS (SELECT i.*, fits AND NOT EXISTS (SELECT 1 FROM ordered o WHERE o.image = i.image AND o.k <> i.k AND o.y < b[1].y1 AND b[1].y0 < o.y + 40 AND len(list_filter(b, lambda s: s.x0 < o.x + 30 * o.n AND o.x < s.x1)) > 0) AS open FROM inside i),
    choices AS (SELECT image, k, list({'try': try, 'b': b} ORDER BY try) FILTER (open) AS free, coalesce(min(try) FILTER (fits AND try < 2), 0) AS with_halo, list(b ORDER BY try) AS every FROM free GROUP BY image, k),
    walk(image, k, taken, chosen, halo) AS (SELECT DISTINCT image, 0::BIGINT, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[], 0::BIGINT, false FROM ordered UNION ALL
      SELECT image, k, list_concat(taken, every[coalesce(good, with_halo) + 1]), coalesce(good, with_halo), good IS NULL FROM (
        SELECT c.*, w.taken, list_min(list_transform(list_filter(c.free, lambda t: len(list_filter(w.taken, lambda o: o.y0 < t.b[1].y1 AND t.b[1].y0 < o.y1 AND len(list_filter(t.b, lambda s: s.x0 < o.x1 AND o.x0 < s.x1)) > 0)) = 0), lambda t: t.try)) AS good
        FROM walk w JOIN choices c ON c.image = w.image AND c.k = w.k + 1))
    SELECT image, line_no, CASE WHEN chosen % 2 = 0 THEN 'after' ELSE 'before' END AS side, round(1 - 0.05 * (chosen // 2), 2)::DOUBLE AS scale, halo FROM walk JOIN ordered USING (image, k)"""
)
def place_labels(spark, sf_dir):
    """Six parts' names as lines of an image: side and scale of each line's labels, and whether they have a halo."""
    letters = F.split(F.regexp_replace("p_name", " ", ""), "")
    y = ((F.col("p_partkey") % 6) * 97 + F.col("p_partkey") * 37 % 50).cast("double")
    corners = F.array(*(F.lit(float(v)) for v in (0, 0, 30, 0, 30, 40, 0, 40)))
    chars = F.transform(F.slice(letters, F.lit(1), F.length(F.regexp_replace("p_name", " ", ""))), lambda c, k: F.struct(c.alias("reading"), F.transform(corners, lambda v, i: v + F.when(i % 2 == 0, k * 30.0 + F.col("p_size")).otherwise(y)).alias("quad")))
    # Rows are small before their characters are drawn: without a number they would be put together in one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(tasks, "p_partkey")
    lines = parts.select(F.floor(F.col("p_partkey") / 6).alias("image"), F.lit(1500.0).alias("width"), F.lit(700.0).alias("height"), (F.col("p_partkey") % 6).cast("int").alias("line_no"), F.lit(False).alias("vertical"), chars.alias("chars"))
    return layout.place_labels(lines, "image").withColumn("scale", F.round("scale", 2))


# States and messages

_KINDS = """CASE event_type || (event_id % 4) WHEN 'signup0' THEN 'start' WHEN 'signup1' THEN 'engine-ready' WHEN 'signup2' THEN 'dict-ready' WHEN 'signup3' THEN 'toggle-readings'
  WHEN 'view0' THEN 'freeze' WHEN 'view1' THEN 'freeze' WHEN 'view2' THEN 'progress' WHEN 'view3' THEN 'open-about' WHEN 'click0' THEN 'scan-done' WHEN 'click1' THEN 'scan-done' WHEN 'click2' THEN 'show-card' WHEN 'click3' THEN 'scan-failed'
  WHEN 'purchase0' THEN 'resume' WHEN 'purchase1' THEN 'notice' WHEN 'purchase2' THEN 'close-card' WHEN 'purchase3' THEN 'dismiss-notice' WHEN 'error0' THEN 'back' WHEN 'error1' THEN 'start' WHEN 'error2' THEN CASE WHEN event_id % 60 = 2 THEN 'fatal' ELSE 'dict-failed' END ELSE 'close-about' END"""
_PAYLOAD = {"kind": _KINDS, "message": "'m' || event_id", "card": "'c' || event_id", "line_count": "CAST(event_id % 3 AS INT)", "source": "CASE WHEN event_id % 8 = 2 THEN 'engine' ELSE 'camera' END"}
_EVENT = f"e AS (SELECT user_id, event_id, value, {', '.join(f'{v} AS {k}' for k, v in _PAYLOAD.items())} FROM events)"


@query(
    f"""WITH RECURSIVE {_EVENT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
    f(user_id, k, screen, engine, progress, error_kind, error_message, notice, card, about, dictionary, readings_shown) AS (
      SELECT DISTINCT user_id, 0::BIGINT, 'intro', 'loading', 0.0::DOUBLE, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false, 'loading', true FROM events UNION ALL
      SELECT f.user_id, n.k,
        CASE WHEN kind = 'start' AND screen = 'intro' THEN 'live' WHEN kind = 'freeze' AND screen = 'live' AND engine = 'ready' THEN 'scanning' WHEN kind = 'scan-done' AND screen = 'scanning' THEN 'frozen' WHEN kind = 'scan-failed' AND screen = 'scanning' THEN 'live'
          WHEN kind = 'resume' AND screen = 'frozen' THEN 'live' WHEN kind = 'back' AND screen IN ('live', 'frozen') THEN 'intro' WHEN kind = 'fatal' THEN 'error' ELSE screen END,
        CASE WHEN kind = 'engine-ready' THEN 'ready' WHEN kind = 'fatal' AND source = 'engine' THEN 'failed' ELSE engine END,
        CASE kind WHEN 'progress' THEN value WHEN 'engine-ready' THEN 1.0 ELSE progress END, CASE kind WHEN 'fatal' THEN source ELSE error_kind END, CASE kind WHEN 'fatal' THEN message ELSE error_message END,
        CASE WHEN kind = 'freeze' AND screen = 'live' AND engine = 'ready' THEN NULL WHEN kind = 'scan-done' AND screen = 'scanning' THEN CASE WHEN line_count = 0 THEN '{reducer.NOTHING_FOUND}' END WHEN kind = 'scan-failed' AND screen = 'scanning' THEN '{reducer.SCAN_FAILED}'
          WHEN kind = 'resume' AND screen = 'frozen' THEN NULL WHEN kind = 'back' AND screen IN ('live', 'frozen') THEN NULL WHEN kind = 'notice' THEN message WHEN kind = 'dismiss-notice' THEN NULL ELSE notice END,
        CASE WHEN kind = 'resume' AND screen = 'frozen' THEN NULL WHEN kind = 'back' AND screen IN ('live', 'frozen') THEN NULL WHEN kind = 'show-card' AND screen = 'frozen' THEN n.card WHEN kind = 'close-card' THEN NULL ELSE f.card END,
        CASE kind WHEN 'open-about' THEN true WHEN 'close-about' THEN false ELSE about END, CASE kind WHEN 'dict-ready' THEN 'ready' WHEN 'dict-failed' THEN 'failed' ELSE dictionary END, readings_shown <> (kind = 'toggle-readings')
      FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
    SELECT * EXCLUDE (k) FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""
)
def app_states(spark, sf_dir):
    """Users' events as all kinds of events of the app; every field of the state after the last."""
    rows = _table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "value", *(f"{v} AS {k}" for k, v in _PAYLOAD.items()))
    return reducer.reduce_events(rows, "user_id", "event_id")


_MESSAGES = "m AS (SELECT user_id, event_id, ts, value, CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'scan' WHEN 'click' THEN 'load' WHEN 'purchase' THEN 'lookup' ELSE 'ping' END AS type FROM events)"


def _messages(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "init").when(F.col("event_type") == "view", "scan").when(F.col("event_type") == "click", "load").when(F.col("event_type") == "purchase", "lookup").otherwise("ping")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", kind.alias("type"))


@query(
    f"""WITH {_MESSAGES}, c AS (SELECT *, CASE WHEN type IN ('init', 'scan') THEN count_if(type = 'init') OVER w WHEN type IN ('load', 'lookup') THEN count_if(type = 'load') OVER w END::INT AS engine FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, engine, CASE WHEN type = 'ping' THEN 'unknown type: ping' WHEN engine = 0 THEN 'not started' END AS message, CASE WHEN type = 'ping' OR engine = 0 THEN 'error' WHEN type IN ('init', 'load') THEN 'ready' ELSE 'result' END AS reply FROM c"""
)
def dispatch_messages(spark, sf_dir):
    """Users' events as messages to two workers: each with its one reply."""
    return messages.dispatched(_messages(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "engine", "message", "reply")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, ts + to_seconds((value * 3600)::BIGINT) AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
    f(user_id, k, event_id, accepted, flight, until) AS (SELECT user_id, k, event_id, true, event_id, done FROM e WHERE k = 1 UNION ALL
      SELECT e.user_id, e.k, e.event_id, e.ts >= f.until, CASE WHEN e.ts >= f.until THEN e.event_id ELSE f.flight END, CASE WHEN e.ts >= f.until THEN e.done ELSE f.until END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id, accepted, flight FROM f"""
)
def single_flight(spark, sf_dir):
    """Users' events as requests that take their value in hours: one runs at a time, others share or miss it."""
    rows = _table(spark, sf_dir, "events").where("value is not null")
    rows = rows.withColumn("done", F.col("ts") + F.make_dt_interval(secs=(F.round(F.col("value") * 3600)).cast("decimal(18,6)")))
    return messages.one_at_a_time(rows, "user_id", "ts", "done", "event_id")


#: All lines of an order, numbered; lines that are equal in all these are equal in what is made of them.
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
_NUMBERED = f"numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)}) AS n FROM lineitem)"


def _numbered_lines(spark, sf_dir):
    return ranges.running(_table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE), ["l_orderkey"], list(_LINE), sums={"n": F.lit(1).cast("long")})


@query(
    f"""WITH {_NUMBERED}, r AS (SELECT l_orderkey, n, l_shipdate AS sent, CASE WHEN l_discount < 0.08 THEN l_shipdate + to_seconds((l_quantity * 10)::BIGINT) END AS came FROM numbered),
    t AS (SELECT *, came IS NULL OR came > sent + INTERVAL 300 SECOND AS timed_out FROM r)
    SELECT l_orderkey, n, timed_out, coalesce(count_if(timed_out) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS worker FROM t"""
)
def watch_requests(spark, sf_dir):
    """Lines of orders as requests with a limit of 300 seconds: which timed out, and on which worker they ran."""
    asked = _numbered_lines(spark, sf_dir)
    answers = asked.where("l_discount < 0.08").select("l_orderkey", "n", (F.col("l_shipdate") + F.make_dt_interval(secs=(F.col("l_quantity") * 10).cast("decimal(18,6)"))).alias("came"))
    out = messages.watched(asked.select("l_orderkey", "n", F.col("l_shipdate").alias("sent")), answers, ["l_orderkey"], "n", "sent", "came", F.expr("INTERVAL 300 SECONDS"))
    return out.select("l_orderkey", "n", "timed_out", "worker")


@query(
    f"""WITH {_NUMBERED}, a AS (SELECT l_orderkey, n, l_discount > 0.05 AS ok, row_number() OVER w AS attempt, coalesce(count_if(l_discount > 0.05) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good FROM numbered WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
    SELECT l_orderkey, n, ok, attempt::INT AS attempt, (CASE WHEN attempt = 1 THEN 0 ELSE 500 * 2 ** (attempt - 2) END)::DOUBLE AS wait_ms FROM a WHERE good = 0 AND attempt <= 3"""
)
def retry_schedule(spark, sf_dir):
    """Lines of orders as attempts that go on until one is good."""
    rows = _numbered_lines(spark, sf_dir).withColumn("ok", F.col("l_discount") > 0.05)
    return messages.backoff(rows, ["l_orderkey"], "n", "ok").select("l_orderkey", "n", "ok", F.col("attempt").cast("int").alias("attempt"), "wait_ms")


@query(
    f"WITH {_NUMBERED} SELECT l_orderkey, n, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY n) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS fraction FROM numbered"
)
def load_progress(spark, sf_dir):
    rows = _numbered_lines(spark, sf_dir)
    out = messages.progress(rows, rows, ["l_orderkey"], "n", "n", "l_quantity", "l_quantity")
    return out.select("l_orderkey", "n", F.round("fraction", 9).alias("fraction"))


@query("SELECT conv_id, octet_length(encode(string_agg(text, '' ORDER BY turn)))::BIGINT AS size, sha256(string_agg(text, '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def reassembled_files(spark, sf_dir):
    """Conversations as files that come in chunks."""
    chunks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    return messages.reassembled(chunks, ["conv_id"], "turn", "data").select("conv_id", "size", F.sha2("content", 256).alias("sha256"))


_POINTER = "CASE (n - 1) % 7 + 1 WHEN 1 THEN 'down' WHEN 3 THEN 'down' WHEN 6 THEN 'up' WHEN 7 THEN 'up' ELSE 'move' END"
_WHICH = "CASE WHEN (n - 1) % 7 + 1 IN (3, 4, 6) THEN 1 ELSE 0 END"


@query(
    f"""WITH {_NUMBERED}, p AS (SELECT l_orderkey, n, {_WHICH} AS pointer, {_POINTER} AS kind, l_quantity AS x, l_extendedprice AS y FROM numbered),
    c AS (SELECT *, CASE kind WHEN 'down' THEN 1 WHEN 'up' THEN -1 ELSE 0 END AS change, min(pointer) OVER (PARTITION BY l_orderkey) AS first FROM p),
    a AS (SELECT *, sum(change) OVER w AS active, sum(abs(change)) OVER w AS island, last_value(CASE WHEN pointer = first THEN x END IGNORE NULLS) OVER w AS ax, last_value(CASE WHEN pointer = first THEN y END IGNORE NULLS) OVER w AS ay,
      last_value(CASE WHEN pointer <> first THEN x END IGNORE NULLS) OVER w AS bx, last_value(CASE WHEN pointer <> first THEN y END IGNORE NULLS) OVER w AS yb FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT l_orderkey, n, active, island, CASE WHEN active = 2 THEN (ax + bx) / 2 ELSE x END AS mx, CASE WHEN active = 2 THEN (ay + yb) / 2 ELSE y END AS my, CASE WHEN active = 2 THEN sqrt((ax - bx) * (ax - bx) + (ay - yb) * (ay - yb)) END AS far FROM a WHERE kind = 'move' AND active > 0)
    SELECT l_orderkey, n, active::BIGINT AS active, round(mx - lag(mx) OVER v, 6) AS dx, round(my - lag(my) OVER v, 6) AS dy, round(CASE WHEN lag(far) OVER v <> 0 THEN far / lag(far) OVER v END, 6) AS ratio FROM m WINDOW v AS (PARTITION BY l_orderkey, island ORDER BY n)"""
)
def pointer_moves(spark, sf_dir):
    """Lines of orders as what two pointers do: one drags, both pinch, one drags on."""
    rows = _numbered_lines(spark, sf_dir).select("l_orderkey", "n", F.expr(_WHICH).alias("pointer"), F.expr(_POINTER).alias("kind"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = messages.pointer_moves(rows, "l_orderkey", "n", "pointer", "kind", "x", "y")
    return out.select("l_orderkey", "n", F.col("active").cast("long").alias("active"), *(F.round(c, 6).alias(c) for c in ("dx", "dy", "ratio")))
