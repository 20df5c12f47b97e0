"""What a screen shows, as columns of its states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The length of the ring around the shutter, whose radius is 32.
RING = 64 * 3.141592653589793


def shutter_mode(screen: Column, engine: Column) -> Column:
    return F.when(screen == "scanning", "busy").when(screen == "frozen", "resume").when(engine == "ready", "freeze").otherwise("loading")


def screen_views(states: DataFrame, hints: dict[str, str]) -> DataFrame:
    """States (screen, engine, progress, notice, pinyin_visible, error: kind and message, about) with what is shown of each.

    ``hints`` has a text for each kind of error; the error's own message follows
    in brackets. A kind without a hint shows its message alone. Null progress
    counts as none, a null notice as empty.
    """
    screen, kind, message = F.col("screen"), F.col("error.kind"), F.nullif(F.col("error.message"), F.lit(""))
    hint = F.lit(None).cast("string")
    for name, text in hints.items():
        hint = F.when(kind == name, text).otherwise(hint)
    mode = shutter_mode(screen, F.col("engine"))
    shown = {
        "mode": mode,
        "shutter_shown": screen.isin("live", "scanning", "frozen"),
        "shutter_enabled": mode.isin("freeze", "resume"),
        "ring_offset": RING * (1 - F.coalesce(F.col("progress"), F.lit(0.0))),
        "notice_text": F.coalesce("notice", F.lit("")),
        "toggle_shown": screen == "frozen",
        "toggle_off": ~F.col("pinyin_visible"),
        "back_shown": screen.isin("live", "frozen"),
        "error_text": F.when(kind.isNotNull(), F.coalesce(F.concat(hint, F.lit(" ("), message, F.lit(")")), hint, message, F.lit(""))),
        "retry_shown": kind.isNotNull() & (F.coalesce(kind, F.lit("")) != "unsupported"),
        "reset_shown": F.coalesce(kind, F.lit("")) == "engine",
        "about_shown": F.coalesce(F.col("about"), F.lit(False)),
    }
    return states.withColumns(shown)


def debug_lines(version: Column, start_ms: Column, region: Column, timings: Column, error: Column, none: str = "–") -> Column:
    """Lines of a debug panel: version, start, last scan (region: width and height; timings: total, det, rec, post) and last error."""
    ms = lambda c: F.when(c.isNull(), none).otherwise(F.concat(F.floor(c + 0.5).cast("string"), F.lit(" ms")))
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    size = F.coalesce(F.concat_ws("×", region["width"].cast("string"), region["height"].cast("string")), F.lit(none))
    stages = F.concat_ws(", ", *(F.concat(F.lit(f"{s} "), ms(timings[s])) for s in ("det", "rec", "post")))
    scan = F.concat(F.lit("scan "), F.when(region.isNull(), none).otherwise(size), F.lit(": "), ms(timings["total"]), F.lit(" ("), stages, F.lit(")"))
    return F.array(F.concat(F.lit("version "), known(version)), F.concat(F.lit("start "), ms(start_ms)), scan, F.concat(F.lit("error "), known(error)))
