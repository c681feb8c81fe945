"""Line-first quality rules, in DataFrame functions only.

Every line of a text is judged on its own: punctuation (too many marks and symbols, or a longer line without any
stop), navigation (separators between short items, menu words) and boilerplate (licences, cookies, rights).
Failing lines are removed; a document that loses more than LEAST_LEFT allows is rejected.

Words are runs of anything but space and tab to carriage return. Null and empty texts have no words: all
counts are 0, base_failed is true and kept false. Repeated rows each get a row. Windows of eight words are
compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line fails above this share of marks among its characters, or if it has so many words and ends without a stop.
MOST_MARKS, STOPLESS_WORDS = 0.25, 12
#: Share of a text's word characters that its good lines must hold.
LEAST_LEFT = 0.5
NAVIGATION = r"(?i)(?:[|»›•·→]\s*\S[^|»›•·→]*){3}|^\W*(?:home|menu|login|log in|sign in|sign up|search|contact|about us|next|previous|back to top|share|print|read more)\W*$"
BOILERPLATE = r"(?i)all rights reserved|licen[sc]ed under|copyright \(c\)|©|cookie|privacy policy|terms of (?:use|service)|subscribe to|javascript"
MARKS = r"[\p{Punct}\p{S}]"
STOP = r"[.!?;:,\"'”»…)\]]\s*$"


def line_passes(line: Column) -> Column:
    """The verdict on one line."""
    marks = F.regexp_count(line, F.lit(MARKS))
    letters = F.char_length(F.translate(line, WHITE_CHARACTERS, ""))
    stopless = ~line.rlike(STOP) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= STOPLESS_WORDS)
    return ~((marks > MOST_MARKS * letters) | stopless | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE))


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with n_words and win, the hashes of the windows."""
    rows = rows.withColumn("pairs", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs, size = F.col("pairs"), F.size("pairs")
    none = F.array(F.lit(None).cast("bigint"))
    hashes = F.transform(pairs, lambda p: p["h"])
    beside = F.zip_with(F.concat(none, F.slice(hashes, F.lit(1), size - 1)), F.concat(F.slice(hashes, F.lit(2), size - 1), none), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    again = F.zip_with(pairs, beside, lambda p, q: F.when(p["h"].eqNullSafe(q["a"]) | p["h"].eqNullSafe(q["b"]), p["i"]))
    rows = rows.withColumn("at", F.when(pairs.isNotNull(), F.array_sort(F.array_compact(again))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n = F.aggregate("at", start, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")))["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(n, F.lit(0)).cast("long"))


def assess(docs: DataFrame, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and left_chars: word characters in good lines."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", WHITE + "+"), lambda w: w != ""))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words").cast("long")).drop("words")
    shifted = F.arrays_zip(*(F.slice("hashes", F.lit(k + 1), F.size("hashes") - WINDOW + 1) for k in range(WINDOW)))
    windows = F.transform(shifted, lambda w: F.xxhash64(*(w[str(k)] for k in range(WINDOW))))
    rows = rows.withColumn("win", F.when(F.col("n_words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    rows = _repeated(rows).drop("win", "pairs", "at")
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    left = F.aggregate(F.filter("lines", line_passes), F.lit(0), lambda a, x: a + F.char_length(F.translate(x, WHITE_CHARACTERS, "")))
    rows = rows.select(
        "doc_id", "n_words", F.char_length(F.translate("t", WHITE_CHARACTERS, "")).cast("long").alias("word_chars"), (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", left.cast("long").alias("left_chars"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("left_chars") >= least_left * F.col("word_chars")))


def cleaned(docs: DataFrame, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that are kept by the line rules, with their failing lines removed; all columns stay."""
    good = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x))
    rows = docs.select(F.struct("*").alias("row"), F.array_join(good, "\n").alias("left"))  # no column of docs can clash
    size = lambda c: F.char_length(F.translate(c, WHITE_CHARACTERS, ""))
    kept = rows.filter((size("row.text") > 0) & (size("left") >= least_left * size("row.text")))
    return kept.select(*(F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
