"""Line-first quality rules in DataFrame functions only.

Every line is judged by itself: navigation (cells between bars), punctuation (symbols or
doubled exclamation marks in place of prose) and boilerplate (stock phrases of web pages).
Failing lines and repeats of earlier lines are removed, and a document that loses too much
of its text is rejected. Base counts over the whole text come first and reject by themselves.

All work on a document happens in its own row: no shuffle, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS, LINE_SYMBOLS = r"[#*$%&|<>]", r"[#*$%&<>]"
#: Fixed thresholds: least words, percent of words in repeated windows, percent of words that must remain.
LEAST_WORDS, MOST_REPEATED, LEAST_KEPT = 10, 20, 50
#: Bars of a navigation line, percent of its words; percent of symbols or "!!" to words of a line.
LEAST_BARS, BAR_PERCENT, SYMBOL_PERCENT, SHOUT_PERCENT = 3, 20, 30, 30
#: A boilerplate line has a stock phrase and at most so many words.
STOCK = r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|click here|read more|log ?in|sign (in|up)|subscribe|lorem ipsum|skip to content|share this|back to top)\b"
STOCK_WORDS = 20
WINDOW = 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs more than once, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        near = lambda k: F.get(pairs, k)["h"]
        again = F.filter(pairs, lambda p, k: (p["h"] == near(k - 1)) | (p["h"] == near(k + 1)))
        starts = F.sort_array(F.transform(again, lambda p: p["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, at: F.struct((a["n"] + F.least(F.lit(WINDOW), at - a["last"])).alias("n"), at.alias("last")),
            lambda a: a["n"],
        )

    once = F.size(hashes) == F.size(F.array_distinct(hashes))
    return F.when(once, 0).otherwise(F.element_at(F.transform(F.array(pairs), covered), 1))


def _bad_line(line: Column) -> Column:
    n = F.size(_words(line))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    navigation = (bars >= LEAST_BARS) & (bars * 100 >= n * BAR_PERCENT)
    symbols = _count(line, LINE_SYMBOLS) * 100 >= n * SYMBOL_PERCENT
    shouting = (shouts > 0) & (shouts * 100 >= n * SHOUT_PERCENT)
    return navigation | symbols | shouting | ((n <= STOCK_WORDS) & line.rlike(STOCK))


#: Columns of the result.
RESULTS = ("q_n_words", "q_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_left", "q_text", "q_base_failed", "q_kept")


def _judged(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs``, named ``c0``, ``c1`` and so on, and the results."""
    df = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    df = df.withColumns({"q_words": _words(text), "q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), "q_symbols": _count(text, SYMBOLS)})
    df = df.withColumns(
        {
            "q_n_words": F.size("q_words"),
            "q_chars": F.length(F.array_join("q_words", "")),
            "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
            "q_distinct": F.array_distinct("q_lines"),
            "q_n_lines": F.size("q_lines"),
        }
    ).drop("q_words", "q_lines")
    windows = F.transform(
        F.sequence(F.lit(0), F.col("q_n_words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("q_hashes"), i + k) for k in range(WINDOW)])
    )
    df = df.withColumns(
        {
            "q_windows": F.when(F.col("q_n_words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
            "q_dup_lines": F.col("q_n_lines") - F.size("q_distinct"),
            "q_text": F.array_join(F.filter("q_distinct", lambda x: ~_bad_line(x)), "\n"),
        }
    ).drop("q_hashes", "q_distinct", "q_n_lines")
    df = df.withColumns({"q_repeat_words": repeated_words(F.col("q_windows")), "q_left": F.size(_words(F.col("q_text")))}).drop("q_windows")
    failed = (F.col("q_n_words") < LEAST_WORDS) | (F.col("q_repeat_words") * 100 > F.col("q_n_words") * MOST_REPEATED)
    lost = F.col("q_left") * 100 < F.col("q_n_words") * LEAST_KEPT
    return df.withColumns({"q_base_failed": failed, "q_kept": ~failed & ~lost})


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``RESULTS``: counts, verdicts and ``q_text``, the lines that passed.

    A null or empty text has no words and fails the base rules. Texts are read whole, and
    every row is judged alone, so repeated rows and null ids are rows like others, and an
    empty table gives an empty result. Columns with the names of results are replaced, all
    others pass through. Windows of words are compared by a 64-bit hash of 64-bit hashes:
    two different ones of a text are taken for equal with a probability near 2**-63.
    """
    taken = {c.lower() for c in RESULTS}
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken]
    return _judged(docs, text_col).select(*own, *RESULTS)


def keep_clean(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Rows that are kept, their text without the failing lines; ``length_col`` is brought up to date.

    All other columns pass through, whatever their names. The verdict passes through a
    generator of one row, so that the filter is not pushed down and the rules are not
    evaluated twice.
    """
    verdict = F.explode(F.array(F.struct("q_kept", "q_text"))).alias("q")
    kept = _judged(docs, text_col).select(*[f"c{i}" for i in range(len(docs.columns))], verdict).where("q.q_kept")
    changed = {text_col: F.col("q.q_text")} | ({length_col: F.length("q.q_text").cast("long")} if length_col else {})
    return kept.select(*[changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
