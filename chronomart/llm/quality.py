"""Line-first cleaning with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE_RUN, SPACES

#: What marks a line as boilerplate, in English, German, French and Spanish.
BOILERPLATE = (
    "licensed under the",
    "is licensed under",
    "released under the",
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "subscribe to our newsletter",
    "click here",
    "sign up",
    "log in",
    "lizenziert unter",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerkl",
    "cookies akzeptieren",
    "newsletter abonnieren",
    "hier klicken",
    "sous licence",
    "tous droits réservés",
    "conditions d'utilisation",
    "politique de confidentialité",
    "accepter les cookies",
    "cliquez ici",
    "bajo licencia",
    "todos los derechos reservados",
    "condiciones de uso",
    "política de privacidad",
    "aceptar cookies",
    "haga clic aquí",
)
#: What separates the entries of a navigation line.
BARS = "|>»·•"
SYMBOLS = "#*$%&|<>"


def _no_space(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _line_fails(line: Column, symbol_share: float, nav_bars: int, boilerplate_chars: int) -> Column:
    chars = F.length(_no_space(line))
    marks = chars - F.length(F.translate(_no_space(line), SYMBOLS + "!", ""))
    punctuation = marks > symbol_share * chars
    bars = F.length(line) - F.length(F.translate(line, BARS, ""))
    navigation = (bars >= nav_bars) & (bars * 20 > chars)
    boilerplate = (F.length(line) <= boilerplate_chars) & F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def quality_rules(
    docs: DataFrame,
    *,
    symbol_share: float = 0.08,
    nav_bars: int = 3,
    boilerplate_chars: int = 200,
    max_lost: float = 0.3,
    min_words: int = 50,
    max_repeat_share: float = 0.5,
) -> DataFrame:
    """Judge lines first, then documents by what their failed lines hold.

    A line (split at newlines) fails if over symbol_share of its characters are marks, if it is a bar-separated
    navigation line, or if it is a short boilerplate line. A document fails the base rules (too few words, or too many
    words in repeated three-word windows), or loses over max_lost of its characters with its failed lines.
    Windows of three words are compared by 64-bit hashes within one document.

    Null and empty texts have no words, fail the base rules and keep nothing; each row is judged alone, so
    repeated rows give repeated rows; other columns are left out; an empty table gives an empty table.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars
    (long), base_failed, kept (boolean), clean_text (the lines that passed, joined by newlines).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id"), text.alias("_t"))
    trimmed = F.btrim(F.col("_t"), F.lit(SPACES))
    d = d.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)))
    n = F.size("_w")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    d = d.withColumn("_h", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("n_words", n.cast("long")).drop("_w")
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_h")
    again = F.filter("_s", lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_s")
    covered = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("_p")
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("_bad", F.filter("_l", lambda x: _line_fails(x, symbol_share, nav_bars, boilerplate_chars)))
    flat = _no_space(F.col("_t"))
    d = d.withColumn("word_chars", F.length(flat).cast("long"))
    lost = F.aggregate("_bad", F.lit(0).cast("long"), lambda a, x: a + F.length(_no_space(x)))
    d = d.withColumns(
        {
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_failed_lines": F.size("_bad").cast("long"),
            "lost_chars": lost,
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat_share * F.col("n_words")),
        }
    )
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars")))
    clean = F.array_join(F.filter("_l", lambda x: ~_line_fails(x, symbol_share, nav_bars, boilerplate_chars)), "\n")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_failed_lines", "lost_chars", "base_failed", "kept", clean.alias("clean_text"),
    )
