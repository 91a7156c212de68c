"""Line-first quality rules, DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go; a document
that loses more than `most_loss` of its words goes too. Everything is local to a row: no shuffle.

Defined results: a null, empty or blank text has no words and fails the base rules; a text of any
length is taken whole; repeated rows are judged alike; an empty table gives an empty table; extra
columns of the input are kept by `clean_lines` and its own columns may be renamed with `prefix`.
Five-word windows are compared by a 64-bit hash of their words' hashes within one text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import SPACE, words_of

SYMBOLS = "#*$%&|<>"
#: A kept line's last character, white space aside, is one of these.
TERMINALS = ".!?…:;\"'”’»)]。！？；：」』؟।"
BLANKS = " \t\n\x0b\f\r"
# Stock phrases of web pages in English, Spanish, French and German, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "javascript", "log in", "lorem ipsum", "privacy policy", "read more", "sign up", "subscribe now", "terms of service", "terms of use",
    "aviso legal", "haga clic aquí", "iniciar sesión", "leer más", "política de cookies", "política de privacidad", "todos los derechos reservados", "términos de uso",
    "cliquez ici", "conditions d'utilisation", "lire la suite", "mentions légales", "politique de confidentialité", "se connecter", "tous droits réservés",
    "alle rechte vorbehalten", "datenschutzerklärung", "hier klicken", "jetzt anmelden", "mehr lesen", "nutzungsbedingungen",
)
NAVIGATION = "|»›•"


def count_of(text: Column, chars: str) -> Column:
    """How many of the characters a text has. A regular expression scans faster than translate, which looks up every character."""
    these = "".join(f"\\{c}" if c.isascii() else c for c in chars)
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{these}]", ""))).cast("long")


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def windows_of(hashes: Column) -> Column:
    """array<struct<h,i>>: a hash of every five-word window and its place."""
    place = F.when(F.size(hashes) >= 5, F.sequence(F.lit(0), F.size(hashes) - 5)).otherwise(F.array().cast("array<int>"))
    return F.transform(place, lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]).alias("h"), i.alias("i")))


def repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from windows sorted by hash."""
    n = F.size(windows)

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(windows, k - 1)["h"] == x["h"], F.get(windows, k + 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    hit = F.sort_array(F.transform(F.filter(windows, repeated), lambda x: x["i"]))
    covered = F.aggregate(
        hit,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return F.when(n > 1, covered).otherwise(F.lit(0).cast("long"))


def failed_rule(line: Column, words: Column) -> Column:
    """The first rule a line fails, or null: punctuation, navigation or boilerplate.

    A boilerplate phrase counts where no letter or digit adjoins it. _stock tells whether the text holds one's
    characters at all; its lines are searched only then.
    """
    symbol = count_of(line, SYMBOLS) * 10 > words * 3
    shout = count_of(line, "!?") * 10 > words * 3
    shout = shout & (count_of(line, "!?") > 1)
    menu = (count_of(line, NAVIGATION) >= 2) & (count_of(line, NAVIGATION) * 6 >= words)
    apart = r"(^|[^\p{L}\p{N}])(%s)($|[^\p{L}\p{N}])" % "|".join(BOILERPLATE)
    stock = F.col("_stock") & F.lower(line).rlike(apart)
    return (
        F.when(menu, "navigation").when(symbol | shout | ~F.lit(TERMINALS).contains(F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1)), "punctuation").when(stock, "boilerplate")
    )


def clean_lines(df: DataFrame, text: str = "text", most_loss: float = 0.5, prefix: str = "") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost_words, n_failed_lines and clean_text (the kept lines joined by \\n; null for a null text)."""
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "n_failed_lines", "clean_text"]
    own = [f"{prefix}{c}" for c in out]
    clash = {c.lower() for c in own} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}; give a prefix")
    t = F.col(f"`{text}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), t.alias("_text"))
    rows = rows.withColumns({"_words": words_of(F.coalesce("_text", F.lit(""))), "_lines": F.split(F.coalesce("_text", F.lit("")), "\n")})
    rows = rows.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_judged": F.transform("_lines", lambda x: F.struct(x.alias("line"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).cast("long").alias("n"))),
        "n_words": F.size("_words").cast("long"),
        **base_columns(F.coalesce("_text", F.lit("")), F.col("_words")),
        "_stock": functools.reduce(lambda a, b: a | b, [F.lower(F.coalesce("_text", F.lit(""))).contains(p) for p in BOILERPLATE]),
    })
    rows = rows.withColumns({
        "_windows": windows_of(F.col("_hashes")),
        "_judged": F.transform("_judged", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), F.when(x["n"] > 0, failed_rule(x["line"], x["n"])).alias("rule"))),
    })
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct(F.transform("_windows", lambda x: x["h"]))) == F.size("_windows"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array("_windows")))
    lost = F.aggregate(F.filter("_judged", lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = rows.withColumns({
        "n_repeat_words": repeated_words(F.col("_sorted")),
        "lost_words": lost,
        "n_failed_lines": F.size(F.filter("_judged", lambda x: x["rule"].isNotNull())).cast("long"),
        "clean_text": F.when(F.col("_text").isNotNull(), F.array_join(F.transform(F.filter("_judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.lit(float(most_loss)) * F.col("n_words")))
    return rows.select("_row.*", *[F.col(c).alias(f"{prefix}{c}") for c in out])
