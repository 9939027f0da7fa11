"""Quality rules as a bitmask ledger, in DataFrame operations alone.

Every rule is evaluated once over a text; the ledger keeps the measurements and one bit per rule
that failed. A policy is a versioned set of rules, so applying it, or asking what each rule changes,
reads the ledger's bits and never the texts again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANK

#: (name, when it fails). A rule's bit is its place, so rules are only ever added at the end.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines > 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "5 * n_shouted > n_words"),
    ("few_letters", "2 * n_letter_words < n_words"),
    ("torn_lines", "n_lines > 0 and n_words < 2 * n_lines"),
    ("very_long", "n_words > 1000000"),
)
#: Versioned policies: the rules of which none may fail.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "prose-1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting", "few_letters"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted", "n_letter_words")
WORD_START, WORD_END, IN_WORD = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])", r"[^\x20\x09-\x0D\p{L}]*+"


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, and ``MEASURES`` as long). Null text has no words; lines count if they hold a word.

    For n_repeat_words, three-word windows are compared by a 64-bit hash. Sorted with their places,
    equal ones are neighbours; each of their places, in order, covers up to three words more.
    """
    # Counted by expressions that look at each character a fixed number of times, whatever the text.
    count = lambda form: F.regexp_count("text", F.lit(form)).cast("long")
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = texts.select(
        "id",
        F.array_remove(F.split("text", f"{BLANK}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(f"{WORD_START}{IN_WORD}\\p{{Lu}}{{2,}}+{IN_WORD}{WORD_END}").alias("n_shouted"),
        count(f"{WORD_START}{IN_WORD}\\p{{L}}").alias("n_letter_words"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    counted = split.select(
        "id", "n_symbols", "n_shouted", "n_letter_words",
        F.size("words").cast("long").alias("n_words"), F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, hashed).alias("hashes"),
    )
    # Only texts with a repeated window need the places.
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    windows = counted.select(*(x for x in counted.columns if x != "hashes"), F.sort_array(F.when(repeats, F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("windows"))
    twice = lambda x, k: F.coalesce(F.get("windows", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("windows", k + 1)["h"] == x["h"], F.lit(False))
    placed = windows.select(*(x for x in windows.columns if x != "windows"), F.sort_array(F.transform(F.filter("windows", twice), lambda x: x["i"])).alias("places"))
    new = F.transform("places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - x, F.lit(3))))
    repeat = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    made = placed.withColumn("n_repeat_words", repeat).select(F.struct(F.col("id").alias(id_col), *MEASURES).alias("row"))
    # A filter on the result must not be pushed into these expressions, where it would evaluate them again and again.
    return made.select(F.inline(F.array("row")))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measures`` with ``failed``: bit b is set if rule b of ``RULES`` fails.

    Each row is taken by itself: repeated rows and null ids pass through, other columns are
    ignored, an empty table gives an empty one. A null or blank text fails few_words alone.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << b)).otherwise(F.lit(0)) for b, (_, rule) in enumerate(RULES)]
    return measures(df, id_col, text_col).withColumn("failed", reduce(Column.bitwiseOR, bits).cast("long"))


def passes(policy: str) -> Column:
    """Over a ledger: whether a row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows failing it, and rows that only it rejects, from the ledger's bits in one aggregation.

    Repeated rows and null ids count each; a null ``failed`` counts as no failure; an empty ledger gives no rules; other columns are ignored.
    """
    names = [name for name, _ in RULES]
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    counts = rows.groupBy(own.alias("own")).agg(F.count("*").alias("n"))  # at most one row a set of failed rules
    bits = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in POLICIES[policy])))
    each = counts.select("own", "n", bits.alias("r"))
    failing = F.sum(F.when(F.col("own").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0))
    only = F.sum(F.when(F.col("own") == F.col("r.bit"), F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(failing.alias("n_failing"), only.alias("n_only"))
