"""Quality rules, line first (DataFrame functions only).

Every line is judged by itself; lines that fail a rule are removed, and a document is rejected
if it then has lost too much of its text:
 * punctuation: a long line without the end of any sentence, or marks of emphasis on most words;
 * symbols: half as many of ``#*$%&|<>`` as words, or more;
 * navigation: cells separated by bars, arrows or bullets;
 * boilerplate: notices on cookies, rights, subscriptions, scripts, licences;
 * repetition: few distinct words in a line;
 * repeats of an earlier line.
Before that, base statistics of the whole text reject very short texts, and texts in which
words in repeated windows of eight words make up more than 30 %.

Null, empty and blank texts have no words; base fails and they are not kept. Blank lines are
neither judged nor counted. Long texts are processed whole; whether a text repeats a window is found by one sort
of its window hashes, and where, by a sort of (hash, position) in texts that do. Repeated rows get equal
results, an empty table an empty result; columns with the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved|copyright ©|\\(c\\) copyright|cookie policy|we use cookies|accept cookies|privacy policy|terms of (use|service)"
    "|subscribe to|sign up for|log ?in to|click here|read more|share this|enable javascript|lorem ipsum|licensed under|follow us on"
)


@dataclass(frozen=True)
class RuleConfig:
    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    keep_percent: int = 50  # characters of words that must be left


#: One of these is in every boilerplate phrase: a fast test of whole texts before lines are matched.
MARKS = ("reserved", "copyright", "cookie", "policy", "terms of", "subscribe", "sign up", "login", "log in", "click here", "read more", "share this", "javascript", "ipsum", "licensed", "follow us")


def _is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column, parts: Column, boilerplate: bool = True) -> Column:
    """Whether a line with words ``parts`` fails a rule; ``boilerplate``: phrases are looked for."""
    n = F.size(parts)
    fails = (
        (F.regexp_count(line, F.lit("[#*$%&|<>]")) * 10 >= n * 5)
        | (F.regexp_count(line, F.lit("!!")) * 10 >= F.greatest(n * 4, F.lit(20)))
        | (F.regexp_count(line, F.lit("[|»›→•·]")) * 10 >= F.greatest(n * 2, F.lit(20)))
        | ((n >= 10) & (F.size(F.array_distinct(parts)) * 10 <= n * 3))
        | ((n >= 40) & ~line.rlike(r"[.!?…]"))
    )
    return fails | F.lower(line).rlike(BOILERPLATE) if boilerplate else fails


def with_statistics(df: DataFrame, text: str = "text", cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and kept_text (the lines left, joined by line feeds). Columns of these names are replaced."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_text"]
    t = {k: fresh(f"lr_{k}", [*df.columns, *made]) for k in ("text", "words", "windows", "sorted", "any", "at", "lines", "good")}
    c = {k: F.col(v) for k, v in t.items()}
    df = df.withColumn(t["text"], F.coalesce(F.col(text), F.lit(""))).withColumn(t["words"], words(c["text"]))
    df = df.withColumn("n_words", F.size(c["words"]).cast("long")).withColumn("word_chars", F.length(F.array_join(c["words"], "")).cast("long"))
    # repeated windows: equal hashes are neighbours once sorted
    df = df.withColumn(t["words"], F.transform(c["words"], lambda w: F.xxhash64(w)))
    n = F.size(c["words"])
    at_each = F.when(n >= cfg.window, F.sequence(F.lit(0), n - cfg.window)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(t["windows"], F.transform(at_each, lambda i: F.xxhash64(*[F.get(c["words"], i + k) for k in range(cfg.window)])))
    df = df.withColumn(t["sorted"], F.sort_array(c["windows"]))
    df = df.withColumn(t["any"], F.size(F.filter(c["sorted"], lambda x, j: x == F.get(c["sorted"], j + 1))) > 0)
    coded = F.sort_array(F.transform(c["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(t["sorted"], F.when(c["any"], coded).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = c["sorted"]
    twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | F.when(j > 0, x["h"] == F.get(s, j - 1)["h"]))
    df = df.withColumn(t["at"], F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a repeated window covers its words up to the next repeated window
    reach = F.transform(c["at"], lambda p, j: F.least(F.lit(cfg.window), F.coalesce(F.get(c["at"], j + 1) - p, F.lit(cfg.window))))
    df = df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda acc, x: acc + x))
    df = df.withColumn("n_symbols", F.regexp_count(c["text"], F.lit("[#*$%&|<>]")).cast("long"))
    # lines
    df = df.withColumn(t["lines"], F.filter(F.split(c["text"], "\n"), lambda x: ~_is_blank(x)))
    df = df.withColumn(t["good"], F.array_distinct(c["lines"]))
    df = df.withColumn("n_dup_lines", (F.size(c["lines"]) - F.size(c["good"])).cast("long"))
    low = F.lower(c["text"])
    suspect = low.contains(MARKS[0])
    for m in MARKS[1:]:
        suspect = suspect | low.contains(m)
    split = F.transform(c["good"], lambda x: F.struct(x.alias("line"), words(x).alias("parts")))
    df = df.withColumn(t["good"], split)
    # the test of the text stays outside the lambda: inside, it would be made for each line
    with_phrases = F.filter(c["good"], lambda x: ~line_fails(x["line"], x["parts"]))
    without = F.filter(c["good"], lambda x: ~line_fails(x["line"], x["parts"], boilerplate=False))
    df = df.withColumn(t["good"], F.when(suspect, with_phrases).otherwise(without))
    left = F.aggregate(c["good"], F.lit(0).cast("long"), lambda acc, x: acc + F.length(F.array_join(x["parts"], "")))
    failed = (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * left >= cfg.keep_percent * F.col("word_chars")))
    df = df.withColumn("kept_text", F.array_join(F.transform(c["good"], lambda x: x["line"]), "\n")).drop(*t.values())
    # a generator ends the chain: a filter on the results stays above it instead of repeating the chain
    others, row = [n for n in df.columns if n not in made], fresh("lr_row", df.columns)
    return df.select(*others, F.explode(F.array(F.struct(*made))).alias(row)).select(*others, f"{row}.*")


def clean(docs: DataFrame, cfg: RuleConfig = RuleConfig(), text: str = "text") -> DataFrame:
    """The kept documents, their text replaced by the lines left."""
    out = with_statistics(docs.withColumn(text, F.col(text)), text, cfg).where("kept")
    return out.withColumn(text, F.col("kept_text")).select(*docs.columns)


def report(docs: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """The statistics and verdict of each document."""
    out = with_statistics(docs.select("doc_id", "text"), "text", cfg)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
