"""Quality rules whose thresholds follow each language and source.

Each document gets integer metrics. Per (lang, source) every metric is summarised by a
quantile sketch of counted buckets: values below 64 have a bucket of their own, larger ones
share 32 buckets per power of two, so a quantile is off by less than 1/32. Sketches merge by
adding counts in any order: they are plain partial aggregates and give the same thresholds on
every run. Fences stand some quartile distances outside the quartiles; they are joined back to
the documents and decide.

Everything is a DataFrame expression. Counts are added up before the shuffle, so a source with
a third of all documents sends no more rows than another one.

Null or empty texts have no words and fail the base rules; null languages and sources are
groups of their own; repeated rows are counted and returned as often as they come; an empty
table gives an empty result. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.functions.binding import attach
from textguard.llm.common import SPACES, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A metric and the fences it must stay within.

    ``spread`` is the least distance of a fence from its quartile: in groups of very similar
    documents the quartiles coincide.
    """

    metric: str
    spread: int
    low: bool = False


#: Shares are per thousand, the mean word length is in hundredths of a character.
RULES = (
    Rule("symbol_share", 30),
    Rule("dup_line_share", 300),
    Rule("repeat_share", 250),
    Rule("mean_word", 150, low=True),
)
REACH = 3  # quartile distances between a quartile and its fence


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of each text, in one narrow pass.

    Windows are compared by hash first; texts in which one seems to come twice have their
    windows sorted, so counts are exact and a very long text costs n log n.
    """
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    df = attach(df, "w", words(F.col("text")))
    w, text = F.col("w"), F.col("text")
    spaceless = F.length(F.translate(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, SPACES, "")) != "")
    df = df.select(
        *keep, "w",
        F.size(w).cast("long").alias("n_words"),
        spaceless.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.explode_outer(F.array(lines)).alias("lines"),
    )
    third = F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0)))
    hashes = F.transform(third, lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    windows = F.transform(
        third,
        lambda x, i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), x).alias("s"), i.alias("i")),
    )
    seems = F.size(F.array_distinct(hashes)) < F.size(w) - 2
    df = df.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.explode_outer(F.array(F.when(seems, F.array_sort(windows)))).alias("sorted"),
    )
    s = F.col("sorted")
    twice = F.filter(
        s,
        lambda x, i: F.coalesce(x["s"] == F.get(s, i - 1)["s"], F.lit(False))
        | F.coalesce(x["s"] == F.get(s, i + 1)["s"], F.lit(False)),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).alias("n"), (i + 3).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    def share(part: str, whole: str, unit: int) -> Column:
        return F.expr(f"{unit} * {part} div greatest({whole}, 1)")

    return counts.withColumns({
        "symbol_share": share("n_symbols", "word_chars", 1000),
        "dup_line_share": share("n_dup_lines", "n_lines", 1000),
        "repeat_share": share("n_repeat_words", "n_words", 1000),
        "mean_word": share("word_chars", "n_words", 100),
    })


def bucket(value: Column) -> Column:
    """The sketch bucket of a value of 0 or more."""
    e = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(
        64 + (e - 1) * 32 + F.call_function("shiftright", value, e) - 32
    )


def least_value(of: Column) -> Column:
    """The smallest value in a bucket."""
    e = F.floor((of - 64) / 32).cast("int") + 1
    return F.when(of < 64, of).otherwise(F.call_function("shiftleft", (of - 64) % 32 + 32, e))


def thresholds(metrics: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per (lang, source): the fences ``<metric>_low`` and ``<metric>_high``."""
    each = F.explode(F.array(*[
        F.struct(F.lit(r.metric).alias("metric"), bucket(F.col(r.metric)).alias("bucket")) for r in rules
    ])).alias("m")
    sketch = (
        metrics.select("lang", "source", each)
        .groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))
    )
    group = W.partitionBy("lang", "source", "metric")
    ranked = sketch.select(
        "lang", "source", "metric", least_value(F.col("bucket")).alias("value"),
        F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"),
    )
    quartiles = ranked.groupBy("lang", "source", "metric").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("value"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("value"))).alias("q3"),
    )

    def fences(rule: Rule) -> list[Column]:
        reach = F.greatest(F.lit(REACH) * (F.col("q3") - F.col("q1")), F.lit(rule.spread))
        pick = lambda c: F.max(F.when(F.col("metric") == rule.metric, c))
        return [
            pick(F.col("q1") - reach).alias(f"{rule.metric}_low"),
            pick(F.col("q3") + reach).alias(f"{rule.metric}_high"),
        ]

    return quartiles.groupBy("lang", "source").agg(*[c for r in rules for c in fences(r)])


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base verdict and verdict of each document.

    The counts are written once: thresholds and verdicts read them, not the texts again.
    """
    metrics = stored(with_metrics(text_counts(docs, ["doc_id", "lang", "source"])), "rule-counts")
    limits = thresholds(metrics, rules).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    judged = metrics.join(
        limits,
        F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")),
        "left",
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    within = [F.col(r.metric) <= F.col(f"{r.metric}_high") for r in rules]
    within += [F.col(r.metric) >= F.col(f"{r.metric}_low") for r in rules if r.low]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & reduce(lambda a, b: a & b, within)).alias("kept"),
    )


def _word_list(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_word_list('text')} AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
grams AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
  SELECT rid, i AS p FROM twice UNION ALL SELECT rid, i + 1 FROM twice UNION ALL SELECT rid, i + 2 FROM twice) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
  1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share,
  100 * word_chars // greatest(n_words, 1) AS mean_word FROM c),
u AS ({' UNION ALL '.join(f"SELECT lang, source, '{r.metric}' AS metric, {r.spread} AS spread, {r.metric} AS v FROM m" for r in RULES)}),
r AS (SELECT lang, source, metric, spread,
  CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS value FROM u),
q AS (SELECT lang, source, metric, spread, min(CASE WHEN upto * 4 >= total THEN value END) AS q1,
  min(CASE WHEN upto * 4 >= total * 3 THEN value END) AS q3 FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY value) AS upto,
    sum(n) OVER (PARTITION BY lang, source, metric) AS total
  FROM (SELECT lang, source, metric, spread, value, count(*) AS n FROM r GROUP BY ALL)) GROUP BY ALL),
f AS (SELECT lang, source, metric, q1 - greatest({REACH} * (q3 - q1), spread) AS low,
  q3 + greatest({REACH} * (q3 - q1), spread) AS high FROM q),
j AS (SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(
    f"j.{r.metric} <= f_{r.metric}.high" + r.low * f" AND j.{r.metric} >= f_{r.metric}.low" for r in RULES)} AS kept
FROM j {' '.join(
  f"LEFT JOIN f f_{r.metric} ON f_{r.metric}.metric = '{r.metric}' AND f_{r.metric}.lang IS NOT DISTINCT FROM j.lang "
  f"AND f_{r.metric}.source IS NOT DISTINCT FROM j.source" for r in RULES)}
"""
