"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import GAP, documents, id_and_text

WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is was that with for on by it as at or an this "
    "der die und das von den des mit im ist für auf dem nicht ein eine als zu "
    "la le les et de des en un une du est que dans pour au par il "
    "el los las y que del se con por una su no al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= metric <= high; a metric without a denominator is null and passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.expr(self.metric)
        test = F.lit(True)
        if self.low is not None:
            test = test & (value >= self.low)
        if self.high is not None:
            test = test & (value <= self.high)
        return F.coalesce(test, F.lit(True))


RULES = (
    Rule("word_length", "word_chars / nullif(n_words, 0)", 2.0, 25.0),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", high=0.2),
    Rule("stop_words", "n_stop / nullif(n_words, 0)", low=0.02),
    Rule("exclamations", "n_bangs / nullif(n_words, 0)", high=0.5),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", high=0.5),
)


def _repeat_words() -> Column:
    """Words inside 8-word windows that occur twice or more in one text.

    One-element arrays bind a value once: a lambda that names an outer expression would evaluate it anew for each
    element. Windows are compared by 64-bit hash within one text. Only texts with a repeated window are sorted.
    """
    return F.expr(
        f"""
        transform(array(transform(words, w -> xxhash64(w))), h -> if(size(h) < {WINDOW}, 0,
          transform(array(transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64(slice(h, i + 1, {WINDOW})))), win ->
            if(size(array_distinct(win)) = size(win), 0,
              transform(array(sort_array(transform(win, (x, i) -> named_struct('x', x, 'i', i)))), p ->
                aggregate(
                  sort_array(transform(
                    filter(p, (e, j) -> (j > 0 and p[j - 1].x = e.x) or (j < size(p) - 1 and p[j + 1].x = e.x)),
                    e -> e.i)),
                  named_struct('end', 0, 'n', 0),
                  (a, i) -> named_struct('end', i + {WINDOW}, 'n', a.n + least({WINDOW}, i + {WINDOW} - a.end)),
                  a -> a.n))[0]))[0]))[0]
        """
    )


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with the counts that the rules use.

    Null and empty texts have no words and every count 0. Rows are taken as they come, repeated ids included; columns
    other than doc_id and text are ignored.
    """
    words = id_and_text(docs).select(
        "doc_id",
        "text",
        F.filter(F.split("text", GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.length(F.regexp_replace("text", r"[^!]+", "")).cast("long").alias("n_bangs"),
        F.size(F.filter("words", lambda w: w == "|")).cast("long").alias("n_bars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.expr("transform(array(words), a -> size(filter(a, (w, i) -> i > 0 and w = a[i - 1])))[0]").cast("long").alias("n_adjacent"),
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`measure` plus base_failed, the failed rules' names and kept.

    base_failed: fewer than 20 words, or over 30 in 100 words lie in repeated windows. A text is kept if the base and
    every rule pass. An empty table gives an empty result.
    """
    counted = measure(docs)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    ruled = counted.withColumns({"base_failed": base, "failed_rules": failed})
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply_rules(documents(spark, sf_dir)).select(*cols)


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP1_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (
  SELECT doc_id, sum(least(8, i + 8 - e)) AS n
  FROM (SELECT doc_id, i, coalesce(lag(i + 8) OVER (PARTITION BY doc_id ORDER BY i), 0) AS e FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop,
         length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, coalesce(chars, 0)::BIGINT AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2::DOUBLE AND 25::DOUBLE AND n_symbols / n_words <= 0.2::DOUBLE
       AND n_stop / n_words >= 0.02::DOUBLE AND n_bangs / n_words <= 0.5::DOUBLE AND n_dup_lines / n_lines <= 0.5::DOUBLE AS kept
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": OP1_SQL}
