"""Quality rules as a bitmask ledger (native: DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements and one failure bit per rule; policies are
named, versioned masks over those bits, and ablations are counts over ``ledger & mask`` - no text is read again.

Defined results: a null or empty text has no words, fails ``too_few_words`` and has zero in every measurement; very long
texts are measured whole; repeated rows are measured each for itself; an empty table gives an empty ledger; extra columns
of the input pass through ``ledger`` unless they bear the name of a measurement, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, words_of

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _covered(windows: Column) -> Column:
    """How many positions the windows cover whose hash occurs at least twice in ``windows``."""

    def of(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False)) | F.coalesce(
            x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)
        )
        at = F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ordered, of))


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes within one text; hashes of 2, 4 and 8 words are made from those of half as many.
    """

    def doubled(step: int, body: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda hs: let(F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + step))), body)

    def of(eights: Column) -> Column:
        return let(F.slice(eights, 1, F.size(eights) - (WINDOW - 1)), _covered)

    chain = doubled(1, doubled(2, doubled(4, of)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), chain))


def _left(text: Column, other_than: str) -> Column:
    """The number of characters of a class: what stays of the text without the rest."""
    return F.length(F.regexp_replace(text, f"[^{other_than}]+", "")).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements (all long) to ``docs``.  ``inline`` keeps the optimizer from evaluating one twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    telling = F.regexp_replace(t, "[^#*$%&|<>\\p{Lu}!?]+", "")
    parts = F.struct(words_of(F.col(text)).alias("w"), lines.alias("l"), telling.alias("c"))

    def of(x: Column) -> Column:
        w, l, c = x["w"], x["l"], x["c"]  # noqa: E741
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _left(c, "#*$%&|<>").alias("n_symbols"),
            F.size(l).cast("long").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            _left(c, "\\p{Lu}").alias("n_upper"),
            _left(c, "!?").alias("n_marks"),
        )

    return docs.drop(*MEASURES).select("*", F.inline(F.transform(F.array(parts), of)))


#: Rule name -> failure condition in SQL over the measurements; the bit is the position.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 30 * n_words or word_chars < 2 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "marks": "3 * n_marks > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: a document is kept where none of the policy's bits failed.
POLICIES = {
    "base-1": BIT["too_few_words"] | BIT["repeated_windows"],
    "web-1": sum(BIT.values()),
}


def keep(docs: DataFrame, policy: str = "web-1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns, also those that are named like a measurement."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(f"`{text}`").alias("text"))
    return ledger(held).where(passes(policy)).select("document.*")


def ledger(docs: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the measurements and ``ledger`` (long): bit i is set where rule i failed."""
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, cond in enumerate((rules or RULES).values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs.drop("ledger"), text).withColumn("ledger", total)


def mask_of(policy: str | int, rules: dict[str, str] | None = None) -> int:
    """A policy's bits: by name, as a number, or all of ``rules`` where these are given instead of ``RULES``."""
    if isinstance(policy, int):
        return policy
    return POLICIES[policy] if rules is None else (1 << len(rules)) - 1


def passes(policy: str | int, rules: dict[str, str] | None = None) -> Column:
    return F.col("ledger").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0


def ablation(book: DataFrame, policy: str | int = "web-1", rules: dict[str, str] | None = None) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if the rule were dropped (one aggregation over the ledger)."""
    mask = mask_of(policy, rules)
    masked = F.col("ledger").bitwiseAND(F.lit(mask).cast("long"))
    bits = {name: 1 << i for i, name in enumerate(rules or RULES) if mask >> i & 1}
    aggs = [F.count_if(masked == 0).alias("kept")]
    for n, bit in bits.items():
        aggs += [F.count_if(masked.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"fails_{n}"), F.count_if(masked == bit).alias(f"only_{n}")]
    one = book.agg(*aggs)
    rows = [
        F.struct(
            F.lit(n).alias("rule"),
            F.col(f"fails_{n}").alias("failed"),
            F.col(f"only_{n}").alias("failed_alone"),
            (F.col("kept") + F.col(f"only_{n}")).alias("kept_without"),
        )
        for n in bits
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(read(spark, sf_dir, "documents", "doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base-1")).alias("base_failed"), passes("web-1").alias("kept"), "ledger",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_marks
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 4 * n_symbols > n_words AS r2, 2 * n_dup_lines > n_lines AS r3,
         word_chars > 30 * n_words OR word_chars < 2 * n_words AS r4, 2 * n_upper > word_chars AS r5, 3 * n_marks > n_words AS r6
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept,
       (r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT)::BIGINT AS ledger
FROM b
"""
