"""Quality rules as a bitmask ledger.

One pass over a text evaluates every rule and stores its measurements and one failure bit per rule. What a policy rejects
is decided later from the bits alone: a policy is a version and the mask of the rules that it enforces, so a new policy,
or the ablation of a rule, is a bitwise operation over the ledger and never reads a text again.

Rules (bit: fails if):
  0 few_words      fewer than 50 words
  1 repeat_words   over half of the words lie in 3-word windows found twice or more in the text
  2 symbols        more than 30 symbol characters per 100 words
  3 shouting       over half of the words have upper-case letters only (four bytes or more, ASCII letters)
  4 dup_lines      over half of the lines with words equal an earlier line
  5 word_length    fewer than 2 or more than 20 characters a word on average
Policy 1, the default, enforces rules 0 to 3; policy 2 all six.

Defined cases: a null text has no words, so it fails rule 0; bytes that aren't UTF-8 count as characters unless they
continue one; repeated rows are judged alike; an empty table gives no rows; extra columns pass through keep().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import documents

RULES = ("few_words", "repeat_words", "symbols", "shouting", "dup_lines", "word_length")
BASE_MASK = 0b000011
POLICIES = {1: 0b001111, 2: 0b111111}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "fails")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
SYMBOLS = b"#*$%&|<>"


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of a text in UTF-8, in the order of MEASURES."""
    from collections import Counter

    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, _HEADS))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    upper = sum(1 for w in words if len(w) > 3 and w.isupper())
    fails = (
        (n < 50) | (100 * repeated > 50 * n) << 1 | (100 * symbols > 30 * n) << 2 | (100 * upper > 50 * n) << 3
        | (100 * duplicates > 50 * len(lines)) << 4 | (n > 0 and not 2 * n <= chars <= 20 * n) << 5
    )
    return n, chars, symbols, duplicates, repeated, len(lines), upper, int(fails)


#: Bytes that begin a character: all but UTF-8's continuation bytes.
_HEADS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements and failure bits of each row."""

    def batches(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            found = np.array([measure(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(batches, LEDGER)


def kept(mask: int) -> Column:
    """Whether a policy that enforces the rules of this mask keeps the row of a ledger."""
    return F.col("fails").bitwiseAND(F.lit(mask)) == 0


def ablations(rows: DataFrame, policy: int = 1) -> DataFrame:
    """For each rule of a policy: how many rows fail it, fail it alone, and are kept without it; one aggregation of bits."""
    mask, total = POLICIES[policy], F.count(F.lit(1)).alias("n")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    on = [k for k in range(len(RULES)) if mask >> k & 1]
    enforced = F.col("fails").bitwiseAND(F.lit(mask))
    sums = [x for k in on for x in (count(enforced.bitwiseAND(F.lit(1 << k)) != 0, f"f{k}"), count(enforced == 1 << k, f"o{k}"), count(kept(mask & ~(1 << k)), f"k{k}"))]
    one = rows.agg(total, *sums)
    out = F.explode(F.array(*[F.struct(F.lit(RULES[k]).alias("rule"), F.col(f"f{k}").alias("failed"), F.col(f"o{k}").alias("failed_alone"), F.col(f"k{k}").alias("kept_without")) for k in on])).alias("x")
    return one.select("n", out).select(F.lit(policy).alias("policy"), "x.*", "n")


def keep(docs: DataFrame, policy: int = 1) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns."""
    mask = POLICIES[policy]
    at = docs.columns.index("text")

    def batches(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts:
            # a string's bytes are read in place
            texts = batch.column(at).cast(pa.large_binary())
            yield batch.filter(pa.array([measure(t.as_py())[-1] & mask == 0 for t in texts], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [m for m in MEASURES if m not in ("n_lines", "n_upper_words", "fails")]
    return ledger(documents(spark, sf_dir)).select(
        "doc_id", *shown, (F.col("fails").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), kept(POLICIES[1]).alias("kept"), F.col("fails").alias("fail_bits"), F.lit(1).alias("policy"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), t AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g
), p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, range(3) x(k) WHERE n > 1 GROUP BY r
), l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), m AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: octet_length(encode(x)) > 3 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS upper_words
  FROM d JOIN l USING (r) LEFT JOIN p ON p.r = d.r
), b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
            + 8 * (100 * upper_words > 50 * n_words)::BIGINT + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
            + 32 * (n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 20 * n_words)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept,
       fail_bits, 1 AS policy FROM b
"""
