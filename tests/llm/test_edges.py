"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.llm import common, op1_backoff, op2_rules, op3_slots, op4_pu, op5_crf, op6_templates, op7_lines, op8_simhash, op9_tokens, op10_mixing
from tests.llm.conftest import ODD, frame

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (99, 1, 1), (11, 1, 0)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, "same text here with five words"), (2, None), (3, ""), (4, "one"), (1, "same text here with five words")], "item_id long, text string")


WHOLE = {
    "op1": lambda s, d: op1_backoff.scored(d),
    "op2": lambda s, d: op2_rules.ledger(d),
    "op3": lambda s, d: op3_slots.sharded(d),
    "op4": lambda s, d: op4_pu.op4_scores(d, labels(s)),
    "op5": lambda s, d: op5_crf.tagged(d, labels(s)),
    "op8": lambda s, d: op8_simhash.clusters(d),
    "op9": lambda s, d: op9_tokens.counted(d, block=64),
}


@pytest.mark.parametrize("name", WHOLE)
def test_one_row_a_document(spark, odd, name):
    got = WHOLE[name](spark, odd).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((d is None, d) for d, _, _ in ODD)
    assert not any(None in (r.score, r.predicted) for r in got if name in ("op4", "op5"))


@pytest.mark.parametrize("name", WHOLE)
def test_empty_table(spark, none, name):
    assert WHOLE[name](spark, none).count() == 0


def test_empty_labels_and_benchmark(spark, odd):
    no_labels = spark.createDataFrame([], LABELS)
    assert {r.score for r in op4_pu.op4_scores(odd, no_labels).collect()} == {0.0}
    assert all(r.score < 0.01 for r in op5_crf.tagged(odd, no_labels).collect())
    assert op6_templates.leaks(odd, items(spark).limit(0)).count() == 0


def test_stages_keep_columns_and_rows(spark, odd, none):
    b = items(spark)
    for stage in (op2_rules.keep, op8_simhash.keep_one, op10_mixing.mixed, op7_lines.dedup, lambda d: op6_templates.clean(d, b)):
        assert stage(odd).columns == odd.columns
        assert stage(none).count() == 0


def test_rules_of_odd_texts(odd):
    r = {x.doc_id: x for x in op2_rules.ledger(odd).collect()}
    assert (r[1].n_words, r[2].n_words, r[3].n_words) == (0, 0, 0)
    assert (r[6].n_words, r[6].word_chars, r[6].n_dup_lines, r[6].n_lines) == (6, 6, 1, 3)
    assert r[11].word_chars == len("éñü中文😀naïve")
    assert r[1].fails & 1 and not r[9].fails & 1


def test_ablations_count_bits(odd):
    rows = [r.fails for r in op2_rules.ledger(odd).collect()]
    for policy, mask in op2_rules.POLICIES.items():
        got = {r.rule: (r.failed, r.failed_alone, r.kept_without, r.n) for r in op2_rules.ablations(op2_rules.ledger(odd), policy).collect()}
        assert got == {op2_rules.RULES[k]: (sum(f >> k & 1 for f in rows), sum(f & mask == 1 << k for f in rows), sum(f & mask & ~(1 << k) == 0 for f in rows), len(rows)) for k in range(6) if mask >> k & 1}


def test_lines_of_odd_rows(odd):
    got = {(r.doc_id, r.text) for r in op7_lines.dedup(odd).collect()}
    # short texts stay, also if they are the same; the long text's second copy differs in its one line
    assert (6, "A b\nA b\n\nc d") in got and (8, "same text here with five words") in got and (1, None) in got and (7, "same text here with five words") in got
    assert {len(t) for d, t in got if d in (9, 10)} == {len(r.text) for r in odd.collect() if r.doc_id in (9, 10)}


def test_keep_one_of_ties(odd):
    kept = [r.doc_id for r in op8_simhash.keep_one(odd).collect()]
    assert kept.count(7) == 1 and 8 not in kept
    # texts without words are one group, of which the least id stays
    assert 1 in kept and 2 not in kept and 3 not in kept
    assert kept.count(None) == 1  # equal texts are one group, of which one row stays


def test_keep_one_row_of_each_group(spark):
    a, b = "the first text of two " * 9, "quite another one that nothing links to it " * 7
    kept = lambda rows: sorted((r.doc_id is None, r.doc_id, r.text) for r in op8_simhash.keep_one(frame(spark, rows)).collect())
    assert kept([(3, a, "s"), (7, a, "s"), (7, b, "s")]) == [(False, 3, a), (False, 7, b)]
    assert kept([(7, a, "s"), (7, b, "s")]) == [(False, 7, b), (False, 7, a)]
    assert kept([(3, a, "s"), (None, a, "s"), (None, b, "s")]) == [(False, 3, a), (True, None, b)]
    assert kept([(None, a, "x"), (None, a, "s"), (None, a, "s")]) == [(True, None, a)]


def test_clean_drops_leaks_only(spark, odd):
    kept = {r.doc_id for r in op6_templates.clean(odd, items(spark)).collect()}
    assert kept == {1, 2, 3, 5, 6, 9, 10, 11, None}  # 4 is the one-word item, 5 only holds it


def test_slots_are_gapless_and_even(spark):
    rows = frame(spark, [(k, f"text {k} " * (k % 50), "s") for k in range(3000)] + [(5, "text 5 " * 5, "s")] * 3)
    got = op3_slots.sharded(rows, shards=24).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == 3003 and set(by) == set(range(24))
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert max(sizes) <= 1.01 * min(sizes)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})


def test_rebalance_moves_few_slots():
    sums = [(s, 100 + s % 7, 1) for s in range(480)]
    before = op3_slots.assign(sums, shards=23, slots=480)
    after, moved = op3_slots.even(before, sums, 24)
    loads = [sum(b for s, b, _ in sums if after[s] == k) for k in range(24)]
    assert max(loads) <= 1.1 * min(loads) and len(moved) < 480 / 12
    back, _ = op3_slots.even(after, sums, 23)
    assert max(back) == 22


def test_versions_of_the_map(spark, tmp_path):
    docs = frame(spark, [(k, f"text {k} " * (k % 50), "s") for k in range(3000)])
    rows = op3_slots.slotted(docs, 480).cache()
    sums = op3_slots.slot_sums(rows)
    path = str(tmp_path / "map")
    op3_slots.store(op3_slots.slot_map(spark, op3_slots.assign(sums, 23, 480), sums), path)
    op3_slots.store(op3_slots.rebalance(op3_slots.stored(spark, path), 24), path)
    one, two = ({r.virtual_slot: r.shard for r in op3_slots.stored(spark, path, v).collect()} for v in (1, 2))
    moved = {s for s in one if one[s] != two[s]}
    assert set(one.values()) == set(range(23)) and set(two.values()) == set(range(24)) and 0 < len(moved) < 480 / 12
    placed = op3_slots.placed(rows, op3_slots.stored(spark, path)).collect()
    by = {}
    for r in placed:
        assert r.shard == two[r.virtual_slot] and r.map_version == 2
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert max(sizes) <= 1.1 * min(sizes)


def test_carried_columns(odd):
    rows = op3_slots.sharded(odd, carry=True)
    assert {"doc_id", "text", "lang", "source", "n_chars", "key", "fp"} <= set(rows.columns) and len(set(rows.columns)) == len(rows.columns)
    want, got = (sorted(map(tuple, x.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr) for x in (op3_slots.sharded(odd), rows))
    assert got == want


def test_mix_meets_targets(spark):
    import random

    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randint(0, 40)), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(2000)] + [(None, "a b c", None)] * 4
    docs = frame(spark, rows)
    held = op10_mixing.cuts(op10_mixing.keyed(docs)).collect()
    total = sum(x.source_size for x in held)
    assert abs(sum(x.target for x in held) - total) < 1e-6 and all(x.target <= 3 * x.source_size + 1e-9 for x in held)
    copies = {x.source: x.n for x in op10_mixing.mixed(docs).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert all(abs(copies.get(x.source, 0) - x.target) <= 41 for x in held)


def test_mix_is_the_same_again(spark):
    docs = frame(spark, [(k, "a b " * (k % 9), f"s{k % 4}") for k in range(300)])
    rows = lambda d: sorted(r.doc_id for r in op10_mixing.mixed(d).collect())
    assert rows(docs) == rows(docs.repartition(7))


def test_keep_one_leaves_columns_as_they_are(spark):
    rows = [(k, "the same few words of a text", "s", 100 + k, 200 + k, 300 + k) for k in (3, 1, 2)] + [(4, "another text altogether", "s", 104, 204, 304)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept_doc long, kept_crc long, row long")
    kept = op8_simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted({rows[1], rows[3]})


def test_facts_are_dealt_evenly():
    """Chunks are numbered from partition << 32 on; their facts must not meet in the few buckets of the lower digits."""
    for buckets in (64, 1024, 1000):
        held = [0] * buckets
        for partition in range(1000):
            for k in range(12):
                held[common.dealt(partition << 32 | k, buckets)] += 1
        assert min(held) > 0 and max(held) < 4 * 12_000 / buckets + 12
