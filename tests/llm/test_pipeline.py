"""The whole pipeline against a plain version of its stages."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from riskloom.llm import op2_rules, op3_slots
from tests.llm.conftest import frame
from tests.llm.test_brute_force import corpus  # noqa: F401
from tests.llm.test_near_copies import brute
from tests.llm.test_templates import leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, docs, items, where):
    docs.write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where)


def test_pipeline(spark, corpus, tmp_path):  # noqa: F811
    bench = [(0, corpus[4][1].split("\n")[0] + " " + corpus[4][1].split("\n")[-1]), (1, corpus[21][1].replace("\n", " ")), (2, corpus[33][1])]
    got = corpus_pipeline.run(spark, tables(spark, frame(spark, corpus).select(*COLUMNS), bench, tmp_path)).collect()
    kept = {d: t for d, t, _ in corpus if op2_rules.measure(t.encode())[-1] & op2_rules.POLICIES[1] == 0}
    roots = brute([(d, t, "") for d, t in kept.items()])
    kept = {d: t for d, t in kept.items() if roots[d] == d}
    before = len(kept)
    kept = {d: t for d, t in kept.items() if not any(leaks(t, q) for _, q in bench)}
    assert len(kept) < before
    sizes, source = defaultdict(int), {d: s for d, _, s in corpus}
    for d, t in kept.items():
        sizes[source[d]] += len(t.split())
    total, weight = sum(sizes.values()), {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    low, high = 0.0, float(total)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < total else (low, mid)
    taken = Counter()
    for r in got:
        assert r.doc_id in kept and r.text == kept[r.doc_id] and r.size == len(kept[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(kept[r.doc_id].encode())
        taken[source[r.doc_id]] += len(kept[r.doc_id].split())
    longest = max(len(t.split()) for t in kept.values())
    assert all(abs(taken[s] - min(3 * sizes[s], low * weight[s])) <= longest for s in sizes)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and op3_slots.SHARDS >= len(by)


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        where = tmp_path / name
        where.mkdir()
        rows = corpus_pipeline.run(spark, tables(spark, docs, [(1, "same text here with five words"), (2, None)], where)).collect()
        # only the long texts have fifty words, and one is a near copy of the other
        assert {r.doc_id for r in rows} == ({9} if name == "odd" else set())
