"""The pipeline as a chain: each stage against plain Python on what the stage before kept, and its edge cases."""

import collections
import random

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_classes
from wardwatch.llm import mix_flow, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, digest string, pattern string"
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "score", "digest", "pattern"]


def _rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        if i % 4 == 1:
            text += " vilegrot"
        elif i % 16 == 2:
            text += " v1l3gr0t"
        elif rows and i % 10 == 3:
            text = rows[rng.randrange(len(rows))][1] or ""  # an exact copy
        elif rows and i % 10 == 7:
            text = (rows[rng.randrange(len(rows))][1] or "") + " end"
        rows.append((i, text, "en", rng.choice(("a", "b", "c", None))))
    rows += [(200, None, None, "a"), (201, "", "en", None), (202, "", "en", "b"), (203, "long " * 30_000, "en", "b"), (204, rows[0][1], "en", "a")]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, "d", "p") for r in rows] + [(204, rows[0][1], "en", "a", len(rows[0][1]), 0.5, "d", "p")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 1)) for i in range(120)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)



def _bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == NAMES
        out.write.parquet(f"{folder}/out-{name}")
        outs[name] = (docs.collect(), spark.read.parquet(f"{folder}/out-{name}"))
        docs = outs[name][1]

    before, after = outs["toxicity"]
    scorer = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert _bag(after.collect()) == _bag(r for r in before if scorer.score(r.text) < 0.5)
    assert not any("vilegrot" in (r.text or "") or "v1l3gr0t" in (r.text or "") for r in after.collect())
    clean = [r for r in before if "vilegrot" not in (r.text or "") and "v1l3gr0t" not in (r.text or "")]
    assert after.count() == len(clean)

    before, after = outs["exact_dedup"]
    best = {}
    for r in before:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted((r.text or "", r.doc_id) for r in after.collect()) == sorted(best.items())

    before, after = outs["simhash_near_dedup"]
    roots = {root for _, _, root in brute_classes([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after.collect()) == sorted(roots) and not _bag(after.collect()) - _bag(before)

    before, after = outs["mix"]
    size = lambda text: len([w for w in (text or "").split(" ") if w])
    kept = _bag(after.collect())
    known = _bag(before)
    assert set(kept) <= set(known) and all(n <= 3 * known[r] for r, n in kept.items())
    taken, whole = collections.Counter(), collections.Counter()
    for r in before:
        whole[r.source] += size(r.text)
    for r, n in kept.items():
        taken[r[3]] += n * size(r[1])
    sources = spark.createDataFrame(list(whole.items()), "source string, source_size long")
    for r in mix_flow.share_targets(sources, corpus_pipeline.MIX_WEIGHTS).collect():
        longest = max(size(x.text) for x in before if x.source == r.source)
        assert abs(taken[r.source] - r.target) <= longest

    before, after = outs["best_fit_packing"]
    pieces = after.collect()
    filled = collections.defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert collections.Counter(p.doc_id for p in pieces if p.piece == 0) == collections.Counter(r.doc_id for r in before)


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
