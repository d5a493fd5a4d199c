"""Learned operators: statistics against plain Python, identities, held-out accuracy, and edge cases."""

import itertools
import re
import zlib

import numpy as np
import pytest

from wardwatch.llm import mbs_packing, mix_flow, quality_fm, quality_rules, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `Label` int"
EDGE = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "long words here " * 40_000), (5, " \t\n"), (6, "#*$%&|<>\n\nx\nx\n x")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 5 else "s%d" % ((i or 0) % 2), len(t or ""), "d", 1) for i, t in rows], SCHEMA)


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_statistics_like_plain_python(spark):
    tables = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in tables.collect()] + [(10**6 + i, t) for i, (_, t) in enumerate(EDGE)]
    got = {r.doc_id: r for r in quality_rules.judge(_docs(spark, rows), []).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, text in rows:
        text = text or ""
        words = word.findall(text)
        lines = [x for x in text.split("\n") if word.search(x)]
        windows = list(zip(words, words[1:], words[2:]))
        seen = {}
        for k, w in enumerate(windows):
            seen.setdefault(w, []).append(k)
        repeat = len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)})
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words)) and r.kept == (not r.base_failed)


def test_decision_list():
    rng = np.random.default_rng(1)
    rows = [dict(zip(quality_rules.FEATURES, x)) for x in rng.integers(0, 11, (900, len(quality_rules.FEATURES))) / 10]
    junk = [r["digit_share"] > 0.8 and r["mean_word"] < 0.5 or r["repeat_share"] > 0.9 for r in rows]
    rules = quality_rules.learn(rows, junk)
    holds = lambda t, r: r[t.feature] >= t.limit if t.above else r[t.feature] <= t.limit
    said = [any(all(holds(t, r) for t in rule) for rule in rules) for r in rows]
    assert said == junk  # the thresholds are among the values, so the rules can be found exactly
    assert quality_rules.learn(rows, [False] * 900) == []


def test_rules_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.fit(docs, labels, held_out=(2, 1))
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    tested = [(kept[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 2 == 1]
    assert sum(k == (q == 1) for k, q in tested) >= 0.9 * len(tested)


def test_rules_as_one_expression(spark):
    one, two = quality_rules.Test("a", True, 5.0), quality_rules.Test("b", False, 1.0)
    df = spark.createDataFrame([(6.0, 9.0), (5.0, 1.0), (0.0, 1.0), (0.0, 2.0)], "a double, b double")
    for rules, kept in (([(one, two)], [True, False, True, True]), ([(one,), (two,)], [False, False, False, True]), ([], [True] * 4)):
        assert [r.kept for r in df.select(quality_rules.as_column(rules).alias("kept")).collect()] == kept


def test_sum_of_squares_identity():
    machine = quality_fm.Machine(20)
    machine.w, machine.b = np.arange(20) / 7, 0.3
    at, x = np.array([1, 4, 9, 17]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum(machine.v[i] @ machine.v[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(at, x), 2))
    assert machine.margin(at, x) == pytest.approx(0.3 + machine.w[at] @ x + pairs)


@pytest.mark.parametrize("classify,label,mod,out", [(quality_fm.classify, "quality", 3, 1), (toxicity.classify, "toxic", 5, 0)])
def test_held_out(spark, classify, label, mod, out):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    tested = [(got[r.doc_id].predicted, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)


@pytest.mark.parametrize("classify", [quality_fm.classify, toxicity.classify])
def test_classifier_edges(spark, classify):
    got = classify(_docs(spark, EDGE), _labels(spark, [(1, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None)])).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len(classify(_docs(spark, EDGE), _labels(spark)).collect()) == len(EDGE)
    assert classify(_docs(spark, []), _labels(spark)).collect() == []


def test_restorer_reads_disguises(spark):
    docs = spark.createDataFrame([("the silly monkey went to hell and the idiot is stupid " * 20,)], "text string")
    restorer = toxicity.Restorer(toxicity.character_model(docs))
    for spot, word in (("1d10t", "idiot"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"), ("h3ll", "hell"), ("s1lly", "silly")):
        assert word in restorer.words(f"You {spot} there"), spot
    kept = toxicity.drop_toxic(_docs(spark, EDGE), _labels(spark))
    assert kept.columns == _docs(spark, EDGE).columns and kept.count() == len(EDGE)


def test_packing(spark):
    rows = EDGE + [(100 + i, "w " * (37 * i % 2500)) for i in range(150)] + [(900, "end <|endoftext|> next " * 5), (901, "<|endoftext|>" * 900)]
    got = mbs_packing.pack(_docs(spark, rows), shard_pieces=100).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 4  # a shard may leave a sequence or two part empty
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True  # their strings in a text are ordinary text
    for i, text in rows[3:8] + rows[60:70] + rows[-2:]:
        ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        assert sum(x[2] for x in mine) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
    assert mbs_packing.pack(_docs(spark, [])).collect() == []


def test_fullest_is_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 5)}
        room = int(rng.integers(1, 60))
        flat = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for k in range(len(flat) + 1) for c in itertools.combinations(flat, k) if (s := sum(c)) <= room)
        chosen = mbs_packing.fullest(counts, room)
        assert sum(chosen) == best and all(chosen.count(x) <= counts[x] for x in chosen)


def test_mix(spark):
    rows = [(i, "w " * (i % 9 + 1)) for i in range(2000)] + EDGE[:4] + EDGE[6:7]
    weights = (5.0, 2.0, 1.0)
    got = mix_flow.mix_words(_docs(spark, rows), weights).collect()
    again = mix_flow.mix_words(_docs(spark, rows[::-1]), weights).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in got))
    for (size, target), taken in by.items():
        assert target <= 3 * size and abs(sum(taken) - target) <= 9
    assert mix_flow.mix_words(_docs(spark, []), weights).collect() == []
    mixed = mix_flow.mix(_docs(spark, rows), mix_flow.F.array("source"), mix_flow.word_count(mix_flow.F.col("text")), weights=weights)
    assert mixed.columns == _docs(spark, rows).columns


def test_route_overlapping():
    taken = mix_flow.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 12})
    assert sum(taken.values()) == 24 and all(v <= 3 * n for v, n in zip(taken.values(), (10, 10, 2)))
    assert mix_flow.route({("a",): 10, (): 5}, {"a": 50}) == {("a",): 30, (): 0}
