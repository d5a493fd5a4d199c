"""Signed token rollups and quotation links against plain Python."""

from collections import Counter

import pytest

from wardwatch.llm import quote_links, token_rollup

COUNTS = "doc_id long, source string, lang string, version string, tokens long"


def _totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def _plain(rows):
    out = {}
    for _, s, g, v, n in rows:
        a, b = out.get((s, g, v), (0, 0))
        out[s, g, v] = (a + 1, b + n)
    return out


def test_insert_delete_revise_and_replay(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert _totals(rollup) == {}
    first = [(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, None, "v1", 0), (3, None, None, "v1", 0), (4, "b", "de", "v1", 9)]
    frame = lambda rows: spark.createDataFrame(rows, COUNTS)
    assert rollup.commit("1", token_rollup.delta(new=frame(first)))
    assert not rollup.commit("1", token_rollup.delta(new=frame(first)))
    assert _totals(rollup) == _plain(first)
    revised = [(1, "a", "en", "v1", 12), (1, "a", "en", "v2", 3)]
    assert rollup.commit("2", token_rollup.delta(new=frame(revised), old=frame(first[:1] + first[4:])))
    now = _plain(first[1:4] + revised)
    assert _totals(rollup) == now  # the group of "b" has vanished
    # An attempt that died before its log row, and one that raced with a committed batch, don't count.
    lost = token_rollup.delta(new=frame(first)).selectExpr("*", "'3' batch", "'zz' attempt")
    lost.write.mode("append").parquet(f"{rollup.path}/deltas")
    lost.selectExpr("source", "lang", "version", "n_docs", "n_tokens", "n_changes", "'1' batch", "'zz' attempt").write.mode("append").parquet(f"{rollup.path}/deltas")
    spark.createDataFrame([("1", "zz", [])], token_rollup.LOG).write.mode("append").parquet(f"{rollup.path}/log")
    assert _totals(rollup) == now
    assert rollup.compact("1+2") and _totals(rollup) == now
    assert not rollup.commit("2", token_rollup.delta(new=frame(first))) and _totals(rollup) == now
    assert rollup.commit("4", token_rollup.delta(new=frame([]))) and _totals(rollup) == now
    assert _totals(token_rollup.Rollup(spark, rollup.path)) == now


def test_count_tokens(spark):
    rows = [(1, None, "a", "en"), (2, "", "a", "en"), (None, "two words", None, None), (3, "x " * 50_000, "b", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, `Version` int")
    known = token_rollup.public_vocabularies()
    got = Counter((r.doc_id, r.source, r.lang, r.version, r.tokens) for r in token_rollup.count_tokens(docs, known).collect())
    assert got == Counter((i, s, g, v, len(x.encode(t or ""))) for i, t, s, g in rows for v, x in known.items())
    assert token_rollup.count_tokens(docs.limit(0), known).count() == 0


def _chat(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, `Position` string")
    return {(r.conv_id, r.position): r for r in quote_links.format_chats(df, **kw).collect()}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "How do I  sort?\nIt is slow."),
        (1, 1, "assistant", "Use an index.\n\nOr less data."),
        (1, 2, "user", "Unrelated note"),
        (1, 3, "assistant", "Ann wrote:\n> how do i sort?\n> It is slow.\n\nTry again."),
        (1, 4, "user", "> use an INDEX.\n> > How do I sort?\nWhich one?"),
        (1, 5, "user", "> nobody said this\nfine"),
        (1, 6, "user", "> Or less data.\n>> Which one?\n> Use an index.\nok"),
        (2, 0, "user", "> Use an index.\nfrom elsewhere"),
    ]
    for ranges in (None, 2, 9):
        got = _chat(spark, rows, ranges=ranges)
        assert {k: r.parent for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 1, (1, 5): 4, (1, 6): 1, (2, 0): None}
        assert {k for k, r in got.items() if r.linked} == {(1, 3), (1, 4), (1, 6)}
        assert got[1, 3].text == "Try again." and got[1, 4].text == "Which one?" and got[1, 4].depth == 2 and got[1, 0].text == rows[0][3]


def test_chat_edges(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (3, None, "user", ""), (3, 5, "user", "b"), (3, 5, "user", "b"), (4, 0, "user", ">"), (4, 1, "user", "> " * 5 + "w " * 60_000)]
    rows += [(5, i, "user", "> same\nsame" if i else "same") for i in range(300)]
    got = _chat(spark, rows, ranges=16)
    assert len(got) == len(rows)
    assert [got[None, i].text for i in range(2)] == ["a", ""] and got[3, 2].turn is None
    assert all(got[5, i].parent == 0 and got[5, i].linked and got[5, i].text == "same" for i in range(1, 300))
    assert _chat(spark, []) == {}


@pytest.mark.parametrize("conv,turn", [(None, None), (7, 3), (None, 3)])
def test_hot_conversation_is_split(spark, conv, turn):
    """Rows of one conversation with one turn or none, most of them equal, are ordered in many tasks."""
    rows = [(conv, turn, "user", "same" if i % 3 else f"text {i}", "x") for i in range(4000)] + [(8, 0, "user", "other", "x")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `Position` string").repartition(5)
    numbered = quote_links._numbered(df, "conv_id", "turn", "role", "text", 16)
    sizes = [r["count"] for r in numbered.groupBy("block").count().collect()]
    assert sum(sizes) == 4050 and max(sizes) < 800
    got = quote_links.placed(df, ranges=16).collect()
    assert sorted(r.position for r in got if r.conv_id == conv) == list(range(4000)) and sorted(r.position for r in got if r.conv_id == 8) == list(range(50))
    texts = [r.text for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)]
    assert sum(a != b for a, b in zip(texts, texts[1:])) <= 2 * len(set(texts))
