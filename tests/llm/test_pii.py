"""PII spans against plain patterns, and disclosing terms against counts by hand."""

import math
import random
import re

import pytest

from wardwatch.llm import pii_disclosure as pii

SCHEMA = "doc_id long, text string, spans string, n_email int, `Clean` string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)


def plain(text):
    """The contract's patterns as they are written."""

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    found = []
    for k, pattern in enumerate(
        (
            r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]",
        )
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if (
                k == 0
                or k == 1
                and all(int(p) <= 255 for p in m.group().split("."))
                or k == 2
                and 14 <= len(d) <= 19
                and luhn(d)
                or k == 3
                and 10 <= len(d) <= 15
            ):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_like_the_patterns():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "x-y", ".", "1", "23", "255", "256", "004", " ", "-", "+", "(", ")", "4539 1488 0343 6467", "+49 30 1234567", "é", "\n", "1.2.3.4", "a@b.c"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1 " * 130_000):
        pii.base_spans(run)


def _corpus():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(200)]
    for i in range(200, 206):  # "Zorbek" stands beside one address in six contexts that differ
        rows.append((i, f"{' '.join(rng.choices(words, k=6))} Zorbek boss@corp.example {' '.join(rng.choices(words, k=6))}"))
    same = f"{' '.join(words[:4])} quixby only@copy.example {' '.join(words[4:8])}"
    rows += [(i, same) for i in range(300, 330)]  # copies are no evidence
    rows.append((400, "We met Zorbek. And quixby."))
    return rows


@pytest.mark.parametrize("limit", [0, 1000])
def test_disclosing_terms(spark, limit):
    rows = _corpus()
    terms = {r.term: r for r in pii.disclosing_terms(_docs(spark, rows)).collect()}
    assert set(terms) == {"zorbek"}
    n = len(rows)
    chance = (6 * 6 / 7 + 36 / n * 6 / 36) / 7  # no other address has the term beside it
    assert terms["zorbek"].disclosure == pytest.approx(1 - math.log(chance) / math.log(6 / n))
    got = {r.doc_id: r for r in pii.find(_docs(spark, rows), broadcast_terms=limit).collect()}
    assert len(got) == n and got[0].spans == "" and got[400].spans == ("term:7:13" if not terms["zorbek"].removed else "removed_term:7:13")
    assert got[200].n_email == 1 and "email:" in got[200].spans and "term:" in got[200].spans
    clean = pii.sanitise(_docs(spark, rows), broadcast_terms=limit)
    assert clean.columns == ["doc_id", "text", "spans", "n_email", "Clean"]
    texts = {r.doc_id: r for r in clean.collect()}
    assert "Zorbek" not in texts[400].text and "[email]" in texts[200].text and texts[0].text == rows[0][1] and texts[0].Clean == "y"


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, "ü 8.8.8.8 " + "w " * 90_000)]
    got = pii.find(_docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in got) == sorted(
        [(1, 0, 0, ""), (2, 0, 0, ""), (0, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6"), (4, 0, 1, "ip:2:9")]
    )
    assert pii.find(_docs(spark, [])).collect() == []


def _random_corpus(seed):
    """Addresses and numbers of a few groups among words that are common, rare or tied to one of them; copies, nulls and empty texts too."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    people = [(f"P{w}name", f"{w}@mail{rng.randrange(3)}.example") for w in words[:25]]
    rows = []
    for i in range(260):
        if rows and rng.random() < 0.2:
            rows.append((i, rng.choice(rows)[1]))
            continue
        text = rng.choices(words, k=rng.randrange(25))
        if rng.random() < 0.5:
            name, address = rng.choice(people)
            text += [name.upper() if rng.random() < 0.2 else name, rng.choice((address, address.upper(), "+49 30 12345" + str(rng.randrange(10, 99)), f"10.0.{rng.randrange(3)}.7", "4539 1488 0343 6467"))] * rng.choice((1, 1, 2))
            text += [f"once{i}".translate(str.maketrans("0123456789", "ghijklmnop"))] * rng.randrange(2)
        text += rng.choices(words, k=rng.randrange(25))
        rows.append((i, rng.choice((" ".join(text), " ".join(text), "", None))))
    return rows


def brute_terms(rows, window=80):
    """Disclosure of every word near an entity, counted from the whole corpus with plain loops."""
    word = re.compile(r"[^\W\d_]{3,}")
    near, named, used = {}, {}, {}
    for doc, text in rows:
        text = text or ""
        for w in {m.group().lower() for m in word.finditer(text)}:
            used.setdefault(w, set()).add(doc)
        spans = plain(text)
        for a, k, b in spans:
            said = text[a:b]
            digits = re.sub("[^0-9]", "", said)
            value, group = [(said.lower(), said.lower().split("@")[-1]), (said, said.rsplit(".", 2)[0]), (digits, digits[:6]), (digits, digits[:4])][k]
            around = set()
            for m in word.finditer(text):
                whole = m.start() >= a - window and m.end() <= a or m.start() >= b and m.end() <= b + window
                if whole and not any(m.start() < y and m.end() > x for x, _, y in spans):
                    around.add(m.group().lower())
            kind = pii.KINDS[k]
            for e in ((kind,), (kind, group), (kind, group, value)):
                named.setdefault(e, set()).add(doc)
                for w in around:
                    others = sorted(around - {w}, key=lambda x: pii.xxhash.xxh64_intdigest(x) >> 1)
                    found = near.setdefault((e, w), (set(), set()))
                    found[0].add(doc)
                    found[1].add(others[0] if others else None)
    best, n = {}, len(rows)

    def known(e, w, contexts):
        """P(e | w) from the given contexts of the two and what is known without them."""
        docs, all_contexts = near[e, w]
        if len(e) == 1:
            lean = len(named[e]) / n
        else:
            lean = known(e[:-1], w, near[e[:-1], w][1] - all_contexts) * len(named[e]) / len(named[e[:-1]])
        return (len(contexts) * len(docs) / len(used[w]) + lean) / (len(contexts) + 1)

    for e, w in near:
        if len(e) > 1:
            best[w] = max(best.get(w, 0), 1 - math.log(known(e, w, near[e, w][1])) / math.log(len(named[e]) / n))
    return {w: d for w, d in best.items() if d >= pii.GENERALISE}


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosure_like_plain_counts(spark, seed):
    rows = _random_corpus(seed)
    got = {r.term: r for r in pii.disclosing_terms(_docs(spark, rows)).collect()}
    want = brute_terms(rows)
    assert len(want) > 10
    assert {t: r.disclosure for t, r in got.items()} == pytest.approx(want)
    assert all(r.removed == (r.disclosure >= pii.REMOVE) for r in got.values())
    found = {r.doc_id: r for r in pii.find(_docs(spark, rows)).collect()}
    for doc, text in rows:
        base = plain(text or "")
        terms = [m for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m.group().lower() in want and not any(m.start() < y and m.end() > x for x, _, y in base)]
        assert (found[doc].n_terms, found[doc].n_spans) == (len(terms), len(terms) + len(base))
