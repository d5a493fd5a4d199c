"""Personal data by patterns, and terms that disclose it by co-occurrence.

Patterns find the protected entities of a text: e-mail and network
addresses, card and phone numbers.  An entity also stands for its group (mail
domain, network, number prefix), and a group for its kind.  All documents
then tell how strongly a word near an entity gives it away.  With N
documents, n(e) of them naming e (a value, group or kind), n(t) using term t,
n(e, t) using t within ``WINDOW`` code points of e and c(e, t) contexts of
the two that differ (by the smallest hash of the words around),

    P(e | t) = (c(e,t) n(e,t) / n(t) + PRIOR lean(e,t)) / (c(e,t) + PRIOR)

where lean(e,t) is what is known without these contexts: P(up | t) n(e) / n(up)
with ``up`` a value's group or a group's kind, estimated in the same way from
those contexts of ``up`` that aren't contexts of e too, and for a kind the
plain share n(e) / N.  So a pair seen once counts for what it is, one
context, rare values lean on their group, and copies, which weigh on both
n(e,t) and n(t) but add no context, aren't taken for evidence.  The term discloses the
share PMI(e; t) / IC(e) = 1 - log P(e|t) / log(n(e) / N) of the entity's
information: 1 if the term occurs beside the entity alone, 0 if it tells
nothing.  Terms that disclose a value or a group to the degree ``GENERALISE``
or more are generalised to their class wherever they occur, and those that
disclose ``REMOVE`` or more are removed.  With a prior of one context a word
that occurs once in the corpus, beside an entity named once, is generalised
as soon as N reaches about a hundred.

Pairs and words are counted by partial aggregates.  The disclosing terms are
broadcast up to ``BROADCAST_TERMS``; more of them meet the words of each
document in an ordinary join.

Defined results: a null text counts as empty, without spans; null and
repeated ids are kept, one row per input row; an empty table gives an empty
one; extra columns are ignored by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.common import fresh, slices
from wardwatch.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
WINDOW = 80
#: Contexts that the estimate of the next higher level counts for.
PRIOR = 1.0
GENERALISE, REMOVE = 0.85, 0.95
#: Digits of a card or phone number that name its group.
PREFIX = {2: 6, 3: 4}
BROADCAST_TERMS = 100_000
#: Words a task counts before it passes its counts on.
FLUSH_WORDS = 200_000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, int]


def _luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of all pattern spans, sorted; time grows linearly with the text."""
    found: list[Span] = []
    floor = 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                floor = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = (p.lstrip("0") for p in m.group().split("."))
            if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _DIGIT.findall(m.group())
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _levels(text: str, span: Span) -> tuple[str, str, str]:
    """Names of the entity's value, group and kind: e-mail addresses compare without case, numbers by their digits."""
    said, kind = text[span[0] : span[2]], KINDS[span[1]]
    if span[1] == 0:
        value = said.lower()
        group = value.rpartition("@")[2]
    elif span[1] == 1:
        value = said
        group = ".".join(said.split(".")[:2])
    else:
        value = "".join(_DIGIT.findall(said))
        group = value[: PREFIX[span[1]]]
    return f"{kind}:{group}:{value}", f"{kind}:{group}", kind


def _words_between(text: str, start: int, end: int, masked: tuple[list[int], list[int]]) -> list[str]:
    """Lower-case words that lie wholly in a window and outside the masked spans."""
    found = []
    for m in _WORD.finditer(text, start, end):
        a, b = m.span()
        if a == start and a and text[a - 1].isalpha() or b == end and b < len(text) and text[b].isalpha():
            continue
        i = bisect.bisect_right(masked[0], a) - 1
        if i < 0 or masked[1][i] <= a:
            found.append(m.group().lower())
    return found


def contexts(text: str, window: int = WINDOW) -> dict[tuple[str, str], set[int]]:
    """For each (entity, term) of a text, entities of all levels, the contexts it was seen in; term "" stands for the entity itself."""
    spans = base_spans(text)
    if not spans:
        return {}
    starts, ends = [s[0] for s in spans], []
    for s in spans:
        ends.append(max(s[2], ends[-1] if ends else 0))
    pairs: dict[tuple[str, str], set[int]] = {}
    for span in spans:
        names = _levels(text, span)
        for name in names:
            pairs.setdefault((name, ""), {0})
        near = set(_words_between(text, max(0, span[0] - window), span[0], (starts, ends)))
        near |= set(_words_between(text, span[2], min(len(text), span[2] + window), (starts, ends)))
        ranked = sorted((xxhash.xxh64_intdigest(w) >> 1, w) for w in near)
        for _, w in ranked:
            other = next((h for h, x in ranked[:2] if x != w), 0)
            for name in names:
                pairs.setdefault((name, w), set()).add(other)
    return pairs


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [
            (entity, term, context, int(i == 0))
            for text in batch.column(0).to_pylist()
            if text
            for (entity, term), seen in contexts(text).items()
            for i, context in enumerate(sorted(seen))
        ]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["entity", "term", "context", "first"])


def _vocabulary(text: str | None) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))} if text else set()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    counts: Counter[str] = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update(_vocabulary(text))
        if len(counts) > FLUSH_WORDS:
            yield flush()
            counts.clear()
    yield flush()


def _up(entity) -> Column:
    """Name of the next higher level."""
    return F.when(F.size(F.split(entity, ":", 3)) == 3, F.substring_index(entity, ":", 2)).otherwise(F.substring_index(entity, ":", 1))


def estimates(docs: DataFrame, text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """(entity, term, chance, share): P(entity | term) and the entity's share of all documents, for all values and groups and the words near them."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    each = texts.mapInArrow(_pair_rows, "entity string, term string, context long, first long")
    each = each.groupBy("entity", "term", "context").agg(F.sum("first").alias("n"))
    pairs = cut_lineage(each.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts")))
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "entity string, term string, chance double, share double")
    total = texts.count()
    used = texts.mapInArrow(_word_rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    seen = cut_lineage(pairs.where("term <> ''").join(used, "term").select("entity", "term", "contexts", (F.col("n") / F.col("n_term")).alias("beside")))
    size = pairs.where("term = ''").select(F.col("entity").alias("of"), F.col("n").alias("size"))
    kinds = F.broadcast(size.where(F.col("of").isin(*KINDS)))
    smooth = lambda contexts, beside, lean: (contexts * beside + prior * lean) / (contexts + prior)
    # One level after the other: a kind's rows meet those of its groups by (kind, term), a group's those of its values.
    above = seen.where(F.col("entity").isin(*KINDS)).join(kinds, F.col("entity") == F.col("of")).withColumn("lean", F.col("size") / total)
    found = []
    for colons in (1, 2):
        level = lambda name: F.size(F.split(name, ":", 3)) == colons + 1  # noqa: B023, E731
        above = above.select(F.col("entity").alias("up"), F.col("term").alias("up_term"), *[F.col(c).alias(f"up_{c}") for c in ("contexts", "beside", "size", "lean")])
        rows = seen.where(level(F.col("entity"))).join(size.where(level(F.col("of"))), F.col("entity") == F.col("of")).withColumn("of_", _up(F.col("entity")))
        rows = rows.join(above, (F.col("of_") == F.col("up")) & (F.col("term") == F.col("up_term")))
        others = smooth(F.col("up_contexts") - F.col("contexts"), F.col("up_beside"), F.col("up_lean"))
        above = cut_lineage(rows.select("entity", "term", "contexts", "beside", "size", (others * F.col("size") / F.col("up_size")).alias("lean")))
        chance = smooth(F.col("contexts"), F.col("beside"), F.col("lean"))
        found.append(above.select("entity", "term", chance.alias("chance"), (F.col("size") / total).alias("share")))
    return found[0].union(found[1])


def disclosing_terms(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """(term, disclosure, removed): terms that disclose a value or group of entities to the degree ``generalise`` or more."""
    told = 1 - F.log("chance") / F.log("share")
    best = estimates(docs, text_col, prior).where("share < 1").groupBy("term").agg(F.max(told).alias("disclosure"))
    return cut_lineage(best.where(F.col("disclosure") >= generalise).withColumn("removed", F.col("disclosure") >= remove))


def term_spans(text: str, terms: dict[str, bool], base: list[Span]) -> list[Span]:
    """Spans of disclosing terms outside the base spans; kind 4 is generalised, 5 removed."""
    if not terms or _vocabulary(text).isdisjoint(terms):
        return []
    starts, ends = [s[0] for s in base], []
    for s in base:
        ends.append(max(s[2], ends[-1] if ends else 0))
    found = []
    for m in _WORD.finditer(text):
        removed = terms.get(m.group().lower())
        if removed is not None:
            i = bisect.bisect_left(starts, m.end()) - 1
            if i < 0 or ends[i] <= m.start():
                found.append((m.start(), 5 if removed else 4, m.end()))
    return found


_NAMES = (*KINDS, "term", "removed_term")


def clean(text: str, spans: list[Span]) -> str:
    """The text with entities and generalised terms replaced by their class and the other terms taken out."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            said = text[start:end]
            mark = f"[{KINDS[kind]}]" if kind < 4 else "" if kind == 5 else "[name]" if said[0].isupper() else "[word]"
            out += [text[at:start], mark]
        elif end <= at:
            continue
        at = end
    return "".join([*out, text[at:]])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{_NAMES[k]}:{a}:{b}" for a, k, b in spans)


def _marked(rows: DataFrame, terms: DataFrame, broadcast_terms: int, with_text: bool) -> DataFrame:
    """All columns of ``rows`` but its last, the text, with counts, base digest, spans and, if asked for, the clean text."""
    names = rows.columns[:-1]
    known = terms.select("term", "removed").limit(broadcast_terms + 1).collect()
    small = len(known) <= broadcast_terms
    shared = rows.sparkSession.sparkContext.broadcast({r.term: r.removed for r in known} if small else {})
    if not small:
        row, text = fresh(rows, "row"), rows.columns[-1]
        numbered = cut_lineage(rows.select("*", F.monotonically_increasing_id().alias(row)))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                used = [sorted(_vocabulary(t)) for t in batch.column(1).to_pylist()]
                ids = pa.array([i for i, w in zip(batch.column(0).to_pylist(), used) for _ in w], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for w in used for x in w], pa.string())], ["at", "term"])

        hits = numbered.select(row, text).mapInArrow(words, "at long, term string").join(terms.select("term", "removed"), "term")
        hits = hits.groupBy("at").agg(F.collect_list(F.struct("term", "removed")).alias("hits_"))  # no longer than the text's vocabulary
        own = fresh(numbered, "hits")
        rows = numbered.join(hits.select(F.col("at").alias(row), F.col("hits_").alias(own)), row, "left").select(*[f"`{c}`" for c in names], f"`{own}`", f"`{text}`")
    kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    added = [fresh(rows, n) for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_terms", "clean")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lists = [None] * len(texts) if small else batch.column(len(names)).to_pylist()
            for text, own_terms in zip(texts, lists):
                text = text or ""
                base = base_spans(text)
                these = shared.value if small else {x["term"]: x["removed"] for x in own_terms or ()}
                spans = sorted(base + term_spans(text, these, base))
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                found.append((*counts, digest, _listed(spans), len(spans), len(spans) - len(base), clean(text, spans) if with_text else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *added])

    schema = [f"`{c}` {kind}" for c, kind in rows.dtypes[: len(names)]] + [f"`{c}` {k}" for c, k in zip(added, ["long"] * 4 + ["string"] * 2 + ["long"] * 2 + ["string"])]
    return rows.mapInArrow(mark, ", ".join(schema))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS, **thresholds) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, and n_terms, the number of disclosing terms among them."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _marked(rows, disclosing_terms(docs, text_col, **thresholds), broadcast_terms, False).drop("clean")


def sanitise(docs: DataFrame, text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS, **thresholds) -> DataFrame:
    """The rows of ``docs`` with their texts sanitised and all other columns as they are; a null text becomes empty."""
    source = fresh(docs, "source_text")
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c != text_col], F.col(f"`{text_col}`").cast("string").alias(source))
    out = _marked(rows, disclosing_terms(docs, text_col, **thresholds), broadcast_terms, True)
    return out.select(*[F.col(f"`{out.columns[-1]}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
