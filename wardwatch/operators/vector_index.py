"""Vector search on a stored, partitioned index (J04, X07, T04), beside the exact mode of ``retrieval``.

Vectors are filed in cells, each the surroundings of a centroid (k-means on a
bounded sample of unit vectors, ``SAMPLE_ROWS``); every vector is filed, only
the centroids come from the sample.  A cell above ``CELL_ROWS`` is split by a
hash of the document.  A search looks into the ``probes`` nearest cells of
each query and scores all vectors there exactly (cosine in doubles), so the
ranks among the vectors it sees are those of the exact mode.  How many cells
that takes is measured when the index is built: ``TRIAL_ROWS`` vectors are
searched for exactly, and enough cells are probed for ``TARGET`` of their
neighbours (few where the vectors cluster, most where they don't).  The parts
of cells are dealt to shards of ``BLOCK_BYTES``, and a query is sent once to
each shard that holds a part of a cell it probes, not once per cell; the
queries of a shard are split into crowds of as many bytes and ``QUERY_ROWS`` at
most.  A task holds one crowd and one shard, finds the cells that each query
probes and scores cell by cell, so its memory grows with neither table.

Vectors of one length make cells of their own; lengths that the sample
doesn't hold have one cell each, which all queries of that length look into.
Null, empty and zero vectors, and those with entries that aren't finite, have
no cosine and are neither filed nor found.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.operators.retrieval import _Best, _bytes, _hits_schema, _lengths, _matrix, _merge_topk, _score_into, _unit, vector_topk
from wardwatch.session import cut_lineage, ensure_checkpoint_dir, ship_package

SAMPLE_ROWS = 10_000
CELL_ROWS = 4096
QUERY_ROWS = 65_536
#: Bytes of vectors of a shard and of a crowd.
BLOCK_BYTES = 16 << 20
#: Cells of (query, centroid) that are held at a time.
NEAR_CELLS = 2_000_000
MAX_CELLS = 4096
ROUNDS = 12
#: Vectors that are searched for to learn the number of probes, their neighbours, and the recall that is aimed at.
TRIAL_ROWS, TRIAL_K, TARGET = 200, 5, 0.95
#: Number of the cell of a length that has no centroids.
NO_CENTROID = 2**31


def train(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by Lloyd's iteration from evenly spread starts; the same on every run."""
    rng = np.random.default_rng(5)
    cells = min(cells, len(x))
    centers = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        moved = np.linalg.norm(sums, axis=1) > 0
        centers = np.where(moved[:, None], _unit(np.where(moved[:, None], sums, 1.0)), centers)
    return centers


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors) of the vectors in a batch that have a direction."""
    vecs = batch.column(column)
    sizes = _lengths(vecs)
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        unit = _unit(_matrix(vecs.take(pa.array(rows))))
        good = np.isfinite(unit).all(1)
        if good.any():
            yield width, rows[good], unit[good]


@dataclass(frozen=True)
class VectorIndex:
    """An index: the folder of its tables and the centroids of each vector length (at most ``MAX_CELLS`` a length)."""

    spark: SparkSession
    path: str
    centroids: dict[int, np.ndarray] = field(repr=False)
    probes: int = 1

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("cell long, part long, doc_id long, vec array<double>").parquet(f"{self.path}/vectors")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell long, n long, parts long").parquet(f"{self.path}/cells")


def build(docs: DataFrame, path: str | None = None, cells: int | None = None, sample: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> VectorIndex:
    """File ``docs`` (doc_id, vec) at ``path``, by default a fresh folder beside the checkpoints."""
    spark = docs.sparkSession
    ship_package(spark)
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    drawn = rows.where(F.size("vec") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    wanted = cells or math.ceil(math.sqrt(rows.count()))
    known: dict[int, list[np.ndarray]] = {}
    for batch in drawn.to_batches():
        for width, _, unit in _by_length(batch, 1):
            known.setdefault(width, []).append(unit)
    centroids = {w: train(np.concatenate(x), max(1, min(wanted, MAX_CELLS, sum(map(len, x)) // 4))) for w, x in known.items()}
    shared = spark.sparkContext.broadcast(centroids)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, unit in _by_length(batch, 1):
                centers = shared.value.get(width)
                cell = np.full(len(at), NO_CENTROID) if centers is None else (unit @ centers.T).argmax(1)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array((width << 32) + cell.astype(np.int64)), kept.column(0), kept.column(1)], ["cell", "doc_id", "vec"])

    placed = cut_lineage(rows.mapInArrow(filed, "cell long, doc_id long, vec array<double>"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / cell_rows))
    sizes.write.parquet(f"{path}/cells")
    index = VectorIndex(spark, path, centroids)
    parted = placed.join(index.cells, "cell").select("cell", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), "doc_id", "vec")
    parted.repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/vectors")
    return replace(index, probes=_enough(index, rows, drawn))


def _enough(index: VectorIndex, rows: DataFrame, drawn: pa.Table) -> int:
    """The number of nearest cells that hold ``TARGET`` of the exact neighbours of some vectors of the sample, themselves left out."""
    trial = index.spark.createDataFrame(drawn.slice(0, TRIAL_ROWS)).withColumnRenamed("doc_id", "query_id")
    near = vector_topk(trial, rows, TRIAL_K + 1).where("query_id <> doc_id").join(index.vectors.select("doc_id", "cell"), "doc_id")
    found = near.select("query_id", "cell").join(trial, "query_id").select("vec", "cell").toArrow()  # some thousand rows at most
    places = []
    for batch in found.to_batches():
        for width, at, unit in _by_length(batch, 0):
            centers = index.centroids.get(width)
            if centers is not None:
                own = batch.column(1).take(pa.array(at)).to_numpy(zero_copy_only=False) & (2**32 - 1)
                like = unit @ centers.T
                places += (like > like[np.arange(len(at)), own][:, None]).sum(1).tolist()
    return int(np.quantile(places, TARGET, method="higher")) + 1 if places else 1


def _probed(unit: np.ndarray, centers: np.ndarray, probes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, probed): for some rows at a time whether they look into a cell."""
    many = min(probes, len(centers))
    step = max(1, NEAR_CELLS // len(centers))
    for lo in range(0, len(unit), step):
        like = unit[lo : lo + step] @ centers.T
        probed = np.zeros(like.shape, bool)
        np.put_along_axis(probed, np.argpartition(-like, many - 1, axis=1)[:, :many], True, axis=1)
        yield lo, probed


def _scored(k: int, probes: int, shared, schema: pa.Schema):
    """Best k of a shard for a crowd, each query in the cells it probes."""

    def fn(queries: pa.Table, docs: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and docs.num_rows:
            cells = docs.column("cell").to_numpy()
            ids, vecs = docs.column("doc_id").to_numpy().astype(np.int64), docs.column("vec").combine_chunks()
            crowd = pa.RecordBatch.from_arrays([queries.column("query_id").combine_chunks(), queries.column("vec").combine_chunks()], ["query_id", "vec"])
            for width, at, unit in _by_length(crowd, 1):
                mine = np.flatnonzero(cells >> 32 == width)
                if not len(mine):
                    continue
                mine = mine[np.argsort(cells[mine], kind="stable")]
                there, stored = _unit(_matrix(vecs.take(pa.array(mine)))), cells[mine] & (2**32 - 1)
                numbers, starts = np.unique(stored, return_index=True)
                ends = np.append(starts[1:], len(stored))
                best = _Best(len(at), k)
                centers = shared.value.get(width)
                for lo, probed in _probed(unit, centers, probes) if centers is not None else [(0, None)]:
                    for cell, a, b in zip(numbers.tolist(), starts, ends):
                        rows = np.arange(len(unit)) if probed is None else lo + np.flatnonzero(probed[:, cell])
                        _score_into(best, rows, unit[rows], there[a:b], ids[mine[a:b]])
                places, found, scores = best.rows()
                parts.append(pa.Table.from_arrays([crowd.column(0).take(pa.array(at[places])), pa.array(found), pa.array(scores)], names=schema.names).cast(schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return fn


def search(queries: DataFrame, index: VectorIndex, k: int = 5, probes: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best k of the vectors in the ``probes`` cells nearest to each query."""
    spark, probes = index.spark, probes or index.probes
    ship_package(spark)
    struct, schema = _hits_schema(queries.schema["query_id"].dataType)
    rows = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    parts = index.cells.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    shards = max(1, math.ceil(_bytes(index.vectors) / BLOCK_BYTES))
    shard = F.pmod(F.xxhash64("cell", "part"), F.lit(shards)).cast("int").alias("shard")
    where: dict[int, set[int]] = {}
    for r in parts.select("cell", shard).distinct().collect():  # MAX_CELLS and a row per CELL_ROWS at most
        where.setdefault(r.cell, set()).add(r.shard)
    held = {w: np.zeros((len(c), shards), bool) for w, c in index.centroids.items()}
    alone: dict[int, np.ndarray] = {}
    for cell, some in where.items():
        width, number = cell >> 32, cell & (2**32 - 1)
        if width in held and number != NO_CENTROID:
            held[width][number, sorted(some)] = True
        else:
            alone[width] = np.isin(np.arange(shards), sorted(some))
    shared, placed = spark.sparkContext.broadcast(index.centroids), spark.sparkContext.broadcast((held, alone))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once for each shard that it looks into."""
        step = max(1, 65_536 // shards)
        for batch in batches:
            for width, at, unit in _by_length(batch, 1):
                held, alone = placed.value
                if width in alone:
                    looks = [(0, np.broadcast_to(alone[width], (len(at), shards)))]
                elif width in held:
                    looks = ((lo, probed @ held[width]) for lo, probed in _probed(unit, shared.value[width], probes))
                else:
                    continue
                for lo, into in looks:
                    for a in range(0, len(into), step):
                        row, to = np.nonzero(into[a : a + step])
                        kept = batch.take(pa.array(at[lo + a + row]))
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(to.astype(np.int32))], ["query_id", "vec", "shard"])

    many, size = rows.count(), _bytes(rows)
    crowds = max(1, math.ceil(size / BLOCK_BYTES), math.ceil(many / query_rows))
    crowd = F.pmod(F.xxhash64("query_id"), F.lit(crowds)).cast("int").alias("crowd")
    left = rows.mapInArrow(sent, f"query_id {dict(rows.dtypes)['query_id']}, vec array<double>, shard int").select("query_id", "vec", "shard", crowd)
    right = index.vectors.select("cell", "doc_id", "vec", shard, F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))).alias("crowd"))
    keys = ["shard", "crowd"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored(k, probes, shared, schema), struct)
    return _merge_topk(hits, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_exact, n_found, recall): how much of the exact answer an index search found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    sums = both.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return sums.withColumn("recall", F.try_divide("n_found", "n_exact"))
