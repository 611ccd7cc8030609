"""Centroid clustering with exact integer distances, filtered by an n-simplex projection.

A few pivots are picked once and the distance from every vector to every pivot is taken once. Seen from
the pivots, these distances place a vector at the apex of a simplex: as many coordinates as pivots, the
last one the height above the pivots' own space. For two apexes the plain Euclidean distance is a lower
bound of the true one, and the distance with one height turned over is an upper bound. In every
round a centroid whose lower bound exceeds another's upper bound is out; the others are
compared by exact integers.

Bounds are taken with a margin far above their rounding error, and an apex that does not give its own pivot
distances back (pivots that nearly lie in one plane) bounds nothing, so results never depend on
floating point.

Vectors and apexes are settled once in the checkpoint folder. A round reads them, sums up inside each
task and shuffles one row per task, centroid and component; centroids and pivots, a few dozen vectors,
are all that reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, settled_table, table

SCALE = 1024
MAX_PART = 1 << 27      # squared distances of 64 components stay within a long
PIVOTS = 32
_PIVOT_POOL = 256       # vectors among which the pivots are picked, by hash of the id
_MARGIN = 1e-5          # relative to the squared distances; apexes are kept in single precision
_MIN_HEIGHT = 1e-2      # a pivot nearer than this (relative) to the space of the others is no pivot


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to an integer point."""
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


class Simplex:
    """The pivots, their base simplex, and apexes above it."""

    def __init__(self, pool: np.ndarray, count: int):
        """Pick up to ``count`` pivots of ``pool``, each as high as possible above those before."""
        self.pivots, self.base = pool[:1], np.zeros((1, 0))
        while len(self.pivots) and len(self.pivots) < min(count, len(pool)):
            heights = self.apexes(pool)[:, -1]
            best = int(np.argmax(np.nan_to_num(heights)))
            reach = np.sqrt(max(float(squared(pool, self.pivots[0]).max()), 1.0))
            if not heights[best] > _MIN_HEIGHT * reach:
                break
            corner = self.apexes(pool[best:best + 1])[0]
            self.base = np.vstack([np.pad(self.base, ((0, 0), (0, 1))), corner])
            self.pivots = np.vstack([self.pivots, pool[best:best + 1]])

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates in as many dimensions as pivots, the last at least 0; NaN where they fail."""
        far = np.stack([squared(rows, p) for p in self.pivots], 1).astype(np.float64)
        corners = self.base[1:]
        sides = (far[:, :1] - far[:, 1:] + (corners ** 2).sum(1)) / 2
        flat = np.linalg.solve(corners, sides.T).T if len(corners) else sides
        height = np.sqrt(np.maximum(far[:, 0] - (flat ** 2).sum(1), 0))
        again = ((flat[:, None, :] - self.base[None]) ** 2).sum(2) + height[:, None] ** 2
        scale = far.max(1, keepdims=True) + (corners ** 2).sum(1).max(initial=1)
        apex = np.column_stack([flat, height])
        apex[(np.abs(again - far) > _MARGIN / 10 * scale).any(1)] = np.nan
        return apex


def bounds(apexes: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the squared distance to a centroid; 0 and infinity without an apex."""
    base = ((apexes[:, :-1] - centre[:-1]) ** 2).sum(1)
    margin = _MARGIN * ((apexes ** 2).sum(1) + (centre ** 2).sum() + 1)
    lower = base + (apexes[:, -1] - centre[-1]) ** 2 - margin
    upper = base + (apexes[:, -1] + centre[-1]) ** 2 + margin
    return np.nan_to_num(lower, nan=0.0), np.nan_to_num(upper, nan=np.inf)


def nearest(rows: np.ndarray, apexes: np.ndarray, centres: np.ndarray,
            peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), exact squared distance, integer comparisons made."""
    both = [bounds(apexes, peak) for peak in peaks]
    limit = np.min([upper for _, upper in both], axis=0)
    best, distance, compared = np.zeros(len(rows), np.int32), np.full(len(rows), np.iinfo(np.int64).max), 0
    for number, centre in enumerate(centres):
        near = np.flatnonzero(both[number][0] <= limit)
        compared += len(near)
        exact = squared(rows[near], centre)
        closer = exact < distance[near]
        distance[near[closer]] = exact[closer]
        best[near[closer]] = number
    return best, distance, compared


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), width)


def whole_parts(embedding: str, width: int) -> tuple[Column, Column]:
    """Whether a vector is used, and its integer components."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    keep = F.col(embedding).isNotNull() & (F.size(embedding) == width) & F.coalesce(fine, F.lit(False))
    limit = F.lit(float(MAX_PART))

    def part(x: Column) -> Column:
        scaled = F.floor(x * SCALE)
        return F.when((x * SCALE >= -limit) & (x * SCALE < limit), scaled).otherwise(F.raise_error(
            F.lit(f"a component beyond {MAX_PART // SCALE} has no squared distance within a long")).cast("bigint"))

    return keep, F.transform(wide, part)


def centroid_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, salt: str = "3",
                      width: int = 64, pivots: int = PIVOTS, id_col: str = "vec_id",
                      vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector used.

    Used are vectors of exactly ``width`` components, none null or non-finite; others give no row. Each
    component x counts as floor(1024 x). Centroids start as the vectors with the smallest sha256 of
    ``salt:id`` (null ids last, equal ids by their components); fewer vectors than ``clusters`` give as many
    centroids as there are vectors. Every round assigns all vectors to the nearest centroid (ties: the
    smaller number) and sets each non-empty centroid to floor(sum / count). Repeated rows and ids
    count as often as they occur. A component of 131072 or more in size ends in an error, as its squared
    distance may exceed a long. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    keep, parts = whole_parts("_v", width)
    used = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_v")).filter(keep).select(
        "vec_id", parts.alias("parts"))

    def first(prefix: str, count: int) -> np.ndarray:
        digest = F.sha2(F.concat(F.lit(f"{prefix}:"), F.col("vec_id").cast("string")), 256)
        rows = used.orderBy(digest.asc_nulls_last(), "parts").limit(count).select("parts").collect()
        return np.array([r["parts"] for r in rows], np.int64).reshape(-1, width)

    centres = first(salt, clusters)
    simplex = Simplex(first(f"pivot-{salt}", _PIVOT_POOL), pivots)
    n_apex = len(simplex.pivots)

    def project(batches):
        for batch in batches:
            rows = _matrix(batch.column(1), width, np.int64)
            apexes = simplex.apexes(rows).astype(np.float32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width,
                                                          rows.astype(np.int32).ravel()),
                pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * n_apex, apexes.ravel())],
                names=["vec_id", "parts", "apex"])

    schema = f"vec_id {id_type.simpleString()}, parts array<int>, apex array<float>"
    if not len(centres):
        placed = used.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return _described(placed, centres, {})
    settled = settled_table(used.mapInArrow(project, schema))

    def assigned(batches, now):
        peaks = simplex.apexes(now)
        for batch in batches:
            rows = _matrix(batch.column("parts"), width, np.int64)
            apexes = _matrix(batch.column("apex"), n_apex, np.float64)
            yield batch, rows, *nearest(rows, apexes, now, peaks)[:2]

    def sums(now):
        def add(batches):
            totals, counts = np.zeros((len(now), width), np.int64), np.zeros(len(now), np.int64)
            for _, rows, best, _ in assigned(batches, now):
                for number in np.unique(best):
                    mine = rows[best == number]
                    totals[number] += mine.sum(0)
                    counts[number] += len(mine)
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(held, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(held))),
                pa.array(totals[held].ravel()), pa.array(np.repeat(counts[held], width))],
                names=["cluster", "place", "total", "n"])

        partial = settled.select("parts", "apex").mapInArrow(add, "cluster int, place int, total long, n long")
        exact = "decimal(38,0)"
        return partial.groupBy("cluster", "place").agg(
            F.sum(F.col("total").cast(exact)).alias("total"), F.sum(F.col("n").cast(exact)).alias("n")).collect()

    for _ in range(rounds):
        moved = centres.copy()
        for r in sums(centres):     # one row per centroid and component
            moved[r["cluster"], r["place"]] = int(r["total"]) // int(r["n"])
        centres = moved

    def label(batches):
        for batch, _, best, distance in assigned(batches, centres):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    placed = settled_table(settled.mapInArrow(label, f"vec_id {id_type.simpleString()}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["inertia"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    return _described(placed, centres, inertia)


def _described(placed: DataFrame, centres: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """Each vector with the figures of its centroid, a dozen literals looked up by number."""
    def look(values, kind: str) -> Column:
        at = F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)])
        return F.try_element_at(at, F.col("cluster") + 1)

    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    numbers = range(len(centres))
    return placed.select(
        "vec_id", "cluster", "distance", look([inertia.get(k, 0) for k in numbers], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), look(digests, "string").alias("centroid_sha256"))


def _oracle(clusters: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Plain rounds in SQL: every vector against every centroid."""
    steps = [f"""parts AS MATERIALIZED (SELECT vec_id, unnest(range({width})) AS i,
        unnest(list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))::BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {width})""",
             f"""seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k
        FROM (SELECT DISTINCT vec_id FROM parts) ORDER BY k LIMIT {clusters})""",
             "c0 AS MATERIALIZED (SELECT k, i, x FROM parts JOIN seeds USING (vec_id))"]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT vec_id, k, sum((p.x - c.x) * (p.x - c.x)) AS d
            FROM parts p JOIN c{n} c USING (i) GROUP BY vec_id, k)""")
        steps.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, k, d FROM d{n}
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM parts JOIN a{n} USING (vec_id) GROUP BY k, i)""")
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.x
                ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
                FROM c{n} c LEFT JOIN m{n} m ON c.k = m.k AND c.i = m.i)""")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
            CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} a JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) USING (k)"""


@query("op12_simplex_clusters", _oracle())
def op12_simplex_clusters(spark, sf_dir):
    return centroid_clusters(table(spark, sf_dir, "embeddings"))
