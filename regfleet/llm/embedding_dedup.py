"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components.

Equal vectors of a label are one vector with a count from the start. Each of
several tables puts the vectors of a label into buckets by the signs of their
products with random hyperplanes; the numbers of bits and tables follow from the
number of vectors and the wanted recall at the threshold. A bucket is compared
in blocks of bounded size, and a pair is counted only in the first table in
which both share a bucket, so no list of pairs is ever made: a block gives the
number of links of each vector and a link to the smallest vector it reaches.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze
from .components import components
from .words import mix

#: Most vectors of one side of a compared block.
BLOCK = 1_024

#: Vectors that a bucket has on average, if signs were even.
BUCKET = 2_048


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int


def plan_tables(vectors: int, cosine: float, recall: float) -> Plan:
    """Bits that keep buckets small, and tables that find a pair at the threshold with the wanted probability."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, vectors) / BUCKET))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return Plan(bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _valid_rows(batches):
    """(vec, label, dim, digest, vector): a usable vector's digest is equal for equal vectors, else null."""
    for batch in batches:
        vectors = batch.column("vector")
        digest = np.zeros(len(vectors), dtype=np.int64)
        usable = np.zeros(len(vectors), dtype=bool)
        dims = np.zeros(len(vectors), dtype=np.int32)
        for k in range(len(vectors)):
            if not vectors[k].is_valid or not batch.column("label")[k].is_valid:
                continue
            values = vectors[k].values
            if values.null_count or not len(values):
                continue
            x = np.asarray(values, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                place = mix(np.arange(1, len(x) + 1, dtype=np.uint64))
                usable[k], dims[k] = True, len(x)
                digest[k] = mix(mix((x + 0.0).view(np.uint64) ^ place).sum(keepdims=True)).view(np.int64)[0]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec"), batch.column("label"), pa.array(dims), pa.array(digest, mask=~usable), vectors],
            names=["vec", "label", "dim", "digest", "vector"],
        )


def _signatures(dim: int, plan: Plan, seed: int, x: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng([seed, dim]).standard_normal((dim, plan.tables * plan.bits))
    signs = (x @ planes > 0).reshape(len(x), plan.tables, plan.bits)
    return (signs << np.arange(plan.bits)).sum(axis=2).astype(np.int32)


def _signature_rows(plan: Plan, seed: int):
    def rows(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                signs = _signatures(int(dim), plan, seed, _matrix(part.column("vector"), int(dim)))
                flat = pa.array(signs.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, plan.tables, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "signs"])

    return rows


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` places reaches by the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(cosine: float):
    """Links inside a block of one bucket: (vec, links, root)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec")
        here, lo, hi = (table.column(c).to_numpy() for c in ("block", "block_a", "block_b"))
        dim, number = table.column("dim")[0].as_py(), table.column("table")[0].as_py()
        x = _matrix(table.column("vector").combine_chunks(), dim)
        signs = np.asarray(table.column("signs").combine_chunks().flatten()).reshape(len(x), -1)
        vec, weight = table.column("vec").to_numpy(), table.column("n").to_numpy()
        left, right = np.flatnonzero(here == lo[0]), np.flatnonzero(here == hi[0])
        norm = np.sqrt((x * x).sum(axis=1))
        near = (x[left] @ x[right].T) / np.outer(norm[left], norm[right]) >= cosine
        if lo[0] == hi[0]:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        new = ~(signs[a, :number] == signs[b, :number]).any(axis=1)
        a, b = a[new], b[new]
        links = np.bincount(a, weights=weight[b], minlength=len(x)) + np.bincount(b, weights=weight[a], minlength=len(x))
        root = _roots(len(x), a, b)
        found = links > 0
        return pa.table(
            {"vec": vec[found], "links": links[found].astype(np.int64), "root": vec[root[found]]},
            schema=pa.schema([("vec", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]),
        )

    return compare


def near_vectors(
    rows: DataFrame,
    vec: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
    recall: float = 0.9999,
    seed: int = 17,
) -> DataFrame:
    """(vec, n_links, component_id, kept) of every row.

    Vectors are compared only with others of an equal, non-null label and of the
    same length. A vector that is null, empty, zero or holds null or non-finite
    components links with nothing. Every link has a cosine of at least ``cosine``
    in double precision; a pair exactly at it is found with the probability
    ``recall``, closer ones more surely. Rows that repeat an id count as
    vectors of their own with a common component. Other columns are ignored.
    """
    kind = dict(rows.dtypes)[label]
    source = rows.select(F.col(vec).cast("bigint").alias("vec"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    schema = f"vec bigint, label {kind}, dim int, digest bigint, vector {dict(rows.dtypes)[vector]}"
    known = freeze(source.mapInArrow(_valid_rows, schema), "vectors")
    group = ["label", "dim", "digest"]
    copies = freeze(
        known.filter("digest IS NOT NULL").groupBy(*group).agg(F.min("vec").alias("first"), F.count("*").alias("n")), "copies"
    )
    firsts = known.filter("digest IS NOT NULL").withColumnRenamed("vec", "first")
    distinct = firsts.join(copies, [*group, "first"]).dropDuplicates(group)
    plan = plan_tables(copies.count(), cosine, recall)
    schema = ", ".join(f"{c} {t}" for c, t in [*distinct.dtypes, ("signs", "array<int>")])
    signed = freeze(distinct.mapInArrow(_signature_rows(plan, seed), schema), "signed-vectors")

    bucket = ["table", "label", "dim", "sign"]
    spread = signed.select("label", "dim", F.col("first").alias("vec"), F.posexplode("signs").alias("table", "sign"))
    sizes = spread.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    large = F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes
    rows_of = signed.select(
        "label", "dim", F.col("first").alias("vec"), "n", "vector", "signs", F.posexplode("signs").alias("table", "sign")
    )
    blocked = (
        rows_of.join(large, bucket, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
        .drop("other", "blocks")
    )
    linked = freeze(
        blocked.groupBy(*bucket, "block_a", "block_b").applyInArrow(_compare(cosine), "vec bigint, links bigint, root bigint"),
        "vector-links",
    )
    found = components(linked.select(F.col("vec").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("vec").agg(F.sum("links").alias("links")).withColumnRenamed("vec", "first")
    of_copies = copies.join(counts, "first", "left").join(found, copies["first"] == found["node"], "left")
    of_copies = of_copies.select(
        *group,
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "first").alias("component"),
    )
    return (
        known.join(of_copies, group, "left")
        .select(
            F.col("vec").alias(vec),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component", "vec").alias("component_id"),
        )
        .withColumn("kept", F.col(vec) == F.col("component_id"))
    )
