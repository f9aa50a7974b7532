"""Algebra of bipolar and ternary vectors held as arrays, and sign-projection search over them.

Nothing is drawn at random: a token's vector and the projections come from MD5, alike in every run and engine. Bundles are sums
by position, so they aggregate partially before they shuffle. Vectors of one bundle have one length; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from driftloom.sources.shared import cut

from .vectors import top_k

#: Share of the members beyond which a ternary bundle's place is not 0.
CUT = 0.33
#: Tokens whose vectors a task holds at once.
TOKENS = 50_000


def bipolar(vector: Column) -> Column:
    """1 for places above zero, else -1."""
    return F.transform(vector, lambda v: F.when(v > 0, 1).otherwise(-1))


def bind(a: Column, b: Column) -> Column:
    """Element-wise product; its own inverse for bipolar vectors."""
    return F.zip_with(a, b, lambda x, y: x * y)


def bind_bits(a: Column, b: Column) -> Column:
    """Element-wise exclusive or of 0/1 vectors; its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def permute(vector: Column, shift: Column | int = 1) -> Column:
    """Circular shift to the right."""
    size = F.size(vector)
    by = F.pmod(shift if isinstance(shift, Column) else F.lit(shift), size)
    return F.when(size > 0, F.concat(F.slice(vector, size - by + 1, by), F.slice(vector, F.lit(1), size - by))).otherwise(vector)


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def token_vector(token: Column, size: int) -> Column:
    """The bipolar vector of a token: a place is 1 where the first hex digit of an MD5 is 8 or more."""
    digit = lambda i: F.substring(F.md5(F.concat(token, F.lit(":"), i.cast("string"))), 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(digit(i) >= "8", 1).otherwise(-1))


def _summed(rows: DataFrame, key: str, vector: Column, weight: Column) -> DataFrame:
    """Sum and weight of each place of each key's vectors."""
    places = rows.select(F.col(key), weight.alias("w"), F.posexplode(vector).alias("place", "v"))
    return places.groupBy(key, "place").agg(F.sum(F.col("v") * F.col("w")).alias("total"), F.count("*").alias("n"))


def _collected(places: DataFrame, key: str, value: Column) -> DataFrame:
    listed = places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", value.alias("v")))).alias("all"))
    return listed.select(key, F.transform("all", lambda x: x["v"]).alias("vector"))


def bundle(rows: DataFrame, key: str, vector: Column) -> DataFrame:
    """Majority of each place over a key's bipolar vectors, 0 for ties: key, vector."""
    return _collected(_summed(rows, key, vector, F.lit(1)), key, F.signum(F.col("total").cast("double")).cast("int"))


def weighted_bundle(rows: DataFrame, key: str, vector: Column, weight: Column) -> DataFrame:
    """The same with each vector counted max(1, floor(10 weight)) times."""
    times = F.greatest(F.lit(1), F.floor(10 * weight).cast("int"))
    return _collected(_summed(rows, key, vector, times), key, F.signum(F.col("total").cast("double")).cast("int"))


def ternary_bundle(rows: DataFrame, key: str, vector: Column) -> DataFrame:
    """1 or -1 where the mean of a place lies beyond ``CUT``, else 0."""
    mean = F.col("total") / F.col("n")
    return _collected(_summed(rows, key, vector, F.lit(1)), key, F.when(mean > CUT, 1).when(mean < -CUT, -1).otherwise(0))


def _token_bits(tokens: list[bytes | None], size: int) -> np.ndarray:
    """The vectors of ``token_vector``: a row for each token."""
    digits = [b"" if t is None else bytes(hashlib.md5(b"%b:%d" % (t, i)).digest()[0] for i in range(size)) for t in tokens]
    return np.array([np.where(np.frombuffer(d, np.uint8) >= 0x80, 1, -1) if d else np.full(size, -1) for d in digits], np.int8).reshape(-1, size)


def sequence_vectors(rows: DataFrame, key: str, tokens: Column, size: int) -> DataFrame:
    """Bundle of each row's token vectors, each shifted by its position: key, vector. Rows without tokens drop out.

    Keys are unique; rows of an equal key are bundled together. The tokens are dealt by key, so that a small file is not one task, and places
    are no rows: a batch makes the vector of each of its different tokens once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(size)
        for batch in batches:
            lists = batch.column("lists")
            inner, total = lists.flatten(), np.zeros((len(batch), size), np.int32)
            sizes = np.asarray(inner.value_lengths())
            row = np.repeat(np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths())), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            words = inner.flatten()
            for low in range(0, len(row), TOKENS):
                some = words.slice(low, TOKENS).dictionary_encode(null_encoding="encode")
                vectors, part = _token_bits(some.dictionary.to_pylist(), size), slice(low, low + TOKENS)
                shifted = vectors[some.indices.to_numpy()[:, None], (places - at[part, None]) % size]
                starts = np.flatnonzero(np.r_[True, np.diff(row[part]) > 0])
                total[row[part][starts]] += np.add.reduceat(shifted, starts, axis=0, dtype=np.int32)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * size
            vector = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.sign(total).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), vector], names=[key, "vector"])

    some = rows.select(F.col(key), tokens.cast("array<string>").cast("array<binary>").alias("lists")).where(F.size("lists") > 0)
    listed = some.repartition(F.col(key)).groupBy(key).agg(F.collect_list("lists").alias("lists"))
    return listed.mapInArrow(run, StructType([listed.schema[key], StructField("vector", ArrayType(IntegerType()))]))


def nearest(rows: DataFrame, key: str, vector: str, candidates: DataFrame, name: str) -> DataFrame:
    """The candidate (name, vector) that agrees most with each row, the least name of equals. Candidates are a stated small set: every
    row meets each of them."""
    named = candidates.select(F.col(name).alias("candidate"), F.col("vector").alias("other"))
    met = rows.select(key, vector).crossJoin(named).withColumn("agreement", F.round(agreement(F.col(vector), F.col("other")), 6))
    best = F.max_by(F.struct("candidate", "agreement"), F.struct(F.col("agreement"), -F.col("candidate")))
    return met.groupBy(key).agg(best.alias("b")).select(key, "b.candidate", "b.agreement")


def projections(vector: Column, tables: int, bits: int, size: int) -> Column:
    """One integer for each table: bits of whether the dot product with a ternary plane from MD5 is above 0, the first bit highest."""
    digit = lambda t, b, i: F.conv(F.substring(F.md5(F.concat_ws(":", t.cast("string"), b.cast("string"), i.cast("string"))), 1, 4), 16, 10).cast("int") % 3 - 1
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def bit(t: Column, b: Column) -> Column:
        dot = F.aggregate(F.zip_with(places, vector, lambda i, v: digit(t, b, i) * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.round(dot, 6) > 0, 1).otherwise(0)

    whole = lambda t: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: bit(t, b)), F.lit(0), lambda s, v: s * 2 + v)
    return F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), whole)


def plane_table(spark, tables: int, bits: int, size: int) -> DataFrame:
    """The planes as one row ``planes`` (tables x bits arrays), made once so that rows need no MD5."""
    ids = F.sequence(F.lit(0), F.lit(size - 1))
    plane = lambda t, b: F.transform(ids, lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", t.cast("string"), b.cast("string"), i.cast("string"))), 1, 4), 16, 10).cast("int") % 3 - 1)
    made = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: plane(t, b)))
    return spark.range(1).select(made.alias("planes"))


def _bucket(planes: Column, vector: Column) -> Column:
    """The number of a vector's bucket by the planes of one table."""
    dot = lambda p: F.aggregate(F.zip_with(p, vector, lambda a, v: a * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(planes, lambda p: F.when(F.round(dot(p), 6) > 0, 1).otherwise(0)), F.lit(0), lambda s, v: s * 2 + v)


def hashed(rows: DataFrame, key: str, vector: str, tables: int = 8, bits: int = 16, size: int = 64) -> DataFrame:
    """Bucket of each row in each table: key, slot, bucket. The planes are tables x bits x size small numbers in one row."""
    planes = F.broadcast(plane_table(rows.sparkSession, tables, bits, size))
    return rows.select(key, vector).crossJoin(planes).select(key, F.posexplode(F.transform("planes", lambda ps: _bucket(ps, F.col(vector)))).alias("slot", "bucket"))


def bucket_matches(queries: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """Rows that share a bucket with a query (slot, bucket): query, key, slots shared. The queries are a stated set."""
    asked = queries.select(F.col(key).alias("query"), "slot", "bucket")
    return asked.join(buckets, ["slot", "bucket"]).where(F.col("query") != F.col(key)).groupBy("query", key).agg(F.count("*").alias("shared"))


def bucket_search(queries: DataFrame, rows: DataFrame, key: str, vector: str, tables: int, bits: int, k: int, size: int = 64) -> DataFrame:
    """The ``k`` most similar rows (cosine, six places) of those that share a bucket with a query: query, key, similarity, nth.

    Fewer bits make larger buckets and a better recall: vectors whose neighbours are hardly nearer than others need about
    three, well separated ones a dozen. Ties go to the smaller key. The queries are a stated set; rows without length have a similarity of 0.
    """
    planes = F.broadcast(plane_table(rows.sparkSession, tables, bits, size))
    # the buckets travel as a vector's first places, so candidates are told inside the cells of blocks and are no rows
    known = rows.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v")).crossJoin(planes)
    tagged = cut(known.select(key, F.concat(F.transform("planes", lambda ps: _bucket(ps, F.col("v")).cast("double")), "v").alias("v")))
    near = top_k(tagged.join(queries.select(key).distinct(), key, "left_semi"), tagged, key, "v", k, tables)
    return near.select(F.col("a").alias("query"), F.col("b").alias(key), "similarity", "nth")
