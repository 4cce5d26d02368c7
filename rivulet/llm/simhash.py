"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all its variants within half the radius (at
radius 2: itself and its 64 one-bit neighbours). The variants are shuffled; two
fingerprints within the radius meet on one at least. What meets on a variant is
summed up as 64 bits (which neighbours) and a flag (the variant itself), so a
group has a fixed size however many documents share it, and is combined before
the shuffle. Members are worked out from the bits, verified by their distance,
linked to the least of them, and the links make components.

Null text is taken as empty; texts without words have fingerprint zero and are
linked like any other. Repeated rows and equal ids give a row each. Whole texts
count, in blocks of shingles.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, scratch, stored
from rivulet.llm.components import connected_components

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Shingles hashed at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash over word shingles, repeats included."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, joined, repeat(SEED))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = np.fromiter(islice(hashes, BLOCK), np.uint64, min(BLOCK, n - at))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint (long) of ``text_col``."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return df.withColumn(out_col, prints(F.col(text_col)))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at most ``radius`` (1 or 2) bits
    apart, enough to connect whatever is connected: each group that meets on a
    variant gives a star. ``prints`` has one column of distinct longs."""
    if radius not in (1, 2):
        raise ValueError("ball hashing by one-bit variants serves a radius of 1 or 2")
    spark, fp = prints.sparkSession, F.col(prints.columns[0])
    # the prints are few bytes but each makes 65 rows: not to be gathered in a task or two
    prints = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    ball = F.array(F.struct(fp.alias("variant"), F.lit(0).cast("long").alias("flip"), F.lit(1).alias("self")), *(F.struct(fp.bitwiseXOR(F.lit(b)).alias("variant"), F.lit(b).alias("flip"), F.lit(0).alias("self")) for b in bits))
    met = (
        prints.select(F.explode(ball).alias("x"))
        .select("x.*")
        .groupBy("variant")
        .agg(F.bit_or("flip").alias("flips"), F.max("self").alias("self"))
        .where(F.bit_count("flips") + F.col("self") > 1)
    )
    flipped = F.transform(F.filter(F.array(*map(F.lit, bits)), lambda b: F.col("flips").bitwiseAND(b) != 0), lambda b: F.col("variant").bitwiseXOR(b))
    members = F.concat(F.when(F.col("self") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")), flipped)
    pairs = met.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return pairs.where((F.col("a") != F.col("b")) & (near <= radius)).distinct()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: its id, ``fingerprint`` (long) and
    ``component_id``, the least id reachable over links of at most ``radius``
    bits (null ids count as greatest)."""
    with scratch(df.sparkSession):
        docs = stored(with_fingerprint(df.select(F.col(id_col), F.col(text_col).alias("_rv_text")), "_rv_text", "fingerprint", shingle).drop("_rv_text"), "prints")
        least = docs.groupBy("fingerprint").agg(F.min(id_col).alias("_rv_least"))
        roots = connected_components(links(docs.select("fingerprint").distinct(), radius))
        joined = least.join(roots, least.fingerprint == roots.node, "left").select("fingerprint", "_rv_least", F.coalesce("root", "fingerprint").alias("_rv_root"))
        named = joined.join(joined.groupBy("_rv_root").agg(F.min("_rv_least").alias("component_id")), "_rv_root")
        return stored(docs.join(named.select("fingerprint", "component_id"), "fingerprint").select(id_col, "fingerprint", "component_id"), "components", lasting=True)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``df`` for each component: that of least id (null as greatest),
    then of least hash of the text. Of equal rows one stays, whichever."""
    d, t = F.col(id_col), F.col(text_col)
    keys = {"_rv_k1": F.xxhash64(d.cast("string"), d.isNull()), "_rv_k2": F.xxhash64(F.coalesce(t, F.lit("")))}
    own = df.select(d.isNull().alias("_rv_null"), d.alias("_rv_id"), keys["_rv_k2"].alias("_rv_k2"), keys["_rv_k1"].alias("_rv_k1"), t.alias("_rv_text"))
    with scratch(df.sparkSession):
        prints = stored(with_fingerprint(own, "_rv_text", "fingerprint", shingle).drop("_rv_text"), "prints")
        first = prints.groupBy("fingerprint").agg(F.min(F.struct("_rv_null", "_rv_id", "_rv_k2", "_rv_k1")).alias("_rv_first"))
        roots = connected_components(links(prints.select("fingerprint").distinct(), radius))
        joined = first.join(roots, first.fingerprint == roots.node, "left").select(F.coalesce("root", "fingerprint").alias("_rv_root"), "_rv_first")
        chosen = stored(joined.groupBy("_rv_root").agg(F.min("_rv_first").alias("f")).select("f._rv_k1", "f._rv_k2"), "chosen", lasting=True)
    kept = df.withColumns(keys).join(chosen, ["_rv_k1", "_rv_k2"], "left_semi")
    return kept.dropDuplicates(["_rv_k1", "_rv_k2"]).select(*df.columns)


def digest(df: DataFrame) -> DataFrame:
    """The query's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return components(df).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
