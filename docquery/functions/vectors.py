"""Vector functions: N9 hashed bag-of-tokens embedding and cosine similarity (JVM-side).

A hashed embedding is a sparse vector ``array<struct<b:int, c:int>>`` sorted by bucket ``b`` with count
``c``; dot products and norms are integers so every engine computes the same cosine bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery import config as C


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Maximal runs of letters, digits, apostrophes and dashes, in text order."""
    return F.regexp_extract_all(_col(text), F.lit(C.TOKEN_PATTERN), 0)


def token_bucket(token) -> Column:
    """Bucket of one token: first 28 bits of md5 of the lower-cased token, modulo the width."""
    h = F.conv(F.substring(F.md5(F.lower(token)), 1, 7), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(C.EMBED_BUCKETS)).cast("int")


def with_embedding(df: DataFrame, text_col: str, out: str = "vector", norm_out: str | None = "norm2") -> DataFrame:
    """Add the sparse token-count vector of ``text_col`` (sorted by bucket) and its squared norm.

    Built in staged columns (sorted buckets → run starts → (bucket, count) runs) so that every array is
    computed once per row; a lambda that referenced an un-materialised array would recompute it per
    element.
    """
    hb, hs = f"_{out}_b", f"_{out}_s"
    df = df.withColumn(hb, F.array_sort(F.transform(tokens(F.col(text_col)), token_bucket)))
    s, n = F.col(hb), F.size(F.col(hb))
    df = df.withColumn(hs, F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (F.size(F.col(hb)) > 0)
        & ((i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1)))))))
    st = F.col(hs)
    df = df.withColumn(out, F.transform(
        st, lambda x, j: F.struct(F.try_element_at(s, x).alias("b"),
                                  (F.coalesce(F.try_element_at(st, j + 2), F.size(s) + 1) - x).alias("c"))))
    df = df.drop(hb, hs)
    if norm_out:
        df = df.withColumn(norm_out, sparse_norm2(out))
    return df


def sparse_norm2(v) -> Column:
    return F.aggregate(_col(v), F.lit(0).cast("bigint"), lambda acc, e: acc + e["c"].cast("bigint") * e["c"])


def with_sparse_cosine(df: DataFrame, a: str, b: str, na: str, nb: str, out: str = "cosine") -> DataFrame:
    """Integer dot product by merging both sorted bucket lists (equal neighbours are shared buckets),
    then ``dot / sqrt(na * nb)``."""
    mc = f"_{out}_m"
    df = df.withColumn(mc, F.array_sort(F.concat(F.col(a), F.col(b))))
    m = F.col(mc)
    dot = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1))), F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.coalesce(
            F.when(F.try_element_at(m, i)["b"] == F.try_element_at(m, i + 1)["b"],
                   F.try_element_at(m, i)["c"].cast("bigint") * F.try_element_at(m, i + 1)["c"]),
            F.lit(0).cast("bigint")))
    return df.withColumn(out, cosine_from_parts(dot, na, nb)).drop(mc)


def cosine_from_parts(dot, n1, n2) -> Column:
    """``dot / sqrt(n1 * n2)``; 0 when either vector is empty."""
    prod = (_col(n1) * _col(n2)).cast("double")
    return F.when(prod > 0, _col(dot).cast("double") / F.sqrt(prod)).otherwise(F.lit(0.0))


def dense_dot(a, b) -> Column:
    """Dot product of two float arrays, summed left to right in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dense_norm2(a) -> Column:
    return dense_dot(a, a)


def dense_cosine(a, b, n1=None, n2=None) -> Column:
    """``dot / sqrt(|a|² · |b|²)``; 0 when a norm is 0. Norms may be precomputed."""
    n1 = dense_norm2(a) if n1 is None else _col(n1)
    n2 = dense_norm2(b) if n2 is None else _col(n2)
    return cosine_from_parts(dense_dot(a, b), n1, n2)
