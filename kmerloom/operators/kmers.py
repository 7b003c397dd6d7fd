"""k-mer features in three forms: long and sparse, one array a sequence, and (only when exported) wide."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Kmers
from ..functions import sequences


def vocabulary(spark: SparkSession, p: Kmers = Kmers()) -> DataFrame:  # noqa: B008
    """kmer_idx and kmer in the alphabet's order."""
    n = len(p.alphabet)
    digits = [F.substring(F.lit(p.alphabet), (F.floor(F.col("id") / n ** (p.k - 1 - i)) % n + 1).cast("int"), F.lit(1)) for i in range(p.k)]
    return spark.range(n**p.k).select(F.col("id").alias("kmer_idx"), F.concat(*digits).alias("kmer"))


def counts(seqs: DataFrame, key: str = "sequence_id", p: Kmers = Kmers(), *extra: str) -> DataFrame:  # noqa: B008
    """key, kmer, n: valid windows only; sequences without any have no rows."""
    return seqs.select(key, *extra, F.explode(sequences.kmers(F.col("sequence"), p.k, p.alphabet)).alias("kmer")).groupBy(key, *extra, "kmer").agg(F.count("*").alias("n"))


def frequencies(seqs: DataFrame, key: str = "sequence_id", p: Kmers = Kmers(), *extra: str) -> DataFrame:  # noqa: B008
    """key, kmer, n, freq. The total comes from the same windows array, so nothing is shuffled for it."""
    cut = seqs.select(key, *extra, sequences.kmers(F.col("sequence"), p.k, p.alphabet).alias("w"))
    long = cut.select(key, *extra, F.size("w").alias("total"), F.explode("w").alias("kmer"))
    return long.groupBy(key, *extra, "total", "kmer").agg(F.count("*").alias("n")).select(key, *extra, "kmer", "n", (F.col("n") / F.col("total")).alias("freq"))


def without_kmers(seqs: DataFrame, p: Kmers = Kmers()) -> DataFrame:  # noqa: B008
    """Sequences with no valid window, which no feature table has."""
    return seqs.filter(F.size(sequences.kmers(F.col("sequence"), p.k, p.alphabet)) == 0)


def matrix(seqs: DataFrame, key: str = "sequence_id", p: Kmers = Kmers(), *extra: str) -> DataFrame:  # noqa: B008
    """key and features: a dense array of frequencies in the vocabulary's order, made within each row: no shuffle at all.

    Counting goes by a hash of the fixed vocabulary; sequences without a valid window have no row.
    """
    words = ["".join(w) for w in product(p.alphabet, repeat=p.k)]
    count = CountVectorizerModel.from_vocabulary(words, inputCol="__w", outputCol="__c")
    cut = seqs.select(key, *extra, sequences.kmers(F.col("sequence"), p.k, p.alphabet).alias("__w")).filter(F.size("__w") > 0)
    shares = Normalizer(p=1.0, inputCol="__c", outputCol="__f").transform(count.transform(cut))
    return shares.select(key, *extra, vector_to_array("__f").alias("features"))


def counted(sequence: Column, p: Kmers = Kmers()) -> Column:  # noqa: B008
    """An array of counts in the vocabulary's order; all zero where there is no valid window. Letters are numbers, windows never texts of their own."""
    size, letters = len(p.alphabet), np.full(0x110000, -1, np.int16)
    letters[[ord(c) for c in p.alphabet]] = np.arange(size)

    def count(text: str) -> np.ndarray:
        code = letters[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        n = max(0, len(code) - p.k + 1)
        index, valid = np.zeros(n, np.int64), np.full(n, True)
        for i in range(p.k):
            letter = code[i : i + n]
            index = index * size + letter
            valid &= letter >= 0
        return np.bincount(index[valid], minlength=size**p.k).astype(np.int32)

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([count(x) for x in s], dtype=object)

    return run(F.coalesce(F.upper(sequence), F.lit("")))


def vectors(features: DataFrame, column: str = "features") -> DataFrame:
    """The array as an ML vector."""
    return features.withColumn(column, array_to_vector(F.col(column)))


def top_kmers(seqs: DataFrame, n: int = 10, p: Kmers = Kmers()) -> DataFrame:  # noqa: B008
    """The n most frequent k-mers of each genus; equal counts by k-mer."""
    from pyspark.sql.window import Window

    per_genus = counts(seqs, "genus", p)
    rank = F.row_number().over(Window.partitionBy("genus").orderBy(F.desc("n"), "kmer"))
    return per_genus.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)
