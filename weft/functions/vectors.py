"""Hashed embeddings of symbols and relations, and weights of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.scratch import written


def cells(symbol: str, columns: int, hashes: int, seed: int = 0):
    """The distinct cells that a symbol sets: ``hashes`` hashed columns."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(symbol)), F.lit(columns)).cast("int" if columns <= 1 << 31 else "long") for k in range(hashes)]))


def embed(message: DataFrame, columns: int = 64, hashes: int = 3, seed: int = 0) -> DataFrame:
    """(qid, cell, w): a message as sums of its symbols' cells."""
    by = [c for c in ("qid",) if c in message.columns]
    return message.select(*by, F.explode(cells("id", columns, hashes, seed)).alias("cell"), "w").groupBy(*by, "cell").agg(F.sum("w").alias("w"))


def embed_relation(relation: DataFrame, columns: int = 64, hashes: int = 3, seed: int = 0) -> DataFrame:
    """(src_cell, dst_cell, w): a relation between cells."""
    src = F.explode(cells("src", columns, hashes, seed)).alias("src_cell")
    halfway = relation.select(src, "dst", "w")
    return halfway.select("src_cell", F.explode(cells("dst", columns, hashes, seed)).alias("dst_cell"), "w").groupBy("src_cell", "dst_cell").agg(F.sum("w").alias("w"))


def step_cells(embedded: DataFrame, relation: DataFrame, columns: int = 64, hashes: int = 3, seed: int = 0) -> DataFrame:
    """(qid, cell, w): a step taken in cells, of :func:`embed` along
    :func:`embed_relation` of ``relation``.

    A symbol's weight is in each of its cells, so a fact is met once for every
    cell of its near end: each fact is shared among them, by their number.
    What other symbols have in a shared cell adds to it, so with weights that
    aren't negative each cell is an upper bound of the step's own.
    """
    by = [c for c in ("qid",) if c in embedded.columns]
    n = F.size(cells("src", columns, hashes, seed))
    facts = embed_relation(relation.select("src", "dst", (F.col("w") / n).alias("w")), columns, hashes, seed)
    both = embedded.join(facts.select(F.col("src_cell").alias("cell"), "dst_cell", F.col("w").alias("rw")), "cell")
    return both.groupBy(*by, F.col("dst_cell").alias("cell")).agg(F.sum(F.col("w") * F.col("rw")).alias("w"))


def unembed(embedded: DataFrame, symbols: DataFrame, columns: int = 64, hashes: int = 3, seed: int = 0) -> DataFrame:
    """(qid, id, w): for each symbol the least of its cells, an upper bound of
    its weight; symbols with an empty cell are certainly absent."""
    by = [c for c in ("qid",) if c in embedded.columns]
    want = symbols.select("id", cells("id", columns, hashes, seed).alias("cells")).select("id", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    got = want.join(embedded, "cell").groupBy(*by, "id", "n").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("k"))
    return got.filter("k = n").select(*by, "id", "w")


def contains(embedded: DataFrame, symbols: DataFrame, threshold: float = 1.0, **options) -> DataFrame:
    """(qid, id): symbols all of whose cells reach the threshold."""
    return unembed(embedded, symbols, **options).filter(F.col("w") >= threshold).drop("w")


def tfidf(relation: DataFrame) -> DataFrame:
    """(src, dst, w): ln(tf+1) ln(N/df), each source's row of length one; N counts sources."""
    relation = written(relation, "tf")  # used three times
    df = relation.groupBy("dst").agg(F.count(F.lit(1)).alias("df"))
    n = relation.agg(F.countDistinct("src").alias("n"))
    raw = relation.join(df, "dst").crossJoin(F.broadcast(n)).select("src", "dst", (F.log1p("w") * F.log(F.col("n") / F.col("df"))).alias("w"))
    raw = raw.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("src"))))
    return raw.select("src", "dst", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("w"))
