"""Line dedup: lines found in many documents stay in one of them only. [native]

Explode the lines with their positions, hash each normalised line (128 bits),
count distinct documents per hash, and send back the positions to drop; each
text is then rebuilt from the positions that stay. Only hashes and positions
are shuffled for the counting, map-side combined, so a line that a third of
all documents hold costs one row per task. The text itself moves once.

Defined cases: a null or empty text is one empty line; rows with a null id are
kept whole and not counted; rows that repeat an id count as one document; equal
lines of one document are dropped or kept together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkwise.llm.common import SPACES, hash128

MIN_CHARS = 40
MIN_DOCS = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _UPPER.lower())


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drops(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(__id, __t, __drop): ids with the positions of their lines that go."""
    lines = (docs.filter(F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__t"),
                     F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
             .filter(F.length("line") >= min_chars)
             .select("__id", "__t", "pos", line_key(F.col("line")).alias("key"))
             .filter(F.length("key") >= min_chars))
    k1, k2 = hash128(F.col("key"))
    held = (lines.select("__id", "__t", "pos", k1.alias("k1"), k2.alias("k2"))
            .groupBy("k1", "k2", "__id", "__t").agg(F.collect_list("pos").alias("at")))
    common = (held.groupBy("k1", "k2", "__id").agg(F.count("*").alias("n"))
              .groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("__id").alias("last"))
              .filter(F.col("docs") >= min_docs))
    return (held.join(common, ["k1", "k2"]).filter(F.col("__id") != F.col("last"))
            .groupBy("__id", "__t").agg(F.flatten(F.collect_list("at")).alias("__drop")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the shared lines taken out of the text, and two counts (long).

    Existing columns of those two names are replaced.
    """
    gone = drops(docs, id_col, text_col, min_chars, min_docs)
    df = docs.drop(n_lines, n_dropped).withColumn("__t", F.xxhash64(F.col(text_col)))
    joined = df.join(gone, (df[id_col] == gone["__id"]) & (df["__t"] == gone["__t"]), "left").drop(gone["__t"])
    lines = lines_of(F.col(text_col))
    none = F.array().cast("array<int>")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *[(F.when(F.col("__drop").isNull(), F.col(c)).otherwise(kept) if c == text_col else F.col(c)).alias(c)
          for c in docs.columns if c not in (n_lines, n_dropped)],
        F.size(lines).cast("long").alias(n_lines),
        F.size(F.coalesce("__drop", none)).cast("long").alias(n_dropped))
