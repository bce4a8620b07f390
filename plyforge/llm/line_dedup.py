"""Line deduplication over windows of three consecutive lines.

Every run of three consecutive lines of a text is hashed. A window that occurs anywhere
before, in the order (doc_id, position), is a later occurrence; the positions that later
occurrences cover are merged, and those lines are removed. Of every line at least the
earliest occurrence stays: each removed line lies in a later occurrence of a window, whose
first occurrence has the same line strictly earlier.

Repeats are found from hashes and positions alone: the windows aggregate to their first
occurrence before the shuffle, and only windows that repeat are joined back. The texts are
shuffled once, as lines, to meet their covered positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import staged, table

WINDOW_LINES = 3
_SEED = 0x51ED27


def _lines(text):
    return F.split(text, "\n", -1)


def _key(text) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text)


def covered_positions(documents: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """doc_id, key (_key) and covered, the sorted positions of the lines that later occurrences cover.

    Only documents that lose lines have a row. Windows are equal when both of two 64-bit
    hashes of their lines are. The first occurrence is that of the smallest (doc_id, key,
    position), rows without doc_id first.
    """
    hashes = documents.where(F.col("text").isNotNull()).select(
        "doc_id",
        _key(F.col("text")).alias("key"),
        F.transform(_lines(F.col("text")), lambda line: F.xxhash64(line)).alias("a"),
        F.transform(_lines(F.col("text")), lambda line: F.xxhash64(F.lit(_SEED), line)).alias("b"),
    )
    at = F.sequence(F.lit(0), F.size("a") - window)
    windows = (
        hashes.where(F.size("a") >= window)
        .select(
            "doc_id",
            "key",
            F.posexplode(
                F.transform(
                    at,
                    lambda i: F.struct(
                        F.xxhash64(*[F.get("a", i + k) for k in range(window)]).alias("a"),
                        F.xxhash64(*[F.get("b", i + k) for k in range(window)]).alias("b"),
                    ),
                )
            ).alias("pos", "h"),
        )
        .select("doc_id", "key", "pos", "h.a", "h.b")
    )
    windows = staged(windows, "windows")
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    later = windows.join(repeated, ["a", "b"]).where(~F.struct("doc_id", "key", "pos").eqNullSafe(F.col("first")))
    return (
        later.select("doc_id", "key", F.explode(F.sequence("pos", F.col("pos") + window - 1)).alias("line"))
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set("line")).alias("covered"))
    )


def remove_repeated_lines(documents: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """The documents, all their columns, with text rewritten, plus n_lines and n_removed.

    A null text stays null with 0 lines; an empty text is one empty line. A text all of whose
    lines are covered becomes empty. Texts of fewer lines than a window stay as they are.
    Of equal windows the one with the smallest (doc_id, position) stays; rows that share a
    doc_id are told apart by a hash of their texts, and rows equal in both are one document:
    they lose the same lines. Columns of the input named covered, n_lines or n_removed are replaced.
    """
    own = [c for c in documents.columns if c not in ("covered", "n_lines", "n_removed")]
    covered = covered_positions(documents.select("doc_id", "text"), window)
    covered = covered.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "covered")
    # The lines travel instead of the text: computed below the join, they are split once a row.
    rows = documents.select(*[c for c in own if c != "text"], _lines(F.col("text")).alias("_lines"), _key(F.col("text")).alias("_own"))
    joined = rows.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_key")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "covered")
    text = F.when(F.col("covered").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    )
    return joined.select(
        *[text.alias("text") if c == "text" else c for c in own],
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
    )


NAME = "op4_line_dedup"
ORACLE_SQL = """
WITH lines AS (
    SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w
    FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS pos FROM lines WHERE len(l) >= 3)
), ranked AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM windows
), covered AS (
    SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE nth > 1
), numbered AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM lines
), kept AS (
    SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.pos) AS text
    FROM numbered n ANTI JOIN covered c ON n.doc_id = c.doc_id AND n.pos = c.pos
    GROUP BY n.doc_id
), lost AS (
    SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(lost.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
