"""Cumulative-snapshot collapse of logged conversations, then rendering with a chat template.

Services often log a conversation again after every turn, so that short logs are the beginning of longer ones. The first
k turns of every conversation get a rolling hash: a running sum of turn hashes that depend on the turn's
position, so equal beginnings have equal sums wherever they are logged. A conversation goes if its whole hash is that of a
proper beginning of another; of equal ones the smallest id stays. What is left, the maximal conversations, is rendered.

Only DataFrame functions are used; turns with their running sums are written once and read by each step. Beginnings are made distinct before they meet anything, so a first turn that every
log shares is one row, and the anti-join compares each conversation with one row at most. Running sums are taken
within runs of turn numbers and carried over from run to run, so a conversation with a large share of all rows is
spread over many tasks, and no conversation is gathered: rendered turns stay rows, in order of ``position``. Two
61-bit sums and the count identify a beginning; unequal ones agree with probability near 2**-120.

Defined results: turns are ordered by ``turn`` (null first), then role and text; rows that repeat are turns of their own, and
ties are in order of role and text. A null role or text is rendered as empty and differs from the empty one in
comparison. A null conversation id is one conversation of its own. An empty table gives an empty table. Further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm.shared import written

#: Turn numbers of a run; running sums are taken within runs and carried over between them.
RUN = 256
#: Sums of up to 2**32 values below this stay in range.
_MODULUS = 1 << 30


def _turn_hash(seed: int) -> Column:
    """A value below 2**30 from position, role and text of a turn; null differs from empty."""
    parts = [F.lit(seed), F.col("position"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.pmod(F.xxhash64(*parts), F.lit(_MODULUS))


def positions(turns: DataFrame) -> DataFrame:
    """Add ``position`` (1, 2, ... in each conversation) and four running sums of turn hashes, ``p1`` to ``p4``."""
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("run", F.expr(f"CAST(floor(turn / {RUN}) AS BIGINT)"))
    key = ["conv_id", "run"]
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    inner = Window.partitionBy(*key).orderBy(*order)
    runs = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = runs.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = _with(rows.withColumn("inner", F.row_number().over(inner)), first, key).withColumn("position", F.col("inner") + F.col("skip"))
    sums = placed.select(*key, "position", "role", "text", *(_turn_hash(k).alias(f"h{k}") for k in range(1, 5)))
    upto = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    totals = sums.groupBy(*key).agg(*(F.sum(f"h{k}").alias(f"t{k}") for k in range(1, 5)))
    carried = totals.select(*key, *(F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)).alias(f"c{k}") for k in range(1, 5)))
    return _with(sums, carried, key).select(
        "conv_id", "position", "role", "text", *((F.sum(f"h{k}").over(upto) + F.col(f"c{k}")).alias(f"p{k}") for k in range(1, 5))
    )


def _with(rows: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    other = extra.select(*(F.col(k).alias(f"_{k}") for k in key), *(c for c in extra.columns if c not in key))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return rows.join(other, same, "left").drop(*(f"_{k}" for k in key))


def maximal(placed: DataFrame) -> DataFrame:
    """Per conversation that stays: ``conv_id``, ``n_turns`` and ``n_logs``, how many equal ones were logged."""
    sums = [f"p{k}" for k in range(1, 5)]
    last = placed.groupBy("conv_id").agg(F.max(F.struct("position", *sums)).alias("z")).select("conv_id", "z.*")
    whole = last.groupBy("position", *sums).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logs")
    )
    proper = _with(placed, last.select("conv_id", F.col("position").alias("n_turns")), ["conv_id"]).where("position < n_turns")
    beginnings = proper.select("position", *sums).distinct()
    kept = whole.join(beginnings, ["position", *sums], "left_anti")
    return kept.select("conv_id", F.col("position").alias("n_turns"), "n_logs")


def render(turns: DataFrame) -> Column:
    """One turn in the chat template; the last one ends the text."""
    body = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    return F.when(F.col("position") == F.col("n_turns"), F.concat(body, F.lit("<|eot|>"))).otherwise(body)


def collapse(turns: DataFrame) -> DataFrame:
    """Rendered turns of all maximal conversations: ``conv_id, position, n_turns, n_logs, rendered``."""
    placed = written(positions(turns), "turns")
    kept = _inner(placed.select("conv_id", "position", "role", "text"), maximal(placed))
    return kept.select("conv_id", "position", "n_turns", "n_logs", render(kept).alias("rendered"))


def _inner(rows: DataFrame, kept: DataFrame) -> DataFrame:
    other = kept.withColumnRenamed("conv_id", "_conv_id")
    return rows.join(other, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "inner").drop("_conv_id")


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, collapsed and rendered."""
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
    role, text FROM conversations),
n AS (SELECT conv_id, count(*) AS n_turns FROM t GROUP BY conv_id),
p AS (SELECT conv_id, position, string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), ',')
    OVER (PARTITION BY conv_id ORDER BY position) AS h FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logs, h FROM p JOIN n USING (conv_id) WHERE position = n_turns GROUP BY h, n_turns),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p JOIN n USING (conv_id) WHERE p.h = w.h AND p.position < n.n_turns))
SELECT conv_id, position, n_turns, n_logs, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)
    || CASE WHEN position = n_turns THEN '<|eot|>' ELSE '' END AS rendered
FROM t JOIN kept USING (conv_id)
"""
