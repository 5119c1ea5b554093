"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of all tokens gets the weight p^a / sum(p^a). The exponent
a is bisected: either so that no source is repeated more than ``max_repeats``
times within the budget (the smallest such exponent, at most 1), or so that
the weights have a given entropy. A target that no exponent meets is an error. A source's budget in tokens is its weight times
the total budget. It is spent in epochs: whole passes over the source, then a
part of one more pass, in which the source's blocks of documents are taken in a
permuted order until the budget is met; the block at the edge is taken document
by document in its own permuted order.

Only DataFrame and SQL functions are used. Sources are summarised before any
shuffle, blocks are numbered by a hash, and windows run over blocks of a source
or over the documents of one block, never over a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise

STEPS = 40
NEW = ("n_tokens", "copies", "place")
FEW = 10_000  # rows that are sent to all tasks
FEW_BLOCKS = 200_000  # blocks, of some 100 bytes, that are sent to all tasks: those of about 48 sources


def token_count(text: Column) -> Column:
    """White-space separated words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weights(shares: DataFrame, exponent: float) -> DataFrame:
    raw = F.pow(F.col("share"), F.lit(exponent))
    total = shares.agg(F.sum(raw)).first()[0]
    return shares.withColumn("weight", raw / F.lit(total))


def fit_exponent(shares: DataFrame, budget: float, *, max_repeats: float | None = None, entropy: float | None = None, steps: int = STEPS) -> float:
    """Bisect the exponent over (source, tokens, share); each step is one small aggregation on the executors."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")

    def enough(exponent: float) -> bool:
        raw = F.pow(F.col("share"), F.lit(exponent))
        z, peak, h = shares.agg(F.sum(raw), F.max(raw / F.col("tokens")), F.sum(raw * F.ln(raw))).first()
        if max_repeats is not None:
            return peak / z * budget <= max_repeats * (1 + 1e-12)
        # entropy of raw / z
        return math.log(z) - h / z <= entropy * (1 + 1e-12)

    low, high, top = 0.0, 1.0, 1.0 if max_repeats is not None else 1024.0
    if enough(low):
        if entropy is not None and math.log(shares.count()) < entropy * (1 - 1e-9):
            raise ValueError(f"no weights of {shares.count()} sources have an entropy of {entropy}")
        return low
    while not enough(high):
        low, high = high, 2 * high
        if high > top:
            raise ValueError(f"a budget of {budget} takes sources more than {max_repeats} times" if max_repeats is not None else f"the entropy can't be as low as {entropy}")
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    max_repeats: float | None = 2.0,
    entropy: float | None = None,
    blocks: int = 4096,
    seed: int = 0,
) -> DataFrame:
    """The rows of ``df`` plus ``n_tokens``, ``copies``: how many times the mix takes the row (0: not at all), and ``place``: of its block in the permuted order of its source's blocks, from 1.

    ``budget`` is in tokens, by default as many as there are. Rows with null
    source form a source of their own; rows without tokens (null, empty or blank
    text) take no part and get 0 copies and no place, and so does every row of an
    empty mix. Rows that share an identifier are taken together. Other columns
    stay, whatever their names, but for those that have the new names.
    """
    names = [c for c in df.columns if c not in NEW]
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("string")))
    # a row is one struct, so that no column name clashes
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), source.alias("_source"), token_count(F.col(text_col)).alias("n_tokens"))
    rows = rows.withColumn("_key", key)
    finished = lambda out, copies, place: out.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "n_tokens", copies.cast("int").alias("copies"), place.cast("int").alias("place"))
    rows = rows.withColumn("_block", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % blocks).cast("int"))
    table = materialise(
        rows.where("n_tokens > 0").groupBy("_source", "_block").agg(F.sum("n_tokens").alias("tokens")), "blocks"
    )  # at most `blocks` rows a source
    total = table.agg(F.sum("tokens")).first()[0]
    if not total:
        return finished(rows, F.lit(0), F.lit(None))
    budget = int(total) if budget is None else int(budget)
    shares = materialise(table.groupBy("_source").agg(F.sum("tokens").alias("tokens")).withColumn("share", F.col("tokens") / F.lit(total)).coalesce(1), "shares")
    exponent = fit_exponent(shares, budget, max_repeats=max_repeats, entropy=entropy)
    plan = _weights(shares, exponent).withColumn("_goal", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
    plan = plan.select("_source", F.expr("_goal div tokens").cast("int").alias("_passes"), (F.col("_goal") % F.col("tokens")).alias("_rest"))
    # the last pass takes blocks in a permuted order until its budget is met
    turn = F.md5(F.concat_ws("|", F.lit(f"block {seed}"), "_source", F.col("_block").cast("string")))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("_source").orderBy(turn, "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_source").orderBy(turn, "_block"))
    spent = table.join(plan, "_source").withColumn("_room", F.col("_rest") - before).withColumn("_place", place)
    spent = spent.select("_source", "_block", "_passes", "_room", "_place", (F.col("tokens") > F.col("_room")).alias("_edge"))
    spent = materialise(spent, "plan")
    edge = spent.where("_edge and _room > 0").select("_source", "_block", "_room")
    # documents of the block at the edge, one block a source
    running = F.sum("n_tokens").over(Window.partitionBy("_source", "_block").orderBy("_key", "_id").rangeBetween(Window.unboundedPreceding, 0))
    inside = rows.where("n_tokens > 0").select("_source", "_block", "_key", "_id", "n_tokens")
    # one row a source at most, sent to all tasks where that is few
    inside = inside.join(F.broadcast(edge) if edge.count() <= FEW else edge, ["_source", "_block"])
    inside = inside.withColumn("_run", running).where("_run <= _room").select("_source", "_block", F.col("_key").alias("_key")).distinct()
    inside = materialise(inside, "edge")
    # at most one row for each block of a source; salted by nothing, as blocks of the hot source are many. Where they are few, no text is shuffled
    few = lambda small, most: F.broadcast(small) if small.count() <= most else small
    out = rows.join(few(spent.select("_source", "_block", "_passes", "_room", "_place", "_edge"), FEW_BLOCKS), ["_source", "_block"], "left")
    taken = inside.select("_source", "_block", "_key", F.lit(1).alias("_in"))
    out = out.join(few(taken, FEW_BLOCKS), ["_source", "_block", "_key"], "left")
    more = F.when(F.col("_edge"), F.coalesce("_in", F.lit(0))).otherwise(F.lit(1))
    copies = F.when(F.col("n_tokens") > 0, F.col("_passes") + more).otherwise(0)
    return finished(out, F.coalesce(copies, F.lit(0)), F.when(F.col("n_tokens") > 0, F.col("_place")))


def realise(mixed: DataFrame) -> DataFrame:
    """Each row as many times as the mix takes it, without the columns that the mix added."""
    rows = mixed.where("copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c not in NEW]).alias("_row"), "copies")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), e AS (SELECT *, CAST(CAST('0x' || substr(k, 1, 8) AS BIGINT) % 4096 AS INTEGER) AS block FROM d),
s AS (SELECT src, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) / (SELECT sum(n_tokens) FROM e) AS share FROM e WHERE n_tokens > 0 GROUP BY src),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t, list(share ORDER BY src) AS p, list(CAST(tokens AS DOUBLE) ORDER BY src) AS n FROM s),
fit AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.0::DOUBLE AS probe FROM total
  UNION ALL
  SELECT i + 1,
    CASE WHEN ok THEN low ELSE probe END,
    CASE WHEN ok THEN probe ELSE high END,
    CASE WHEN ok THEN (low + probe) / 2 ELSE (probe + high) / 2 END
  FROM (SELECT fit.*, list_max(list_transform(range(1, len(p) + 1), lambda j: pow(p[j], probe) / n[j])) / list_sum(list_transform(p, lambda x: pow(x, probe))) * t <= 2.0 AS ok
        FROM fit, total WHERE i < 41)
), a AS (SELECT high AS x FROM fit WHERE i = 41),
w AS (SELECT src, tokens, CAST(floor(pow(share, (SELECT x FROM a)) / (SELECT sum(pow(share, (SELECT x FROM a))) FROM s) * (SELECT t FROM total)) AS BIGINT) AS goal FROM s),
b AS (SELECT src, block, sum(n_tokens) AS tokens, md5('block 0|' || src || '|' || block) AS turn FROM e WHERE n_tokens > 0 GROUP BY src, block),
r AS (SELECT b.src, b.block, b.tokens, CAST(w.goal // w.tokens AS INTEGER) AS passes,
             w.goal % w.tokens - coalesce(sum(b.tokens) OVER (PARTITION BY b.src ORDER BY turn, b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
             CAST(row_number() OVER (PARTITION BY b.src ORDER BY turn, b.block) AS INTEGER) AS place
      FROM b JOIN w USING (src)),
f AS (SELECT e.doc_id, e.n_tokens, r.passes, r.room, r.place, r.tokens,
             sum(e.n_tokens) OVER (PARTITION BY e.src, e.block ORDER BY e.k, e.doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM e JOIN r ON e.src = r.src AND e.block = r.block WHERE e.n_tokens > 0)
SELECT doc_id, n_tokens, CAST(passes + CASE WHEN tokens <= room THEN 1 WHEN run <= room THEN 1 ELSE 0 END AS INTEGER) AS copies, place FROM f
UNION ALL SELECT doc_id, n_tokens, 0, NULL FROM e WHERE n_tokens = 0
"""
