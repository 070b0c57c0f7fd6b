"""Ranking of linked lists and rings by pointer doubling: after k rounds of joins each row knows 2 ** k steps of its way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Rounds


def ring_ranks(links: DataFrame, keys: list[str], name: str = "ring-ranks") -> DataFrame:
    """Rows (keys, id, next) that form closed rings, with ring (the least id on it), seq (steps from that id on, from 0)
    and size. There are as many rounds as the longest ring has doublings, and one more."""
    start = F.struct(F.col("id").alias("at"), F.lit(0).cast("long").alias("steps"))
    state, step, moved = Rounds(links.select(*keys, "id", F.col("next").alias("jump"), start.alias("least")), name), 1, True
    while moved:
        t = state.df
        ahead = t.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        far = F.struct(F.col("_least.at").alias("at"), (F.col("_least.steps") + step).alias("steps"))
        both = t.join(ahead, [*keys, "jump"]).select(
            *keys, "id", F.col("_jump").alias("jump"), F.least("least", far).alias("least"), (F.col("_least.at") < F.col("least.at")).alias("moved")
        )
        # a least id that stays the same for all over twice the steps is that of the ring
        moved = not state.next(both).where("moved").isEmpty()
        step *= 2
    ranked = state.df.select(*keys, "id", F.col("least.at").alias("ring"), F.col("least.steps").alias("_steps"))
    size = ranked.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("size"))
    return ranked.join(size, [*keys, "ring"]).select(*keys, "id", "ring", F.pmod(F.col("size") - F.col("_steps"), F.col("size")).alias("seq"), "size")


def list_ranks(links: DataFrame, keys: list[str], name: str = "list-ranks") -> DataFrame:
    """Rows (keys, id, prev) that form lists or trees, prev null at a head, with head (the first id that prev leads to) and seq
    (steps from it, from 0). Rows on closed rings have no head and are left out."""
    first = links.select(*keys, "id", F.coalesce("prev", "id").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("seq"), F.col("prev").isNull().alias("done"))
    state = Rounds(first, name)
    known, most = 1, state.df.count()
    while known <= most and not state.df.where("not done").isEmpty():  # what is open after that many steps goes round
        t = state.df
        for _ in range(2):  # each row's jump goes four times as far in a round
            back = t.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("seq").alias("_seq"), F.col("done").alias("_done"))
            t = t.join(back, [*keys, "jump"]).select(*keys, "id", F.col("_jump").alias("jump"), (F.col("seq") + F.col("_seq")).alias("seq"), (F.col("done") | F.col("_done")).alias("done"))
        state.next(t)
        known *= 4
    return state.df.where("done").select(*keys, "id", F.col("jump").alias("head"), "seq")
