"""Dialog context across turns (WIN-4, DLG-1, DLG-2).

A user turn follows up on a clarification when the reply to the previous
user turn was one. A chain of follow-ups is an episode; the web form sends
the episode's first text, the latest question and the reply, the terminal
form nests every reply into the running query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare import contracts as C
from wayfare.functions import text as X
from wayfare.operators.ordering import global_index

CLARIFY_TOKEN = " the "


def user_turns(turns: DataFrame, is_clarification) -> DataFrame:
    """Each user turn with the reply to it (the next turn, if it is the
    assistant's) and whether that reply asked for clarification."""
    nxt = turns.select(F.col("conv_id").alias("n_conv"), (F.col("turn") - 1).alias("n_prev"),
                       F.col("role").alias("n_role"), F.col("text").alias("n_text"))
    u = turns.filter(F.col("role") == "user")
    j = u.join(nxt, (u.conv_id == nxt.n_conv) & (u.turn == nxt.n_prev), "left")
    reply = F.when(F.col("n_role") == "assistant", F.col("n_text"))
    return j.select("conv_id", "turn", "text", reply.alias("reply"),
                    F.coalesce(is_clarification(reply), F.lit(False)).alias("asks"))


def episodes(turns: DataFrame, is_clarification=None) -> DataFrame:
    """Number the episodes of each conversation: a user turn starts one unless
    the reply to the previous user turn was a clarification."""
    is_clarification = is_clarification or (lambda c: F.instr(c, CLARIFY_TOKEN) > 0)
    u = user_turns(turns, is_clarification)
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = (u.withColumn("prev_asks", F.coalesce(F.lag("asks").over(w), F.lit(False)))
         .withColumn("question", F.lag("reply").over(w)))
    u = u.withColumn("episode", F.sum(F.when(F.col("prev_asks"), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    return u


def followup_latest(turns: DataFrame, is_clarification=None, bucket: int = 1024) -> DataFrame:
    """DLG-1 (web): original + latest question + reply while a chain is open.

    No window per conversation: user turns get global positions (range
    sort); the previous user turn is an equi-join on position - 1; episode
    starts get their own positions k, and every turn finds its start with a
    range join [start, next start) done as an equi-join on position buckets
    (a range covering many buckets is repeated once per bucket, so the extra
    rows are bounded by starts + turns / bucket). A conversation holding a
    third of all turns is spread over as many tasks as its positions span.
    """
    is_clarification = is_clarification or (lambda c: F.instr(c, CLARIFY_TOKEN) > 0)
    u = global_index(user_turns(turns, is_clarification), ["conv_id", "turn"], "upos")
    prev = u.select(F.col("conv_id").alias("p_conv"), (F.col("upos") + 1).alias("p_next"),
                    F.col("asks").alias("p_asks"), F.col("reply").alias("p_reply"))
    x = (u.join(prev, (F.col("upos") == F.col("p_next")) & (F.col("conv_id") == F.col("p_conv")), "left")
         .select("conv_id", "turn", "text", "upos", F.coalesce("p_asks", F.lit(False)).alias("follow_up"),
                 F.col("p_reply").alias("question")))
    n = x.select(F.count(F.lit(1))).scalar()
    starts = global_index(x.filter(~F.col("follow_up")).select("conv_id", "upos", F.col("text").alias("original")),
                          ["upos"], "k")
    nxt = starts.select((F.col("k") - 1).alias("k"), F.col("upos").alias("hi"))
    first_k = starts.groupBy(F.col("conv_id").alias("f_conv")).agg(F.min("k").alias("k0"))
    ranges = (starts.join(nxt, "k", "left")
              .select("k", F.col("conv_id").alias("r_conv"), F.col("upos").alias("lo"),
                      F.coalesce(F.col("hi"), n).alias("hi"), "original")
              .join(first_k, F.col("r_conv") == F.col("f_conv"))
              .select("lo", "hi", "original", (F.col("k") - F.col("k0") + 1).alias("episode"))
              .withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bucket),
                                                    F.floor((F.col("hi") - 1) / bucket)))))
    rows = x.withColumn("b", F.floor(F.col("upos") / bucket))
    j = rows.join(ranges, ["b"]).filter((F.col("upos") >= F.col("lo")) & (F.col("upos") < F.col("hi")))
    sent = F.when(F.col("follow_up"), X.render(C.FOLLOWUP_WEB, original=F.col("original"),
                                               question=F.coalesce(F.col("question"), F.lit("")),
                                               reply=F.col("text"))).otherwise(F.col("text"))
    return j.select("conv_id", "turn", F.col("episode").cast("long").alias("episode"), "follow_up",
                    sent.alias("query_sent"))


def followup_nested(turns: DataFrame, is_clarification=None) -> DataFrame:
    """DLG-2 (terminal): each reply wraps the running query of its chain."""
    e = episodes(turns, is_clarification)
    we = Window.partitionBy("conv_id", "episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("__texts", F.collect_list("text").over(we))
    nested = F.aggregate(
        F.slice("__texts", 2, F.greatest(F.size("__texts") - 1, F.lit(1))),
        F.element_at("__texts", 1),
        lambda acc, x: X.render(C.FOLLOWUP_CLI, original=acc, reply=x))
    sent = F.when(F.size("__texts") > 1, nested).otherwise(F.col("text"))
    return e.select("conv_id", "turn", "episode", F.col("prev_asks").alias("follow_up"), sent.alias("query_sent"))
