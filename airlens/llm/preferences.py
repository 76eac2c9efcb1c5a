"""Preference pairs: the turns that chosen and rejected share from the start are the prompt, the rest two completions.

Built-in functions only; one shuffle on the pair. A pair is one row of the result, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
#: code points of a turn's header besides its role
HEAD = len(OPEN) - 2
#: the role whose turns carry loss
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    head, tail = OPEN.split("{}")
    return F.concat(F.lit(head), F.coalesce(turn["role"], F.lit("")), F.lit(tail), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns (pair_id, side, turn, role, text; more columns are ignored) -> one row per pair.

    pair_id, prompt_turns (int), prompt (string), chosen and rejected: arrays of (text, loss, start, end), whose texts
    joined are the completion; loss is true on the turns of TRAINED. A turn lies from start to end in the completion, in
    code points and without its header: what is trained is the answer and the mark of its end. Turns of a side are in the order of turn, role, text, nulls
    first; turns are equal if role and text are, null equal to null and shown as empty. A pair with one side has an
    empty prompt and an empty other completion; equal sides are all prompt. Rows whose pair_id is null or whose side is
    neither chosen nor rejected belong to no pair; repeated rows are repeated turns.
    """
    t = turns.filter("pair_id is not null and side in ('chosen', 'rejected')")
    a_turn = F.struct("turn", "role", "text")
    sides = t.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(c("side") == s, a_turn))).alias(s) for s in ("chosen", "rejected")])
    # turn numbers may differ between the sides: only role and text are compared
    both = F.zip_with("chosen", "rejected", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    short = F.least(F.size("chosen"), F.size("rejected"))
    first = F.array_position(F.slice(both, F.lit(1), short), F.lit(False))
    sides = sides.withColumn("prompt_turns", F.when(first > 0, first - 1).otherwise(short).cast("int"))

    def rest(s: str) -> Column:
        left = F.slice(c(s), c("prompt_turns") + 1, F.greatest(F.size(s) - c("prompt_turns"), F.lit(0)))
        shown = F.transform(left, lambda x: F.struct(_rendered(x).alias("text"), F.coalesce(x["role"] == TRAINED, F.lit(False)).alias("loss"), (F.coalesce(F.char_length(x["role"]), F.lit(0)) + HEAD).alias("head")))

        def placed(x: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(shown, F.lit(1), i), F.lit(0), lambda n, y: n + F.char_length(y["text"]))
            return F.struct(x["text"].alias("text"), x["loss"].alias("loss"), (before + x["head"]).alias("start"), (before + F.char_length(x["text"])).alias("end"))

        return F.transform(shown, placed)

    prompt = F.array_join(F.transform(F.slice("chosen", F.lit(1), c("prompt_turns")), _rendered), "")
    return sides.select("pair_id", "prompt_turns", prompt.alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
