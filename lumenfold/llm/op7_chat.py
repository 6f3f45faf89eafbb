"""Preference formatting of conversations, with DataFrame functions only.

For a pair of a chosen and a rejected conversation the longest common prefix of turns (equal
role and text, nulls equal) is rendered once as the prompt; what follows it in each becomes a
completion: its turns' pieces in order and, for each, whether the loss counts it.  Only the
text and the end mark of assistant turns count; role headers and other roles' turns are masked.

If one conversation is a prefix of the other, or both are equal, the last shared turn on is
left out of the prompt as long as that leaves an assistant turn to either completion; equal
conversations therefore end in equal completions.  A null role renders as an empty role, a
null text as an empty text.  Turns are ordered by turn, then role, then text, nulls first;
equal rows are one turn.  Turns without a conversation id are not part of a pair.  A
conversation with no turns has no pair; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSISTANT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, said): an ordered array of struct(turn, role, text) for each conversation."""
    turns = common.named(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    return (
        turns.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text")), _order).alias("said"))
    )


def _order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = (
            F.when(x.eqNullSafe(y), out)
            .when(x.isNull(), -1)
            .when(y.isNull(), 1)
            .when(x < y, -1)
            .otherwise(1)
        )
    return out


def _spoken(turn: Column) -> Column:
    return F.struct(F.coalesce(turn["role"], F.lit("")).alias("role"), F.coalesce(turn["text"], F.lit("")).alias("text"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns two arrays of struct(role, text) share from the start."""
    met = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(met, F.lit(False)), F.lit(0)).cast("int") - 1, F.size(met)).cast("int")


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _footer(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _footer(t))), "")


def completion(turns: Column) -> Column:
    """Pieces of the turns as array of struct(text, counts)."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(_header(t).alias("text"), F.lit(False).alias("counts")),
                F.struct(_footer(t).alias("text"), (t["role"] == ASSISTANT).alias("counts")),
            ),
        )
    )


def preferences(pairs: DataFrame) -> DataFrame:
    """For pairs(pair_id, chosen, rejected), the latter arrays of struct(role, text): pair_id,
    shared (turns of the prompt), prompt, chosen and rejected (arrays of struct(text, counts))."""
    sides = pairs.withColumn("same", common_turns(F.col("chosen"), F.col("rejected")))
    short = F.least(F.size("chosen"), F.size("rejected"))
    # a prefix leaves a side empty: give back the turns from the last shared assistant turn on
    last = F.array_max(
        F.transform(
            F.slice("chosen", 1, F.col("same")),
            lambda t, i: F.when(t["role"] == ASSISTANT, i),
        )
    )
    sides = sides.withColumn("shared", F.when((F.col("same") == short) & (F.col("same") > 0), F.coalesce(last, F.col("same"))).otherwise(F.col("same")))
    rest = lambda side: F.slice(side, F.col("shared") + 1, F.size(side))
    return sides.select(
        "pair_id",
        "shared",
        rendered(F.slice("chosen", 1, F.col("shared"))).alias("prompt"),
        completion(rest("chosen")).alias("chosen"),
        completion(rest("rejected")).alias("rejected"),
    )


def answer_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of turns(conv_id, turn, role, text): each conversation, and
    the same one with its last assistant turn answered as its partner (conv_id with the lowest
    bit flipped) ends; an empty answer if it has no partner with an assistant turn.  A
    conversation without an assistant turn makes no pair."""
    talks = conversations(turns).select("conv_id", F.transform("said", _spoken).alias("said"))
    talks = talks.withColumn("at", F.array_max(F.transform("said", lambda t, i: F.when(t["role"] == ASSISTANT, i + 1)))).where("at is not null")
    answers = talks.select(
        F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.element_at("said", F.col("at"))["text"].alias("answer")
    )
    paired = talks.join(answers, "conv_id", "left")
    other = F.struct(F.lit(ASSISTANT).alias("role"), F.coalesce("answer", F.lit("")).alias("text"))
    head = F.slice("said", 1, F.col("at") - 1)
    tail = F.slice("said", F.col("at") + 1, F.size("said"))
    return paired.select(F.col("conv_id").alias("pair_id"), F.col("said").alias("chosen"), F.concat(head, F.array(other), tail).alias("rejected"))


def _text(side: str) -> Column:
    return F.array_join(F.transform(side, lambda p: p["text"]), "")


def _mask(side: str) -> Column:
    """start:end of the counted pieces, in code points of the completion, comma-joined."""
    ends = F.aggregate(
        F.col(side),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["counts"],
                F.concat(s["spans"], F.when(s["spans"] == "", "").otherwise(","), s["at"].cast("string"), F.lit(":"), (s["at"] + F.length(p["text"])).cast("string")),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    return ends["spans"]


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preferences(answer_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return made.select(
        F.col("pair_id").alias("conv_id"),
        F.col("shared").cast("long").alias("prompt_turns"),
        "prompt",
        _text("chosen").alias("chosen"),
        _mask("chosen").alias("chosen_mask"),
        _text("rejected").alias("rejected"),
        _mask("rejected").alias("rejected_mask"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
t AS (SELECT *, list_max(list_filter(range(1, len(said) + 1), lambda i: said[i].role = 'assistant')) AS at FROM c),
p AS (SELECT t.conv_id, t.said AS ch, t.said[1:t.at-1] || [{'role': 'assistant', 'text': coalesce(o.said[o.at].text, '')}] || t.said[t.at+1:] AS re
  FROM t LEFT JOIN t o ON o.conv_id = xor(t.conv_id, 1) AND o.at IS NOT NULL WHERE t.at IS NOT NULL),
s AS (SELECT *, coalesce(list_min(list_filter(range(1, len(ch) + 1), lambda i: ch[i] IS DISTINCT FROM re[i])) - 1, len(ch)) AS same FROM p),
k AS (SELECT *, CASE WHEN same = len(ch) THEN coalesce(list_max(list_filter(range(1, len(ch) + 1), lambda i: ch[i].role = 'assistant')) - 1, same) ELSE same END AS shared FROM s),
r AS (SELECT conv_id, shared, array_to_string(list_transform(ch[1:shared], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') AS prompt,
  ch[shared+1:] AS ch, re[shared+1:] AS re FROM k),
piece AS (SELECT conv_id, side, i, '<|' || x.role || '|>' || chr(10) AS head, x.text || '<|end|>' || chr(10) AS body, x.role = 'assistant' AS counts
  FROM (SELECT conv_id, 'c' AS side, unnest(ch) AS x, unnest(range(1, len(ch) + 1)) AS i FROM r
        UNION ALL SELECT conv_id, 're', unnest(re), unnest(range(1, len(re) + 1)) FROM r)),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side ORDER BY i) AS stop FROM piece),
done AS (SELECT conv_id, side, string_agg(head || body, '' ORDER BY i) AS text,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE counts), '') AS mask
  FROM placed GROUP BY conv_id, side)
SELECT r.conv_id, CAST(shared AS BIGINT) AS prompt_turns, prompt, coalesce(a.text, '') AS chosen, coalesce(a.mask, '') AS chosen_mask,
  coalesce(b.text, '') AS rejected, coalesce(b.mask, '') AS rejected_mask
FROM r LEFT JOIN done a ON a.conv_id = r.conv_id AND a.side = 'c' LEFT JOIN done b ON b.conv_id = r.conv_id AND b.side = 're'
"""
