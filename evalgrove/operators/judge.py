"""Judging answers: distinct prompts, a completion source, parsing, votes and hits.

A completion source is any function from a table of distinct prompts to (prompt, completion, reply): a
replayed table, or complete_with() around a model client.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrove.functions import prompts as P
from evalgrove.functions.text import strip

Source = Callable[[DataFrame], DataFrame]
#: Rows of a table that goes out by broadcast.
BROADCAST_ROWS = 200_000


def complete_with(client: Callable[[list[str], int], list[list[str]]], n: int = 1, batch: int = 1024) -> Source:
    """A source that calls client(prompts, n) -> n replies a prompt on the executors, batch prompts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                asked = frame["prompt"].iloc[at : at + batch].tolist()
                rows = [(p, i, r) for p, replies in zip(asked, client(asked, n)) for i, r in enumerate(replies)]
                yield pd.DataFrame(rows, columns=["prompt", "completion", "reply"])

    return lambda prompts: prompts.mapInPandas(run, "prompt string, completion int, reply string")


def replay(table: DataFrame) -> Source:
    return lambda prompts: table.join(prompts, "prompt", "left_semi")


def keeping(source: Source) -> Source:
    """Marks a source that gives the other columns of the prompts' rows back with their replies, which saves joining them."""
    source.keeps_columns = True
    return source


def in_round(source: Source, number: int) -> Source:
    """The source as it is asked in one of several rounds: one that keeps replies keeps each round's apart."""
    return source.in_round(number) if hasattr(source, "in_round") else source


def _digest(prompt: Column) -> Column:
    """128 bits of a prompt's SHA-256."""
    return F.unhex(F.substring(F.sha2(prompt, 256), 1, 32))


def fan_out(rows: DataFrame, source: Source, prompt: Column | None = None) -> DataFrame:
    """rows joined to the replies of their prompts; each distinct prompt is asked once.

    rows hold prompt, or what the column prompt makes it from: then no prompt goes through an exchange, only its parts.
    Replies come back by digests of prompts.
    """
    made = F.col("prompt") if prompt is None else prompt
    # no digest is empty: rows without a prompt find no reply, and the join need not make prompts once more to look for nulls
    keyed = rows.withColumn("_h", F.coalesce(_digest(made), F.lit(b"")))
    if prompt is None:
        asked = rows.select("prompt").distinct()
    else:
        again = F.lag("_h").over(Window.partitionBy("_h").orderBy("_h"))
        asked = keyed.withColumn("_before", again).where("_before is null").select(made.alias("prompt"))
    replies = source(asked).withColumn("_r", _digest(F.col("prompt"))).drop("prompt")
    return keyed.join(replies, F.col("_h") == F.col("_r")).drop("_h", "_r")


def ask(rows: DataFrame, source: Source) -> DataFrame:
    """rows, whose prompts are distinct already, with their replies instead of prompts."""
    if getattr(source, "keeps_columns", False):
        return source(rows).drop("prompt", "completion")
    replies = source(rows.select("prompt")).select(_digest(F.col("prompt")).alias("_r"), "reply")
    keyed = rows.withColumn("_h", F.coalesce(_digest(F.col("prompt")), F.lit(b""))).drop("prompt")
    return keyed.join(replies, F.col("_h") == F.col("_r")).drop("_h", "_r")


def votes(replies: DataFrame, *key: str, structured: bool = False) -> DataFrame:
    """Per answer: verdict and reply of the first completion, majority over all, yes and no votes, parse_ok.

    Unparseable replies cast no vote, but the last completion always does, as no. A tie is no.
    """
    parsed = P.parse_structured(F.col("reply")) if structured else P.parse_free_form(F.col("reply"))
    rows = replies.withColumn("_p", parsed)
    last = F.max("completion")
    out = rows.groupBy(*key).agg(
        F.min_by(F.col("_p.verdict"), "completion").alias("verdict"), F.count_if("_p.verdict").alias("votes_yes"),
        F.count_if(F.col("_p.parse_ok") & ~F.col("_p.verdict")).alias("_no"), F.bool_or("_p.parse_ok").alias("parse_ok"),
        F.max_by(F.col("_p.parse_ok"), "completion").alias("_last_ok"), last.alias("_last"),
    )
    no = F.col("_no") + F.when(F.col("_last_ok"), 0).otherwise(1)
    return out.withColumn("votes_no", no).withColumn("verdict_majority", F.col("votes_yes") > F.col("votes_no")).drop("_no", "_last_ok", "_last")


def hits(rollouts: DataFrame, key: str = "example_id", verdict: str = "verdict") -> DataFrame:
    """(key, judge_hit, judge_hit_count, judge_selected, judge_selected_text): -1 and the first text without a hit."""
    yes = F.coalesce(F.col(verdict), F.lit(False))
    out = rollouts.groupBy(key).agg(
        F.count_if(yes).alias("judge_hit_count"), F.min(F.when(yes, F.col("idx"))).alias("_at"),
        F.min_by(F.when(yes, F.col("text")), F.when(yes, F.col("idx"))).alias("_text"), F.min_by("text", "idx").alias("_first"),
    )
    return out.select(
        key, (F.col("judge_hit_count") > 0).alias("judge_hit"), "judge_hit_count",
        F.coalesce("_at", F.lit(-1)).alias("judge_selected"), F.coalesce("_text", "_first", F.lit("")).alias("judge_selected_text"),
    )


def packed_population(rollouts: DataFrame, size: int, selection: str = "first", seed: str = "1234", key: str = "example_id") -> DataFrame:
    """(key, members) with members an array of structs (slot, text): what population() gives as rows."""
    order = F.struct(F.lit(0).alias("o"), "idx") if selection == "first" else F.struct(F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"), F.col("idx").cast("string"))).alias("o"), "idx")
    full = strip(F.col("text")) != ""
    packed = rollouts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(full, F.struct(order.alias("o"), "text")))).alias("c"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(i.alias("slot"), F.when(F.size("c") > 0, F.get("c", i % F.greatest(F.size("c"), F.lit(1)))["text"]).otherwise("").alias("text")))
    return packed.select(key, slots.alias("members"))


def population(rollouts: DataFrame, size: int, selection: str = "first", seed: str = "1234", key: str = "example_id") -> DataFrame:
    """(key, slot, text): a population of size answers of each example, non-blank ones repeated in turn to fill it.

    'first' takes them in order, 'random' in order of md5(seed/key/idx). Without any, all slots are ''.
    """
    return packed_population(rollouts, size, selection, seed, key).select(key, F.inline("members"))


def packed(members: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, members) of rows (key, slot, text)."""
    return members.groupBy(key).agg(F.collect_list(F.struct("slot", "text")).alias("members"))


def _drawn(k: int, number: int, seed: str, key: str) -> Column:
    """An array of structs (subset, candidates) drawn from the column members, by md5 order."""
    mark = lambda d, m: F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"), d.cast("string"), m["slot"].cast("string")))
    ordered = lambda d: F.array_sort(F.transform("members", lambda m: F.struct(mark(d, m).alias("h"), m["slot"].alias("slot"), m["text"].alias("text"))))
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda d: F.struct(d.alias("subset"), F.transform(F.slice(ordered(d), 1, k), lambda m: m["text"]).alias("candidates")))


def draws(population: DataFrame, k: int, number: int, seed: str = "1234", key: str = "example_id") -> DataFrame:
    """A packed population's rows as number rows (.., subset, candidates): k members each without replacement, by md5 order.

    They are drawn within the row, so neither members nor draws are shuffled.
    """
    return population.select("*", F.inline(_drawn(k, number, seed, key))).drop("members")


def subsets(members: DataFrame, k: int, number: int, seed: str = "1234", key: str = "example_id") -> DataFrame:
    """(key, subset, candidates): number draws of k members each without replacement, by md5 order."""
    return draws(packed(members, key), k, number, seed, key)


def _asks(questions: DataFrame, variant: str) -> tuple[DataFrame, list[bool]]:
    """(example_id, questions, shared) with questions an array of structs, and the values that shared may have.

    Of examples that are not shared no prompt equals one of another row of questions.
    """
    from evalgrove.sources.staging import staged

    keyed = questions.select("example_id", "question", F.xxhash64(P.asked_root(F.col("question"), variant)).alias("_q"))
    common = staged(keyed.groupBy("_q").agg(F.count("*").alias("n")).where("n > 1"), "common")
    number, rows = common.agg(F.count("*"), F.sum("n")).first()
    kinds = [False] if not number else [True] if rows == questions.count() else [False, True]
    if len(kinds) > 1:
        known = common.select("_q", F.lit(True).alias("_c"))
        keyed = keyed.join(F.broadcast(known) if number <= BROADCAST_ROWS else known, "_q", "left")
    else:
        keyed = keyed.withColumn("_c", F.lit(kinds[0]))
    one = keyed.groupBy("example_id").agg(F.collect_list(F.struct("question")).alias("questions"), F.bool_or(F.coalesce("_c", F.lit(False))).alias("shared"))
    return one, kinds


def aggregate_rounds(rollouts: DataFrame, questions: DataFrame, source: Source, population_size: int = 16, k: int = 4, steps: int = 2, selection: str = "first", seed: str = "1234", variant: str = "barebones") -> DataFrame:
    """(example_id, slot, text) after steps - 1 rounds in which each slot is answered anew from k members.

    questions: (example_id, question). Each round is written to the shared folder, so the number of rounds
    doesn't lengthen the plan. Each distinct prompt is asked once in a round. Equal prompts have equal questions: where an example's
    question is its own they are all in its row, and nothing goes through an exchange to find them. Examples whose questions others
    have too go by digests of prompts, with questions and candidates.
    """
    from evalgrove.sources.staging import staged

    held = packed_population(rollouts, population_size, selection, seed)
    if steps < 2:
        return held.select("example_id", F.inline("members"))
    prompt = lambda candidates: P.aggregation_prompt(F.col("question"), candidates, variant)
    asks, kinds = _asks(questions, variant)
    held = held.join(asks, "example_id")

    def alone(rows: DataFrame, asked_in: Source, mark: str) -> DataFrame:
        drawn = F.transform(_drawn(k, population_size, mark, "example_id"), lambda d: F.struct(d["subset"].alias("subset"), prompt(d["candidates"]).alias("prompt")))
        made = rows.select("example_id", "questions", "shared", drawn.alias("_made"))
        slots = lambda p: F.transform(F.filter("_made", lambda m: m["prompt"] == p), lambda m: m["subset"])
        each = F.transform(F.array_distinct(F.col("_made")["prompt"]), lambda p: F.struct(p.alias("prompt"), slots(p).alias("slots")))
        return ask(made.select("example_id", "questions", "shared", F.inline(each)), asked_in)

    def together(rows: DataFrame, asked_in: Source, mark: str) -> DataFrame:
        return fan_out(draws(rows, k, population_size, mark), asked_in, prompt(F.col("candidates"))).select("example_id", "questions", "shared", F.array("subset").alias("slots"), "reply")

    for step in range(1, steps):
        rows = held.select("example_id", "questions", "shared", "members", F.inline("questions"))
        got = [(together if kind else alone)(rows.where(F.col("shared") == kind) if len(kinds) > 1 else rows, in_round(source, step), f"{seed}/{step}") for kind in kinds]
        replies = got[0] if len(got) == 1 else got[0].unionByName(got[1])
        if step == steps - 1:
            return staged(replies.select("example_id", F.explode("slots").alias("slot"), F.col("reply").alias("text")), "round", "zstd")
        packed_replies = replies.groupBy("example_id").agg(F.first("questions").alias("questions"), F.first("shared").alias("shared"), F.collect_list(F.struct("slots", "reply")).alias("replies"))
        members = F.flatten(F.transform("replies", lambda r: F.transform(r["slots"], lambda s: F.struct(s.alias("slot"), r["reply"].alias("text")))))
        held = staged(packed_replies, "round", "zstd").select("example_id", "questions", "shared", members.alias("members"))


def iterate(examples: DataFrame, source: Source, rounds: int = 1, feedback: bool = False, max_chars: int = 2000, variant: str = "barebones") -> DataFrame:
    """(example_id, round, attempt, text) of rounds of attempts; with feedback a round's prompt ends with the notes on all rounds before.

    No attempt is taken as success here, so every example runs all rounds. Notes follow the question in order, as the
    turns of a conversation do. Prompts and attempts are written each round, so the number of rounds doesn't lengthen the plan.
    """
    from evalgrove.sources.staging import staged

    asked = examples.select("example_id", P.question_prompt(F.col("question"), variant).alias("prompt"))
    done = None
    for r in range(1, rounds + 1):
        got = staged(fan_out(asked, in_round(source, r)).select("example_id", F.lit(r).alias("round"), F.col("completion").alias("attempt"), F.col("reply").alias("text")), "attempts")
        done = got if done is None else done.unionByName(got)
        if feedback and r < rounds:
            failed = got.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "text"))).alias("a"))
            notes = failed.select("example_id", P.feedback_block(F.lit(r), F.transform("a", lambda x: x["text"]), max_chars).alias("note"))
            asked = staged(asked.join(notes, "example_id").select("example_id", F.concat_ws("\n\n", "prompt", "note").alias("prompt")), "asked")
    return done
