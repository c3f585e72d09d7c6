"""Prompts and replies on Columns: question prompts, judge prompts, feedback, aggregation, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Question prompts by variant; {} takes the question.
VARIANTS = {
    "base_pretrained": "Q: {}\nA:",
    "barebones": "{} Answer in the format 'A: <answer>.'",
    "concise": "{} Answer questions directly and concisely. If you don't know, say 'I don't know'.",
    "concise_no_idk": "{} Answer questions directly and concisely. If you don't know, give your best guess.",
    "default": "{} Do not give any extra text. Do not answer in a full sentence. Do not specify your certainty about the answer. Give your best guess if you are not sure. Answer in the format 'A: <answer>.'",
    "specific": "{} Do not give any extra text. Do not answer in a full sentence. Do not specify your certainty about the answer. Give your best guess if you are not sure. Be as specific as possible. Answer in the format 'A: <answer>.'",
    "vague": "{} Do not try to be overly specific. Aim for a simple answer as if you were talking to a child. Answer in the format 'A: <answer>.'",
}
#: The judge's instructions, in parts around the row's fields.
JUDGE_HEAD = "You are verifying whether a model's answer to a visual question matches the ground truth.\n\n"
JUDGE_TAIL = (
    "Is the model's answer semantically equivalent to the ground truth?\n\n"
    "Respond with a JSON object containing exactly two fields:\n"
    '- "verdict": either "yes" or "no"\n'
    '- "reason":  one short sentence explaining your decision\n\n'
    "Always include both fields, for both yes and no verdicts."
)
FREE_HEAD = (
    "Your task is to judge whether the given response to a question matches a given ground truth answer or not. "
    "You are provided with a question, a ground truth answer, and the response you need to judge.\n\n"
)
FREE_HEAD_EVIDENCE = (
    "Your task is to judge whether the given response to a question matches a given ground truth answer or not. "
    "You are provided with a question, a ground truth answer, supporting description evidence for the ground truth answer, "
    "and the response you need to judge.\n\n"
)
FREE_RULE = "The response matches the ground truth if both are semantically equivalent — they refer to the same entity at the level of specificity asked by the question.\n\n"
FREE_RULE_EVIDENCE = "Use the description evidence only to disambiguate the ground-truth answer. Do not mark a response correct merely because it matches only the parent or grandparent class.\n\n"
FREE_SCALE = 'Possible judgments:\n\n"0": The response does not match the ground-truth answer.\n"1": The response matches the ground-truth.\n\n'
FREE_TAIL = (
    "Your job is to ONLY check whether the given response matches the ground truth answer or not in the context of the question. "
    "You DO NOT NEED to assess the correctness of the response. This is part of an automated evaluation process, therefore you "
    'MUST OUTPUT your final answer as "0" or "1" in <answer> </answer> tags.\n'
    "YOU SHOULD ALWAYS END YOUR RESPONSE WITH <answer>0</answer> OR <answer>1</answer> TAGS."
)
EVIDENCE_TITLE = "Ground-truth description evidence:"
ROLES = ("Ground truth", "Parent", "Grandparent")
#: Instructions for improving on candidate answers.
ONE_CANDIDATE = (
    "You are given an image question and one candidate answer. The candidate may be incomplete or wrong. Use the image and the question "
    "to produce one improved answer. If the candidate is wrong, answer with a better label. Return only the final answer; do not explain.\n"
)
MANY_CANDIDATES = (
    "You are given an image question and several candidate answers. Some candidates may be incorrect or under-specific. Aggregate the useful clues, "
    "choose the answer best supported by the image and question, and produce one improved answer. If all candidates seem wrong, answer with a better label. "
    "Return only the final answer; do not explain.\n"
)
CUT_MARK = "\n...(truncated)"


def question_prompt(question: Column, variant: str = "barebones") -> Column:
    if variant not in VARIANTS:
        raise ValueError(f"unknown prompt variant {variant!r}, known: {sorted(VARIANTS)}")
    before, after = VARIANTS[variant].split("{}")
    return F.concat(F.lit(before), question, F.lit(after))


def judge_prompt(question: Column, truth: Column, answer: Column) -> Column:
    return F.concat(F.lit(JUDGE_HEAD + "Question: "), question, F.lit("\nGround truth: "), truth, F.lit("\nModel's answer: "), answer, F.lit("\n\n" + JUDGE_TAIL))


def evidence_block(labels: Column, descriptions: Column) -> Column:
    """Up to three described levels under a title; empty without any description."""
    one = lambda i, role: F.when(
        strip(F.get(descriptions, F.lit(i))) != "",
        F.concat(
            F.lit(f"- {role}: "),
            F.when(strip(F.get(labels, F.lit(i))) != "", F.concat(strip(F.get(labels, F.lit(i))), F.lit(" — "))).otherwise(F.lit("")),
            strip(F.get(descriptions, F.lit(i))),
        ),
    )
    lines = F.array_compact(F.array(*[one(i, role) for i, role in enumerate(ROLES)]))
    return F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(EVIDENCE_TITLE), F.array_join(lines, "\n"))).otherwise(F.lit(""))


def free_form_prompt(question: Column, truth: Column, answer: Column, evidence: Column | None = None) -> Column:
    """The prompt for a 0/1 verdict; rows with an evidence block get the longer form."""
    quoted = lambda name, x: F.concat(F.lit(f'{name}: "'), x, F.lit('"\n'))
    asked = F.concat(quoted("Question", question), quoted("Ground truth", truth))
    said = F.concat(quoted("Response", answer), F.lit("\n" + FREE_TAIL))
    plain = F.concat(F.lit(FREE_HEAD + FREE_RULE + FREE_SCALE), asked, said)
    if evidence is None:
        return plain
    return F.when(evidence == "", plain).otherwise(F.concat(F.lit(FREE_HEAD_EVIDENCE + FREE_RULE + FREE_RULE_EVIDENCE + FREE_SCALE), asked, evidence, F.lit("\n"), said))


def feedback_block(round_no: Column, failed: Column, max_chars: int = 2000, final: bool = False) -> Column:
    clip = lambda t: F.when(F.length(t) <= max_chars, t).otherwise(F.concat(F.substring(t, 1, max_chars), F.lit(CUT_MARK)))
    chunks = F.transform(failed, lambda t, i: F.concat(F.lit("Attempt "), (i + 1).cast("string"), F.lit(":\n"), clip(t)))
    block = F.array_join(chunks, "\n\n")
    if final:
        return F.concat(F.lit("All sampled answers in final round "), round_no.cast("string"), F.lit(" were incorrect.\n\nFailed attempts:\n"), block)
    return F.concat(
        F.lit("All sampled answers in round "), round_no.cast("string"), F.lit(" were incorrect.\n\nFailed attempts:\n"), block,
        F.lit("\n\nUse these failed attempts as evidence. Reflect on what they missed, then answer again. State the final class label clearly."),
    )


def asked_root(question: Column, variant: str = "barebones") -> Column:
    """What equal prompts of aggregation_prompt() have in common, whatever their candidates: the question as asked, up to where candidates begin.

    In a prompt the same words follow the question, which ends without a line end, so a question that holds those words is cut at
    the place where the prompt is. Prompts of questions with different roots are different.
    """
    return F.substring_index(strip(question_prompt(question, variant)), "\n\nCandidate answer", 1)


def aggregation_prompt(question: Column, candidates: Column, variant: str = "barebones") -> Column:
    asked = F.concat(F.lit("Question:\n\n"), strip(question_prompt(question, variant)), F.lit("\n"))
    one = F.concat(F.lit("Candidate answer (may contain mistakes):\n\n---- Candidate ----\n"), strip(F.get(candidates, F.lit(0))), F.lit("\n\nNow write the improved final answer."))
    each = F.transform(candidates, lambda t, i: F.concat(F.lit("---- Answer "), (i + 1).cast("string"), F.lit(" ----\n"), strip(t), F.lit("\n")))
    many = F.concat_ws("\n", F.lit("Candidate answers (may contain mistakes):\n"), F.array_join(each, "\n"), F.lit("Now write a single improved final answer."))
    return F.when(F.size(candidates) == 1, F.concat_ws("\n", F.lit(ONE_CANDIDATE), asked, one)).otherwise(F.concat_ws("\n", F.lit(MANY_CANDIDATES), asked, many))


def parse_structured(reply: Column) -> Column:
    """struct(verdict, reason, parse_ok) of a JSON reply; anything malformed is false, '(parse error)'."""
    fields = F.from_json(reply, "verdict string, reason string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    texts = F.regexp_like(reply, F.lit(r'"reason"\s*:\s*"')) & F.regexp_like(reply, F.lit(r"(?s)^\s*\{.*\}\s*$"))
    ok = F.coalesce(fields["_bad"].isNull() & fields["verdict"].isin("yes", "no") & (strip(fields["reason"]) != "") & texts, F.lit(False))
    return F.struct((ok & (fields["verdict"] == "yes")).alias("verdict"), F.when(ok, strip(fields["reason"])).otherwise(F.lit("(parse error)")).alias("reason"), ok.alias("parse_ok"))


def parse_free_form(reply: Column) -> Column:
    """struct(verdict, digit, parse_ok): the last tagged digit decides, no tag is false."""
    digit = F.coalesce(F.try_element_at(F.regexp_extract_all(reply, F.lit(r"<answer>\s*(\d)\s*</answer>"), F.lit(1)), F.lit(-1)), F.lit(""))
    return F.struct((digit == "1").alias("verdict"), digit.alias("digit"), (digit != "").alias("parse_ok"))


def described(labels: Column, descriptions: Column) -> Column:
    """The descriptions of a chain's labels from a map, '' where one is missing."""
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(descriptions, x), F.lit("")))
