"""Text functions on Columns: normalisers, cleaners, n-grams, containment, refusals, labels of models.

The normalisers differ on purpose and are not interchangeable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that count as white space at the ends of texts.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that model output carries, removed in this order.
MARKS = ("A: ", "A:", "<answer>", "</answer>", "<s>", "</s>")
HEADER_END, TURN_END = "<|end_header_id|>", "<|eot_id|>"
#: Answers that refuse, and patterns of refusals.
REFUSALS = ("i don't know", "i don't know.", "i don't know,", "i dont know", "i dont know.")
REFUSAL_PATTERNS = (
    r"\bi don'?t know\b",
    r"\bnot sure\b",
    r"\bcannot (?:determine|identify|tell|answer|say)\b",
    r"\bcan'?t (?:determine|identify|tell|answer|say)\b",
    r"\bno idea\b",
    r"\bunsure\b",
    r"\bunknown\b",
    r"\bunable to (?:determine|identify|tell)\b",
    r"\bimpossible to (?:determine|identify|tell|say)\b",
    r"\bnot possible to (?:determine|identify|tell)\b",
)
#: Categories of a judged answer that support its verdict.
SUPPORTED = ("exact", "alias", "contains_answer", "contains_alias")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; trim() alone knows blanks only."""
    return F.trim(text, F.lit(BLANKS))


def normalize_scores(text: Column) -> Column:
    """Lower case, hyphens to blanks, other ASCII punctuation deleted; white space stays."""
    return F.translate(F.translate(F.lower(text), "-", " "), PUNCTUATION, "")


def squeeze(text: Column, pattern: str = r"(?U)\s+") -> Column:
    return F.trim(F.regexp_replace(text, pattern, " "))


def normalize_match(text: Column) -> Column:
    """normalize_scores with white space collapsed and trimmed. Unicode letters stay."""
    return squeeze(normalize_scores(text))


def normalize_audit(text: Column) -> Column:
    """Lower case, tags to blanks, everything but a-z and 0-9 to single blanks."""
    bare = F.regexp_replace(strip(F.lower(text)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def normalize_index(text: Column) -> Column:
    """Lower case, _ and - to blanks, everything but a-z, 0-9 and blanks to single blanks."""
    bare = F.regexp_replace(F.translate(F.lower(text), "_-", "  "), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clean_light(text: Column) -> Column:
    """Without output marks, trimmed."""
    for mark in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return strip(text)


def clean_full(text: Column) -> Column:
    """clean_light, the last turn only, and without one mark of punctuation at the end."""
    for mark in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    text = F.substring_index(F.substring_index(text, HEADER_END, -1), TURN_END, 1)
    return strip(F.regexp_replace(strip(text), r"[.!?,;]\z", ""))


def words(text: Column) -> Column:
    """Blank-separated words of a normalised text; none for the empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def bound(value: Column, then) -> Column:
    """then(value) with value evaluated once a row, not once for each place of a lambda inside."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of words; empty if there are fewer words."""

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return bound(words(text), grams)


def grams_of(chars: Column, n: int) -> Column:
    """Distinct runs of n of an array of characters, as texts; empty if there are fewer."""
    each = F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.size(chars) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def char_grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters; empty if there are fewer characters."""
    return bound(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: grams_of(c, n))


def ngram_overlap(prediction: Column, label: Column, n: int = 2) -> Column:
    """Share of the label's n-grams that the prediction has; 0 if the label has none."""
    share = lambda g: F.when(F.size(g) > 0, F.size(F.array_intersect(ngrams(prediction, n), g)) / F.size(g)).otherwise(F.lit(0.0))
    return bound(ngrams(label, n), share)


def contained(prediction: Column, label: Column) -> Column:
    """1.0 if the normalised label is part of the normalised prediction; the empty label always is."""
    return F.contains(normalize_match(prediction), normalize_match(label)).cast("double")


def exact_pair(prediction: Column, reference: Column) -> Column:
    return (prediction == reference).cast("double")


def contained_pair(prediction: Column, reference: Column) -> Column:
    """1.0 if the reference is part of the prediction, case aside."""
    return F.contains(F.lower(prediction), F.lower(reference)).cast("double")


def phrase_in(needle: Column, haystack: Column) -> Column:
    """Whole-word containment of normalised texts; the empty needle is in none."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (needle != "") & F.contains(pad(haystack), pad(needle))


def is_alias_seed(alias: Column) -> Column:
    """Long enough for containment checks, and not a mere number."""
    return (F.length(alias) >= 4) & ~F.regexp_like(alias, F.lit("^[0-9]+$"))


def is_refusal(text: Column) -> Column:
    return F.lower(strip(text)).isin(*REFUSALS)


def is_refusal_fuzzy(text: Column) -> Column:
    low = F.lower(strip(text))
    return is_refusal(text) | F.regexp_like(low, F.lit("|".join(REFUSAL_PATTERNS)))


def is_supported(category: Column) -> Column:
    return F.coalesce(category.isin(*SUPPORTED), F.lit(False))


def first_full(*candidates: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def model_slug(model: Column) -> Column:
    """'8b' from a model's name, the name itself if it says no size."""
    size = F.lower(F.regexp_extract(model, r"(?i)(\d+)b", 1))
    return F.when(size != "", F.concat(size, F.lit("b"))).otherwise(model)


def model_label(slug: Column, families: dict[str, str], bare: bool = False) -> Column:
    """'Family 8B' from a slug with '-8b-'; families maps parts of slugs to names, first match wins.

    Without a match the slug's part before _ is the family; with bare, the slug itself is the label.
    """
    found = F.regexp_extract(slug, r"-(\d+b)-", 1)
    size = F.when(found != "", F.upper(found)).otherwise(slug)
    label = slug if bare else F.concat_ws(" ", F.substring_index(slug, "_", 1), size)
    for part, name in reversed(families.items()):
        label = F.when(F.contains(slug, F.lit(part)), F.concat_ws(" ", F.lit(name), size)).otherwise(label)
    return label


def above(path: Column, up: int = 1) -> Column:
    """The name of the folder that many levels above a path; empty if there are fewer."""
    parts = F.split(path, "/")
    return F.coalesce(F.get(parts, F.size(parts) - 1 - up), F.lit(""))


def stem(path: Column) -> Column:
    """A path's last name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def path_label(path: Column, families: dict[str, str]) -> Column:
    """'Family 8B' from the first family in a path that a size follows, else the name two levels above."""
    label = above(path, 2)
    for part, name in reversed(families.items()):
        size = F.regexp_extract(path, f"{re.escape(part)}-(\\d+b)", 1)
        label = F.when(size != "", F.concat(F.lit(name + " "), F.upper(size))).otherwise(label)
    return label


def run_label(path: Column, lead: str, tail: str) -> Column:
    """What the first name in a path that begins with lead and ends with tail has between them, in upper case; else the stem."""
    named = F.filter(F.split(path, "/"), lambda x: F.startswith(x, F.lit(lead)) & F.endswith(x, F.lit(tail)))
    rest = F.substring(F.get(named, F.lit(0)), len(lead) + 1, 1 << 30)
    inner = F.regexp_replace(rest, f"{re.escape(tail)}$", "") if tail else rest
    return F.coalesce(F.upper(inner), stem(path))


def run_id(started: Column, number: Column) -> Column:
    """Date, time and six digits of a number, so that runs of one second differ."""
    return F.concat_ws("_", F.date_format(started, "yyyyMMdd_HHmmss"), F.lpad(F.pmod(number, F.lit(1_000_000)).cast("string"), 6, "0"))


def output_dir(root: str, task: str, method: Column, prompt: Column, model: Column, run: Column) -> Column:
    """root/task_method_prompt/model/run, the model's name lower-cased with _ for /."""
    return F.concat_ws("/", F.lit(root), F.concat_ws("_", F.lit(task), method, prompt), F.lower(F.translate(model, "/", "_")), run)


def aggregated_path(path: Column, population: int, k: int, steps: int) -> Column:
    """Where the answers that a samples file is aggregated to go: beside it, with the sizes in the name."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, stem(path), F.lit(f"_rsa_n{population}_k{k}_t{steps}.jsonl"))


def results_path(path: Column) -> Column:
    """Where the metrics of a samples or judged file go: run_judged_x.jsonl gives run_results_x.json."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    judged = r"^(.+?)(?:_samples)?_judged_([A-Za-z0-9_.-]+)\.jsonl$"
    target = (
        F.when(F.regexp_like(name, F.lit(judged)), F.regexp_replace(name, judged, "$1_results_$2.json"))
        .when(F.regexp_like(name, F.lit(r"^.+_samples\.jsonl$")), F.regexp_replace(name, r"_samples\.jsonl$", "_results.json"))
        .otherwise(F.lit("generations_results.json"))
    )
    return F.concat(folder, target)
