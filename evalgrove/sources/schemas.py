"""Schemas of the stages' tables, so that nothing is inferred from files."""

from __future__ import annotations

EXAMPLES = "data_id string, image_id string, question string, entity_id string, entity_text string, answer string, dataset string, image_path string, original_answer string"
SAMPLES = (
    EXAMPLES + ", prediction string, method string, prompt_variant string, sampling string, n_samples int, success boolean, all_texts array<string>, attempts_per_round int, max_rounds int, enable_feedback boolean, success_round int, total_attempts int, "
    "attempts array<struct<round:int,attempt:int,text:string,matched:boolean>>"
)
VOTES = "array<struct<votes_yes:int,votes_no:int>>"
JUDGED = (
    SAMPLES + ", judge_verdicts array<boolean>, judge_parse_ok array<boolean>, judge_hit boolean, judge_hit_count int, judge_selected int, "
    "judge_selected_text string, judge_reasons array<string>, judge_raw array<string>, judge_verdicts_majority array<boolean>, "
    f"judge_hit_majority boolean, judge_hit_count_majority int, judge_selected_majority int, judge_selected_text_majority string, judge_votes {VOTES}"
)
CHAINS = "id string, taxonomy array<string>"
ALIASES = "id string, aka struct<en:array<struct<value:string>>>"
ROLLOUTS = "example_id string, idx int, text string, verdict boolean, parse_ok boolean"
METRICS = "run string, measure string, metric string, value double"
METADATA = "model string, prompt_variant string, judge_model string, data struct<input:string,no_image:boolean,num_examples:int>, sharding struct<num_shards:int>"
#: What scoring adds for a measure.
MEASURED = "{m}_predicted_node string, {m}_predicted_path array<string>, {m}_hP double, {m}_hR double, {m}_hF double, {m}_exact_match boolean, {m}_mapping_method string"
REPLIES = "prompt string, completion int, reply string"
