"""Queries on scores, run metrics, pass@k and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import metrics as M
from evalgrove.operators import judge as J
from evalgrove.operators import rollouts as R
from evalgrove.operators import score as S
from evalgrove.sources import files

from .registry import Tables, d_common, d_match, d_pass, query

_COUNTS = "(SELECT example_id, count(*) AS n, count_if(verdict) AS c FROM {rollouts} GROUP BY 1)"
_KS = f"(SELECT DISTINCT unnest(list_append([k for k in [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048] if k <= top], top)) AS k FROM (SELECT max(n) AS top FROM {_COUNTS}))"


def _pass(strict: bool, counts: str = _COUNTS, ks: str = _KS) -> str:
    kept = "WHERE k <= n" if strict else ""
    return f"SELECT k::BIGINT AS k, round(avg({d_pass('n', 'c', 'k')}), 9) AS value FROM {counts}, {ks} {kept} GROUP BY k"


def _round(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(_pass(False))
def pass_at_k_compat(t: Tables) -> DataFrame:
    return _round(S.pass_at_k(S.verdict_counts(t.rollouts)), "value")


@query(_pass(True))
def pass_at_k_strict(t: Tables) -> DataFrame:
    return _round(S.pass_at_k(S.verdict_counts(t.rollouts), strict=True), "value")


@query(_pass(False, "(SELECT user_id, count(*) AS n, count_if(value > 20) AS c FROM {events} GROUP BY 1)", "(SELECT DISTINCT unnest(list_append([k for k in [1, 2, 4, 8, 16, 32, 64, 128, 256] if k <= top], top)) AS k FROM (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM {events} GROUP BY user_id)))"))
def pass_at_k_users(t: Tables) -> DataFrame:
    return _round(S.pass_at_k(S.verdict_counts(t.user_rollouts)), "value")


# three completions an answer: the line's own reply and two derived ones
_DIGIT = "list_last(regexp_extract_all(reply, '<answer>\\s*(\\d)\\s*</answer>', 1))"
_VOTES = (
    "(SELECT example_id, idx, part_id, supp_id, arg_min(verdict, completion) AS verdict, sum(verdict::INT)::BIGINT AS votes_yes, "
    "sum((NOT verdict AND (ok OR completion = last))::INT)::BIGINT AS votes_no, bool_or(ok) AS parse_ok FROM "
    "(SELECT *, coalesce(digit = '1', FALSE) AS verdict, digit IS NOT NULL AS ok, max(completion) OVER (PARTITION BY example_id, idx, part_id, supp_id) AS last FROM "
    f"(SELECT DISTINCT example_id, idx, part_id, supp_id, completion, {_DIGIT} AS digit FROM "
    "(SELECT example_id, idx, part_id, supp_id, 0 AS completion, reply FROM {replies} UNION ALL SELECT example_id, idx, part_id, supp_id, 1, replace(reply, '1', '0') FROM {replies} WHERE part_id % 3 > 0 "
    "UNION ALL SELECT example_id, idx, part_id, supp_id, 2, concat(reply, CASE WHEN supp_id % 2 = 0 THEN '<answer>1</answer>' ELSE '' END) FROM {replies} WHERE part_id % 3 > 1))) GROUP BY 1, 2, 3, 4)"
)


def _completions(t: Tables) -> DataFrame:
    keys = ["example_id", "idx", "part_id", "supp_id"]
    one = t.replies.select(*keys, "completion", "reply")
    two = t.replies.where("part_id % 3 > 0").select(*keys, F.lit(1).alias("completion"), F.replace("reply", F.lit("1"), F.lit("0")).alias("reply"))
    tail = F.when(F.col("supp_id") % 2 == 0, "<answer>1</answer>").otherwise("")
    three = t.replies.where("part_id % 3 > 1").select(*keys, F.lit(2).alias("completion"), F.concat("reply", tail).alias("reply"))
    return one.unionByName(two).unionByName(three).distinct()


def _voted(t: Tables) -> DataFrame:
    return J.votes(_completions(t), "example_id", "idx", "part_id", "supp_id")


@query(f"SELECT example_id, idx, part_id, supp_id, verdict, votes_yes, votes_no, parse_ok, votes_yes > votes_no AS verdict_majority FROM {_VOTES}")
def judge_votes(t: Tables) -> DataFrame:
    return _voted(t).withColumn("votes_no", F.col("votes_no").cast("long"))


@query(_pass(False, f"(SELECT example_id, count(*) AS n, count_if(votes_yes > votes_no) AS c FROM {_VOTES} GROUP BY 1)", f"(SELECT DISTINCT unnest(list_append([k for k in [1, 2, 4, 8, 16, 32, 64] if k <= top], top)) AS k FROM (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM {_VOTES} GROUP BY example_id)))"))
def pass_at_k_majority(t: Tables) -> DataFrame:
    return _round(S.pass_at_k(S.verdict_counts(_voted(t), verdict="verdict_majority")), "value")


@query(
    "SELECT example_id, count_if(verdict) > 0 AS judge_hit, count_if(verdict)::BIGINT AS judge_hit_count, coalesce(min(CASE WHEN verdict THEN idx END), -1)::INT AS judge_selected, "
    "coalesce(arg_min(CASE WHEN verdict THEN text END, CASE WHEN verdict THEN idx END), arg_min(text, idx), '') AS judge_selected_text FROM {rollouts} GROUP BY 1"
)
def judge_hits(t: Tables) -> DataFrame:
    return J.hits(t.rollouts)


@query(
    "SELECT DISTINCT json, coalesce(json LIKE '{{%' AND (json LIKE '%yes%' OR json LIKE '%\"no\"%') AND json NOT LIKE '%\" \"}}', FALSE) AS parse_ok, "
    "json LIKE '%\"yes\"%same%' AS verdict, CASE WHEN json LIKE '%same%' THEN 'same' WHEN json LIKE '%other%' THEN 'other' ELSE '(parse error)' END AS reason FROM {replies}".replace("{{", "{").replace("}}", "}")
)
def judge_parse_structured(t: Tables) -> DataFrame:
    from evalgrove.functions.prompts import parse_structured

    rows = t.replies.select("json").distinct().withColumn("p", parse_structured(F.col("json")))
    return rows.select("json", "p.parse_ok", "p.verdict", "p.reason")


@query(f"SELECT DISTINCT reply, coalesce({_DIGIT} = '1', FALSE) AS verdict, coalesce({_DIGIT}, '') AS digit, {_DIGIT} IS NOT NULL AS parse_ok FROM {{replies}}")
def judge_parse_freeform(t: Tables) -> DataFrame:
    from evalgrove.functions.prompts import parse_free_form

    rows = t.replies.select("reply").distinct().withColumn("p", parse_free_form(F.col("reply")))
    return rows.select("reply", "p.verdict", "p.digit", "p.parse_ok")


@query("SELECT count(parse_ok)::BIGINT AS num_judge_rollouts, count_if(NOT parse_ok)::BIGINT AS num_judge_unparseable FROM {rollouts}")
def judge_parse_stats(t: Tables) -> DataFrame:
    return S.parse_stats(t.rollouts)


_BOTH = d_common("predicted_path", "reference_path")
_H = (
    f"(SELECT *, common / len(predicted_path)::DOUBLE AS hP, common / len(reference_path)::DOUBLE AS hR, CASE WHEN common > 0 THEN 2.0::DOUBLE * common / (len(predicted_path) + len(reference_path)) ELSE 0 END AS hF, "
    f"{d_match('predicted_node')} = {d_match('answer')} AS exact_match FROM (SELECT *, {_BOTH} AS common FROM {{order_geo}}))"
)


@query(f"SELECT example_id, idx, round(hP, 9) AS hP, round(hR, 9) AS hR, round(hF, 9) AS hF, exact_match FROM {_H}")
def hier_metrics(t: Tables) -> DataFrame:
    return _round(S.scored(t.order_geo).select("example_id", "idx", "hP", "hR", "hF", "exact_match"), "hP", "hR", "hF")


_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY round(hF, 9) DESC, idx) AS n FROM {_H}) WHERE n = 1)"


def _best(t: Tables) -> DataFrame:
    return S.best_of(S.scored(t.order_geo))


@query(f"SELECT example_id, idx, predicted_node, answer, round(hP, 9) AS hP, round(hR, 9) AS hR, round(hF, 9) AS hF, exact_match FROM {_BEST}")
def best_of_n(t: Tables) -> DataFrame:
    return _round(_best(t).select("example_id", "idx", "predicted_node", "answer", "hP", "hR", "hF", "exact_match"), "hP", "hR", "hF")


@query(
    "WITH c AS (SELECT example_id, predicted_node AS text, min(idx) AS idx FROM {order_geo} WHERE verdict GROUP BY 1, 2), "
    "f AS (SELECT example_id, arg_min(predicted_node, idx) AS text, 0 AS idx FROM {order_geo} GROUP BY 1), "
    "a AS (SELECT * FROM c UNION ALL SELECT f.example_id, f.text, f.idx FROM f WHERE example_id NOT IN (SELECT example_id FROM c)), "
    f"h AS (SELECT DISTINCT example_id, predicted_node, hF, exact_match FROM {_H}) "
    "SELECT example_id, text, round(hF, 9) AS hF, exact_match FROM (SELECT a.*, h.hF, h.exact_match, row_number() OVER (PARTITION BY a.example_id ORDER BY round(hF, 9) DESC, a.idx) AS n FROM a JOIN h ON a.example_id = h.example_id AND a.text = h.predicted_node) WHERE n = 1"
)
def best_of_correct(t: Tables) -> DataFrame:
    answers = t.order_geo.withColumn("text", F.col("predicted_node"))
    fallback = answers.groupBy("example_id").agg(F.min_by("text", "idx").alias("text"))
    chosen = S.judged_candidates(answers, fallback)
    refs = t.order_geo.select("example_id", "answer", "reference_path").distinct()
    paths = t.order_geo.select("predicted_node", "predicted_path").distinct()
    rows = chosen.join(refs, "example_id").join(paths, F.col("text") == F.col("predicted_node"))
    return _round(S.best_of(S.scored(rows)).select("example_id", "text", "hF", "exact_match"), "hF")


# predictions of Asia's nations count as unmapped, so that means over mapped rows and over all rows differ
_HALF = "(SELECT *, reference_path[2] <> 'ASIA' AS mapped FROM " + _BEST + ")"
_SUMMARY = (
    "SELECT round(avg(hP) FILTER (WHERE mapped), 9) AS hP, round(avg(hR) FILTER (WHERE mapped), 9) AS hR, round(avg(hF) FILTER (WHERE mapped), 9) AS hF, round(avg(exact_match::INT) FILTER (WHERE mapped), 9) AS exact, "
    "round(avg(CASE WHEN mapped THEN hF ELSE 0 END), 9) AS hF_all, count(*)::BIGINT AS num_examples, count_if(mapped)::BIGINT AS num_mapped FROM " + _HALF
)


def _half(t: Tables) -> DataFrame:
    rows = t.order_geo.withColumn("predicted_path", F.when(F.get("reference_path", F.lit(1)) != "ASIA", F.col("predicted_path")))
    return S.best_of(S.scored(rows))


@query(
    "SELECT round(coalesce(avg(hP) FILTER (WHERE mapped), 0), 9) AS hP, round(coalesce(avg(hF) FILTER (WHERE mapped), 0), 9) AS hF, round(coalesce(avg(exact_match::INT) FILTER (WHERE mapped), 0), 9) AS exact, "
    "round(avg(CASE WHEN mapped THEN hF ELSE 0 END), 9) AS hF_all, count(*)::BIGINT AS num_examples, count_if(mapped)::BIGINT AS num_mapped FROM " + _HALF
)
def run_summary(t: Tables) -> DataFrame:
    return _round(S.run_metrics(_half(t)).select("hP", "hF", "exact", "hF_all", "num_examples", "num_mapped"), "hP", "hF", "exact", "hF_all")


@query(f"SELECT 'direct' AS measure, round(avg(hP), 9) AS hP, round(avg(hR), 9) AS hR, round(avg(hF), 9) AS hF, round(avg(exact_match::INT), 9) AS exact, count(*)::BIGINT AS num_mapped FROM {_BEST} UNION ALL SELECT 'other', round(avg(hP), 9), 0, 0, 1, count(*)::BIGINT FROM {_BEST}")
def reaggregate(t: Tables) -> DataFrame:
    rows = _best(t).withColumnRenamed("reference_path", "scored_reference_path")
    wide = rows.select("scored_reference_path", *[F.col(c).alias(f"direct_{c}") for c in ("predicted_path", "hP", "hR", "hF", "exact_match")], F.col("predicted_path").alias("other_predicted_path"), F.col("hP").alias("other_hP"), F.lit(0.0).alias("other_hR"), F.lit(0.0).alias("other_hF"), F.lit(True).alias("other_exact_match"))
    return _round(S.reaggregate(wide).select("measure", "hP", "hR", "hF", "exact", "num_mapped"), "hP", "hR", "hF", "exact")


@query(
    "SELECT 'run1' AS run, 'direct' AS measure, metric, value FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(coalesce(avg({e}) FILTER (WHERE mapped), 0), 9) AS value FROM {_HALF}" for m, e in (("hP", "hP"), ("hF", "hF"), ("exact", "exact_match::INT"))) + f" UNION ALL SELECT 'num_mapped', count_if(mapped)::DOUBLE FROM {_HALF})"
)
def metrics_long(t: Tables) -> DataFrame:
    rows = S.long_metrics(S.run_metrics(_half(t)), F.lit("run1"), F.lit("direct"), ["hP", "hF", "exact", "num_mapped"])
    return _round(rows, "value")


@query("SELECT 'run1' AS run, concat('{\"measures\":[{\"measure\":\"a\",\"metrics\":{\"n\":', count(*)::DOUBLE, '}},{\"measure\":\"b\",\"metrics\":{\"n\":', (count(*) + 1)::DOUBLE, '}}]}') AS results FROM {nation}")
def results_json(t: Tables) -> DataFrame:
    n = t.nation.agg(F.count("*").cast("double").alias("n"))
    a = S.long_metrics(n, F.lit("run1"), F.lit("a"), ["n"])
    b = S.long_metrics(n.select((F.col("n") + 1).alias("n")), F.lit("run1"), F.lit("b"), ["n"])
    return files.metrics_json(a.unionByName(b))


_SHARES = "[exp(s - list_max(v)) for s in v]"


@query(
    f"SELECT example_id, array_to_string([round(e / list_sum({_SHARES}), 9)::DECIMAL(12, 9)::VARCHAR for e in {_SHARES}], ' ') AS shares, "
    f"coalesce(len(v) >= 2 AND exp(v[1] - list_max(v)) / list_sum({_SHARES}) - exp(v[2] - list_max(v)) / list_sum({_SHARES}) < 0.001 AND exp(v[1] - list_max(v)) / list_sum({_SHARES}) - exp(v[-1] - list_max(v)) / list_sum({_SHARES}) < 0.005, FALSE) AS ambiguous FROM "
    "(SELECT l_orderkey AS example_id, list_reverse_sort(list(l_discount::DOUBLE))[1:3] AS v FROM {lineitem} GROUP BY 1)"
)
def softmax_gate(t: Tables) -> DataFrame:
    v = F.slice(F.sort_array(F.collect_list("l_discount"), asc=False), 1, 3)
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("example_id")).agg(v.alias("v")).withColumn("s", M.softmax(F.col("v")))
    return rows.select("example_id", F.array_join(F.transform("s", lambda x: x.cast("decimal(12,9)").cast("string")), " ").alias("shares"), M.is_ambiguous(F.col("s")).alias("ambiguous"))


@query("SELECT example_id, idx, text, verdict FROM {rollouts} WHERE idx < 4 - example_id % 3")
def positional_join(t: Tables) -> DataFrame:
    """Texts and verdicts of different lengths, nested and exploded again: the shorter list sets the length."""
    nested = R.nest_rollouts(t.rollouts).withColumn("judge_verdicts", F.slice("judge_verdicts", F.lit(1), (4 - F.col("example_id") % 3).cast("int")))
    return R.explode_rollouts(nested, "example_id", verdicts="judge_verdicts")


@query("SELECT example_id, text, min(idx)::INT AS idx FROM {rollouts} GROUP BY 1, 2")
def distinct_candidates(t: Tables) -> DataFrame:
    return R.distinct_candidates(t.rollouts)


_HITS = "SELECT '{name}' AS variant, c, count(*)::BIGINT AS examples FROM (SELECT example_id, count_if(verdict)::BIGINT AS c FROM {{{name}}} GROUP BY 1) GROUP BY 2"


@query(_HITS.format(name="rollouts") + " UNION ALL " + _HITS.format(name="other_run"))
def variants(t: Tables) -> DataFrame:
    """Hits of two runs below one another, as a chart draws them."""
    counted = lambda rows: S.verdict_counts(rows).groupBy("c").agg(F.count("*").alias("examples"))
    return S.variants({"rollouts": counted(t.rollouts), "other_run": counted(t.other_run)})
