"""Queries on audits, hit counts, refusals and diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import text as T
from evalgrove.operators import audit as A
from evalgrove.operators import compare as C
from evalgrove.operators import taxonomy as X

from .registry import Tables, d_audit, d_pass, query
from .score_queries import _round

_AL = f"(SELECT DISTINCT {d_audit('label')} AS canonical, {d_audit('alias')} AS alias FROM {{part_aliases}})"
_P, _A = d_audit("text"), d_audit("answer")


def _in(needle: str, hay: str) -> str:
    return f"({needle} <> '' AND contains(concat(' ', {hay}, ' '), concat(' ', {needle}, ' ')))"


_CLASSIFIED = (
    f"(SELECT example_id, idx, verdict, CASE WHEN p = a THEN 'exact' WHEN list_contains(names, p) THEN 'alias' WHEN {_in('a', 'p')} THEN 'contains_answer' "
    f"WHEN len([x for x in names if length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$') AND contains(concat(' ', p, ' '), concat(' ', x, ' '))]) > 0 THEN 'contains_alias' "
    f"WHEN {_in('p', 'a')} THEN 'answer_contains_prediction' END AS category FROM (SELECT r.*, coalesce(n.names, []) AS names FROM (SELECT example_id, idx, verdict, {_P} AS p, {_A} AS a FROM {{rollouts}}) r "
    f"LEFT JOIN (SELECT canonical, list(alias) AS names FROM {_AL} GROUP BY 1) n ON r.a = n.canonical))"
)
_OK = "coalesce(category IN ('exact', 'alias', 'contains_answer', 'contains_alias'), FALSE)"


def _classified(t: Tables) -> DataFrame:
    return A.classify(t.rollouts, X.aliases_by_label(t.part_aliases))


@query(f"SELECT example_id, idx, category FROM {_CLASSIFIED}")
def classify_positive(t: Tables) -> DataFrame:
    return _classified(t).select("example_id", "idx", "category")


_PER = (
    f"(SELECT example_id % 3 AS run, example_id, count(*) AS n, count_if(verdict) AS c, count_if(verdict AND {_OK}) AS s, count_if(verdict AND category = 'exact') AS exact, "
    f"count_if(verdict AND category = 'contains_alias') AS contains_alias, count_if(verdict AND category = 'answer_contains_prediction') AS under FROM {_CLASSIFIED} GROUP BY 1, 2)"
)


def _audit(t: Tables) -> DataFrame:
    return A.audit(_classified(t).withColumn("run", F.col("example_id") % 3))


@query(
    f"SELECT run::BIGINT AS run, count(*)::BIGINT AS rows, count_if(c > 0)::BIGINT AS judge_hit_examples, count_if(s > 0)::BIGINT AS supported_hit_examples, "
    f"round(avg({d_pass('n', 'c', '1')}), 9) AS judge_pass_1, round(avg({d_pass('n', 's', '1')}), 9) AS supported_pass_1, round(avg({d_pass('n', 'c', 'n')}), 9) AS judge_pass_n, round(avg({d_pass('n', 's', 'n')}), 9) AS supported_pass_n, "
    f"sum(c)::BIGINT AS judge_positive, sum(s)::BIGINT AS supported_positive, sum(exact)::BIGINT AS exact, sum(contains_alias)::BIGINT AS contains_alias, sum(under)::BIGINT AS answer_contains_prediction, "
    f"round(100.0::DOUBLE * sum(s) / sum(c), 9) AS supported_percent, round(100.0::DOUBLE * sum(under) / sum(c), 9) AS under_specific_percent FROM {_PER} GROUP BY run"
)
def audit_summary(t: Tables) -> DataFrame:
    out = _audit(t).select("run", "rows", "judge_hit_examples", "supported_hit_examples", "judge_pass_1", "supported_pass_1", "judge_pass_n", "supported_pass_n", "judge_positive", "supported_positive", "exact", "contains_alias", "answer_contains_prediction", "supported_percent", "under_specific_percent")
    return _round(out, "judge_pass_1", "supported_pass_1", "judge_pass_n", "supported_pass_n", "supported_percent", "under_specific_percent")


@query(
    f"SELECT run::BIGINT AS run, round(avg(c) FILTER (WHERE c > 0), 9) AS mean_judge_pos, median(c) FILTER (WHERE c > 0)::DOUBLE AS median_judge_pos, round(avg(s) FILTER (WHERE s > 0), 9) AS mean_supported_pos, median(s) FILTER (WHERE s > 0)::DOUBLE AS median_supported_pos FROM {_PER} GROUP BY run"
)
def audit_medians(t: Tables) -> DataFrame:
    return _round(_audit(t).select("run", "mean_judge_pos", "median_judge_pos", "mean_supported_pos", "median_supported_pos"), "mean_judge_pos", "mean_supported_pos")


@query(f"SELECT run::BIGINT AS run, CASE WHEN min(n) = max(n) THEN max(n)::VARCHAR ELSE concat('var:', min(n)::VARCHAR, '-', max(n)::VARCHAR) END AS k FROM {_PER} GROUP BY run")
def rollout_size_label(t: Tables) -> DataFrame:
    return _audit(t).select("run", "k")


_CI = "(SELECT example_id, count(*) AS n, count_if(verdict) AS c FROM {rollouts} GROUP BY 1)"
_CU = "(SELECT example_id, count(*) AS n, count_if(verdict) AS c FROM {user_rollouts} GROUP BY 1)"
_CB = "(SELECT example_id, count(*) AS n, count_if(verdict) AS c FROM {other_run} GROUP BY 1)"
_BIN = "CASE WHEN c < 2 THEN 1 WHEN c < 3 THEN 2 WHEN c < 5 THEN 3 WHEN c < 9 THEN 5 WHEN c < 17 THEN 9 WHEN c < 33 THEN 17 WHEN c < 65 THEN 33 WHEN c < 129 THEN 65 ELSE 129 END"


@query(f"SELECT example_id, n::BIGINT AS n, c::BIGINT AS c, s::BIGINT AS s FROM {_PER}")
def ci_counts(t: Tables) -> DataFrame:
    return C.hit_counts(_classified(t), support=T.is_supported(F.col("category")))


@query(f"SELECT {_BIN} AS bin, count(*)::BIGINT AS examples, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 9) AS percent FROM {_CI} WHERE c > 0 GROUP BY 1 UNION ALL SELECT 1000 + {_BIN}, count(*)::BIGINT, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 9) FROM {_CU} WHERE c > 0 GROUP BY 1")
def ci_hist(t: Tables) -> DataFrame:
    lines, users = (C.histogram(C.hit_counts(r)) for r in (t.rollouts, t.user_rollouts))
    return _round(lines.unionByName(users.withColumn("bin", F.col("bin") + 1000)), "percent")


@query(f"SELECT c::BIGINT AS value, round(sum(count(*)) OVER (ORDER BY c)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM {_CU} WHERE c > 0 GROUP BY c")
def ci_cdf(t: Tables) -> DataFrame:
    return _round(C.cdf(C.hit_counts(t.user_rollouts)), "share")


@query(f"SELECT count(*)::BIGINT AS examples, round(avg(a.c), 9) AS mean_hits, round(avg((a.c = 1)::INT), 9) AS one, round(avg((a.c <= 2)::INT), 9) AS upto2, round(avg((a.c <= 4)::INT), 9) AS upto4 FROM {_CI} a JOIN {_CB} b ON a.example_id = b.example_id WHERE a.c > 0 AND b.c = 0")
def ci_diff(t: Tables) -> DataFrame:
    return _round(C.differential(C.hit_counts(t.rollouts), C.hit_counts(t.other_run)), "mean_hits", "one", "upto2", "upto4")


_MODAL = f"(SELECT example_id, max(k) AS modal FROM (SELECT example_id, text, count(*) AS k FROM {{rollouts}} GROUP BY 1, 2) WHERE example_id IN (SELECT a.example_id FROM {_CI} a JOIN {_CB} b ON a.example_id = b.example_id WHERE a.c > 0 AND b.c = 0) GROUP BY 1)"


@query(f"SELECT example_id, modal::BIGINT AS modal FROM {_MODAL}")
def modal_gap(t: Tables) -> DataFrame:
    return C.modal_gap(t.rollouts, C.hit_counts(t.rollouts), C.hit_counts(t.other_run))


@query(f"SELECT {_BIN} AS bin, count(*)::BIGINT AS examples, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 9) AS percent FROM (SELECT modal AS c FROM {_MODAL}) GROUP BY 1")
def modal_hist(t: Tables) -> DataFrame:
    modal = C.modal_gap(t.rollouts, C.hit_counts(t.rollouts), C.hit_counts(t.other_run))
    return _round(C.histogram(modal, "modal"), "percent")


@query("SELECT example_id FROM {rollouts} WHERE verdict INTERSECT SELECT example_id FROM {other_run} WHERE verdict INTERSECT SELECT user_id FROM {events}")
def common_ids(t: Tables) -> DataFrame:
    return C.common_ids([t.rollouts.where("verdict"), t.other_run.where("verdict"), t.user_rollouts])


_IDK = "lower(trim(text)) IN ('i don''t know', 'i don''t know.', 'i don''t know,', 'i dont know', 'i dont know.')"
_FUZZY = f"({_IDK} OR regexp_matches(lower(trim(text)), '\\bi don''?t know\\b|\\bnot sure\\b|\\bno idea\\b|\\bunsure\\b|\\bunknown\\b'))"


@query(f"SELECT example_id, count(*)::BIGINT AS rollouts, round(avg(({_IDK})::INT) * 100, 9) AS exact_percent, round(avg({_FUZZY}::INT) * 100, 9) AS fuzzy_percent FROM {{user_rollouts}} GROUP BY 1")
def idk_rate(t: Tables) -> DataFrame:
    return _round(C.refusal_rates(t.user_rollouts, "example_id"), "exact_percent", "fuzzy_percent")


_SAID = "(SELECT doc_id, concat(CASE doc_id % 11 WHEN 0 THEN 'I don''t know' WHEN 1 THEN 'Unsure, ' WHEN 2 THEN 'I cannot tell ' WHEN 3 THEN 'can''t say: ' WHEN 4 THEN 'unable to identify' WHEN 5 THEN 'It is impossible to tell' WHEN 6 THEN 'not possible to determine' WHEN 7 THEN 'unknowns' WHEN 8 THEN 'no ideas' WHEN 9 THEN ' I DONT KNOW.' ELSE 'dog' END, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE ' x' END) AS text FROM {documents})"


@query(
    f"SELECT doc_id, {_IDK} AS exact, ({_IDK} OR regexp_matches(lower(trim(text)), '\\bi don''?t know\\b|\\bnot sure\\b|\\bcan(not|''?t) (determine|identify|tell|answer|say)\\b|\\bno idea\\b|\\bunsure\\b|\\bunknown\\b|\\bunable to (determine|identify|tell)\\b|\\bimpossible to (determine|identify|tell|say)\\b|\\bnot possible to (determine|identify|tell)\\b')) AS fuzzy FROM {_SAID}"
)
def idk_fuzzy(t: Tables) -> DataFrame:
    rows = t.documents.selectExpr("doc_id", _SAID[len("(SELECT doc_id, ") : -len(" FROM {documents})")].replace("''", "\\'"))
    return rows.select("doc_id", T.is_refusal(F.col("text")).alias("exact"), T.is_refusal_fuzzy(F.col("text")).alias("fuzzy"))


@query(f"SELECT k::INT AS k, round(avg(share) * 100, 9) AS percent FROM (SELECT example_id, k, avg(({_IDK})::INT) AS share FROM {{user_rollouts}}, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256]) AS k) WHERE idx < k GROUP BY 1, 2) GROUP BY k")
def idk_per_k(t: Tables) -> DataFrame:
    return _round(C.refusal_by_k(t.user_rollouts), "percent")


@query("SELECT (idx + 1)::INT AS k, count(*)::BIGINT AS examples, round(avg(verdict::INT), 9) AS accuracy FROM {user_rollouts} WHERE idx + 1 IN (1, 2, 4, 8, 16, 32, 64, 80) GROUP BY 1")
def accuracy_at_k(t: Tables) -> DataFrame:
    return _round(C.accuracy_at(t.user_rollouts, (1, 2, 4, 8, 16, 32, 64, 80)), "accuracy")


@query("SELECT * FROM (SELECT example_id, text, n, verdict, row_number() OVER (PARTITION BY example_id ORDER BY n DESC, first)::INT AS place FROM (SELECT example_id, text, count(*)::BIGINT AS n, min(idx) AS first, arg_min(verdict, idx) AS verdict FROM {user_rollouts} GROUP BY 1, 2)) WHERE place <= 12")
def answer_top12(t: Tables) -> DataFrame:
    return C.answer_distribution(t.user_rollouts).select("example_id", "text", "n", "verdict", "place")


@query("SELECT example_id, count(DISTINCT text)::BIGINT AS distinct_answers FROM {rollouts} GROUP BY 1")
def answer_diversity(t: Tables) -> DataFrame:
    return C.diversity(t.rollouts)


@query(f"SELECT count(*)::BIGINT AS examples, round(avg((c > 0)::INT), 9) AS hit_rate, round(avg(c), 9) AS mean_hits, count_if(s > 0)::BIGINT AS supported, count_if(c > 0 AND s = 0)::BIGINT AS unsupported, count_if(c = 0)::BIGINT AS missed FROM {_PER}")
def dashboard_headline(t: Tables) -> DataFrame:
    return _round(C.headline(_classified(t), T.is_supported(F.col("category"))), "hit_rate", "mean_hits")


@query(f"SELECT p.example_id FROM {_PER} p WHERE c > 0 AND s = 0 AND example_id IN (SELECT example_id FROM {{rollouts}} WHERE contains(lower(text), 'gear') OR contains(lower(answer), 'gear'))")
def dashboard_filter(t: Tables) -> DataFrame:
    rows = _classified(t)
    per = rows.groupBy("example_id").agg(
        F.first("answer").alias("answer"), F.collect_list("text").alias("all_texts"),
        F.count_if("verdict").alias("c"), F.count_if(F.col("verdict") & T.is_supported(F.col("category"))).alias("s"),
    )
    return C.matching(per, hit=True, support="unsupported", search="gear").select("example_id")


@query("SELECT l_orderkey AS example_id, l_partkey AS part_id, l_linenumber AS line, CASE WHEN l_returnflag <> 'A' THEN l_returnflag WHEN l_linestatus <> 'F' THEN l_linestatus ELSE '' END AS chosen FROM {lineitem}")
def fallback_prediction(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("example_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("a"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("b"))
    return rows.select("example_id", "part_id", "line", T.first_full(F.col("a"), F.col("b")).alias("chosen"))
