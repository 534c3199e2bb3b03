"""Grounding, rates, comparisons over conversations, labels, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grounding as gr
from ..functions import stats as st
from ..functions import text as tx
from ..operators import compare as cp
from ..operators import evaluate as ev
from ..operators import reconcile as rc
from ..operators import retrieve as rt
from .text_queries import query, table

# Answers are made from the words of each assistant turn, in the shapes that occur, and judged against candidates from the same words;
# the SQL makes the same texts and parses them with its own JSON functions.
#: By (7 conv_id + turn) % 10: list, object, empty list, item without name, prose, fenced list, list of numbers, names from elsewhere, unclosed fence, no answer.
SHAPES = (
    '[{"name":"%1 %2","description":"x"},{"name":"%3"}]', '{"name":"%1"}', "[]", '[{"description":"%1"}]', "recommended: %1",
    '```json\n[{"name":"%2"}]\n```', "[1]", '[{"name":"%1"},{"name":"alien"},{"name":"%4"},{"name":"other"}]', '```\n[{"name":"%3 %1"}]', None,
)


def answers(spark, d):
    """(conv_id, turn, route, arm, answer, cands) of each assistant turn."""
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda w: w != "")

    def made(w):
        word = lambda i: F.coalesce(F.get(w, F.lit(i - 1)), F.lit("none"))
        text = F.element_at(F.array(*map(F.lit, SHAPES)), ((7 * F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int")).cast("string")
        for i in (1, 2, 3, 4):
            text = F.replace(text, F.lit(f"%{i}"), word(i))
        cands = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.upper(word(1)), word(3), F.concat(word(4), F.lit(" ")), F.lit("")))
        return F.struct(text.alias("answer"), cands.alias("cands"))

    # Exploded from an array of one, so that the words are found once and not by each expression that reads an answer.
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(F.array(gr.let(words, made))).alias("m"))
    return rows.select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, "menu").otherwise("ingredient").alias("route"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b").alias("arm"), "m.answer", "m.cands")


_sql = lambda s: "NULL" if s is None else "replace(replace(replace(replace('" + s.replace("\n", "' || chr(10) || '") + "', '%1', c1), '%2', c2), '%3', c3), '%4', c4)"
A = rf"""w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, coalesce(w[1], 'none') AS c1, coalesce(w[2], 'none') AS c2, coalesce(w[3], 'none') AS c3, coalesce(w[4], 'none') AS c4 FROM w),
t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'menu' ELSE 'ingredient' END AS route, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm,
  CASE (7 * conv_id + turn) % 10 {' '.join(f'WHEN {i} THEN {_sql(x)}' for i, x in enumerate(SHAPES))} END AS answer,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN []::VARCHAR[] ELSE [upper(c1), c3, c4 || ' ', ''] END AS cands FROM c),
bare AS (SELECT *, CASE WHEN trim(answer) LIKE '```%' THEN regexp_replace(regexp_replace(substr(trim(answer), 4), '^[ ]*[A-Za-z]+[ ]*' || chr(10), ''), '```[^`]*$', '') ELSE answer END AS body FROM t),
j AS (SELECT *, coalesce(json_valid(body), FALSE) AS valid, CASE WHEN json_valid(body) THEN json_type(body) END AS kind, [lower(regexp_replace(x, '\s+', '', 'g')) FOR x IN cands IF x <> ''] AS nc FROM bare),
n AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN [nullif(json_extract_string(body, '$[' || i || '].name'), '') FOR i IN range(json_array_length(body)::BIGINT)] END AS names FROM j),
a0 AS (SELECT *, len(list_filter(names, lambda x: x IS NULL)) > 0 AS nameless, coalesce(len(names), 0) AS many FROM n),
a1 AS (SELECT *, CASE WHEN answer IS NULL THEN 'absent' WHEN NOT valid THEN 'prose' WHEN many = 0 THEN 'not_list' WHEN nameless THEN 'item_without_name' WHEN len(cands) = 0 THEN 'no_candidates' ELSE 'ok' END AS skip,
  CASE WHEN many = 0 OR nameless THEN []::VARCHAR[] ELSE names END AS named,
  [lower(regexp_replace(x, '\s+', '', 'g')) FOR x IN (CASE WHEN many = 0 OR nameless THEN []::VARCHAR[] ELSE names END)] AS nn FROM a0),
a2 AS (SELECT *, [list_contains(nc, x) FOR x IN nn] AS strict, [len(list_filter(nc, lambda c: c <> '' AND contains(x, c))) > 0 FOR x IN nn] AS lenient FROM a1),
a AS (SELECT *, len(named) AS items, len(list_filter(lenient, lambda x: NOT x)) AS out_lenient, len(list_filter(strict, lambda x: NOT x)) AS out_strict,
  CASE WHEN NOT valid THEN 'json_parse_error' WHEN many = 0 THEN 'not_a_list' WHEN nameless THEN 'missing_name_field'
    WHEN len(list_filter(lenient, lambda x: NOT x)) > 0 THEN 'ungrounded:' || array_to_string([named[i] FOR i IN range(1, len(named) + 1) IF NOT lenient[i]][1:3], ',') ELSE 'ok' END AS reason FROM a2),
i AS (SELECT conv_id, turn, route, arm, unnest(range(len(named)))::INTEGER AS pos, unnest(named) AS name, unnest(strict) AS strict, unnest(lenient) AS lenient FROM a WHERE skip = 'ok')"""


def judged(spark, d):
    return ev.per_answer(answers(spark, d), F.col("answer"), F.col("cands"), ["conv_id", "turn", "route", "arm"])


@query(f"WITH {A} SELECT conv_id, turn, reason FROM a")
def validate_reasons(spark, d):
    return answers(spark, d).select("conv_id", "turn", gr.validation(F.col("answer"), F.col("cands")).alias("reason"))


@query(f"WITH {A} SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM a GROUP BY 1")
def reason_histogram(spark, d):
    return ev.reasons(answers(spark, d), gr.validation(F.col("answer"), F.col("cands")))


@query(f"WITH {A} SELECT conv_id, turn, pos, name, strict, lenient FROM i")
def ground_items(spark, d):
    return ev.judged_items(answers(spark, d), F.col("answer"), F.col("cands"), ["conv_id", "turn"])


@query(f"WITH {A} SELECT route, count(*) AS items, count(*) FILTER (NOT lenient) AS out_lenient, count(*) FILTER (NOT strict) AS out_strict FROM i GROUP BY route")
def ground_rates(spark, d):
    return ev.item_rates(ev.judged_items(answers(spark, d), F.col("answer"), F.col("cands"), ["conv_id", "turn", "route"]), ["route"])


@query(f"WITH {A} SELECT skip, count(*) AS n FROM a GROUP BY skip")
def skip_reasons(spark, d):
    return answers(spark, d).groupBy(gr.skip_reason(F.col("answer"), F.col("cands")).alias("skip")).agg(F.count("*").alias("n"))


@query(f"WITH {A} SELECT conv_id, turn, route, arm, skip, split_part(reason, ':', 1) AS reason, items, out_lenient, out_strict FROM a")
def answer_scores(spark, d):
    return judged(spark, d)


@query(f"""WITH {A}, s AS (SELECT route, grouping(route)::INTEGER AS overall, count(*) FILTER (skip = 'ok') AS evaluated, count(*) FILTER (skip <> 'ok') AS skipped, coalesce(sum(items) FILTER (skip = 'ok'), 0)::BIGINT AS items,
coalesce(sum(out_strict) FILTER (skip = 'ok'), 0)::BIGINT AS out_strict, coalesce(sum(out_lenient) FILTER (skip = 'ok'), 0)::BIGINT AS out_lenient, count(*) FILTER (skip = 'ok' AND out_strict > 0) AS answers_strict, count(*) FILTER (skip = 'ok' AND out_lenient > 0) AS answers_lenient FROM a GROUP BY GROUPING SETS ((), (route)))
SELECT *, out_strict / nullif(items, 0) AS out_strict_rate, out_lenient / nullif(items, 0) AS out_lenient_rate, answers_strict / nullif(evaluated, 0) AS answers_strict_rate, answers_lenient / nullif(evaluated, 0) AS answers_lenient_rate FROM s""")
def grounding_summary(spark, d):
    return ev.grounding_summary(judged(spark, d))


@query(f"""WITH {A}, s AS (SELECT route, arm, count(*) AS answers, count(*) FILTER (skip NOT IN ('ok', 'no_candidates')) AS parse_fail, sum(items)::BIGINT AS items, sum(out_lenient)::BIGINT AS out_lenient, sum(out_strict)::BIGINT AS out_strict FROM a GROUP BY route, arm)
SELECT *, out_lenient / nullif(items, 0) AS rate_lenient, out_strict / nullif(items, 0) AS rate_strict FROM s""")
def ab_scores(spark, d):
    return ev.arm_scores(judged(spark, d))


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({k}::DOUBLE / {n})", "(1.96::DOUBLE * 1.96::DOUBLE)"
    mid, spread = f"({p} + {z2} / (2 * {n}))", f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})))"
    return f"greatest(0, ({mid} - {spread}) / (1 + {z2} / {n}))", f"least(1, ({mid} + {spread}) / (1 + {z2} / {n}))"


def rated(name: str, k: str, n: str) -> str:
    low, high = wilson_sql(k, n)
    return f"{k} / nullif({n}, 0) AS {name}_rate, CASE WHEN {n} > 0 THEN round_even({low}, 4) END AS {name}_low, CASE WHEN {n} > 0 THEN round_even({high}, 4) END AS {name}_high"


@query(f"""WITH {A}, s AS (SELECT route, grouping(route)::INTEGER AS overall, count(*) AS answers, count(*) FILTER (split_part(reason, ':', 1) IN ('json_parse_error', 'not_a_list', 'missing_name_field')) AS schema_fail, count(*) FILTER (reason <> 'ok') AS rejected,
sum(items)::BIGINT AS items, sum(out_lenient)::BIGINT AS out_lenient, sum(out_strict)::BIGINT AS out_strict, count(*) FILTER (out_lenient > 0) AS answers_out, count(*) FILTER (items > 0) AS parsed,
round_even(avg(items) FILTER (items > 0), 2) AS mean_items, (min(items) FILTER (items > 0))::INTEGER AS min_items, (max(items) FILTER (items > 0))::INTEGER AS max_items, count(*) FILTER (items > 0 AND items NOT BETWEEN 3 AND 5) AS outside_3_5 FROM a GROUP BY GROUPING SETS ((), (route)))
SELECT *, {rated('schema_fail', 'schema_fail', 'answers')}, {rated('rejected', 'rejected', 'answers')}, {rated('out_lenient', 'out_lenient', 'items')}, {rated('answers_out', 'answers_out', 'parsed')} FROM s""")
def scorecard_grouping_sets(spark, d):
    return ev.scorecard(judged(spark, d))


@query(f"""WITH {A}, r AS (SELECT lower(left(cands[1], 1)) AS input, round(len(list_filter(nn, lambda x: NOT contains(x, lower(left(cands[1], 1))))) / len(named), 3) AS rate FROM a WHERE len(named) > 0 AND len(cands) > 0)
SELECT input, count(DISTINCT rate) AS outcomes, count(*) AS n FROM r GROUP BY input HAVING count(DISTINCT rate) > 1""")
def divergent_candidates(spark, d):
    """Candidate lists, here of one letter, under which the share of items from elsewhere differs from answer to answer."""
    rows = answers(spark, d).where(F.size("cands") > 0).withColumn("cands", F.array(F.lower(F.substring(F.element_at("cands", 1), 1, 1))))
    judged_by_list = ev.per_answer(rows.withColumn("input", F.array_join("cands", ",")), F.col("answer"), F.col("cands"), ["conv_id", "turn", "input"])
    return ev.divergent(judged_by_list.where("items > 0"), F.col("input"), F.round(F.col("out_lenient") / F.col("items"), 3))


LABELLED = "l AS (SELECT lang, sum(quality)::BIGINT AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


def labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


LO, HI = wilson_sql("k", "n")


@query(f"WITH {LABELLED} SELECT lang, k, n, round({LO}, 4) AS low, round({HI}, 4) AS high FROM l")
def wilson_ci(spark, d):
    rows = labelled(spark, d).groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "k", "n", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


COUNTS = "c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, (SELECT count(*) FROM documents) - count(*) AS dropped FROM labels)"
M_LO, M_HI = wilson_sql("fn", "(fn + tn)")


@query(f"WITH {COUNTS} SELECT round(tp::DOUBLE / (tp + fp), 4) AS precision, round(fn::DOUBLE / (fn + tn) * dropped, 4) AS missed, round(tp / (tp + fn::DOUBLE / (fn + tn) * dropped), 4) AS recall, round(tp / (tp + {M_HI} * dropped), 4) AS recall_low, round(tp / (tp + {M_LO} * dropped), 4) AS recall_high FROM c")
def precision_recall(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("all_docs"))
    is_ = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    c = table(spark, d, "labels").agg(is_(1, 0).alias("tp"), is_(0, 0).alias("fp"), is_(1, 1).alias("fn"), is_(0, 1).alias("tn"), F.count("*").alias("n")).crossJoin(F.broadcast(n))
    pr = st.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), F.col("all_docs") - F.col("n"))
    return c.select(*[F.round(pr[k], 4).alias(k) for k in ("precision", "missed", "recall", "recall_low", "recall_high")])


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'kept' ELSE 'dropped' END AS kind FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200)")
def kept_dropped_split(spark, d):
    return ev.kept_and_dropped(head_documents(spark, d), kept_documents(spark, d), "doc_id")


def head_documents(spark, d):
    """The 200 longest documents, as a filter by score alone would choose."""
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200).select("doc_id")


def kept_documents(spark, d):
    return table(spark, d, "labels").where("toxic = 0").select("doc_id")


@query("""WITH head AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200), kept AS (SELECT doc_id FROM labels WHERE toxic = 0),
lab AS (SELECT doc_id, 'kept' AS kind, CASE WHEN quality = 1 THEN TRUE ELSE FALSE END AS label FROM labels UNION ALL SELECT doc_id, 'dropped', source < 'src2' FROM documents WHERE lang <> 'fr'),
s AS (SELECT h.doc_id, CASE WHEN h.doc_id IN (SELECT doc_id FROM kept) THEN 'kept' ELSE 'dropped' END AS kind FROM head h),
m AS (SELECT s.doc_id, s.kind, label FROM s LEFT JOIN lab ON lab.doc_id = s.doc_id AND lab.kind = s.kind),
g AS (SELECT count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (kind = 'kept') AS kept_size, count(label) FILTER (kind = 'kept') AS kept_labelled, count(*) FILTER (kind = 'kept' AND label) AS kept_yes,
count(DISTINCT doc_id) FILTER (kind = 'dropped') AS dropped_size, count(label) FILTER (kind = 'dropped') AS dropped_labelled, count(*) FILTER (kind = 'dropped' AND label) AS dropped_yes FROM m)
SELECT *, (kept_size * kept_yes / nullif(kept_labelled, 0) + dropped_size * dropped_yes / nullif(dropped_labelled, 0)) / n AS baseline FROM g""")
def stratified_baseline(spark, d):
    """What share of the head is right, from labels of its kept part and a labelled sample of its dropped part."""
    labels = table(spark, d, "labels").select("doc_id", F.lit("kept").alias("kind"), (F.col("quality") == 1).alias("label"))
    sample = table(spark, d, "documents").where("lang <> 'fr'").select("doc_id", F.lit("dropped").alias("kind"), (F.col("source") < "src2").alias("label"))
    return ev.stratified_baseline(head_documents(spark, d), kept_documents(spark, d), labels.union(sample), "doc_id")


@query("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, len(list(value)) AS n FROM events GROUP BY event_type)
SELECT event_type, v[greatest(1, ceil(0.95::DOUBLE * n))::INTEGER] AS nearest_rank, v[round_even(0.95::DOUBLE * (n - 1), 0)::INTEGER + 1] AS rounded_index, v[n // 2 + 1] AS upper_median, v[greatest(1, floor(0.95::DOUBLE * n))::INTEGER] AS low_index FROM s""")
def latency_percentiles(spark, d):
    n = F.col("n")
    places = {"nearest_rank": st.nearest_rank(n, 0.95), "rounded_index": st.rounded_index(n, 0.95), "upper_median": st.upper_median(n), "low_index": st.low_index(n, 0.95)}
    return cp.order_statistics(table(spark, d, "events"), ["event_type"], "value", places).drop("n")


@query("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, len(list(value)) AS n FROM events GROUP BY event_type)
SELECT event_type, (v[(n + 1) // 2] + v[n // 2 + 1]) / 2 AS p50, v[greatest(1, floor(0.95::DOUBLE * n))::INTEGER] AS p95, v[n] AS max FROM s""")
def tool_latency(spark, d):
    return ev.tool_latency(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, len(list(value)) AS n FROM events GROUP BY event_type)
SELECT event_id, e.event_type, value FROM events e JOIN s ON s.event_type = e.event_type WHERE value > 3 * v[greatest(1, ceil(0.5::DOUBLE * n))::INTEGER]""")
def latency_outliers(spark, d):
    return ev.outliers(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


@query("""WITH t AS (SELECT event_id // 3 AS qid, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS attempt, event_type NOT IN ('error', 'view') AS ok, event_type AS reason FROM events),
f AS (SELECT qid, min(attempt) FILTER (ok) AS good, count(*) AS n, arg_max(reason, attempt) AS reason FROM t GROUP BY qid)
SELECT qid, good IS NOT NULL AS ok, coalesce(good, n) AS attempts, CASE WHEN good IS NULL THEN reason END AS dead_reason FROM f""")
def retry_first_ok(spark, d):
    return ev.first_ok(attempts(spark, d)).select("qid", "ok", "attempts", "dead_reason")


def attempts(spark, d):
    """Three events in a row are a question's attempts."""
    from pyspark.sql import Window as W

    qid = F.floor(F.col("event_id") / 3)
    n = F.row_number().over(W.partitionBy(qid).orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").select(qid.alias("qid"), n.alias("attempt"), (~F.col("event_type").isin("error", "view")).alias("ok"), F.col("event_type").alias("reason"), F.col("props").alias("answer"), "value")


SERVED = """t AS (SELECT event_id // 3 AS qid, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS attempt, event_type NOT IN ('error', 'view') AS ok, event_type AS reason, value FROM events),
f AS (SELECT qid, min(attempt) FILTER (ok) AS good, count(*) AS n, arg_max(reason, attempt) AS reason, round(sum(value), 6) AS total_s FROM t GROUP BY qid),
g AS (SELECT qid, CASE qid % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'model' ELSE 'both' END AS arm, good IS NOT NULL AS ok, coalesce(good, n) AS attempts, CASE WHEN good IS NULL THEN reason || ':late' END AS reason, total_s, qid % 4 > 0 AS route_menu,
  CASE qid % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['tags'] WHEN 2 THEN ['tags', 'season'] ELSE ['category'] END AS given, CASE qid % 7 WHEN 0 THEN ['category', 'tags'] WHEN 1 THEN ['category'] ELSE []::VARCHAR[] END AS relaxed FROM f)"""


def served(spark, d):
    """A question for three events, its conditions, and those that were dropped, by its number."""
    rows = attempts(spark, d).groupBy("qid").agg(F.sum("value").alias("total_s")).join(ev.first_ok(attempts(spark, d)), "qid")
    n, words = F.col("qid"), lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    given = F.when(n % 5 == 0, words()).when(n % 5 == 1, words("tags")).when(n % 5 == 2, words("tags", "season")).otherwise(words("category"))
    relaxed = F.when(n % 7 == 0, words("category", "tags")).when(n % 7 == 1, words("category")).otherwise(words())
    arm = F.when(F.col("qid") % 3 == 0, "rule").when(F.col("qid") % 3 == 1, "model").otherwise("both")
    return rows.select("qid", arm.alias("arm"), "ok", "attempts", F.concat("dead_reason", F.lit(":late")).alias("reason"), "total_s", (n % 4 > 0).alias("route_menu"), given.alias("given"), relaxed.alias("relaxed"))


@query(f"""WITH {SERVED}, u AS (SELECT *, route_menu AND len([x FOR x IN given IF NOT list_contains(relaxed, x)]) = 0 AS free FROM g),
s AS (SELECT arm, list(total_s ORDER BY total_s) AS v, count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (ok AND attempts = 1) AS first_try, count(*) FILTER (ok AND attempts > 1) AS recovered, round_even(avg(attempts), 3) AS attempts_mean,
count(*) FILTER (free) AS unconditioned, count(*) FILTER (free AND ok) AS unconditioned_ok, count(*) FILTER (len(relaxed) > 0) AS relaxed_any FROM u GROUP BY arm)
SELECT arm, n, ok, first_try, recovered, attempts_mean, unconditioned, unconditioned_ok, relaxed_any, round_even(ok / n, 3) AS ok_rate, round_even(unconditioned / n, 3) AS unconditioned_rate,
round(v[round_even(0.5::DOUBLE * (n - 1), 0)::INTEGER + 1], 6) AS p50, round(v[round_even(0.95::DOUBLE * (n - 1), 0)::INTEGER + 1], 6) AS p95 FROM s""")
def service_summary(spark, d):
    return ev.service_summary(served(spark, d).withColumn("total_s", F.round("total_s", 6)))


@query(f"WITH {SERVED} SELECT arm, split_part(reason, ':', 1) AS reason, count(*) AS n FROM g WHERE NOT ok GROUP BY ALL")
def fail_reasons(spark, d):
    return ev.fail_reasons(served(spark, d))


#: Conditions that were found and those that are right, by the parity of ids; a call fails for every 13th conversation.
CONDITIONS = """k AS (SELECT conv_id, turn, conv_id % 13 = 0 AS failed, CASE WHEN turn % 2 = 0 THEN 'rule' ELSE 'model' END AS src, length(text) % 2 = 0 AS p_use, turn % 4 < 2 AS l_use,
  CASE conv_id % 3 WHEN 0 THEN ['a', role] WHEN 1 THEN [role] ELSE []::VARCHAR[] END AS p_tags, CASE length(text) % 3 WHEN 0 THEN ['user', 'b'] WHEN 1 THEN ['a'] ELSE []::VARCHAR[] END AS l_tags,
  CASE conv_id % 4 WHEN 1 THEN 's' WHEN 3 THEN NULL ELSE 't' END AS p_season, CASE turn % 3 WHEN 0 THEN ['s', NULL] ELSE ['t'] END AS l_season, role AS p_category, ['user', 'system'] AS l_category FROM conversations),
z AS (SELECT *, p_use = l_use AS c_use, CASE WHEN len(l_tags) > 0 THEN list_has_any(p_tags, l_tags) ELSE len(p_tags) = 0 END AS c_tags, CASE WHEN p_season IS NULL THEN len(list_filter(l_season, lambda x: x IS NULL)) > 0 ELSE coalesce(list_contains(l_season, p_season), FALSE) END AS c_season, list_contains(l_category, p_category) AS c_category FROM k)"""


def conditions(spark, d):
    words = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]).cast("array<string>")
    c, t, size = F.col("conv_id"), F.col("turn"), F.length("text")
    none = F.lit(None).cast("string")
    pred = {"use_ingredient": size % 2 == 0, "tags": F.when(c % 3 == 0, words("a", F.col("role"))).when(c % 3 == 1, words(F.col("role"))).otherwise(words()), "season": F.when(c % 4 == 1, "s").when(c % 4 == 3, none).otherwise("t"), "category": F.col("role")}
    label = {"use_ingredient": t % 4 < 2, "tags_ok": F.when(size % 3 == 0, words("user", "b")).when(size % 3 == 1, words("a")).otherwise(words()), "season_ok": F.when(t % 3 == 0, words("s", none)).otherwise(words("t")), "category_ok": words("user", "system")}
    return table(spark, d, "conversations"), ev.condition_score(pred, label)


@query(f"WITH {CONDITIONS} SELECT conv_id, turn, c_use AS r_route, c_tags AS r_tags, c_season AS r_season, c_category AS r_category, c_use AND c_tags AND c_season AND c_category AS r_all FROM z")
def condition_scores(spark, d):
    rows, s = conditions(spark, d)
    return rows.select("conv_id", "turn", s["use_ingredient"].alias("r_route"), s["tags"].alias("r_tags"), s["season"].alias("r_season"), s["category"].alias("r_category"), s["all"].alias("r_all"))


_fields = {"use_ingredient": "c_use", "tags": "c_tags", "season": "c_season", "category": "c_category", "all": "c_use AND c_tags AND c_season AND c_category"}


@query(f"""WITH {CONDITIONS}, s AS (SELECT src, count(*) FILTER (NOT failed) AS n, count(*) FILTER (failed) AS failed_calls, {', '.join(f'count(*) FILTER (NOT failed AND {c}) AS "{f}"' for f, c in _fields.items())} FROM z GROUP BY src)
SELECT *, {', '.join(f'round_even("{f}" / nullif(n, 0), 3) AS {f}_rate' for f in _fields)} FROM s""")
def condition_accuracy(spark, d):
    rows, s = conditions(spark, d)
    called = F.col("conv_id") % 13 != 0
    return ev.condition_accuracy(rows.select(F.when(F.col("turn") % 2 == 0, "rule").otherwise("model").alias("src"), *[F.when(called, v).alias(k) for k, v in s.items()]))


@query("SELECT md5(text) AS input, count(DISTINCT source) AS outcomes, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def divergent_groups(spark, d):
    return ev.divergent(table(spark, d, "documents"), F.md5(F.col("text").cast("binary")), F.col("source"))


RUNS = """a AS (SELECT c_custkey AS id, [c_mktsegment, c_name, c_mktsegment] AS x FROM customer WHERE c_acctbal > 0),
b AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 9 THEN [c_mktsegment, c_name, c_mktsegment] WHEN c_nationkey < 18 THEN [c_name, c_mktsegment] ELSE ['new', c_name] END AS y FROM customer WHERE c_mktsegment <> 'MACHINERY'),
j AS (SELECT a.id AS ai, b.id AS bi, x, y, x = y AS ex, list_sort(list_distinct(x)) = list_sort(list_distinct(y)) AS se FROM a FULL JOIN b ON a.id = b.id)"""


def runs(spark, d):
    """Customers in credit, and those of all segments but one, with lists that agree, differ in order, or differ by nation."""
    c = table(spark, d, "customer")
    same = F.array("c_mktsegment", "c_name", "c_mktsegment")
    other = F.when(F.col("c_nationkey") < 9, same).when(F.col("c_nationkey") < 18, F.array("c_name", "c_mktsegment")).otherwise(F.array(F.lit("new"), "c_name"))
    return c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), same.alias("keywords")), c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), other.alias("keywords"))


COMPARED = f"""WITH {RUNS}
SELECT count(*) FILTER (bi IS NULL) AS only_a, count(*) FILTER (ai IS NULL) AS only_b, count(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL) AS common, count(*) FILTER (ex) AS exact, count(*) FILTER (se) AS set_equal, count(*) FILTER (se AND NOT ex) AS order_only, count(*) FILTER (NOT se) AS content_diff FROM j"""


@query(COMPARED)
def run_compare(spark, d):
    return cp.compare_runs(*runs(spark, d))


@query(COMPARED)
def run_compare_by_summaries(spark, d):
    return rc.compare_by_summaries(*runs(spark, d))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_totalprice >= 2000),
b AS (SELECT o_orderkey AS id, o_orderstatus AS s, CASE WHEN o_totalprice > 480000 THEN 'late' ELSE o_orderpriority END AS p FROM orders WHERE o_totalprice < 495000)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.s <> b.s OR a.p <> b.p""")
def orders_changed_between_runs(spark, d):
    """Two runs over all orders that differ in the cheapest and the dearest, found from their summaries."""
    o = table(spark, d, "orders")
    run = lambda rows, p: rows.select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", p).alias("keywords"))
    later = F.when(F.col("o_totalprice") > 480000, F.lit("late")).otherwise(F.col("o_orderpriority"))
    return rc.differing(run(o.where("o_totalprice >= 2000"), F.col("o_orderpriority")), run(o.where("o_totalprice < 495000"), later))


@query(f"WITH {RUNS} SELECT ai AS id, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), '|') AS only_in_a, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), '|') AS only_in_b, se AS order_only FROM j WHERE NOT ex ORDER BY ai LIMIT 10")
def run_diffs(spark, d):
    return cp.run_diffs(*runs(spark, d)).select("id", F.array_join("only_in_a", "|").alias("only_in_a"), F.array_join("only_in_b", "|").alias("only_in_b"), "order_only")


@query(f"WITH {RUNS} (SELECT 'a' AS side, ai AS id FROM j WHERE bi IS NULL ORDER BY ai LIMIT 5) UNION ALL (SELECT 'b', bi FROM j WHERE ai IS NULL ORDER BY bi LIMIT 5)")
def run_one_sided(spark, d):
    return cp.one_sided(*runs(spark, d))


@query("SELECT count(DISTINCT id) AS n FROM (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def injected_ids(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return cp.injected([a, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))], "id")


@query("SELECT c_nationkey, left(sha256(string_agg(c_custkey::VARCHAR || c_name || chr(31) || c_mktsegment || chr(30), '' ORDER BY c_custkey::VARCHAR)), 16) AS digest FROM customer GROUP BY c_nationkey")
def content_digest(spark, d):
    rows = table(spark, d, "customer").withColumn("words", F.array("c_name", "c_mktsegment"))
    return cp.content_digest(rows, "c_custkey", "words", ["c_nationkey"])


@query("""WITH m AS (SELECT l.event_id, min((r.ts, r.event_id)) AS hit FROM events l LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = l.user_id AND r.ts >= l.ts WHERE l.event_type = 'signup' GROUP BY l.event_id)
SELECT event_id, hit[1] AS match_time, hit[2] AS match_value FROM m""")
def asof_forward(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("at"))
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("hit"))
    return cp.asof_forward(left, right, "at", "ts", "hit", ["user_id"]).select("event_id", "match_time", "match_value")


@query(f"WITH {A} SELECT conv_id, turn, CASE WHEN answer IS NULL OR NOT json_valid(answer) THEN '[FORMAT ERROR]' WHEN json_type(answer) = 'OBJECT' THEN json_extract_string(answer, '$.name') ELSE json_extract_string(answer, '$[0].name') END AS first_name FROM a")
def format_error_rows(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.get(gr.answer_items(F.col("answer")), F.lit(0))["name"].alias("first_name"))


@query("""WITH r AS (SELECT conv_id, turn, CASE length(text) % 9 WHEN 0 THEN 'y' WHEN 1 THEN 'YES ' WHEN 2 THEN '1' WHEN 3 THEN '예' WHEN 4 THEN ' n' WHEN 5 THEN '0' WHEN 6 THEN '아니오' WHEN 7 THEN '' ELSE role END AS raw FROM conversations)
SELECT conv_id, turn, CASE WHEN lower(trim(raw)) IN ('y', 'yes', '1', 'o', '예') THEN TRUE WHEN lower(trim(raw)) IN ('n', 'no', '0', 'x', '아니오') THEN FALSE END AS label FROM r""")
def label_decoding(spark, d):
    size = F.length("text") % 9
    raw = F.coalesce(*[F.when(size == i, x) for i, x in enumerate(("y", "YES ", "1", "예", " n", "0", "아니오", ""))], F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.decode_label(raw).alias("label"))


#: Questions: words that the rules know, each where the text has a certain letter pair.
ASKS = (("달콤하고", "th"), ("예쁜", "on"), ("SNS", "er"), ("핫한", "le"), ("비주얼", "re"), ("재료", "ti"), ("계절", "en"), ("신메뉴", "sh"), ("카페", "qu"))
ASKED_SQL = "q AS (SELECT conv_id, turn, concat_ws(' ', " + ", ".join(f"CASE WHEN contains(text, '{p}') THEN '{w}' END" for w, p in ASKS) + ") AS q FROM conversations)"
PARSED_SQL = """p AS (SELECT conv_id, turn, contains(q, '재료') AS use_ingredient, list_filter([CASE WHEN contains(q, '달콤') THEN '단맛' END, CASE WHEN contains(q, '비주얼') OR contains(q, '예쁜') THEN '비주얼' END, CASE WHEN contains(q, 'SNS') OR contains(q, '핫한') THEN '트렌디' END], lambda x: x IS NOT NULL) AS tags,
  CASE WHEN contains(q, '계절') THEN '봄' END AS season, CASE WHEN contains(q, '신메뉴') OR contains(q, '카페') THEN '디저트' END AS category FROM q)"""


def parsed(spark, d):
    q = F.concat_ws(" ", *[F.when(F.contains("text", F.lit(p)), F.lit(w)) for w, p in ASKS])
    p = rt.parse_question(q)
    return table(spark, d, "conversations").select("conv_id", "turn", *[v.alias(k) for k, v in p.items()])


@query(f"WITH {ASKED_SQL}, {PARSED_SQL} SELECT conv_id, turn, use_ingredient, array_to_string(tags, ',') AS tags, season, category FROM p")
def question_rules(spark, d):
    return parsed(spark, d).withColumn("tags", F.array_join("tags", ","))


VOCAB = {"tags": ["단맛", "트렌디"], "season": ["여름"], "category": ["디저트"]}


def vocab():
    return {k: F.array(*[F.lit(x) for x in v]) for k, v in VOCAB.items()}


@query(f"""WITH {ASKED_SQL}, {PARSED_SQL} SELECT conv_id, turn, array_to_string(list_filter(tags, lambda t: t IN ('단맛', '트렌디')), ',') AS tags, CASE WHEN season IN ('여름') THEN season END AS season, CASE WHEN category IN ('디저트') THEN category END AS category,
concat_ws(',', nullif(array_to_string(list_filter(tags, lambda t: t NOT IN ('단맛', '트렌디')), ','), ''), CASE WHEN season NOT IN ('여름') THEN season END, CASE WHEN category NOT IN ('디저트') THEN category END) AS unknown,
len(tags) <= 1 AND len(list_filter(tags, lambda t: t NOT IN ('단맛', '트렌디'))) = 0 AND (season IS NULL OR season IN ('여름')) AND (category IS NULL OR category IN ('디저트')) AS valid FROM p""")
def vocabulary_binding(spark, d):
    p = parsed(spark, d)
    own = [F.col(c) for c in ("tags", "season", "category")]
    b = rt.bind_vocabulary(*own, vocab())
    return p.select("conv_id", "turn", F.array_join(b["tags"], ",").alias("tags"), b["season"].alias("season"), b["category"].alias("category"), F.array_join(b["unknown"], ",").alias("unknown"), rt.valid_conditions(*own, vocab(), 1).alias("valid"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return ev.seeded_sample(table(spark, d, "documents"), "doc_id", 100).select("doc_id")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def ordered_distinct_pairs(spark, d):
    return ev.distinct_pairs(table(spark, d, "documents"), ["source", "lang"], "doc_id")
