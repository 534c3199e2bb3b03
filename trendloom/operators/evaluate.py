"""Rates and scorecards over stored answers, attempts and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grounding import grounded, grounded_strict, names_of, skip_reason, validation
from ..functions.stats import low_index, lower_median, nearest_rank, rounded_index, upper_median, wilson_or_null
from .compare import order_statistics


def first_ok(attempts: DataFrame) -> DataFrame:
    """attempts(qid, attempt, ok, reason, ...) -> one row for each question: its first good attempt, else a dead letter."""
    done = attempts.groupBy("qid").agg(F.min_by(F.struct("attempt", "answer"), F.when(F.col("ok"), F.col("attempt"))).alias("good"), F.max_by("reason", "attempt").alias("reason"), F.count("*").alias("attempts"))
    return done.select("qid", F.col("good").isNotNull().alias("ok"), "good.answer", F.coalesce("good.attempt", "attempts").alias("attempts"), F.when(F.col("good").isNull(), F.col("reason")).alias("dead_reason"))


def reasons(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.groupBy(F.split(reason, ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def judged_items(rows: DataFrame, answer: Column, candidates: Column, keys: list[str]) -> DataFrame:
    """One row for each named item with its strict and lenient verdicts."""
    items = rows.where(skip_reason(answer, candidates) == "ok").select(*keys, candidates.alias("_c"), F.posexplode(names_of(answer)).alias("pos", "name"))
    return items.select(*keys, "pos", "name", grounded_strict(F.col("name"), F.col("_c")).alias("strict"), grounded(F.col("name"), F.col("_c")).alias("lenient"))


def share(k: Column, n: Column) -> Column:
    """k / n; null for n = 0."""
    return k / F.nullif(n, F.lit(0))


def item_rates(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(~F.col("lenient")).alias("out_lenient"), F.count_if(~F.col("strict")).alias("out_strict"))


def per_answer(rows: DataFrame, answer: Column, candidates: Column, keys: list[str]) -> DataFrame:
    """keys -> skip, reason, items, out_lenient, out_strict of each answer; keys must name an answer."""
    base = rows.select(*keys, skip_reason(answer, candidates).alias("skip"), F.split(validation(answer, candidates), ":")[0].alias("reason"), names_of(answer).alias("_names"), candidates.alias("_c"))
    out = lambda test: F.coalesce(F.size(F.filter("_named", lambda n: ~test(n, F.col("_c")))), F.lit(0))
    # An answer with an item that has no name counts as one without items.
    base = base.withColumn("_named", F.when(F.col("skip").isin("ok", "no_candidates"), F.col("_names")).otherwise(F.array().cast("array<string>")))
    return base.select(*keys, "skip", "reason", F.size("_named").alias("items"), out(grounded).alias("out_lenient"), out(grounded_strict).alias("out_strict"))


def grounding_summary(answers: DataFrame) -> DataFrame:
    """per_answer rows with a route -> overall and by route: answers counted and skipped, items, items out and answers with any, with their rates."""
    ok = F.col("skip") == "ok"
    n = lambda test: F.count_if(ok & test)
    some = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    out = answers.groupingSets([[], ["route"]], "route").agg(
        F.grouping("route").cast("int").alias("overall"), F.count_if(ok).alias("evaluated"), F.count_if(~ok).alias("skipped"), some("items").alias("items"),
        some("out_strict").alias("out_strict"), some("out_lenient").alias("out_lenient"), n(F.col("out_strict") > 0).alias("answers_strict"), n(F.col("out_lenient") > 0).alias("answers_lenient"),
    )
    rates = {f"{k}_rate": share(F.col(k), F.col(of)) for k, of in (("out_strict", "items"), ("out_lenient", "items"), ("answers_strict", "evaluated"), ("answers_lenient", "evaluated"))}
    return out.withColumns(rates)


def arm_scores(answers: DataFrame) -> DataFrame:
    """per_answer rows with route and arm -> answers, parse failures, items, items out, rates by route and arm."""
    parsed = F.col("skip").isin("ok", "no_candidates")
    some = lambda c: F.coalesce(F.sum(F.when(parsed, F.col(c))), F.lit(0))
    out = answers.groupBy("route", "arm").agg(F.count("*").alias("answers"), F.count_if(~parsed).alias("parse_fail"), some("items").alias("items"), some("out_lenient").alias("out_lenient"), some("out_strict").alias("out_strict"))
    return out.withColumns({"rate_lenient": share(F.col("out_lenient"), F.col("items")), "rate_strict": share(F.col("out_strict"), F.col("items"))})


#: The reasons for which an answer has not the form asked for.
SCHEMA_FAIL = ("json_parse_error", "not_a_list", "missing_name_field")


def scorecard(answers: DataFrame) -> DataFrame:
    """per_answer rows with a route -> overall and by route in one pass of grouping sets."""
    named = F.col("items") > 0
    out = answers.groupingSets([[], ["route"]], "route").agg(
        F.grouping("route").cast("int").alias("overall"), F.count("*").alias("answers"), F.count_if(F.col("reason").isin(*SCHEMA_FAIL)).alias("schema_fail"), F.count_if(F.col("reason") != "ok").alias("rejected"),
        F.sum("items").alias("items"), F.sum("out_lenient").alias("out_lenient"), F.sum("out_strict").alias("out_strict"), F.count_if(F.col("out_lenient") > 0).alias("answers_out"), F.count_if(named).alias("parsed"),
        F.bround(F.avg(F.when(named, F.col("items"))), 2).alias("mean_items"), F.min(F.when(named, F.col("items"))).alias("min_items"), F.max(F.when(named, F.col("items"))).alias("max_items"), F.count_if(named & ~F.col("items").between(3, 5)).alias("outside_3_5"),
    )
    for name, k, n in (("schema_fail", "schema_fail", "answers"), ("rejected", "rejected", "answers"), ("out_lenient", "out_lenient", "items"), ("answers_out", "answers_out", "parsed")):
        low, high = wilson_or_null(F.col(k), F.col(n))
        out = out.withColumns({f"{name}_rate": share(F.col(k), F.col(n)), f"{name}_low": low, f"{name}_high": high})
    return out


def condition_score(pred: dict[str, Column], label: dict[str, Column]) -> dict[str, Column]:
    """Route equal; tags overlap, or none where none are right; season and category among the right ones, null allowed where listed."""
    tags, ok = F.coalesce(pred["tags"], F.array().cast("array<string>")), label["tags_ok"]
    among = lambda x, xs: F.exists(xs, lambda v: v.eqNullSafe(x))
    out = {
        "use_ingredient": F.coalesce(pred["use_ingredient"], F.lit(False)) == label["use_ingredient"],
        "tags": F.when(F.size(ok) > 0, F.size(F.array_intersect(tags, ok)) > 0).otherwise(F.size(tags) == 0),
        "season": among(pred["season"], label["season_ok"]), "category": among(pred["category"], label["category_ok"]),
    }
    return {**out, "all": out["use_ingredient"] & out["tags"] & out["season"] & out["category"]}


def condition_accuracy(scored: DataFrame, by: str = "src", fields: tuple[str, ...] = ("use_ingredient", "tags", "season", "category", "all")) -> DataFrame:
    """scored(src, one boolean for each field, null where the call failed) -> answers scored, failed calls, right ones and their share by source."""
    got = F.col(fields[-1]).isNotNull()
    out = scored.groupBy(by).agg(F.count_if(got).alias("n"), F.count_if(~got).alias("failed_calls"), *[F.count_if(F.col(f)).alias(f) for f in fields])
    return out.withColumns({f"{f}_rate": F.bround(share(F.col(f), F.col("n")), 3) for f in fields})


def unconditioned(route_menu: Column, given: Column, relaxed: Column) -> Column:
    """A menu question all of whose conditions were dropped, or that has none."""
    return route_menu & (F.size(F.array_except(given, relaxed)) == 0)


def service_summary(rows: DataFrame, by: str = "arm") -> DataFrame:
    """rows(arm, ok, attempts, route_menu, given, relaxed, total_s) -> counts, rates and latencies by arm; the places of the percentiles are exact."""
    free = unconditioned(F.col("route_menu"), F.col("given"), F.col("relaxed"))
    out = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.count_if(F.col("ok") & (F.col("attempts") == 1)).alias("first_try"), F.count_if(F.col("ok") & (F.col("attempts") > 1)).alias("recovered"),
        F.bround(F.avg("attempts"), 3).alias("attempts_mean"), F.count_if(free).alias("unconditioned"), F.count_if(free & F.col("ok")).alias("unconditioned_ok"), F.count_if(F.size("relaxed") > 0).alias("relaxed_any"),
    )
    out = out.withColumns({"ok_rate": F.bround(share(F.col("ok"), F.col("n")), 3), "unconditioned_rate": F.bround(share(F.col("unconditioned"), F.col("n")), 3)})
    at = order_statistics(rows, [by], "total_s", {"p50": rounded_index(F.col("n"), 0.5), "p95": rounded_index(F.col("n"), 0.95)}).drop("n")
    return out.join(at, by, "left")


def fail_reasons(rows: DataFrame, by: str = "arm") -> DataFrame:
    """rows(arm, ok, reason) -> how often each reason, up to its colon, ended in failure."""
    return rows.where(~F.col("ok")).groupBy(by, F.split(F.coalesce("reason", F.lit("")), ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def kept_and_dropped(head: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """head + kind: whether its key is among the kept."""
    return head.join(kept.select(key).distinct(), key, "left_semi").withColumn("kind", F.lit("kept")).union(head.join(kept.select(key).distinct(), key, "left_anti").withColumn("kind", F.lit("dropped")))


def stratified_baseline(head: DataFrame, kept: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: the precision that the head would have, from the labelled share of its kept and its dropped part.

    head(key), kept(key), labels(key, kind, label boolean or null): each stratum's rate is that of its own labels.
    """
    strata = kept_and_dropped(head.select(key), kept, key).join(labels.select(key, "kind", "label"), [key, "kind"], "left")
    by = strata.groupBy("kind").agg(F.countDistinct(key).alias("size"), F.count("label").alias("labelled"), F.count_if("label").alias("yes"))
    part = lambda c, kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    out = by.agg(F.sum("size").alias("n"), *[part(c, k).alias(f"{k}_{c}") for k in ("kept", "dropped") for c in ("size", "labelled", "yes")])
    estimate = F.col("kept_size") * share(F.col("kept_yes"), F.col("kept_labelled")) + F.col("dropped_size") * share(F.col("dropped_yes"), F.col("dropped_labelled"))
    return out.withColumn("baseline", share(estimate, F.col("n")))


def outliers(rows: DataFrame, by: list[str], value: str, times: float = 3.0) -> DataFrame:
    """Rows whose value is over ``times`` the nearest-rank median of their group."""
    middle = order_statistics(rows, by, value, {"_p50": nearest_rank(F.col("n"), 0.5)}).select(*by, "_p50")
    return rows.join(middle, by).where(F.col(value) > times * F.col("_p50")).drop("_p50")


def tool_latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by -> median (the mean of the middle two), p95 by the low index, max."""
    n = F.col("n")
    at = order_statistics(rows, by, value, {"_a": lower_median(n), "_b": upper_median(n), "p95": low_index(n, 0.95), "max": n})
    return at.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("p50"), "p95", "max")


def stability(runs: DataFrame, loose: DataFrame) -> DataFrame:
    """runs(query, repeat, rank, keyword, score) and loose(keyword) -> by query: distinct sets and orders over the repeats, distinct scores, whether all are 0, and loose keywords among the first repeat's.

    A repeat is a top list, so its rows are few.
    """
    lists = runs.groupBy("query", "repeat").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda r: r["keyword"]).alias("l"))
    sets = lists.groupBy("query").agg(F.countDistinct(F.array_sort("l")).alias("distinct_sets"), F.countDistinct("l").alias("distinct_orders"), F.min("repeat").alias("repeat"))
    first = runs.join(sets.select("query", "repeat"), ["query", "repeat"]).join(loose.select("keyword", F.lit(True).alias("_loose")), "keyword", "left")
    first = first.groupBy("query").agg(F.countDistinct("score").alias("distinct_scores"), F.min(F.col("score") == 0).alias("all_scores_zero"), F.count_if("_loose").alias("orphans_in_top"))
    return sets.drop("repeat").join(first, "query")


def distinct_pairs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the least ``order`` of each, as they were first seen."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of key and seed, so that reruns agree."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def divergent(rows: DataFrame, key: Column, outcome: Column) -> DataFrame:
    """Groups of the same input with more than one outcome."""
    return rows.groupBy(key.alias("input")).agg(F.countDistinct(outcome).alias("outcomes"), F.count("*").alias("n")).where("outcomes > 1")
