"""Balancing, acceptance gates, reports and audits of evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The normal quantile of a 95 % interval, and the gate's least reviews and least lower bound.
Z = 1.959963984540054
LEAST_REVIEWED = 40
LEAST_BOUND = 0.80
#: Hexadecimal digits of a key by which balancing counts rows.
BUCKET_DIGITS = 3


def wilson_lower(k: Column, n: Column) -> Column:
    """Lower end of the Wilson interval; 0 without trials, an error where k is outside 0..n."""
    p, z2 = k / n, Z * Z
    bound = (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    outside = F.raise_error(F.concat(k.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" is not a share"))).cast("double")
    return F.when(n <= 0, 0.0).when((k >= 0) & (k <= n), F.greatest(F.lit(0.0), bound)).when(k.isNotNull() & n.isNotNull(), outside)


def passes_gate(k: Column, n: Column) -> Column:
    return (n >= LEAST_REVIEWED) & (wilson_lower(k, n) >= LEAST_BOUND)


def least_to_pass(sizes: DataFrame) -> DataFrame:
    """n and the fewest plausible answers that pass the gate there, null if none does."""
    tried = sizes.select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    return tried.groupBy("n").agg(F.min(F.when(passes_gate(F.col("k"), F.col("n")), F.col("k"))).alias("least"))


def balanced(rows: DataFrame, types: DataFrame, id_col: str, type_col: str, seed: int) -> DataFrame:
    """Rows down-sampled, in each group of types, to the smallest present type.

    ``types`` has type and grp. Which rows stay is by the md5 of seed, type and id, so it is the
    same on any engine. The stratum is the type alone. A type without a group is an error, a null one is dropped.

    Rows are counted by the leading digits of their key; whole buckets below a type's cut stay, and only rows
    of the one bucket in which it falls are put in order, so no task ranks all rows of a type.
    """
    counts = rows.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("n")).join(types, "type")
    floor = counts.withColumn("floor", F.min("n").over(Window.partitionBy("grp"))).select(F.col("type").alias(type_col), "floor")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(type_col), F.col(id_col).cast("string")).cast("binary"))
    keyed = rows.filter(F.col(type_col).isNotNull()).withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    counted = keyed.groupBy(type_col, "_bucket").agg(F.count("*").alias("_n")).join(floor, type_col, "left")
    known = F.when(F.col("floor").isNull(), F.raise_error(F.concat(F.lit("no group has the type "), F.col(type_col))).cast("long")).otherwise(F.col("floor"))
    before = F.sum("_n").over(Window.partitionBy(type_col).orderBy("_bucket")) - F.col("_n")
    buckets = counted.withColumn("_left", known - before).filter("_left > 0").select(type_col, "_bucket", "_left", (F.col("_n") <= F.col("_left")).alias("_whole"))
    chosen = keyed.join(buckets, [type_col, "_bucket"])
    cut = chosen.filter(~F.col("_whole")).withColumn("_r", F.row_number().over(Window.partitionBy(type_col).orderBy("_key", id_col))).filter("_r <= _left").drop("_r")
    return chosen.filter("_whole").unionByName(cut).select(*rows.columns)


def with_status(rows: DataFrame, status: str) -> DataFrame:
    """Rows of one status; an unknown one is an error."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return rows.filter(F.col("status") == status)


def unknown_types(rows: DataFrame, types: DataFrame, type_col: str) -> DataFrame:
    """Types of rows that no group has; balancing should be refused while there are any."""
    return rows.select(F.col(type_col).alias("type")).distinct().join(types, "type", "left_anti")


def balance_summary(rows: DataFrame, kept: DataFrame, types: DataFrame, type_col: str) -> DataFrame:
    """Each type's group and its rows before and after, zero for a missing type."""
    before = rows.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("before"))
    after = kept.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("after"))
    return types.join(before, "type", "left").join(after, "type", "left").select("grp", "type", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def exclusion_report(answers: DataFrame) -> DataFrame:
    """Answers by model version: total, unparsed, unanswerable, and the rate of the unparsed (0 without answers)."""
    total, failed = F.count("*"), F.count("parse_error")
    return answers.groupBy("model_version").agg(total.alias("total"), failed.alias("parse_failures"), F.count_if(F.col("answerable") == F.lit(False)).alias("unanswerable"), F.round(F.when(total > 0, failed / total).otherwise(0.0), 6).alias("excluded_rate"))


# --- audits: SQL checks pass on unknown, so a row violates only where one is false -----------

CONSTRUCTED = "construction"
STATUSES = ("labelled", "discarded", "needs_human_review")


def variant_constraints(accept: tuple, reject: tuple) -> dict[str, Column]:
    """The named conditions of a variant row."""
    c = F.col
    return {
        "ck_variant_type": c("variant_type").isin(*accept, *reject),
        "ck_label_source": c("label_source").isin(CONSTRUCTED, "human"),
        "ck_status": c("status").isin(*STATUSES),
        "ck_constructed_label_matches_type": (c("label_source") != CONSTRUCTED) | c("is_correct").isNull() | (c("is_correct") == c("variant_type").isin(*accept)),
        "ck_review_has_no_label": (c("status") != "needs_human_review") | c("is_correct").isNull(),
        "ck_discard_reason": (c("status") == "discarded") == c("discard_reason").isNotNull(),
        "ck_text_iff_kept": (c("status") == "discarded") == c("text").isNull(),
        "ck_labelled": (c("status") != "labelled") | c("is_correct").isNotNull(),
    }


def violations(rows: DataFrame, constraints: dict[str, Column], id_col: str) -> DataFrame:
    """A row for each broken constraint of each row: id and constraint. One pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in constraints.items()]))
    return rows.select(id_col, F.explode(broken).alias("constraint"))


ATTRIBUTION = ("provider", "model_requested", "model_reported", "model_version")


def attribution_gaps(calls: DataFrame, prompts: DataFrame, id_col: str) -> DataFrame:
    """Calls without full attribution, without a digest in the version, or with an unknown prompt: id and problem."""
    blank = {f"missing_{name}": F.coalesce(F.trim(name), F.lit("")) == "" for name in ATTRIBUTION}
    digest = ~F.coalesce(F.col("model_version"), F.lit("")).rlike(r"@(sha256:)?[0-9a-f]{64}$")
    known = calls.join(prompts.select(F.col("sha256").alias("prompt_sha256"), F.lit(True).alias("_known")), "prompt_sha256", "left")
    problems = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in blank.items()], F.when(digest, F.lit("version_without_digest")), F.when(F.col("_known").isNull(), F.lit("unknown_prompt"))))
    return known.select(id_col, F.explode(problems).alias("problem"))


def span_constraints() -> dict[str, Column]:
    return {"ck_span_start": F.col("char_start") >= 0, "ck_span_end": F.col("char_end") > F.col("char_start")}


def prompt_lock_audit(prompts: DataFrame, lock: DataFrame) -> DataFrame:
    """Prompts whose digest differs from the lock, is missing there, or is locked but gone: name and problem."""
    now = prompts.select("name", F.sha2(F.concat_ws("\x00", "system", "user").cast("binary"), 256).alias("sha256"))
    joined = now.alias("p").join(lock.alias("l"), "name", "full_outer")
    problem = F.when(F.col("l.sha256").isNull(), "unlocked").when(F.col("p.sha256").isNull(), "missing").when(F.col("l.sha256") != F.col("p.sha256"), "changed")
    return joined.select("name", problem.alias("problem")).filter("problem is not null")
