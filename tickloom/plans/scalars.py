"""Queries of the scalar functions, each with SQL for whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query, table

TAIL = " 移动平均线 突 42.5 Risk-Parities companies /home/ann/x.txt 86-13812345678"
TOPICS = ("the ", "with and", "moving average line")
MASKED = ("the", "and")
WORDS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
TERMS_SQL = "flatten(list_transform(regexp_extract_all(lower(t), '[a-z][a-z0-9_+./-]*|[0-9]+(?:\\.[0-9]+)?|[\\x{3400}-\\x{9fff}]+'), lambda x: CASE WHEN regexp_matches(x, '^[\\x{3400}-\\x{9fff}]') AND length(x) > 1 THEN list_transform(range(1, length(x)), lambda i: x[i:i+1]) ELSE [x] END))"
NORMAL = r"' ' || regexp_replace(lower(t), '[ \t\n\r\f\x0b]+', ' ', 'g') || ' '"


def times(phrase: str) -> str:
    return f"CAST((length(n) - length(replace(n, '{phrase}', ''))) / {len(phrase)} AS INTEGER)"


@query(
    "text_scalars",
    f"""WITH r AS (SELECT conv_id, turn, text || '{TAIL}' AS t FROM conversations), m AS (SELECT *, {NORMAL} AS n FROM r)
    SELECT conv_id, turn, array_to_string({TERMS_SQL}, ' ') AS terms, round(len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) / (len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) + len(regexp_extract_all(t, '[A-Za-z]'))), 6) AS cjk_ratio,
    regexp_matches(t, '(?i)(^|[^A-Za-z0-9])risk\\-parities([^A-Za-z0-9]|$)') AS has_phrase, regexp_matches(lower(t), '(^|[^a-z0-9_])risk[ -]+parit(y|ies)([^a-z0-9_]|$)') AND regexp_matches(lower(t), '(^|[^a-z0-9_])compan(y|ies)([^a-z0-9_]|$)') AS has_term,
    length(n) < 120 OR (regexp_matches(n, '\\b(index|bibliography|references)\\b') AND length(n) < 2500) AS noise,
    nullif(CASE WHEN least({times("the ")}, 4) + 2 * least({times("with and")}, 4) + 3 * least({times("moving average line")}, 4) >= 3 THEN least({times("the ")}, 4) + 2 * least({times("with and")}, 4) + 3 * least({times("moving average line")}, 4) END, -1) AS topic,
    sha256(replace(replace(t, 'the', '——'), 'and', '——')) AS masked, 2 * CAST(contains(lower(t), 'the') AS INT) + 2 * CAST(contains(lower(t), 'und') AS INT) + 2 * CAST(contains(lower(t), '平均') AS INT) + CAST(contains(lower(t), '平') AS INT) + CAST(contains(lower(t), '均') AS INT) AS relevance,
    sha256(CASE WHEN length(t) <= 200 THEN t ELSE left(t, 200) || ' …' END) AS trimmed, left(sha256(regexp_replace(concat_ws('|', conv_id, role_, turn), '[^A-Za-z0-9_]+', '', 'g')), 24) AS case_id FROM (SELECT m.*, c.role AS role_ FROM m JOIN conversations c USING (conv_id, turn))""",
)
def text_scalars(spark, d):
    t = F.col("t")
    rows = table(spark, d, "conversations").withColumn("t", F.concat("text", F.lit(TAIL)))
    return rows.select(
        "conv_id", "turn", F.array_join(S.terms(t), " ").alias("terms"), F.round(S.cjk_ratio(t), 6).alias("cjk_ratio"), t.rlike(S.phrase_pattern("risk-parities")).alias("has_phrase"), (S.matches_term(t, "risk–parity") & S.matches_term(t, "company")).alias("has_term"),
        S.is_noise(t).alias("noise"), S.topic_score(t, TOPICS).alias("topic"), F.sha2(S.masked(t, MASKED), 256).alias("masked"), S.relevance("the und 平均", t).alias("relevance"), F.sha2(S.trimmed(t, 200), 256).alias("trimmed"), S.case_id(F.col("conv_id"), F.col("role"), F.col("turn")).alias("case_id"),
    )


@query(
    "redact_text",
    rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || '{TAIL}', '(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '(?i)\b(?:sk-[A-Za-z0-9_-]{{16,}}|(?:api[_-]?key|token|secret)\s*[:=]\s*[A-Za-z0-9._~+/-]{{12,}})', '[SECRET]', 'g'),
    '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}', '[EMAIL]', 'g'), '(^|[^0-9])(?:\+?86[-\s]?)?1[3-9][0-9]{{9}}($|[^0-9])', '\1[PHONE]\2', 'g'), '/home/[^/\s]+(?:/[^\s"''<>]*)?', '[LOCAL_PATH]', 'g') AS text FROM conversations""",
)
def redact_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.redact(F.concat("text", F.lit(TAIL))).alias("text"))


@query(
    "page_ranges",
    """WITH e AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT conv_id, turn, CAST(len(list_distinct(range(turn + 1, turn + 5) || [conv_id + 1])) AS INTEGER) AS n, least(turn + 1, conv_id + 1) AS first_page, greatest(turn + 4, conv_id + 1) AS last_page FROM e""",
)
def page_ranges(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    expression = F.concat_ws("", (F.col("turn") + 1).cast("string"), F.lit(" - "), (F.col("turn") + 4).cast("string"), F.lit(", p7, "), (F.col("conv_id") + 1).cast("string"), F.lit(", 9-3, 0, not_available"))
    found = S.pages(expression)
    return rows.select("conv_id", "turn", F.size(found).alias("n"), F.array_min(found).cast("long").alias("first_page"), F.array_max(found).cast("long").alias("last_page"))


@query(
    "fit_scalars",
    """WITH o AS (SELECT o_custkey, o_totalprice / 7 AS y, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS x FROM orders), c AS (SELECT *, x - avg(x) OVER (PARTITION BY o_custkey) AS d FROM o),
    s AS (SELECT o_custkey, count(*) AS n, sum(d * d) AS s2, sum(d * d * d) AS s3, sum(d * d * d * d) AS s4, sum(d * y) AS t1, sum(d * d * y) AS t2, sum(y) AS sy, max(y) AS hi, min(y) AS lo, avg(y) AS mean, arg_min(y, x) AS first, arg_max(y, x) AS last,
      regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept, regr_r2(y, x) AS r2, var_pop(y) AS v, regr_slope(ln(y), x) AS ls FROM c GROUP BY o_custkey)
    SELECT o_custkey, round(coalesce(slope, 0), 1) AS slope, round(coalesce(icept, mean), 1) AS intercept, round(CASE WHEN v = 0 THEN 1 ELSE coalesce(r2, 0) END, 5) AS r2, round(CASE WHEN n > 3 THEN (s2 * (t2 - s2 * sy / n) - s3 * t1) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) END, 1) AS a,
    (hi - lo) / greatest(abs(mean), 1e-12) <= 0.07 AS similar, round(power(last / first, 1.0 / n) - 1, 5) AS growth, round(last / first, 2) AS ratio, round(least(exp(least(ls, 1) * 2) - 1, 9), 4) AS annualised FROM s WHERE n > 1""",
)
def fit_scalars(spark, d):
    by = Window.partitionBy("o_custkey")
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 7).alias("y"), F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).cast("double").alias("x")).withColumn("mean_x", F.avg("x").over(by))
    priced = F.when(F.col("y").isNotNull(), F.col("x"))
    found = rows.groupBy("o_custkey").agg(*[c.alias(n) for n, c in (S.fit("y", "x") | {"a": S.quadratic("y", "x")["a"]}).items()], F.count(F.lit(1)).alias("n"), F.collect_list("y").alias("ys"), F.min_by("y", priced).alias("first"), F.max_by("y", priced).alias("last"), F.when(F.min("y") <= 0, float("nan")).otherwise(F.regr_slope(F.ln("y"), "x")).alias("ls"))
    # beyond what the functions answer, the SQL has what doubles give: infinity or NaN of a price of 0
    growth = F.coalesce(S.growth(F.col("first"), F.col("last"), F.col("n")), F.pow(F.coalesce(F.try_divide("last", "first"), F.col("last") * float("inf")), 1 / F.col("n")) - 1)
    ratio = F.coalesce(S.safe_ratio(F.col("last"), F.col("first")), F.col("last") * float("inf"))
    slope = F.when(F.size("ys") == 1, float("nan")).otherwise(F.col("slope"))
    out = found.where("n > 1").select("o_custkey", slope.alias("slope"), "intercept", "r2", F.when(F.col("n") > 3, F.col("a")).alias("a"), S.similar(F.col("ys")).alias("similar"), growth.alias("growth"), ratio.alias("ratio"), F.least(S.annualised(F.least("ls", F.lit(1.0)), 2), F.lit(9.0)).alias("annualised"))
    places = {"slope": 1, "intercept": 1, "a": 1, "r2": 5, "growth": 5, "annualised": 4}
    return out.withColumns({name: S.half_away(F.col(name), to) for name, to in places.items()})


@query(
    "label_scalars",
    """WITH v AS (SELECT c_custkey, c_acctbal * 2e7 AS cap, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 100) / 100 END AS s FROM customer)
    SELECT c_custkey, CASE WHEN cap > 0 THEN CASE WHEN cap >= 1e11 THEN 'very large' WHEN cap >= 3e10 THEN 'large' WHEN cap >= 1e10 THEN 'middle' ELSE 'small' END END AS size, CASE WHEN coalesce(s, 0.5) >= 0.82 THEN 'high' WHEN coalesce(s, 0.5) >= 0.67 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN s IS NULL THEN 'unknown' WHEN s < 0.15 THEN 'weak' WHEN s < 0.5 THEN 'moderate' ELSE 'strong' END AS fit, CASE WHEN 3 * s - 0.5 < 0 THEN 'against' WHEN 3 * s - 0.5 < 0.3 THEN 'loose' WHEN 3 * s - 0.5 < 0.7 THEN 'some' WHEN 3 * s - 0.5 <= 1.3 THEN 'in step' WHEN 3 * s - 0.5 <= 1.8 THEN 'stronger' ELSE 'much stronger' END AS beta_band,
    CASE WHEN s < 0.15 THEN 'small' WHEN s < 0.3 THEN 'medium' WHEN s < 0.5 THEN 'large' ELSE 'very large' END AS volatility_band, CASE WHEN 2 * s - 1 < -0.5 THEN 'falls' WHEN 2 * s - 1 > 0.5 THEN 'rises' ELSE 'even' END AS skew_band,
    CASE WHEN 5 * s > 3 THEN 'frequent' WHEN 5 * s > 1 THEN 'at times' ELSE 'normal' END AS kurtosis_band, CASE WHEN s >= 0.6 THEN 'above' WHEN s <= 0.4 THEN 'below' ELSE 'to and fro' END AS trend_band FROM v""",
)
def label_scalars(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 7 > 0, (k % 100) / 100)
    bands = S.plain_bands(3 * s - 0.5, s, 2 * s - 1, 5 * s, s)
    return table(spark, d, "customer").select("c_custkey", S.size_bucket(F.col("c_acctbal") * 2e7).alias("size"), S.confidence_label(s).alias("confidence"), S.fit_level(s).alias("fit"), *[c.alias(n) for n, c in bands.items()])


@query(
    "code_suggestions",
    """WITH q AS (SELECT n_nationkey AS query_id, lpad(CAST(n_nationkey * 37 AS VARCHAR), 6, '0') AS code FROM nation), p AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part),
    z AS (SELECT query_id, p_partkey, hamming(q.code, p.code) AS distance FROM q, p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE distance WHEN 0 THEN 2 ELSE 4 END, p_partkey) AS rank FROM z WHERE distance <= 1)
    SELECT query_id, p_partkey, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""",
)
def code_suggestions(spark, d):
    """Codes that differ in one place at most meet on the code with that place hidden."""
    code = lambda c: F.lpad(c.cast("string"), 6, "0")
    hidden = lambda: F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.overlay("code", F.lit("*"), i, F.lit(1)))).alias("mask")
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), code(F.col("n_nationkey") * 37).alias("code"))
    known = table(spark, d, "part").select("p_partkey", code(F.col("p_partkey")).alias("code"))
    met = asked.select("query_id", F.col("code").alias("asked"), hidden()).join(known.select("p_partkey", "code", hidden()), "mask").dropDuplicates(["query_id", "p_partkey"])
    near = met.select("query_id", "p_partkey", S.code_distance(F.col("asked"), F.col("code")).alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("distance") == 0, 2).otherwise(4), "p_partkey")
    return near.withColumn("rank", F.row_number().over(order)).where("rank <= 6")


CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower(X), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({WORDS})))"


@query(
    "evidence_overlap",
    f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS source FROM conversations), c AS (SELECT *, {CONTENT.replace("X", "text")} AS own, {CONTENT.replace("X", "source")} AS other FROM p WHERE source IS NOT NULL)
    SELECT conv_id, turn, text, round(coalesce(len(list_intersect(own, other)) / nullif(len(own), 0), 1), 5) AS overlap FROM c""",
)
def evidence_overlap(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, d, "conversations").withColumn("source", before).where("source is not null")
    return rows.select("conv_id", "turn", "text", F.round(S.overlap(F.col("text"), F.col("source")), 5).alias("overlap"))


@query(
    "trigger_weights",
    f"""WITH w AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), c AS (SELECT *, regexp_extract_all(t, '[a-z0-9+#.]+') AS ws FROM w), k AS (SELECT *, len(list_filter(ws, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in S.NON_CONTENT)}))) AS n FROM c)
    SELECT conv_id, turn, t, CASE WHEN coalesce(nullif(n, 0), len(ws)) <= 1 THEN 0.4 WHEN coalesce(nullif(n, 0), len(ws)) = 2 THEN 0.55 ELSE 1.0 END AS weight FROM k""",
)
def trigger_weights(spark, d):
    t = F.lower("text")
    return table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"), S.trigger_weight(t).alias("weight"))
