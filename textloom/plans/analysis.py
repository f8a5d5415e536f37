"""Queries that compare systems and look into cases, with the same in SQL. Labels play judgments of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import cases, version
from textloom.functions import text as T
from textloom.operators import analysis, closeness, evaluation, judgments, leakage, percentiles, rules
from textloom.operators.storage import matching
from textloom.plans.retrieval import _ALL, _H, _M, METRICS, _dialect, _metrics, _quoted, dense_run, fused, grades, judged, judgments_of, lexical_run, table, universe

FLAGS, SCORES = ["task_success", "root_cause", "repair"], ["relevance", "faithfulness"]


def judge_aggregate(spark, sf):
    """Odd documents are one system's answers, even ones the other's."""
    d, q = F.col("doc_id"), F.col("quality") == 1
    rows = table(spark, sf, "labels").select(
        F.when(d % 2 == 1, "grounded").otherwise("closed").alias("system"), F.when(q, "success").otherwise("failed").alias("status"), F.when(d % 3 != 0, (d % 3).cast("int") - 1).alias("retry_count"),
        cases.task_success(q, F.col("toxic") == 0, F.when(d % 5 != 0, d % 7 != 0), F.lit(True)).alias("task_success"), F.when(d % 4 != 0, q).alias("root_cause"), (F.col("toxic") == 0).alias("repair"),
        F.when(d % 7 != 0, (d % 101) / 100).alias("relevance"), (d % 11 / 10).alias("faithfulness"),
    )
    return analysis.judged(rows, ["system"], FLAGS, SCORES, "status", "retry_count")


def _hybrid(spark, sf):
    return fused(spark, sf).join(universe(spark, sf), "query_id", "left_semi")


def score_differences(spark, sf):
    """The lexical run against itself, some scores moved a little."""
    run = lexical_run(spark, sf)
    moved = F.col("score") + F.when((F.col("query_id") + F.col("chunk_id")) % 10 == 0, 0.000003).otherwise(0.0)
    return analysis.score_differences(run, run.filter("rank <= 20").withColumn("score", moved))


def ranking_comparison(spark, sf):
    return analysis.compared(dense_run(spark, sf), fused(spark, sf), 10, 30)


def case_selection(spark, sf):
    return analysis.cases(_metrics(spark, sf), _metrics(spark, sf, _hybrid(spark, sf)), "ndcg_10", 3).select("kind", F.col("place").cast("long").alias("place"), "query_id", "delta")


def failure_categories(spark, sf):
    a, b = dense_run(spark, sf), _hybrid(spark, sf)
    found = analysis.failures(universe(spark, sf), a, b, judgments_of(spark, sf, a, b), 10, 5)
    return found.select("category", F.col("place").cast("long").alias("place"), "query_id", F.col("ra").cast("long").alias("rank_a"), F.col("rb").cast("long").alias("rank_b"), "queries")


GATES = {"ndcg_10": ("drops_by", 0.05), "mrr_10": ("at_least", 0.1), "p_5": ("falls_by", 0.2), "judged_5": ("at_most", 0.9)}


def relative_gates(spark, sf):
    """Bounds, a relative reduction and an absolute loss, over all queries and over those of even and odd number."""
    both = _metrics(spark, sf).select("query_id", F.lit("control").alias("side"), *GATES).unionByName(_metrics(spark, sf, _hybrid(spark, sf)).select("query_id", F.lit("candidate").alias("side"), *GATES))
    sliced = both.withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))))
    means = sliced.groupBy("slice").pivot("side", ["control", "candidate"]).agg(*[F.round(F.avg(c), 6).alias(c) for c in GATES])
    rows = means.select("slice", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"control_{c}").alias("control"), F.col(f"candidate_{c}").alias("candidate")) for c in GATES])).alias("x")).select("slice", "x.*")
    return analysis.gates(rows, GATES)


def label_sensitivity(spark, sf):
    return analysis.sensitivity(_metrics(spark, sf), F.col("query_id") % 3, METRICS)


def graded_metrics(spark, sf):
    return evaluation.any_relevance_of(judged(spark, sf, dense_run(spark, sf)), grades(spark, sf), universe(spark, sf))


def latency_totals(spark, sf):
    """Event types play the components of an answer."""
    rows = table(spark, sf, "events")
    means = rows.groupBy(F.col("event_type").alias("kind")).agg(F.round(F.avg("value"), 6).alias("mean"))
    found = percentiles.percentiles(rows, ["event_type"], "value", {"p95": 0.95})
    return analysis.totals(found.join(means, found["event_type"].eqNullSafe(means["kind"])).withColumn("p95", F.round("p95", 6)), ["mean", "p95"])


def evidence_resolution(spark, sf):
    """Each item names its own document, a later one, and one that there is none of."""
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _dialect(F.col("lang")).alias("dialect"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.col("item_id"), F.col("item_id") + 7, F.lit(10**12).cast("long")).alias("ids"))
    return analysis.evidence(items.join(lang.select(F.col("id").alias("query_id"), "dialect"), "query_id"), lang)


VERBS = ("CREATE", "insert", " Select", "WITH", "merge")


def _statements(spark, sf):
    o = F.col("o_orderkey")
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (o % len(VERBS) + 1).cast("int"))
    sql = F.concat(verb, F.lit(" order_"), o % 13, F.lit(" FROM t_"), o % 3, F.when(o % 4 == 0, " WHERE a->>'k' <> max (b)").when(o % 4 == 1, " WHERE c::int >= count(d)").otherwise(" x"))
    return table(spark, sf, "orders").select("o_orderkey", sql.alias("sql"), (o % 3).alias("rows"), (o % 2).alias("columns"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))


def case_rules(spark, sf):
    """Kinds of expected results, their comparison with what was seen, and diagnostic tokens, of statements made of orders."""
    o, price = F.col("o_orderkey"), F.col("price")
    alias = F.when(o % 6 == 0, "table_state").when(o % 6 == 1, "storage_type").otherwise(cases.oracle_type(F.col("sql"), F.col("rows"), F.col("columns")))
    low, high = F.when(o % 2 == 0, F.floor(price / 1000) * 1000).cast("double"), F.when(o % 2 == 0, F.floor(price / 1000) * 1000 + 500).cast("double")
    expected = F.when(o % 5 == 0, price).otherwise(price + 1)
    tokens = cases.diagnostic_tokens(F.col("sql"), F.when(o % 3 == 0, F.concat(F.lit("E"), F.col("cust") % 100)), F.lit(" "))
    return _statements(spark, sf).select("o_orderkey", cases.canonical_oracle(alias).alias("oracle"), cases.matches(expected, low, high, price).alias("matches"), F.array_join(tokens, " ").alias("tokens"))


def _close(spark, sf, k):
    """The candidates of BM25 with the longest common run of tokens and the ratio of matching ones, whole texts."""
    tokens = lambda t: F.transform(T.pool_tokens(t), F.lower)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), tokens(F.col("text")).alias("tokens"))
    run = lexical_run(spark, sf, k)
    docs = _named(table(spark, sf, "documents").select("doc_id", "text"), run).select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("tokens"))
    return closeness.closeness(run, items, docs)


def _named(docs, run):
    """The documents that a run names: no other text is shuffled."""
    return matching(docs, ["doc_id"], run.select(F.col("chunk_id").alias("doc_id")).distinct())


def leakage_status(spark, sf):
    """For the candidates of BM25: containment of five-word runs, the longest common run, the ratio of matching tokens, a
    copied sentence, and what that makes of the pair."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext"))
    docs = _named(table(spark, sf, "documents").select("doc_id", "text"), lexical_run(spark, sf, 10)).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("dtext"))
    rows = _close(spark, sf, 10).join(items, "query_id").join(docs, "chunk_id").withColumns({"qw": T.pool_tokens(F.col("qtext")), "dw": T.pool_tokens(F.col("dtext"))})
    rows = rows.withColumns({"q5": T.ngrams(F.col("qw"), 5), "d5": T.ngrams(F.col("dw"), 5)})  # of columns: else a text is cut again for every run
    marked = rows.select("query_id", "chunk_id", F.round(analysis.containment(F.col("q5"), F.col("d5")), 6).alias("containment"), "run", F.round("ratio", 6).alias("ratio"), analysis.sentence_copied(F.col("qtext"), F.col("dtext")).alias("copied"))
    return marked.select("query_id", "chunk_id", "containment", "run", "ratio", leakage.status(F.col("run"), F.col("copied"), F.col("containment"), F.col("ratio")).alias("status"))


def token_closeness(spark, sf):
    """Longest common run and ratio of an item's tokens and those of the documents that BM25 finds first."""
    return _close(spark, sf, 3).withColumn("ratio", F.round("ratio", 6))


def version_parse(spark, sf):
    """Ten kinds of labels, made of each document's number."""
    d, s = F.col("doc_id"), (F.col("doc_id") % 20).cast("string")
    kinds = [F.lit(None).cast("string"), F.lit("Latest"), F.concat(F.lit("v"), s, F.lit(".4")), F.concat(s, F.lit(".45.2")), F.concat(s, F.lit(".4.x")), s, F.concat(s, F.lit(".0-30.4")), F.concat(F.lit("V"), s, F.lit(".0 to 30.4")), F.lit("rolling snapshot"), F.concat(F.lit(" "), s, F.lit(".7 "))]
    label = F.element_at(F.array(*kinds), (d % 10 + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", label.alias("label")).withColumn("v", version.parse_label(F.col("label"))).select("doc_id", "label", "v.*")
    return rows.withColumn("scope", version.scope(F.col("version"), F.col("version_min"), F.col("version_max"), F.col("version_status")))


def version_compat(spark, sf):
    """Each document with a query of its own: dialects, versions, bounds stated in the text, release notes and current
    documentation, all made of its number; every rule decides some."""
    d, s = F.col("doc_id"), F.col("doc_id") % 20
    num = lambda x, end="": F.concat(x.cast("string"), F.lit(end))
    bound = num(s + d % 3, ".0")
    none = F.lit(None).cast("string")
    text = F.when(d % 5 == 0, F.concat(F.lit("It was introduced in version "), bound, F.lit("."))).when(d % 5 == 1, F.concat(F.lit("It was removed in version "), bound, F.lit("."))).when(d % 5 == 3, "It now supports more.").otherwise("Nothing is said of it.")
    direct = d % 4 == 0
    q = {"dialect": F.when(d % 11 == 0, "postgresql").otherwise("mysql"), "version": F.when(d % 6 == 1, num(s, ".2.5")).when(d % 6 == 2, num(s)).when(d % 6 == 3, F.concat(F.lit("pre-"), num(s, ".2"))).when(d % 6 == 4, "current").otherwise(num(s, ".2")),
         "sql": F.when(direct, "SELECT json_things(a)"), "error_code": none, "sqlstate": none, "error_symbol": none}
    k = d % 7
    p = {"dialect": F.lit("mysql"), "version_min": F.when(k == 2, num(s, ".0")).when(k == 3, num(s, ".2")).when(k == 4, num(s + 3, ".0")).when(k == 6, num(s, ".1")), "version_max": F.when(k == 2, num(s + 1, ".x")).when(k == 3, num(s, ".2")).when(k == 4, num(s + 4, ".x")).when(k == 6, num(s, ".9")),
         "version_status": F.when(k == 0, "unknown").when(k == 1, "current").when(k.isin(3, 5), "exact").otherwise("range"), "source_type": F.when(d % 5 == 3, "release_notes").otherwise("docs"), "title": none, "section": none, "text": F.when(direct, F.concat(text, F.lit(" See json_things(x)."))).otherwise(text)}
    return table(spark, sf, "documents").select("doc_id", version.version_compatibility(q, p).alias("category"))


def claim_support(spark, sf):
    """Claims of items against their first five documents of BM25, as evidence. An item has the dialect of the document with
    its id; it claims version knowledge if it has a figure, dialect knowledge if it has over twenty words, a comparison if it is
    of either compared system, and to be of one system only if it is of that."""
    lang = table(spark, sf, "documents").select("doc_id", _dialect(F.col("lang")).alias("dialect"), "text")
    found = lexical_run(spark, sf, 5).join(lang.select(F.col("doc_id").alias("chunk_id"), F.col("dialect").alias("of")), "chunk_id")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("said")).join(lang.select(F.col("doc_id").alias("query_id"), "dialect"), "query_id")
    same = F.col("of") == F.col("dialect")
    one = F.struct("chunk_id", F.when(F.col("rank") <= 2, 2).otherwise(1).alias("relevance"), F.when(F.col("rank") == 1, "primary").when(~same, "comparison").otherwise("supporting").alias("role"), F.when(same, "compatible").otherwise("incompatible").alias("dialect_compatibility"), F.when(F.col("rank") % 2 == 1, "compatible").otherwise("unknown").alias("version_compatibility"))
    flags = F.struct((T.word_count(F.col("said")) > 20).alias("requires_dialect_reasoning"), F.col("said").rlike("[0-9]").alias("requires_version_reasoning"), F.lit(False).alias("has_documented_error"), F.col("dialect").isin("mysql", "mariadb").alias("compares_mysql_mariadb"), (F.col("dialect") == "duckdb").alias("is_duckdb_specific"))
    cases = found.join(items, "query_id").groupBy("query_id", "dialect", "said").agg(F.collect_list(one).alias("evidence"))
    cases = cases.select("query_id", "dialect", F.lit("exact").alias("version_status"), flags.alias("case_flags"), F.lit(False).alias("states_error"), "evidence")
    held = rules.supported(cases, lang.withColumnRenamed("doc_id", "chunk_id"), F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)))
    return rules.failures(held, "query_id", rules.CLAIM_RULES)


def judgment_staleness(spark, sf):
    """Judgments of conversations, saved at an earlier state of them: then every 11th had another first turn, every 13th was
    not there, and for every 17th there was one more, under a number of its own. Every fifth was judged at the third attempt."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.count(F.lit(1)).alias("turns"))
    n, at = F.col("conv_id"), lambda i, s: F.struct(F.lit(i).alias("attempt"), F.lit(s).alias("status"))
    then = turns.filter(n % 13 != 0).withColumn("first", F.when(n % 11 == 0, F.concat(F.lit("~"), "first")).otherwise(F.col("first")))
    then = then.unionByName(turns.filter(n % 17 == 0).withColumn("conv_id", n + 10**9))
    attempts = F.when(n % 5 == 0, F.array(at(1, "failed"), at(2, "failed"), at(3, "success"))).otherwise(F.array(at(1, "success")))
    saved = judgments.contexts(then, "conv_id", ["first", "turns"]).withColumnRenamed("query_id", "conv_id").select(n.alias("query_id"), "context", F.lit("success").alias("status"), attempts.alias("attempts"))
    return judgments.compared(saved, judgments.contexts(turns, "conv_id", ["first", "turns"])).select("query_id", "state", F.size("faults").cast("long").alias("faults"))


QUERIES = {f.__name__: f for f in (
    claim_support, judgment_staleness, judge_aggregate, score_differences, ranking_comparison, case_selection, failure_categories, relative_gates, label_sensitivity, graded_metrics, latency_totals, evidence_resolution, case_rules, leakage_status, token_closeness, version_parse, version_compat,
)}


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_RATE = lambda c: f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END), 6)"
_PAIRS = "unnest([" + ", ".join(f"{{'metric': '{c}', 'v': {c}}}" for c in METRICS) + "])"
_GATE = {"at_least": "x + 1e-15 >= {0}", "at_most": "x - 1e-15 <= {0}", "falls_by": "c > 0 AND (c - x) / c + 1e-15 >= {0}", "drops_by": "x + 1e-15 >= c - {0}"}
_GATE_ROWS = " UNION ALL ".join(f"SELECT slice, '{m}' AS metric, round(avg(m.{m}), 6) AS c, round(avg(h.{m}), 6) AS x, '{k}' AS kind, {v}::DOUBLE AS lim FROM m JOIN h USING (query_id), LATERAL (SELECT unnest(['all', CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS slice) GROUP BY slice" for m, (k, v) in GATES.items())
_TOKENS = lambda t: f"regexp_extract_all(coalesce({t}, ''), {_quoted(T.POOL_TOKEN)})"

# Matching runs, as boxes that are cut at their longest common run: all maximal runs on diagonals first, then box by box.
_CLOSE = lambda k: rf"""tk AS (SELECT query_id, chunk_id, list_transform({_TOKENS('b.text')}, lambda x: lower(x)) AS q, list_transform({_TOKENS('d.text')}, lambda x: lower(x)) AS w FROM lexical JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id WHERE rank <= {k}),
      cell AS (SELECT x.query_id, x.chunk_id, x.i, y.j FROM (SELECT query_id, chunk_id, unnest(range(len(q))) AS i, unnest(q) AS t FROM tk) x JOIN (SELECT query_id, chunk_id, unnest(range(len(w))) AS j, unnest(w) AS t FROM tk) y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id AND x.t = y.t),
      diag AS (SELECT query_id, chunk_id, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY query_id, chunk_id, i - j ORDER BY i) AS g FROM cell) GROUP BY query_id, chunk_id, i - j, g),
      box AS (SELECT query_id, chunk_id, 0 AS a, len(q) AS b, 0 AS c, len(w) AS d, 0 AS size FROM tk UNION ALL
        SELECT query_id, chunk_id, x.a, x.b, x.c, x.d, x.size FROM (SELECT query_id, chunk_id, unnest([{{'a': a, 'b': m.i, 'c': c, 'd': m.j, 'size': m.n}}, {{'a': m.i + m.n, 'b': b, 'c': m.j + m.n, 'd': d, 'size': 0}}]) AS x FROM (
          SELECT query_id, chunk_id, a, b, c, d, arg_min({{'i': i, 'j': j, 'n': n}}, {{'x': -n, 'y': i, 'z': j}}) AS m FROM (
            SELECT p.query_id, p.chunk_id, a, b, c, d, i + o AS i, j + o AS j, least(n, b - i, d - j) - o AS n FROM (SELECT p.*, r.i, r.j, r.n, greatest(0, a - r.i, c - r.j) AS o FROM box p JOIN diag r ON r.query_id = p.query_id AND r.chunk_id = p.chunk_id WHERE p.a < p.b AND p.c < p.d) p
          ) WHERE n > 0 GROUP BY query_id, chunk_id, a, b, c, d))),
      measured AS (SELECT tk.query_id, tk.chunk_id, q, w, CAST(run AS BIGINT) AS run, round(CASE WHEN len(q) + len(w) = 0 THEN 1.0 ELSE 2 * total / (len(q) + len(w)) END, 6) AS ratio FROM tk JOIN (SELECT query_id, chunk_id, max(size) AS run, sum(size) AS total FROM box GROUP BY 1, 2) t ON t.query_id = tk.query_id AND t.chunk_id = tk.chunk_id)"""  # noqa: E731

ORACLE = {
    "judgment_staleness": """WITH c AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id)
      SELECT conv_id AS query_id, CASE WHEN conv_id % 13 = 0 THEN 'new' WHEN conv_id % 11 = 0 AND t IS NOT NULL THEN 'changed' ELSE 'holds' END AS state, CAST(0 AS BIGINT) AS faults FROM c
      UNION ALL SELECT conv_id + 1000000000, 'gone', 0 FROM c WHERE conv_id % 17 = 0""",
    "claim_support": f"""WITH {_ALL}, l AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'mysql' WHEN 'fr' THEN 'mariadb' WHEN 'de' THEN 'sqlite' ELSE 'duckdb' END AS dialect FROM documents),
      c AS (SELECT item_id AS query_id, b.text AS said, l.dialect FROM benchmark b JOIN l ON doc_id = item_id),
      e AS (SELECT query_id, c.dialect, said, rank, l.dialect AS d, lower(l.text) AS t, rank <= 2 AND l.dialect = c.dialect AS direct, rank <= 2 AND l.dialect = c.dialect AND rank % 2 = 1 AND regexp_matches(l.text, '[0-9]') AS change FROM lexical JOIN c USING (query_id) JOIN l ON l.doc_id = chunk_id WHERE rank <= 5),
      g AS (SELECT query_id, dialect, bool_or(direct) AS direct, bool_or(coalesce(change, false)) AS change, bool_or(d = 'mysql') AND bool_or(d = 'mariadb') OR bool_or(coalesce(rank > 1 AND d <> dialect AND contains(t, 'mysql') AND contains(t, 'mariadb'), false)) AS two, bool_or(direct AND d = 'duckdb') AS duck,
        len(regexp_extract_all(any_value(said), {_quoted(T.WORD)})) > 20 AS fd, regexp_matches(any_value(said), '[0-9]') AS fv FROM e GROUP BY query_id, dialect)
      SELECT query_id, unnest(list_filter([CASE WHEN NOT direct THEN 'direct_evidence' END, CASE WHEN fd AND NOT direct THEN 'dialect_claim' END, CASE WHEN fv AND NOT change THEN 'version_claim' END, CASE WHEN dialect IN ('mysql', 'mariadb') AND NOT two THEN 'comparison_claim' END, CASE WHEN dialect = 'duckdb' AND NOT duck THEN 'duckdb_claim' END], lambda x: x IS NOT NULL)) AS rule FROM g""",
    "judge_aggregate": f"""WITH r AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 'grounded' ELSE 'closed' END AS system, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 - 1 ELSE 0 END AS retry FROM labels)
      SELECT system, count(*) AS results, count(CASE WHEN quality = 1 THEN 1 END) AS successes, count(CASE WHEN quality <> 1 THEN 1 END) AS failures, CAST(sum(retry) AS BIGINT) AS retries, count(CASE WHEN quality = 1 AND retry > 0 THEN 1 END) AS recovered,
      {_RATE('quality = 1 AND toxic = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0')} AS task_success, {_RATE('doc_id % 4 <> 0 AND quality = 1')} AS root_cause, {_RATE('toxic = 0')} AS repair,
      round(avg(CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 101) / 100 ELSE 0.0 END), 6) AS relevance, round(avg(doc_id % 11 / 10), 6) AS faithfulness FROM r GROUP BY system""",
    "score_differences": f"""WITH {_ALL}, x AS (SELECT round(abs(round(score, 8) - round(score + CASE WHEN (query_id + chunk_id) % 10 = 0 THEN 0.000003::DOUBLE ELSE 0 END, 8)), 8) AS gap FROM lexical WHERE rank <= 20)
      SELECT count(*) AS compared, count(CASE WHEN gap = 0 THEN 1 END) AS equal, round(avg(CAST(gap = 0 AS INT)), 6) AS equal_share, round(avg(gap), 9) AS mean_difference, round(max(gap), 9) AS greatest_difference FROM x""",
    "ranking_comparison": f"""WITH {_ALL}, la AS (SELECT query_id, list(chunk_id ORDER BY rank) AS a FROM dense WHERE rank <= 10 GROUP BY query_id), lb AS (SELECT query_id, list(chunk_id ORDER BY rank) AS b FROM fused WHERE rank <= 10 GROUP BY query_id),
      p AS (SELECT coalesce(la.query_id, lb.query_id) AS query_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM la FULL OUTER JOIN lb ON la.query_id = lb.query_id),
      g AS (SELECT *, least(len(a), len(b)) AS d FROM p), ag AS (SELECT query_id, d, i, len(list_intersect(a[1:i], b[1:i])) / i AS agree FROM g, range(1, 11) t(i) WHERE i <= d),
      rb AS (SELECT query_id, 0.1::DOUBLE * sum(agree * pow(0.9, i - 1)) + max(pow(0.9, d) * CASE WHEN i = d THEN agree END) AS rbo FROM ag GROUP BY query_id),
      c AS (SELECT query_id, d.rank AS ra, f.rank AS rb FROM dense d JOIN fused f USING (query_id, chunk_id)), n AS (SELECT query_id, count(*) AS common FROM c GROUP BY query_id),
      ps AS (SELECT x.query_id, sum(sign(y.rb - x.rb)) AS s FROM c x JOIN c y ON x.query_id = y.query_id AND x.ra < y.ra GROUP BY 1), tau AS (SELECT query_id, CASE WHEN common > 1 THEN s / (common * (common - 1) / 2) END AS tau FROM n LEFT JOIN ps USING (query_id)),
      e AS (SELECT g.query_id, a = b AS seq, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS st, len(list_intersect(a, b)) / greatest(1, len(b)) AS overlap, len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS j, coalesce(rbo, 0.0) AS rbo, tau
        FROM g LEFT JOIN rb USING (query_id) LEFT JOIN tau USING (query_id))
      SELECT count(*) AS queries, count(CASE WHEN seq THEN 1 END) AS equal_sequences, count(CASE WHEN st THEN 1 END) AS equal_sets, {_RATE('seq')} AS sequence_share, {_RATE('st')} AS set_share,
      round(avg(overlap), 6) AS mean_overlap, round(avg(j), 6) AS mean_jaccard, round(avg(rbo), 6) AS mean_rbo, round(avg(tau), 6) AS mean_tau FROM e""",
    "case_selection": f"""WITH {_ALL}, {_M}, {_H}, d AS (SELECT query_id, round(h.ndcg_10 - m.ndcg_10, 9) AS delta FROM m JOIN h USING (query_id)), k AS (SELECT *, CASE WHEN delta > 0 THEN 'gain' ELSE 'loss' END AS kind FROM d WHERE delta <> 0)
      SELECT kind, place, query_id, delta FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(delta) DESC, query_id) AS place FROM k) WHERE place <= 3""",
    "failure_categories": f"""WITH {_ALL}, fa AS (SELECT query_id, min(rank) AS ra FROM dense JOIN qrels USING (query_id, chunk_id) WHERE relevance = 2 GROUP BY 1), fb AS (SELECT query_id, min(rank) AS rb FROM hybrid JOIN qrels USING (query_id, chunk_id) WHERE relevance = 2 GROUP BY 1),
      r AS (SELECT DISTINCT u.query_id, ra, rb, coalesce(ra <= 10, false) AS ia, coalesce(rb <= 10, false) AS ib FROM universe u LEFT JOIN fa USING (query_id) LEFT JOIN fb USING (query_id)),
      c AS (SELECT query_id, ra, rb, unnest([CASE WHEN NOT ia AND NOT ib THEN 'both_miss' END, CASE WHEN ia AND NOT ib THEN 'only_a' END, CASE WHEN NOT ia AND ib THEN 'only_b' END, CASE WHEN ia AND ib AND ra > 5 AND rb > 5 THEN 'both_late' END, CASE WHEN ia AND ib AND rb > ra THEN 'regressed' END, CASE WHEN ia AND ib AND rb < ra THEN 'improved' END]) AS category FROM r),
      p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY query_id) AS place, count(*) OVER (PARTITION BY category) AS queries FROM c WHERE category IS NOT NULL) SELECT category, place, query_id, ra AS rank_a, rb AS rank_b, queries FROM p WHERE place <= 5""",
    "relative_gates": f"WITH {_ALL}, {_M}, {_H}, g AS ({_GATE_ROWS}) SELECT slice, metric, c AS control, x AS candidate, kind, lim AS \"limit\", coalesce(CASE kind {' '.join(f'''WHEN '{k}' THEN {v.format('lim')}''' for k, v in _GATE.items())} END, false) AS passed FROM g",
    "label_sensitivity": f"WITH {_ALL}, {_M}, p AS (SELECT query_id % 3 AS pass, {', '.join(f'avg({c}) AS {c}' for c in METRICS)} FROM m GROUP BY 1), l AS (SELECT {_PAIRS} AS x FROM p) SELECT x.metric AS metric, count(x.v) AS passes, round(max(x.v) - min(x.v), 6) AS spread FROM l GROUP BY 1",
    "graded_metrics": f"""WITH {_ALL}, t AS (SELECT query_id, count(*) AS n FROM qrels WHERE relevance >= 1 GROUP BY query_id), g AS (SELECT query_id, min(CASE WHEN rank <= 10 THEN rank END) AS first, {', '.join(f'count(CASE WHEN rank <= {k} THEN 1 END) AS r{k}' for k in (5, 10, 20))} FROM dense JOIN qrels USING (query_id, chunk_id) WHERE relevance >= 1 GROUP BY query_id)
      SELECT DISTINCT u.query_id, round(coalesce(1.0 / first, 0.0), 6) AS mrr_10_any, {', '.join(f'round(coalesce(CASE WHEN n > 0 THEN r{k} / n END, 0.0), 6) AS recall_{k}_any' for k in (5, 10, 20))}, round(coalesce(r5, 0) / 5, 6) AS p_5_any, CAST(coalesce(r5, 0) > 0 AS DOUBLE) AS hit_5_any
      FROM universe u LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id)""",
    "latency_totals": "SELECT count(*) AS components, round(sum(mean), 6) AS mean, round(sum(p95), 6) AS p95 FROM (SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type)",
    "evidence_resolution": """WITH l AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'mysql' WHEN 'fr' THEN 'mariadb' WHEN 'de' THEN 'sqlite' ELSE 'duckdb' END AS dialect FROM documents),
      i AS (SELECT item_id AS query_id, l.dialect, unnest([item_id, item_id + 7, 1000000000000]) AS id FROM benchmark JOIN l ON l.id = item_id)
      SELECT query_id, count(i.id) AS named, count(CASE WHEN l.id IS NULL THEN 1 END) AS missing, count(CASE WHEN l.dialect <> i.dialect THEN 1 END) AS other_dialect FROM i LEFT JOIN l USING (id) GROUP BY query_id""",
    "case_rules": f"""WITH s AS (SELECT *, [{', '.join(map(_quoted, VERBS))}][o_orderkey % {len(VERBS)} + 1] AS verb FROM orders),
      t AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'database_state' WHEN 1 THEN 'scalar' ELSE CASE upper(trim(verb)) WHEN 'CREATE' THEN 'schema_state' WHEN 'INSERT' THEN 'database_state' WHEN 'MERGE' THEN 'database_state' ELSE CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN 'scalar' ELSE 'ordered_rows' END END END AS oracle FROM s)
      SELECT o_orderkey, oracle, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice >= floor(o_totalprice / 1000) * 1000 AND o_totalprice < floor(o_totalprice / 1000) * 1000 + 500 ELSE o_orderkey % 5 = 0 END AS matches,
      concat_ws(' ', CASE WHEN o_orderkey % 3 = 0 THEN 'E' || o_custkey % 100 END, CASE o_orderkey % 4 WHEN 0 THEN '->> -> <> max' WHEN 1 THEN ':: >= count' END, 'order_' || o_orderkey % 13, 't_' || o_orderkey % 3) AS tokens FROM t""",
    "leakage_status": rf"""WITH RECURSIVE {_ALL}, {_CLOSE(10)},
      g AS (SELECT m.*, {', '.join(f"list_distinct(list_transform(range(1, len({x}) - 3), lambda i: array_to_string({x}[i:i + 4], ' '))) AS {x}5" for x in 'qw')}, b.text AS qt, d.text AS dt FROM measured m JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = chunk_id),
      f AS (SELECT *, lower(trim(regexp_replace(dt, '\s+', ' ', 'g'))) AS flat, regexp_split_to_array(regexp_replace(regexp_replace(qt, '([.!?。！？])\s+([A-Z0-9`\[])', '\1' || chr(1) || '\2', 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)) AS parts FROM g),
      c AS (SELECT *, round(CASE WHEN len(q5) = 0 THEN 0.0 ELSE len(list_intersect(q5, w5)) / len(q5) END, 6) AS containment,
        len(list_filter(list_transform(parts, lambda s: lower(trim(regexp_replace(s, '\s+', ' ', 'g')))), lambda s: len(string_split(s, ' ')) >= 6 AND contains(flat, s))) > 0 AS copied FROM f)
      SELECT query_id, chunk_id, containment, run, ratio, CASE WHEN run > 12 OR copied THEN 'FAIL' WHEN containment > 0.45 OR ratio > 0.55 THEN 'WARN' ELSE 'PASS' END AS status FROM c""",
    "token_closeness": rf"WITH RECURSIVE {_ALL}, {_CLOSE(3)} SELECT query_id, chunk_id, run, ratio FROM measured",
    "version_parse": """WITH s AS (SELECT doc_id, doc_id % 10 AS k, CAST(doc_id % 20 AS VARCHAR) AS s FROM documents),
      l AS (SELECT *, CASE k WHEN 1 THEN 'Latest' WHEN 2 THEN 'v' || s || '.4' WHEN 3 THEN s || '.45.2' WHEN 4 THEN s || '.4.x' WHEN 5 THEN s WHEN 6 THEN s || '.0-30.4' WHEN 7 THEN 'V' || s || '.0 to 30.4' WHEN 8 THEN 'rolling snapshot' WHEN 9 THEN ' ' || s || '.7 ' END AS label,
        CASE k WHEN 1 THEN 'current' WHEN 2 THEN s || '.4' WHEN 3 THEN s || '.45.2' WHEN 4 THEN s || '.4.x' WHEN 5 THEN s WHEN 6 THEN s || '.0-30.4' WHEN 7 THEN 'V' || s || '.0 to 30.4' WHEN 8 THEN 'rolling snapshot' WHEN 9 THEN s || '.7' END AS version,
        CASE k WHEN 2 THEN s || '.4' WHEN 3 THEN s || '.45.2' WHEN 4 THEN s || '.4.0' WHEN 5 THEN s || '.0' WHEN 6 THEN s || '.0' WHEN 7 THEN s || '.0' WHEN 9 THEN s || '.7' END AS version_min,
        CASE k WHEN 2 THEN s || '.4' WHEN 3 THEN s || '.45.2' WHEN 4 THEN s || '.4.x' WHEN 5 THEN s || '.x' WHEN 6 THEN '30.4' WHEN 7 THEN '30.4' WHEN 9 THEN s || '.7' END AS version_max,
        CASE WHEN k IN (0, 8) THEN 'unknown' WHEN k = 1 THEN 'current' WHEN k IN (2, 3, 9) THEN 'exact' ELSE 'range' END AS version_status FROM s)
      SELECT doc_id, label, version, version_min, version_max, version_status, CASE WHEN version_status = 'range' THEN version_min || '..' || version_max ELSE coalesce(version, version_status) END AS scope FROM l""",
    "version_compat": """WITH a AS (SELECT doc_id AS d, doc_id % 20 AS s, doc_id % 7 AS k, doc_id % 6 AS v, doc_id % 5 AS t FROM documents),
      b AS (SELECT *, (s + d % 3) * 1000000 AS bound, d % 4 = 0 AS direct, CASE v WHEN 1 THEN s * 1000000 + 2005 WHEN 2 THEN s * 1000000 WHEN 0 THEN s * 1000000 + 2000 WHEN 5 THEN s * 1000000 + 2000 END AS lo,
        CASE v WHEN 1 THEN s * 1000000 + 2006 WHEN 2 THEN s * 1000000 + 1 WHEN 0 THEN s * 1000000 + 2001 WHEN 5 THEN s * 1000000 + 2001 WHEN 3 THEN s * 1000000 + 2000 END AS hi,
        CASE k WHEN 2 THEN s * 1000000 WHEN 3 THEN s * 1000000 + 2000 WHEN 4 THEN (s + 3) * 1000000 WHEN 6 THEN s * 1000000 + 1000 END AS dlo, CASE k WHEN 2 THEN (s + 2) * 1000000 WHEN 3 THEN s * 1000000 + 3000 WHEN 4 THEN (s + 5) * 1000000 WHEN 6 THEN s * 1000000 + 10000 END AS dhi FROM a),
      c AS (SELECT *, t = 0 AND coalesce(lo >= bound, false) OR t = 1 AND coalesce(hi <= bound, false) AS holds, t = 0 AND coalesce(hi <= bound, false) OR t = 1 AND coalesce(lo >= bound, false) AS excludes FROM b)
      SELECT d AS doc_id, CASE WHEN d % 11 = 0 THEN 'not_applicable' WHEN v = 4 THEN 'unknown' WHEN holds THEN 'compatible' WHEN excludes THEN CASE WHEN direct THEN 'compatible' ELSE 'incompatible' END
        WHEN t = 3 AND hi <= dlo THEN CASE WHEN direct THEN 'compatible' ELSE 'incompatible' END WHEN t = 3 AND lo >= dlo THEN 'compatible'
        WHEN dlo IS NOT NULL AND NOT coalesce(lo >= dhi, false) AND NOT coalesce(hi <= dlo, false) THEN 'compatible' WHEN k IN (0, 1) THEN 'unknown' ELSE 'general' END AS category FROM c""",
}
