"""Queries over plan validation, trees, tests and reports, registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import paths
from weft.operators import edgerules, groups, hunks, repairs, reports, trees, validation, verification
from weft.plans.queries import EG, E, M, METRICS, P, SYMBOLS, TITLES, TOTALS, U, WHOLE, _sliced, _symbols, query, titled
from weft.session import bucketed, table
from weft.sources import adapters

CLAIMS = """claim AS (SELECT cs_id, grp, CAST(sum(CASE WHEN is_generated THEN 0 ELSE added END) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted,
  count(DISTINCT file) AS files FROM units JOIN members USING (cs_id, unit_id) GROUP BY cs_id, grp),
  needs AS (SELECT DISTINCT cs_id, grp, grp - 1 AS needs FROM members WHERE grp > 1),
  derived AS (SELECT DISTINCT cs_id, dst_grp AS grp, src_grp AS needs FROM eg WHERE kind = 'before' AND src_grp <> dst_grp)"""


@query(f"""WITH {E}, {M}, {TOTALS}, {EG}, {CLAIMS}
  SELECT cs_id, 'hard-edge-cut' AS rule, src || '>' || dst AS item FROM eg WHERE kind = 'must_with' AND src_grp <> dst_grp
  UNION ALL SELECT cs_id, 'order-inverted', src || '>' || dst FROM eg WHERE kind = 'before' AND src_grp > dst_grp
  UNION ALL SELECT cs_id, 'group-too-large', CAST(grp AS VARCHAR) FROM totals WHERE added + deleted > 800 OR files > 30
  UNION ALL SELECT t.cs_id, 'totals-differ', CAST(t.grp AS VARCHAR) FROM totals t JOIN claim c ON c.cs_id = t.cs_id AND c.grp = t.grp WHERE t.added <> c.added
  UNION ALL SELECT cs_id, 'dependency-missing', needs || '<' || grp FROM (SELECT * FROM derived EXCEPT SELECT * FROM needs) a
  UNION ALL SELECT cs_id, 'dependency-unfounded', needs || '<' || grp FROM (SELECT * FROM needs EXCEPT SELECT * FROM derived) b""")
def plan_violations(spark, sf):
    """All constraints, for a plan that leaves generated lines out of its totals and takes each group to need the one before it."""
    u = adapters.units(spark, sf)
    m = _sliced(u)
    claim = u.join(m, ["cs_id", "unit_id"]).groupBy("cs_id", "grp").agg(
        F.sum(F.when(F.col("is_generated"), 0).otherwise(F.col("added"))).alias("added"), F.sum("deleted").alias("deleted"), F.count_distinct("file").alias("files")
    )
    needs = m.where("grp > 1").select("cs_id", "grp", (F.col("grp") - 1).alias("needs")).distinct()
    return validation.plan_violations(u, adapters.kept_edges(spark, u), m, claim, needs)


@query(f"""WITH {U}, d AS (SELECT DISTINCT cs_id, unit_id AS p, package AS symbol, deleted = 1 AS fresh FROM units WHERE NOT is_test),
  r AS (SELECT cs_id, unit_id AS c, package AS symbol, deleted = 1 AS new_file FROM units WHERE is_test), s AS (SELECT * FROM d JOIN r USING (cs_id, symbol)),
  n AS (SELECT cs_id, c, count(DISTINCT p) AS n, bool_or(fresh) AS fresh FROM s GROUP BY cs_id, c)
  SELECT s.cs_id, s.p AS src, s.c AS dst, CASE WHEN n.n = 1 AND n.fresh AND new_file THEN 'must_with' ELSE 'affinity' END AS kind,
  CASE WHEN n.n = 1 AND n.fresh AND new_file THEN 100 ELSE 90 END AS weight, CASE WHEN n.n = 1 AND n.fresh AND new_file THEN 'exclusive-new-symbol-test' ELSE 'implementation-test' END AS evidence
  FROM s JOIN n ON n.cs_id = s.cs_id AND n.c = s.c""")
def implementation_tests(spark, sf):
    """Units that aren't tests declare their package, tests refer to theirs; a unit from one row of its table is new."""
    u = adapters.units(spark, sf).withColumn("change_kind", F.when(F.col("deleted") == 1, "add").otherwise("modify"))
    code = u.where("NOT is_test").select("cs_id", "unit_id", F.col("package").alias("symbol"), F.explode(F.when(F.col("deleted") == 1, F.array(F.lit("new"))).otherwise(F.array(F.lit("new"), F.lit("old")))).alias("side"))
    named = u.where("is_test").select("cs_id", "unit_id", F.col("package").alias("symbol"), F.lit("new").alias("side"))
    pairs = code.where("side = 'new'").withColumnRenamed("unit_id", "p").join(named.withColumnRenamed("unit_id", "c"), ["cs_id", "symbol"]).select("cs_id", "p", "c").distinct()
    return edgerules.test_rules(u, code, named, pairs)


RANGES = "SELECT l_partkey AS part, l_orderkey AS id, 7 * l_linenumber + l_orderkey % 100 AS start, 7 * l_linenumber + l_orderkey % 100 + CAST(l_quantity AS BIGINT) % 5 AS \"end\" FROM lineitem"


@query(f"""WITH r AS ({RANGES}), o AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY part ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start - 1) THEN 1 ELSE 0 END AS opens FROM r),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY part ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM o)
  SELECT part, min(start) AS island, max("end") AS "end", count(*) AS n FROM n GROUP BY part, i""")
def range_islands(spark, sf):
    """Runs of overlapping ranges in each part, the merging of hunks on one side of a file."""
    r = table(spark, sf, "lineitem").selectExpr("l_partkey AS part", "l_orderkey AS id", "7 * l_linenumber + l_orderkey % 100 AS start", "7 * l_linenumber + l_orderkey % 100 + CAST(l_quantity AS BIGINT) % 5 AS end")
    return hunks.islands(r, ["part"]).groupBy("part", "island").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(doc_id % 10 AS BIGINT) AS cs_id, CASE WHEN doc_id % 4 = 1 THEN 'moved/' || doc_id ELSE lang || '/' || doc_id END AS path,
  CASE WHEN doc_id % 4 = 2 THEN sha1(lang) ELSE sha1(encode(text)) END AS oid, '100644' AS mode FROM documents WHERE doc_id % 4 <> 0""")
def tree_after(spark, sf):
    """The documents as files after changes that delete, rename and replace three quarters of them."""
    d = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(10)).alias("cs_id"), "doc_id", "lang", F.concat_ws("/", "lang", "doc_id").alias("path"), F.sha1("text").alias("oid"), F.lit("100644").alias("mode"))
    kind = F.pmod("doc_id", F.lit(4))
    change = d.where(kind < 3).select(
        "cs_id", F.col("doc_id").alias("file_id"), F.col("path").alias("old_path"), F.when(kind == 1, F.concat(F.lit("moved/"), "doc_id")).when(kind == 2, F.col("path")).alias("new_path"),
        F.when(kind == 2, F.sha1("lang")).otherwise(F.col("oid")).alias("new_oid"), F.lit("100644").alias("new_mode"),
    )
    return trees.reconstruct(d, change)


@query("""WITH o AS (SELECT doc_id, lang, source, n_chars FROM documents), n AS (SELECT doc_id - 1 AS doc_id, lang, source, n_chars FROM documents),
  b AS (SELECT o.doc_id, f.field, f.old_value, f.new_value FROM o JOIN n ON n.doc_id = o.doc_id, LATERAL (VALUES ('lang', o.lang, n.lang), ('source', o.source, n.source),
  ('n_chars', CAST(o.n_chars AS VARCHAR), CAST(n.n_chars AS VARCHAR))) f(field, old_value, new_value) WHERE old_value IS DISTINCT FROM new_value)
  SELECT * FROM b UNION ALL SELECT doc_id, NULL, 'true', 'false' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)
  UNION ALL SELECT doc_id, NULL, 'false', 'true' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)""")
def field_changes(spark, sf):
    """Fields in which each document differs from the next."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return validation.field_changes(d, d.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"])


@query(f"""WITH {E}, {M}, {EG}, k AS (SELECT cs_id, src_grp AS grp, kind, weight, count(*) AS n FROM eg WHERE src_grp = dst_grp GROUP BY cs_id, src_grp, kind, weight),
  r AS (SELECT *, row_number() OVER (PARTITION BY cs_id, grp ORDER BY kind, weight) AS r FROM k)
  SELECT cs_id, grp, string_agg(CASE WHEN r <= 2 THEN kind || ':' || weight || ':' || n ELSE 'more' END, ',' ORDER BY r) AS reasons FROM r WHERE r <= 3 GROUP BY cs_id, grp""")
def group_reasons(spark, sf):
    u = adapters.units(spark, sf)
    return reports.top_reasons(adapters.edges(spark, u), _sliced(u), 2)


@query(f"""WITH {E}, {M}, {TOTALS}, {EG}, {TITLES},
  d AS (SELECT cs_id, grp, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS needs FROM (SELECT DISTINCT cs_id, dst_grp AS grp, src_grp AS g FROM eg WHERE kind = 'before' AND src_grp < dst_grp) x GROUP BY cs_id, grp)
  SELECT t.cs_id, t.grp, '## ' || t.grp || '. ' || title
  || chr(10) || chr(10) || '- Lines: +' || added || ' -' || deleted || chr(10) || '- Files: ' || files || chr(10) || '- Needs: ' || coalesce(needs, 'none') || chr(10) AS markdown
  FROM totals t JOIN titles a ON a.cs_id = t.cs_id AND a.grp = t.grp LEFT JOIN d ON d.cs_id = t.cs_id AND d.grp = t.grp""")
def group_markdown(spark, sf):
    u = adapters.units(spark, sf)
    m = _sliced(u)
    totals = groups.group_totals(u, m)
    return reports.group_markdown(totals, groups.titles(titled(u), m), groups.group_dependencies(adapters.edges(spark, u), m))


@query(f"""WITH {U}, {M}, {TOTALS}, {TITLES},
  j AS (SELECT cs_id, '{{"cs_id":' || cs_id || ',"groups":[' || string_agg('{{"grp":' || grp || ',"added":' || added || ',"deleted":' || deleted || ',"files":' || files || ',"title":"'
  || title || '"}}', ',' ORDER BY grp) || ']}}' AS plan
  FROM totals JOIN titles USING (cs_id, grp) GROUP BY cs_id) SELECT cs_id, plan, CAST(octet_length(encode(plan)) AS BIGINT) AS bytes FROM j""")
def plan_records(spark, sf):
    u = adapters.units(spark, sf)
    m = _sliced(u)
    totals = groups.group_totals(u, m)
    return reports.plan_json(totals, groups.titles(titled(u), m))


CHECKED = """g AS (SELECT cs_id, grp, max(added) > 49 AND min(file) % 3 = 0 AS broken, bool_or(is_test) AS test, count(*) > 3 AS many, min(file) % 11 = 0 AS late, min(file) % 13 = 0 AS none
  FROM units JOIN members USING (cs_id, unit_id) GROUP BY cs_id, grp),
  c AS (SELECT *, CASE WHEN none THEN NULL WHEN broken THEN 'failed' ELSE 'passed' END AS syntax, CASE WHEN none THEN NULL WHEN test THEN 'skipped' ELSE 'passed' END AS semantic,
  CASE WHEN none THEN NULL WHEN many THEN 'skipped' ELSE 'passed' END AS project FROM g)"""


@query(f"""WITH {U}, {M}, {CHECKED}, v AS (SELECT cs_id, count(*) AS total, count(*) FILTER (WHERE NOT none AND NOT late AND syntax = 'passed' AND project = 'passed') AS covered,
  coalesce(bool_or(project <> 'skipped'), false) AS commands, CASE WHEN coalesce(bool_or(syntax = 'failed'), false) THEN 'failed' WHEN bool_or(none OR late) THEN 'verification-unavailable' ELSE 'passed' END AS status,
  count(*) FILTER (WHERE syntax = 'passed') AS n_syntax, count(*) FILTER (WHERE semantic = 'passed') AS n_semantic FROM c GROUP BY cs_id)
  SELECT cs_id, status, CASE WHEN commands AND status = 'passed' THEN 'project' WHEN n_semantic = total THEN 'semantic' WHEN n_syntax = total THEN 'syntax' ELSE 'reconstructed' END AS level,
  CASE WHEN total <= 1 THEN 'single-change' WHEN status = 'passed' THEN 'split-verified' ELSE 'split-unverified' END AS plan_status, covered, total, commands FROM v""")
def verification_status(spark, sf):
    """Rolled-up outcomes of checks that follow from each group's units."""
    u = adapters.units(spark, sf)
    m = _sliced(u)
    file = F.min("file")
    g = u.join(m, ["cs_id", "unit_id"]).groupBy("cs_id", "grp").agg(
        ((F.max("added") > 49) & (file % 3 == 0)).alias("broken"), F.bool_or("is_test").alias("test"), (F.count(F.lit(1)) > 3).alias("many"), (file % 11 == 0).alias("late"), (file % 13 == 0).alias("none")
    )
    one = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    own = [
        one("syntax", F.when(F.col("broken"), "failed").otherwise("passed")), one("semantic", F.when(F.col("test"), "skipped").otherwise("passed")),
        one("build", F.when(F.col("many"), "skipped").otherwise("passed")),
    ]
    first, absent = one("reconstruction", F.lit("passed")), F.lit("unavailable")
    rows = F.when(F.col("none"), F.array(first, one("snapshot", absent))).when(F.col("late"), F.array(first, one("dependencies", absent), *own)).otherwise(F.array(first, *own))
    results = g.select("cs_id", "grp", F.posexplode(rows).alias("pos", "r")).select("cs_id", "grp", "pos", "r.*")
    return verification.verification(results, m)


CONFIDENCE = """w AS (SELECT DISTINCT cs_id, grp FROM members), n AS (SELECT cs_id, count(*) AS groups FROM w GROUP BY cs_id),
  s AS (SELECT cs_id, bool_or(kind = 'must_with' AND src_grp <> dst_grp OR kind = 'before' AND src_grp > dst_grp) AS broken, coalesce(sum(weight) FILTER (WHERE kind = 'affinity'), 0) AS aff,
  coalesce(sum(weight) FILTER (WHERE kind = 'affinity' AND src_grp = dst_grp), 0) AS kept FROM eg GROUP BY cs_id),
  b AS (SELECT cs_id, unnest(range(1, max(grp))) AS boundary FROM members GROUP BY cs_id),
  k AS (SELECT b.cs_id, boundary, count(DISTINCT src || '|' || dst) AS pairs FROM b LEFT JOIN eg ON eg.cs_id = b.cs_id AND kind = 'before' AND weight >= 90 AND src_grp <= boundary AND dst_grp > boundary GROUP BY b.cs_id, boundary),
  a AS (SELECT cs_id, bool_and(pairs >= 2) AS strong FROM k GROUP BY cs_id),
  conf AS (SELECT n.cs_id, CASE WHEN s.cs_id IS NULL THEN 'low' WHEN groups > 1 AND NOT broken AND (aff = 0 OR kept >= 0.9 * aff) AND coalesce(strong, false) THEN 'high' ELSE 'medium' END AS confidence
  FROM n LEFT JOIN s ON s.cs_id = n.cs_id LEFT JOIN a ON a.cs_id = n.cs_id)"""


@query(f"WITH {WHOLE}, {M}, {EG}, {CONFIDENCE} SELECT * FROM conf")
def plan_confidence(spark, sf):
    u = adapters.units(spark, sf)
    return groups.confidence(adapters.kept_edges(spark, u, whole=True), _sliced(u))


SHOWN = "regexp_replace(regexp_replace(CAST(CAST({} AS DECIMAL(7, 2)) AS VARCHAR), '0+$', ''), '[.]$', '')"


@query(f"""WITH {P}, {SYMBOLS}, t AS (SELECT page_id, symbol, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '[^/]*/[^/]*$', '') || substr(symbol, 2) END AS target
  FROM paths JOIN symbols USING (page_id) WHERE symbol LIKE '/%') SELECT page_id, '..' || symbol AS module, target, CAST(CASE WHEN target IS NULL THEN 0 ELSE 14 END AS INTEGER) AS n FROM t""")
def import_targets(spark, sf):
    """Links of pages, taken relative to the folder above each page, as modules."""
    links = _symbols(spark, sf).where("symbol LIKE '/%'").join(adapters.paths(spark, sf), "page_id")
    found = links.select("page_id", F.concat(F.lit(".."), "symbol").alias("module"), paths.import_targets(F.col("path"), F.concat(F.lit(".."), "symbol")).alias("t"))
    return found.select("page_id", "module", F.get("t", F.lit(0)).alias("target"), F.size("t").alias("n"))


W_ = reports.WORDS


@query(f"""WITH {E}, {M}, {TOTALS}, {EG}, {TITLES}, {CONFIDENCE}, {METRICS},
  need AS (SELECT DISTINCT cs_id, dst_grp AS grp, src_grp AS g FROM eg WHERE kind = 'before' AND src_grp < dst_grp),
  md AS (SELECT cs_id, grp, string_agg('`slice-' || g || '`', ', ' ORDER BY g) AS needs FROM need GROUP BY cs_id, grp),
  mf AS (SELECT cs_id, grp, string_agg('- ' || file || chr(10), '' ORDER BY file) AS files FROM (SELECT DISTINCT cs_id, grp, file FROM units JOIN members USING (cs_id, unit_id)) x GROUP BY cs_id, grp),
  mg AS (SELECT t.cs_id, string_agg('### ' || t.grp || '. ' || title || chr(10) || chr(10) || 'ID: `slice-' || t.grp || '` · ' || t.files || ' file · +' || added || '/−' || deleted || chr(10) || chr(10) || 'Dipendenze: '
  || coalesce(needs, 'nessuna') || chr(10) || chr(10) || mf.files || chr(10) || '- ' || packages || ' package, ' || areas || ' aree' || chr(10) || chr(10), '' ORDER BY t.grp) AS body, count(*) AS n, sum(n_units) AS n_units
  FROM totals t JOIN titles a ON a.cs_id = t.cs_id AND a.grp = t.grp JOIN mf ON mf.cs_id = t.cs_id AND mf.grp = t.grp LEFT JOIN md ON md.cs_id = t.cs_id AND md.grp = t.grp GROUP BY t.cs_id),
  mk AS (SELECT cs_id, string_agg('| slice-' || grp || ' | reconstruction | passed |  |' || chr(10) || '| slice-' || grp || ' | semantic | ' || CASE WHEN all_tests THEN 'skipped | no types' ELSE 'passed | ' END || ' |' || chr(10), '' ORDER BY grp) AS checks,
  count(*) FILTER (WHERE all_tests) AS skipped, count(*) AS total FROM totals WHERE cs_id % 4 <> 0 GROUP BY cs_id),
  mc AS (SELECT cs_id, string_agg('- `candidate-' || grp || '`: ' || files || ' gruppi, costo ' || n_units || '.25.' || chr(10), '' ORDER BY grp) AS others FROM totals WHERE grp <= 2 GROUP BY cs_id),
  mw AS (SELECT cs_id, string_agg('- file ' || file || ': generated' || chr(10), '' ORDER BY file) AS limits FROM (SELECT DISTINCT cs_id, file FROM units WHERE is_generated) x GROUP BY cs_id),
  me AS (SELECT cs_id, count(*) AS n_edges FROM edges GROUP BY cs_id), mn AS (SELECT cs_id, count(DISTINCT file) AS n_files FROM units GROUP BY cs_id)
  SELECT mg.cs_id, '# Plan' || chr(10) || chr(10) || '**' || CASE WHEN mg.n > 1 THEN 'Suddivisione da verificare' ELSE 'Modifica singola' END || '**' || chr(10) || chr(10) || 'Base: `' || mg.cs_id || '`  ' || chr(10) || 'Head: `' || (mg.cs_id + 1) || '`'
  || chr(10) || chr(10) || '{W_["facts"]}' || chr(10) || chr(10) || '- ' || n_files || ' file, ' || mg.n_units || ' unità, ' || coalesce(n_edges, 0) || ' relazioni.' || chr(10) || '- Ricostruzione finale identica al tree head: `' || (2 * mg.cs_id) || '`.'
  || chr(10) || '- Analisi: deep.' || chr(10) || chr(10) || '{W_["groups"]}' || chr(10) || chr(10) || mg.body || '{W_["checks"]}' || chr(10) || chr(10) || CASE WHEN mk.cs_id IS NULL THEN 'Stato: **not-run** · livello: **reconstructed**' || chr(10) || chr(10)
  ELSE 'Stato: **passed** · livello: **semantic**' || chr(10) || chr(10) || '- {W_["passed_prefixes"]}' || total || '/' || total || chr(10) || '- {W_["own_checks"]}' || CASE mg.cs_id % 3 WHEN 0 THEN 'non configurati' WHEN 1 THEN '1 configurati (comandi eseguiti)'
  ELSE '2 configurati (comandi non eseguiti)' END || chr(10) || '- {W_["outcomes"]}passed ' || (2 * total - skipped) || ' · failed 0 · skipped ' || skipped || ' · timeout 0 · unavailable 0' || chr(10) || chr(10) END
  || '{W_["check_head"]}' || chr(10) || '|---|---|---|---|' || chr(10) || coalesce(checks, '{W_["no_checks"]}' || chr(10)) || chr(10) || '{W_["marks"]}' || chr(10) || chr(10) || '{W_["mark_head"]}' || chr(10) || '|---|---|' || chr(10)
  || '| Revisionabilità | ' || {SHOWN.format('reviewability')} || '/100 |' || chr(10) || '| Coesione strutturale | ' || {SHOWN.format('cohesion')} || '/100 |' || chr(10) || '| Integrità dipendenze | ' || {SHOWN.format('integrity')} || '/100 |' || chr(10)
  || '| Confidenza dei confini | ' || confidence || ' |' || chr(10) || chr(10) || '{W_["heuristic"]}' || chr(10) || chr(10) || '{W_["others"]}' || chr(10) || chr(10) || coalesce(others, '') || chr(10) || '{W_["limits"]}' || chr(10) || chr(10)
  || coalesce(limits, '') || chr(10) || '{W_["no_proof"]}' || chr(10) AS report
  FROM mg JOIN conf ON conf.cs_id = mg.cs_id JOIN metrics ON metrics.cs_id = mg.cs_id JOIN mn ON mn.cs_id = mg.cs_id LEFT JOIN me ON me.cs_id = mg.cs_id LEFT JOIN mk ON mk.cs_id = mg.cs_id LEFT JOIN mc ON mc.cs_id = mg.cs_id LEFT JOIN mw ON mw.cs_id = mg.cs_id""")
def markdown_reports(spark, sf):
    """The whole report of each change-set's plan."""
    return reports.markdown_report(*_reported(spark, sf))


def _reported(spark, sf: str) -> tuple[DataFrame, ...]:
    """Plans, groups, results, candidates and warnings; the last three follow from the groups' totals.

    Nothing is shuffled between these tables, so what they are made of is written: otherwise one task would hold the sorters of all their joins at once."""
    u = adapters.units(spark, sf)
    e, m = adapters.kept_edges(spark, u), _sliced(u)
    totals = bucketed(groups.group_totals(u, m), "totals", "cs_id")
    slice_id = lambda c: F.concat(F.lit("slice-"), c.cast("string"))
    files = u.join(m, ["cs_id", "unit_id"]).groupBy("cs_id", "grp").agg(F.transform(F.array_sort(F.collect_set("file")), lambda x: x.cast("string")).alias("names"))
    needs = groups.group_dependencies(e, m).select("cs_id", "grp", F.transform(F.split("depends_on", ","), slice_id).alias("depends_on"))
    g = totals.join(groups.titles(titled(u), m), ["cs_id", "grp"]).join(files, ["cs_id", "grp"]).join(needs, ["cs_id", "grp"], "left").select(
        "cs_id", "grp", slice_id(F.col("grp")).alias("group_id"), "title", "added", "deleted", F.col("names").alias("files"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"),
        F.array(F.format_string("%d package, %d aree", "packages", "areas")).alias("reasons"),
    )
    g = bucketed(g, "groups", "cs_id")
    one = lambda name, status, message: F.struct(F.lit(name).alias("name"), status.alias("status"), message.alias("message"))
    checks = F.array(one("reconstruction", F.lit("passed"), F.lit(None).cast("string")), one("semantic", F.when(F.col("all_tests"), "skipped").otherwise("passed"), F.when(F.col("all_tests"), "no types")))
    results = totals.where("cs_id % 4 <> 0").select("cs_id", "grp", slice_id(F.col("grp")).alias("group_id"), F.posexplode(checks).alias("pos", "c")).select("cs_id", "grp", "group_id", "pos", "c.*")
    others = totals.where("grp <= 2").select("cs_id", F.col("grp").alias("rank"), F.concat(F.lit("candidate-"), F.col("grp").cast("string")).alias("candidate_id"), F.col("files").alias("n_groups"), (F.col("n_units") + 0.25).alias("cost"))
    warnings = u.where("is_generated").select("cs_id", "file").distinct().select("cs_id", F.col("file").alias("pos"), F.format_string("file %d: generated", "file").alias("message"))
    run = F.col("cs_id") % 4 != 0
    plans = totals.groupBy("cs_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_units").alias("n_units"))
    plans = plans.join(u.groupBy("cs_id").agg(F.count_distinct("file").alias("n_files")), "cs_id").join(e.groupBy("cs_id").agg(F.count(F.lit(1)).alias("n_edges")), "cs_id", "left")
    marks = [bucketed(x, name, "cs_id") for name, x in (("confidence", groups.confidence(e, m)), ("metrics", groups.metrics(u, e, m)))]
    plans = plans.join(marks[0], "cs_id").join(marks[1], "cs_id").select(
        "cs_id", F.when(F.col("n") > 1, "split-unverified").otherwise("single-change").alias("status"), F.col("cs_id").cast("string").alias("base_oid"), (F.col("cs_id") + 1).cast("string").alias("head_oid"),
        (F.col("cs_id") * 2).cast("string").alias("tree_oid"), F.lit("deep").alias("mode"), "n_files", "n_units", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.when(run, "passed").otherwise("not-run").alias("verified"),
        F.when(run, "semantic").otherwise("reconstructed").alias("level"), F.col("n").alias("covered"), F.col("n").alias("total"), (F.col("cs_id") % 3).alias("commands"), (F.col("cs_id") % 3 == 1).alias("commands_run"),
        "reviewability", "cohesion", "integrity", "confidence",
    )
    return bucketed(plans, "plans", "cs_id"), g, results, others, warnings


@query(f"""WITH {E}, {M}, {TOTALS}, {EG}, {TITLES}, {CONFIDENCE}, {METRICS},
  need AS (SELECT DISTINCT cs_id, dst_grp AS grp, src_grp AS g FROM eg WHERE kind = 'before' AND src_grp < dst_grp),
  td AS (SELECT cs_id, grp, string_agg('slice-' || g, ', ' ORDER BY g) AS needs FROM need GROUP BY cs_id, grp),
  tg AS (SELECT t.cs_id, string_agg(t.grp || '. ' || title || ' [slice-' || t.grp || ']' || chr(10) || '   ' || t.files || ' file · +' || added || '/-' || deleted || ' · dipendenze: ' || coalesce(needs, 'nessuna') || chr(10)
    || '   ' || packages || ' package, ' || areas || ' aree' || chr(10) || CASE WHEN t.grp % 2 = 1 THEN '   second' || chr(10) || '   third\\u202e' || chr(10) ELSE '' END || chr(10), '' ORDER BY t.grp) AS body, count(*) AS n, sum(n_units) AS n_units
    FROM totals t JOIN titles a ON a.cs_id = t.cs_id AND a.grp = t.grp LEFT JOIN td ON td.cs_id = t.cs_id AND td.grp = t.grp GROUP BY t.cs_id),
  tk AS (SELECT cs_id, count(*) FILTER (WHERE all_tests) AS skipped, count(*) AS total FROM totals WHERE cs_id % 4 <> 0 GROUP BY cs_id),
  tw AS (SELECT cs_id, string_agg('- file ' || file || ': generated' || chr(10), '' ORDER BY file) AS limits FROM (SELECT DISTINCT cs_id, file FROM units WHERE is_generated) x GROUP BY cs_id),
  tn AS (SELECT cs_id, count(DISTINCT file) AS n_files FROM units GROUP BY cs_id)
  SELECT tg.cs_id, 'Plan · ' || CASE WHEN tg.n > 1 THEN 'Suddivisione da verificare' ELSE 'Modifica singola' END || chr(10) || n_files || ' file · ' || tg.n_units || ' unità · ' || tg.n || ' gruppi' || chr(10)
  || 'Ricostruzione finale: esatta (' || left((2 * tg.cs_id)::VARCHAR, 12) || ')' || chr(10) || CASE WHEN tk.cs_id IS NULL THEN 'Verifica: not-run · livello reconstructed' || chr(10)
  ELSE 'Verifica: passed · livello semantic' || chr(10) || '{W_["passed_prefixes"]}' || total || '/' || total || chr(10) || '{W_["own_checks"]}' || CASE tg.cs_id % 3 WHEN 0 THEN 'non configurati' WHEN 1 THEN '1 configurati (comandi eseguiti)'
  ELSE '2 configurati (comandi non eseguiti)' END || chr(10) || '{W_["outcomes"]}passed ' || (2 * total - skipped) || ' · failed 0 · skipped ' || skipped || ' · timeout 0 · unavailable 0' || chr(10) END || chr(10) || tg.body
  || 'Coesione: ' || {SHOWN.format('cohesion')} || '/100 · integrità dipendenze: ' || {SHOWN.format('integrity')} || '/100 · confidenza confini: ' || confidence || chr(10)
  || coalesce(chr(10) || 'Limiti e incertezze:' || chr(10) || limits, '') || CASE WHEN tk.cs_id IS NULL THEN chr(10) || 'Build e test non eseguiti. Usa verify; --run-checks abilita i comandi configurati.' || chr(10) ELSE '' END AS report
  FROM tg JOIN conf ON conf.cs_id = tg.cs_id JOIN metrics ON metrics.cs_id = tg.cs_id JOIN tn ON tn.cs_id = tg.cs_id LEFT JOIN tk ON tk.cs_id = tg.cs_id LEFT JOIN tw ON tw.cs_id = tg.cs_id""")
def terminal_report(spark, sf):
    """The terminal report of each change-set's plan; odd groups have four reasons, of which three are shown."""
    plans, g, results, _, warnings = _reported(spark, sf)
    more = F.when(F.col("grp") % 2 == 1, F.array(F.lit("second"), F.lit("third\u202e"), F.lit("fourth"))).otherwise(F.array().cast("array<string>"))
    return reports.terminal_report(plans, g.withColumn("reasons", F.concat("reasons", more)), results, warnings)


@query(f"""WITH RECURSIVE {E}, {M}, {TOTALS}, {EG}, {TITLES},
  cum AS (SELECT cs_id, grp, sum(added) OVER (PARTITION BY cs_id ORDER BY grp)::BIGINT AS c FROM totals),
  rounds AS (SELECT cs_id, list({{'e': grp, 'c': c}} ORDER BY grp) AS b, 0 AS k FROM cum GROUP BY cs_id
    UNION ALL SELECT cs_id, list_filter(b, lambda x: x.e <> b[f].e), k + 1 FROM (SELECT *, list_filter(range(1, len(b)), lambda i: (b[i].c + len(b)) % 3 = 0)[1] AS f FROM rounds) WHERE f IS NOT NULL),
  ends AS (SELECT cs_id, k, unnest(b).e AS last, generate_subscripts(b, 1) AS grp FROM rounds QUALIFY k = max(k) OVER (PARTITION BY cs_id)),
  spans AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY cs_id ORDER BY grp), 0) + 1 AS first FROM ends),
  parts AS (SELECT s.cs_id, s.grp, s.k, t.grp AS own, n_units, added, deleted, title FROM spans s JOIN totals t ON t.cs_id = s.cs_id AND t.grp BETWEEN first AND last JOIN titles a ON a.cs_id = t.cs_id AND a.grp = t.grp),
  need AS (SELECT d.cs_id, d.grp, count(DISTINCT s.grp) AS needs FROM (SELECT DISTINCT cs_id, dst_grp, src_grp FROM eg WHERE kind = 'before' AND src_grp < dst_grp) x
    JOIN parts d ON d.cs_id = x.cs_id AND d.own = x.dst_grp JOIN parts s ON s.cs_id = x.cs_id AND s.own = x.src_grp WHERE d.grp <> s.grp GROUP BY d.cs_id, d.grp)
  SELECT p.cs_id, p.grp::BIGINT AS grp, string_agg(title, ' + ' ORDER BY own) AS title, sum(n_units)::BIGINT AS n_units, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, k::INT AS repairs,
  coalesce(max(needs), 0)::INT AS needs, (count(*) - 1)::INT AS reasons FROM parts p LEFT JOIN need n ON n.cs_id = p.cs_id AND n.grp = p.grp GROUP BY p.cs_id, p.grp, k""")
def settled_plans(spark, sf):
    """Groups of each plan when no prefix but the last fails any more. Whether one fails depends on its lines and on how many groups the plan has, so merges make other prefixes fail."""
    u = adapters.units(spark, sf)
    e, m = adapters.edges(spark, u), _sliced(u)
    own = u.join(m, ["cs_id", "unit_id"]).groupBy("cs_id", "grp").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"), F.transform(F.array_sort(F.collect_set("file")), lambda x: x.cast("string")).alias("files"))
    slice_id = lambda c: F.concat(F.lit("slice-"), c.cast("string"))
    needs = groups.group_dependencies(e, m).select("cs_id", "grp", F.transform(F.split("depends_on", ","), slice_id).alias("depends_on"))
    none = F.array().cast("array<string>")
    g = groups.group_totals(u, m).select("cs_id", "grp", "added", "deleted").join(groups.titles(titled(u), m), ["cs_id", "grp"]).join(own, ["cs_id", "grp"]).join(needs, ["cs_id", "grp"], "left")
    g = g.withColumns({"group_id": slice_id(F.col("grp")), "depends_on": F.coalesce("depends_on", none), "reasons": none})

    def check(live):
        so_far = F.sum("added").over(W.partitionBy("cs_id").orderBy("grp"))
        n = F.count(F.lit(1)).over(W.partitionBy("cs_id"))
        return live.select("cs_id", "grp", ((so_far + n) % 3 == 0).alias("bad")).where("bad").select("cs_id", "grp")

    found = repairs.repaired(g, check)
    return found.select("cs_id", F.col("grp").cast("bigint").alias("grp"), "title", F.size("unit_ids").cast("bigint").alias("n_units"), "added", "deleted", "repairs", F.size("depends_on").alias("needs"), F.size("reasons").alias("reasons"))


@query(f"""WITH {E}, {M}, {TOTALS}, {EG}, {TITLES}, {CONFIDENCE}, {METRICS},
  c AS (SELECT m.cs_id, m.reviewability, m.cohesion, m.integrity, confidence, cs % 11 = 0 AS silent, reviewability + CASE WHEN cs % 5 = 0 THEN 0.01 ELSE 0 END AS r, CASE WHEN cs % 7 <> 0 THEN cohesion END AS h,
    CASE cs % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'certain' END AS k FROM (SELECT *, cs_id AS cs FROM metrics) m JOIN conf ON conf.cs_id = m.cs_id),
  v AS (SELECT *, list_position(['low', 'medium', 'high'], k) AS a, list_position(['low', 'medium', 'high'], confidence) AS b FROM c)
  SELECT cs_id, unnest(list_filter([CASE WHEN silent OR r IS DISTINCT FROM reviewability THEN 'reviewability-differs' END, CASE WHEN silent OR h IS DISTINCT FROM cohesion THEN 'cohesion-differs' END,
    CASE WHEN silent THEN 'integrity-differs' END, CASE WHEN silent OR coalesce(a, 0) = 0 OR a > b THEN 'confidence-above-evidence' END], lambda x: x IS NOT NULL)) AS rule, cs_id::VARCHAR AS item FROM v""")
def metric_violations(spark, sf):
    """Claimed metrics and confidence that what is derived doesn't bear out; every eleventh plan claims nothing."""
    u = adapters.units(spark, sf)
    e, m = adapters.kept_edges(spark, u), _sliced(u)
    derived = bucketed(groups.metrics(u, e, m).join(groups.confidence(e, m), "cs_id"), "derived", "cs_id")
    n = F.col("cs_id")
    claims = derived.where(n % 11 != 0).select(
        "cs_id", (F.col("reviewability") + F.when(n % 5 == 0, 0.01).otherwise(0.0)).alias("reviewability"), F.when(n % 7 != 0, F.col("cohesion")).alias("cohesion"), "integrity",
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "certain"))), (n % 4 + 1).cast("int")).alias("confidence"),
    )
    return validation.metric_rules(claims, derived)
