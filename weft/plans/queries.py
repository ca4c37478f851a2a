"""Registered queries over the change-set adapter views, and their SQL.

Groups in most queries are a fixed slicing of each change-set (position modulo 5), so that the oracle can say the same; the
planner's own groups are checked by what must hold for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import identity, paths
from weft.operators import checks, edgerules, groups, hunks, planner
from weft.operators.components import connected_components
from weft.sources import adapters
from weft.session import table
from weft.streaming.maintain import windowed_counts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sliced(units: DataFrame) -> DataFrame:
    return units.select("cs_id", "unit_id", (F.pmod(F.col("pos") - 1, F.lit(5)) + 1).alias("grp"))


U, E, P = adapters.WITH_UNITS, adapters.WITH_EDGES, adapters.WITH_PATHS
WHOLE = adapters.WITH_WHOLE_EDGES
M = "members AS (SELECT cs_id, unit_id, (pos - 1) % 5 + 1 AS grp FROM units)"
TOTALS = """totals AS (SELECT cs_id, grp, count(*) AS n_units, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted,
  CAST(sum(CASE WHEN is_generated THEN 0 ELSE added + deleted END) AS BIGINT) AS review_lines, count(DISTINCT file) AS files,
  count(DISTINCT package) AS packages, count(DISTINCT area) AS areas, bool_and(is_test) AS all_tests
  FROM units JOIN members USING (cs_id, unit_id) GROUP BY cs_id, grp)"""
EG = """eg AS (SELECT e.*, a.grp AS src_grp, b.grp AS dst_grp FROM edges e JOIN members a ON a.cs_id = e.cs_id AND a.unit_id = e.src
  JOIN members b ON b.cs_id = e.cs_id AND b.unit_id = e.dst)"""


@query(f"WITH {U} SELECT * FROM units")
def units(spark, sf):
    return adapters.units(spark, sf)


@query(f"WITH {E} SELECT * FROM edges")
def edges(spark, sf):
    return adapters.edges(spark, adapters.units(spark, sf))


@query(f"WITH {U}, {M}, {TOTALS} SELECT * FROM totals")
def group_totals(spark, sf):
    u = adapters.units(spark, sf)
    return groups.group_totals(u, _sliced(u))


@query(f"""WITH {E}, {M}, {TOTALS}, {EG}, v AS (SELECT cs_id, count(*) FILTER (WHERE kind = 'must_with' AND src_grp <> dst_grp) AS hard_cuts,
  count(*) FILTER (WHERE kind = 'before' AND src_grp > dst_grp) AS inversions FROM eg GROUP BY cs_id)
  SELECT t.cs_id, grp, n_units, added, deleted, review_lines, files, coalesce(hard_cuts, 0) AS hard_cuts, coalesce(inversions, 0) AS inversions
  FROM totals t LEFT JOIN v ON v.cs_id = t.cs_id""")
def group_report(spark, sf):
    """Flagship: every group's totals with its change-set's violated constraints."""
    u = adapters.units(spark, sf)
    m = _sliced(u)
    v = groups.violations(adapters.edges(spark, u), m)
    return groups.group_totals(u, m).join(v, "cs_id", "left").select(
        "cs_id", "grp", "n_units", "added", "deleted", "review_lines", "files", F.coalesce("hard_cuts", F.lit(0)).alias("hard_cuts"), F.coalesce("inversions", F.lit(0)).alias("inversions")
    )


@query(f"""WITH {E}, {M}, {EG} SELECT cs_id, grp, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS depends_on
  FROM (SELECT DISTINCT cs_id, dst_grp AS grp, src_grp AS g FROM eg WHERE kind = 'before' AND src_grp < dst_grp) x GROUP BY cs_id, grp""")
def group_dependencies(spark, sf):
    u = adapters.units(spark, sf)
    return groups.group_dependencies(adapters.edges(spark, u), _sliced(u))


@query(f"""WITH {WHOLE}, p AS (SELECT e.cs_id, e.kind, CASE e.kind WHEN 'must_with' THEN 0.0 WHEN 'before' THEN 0.1 * weight
  ELSE (CASE WHEN a.is_test <> b.is_test THEN 0.8 ELSE 0.4 END) * weight END AS x
  FROM edges e JOIN units a ON a.cs_id = e.cs_id AND a.unit_id = e.src JOIN units b ON b.cs_id = e.cs_id AND b.unit_id = e.dst)
  SELECT cs_id, kind, count(*) AS n, CAST(sum(CAST(floor(10 * x + 0.5) AS BIGINT)) AS BIGINT) AS penalty_tenths FROM p GROUP BY cs_id, kind""")
def edge_penalties(spark, sf):
    """Of all pairs; those of large change-sets are summed apart, as no change-set has affinities in both parts."""
    u = adapters.units(spark, sf)
    return groups.edge_penalties(u, adapters.edges(spark, u, large=False)).unionByName(groups.edge_penalties(u, adapters.large_edges(u)))


COST = """costs AS (SELECT cs_id, grp, CAST(floor(1000 * (8 + 35 * pow(greatest(0.0, CAST(review_lines AS DOUBLE) / 350 - 1), 2)
  + 10 * greatest(0.0, 0.25 - CAST(review_lines AS DOUBLE) / 350) + 12 * pow(greatest(0.0, CAST(files AS DOUBLE) / 12 - 1), 2)
  + 18 * greatest(0.0, CAST(packages - 1 AS DOUBLE)) + 24 * greatest(0.0, CAST(areas - 1 AS DOUBLE))) + 0.5) AS BIGINT) AS cost_thousandths,
  (added + deleted > 800 OR files > 30) AS infeasible FROM totals)"""


@query(f"WITH {U}, {M}, {TOTALS}, {COST} SELECT * FROM costs")
def group_costs(spark, sf):
    return groups.group_costs(group_totals(spark, sf))


@query(f"""WITH {U}, {M}, {TOTALS}, {COST} SELECT cs_id, grp, cost_thousandths, infeasible, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY cs_id ORDER BY cost_thousandths, grp) AS rank FROM costs) r WHERE rank <= 3""")
def cheapest_groups(spark, sf):
    return planner.rank_by_cost(groups.group_costs(group_totals(spark, sf)), 3)


@query(f"""WITH {U}, {M}, {TOTALS} SELECT cs_id, grp, CAST(sum(n_units) OVER w AS BIGINT) AS units_so_far, CAST(sum(added + deleted) OVER w AS BIGINT) AS lines_so_far
  FROM totals WINDOW w AS (PARTITION BY cs_id ORDER BY grp ROWS UNBOUNDED PRECEDING)""")
def group_prefixes(spark, sf):
    return groups.prefixes(group_totals(spark, sf))


TITLES = """titles AS (SELECT cs_id, grp, substr(CASE WHEN bool_and(is_generated) THEN 'Aggiungi' WHEN bool_and(is_test) THEN 'Aggiorna i test di' ELSE 'Aggiorna' END || ' '
  || CASE WHEN count(DISTINCT area) = 1 THEN min(area) WHEN count(DISTINCT package) = 1 THEN CAST(min(package) AS VARCHAR) ELSE min(CAST(file AS VARCHAR)) END
  || CASE WHEN count(DISTINCT file) > 1 THEN ' (' || count(DISTINCT file) || ' file)' ELSE '' END, 1, 160) AS title FROM units JOIN members USING (cs_id, unit_id) GROUP BY cs_id, grp)"""


def titled(units: DataFrame) -> DataFrame:
    """Units with a kind of change: those whose rows are all final count as added."""
    return units.withColumn("change_kind", F.when(F.col("is_generated"), "add").otherwise("modify"))


@query(f"WITH {U}, {M}, {TITLES} SELECT * FROM titles")
def group_titles(spark, sf):
    u = adapters.units(spark, sf)
    return groups.titles(titled(u), _sliced(u))


METRICS = """r AS (SELECT cs_id, floor(sum(floor(least(1.0, 350.0 / greatest(1, review_lines), 12.0 / greatest(1, files)) * 1000000 + 0.5)) / 1000000 / count(*) * 10000 + 0.5) / 100 AS reviewability FROM totals GROUP BY cs_id),
  ms AS (SELECT cs_id, sum(weight) FILTER (WHERE kind = 'affinity') AS aff, sum(weight) FILTER (WHERE kind = 'affinity' AND src_grp = dst_grp) AS kept,
  count(*) FILTER (WHERE kind <> 'affinity') AS hard, count(*) FILTER (WHERE kind = 'must_with' AND src_grp = dst_grp OR kind = 'before' AND src_grp <= dst_grp) AS ok FROM eg GROUP BY cs_id),
  metrics AS (SELECT r.cs_id, reviewability, CASE WHEN coalesce(aff, 0) = 0 THEN 100.0 ELSE floor(CAST(coalesce(kept, 0) AS DOUBLE) / aff * 10000 + 0.5) / 100 END AS cohesion,
  CASE WHEN coalesce(hard, 0) = 0 THEN 100.0 ELSE floor(CAST(ok AS DOUBLE) / hard * 10000 + 0.5) / 100 END AS integrity FROM r LEFT JOIN ms ON ms.cs_id = r.cs_id)"""


@query(f"WITH {E}, {M}, {TOTALS}, {EG}, {METRICS} SELECT * FROM metrics")
def plan_metrics(spark, sf):
    u = adapters.units(spark, sf)
    return groups.metrics(u, adapters.edges(spark, u), _sliced(u))


@query(f"""WITH {E}, {M}, {EG}, last AS (SELECT cs_id, max(grp) AS last FROM members GROUP BY cs_id),
  b AS (SELECT cs_id, unnest(range(1, last)) AS boundary FROM last),
  c AS (SELECT b.cs_id, b.boundary, count(DISTINCT eg.src || '|' || eg.dst) AS pairs FROM b LEFT JOIN eg
  ON eg.cs_id = b.cs_id AND kind = 'before' AND weight >= 90 AND src_grp <= boundary AND dst_grp > boundary GROUP BY b.cs_id, b.boundary)
  SELECT cs_id, min(pairs) AS least_pairs, bool_and(pairs >= 2) AS all_strong FROM c GROUP BY cs_id""")
def strong_boundaries(spark, sf):
    u = adapters.units(spark, sf)
    m = _sliced(u)
    return groups.strong_boundaries(adapters.edges(spark, u), m, m)


@query(f"""WITH {U} SELECT cs_id, unit_id, lag(pos, 1, 0) OVER (PARTITION BY cs_id, package ORDER BY pos) AS prev_package,
  lag(pos, 1, 0) OVER (PARTITION BY cs_id, area ORDER BY pos) AS prev_area FROM units""")
def previous_occurrences(spark, sf):
    return groups.previous_occurrences(adapters.units(spark, sf))


@query(f"""WITH {U} SELECT cs_id, unit_id, lag(unit_id) OVER w AS before, lead(unit_id) OVER w AS after FROM units
  WINDOW w AS (PARTITION BY cs_id, area ORDER BY unit_id)""")
def area_neighbours(spark, sf):
    return groups.neighbours(adapters.units(spark, sf))


@query(f"""WITH RECURSIVE {E}, pairs AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'must_with' UNION SELECT dst, src FROM edges WHERE kind = 'must_with'),
  reach AS (SELECT a, a AS b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b) SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def hard_components(spark, sf):
    """Components of units that must stay together (unit ids are unique over all change-sets)."""
    e = adapters.edges(spark, adapters.units(spark, sf)).where("kind = 'must_with'")
    return connected_components(e.select("src", "dst"))


REACH = """arcs AS (SELECT cs_id, src AS a, dst AS b FROM edges WHERE kind IN ('must_with', 'before') UNION SELECT cs_id, dst, src FROM edges WHERE kind = 'must_with'),
  reach AS (SELECT cs_id, unit_id AS a, unit_id AS b FROM units UNION SELECT r.cs_id, r.a, x.b FROM reach r JOIN arcs x ON x.cs_id = r.cs_id AND x.a = r.b),
  comps AS (SELECT r.cs_id, r.a AS unit_id, min(r.b) AS component FROM reach r JOIN reach s ON s.cs_id = r.cs_id AND s.a = r.b AND s.b = r.a GROUP BY r.cs_id, r.a)"""


@query(f"WITH RECURSIVE {E}, {REACH} SELECT * FROM comps")
def condensed_units(spark, sf):
    """The component of each unit after hard edges and cycles are joined: in SQL, the least of the units that reach each other."""
    u = adapters.units(spark, sf)
    return planner.condensed(u, adapters.kept_edges(spark, u))


@query(f"""WITH RECURSIVE {E}, {REACH} SELECT cs_id, CAST(mode AS INTEGER) AS mode, count(DISTINCT component) AS n, CAST(0 AS INTEGER) AS least, CAST(count(DISTINCT component) - 1 AS INTEGER) AS most,
  CAST(0 AS BIGINT) AS backward, CAST(0 AS BIGINT) AS unforced FROM comps, range(3) AS t(mode) GROUP BY cs_id, mode""")
def component_orders(spark, sf):
    """What must hold for the three orders of each change-set's components: all places taken, no pair backward, no lesser key later than it must be. (Equal orders are worked out once and named here again.)"""
    u = adapters.units(spark, sf)
    e = adapters.kept_edges(spark, u)
    members = planner.kept(planner.condensed(u, e), "members", dealt=False)
    rows, before = planner.kept(planner.component_rows(u, members), "components"), planner.kept(planner.arcs(e, members), "arcs")
    faults = planner.kept(planner.order_faults(rows, before, planner.kept(planner.placed(planner.orders(rows, before)), "places")), "faults")
    every = faults.select("cs_id").distinct().select("cs_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("mode"))
    first = faults.where("mode = 0").drop("mode")
    own = every.join(faults, ["cs_id", "mode"], "left_anti").join(first, "cs_id").select(faults.columns)
    return faults.unionByName(own)


@query(f"""WITH {E}, u AS (SELECT cs_id, count(*) AS n_units FROM units GROUP BY cs_id) SELECT cs_id, n_units, n_units AS covered, CAST(0 AS BIGINT) AS hard_cuts, CAST(0 AS BIGINT) AS inversions,
  CAST(0 AS BIGINT) AS over_limits, true AS few, true AS ascending FROM u""")
def plan_candidates(spark, sf):
    """What must hold for the plans of each change-set: the first one covers each unit once, cuts no hard edge, inverts no ordered one and keeps the limits unless
    it says that it can't; there are five at most, in order of cost."""
    u = adapters.units(spark, sf)
    e = adapters.kept_edges(spark, u)
    found = planner.kept(planner.candidates(u, e), "candidates", dealt=False)
    m = planner.kept(planner.best_membership(found), "membership")
    covered = m.groupBy("cs_id").agg(F.count_distinct("unit_id").alias("covered"), F.count(F.lit(1)).alias("_rows"))
    broken = groups.violations(e, m)
    status = found.where("rank = 1").select("cs_id", "status")
    over = groups.group_costs(groups.group_totals(u, m)).join(status, "cs_id").groupBy("cs_id").agg(F.count_if(F.col("infeasible") & (F.col("status") != "cannot-safely-split")).alias("over_limits"))
    cheaper = F.col("cost") < F.lag("cost").over(W.partitionBy("cs_id").orderBy("rank"))
    listed = found.withColumn("_c", cheaper).groupBy("cs_id").agg((F.count(F.lit(1)) <= planner.TOP).alias("few"), (~F.coalesce(F.bool_or("_c"), F.lit(False))).alias("ascending"))
    n = u.groupBy("cs_id").agg(F.count(F.lit(1)).alias("n_units"))
    every = n.join(covered.where("covered = _rows"), "cs_id", "left").join(broken, "cs_id", "left").join(over, "cs_id", "left").join(listed, "cs_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.select("cs_id", "n_units", "covered", zero("hard_cuts"), zero("inversions"), zero("over_limits"), "few", "ascending")


@query(f"""WITH {WHOLE} SELECT cs_id, src, dst, kind, weight, 'edge_' || substr(sha256('"' || src || ':' || dst || ':' || kind || '"'), 1, 16) AS edge_id FROM edges""")
def edge_ids(spark, sf):
    e = adapters.whole_edges(spark, adapters.units(spark, sf))
    return e.withColumn("edge_id", identity.edge_id(F.col("src"), F.col("dst"), F.col("kind")))


SYMBOLS = "symbols AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS symbol FROM pages)"


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("symbol")).distinct()


@query(f"WITH {SYMBOLS} SELECT symbol, count(DISTINCT page_id) AS pages, min(page_id) AS first_page, max(page_id) AS last_page FROM symbols GROUP BY symbol")
def symbol_index(spark, sf):
    return edgerules.shared_symbols(_symbols(spark, sf))


@query(f"""WITH {SYMBOLS}, p AS (SELECT page_id, CAST(page_id % 10 AS BIGINT) AS cs_id, symbol, page_id % 2 = 0 AS old FROM symbols),
  d AS (SELECT cs_id, symbol, min(page_id) AS p FROM p GROUP BY cs_id, symbol)
  SELECT DISTINCT d.cs_id, CAST(d.p AS VARCHAR) AS src, CAST(p.page_id AS VARCHAR) AS dst, 'before' AS kind, 95 AS weight, 'new-symbol-reference' AS evidence
  FROM d JOIN p ON p.cs_id = d.cs_id AND p.symbol = d.symbol AND p.page_id <> d.p""")
def symbol_edges(spark, sf):
    """The first page of a change-set (page_id modulo 10) that names a symbol introduces it; the others refer to it."""
    s = _symbols(spark, sf).select(F.pmod("page_id", F.lit(10)).alias("cs_id"), F.col("page_id").cast("string").alias("unit_id"), "symbol", F.lit("new").alias("side"))
    d = s.groupBy("cs_id", "symbol").agg(F.min(F.col("unit_id").cast("bigint")).cast("string").alias("unit_id")).withColumn("side", F.lit("new")).withColumn("signature", F.lit("s"))
    return edgerules.symbol_rules(d, s).distinct()


@query(f"WITH {U}, {adapters.RANKED}, {adapters.NEAR.format(limit=30)} SELECT cs_id, src, dst, 'affinity' AS kind, max(weight) AS weight, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM places GROUP BY cs_id, src, dst")
def place_edges(spark, sf):
    """With all pairs in change-sets of up to 30 units and neighbours in larger ones, so that both ways are met."""
    merged = groups.merge_edges(edgerules.place_rules(adapters.units(spark, sf), dense_units=30))
    return merged.withColumn("evidence", F.array_join("evidence", ","))


@query(f"""WITH {P}, parts AS (SELECT page_id, string_split(path, '/') AS p FROM paths)
  SELECT page_id, array_to_string(p[1:i], '/') AS folder, CAST(i AS INTEGER) AS depth FROM parts, unnest(range(0, len(p))) AS t(i)""")
def path_ancestors(spark, sf):
    p = adapters.paths(spark, sf)
    return p.select("page_id", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "folder"))


GLOBS = [("english", ["en/**"]), ("short", ["*/?", "*/??"]), ("romance", ["fr/*", "es/**/*"])]


@query(f"""WITH {P} SELECT page_id, path, CASE WHEN regexp_matches(path, '^en/.*$') THEN 'english' WHEN regexp_matches(path, '^[^/]*/[^/]{{1,2}}$') THEN 'short'
  WHEN regexp_matches(path, '^(fr/[^/]*|es/(.*/)?[^/]*)$') THEN 'romance' END AS area FROM paths""")
def path_areas(spark, sf):
    p = adapters.paths(spark, sf)
    return p.withColumn("area", paths.first_area(F.col("path"), GLOBS))


@query(f"""WITH {P} SELECT page_id, NOT (path LIKE '%\\%' OR regexp_matches(path, '^[A-Za-z]:') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..') OR lower(x) = '.git')) > 0) AS safe FROM paths""")
def path_safety(spark, sf):
    return adapters.paths(spark, sf).select("page_id", paths.is_safe(F.col("path")).alias("safe"))


@query(f"""WITH {P}, own AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS folder, min(page_id) AS owner FROM paths GROUP BY 1 HAVING min(page_id) % 3 <> 0 OR folder = ''),
  up AS (SELECT page_id, folder, owner, row_number() OVER (PARTITION BY page_id ORDER BY length(folder) DESC) AS r FROM paths JOIN own ON folder = '' OR starts_with(path, folder || '/'))
  SELECT page_id, folder, owner FROM up WHERE r = 1""")
def nearest_owner(spark, sf):
    """The nearest folder above each page that has an owner: a join on all ancestors, the longest kept. A folder's owner is its page with the least id; where that is divisible by three it has none."""
    p = adapters.paths(spark, sf)
    own = p.select(F.element_at(paths.ancestors(F.col("path")), -1).alias("folder"), "page_id").groupBy("folder").agg(F.min("page_id").alias("owner")).where("owner % 3 <> 0 OR folder = ''")
    up = p.select("page_id", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "folder"))
    return up.join(own, "folder").groupBy("page_id").agg(F.max_by(F.struct("folder", "owner"), "depth").alias("x")).select("page_id", "x.folder", "x.owner")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("base")).join(d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("head")), "id")


@query("""WITH s AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents)
  UNION ALL SELECT doc_id - 1, unnest(string_split(text, chr(10))), 1 FROM documents WHERE doc_id > (SELECT min(doc_id) FROM documents)),
  net AS (SELECT id, line, sum(n) AS n FROM s GROUP BY id, line)
  SELECT id, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS deleted FROM net GROUP BY id""")
def line_delta(spark, sf):
    return hunks.line_delta(_pairs(spark, sf))


@query("""SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0)) || encode(text)) AS oid,
  CASE WHEN octet_length(encode(text)) > 400 OR contains(text, 'Z') THEN 'binary' ELSE 'text' END AS kind FROM documents""")
def blob_ids(spark, sf):
    """Ids and kinds of the documents as contents; for the kind, a limit of 400 bytes stands for the real one and Z for the NUL that these texts don't have."""
    d = table(spark, sf, "documents")
    content = F.encode(F.replace("text", F.lit("Z"), F.lit("\0")), "UTF-8")
    return d.select("doc_id", identity.blob_oid(F.col("text")).alias("oid"), hunks.text_kind(content, 400).alias("kind"))


RESULTS = "results AS (SELECT cs_id, unit_id, (pos - 1) % 5 + 1 AS grp, CASE WHEN added > 49 THEN 'failed' WHEN deleted > 3 THEN 'skipped' ELSE 'passed' END AS status FROM units)"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    u = adapters.units(spark, sf)
    status = F.when(F.col("added") > 49, "failed").when(F.col("deleted") > 3, "skipped").otherwise("passed")
    return u.select("cs_id", (F.pmod(F.col("pos") - 1, F.lit(5)) + 1).alias("grp"), status.alias("status"))


@query(f"""WITH {U}, {RESULTS} SELECT cs_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'passed') THEN 'passed' ELSE 'partial' END AS state,
  count(*) FILTER (WHERE status = 'passed') AS passed, count(*) AS total FROM results GROUP BY cs_id""")
def check_rollup(spark, sf):
    return checks.status_rollup(_results(spark, sf))


@query(f"WITH {U}, {RESULTS} SELECT status, count(*) AS n FROM results GROUP BY status")
def check_outcomes(spark, sf):
    return checks.outcomes(_results(spark, sf))


@query(f"""WITH {U}, {RESULTS}, bad AS (SELECT cs_id, grp, bool_or(status = 'failed') AS bad FROM results GROUP BY cs_id, grp)
  SELECT cs_id, grp, CAST(row_number() OVER w - coalesce(sum(CAST(bad AS INTEGER)) OVER (PARTITION BY cs_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS merged_grp
  FROM bad WINDOW w AS (PARTITION BY cs_id ORDER BY grp)""")
def repaired_groups(spark, sf):
    return checks.repair(_results(spark, sf))


@query(f"""WITH {E}, {M} SELECT e.cs_id, m.grp, e.src, e.dst, e.kind, e.weight FROM edges e JOIN members m ON m.cs_id = e.cs_id AND m.unit_id = e.src
  UNION SELECT e.cs_id, m.grp, e.src, e.dst, e.kind, e.weight FROM edges e JOIN members m ON m.cs_id = e.cs_id AND m.unit_id = e.dst""")
def incident_edges(spark, sf):
    u = adapters.units(spark, sf)
    return checks.incident_edges(adapters.edges(spark, u), _sliced(u))


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(floor(value * 100 + 0.5)) AS BIGINT) AS value_cents
  FROM events GROUP BY 1, 2""")
def event_windows(spark, sf):
    return windowed_counts(table(spark, sf, "events"))


FLAGSHIP = group_report
