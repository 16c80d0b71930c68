"""Queries of the profile, reshaping and report operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.functions.scalars import safe_name
from kmerloom.operators import composite, distance, reports, training
from kmerloom.plans import genomes_sql as sql
from kmerloom.plans.genomes import K, asked, keys_of, records_of, rounded
from kmerloom.plans.tables import table
from kmerloom.session import Scratch


def _composed(spark: SparkSession, folder: str) -> DataFrame:
    keys = keys_of(spark, folder)
    return composite.composition(asked(keys), keys)


def _lineages(spark: SparkSession, folder: str) -> DataFrame:
    """(r, line): a lineage of every listed genome, made of its smallest taxid that isn't 0."""
    taxa = table(spark, folder, "genomes").groupBy(F.col("genome_id").cast("bigint").alias("r")).agg(F.min(F.when(F.col("taxid") != 0, F.col("taxid"))).alias("t"))
    return taxa.where("t is not null").select("r", F.format_string("d__Archive; f__F%d; s__S%d x", F.pmod("t", F.lit(7)), "t").alias("line"))


def _depths(spark: SparkSession, folder: str) -> DataFrame:
    rows = _composed(spark, folder).withColumn("depth", reports.depth_by_steps(F.col("pct98_99"), F.col("median"), F.col("shared"), least_shared=6))
    return rows.where("depth is not null").join(_lineages(spark, folder), "r")


def profile_steps(spark, folder):
    """Depths by thresholds, with each sample's shares."""
    rows = _composed(spark, folder).withColumn("depth", reports.depth_by_steps(F.col("pct98_99"), F.col("median"), F.col("shared")))
    return rounded(reports.relative_abundance(rows, "q", "depth").select("q", "r", "depth", "percentage"), "depth", "percentage")


def profile_table(spark, folder):
    rows = _composed(spark, folder).select("q", "r", reports.depth_by_table(F.col("pct98_99"), F.col("shared")).alias("depth"))
    return rounded(rows, "depth")


def profile_offset(spark, folder):
    rows = _composed(spark, folder).select("q", "r", reports.depth_by_offset(F.col("pct98_99"), F.col("shared"), least_shared=8).alias("depth"))
    return rounded(rows, "depth")


def profile_lineage(spark, folder):
    return rounded(reports.lineage_profile(_depths(spark, folder), "q", "line", "depth"), "value")


def profile_krona(spark, folder):
    return reports.krona_rows(_depths(spark, folder), "q", "line", "depth")


def species_names(spark, folder):
    return _lineages(spark, folder).select("r", reports.species_of(F.col("line")).alias("species"))


def composition_ranked(spark, folder):
    """A sample's references by shared keys, most first."""
    return composite.ranked(_composed(spark, folder)).select("q", "r", "shared", "place")


def metadata_joined(spark, folder):
    """Reported pairs with the listed names of the query's genome, ``NA`` where none is listed."""
    pairs = table(spark, folder, "group_dist").select("x_id", "y_id", "xny_ctx")
    listed = table(spark, folder, "genomes").where("taxid <> 0").select(F.col("taxid").alias("x_id"), "taxname", "name")
    return reports.with_metadata(pairs, listed, "x_id")


def rows_of_listed(spark, folder):
    """Sequence records of genomes that are listed with a taxid."""
    wanted = table(spark, folder, "genomes").where("taxid <> 0").select("genome_id")
    return reports.subset(table(spark, folder, "command_sketch").select("rec_id", "genome_id", "len"), wanted, "genome_id")


def ordered_lookup(spark, folder):
    wanted = table(spark, folder, "command_sketch").where("rec_id is not null").select("rec_id", F.col("genome_id").cast("bigint").alias("genome_id")).distinct()
    listed = table(spark, folder, "genomes").where("genome_id < 100000").select(F.col("genome_id").cast("bigint").alias("genome_id"), F.coalesce("taxname", F.lit("?")).alias("taxname"))
    return reports.ordered_subset(wanted, "rec_id", listed, "genome_id", "taxname").drop("__k")


def _square(spark, folder):
    """The matrix of all genomes that are asked."""
    keys = asked(keys_of(spark, folder))
    pairs = distance.similarities(distance.sized_overlaps(keys, keys), K)
    return distance.full_matrix(pairs, keys, keys, "jaccard", missing=0.0)


def matrix_symmetric(spark, folder):
    return rounded(distance.symmetric(_square(spark, folder).where("r < q"), diagonal=1.0), "value")


def phylip(spark, folder):
    long = _square(spark, folder)
    order = reports.labelled(long, "q", "q").select("q", F.col("index").cast("int").alias("place"))
    return reports.phylip_rows(long, order)


def placement_edges(spark, folder):
    """Edge numbers out of placement files, one a record, whose text is put together from the table."""
    rows = table(spark, folder, "command_sketch").where("rec_id is not null and genome_id is not null").select("rec_id", "genome_id").distinct()
    text = F.format_string('{"fields": ["likelihood", "edge_num"], "placements": [{"n": ["rec%d", "other"], "p": [[0.5, %d], [-1.25, 7]]}]}', "rec_id", "genome_id")
    return reports.placements(rows.select(text.alias("text")), "text")


def labelled_taxa(spark, folder):
    """A running number over taxids in the order of their first genome."""
    return reports.labelled(table(spark, folder, "genomes").where("taxid is not null"), "taxid", "genome_id")


def error_model(spark, folder):
    """The error model's coefficient for the records' lengths, weighted by their k-mers."""
    lengths = records_of(spark, folder).select(F.length("seq").cast("double").alias("n")).where("n >= 28")
    rows = lengths.select((F.col("n") - 27).alias("weight"), reports.read_alpha(F.col("n"), 16.364969175, 15.7789105059).alias("alpha"))
    return rounded(reports.weighted_alpha(rows, "weight", "alpha"), "alpha")


def safe_names(spark, folder):
    return table(spark, folder, "genomes").select("genome_id", safe_name(F.col("name")).alias("name"))


def species_depths(spark, folder):
    """Depths by thresholds summed at every ranked ancestor of the reference's taxon, as shares of the sample."""
    return rounded(_depths(spark, folder).groupBy("q", "line").agg(F.sum("depth").alias("depth"), F.count("*").alias("refs")), "depth")


def selection_labels(spark, folder):
    """Labels of the listed names, once in full and once without one species."""
    rows = table(spark, folder, "genomes").select("genome_id", "name", "taxid").where(F.col("name").rlike("[A-Z]{3}_[0-9]+")).groupBy("genome_id").agg(F.min("name").alias("name"), F.min("taxid").alias("taxid"))
    species = rows.where("taxid is not null").select(F.regexp_extract("name", "([A-Z]{3}_[0-9]+)", 1).alias("accession"), F.format_string("S %d", F.pmod("taxid", F.lit(3))).alias("species"))
    files = rows.select(F.col("genome_id").cast("bigint").alias("place"), "name")
    out = [reports.selection_labels(files, species, wanted, "([A-Z]{3}_[0-9]+)").withColumn("way", F.lit(way)) for way, wanted in (("all", None), ("only", "S_1"), ("without", "^S_1"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def renamed_trees(spark, folder):
    """Trees of code names, one a record, with the codes of up to 500 taxa replaced."""
    rows = table(spark, folder, "command_sketch").where("rec_id is not null").select("rec_id").distinct()
    code = lambda n: F.format_string("Species%03d", F.pmod(n, F.lit(1000)))
    trees = rows.select("rec_id", F.concat(F.lit("(("), code(F.col("rec_id")), F.lit(":0.1,"), code(F.col("rec_id") * 7), F.lit("):0.25,x:1);")).alias("tree"))
    names = spark.range(0, 1000, 2).select(code(F.col("id")).alias("code"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    return reports.renamed_tree(trees, "rec_id", "tree", names)


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold-standard comparisons with an identity above 0.8 and aligned fractions above 0.1, all as fractions."""
    fraction = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0), F.when(F.col(c) > 1, F.col(c) / 100).otherwise(F.col(c)))
    rows = table(spark, folder, "ani_pairs").withColumns({c: fraction(c) for c in ("anim", "qry_align_fraction", "ref_align_fraction")})
    return rows.where("anim > 0.8 and qry_align_fraction > 0.1 and ref_align_fraction > 0.1 and xny_ctx > 0 and n_diff_obj >= 0 and n_diff_obj_section >= 0 and n_mut2_ctx >= 0")


def trained_regression(spark, folder):
    """The regression fitted to all gold-standard comparisons: rows, and whether it explains more than their mean does."""
    rows = Scratch(spark, "gold").keep(_gold(spark, folder), "rows")
    model = training.train_regression(rows, 1 - F.col("anim"), sample_rows=5000, rounds=200)
    error = 1 - F.col("anim") - training.predicted(rows, model)
    return rows.agg(F.count("*").alias("used"), (F.sqrt(F.avg(error * error)) < 0.999 * F.stddev_pop("anim")).alias("explains"))


def trained_trees(spark, folder):
    """Boosted trees fitted to the comparisons of four in five hashes, judged on the others."""
    rows = Scratch(spark, "gold").keep(_gold(spark, folder).withColumn("part", F.pmod(F.xxhash64("qry", "ref"), F.lit(5))), "rows")
    model = training.train_boosted(rows.where("part > 0"), F.col("anim"), trees=10, depth=4)
    error = F.col("anim") - F.col("prediction")
    held = model.transform(rows.where("part = 0").dropna(subset=["xny_ctx"])).agg((F.sqrt(F.avg(error * error)) < F.stddev_pop("anim")).alias("explains"))
    return rows.agg(F.count("*").alias("used")).crossJoin(held)


QUERIES = {
    f.__name__: f
    for f in (
        profile_steps, profile_table, profile_offset, profile_lineage, profile_krona, species_names, composition_ranked, metadata_joined, rows_of_listed, ordered_lookup,
        matrix_symmetric, phylip, placement_edges, labelled_taxa, error_model, safe_names, species_depths, selection_labels, renamed_trees, trained_regression, trained_trees,
    )
}

_LINES = """lines AS (SELECT genome_id AS r, t % 7 AS f, t FROM (SELECT genome_id, min(taxid) FILTER (taxid <> 0) AS t FROM genomes GROUP BY 1) WHERE t IS NOT NULL)"""


def _steps(least: int) -> str:
    return f"CASE WHEN pct98_99 > 3 AND median > 1 AND shared > {least} THEN pct98_99 - 3 WHEN pct98_99 >= 2 AND shared > {least} THEN greatest(pct98_99 - 3, 0.001) END"


_DEPTHS = f"WITH {sql.COMPOSED}, {_LINES}, d AS (SELECT q, f, t, {_steps(6)} AS depth FROM comp JOIN lines USING (r) WHERE {_steps(6)} IS NOT NULL)"
_TABLE = ", ".join(map(repr, reports.POISSON_DEPTHS))
_GRID = f"""WITH {sql.PAIRS}, a AS (SELECT genome_id FROM z WHERE genome_id % 50 = 0),
m AS (SELECT x.genome_id AS q, y.genome_id AS r, coalesce(shared / (q_size + r_size - shared), 0.0) AS value FROM a x CROSS JOIN a y LEFT JOIN p ON p.q = x.genome_id AND p.r = y.genome_id)"""

_GOLD = """gold AS (SELECT CASE WHEN anim > 1 THEN anim / 100 ELSE anim END AS anim, CASE WHEN qry_align_fraction > 1 THEN qry_align_fraction / 100 ELSE qry_align_fraction END AS aq,
CASE WHEN ref_align_fraction > 1 THEN ref_align_fraction / 100 ELSE ref_align_fraction END AS ar FROM ani_pairs WHERE NOT isnan(anim) AND NOT isnan(qry_align_fraction) AND NOT isnan(ref_align_fraction)
AND xny_ctx > 0 AND n_diff_obj >= 0 AND n_diff_obj_section >= 0 AND n_mut2_ctx >= 0)"""
_USED = f"WITH {_GOLD} SELECT count(*) AS used, true AS explains FROM gold WHERE anim > 0.8 AND aq > 0.1 AND ar > 0.1"
SQL = {
    "trained_regression": _USED,
    "trained_trees": _USED,
    "selection_labels": """WITH r AS (SELECT genome_id AS place, min(name) AS name, min(taxid) AS taxid FROM genomes WHERE regexp_matches(name, '[A-Z]{3}_[0-9]+') GROUP BY 1),
a AS (SELECT place, regexp_extract(name, '([A-Z]{3}_[0-9]+)', 1) AS acc, 'S_' || (taxid % 3) AS sp FROM r),
k AS (SELECT acc, min(sp) AS sp FROM (SELECT acc, sp FROM a WHERE sp IS NOT NULL UNION ALL SELECT translate(acc, 'AF', 'FA'), sp FROM a WHERE sp IS NOT NULL) GROUP BY 1),
m AS (SELECT a.place, a.acc, k.sp, k.sp IS NOT NULL AND row_number() OVER (PARTITION BY a.acc ORDER BY a.place) = 1 AS counts FROM a LEFT JOIN k USING (acc)),
n AS (SELECT *, sum(CAST(counts AS INTEGER)) OVER (ORDER BY place) AS number FROM m),
w(way) AS (VALUES ('all'), ('only'), ('without'))
SELECT CAST(place AS BIGINT) AS place, way, concat_ws(chr(9), CASE WHEN counts AND (way = 'all' OR (way = 'only') = (sp = 'S_1')) THEN CAST(number AS VARCHAR) ELSE '0' || chr(9) || 'NULL' END, acc, sp) AS line FROM n, w""",
    "renamed_trees": """WITH r AS (SELECT DISTINCT rec_id FROM command_sketch WHERE rec_id IS NOT NULL), c AS (SELECT rec_id, rec_id % 1000 AS a, (rec_id * 7) % 1000 AS b FROM r)
SELECT rec_id, '((' || CASE WHEN a % 2 = 0 THEN 'n' || a ELSE '' END || ':0.1,' || CASE WHEN b % 2 = 0 THEN 'n' || b ELSE '' END || '):0.25,x:1);' AS tree FROM c""",
    "profile_steps": f"""WITH {sql.COMPOSED}, d AS (SELECT q, r, {_steps(9)} AS depth FROM comp)
SELECT q, r, round(depth, 6) AS depth, round(100 * depth / sum(depth) OVER (PARTITION BY q), 6) AS percentage FROM d WHERE depth > 0""",
    "profile_table": f"WITH {sql.COMPOSED} SELECT q, r, round(CASE WHEN shared > 6 THEN CASE WHEN pct98_99 > 5 THEN pct98_99 - 3 ELSE ([{_TABLE}])[1 + CAST(floor(pct98_99) AS INTEGER)] END END, 6) AS depth FROM comp",
    "profile_offset": f"WITH {sql.COMPOSED} SELECT q, r, round(CASE WHEN shared > 8 THEN CASE WHEN pct98_99 - 3 > 0.1 THEN pct98_99 - 3 ELSE pow(10, pct98_99 - 3.1) END END, 6) AS depth FROM comp",
    "profile_lineage": f"""{_DEPTHS} SELECT q AS sample, 'domain' AS rank, 'd__Archive' AS path, round(sum(depth), 6) AS value FROM d GROUP BY 1
UNION ALL SELECT q, 'family', 'd__Archive|f__F' || f, round(sum(depth), 6) FROM d GROUP BY q, f UNION ALL SELECT q, 'species', 'd__Archive|f__F' || f || '|s__S' || t || ' x', round(sum(depth), 6) FROM d GROUP BY q, f, t""",
    "profile_krona": f"""{_DEPTHS} SELECT q AS sample, round(100 * sum(depth) / sum(sum(depth)) OVER (PARTITION BY q), 4) AS percentage, 'Archive' || chr(9) || 'F' || f || chr(9) || 'S' || t || ' x' AS taxonomy FROM d GROUP BY q, f, t""",
    "species_names": f"WITH {_LINES} SELECT r, 'S' || t || ' x' AS species FROM lines",
    "composition_ranked": f"WITH {sql.COMPOSED} SELECT q, r, shared, row_number() OVER (PARTITION BY q ORDER BY shared DESC, r) AS place FROM comp",
    "metadata_joined": """WITH m AS (SELECT taxid AS x_id, min(taxname) AS taxname, min(name) AS name FROM genomes WHERE taxid <> 0 GROUP BY 1)
SELECT d.x_id, d.y_id, d.xny_ctx, coalesce(taxname, 'NA') AS taxname, coalesce(name, 'NA') AS name FROM group_dist d LEFT JOIN m ON m.x_id = d.x_id""",
    "rows_of_listed": "SELECT rec_id, genome_id, len FROM command_sketch SEMI JOIN (SELECT genome_id FROM genomes WHERE taxid <> 0) g USING (genome_id)",
    "ordered_lookup": """WITH m AS (SELECT genome_id, min(coalesce(taxname, '?')) AS taxname FROM genomes WHERE genome_id < 100000 GROUP BY 1), w AS (SELECT DISTINCT rec_id, genome_id FROM command_sketch WHERE rec_id IS NOT NULL)
SELECT w.rec_id, w.genome_id, coalesce(m.taxname, '==no match==') AS taxname FROM w LEFT JOIN m ON m.genome_id = w.genome_id""",
    "matrix_symmetric": f"{_GRID} SELECT q, r, round(CASE WHEN q = r THEN 1.0 ELSE value END, 6) AS value FROM m WHERE (SELECT count(*) FROM a) > 1",
    "phylip": f"""{_GRID}, n AS (SELECT genome_id AS q, row_number() OVER (ORDER BY genome_id) AS place FROM a)
SELECT CAST(n.place AS INTEGER) AS place, 'Species' || lpad(CAST(n.place AS VARCHAR), 3, '0') AS name, string_agg(printf('%.6f', value), ' ' ORDER BY m.r) AS line FROM m JOIN n ON n.q = m.q GROUP BY n.place""",
    "placement_edges": """WITH r AS (SELECT DISTINCT rec_id, genome_id FROM command_sketch WHERE rec_id IS NOT NULL AND genome_id IS NOT NULL)
SELECT 'rec' || rec_id AS name, CAST(genome_id AS BIGINT) AS edge_num FROM r UNION ALL SELECT 'rec' || rec_id, 7 FROM r""",
    "labelled_taxa": "WITH f AS (SELECT taxid, min(genome_id) AS first FROM genomes WHERE taxid IS NOT NULL GROUP BY 1) SELECT taxid, row_number() OVER (ORDER BY first, taxid) AS index, first FROM f",
    "error_model": f"""WITH {sql.RECORDS}, n AS (SELECT CAST(length(s) AS DOUBLE) AS n FROM recs WHERE length(s) >= 28)
SELECT round(sum((n - 27) * (16.364969175 + (n - 100) * (15.7789105059 - 16.364969175) / 50)) / sum(n - 27), 6) AS alpha FROM n""",
    "safe_names": "SELECT genome_id, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM genomes",
    "species_depths": f"{_DEPTHS} SELECT q, 'd__Archive; f__F' || f || '; s__S' || t || ' x' AS line, round(sum(depth), 6) AS depth, count(*) AS refs FROM d GROUP BY q, f, t",
}
