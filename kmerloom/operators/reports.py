"""Profiles, reshaping and estimates made of the other operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kmerloom.operators.hierarchy import hierarchy
from kmerloom.operators.skew import hot_left_join, with_sum_before

# The ranks of a profile, the letters of lineages, what stands for a missing value, and the field of placement files.
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")
LINEAGE_PREFIXES = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}
MISSING, NO_MATCH, EDGE_FIELD, CODE_NAME, CODE = "NA", "==no match==", "edge_num", "Species%03d", "Species[0-9]{3}"
ACCESSION = r"(GC[AF]_[0-9]+\.[0-9]+)"
# Depths of low abundances by their whole part.
POISSON_DEPTHS = (0.0, 0.02, 0.08, 0.69, 1.57, 2.49, 3.41, 4.31, 5.20, 6.08, 6.94)


def depth_by_steps(pct: Column, median: Column, shared: Column, high: float = 3, least_shared: int = 9, low: float = 2, small: float = 0.001) -> Column:
    """pct - high where pct > high and median > 1; else at least ``small`` where pct >= low; null elsewhere and up to ``least_shared`` keys."""
    return F.when(shared > least_shared, F.when((pct > high) & (median > 1), pct - high).when(pct >= low, F.greatest(pct - high, F.lit(small))))


def depth_by_offset(pct: Column, shared: Column, offset: float = 3.0, least_shared: int = 18, small: float = 0.1) -> Column:
    """The deviation from the offset where it exceeds ``small``, else 10 ** (deviation - small); null up to ``least_shared`` keys."""
    dev = pct - offset
    return F.when(shared > least_shared, F.when(dev > small, dev).otherwise(F.pow(F.lit(10.0), dev - small)))


def depth_by_table(pct: Column, shared: Column, table: tuple[float, ...] = POISSON_DEPTHS, above: float = 5, offset: float = 3, least_shared: int = 6) -> Column:
    """pct - offset where pct > above, else table[int(pct)]; null up to ``least_shared`` keys."""
    entry = F.element_at(F.array(*map(F.lit, table)), F.floor(pct).cast("int") + 1)
    return F.when(shared > least_shared, F.when(pct > above, pct - offset).otherwise(entry))


def relative_abundance(rows: DataFrame, sample: str, depth: str) -> DataFrame:
    """Adds percentage: the share of a sample's total depth."""
    return rows.where(F.col(depth) > 0).withColumn("percentage", 100 * F.col(depth) / F.sum(depth).over(Window.partitionBy(sample)))


def roll_up(abundances: DataFrame, nodes: DataFrame, sample: str = "sample", taxon: str = "taxid", value: str = "percentage", ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """(sample, rank, taxid, value): every abundance summed at each of its ancestors of the listed ranks.

    ``nodes`` has node, parent and rank; the ranked nodes above a taxon come from ``hierarchy``, however deep it is.
    """
    ranked = F.col("rank").isin(*ranks)
    asked = abundances.select(F.col(taxon).cast("bigint").alias("node")).distinct()
    tree = hierarchy(nodes, on_path=ranked).where("path is not null").join(asked, "node", "left_semi").select("node", F.explode("path").alias("above"))
    at = nodes.where(ranked).groupBy(F.col("node").alias("above")).agg(F.min("rank").alias("rank"))
    lines = tree.join(at, "above").groupBy("node").agg(F.collect_set(F.struct("rank", "above")).alias("line")).withColumnRenamed("node", "of")
    met = hot_left_join(abundances.select(F.col(sample).alias("sample"), F.col(taxon).alias("taxon"), F.col(value).alias("value")), lines, "taxon", "of")
    return met.select("sample", "value", F.explode("line").alias("x")).groupBy("sample", "x.rank", F.col("x.above").alias("taxid")).agg(F.sum("value").alias("value"))


def lineage_profile(rows: DataFrame, sample: str, lineage: str, value: str) -> DataFrame:
    """(sample, rank, path, value) of lineages like ``d__A;p__B;s__C``: each sample's sums at every prefix of the path."""
    parts = F.filter(F.split(lineage, ";"), lambda x: F.length(F.trim(x)) > 3)
    out = rows.select(F.col(sample).alias("sample"), F.col(value).alias("v"), parts.alias("parts")).select("sample", "v", "parts", F.posexplode("parts").alias("i", "part"))
    letter = F.substring(F.trim("part"), 1, 1)
    names = F.create_map(*[F.lit(x) for pair in LINEAGE_PREFIXES.items() for x in pair])
    return out.groupBy("sample", names[letter].alias("rank"), F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("i") + 1), lambda x: F.trim(x)), "|").alias("path")).agg(F.sum("v").alias("value"))


def krona_rows(rows: DataFrame, sample: str, lineage: str, value: str) -> DataFrame:
    """(sample, percentage, taxonomy): the share of each lineage in its sample, four decimals, and the tab-separated names without rank prefixes."""
    names = F.transform(F.split(lineage, ";"), lambda x: F.regexp_replace(F.trim(x), "^[a-z]__", ""))
    out = rows.groupBy(F.col(sample).alias("sample"), F.array_join(names, "\t").alias("taxonomy")).agg(F.sum(value).alias("v"))
    sums = out.groupBy("sample").agg(F.sum("v").alias("all"))
    return out.join(sums, "sample").select("sample", F.round(100 * F.col("v") / F.col("all"), 4).alias("percentage"), "taxonomy")


def species_of(lineage: Column) -> Column:
    """The species' name in a lineage, null without one."""
    found = F.regexp_extract(lineage, r";\s*s__([^;]+)", 1)
    return F.when(found != "", found)


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Left join to one metadata row per key, with ``NA`` for what is missing."""
    columns = [c for c in metadata.columns if c != key]
    one = metadata.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    out = hot_left_join(rows, one.withColumnRenamed(key, "__k"), key, "__k")
    return out.select(*rows.columns, *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns])


def subset(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def ordered_subset(wanted: DataFrame, order: str, rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row per wanted key in the wanted order, ``==no match==`` where there is none."""
    one = rows.groupBy(F.col(key).alias("__k")).agg(F.min(value).alias(value))
    return hot_left_join(wanted.select(order, key), one, key, "__k").withColumn(value, F.coalesce(value, F.lit(NO_MATCH))).orderBy(order)


def phylip_rows(long: DataFrame, order: DataFrame) -> DataFrame:
    """(place, name, line) of a distance matrix in long form (q, r, value): code names ``Species001`` and values in that order.

    ``order`` has q and place from 1.
    """
    right = order.select(F.col("q").alias("r"), F.col("place").alias("column"))
    met = long.join(right, "r").join(order, "q")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "value"))), lambda x: F.format_string("%.6f", x["value"])), " ")
    return met.groupBy("place", F.format_string(CODE_NAME, "place").alias("name")).agg(line.alias("line"))


def error_rate(keys: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """(h1, h2, total, s, r): from how many distinct keys have each count in any genome: h1 of count 1, h2 of count 2, total the sum
    of count times keys; s = (h1 - 2 h2) / total and r = s / (alpha - beta s). A key counts once for each count it has."""
    histogram = keys.select("ctxobj", "cnt").distinct().groupBy("cnt").agg(F.count("*").alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("cnt") == c, F.col("n"))), F.lit(0))
    sums = histogram.agg(of(1).alias("h1"), of(2).alias("h2"), F.sum(F.col("cnt") * F.col("n")).alias("total"))
    s = (F.col("h1") - 2 * F.col("h2")) / F.col("total")
    return sums.select("h1", "h2", "total", s.alias("s"), (s / (alpha - beta * s)).alias("r"))


def read_alpha(lengths: Column, at_100: float, at_150: float) -> Column:
    """The first coefficient of the error model for a read length: the line through its values at 100 and 150 bases."""
    return at_100 + (lengths - 100.0) * (at_150 - at_100) / 50.0


def weighted_alpha(rows: DataFrame, weight: str, value: str) -> DataFrame:
    return rows.agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("alpha"))


def placements(rows: DataFrame, text: str) -> DataFrame:
    """(name, edge_num) of every placement in the text of a jplace file, under its first name; the field's place is looked up in ``fields``."""
    kind = "struct<fields:array<string>,placements:array<struct<n:array<string>,p:array<array<double>>>>>"
    one = rows.select(F.from_json(text, kind).alias("j")).select(F.array_position("j.fields", EDGE_FIELD).cast("int").alias("at"), F.explode("j.placements").alias("x"))
    return one.select(F.get("x.n", F.lit(0)).alias("name"), "at", F.explode("x.p").alias("v")).select("name", F.element_at("v", F.col("at")).cast("bigint").alias("edge_num"))


def labelled(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, index, first): a running index over the keys' first occurrences in the order of an integer column; no task sees all keys."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("first")).withColumn("one", F.lit(1).cast("bigint"))
    return with_sum_before(firsts, "one", "first", ties=(key,)).select(key, (F.col("before") + 1).alias("index"), "first")


def selection_labels(files: DataFrame, species: DataFrame, wanted: str | None = None, pattern: str = ACCESSION) -> DataFrame:
    """(place, line): a label for every listed file, ``number<TAB>accession<TAB>species`` where it is chosen, ``0<TAB>NULL`` before it elsewhere.

    ``files`` has place (integer, unique) and name, ``species`` accession and species; an accession counts in both of its spellings
    (GCA and GCF). Files of unknown accessions and those whose accession was listed before aren't chosen; the number runs over all others. With
    ``wanted`` only files of that species are chosen, with ``^`` before it only files of others. Raises on a name without accession.
    """
    named = species.select("accession", F.regexp_replace("species", r"\s", "_").alias("species"))
    known = named.unionByName(named.select(F.translate("accession", "AF", "FA").alias("accession"), "species")).groupBy("accession").agg(F.min("species").alias("species")).withColumnRenamed("accession", "of")
    rows = files.select("place", F.regexp_extract("name", pattern, 1).alias("accession"))
    if rows.where("accession = '' or accession is null").limit(1).count():
        raise ValueError("a name without accession")
    met = hot_left_join(rows, known, "accession", "of")
    firsts = met.groupBy("accession").agg(F.min("place").alias("place")).withColumnRenamed("accession", "seen")
    met = met.join(firsts, "place", "left").withColumn("counts", (F.col("species").isNotNull() & F.col("seen").isNotNull()).cast("bigint"))
    met = with_sum_before(met, "counts", "place")
    chosen = F.col("counts") == 1
    if wanted is not None:
        right = F.col("species") == F.lit(wanted.removeprefix("^"))
        chosen = chosen & (~right if wanted.startswith("^") else right)
    number = F.when(chosen, (F.col("before") + 1).cast("string")).otherwise("0\tNULL")
    return met.select("place", F.concat_ws("\t", number, "accession", "species").alias("line"))


def renamed_tree(trees: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, text) of Newick trees with code names replaced: ``names`` has code and name; a code without a name becomes empty.

    ``key`` is unique. A tree is cut at its codes, which meet the names as rows, and put together again.
    """
    parts = F.split(text, f"(?<={CODE})|(?={CODE})")
    cut = trees.select(key, F.posexplode(parts).alias("i", "part"))
    one = names.groupBy(F.col("code").alias("of")).agg(F.min("name").alias("name"))
    met = hot_left_join(cut, one, "part", "of").withColumn("part", F.when(F.col("part").rlike(f"^{CODE}$"), F.coalesce("name", F.lit(""))).otherwise(F.col("part")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "")
    return met.groupBy(key).agg(joined.alias(text))
