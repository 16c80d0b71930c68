"""Queries on the operators of this subpackage. Their SQL is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kmerloom.llm import oracle
from kmerloom.llm.components import connected_groups
from kmerloom.llm.genomes import matches
from kmerloom.llm.mixing import mixture, reached_shares
from kmerloom.llm.overlap_sizes import contained_pairs, overlap_sizes, register_sketches
from kmerloom.llm.packing import pack
from kmerloom.llm.sentences import sentences
from kmerloom.llm.similar_pairs import class_links, similar_classes, similar_pairs
from kmerloom.llm.splitting import split_oversized
from kmerloom.llm.tokens import with_token_counts
from kmerloom.session import Scratch


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Genomes with the smallest genome of their group of matches."""
    groups = connected_groups(matches(_table(spark, folder, "ani_pairs"), _table(spark, folder, "genomes")), "a", "b")
    listed = groups.where("vertex >= 0")
    return listed.select(F.col("vertex").cast("int").alias("genome_id"), F.col("group").cast("int").alias("group_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of groups that share at least half of the smaller one's contexts."""
    return contained_pairs(_table(spark, folder, "group_sketch"), "taxid", "ctx").select(F.col("x").alias("x_id"), F.col("y").alias("y_id"))


def p2_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated sizes and overlap for every pair of groups that was ever reported."""
    listed = _table(spark, folder, "group_dist").where("x_id <> y_id").select(F.least("x_id", "y_id").alias("x_id"), F.greatest("x_id", "y_id").alias("y_id")).distinct()
    sizes = overlap_sizes(listed, register_sketches(_table(spark, folder, "group_sketch"), "taxid", "ctx"), "x_id", "y_id")
    return sizes.select("x_id", "y_id", F.round("x_size").cast("bigint").alias("x_size"), F.round("y_size").cast("bigint").alias("y_size"), F.round("xny").cast("bigint").alias("xny_ctx"), F.round("xny_error", 1).alias("xny_error"))


def p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the estimates of ``p2_overlaps`` lie within four standard errors of exact counts."""
    rows = _table(spark, folder, "group_sketch").where("taxid is not null and ctx is not null").select("taxid", "ctx").distinct()
    estimates = p2_overlaps(spark, folder)
    asked = estimates.select("x_id", "y_id")
    sizes = rows.groupBy("taxid").agg(F.count("*").alias("n"))
    both = asked.join(rows.withColumnRenamed("taxid", "x_id"), "x_id").join(rows.withColumnRenamed("taxid", "y_id"), ["y_id", "ctx"]).groupBy("x_id", "y_id").agg(F.count("*").alias("both"))
    out = estimates.join(both, ["x_id", "y_id"], "left")
    for of in ("x", "y"):
        out = out.join(sizes.select(F.col("taxid").alias(f"{of}_id"), F.col("n").alias(f"{of}_true")), f"{of}_id", "left")
    out = out.fillna(0, ["both", "x_true", "y_true"])
    single = 4 * 1.04 / 64  # four standard errors of one set's size from 4,096 registers
    close = [F.abs(F.col(f"{of}_size") - F.col(f"{of}_true")) <= 1 + single * F.col(f"{of}_true") for of in ("x", "y")]
    return out.select("x_id", "y_id", (close[0] & close[1]).alias("sizes_close"), (F.abs(F.col("xny_ctx") - F.col("both")) <= 1 + 4 * F.col("xny_error")).alias("overlap_close"))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """(genome, value) with the 44 bits of the context and the 20 of the object in one number."""
    low = F.lit((1 << 20) - 1).cast("bigint")
    key = F.col("ctxgid")
    return _table(spark, folder, "sketch").select(key.bitwiseAND(low).alias("genome"), key.bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("obj").cast("bigint").bitwiseAND(low)).alias("value"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of genomes that have at least half of their values in common."""
    pairs = similar_pairs(_values(spark, folder), "genome", "value", 0.5)
    return pairs.select(F.col("a").cast("int").alias("genome_a"), F.col("b").cast("int").alias("genome_b"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every genome that has values, with the smallest genome of equal values and the number of other such classes that are similar."""
    linked = class_links(*similar_classes(_values(spark, folder), "genome", "value", 0.5))
    return linked.select(F.col("r").cast("int").alias("genome_id"), F.col("rep").cast("int").alias("class_id"), "links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cuts of the sequence records with more than 5,000 letters."""
    return split_oversized(_table(spark, folder, "command_sketch"), "rec_id", "seq").drop("piece")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves, with the record's last name that is not blank."""
    records = _table(spark, folder, "command_sketch")
    pieces = split_oversized(records, "rec_id", "seq", with_text=True)
    named = F.when(F.trim("name") != "", F.struct("loaded_at", "name"))
    names = records.groupBy("rec_id").agg(F.max(named)["name"].alias("name"))
    return pieces.join(names, "rec_id", "left").select("rec_id", "name", "piece_no", "start_pos", "end_pos", "piece")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all messages, stored, as every later step reads them."""
    return Scratch(spark, "tokens").keep(with_token_counts(_table(spark, folder, "documents"), "doc_id", "text", "source"), "sizes")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """All messages in containers of 2,048 tokens."""
    return pack(_sizes(spark, folder), 2048).withColumnRenamed("id", "doc_id")


def p6_steered(spark: SparkSession, folder: str) -> DataFrame:
    """All messages in containers that follow the shares of ``mix_targets`` for as long as the sources last."""
    targets = {r.source: r.target_share for r in _table(spark, folder, "mix_targets").collect()}  # a list of sources
    return pack(_sizes(spark, folder), 2048, targets).withColumnRenamed("id", "doc_id")


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For both ways of packing: messages, and whether each is there once and whole, no container is overfull, containers are full
    but for 2 %, and no message is cut that fits."""
    sizes = _sizes(spark, folder)
    targets = {r.source: r.target_share for r in _table(spark, folder, "mix_targets").collect()}
    out = None
    for way, wanted in (("natural", None), ("steered", targets)):
        packed = pack(sizes, 2048, wanted)
        per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("held")).agg(F.max("held").alias("most"), F.sum("held").alias("tokens"), F.count("*").alias("containers"))
        pieces = packed.groupBy("id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.count_distinct("first_token").alias("places"))
        met = pieces.join(sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("size")), "id", "full")
        right = (F.col("n") == F.col("size")) & (F.col("pieces") == F.col("places")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / 2048)))
        messages = met.agg(F.count("*").alias("messages"), F.coalesce(F.bool_and(F.coalesce(right, F.lit(False))), F.lit(True)).alias("each_once"))
        # one row each
        one = messages.crossJoin(per).select(F.lit(way).alias("way"), "messages", "each_once", (F.col("most") <= 2048).alias("none_overfull"), (F.col("tokens") >= 0.98 * 2048 * F.col("containers")).alias("nearly_full"))
        out = one if out is None else out.unionByName(one)
    return out


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the messages, mixed to the sources' target shares."""
    return mixture(_sizes(spark, folder), _table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches, and how often its most used block occurs."""
    return reached_shares(p7_mixture(spark, folder), _table(spark, folder, "mix_targets"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every listed source, whether the mixture keeps its promises: no block above the cap, no source above its
    share of the budget or above what it holds times the cap, and its share reached where it holds enough."""
    sizes, targets = _sizes(spark, folder), _table(spark, folder, "mix_targets")
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    budget = sizes.join(F.broadcast(targets.where("target_share > 0 and max_repeats > 0").select("source")), "source", "left_semi").agg(F.sum("n_tokens").alias("budget"))
    rows = reached_shares(mixture(sizes, targets), targets).join(held, "source", "left").crossJoin(budget)  # one row
    share, most = F.col("target_share") * F.col("budget"), F.coalesce("held", F.lit(0)) * F.col("max_repeats")
    near = F.abs(F.col("n_tokens") - F.least(share, most)) <= 256 + 0.001 * F.col("n_tokens") + 256 * F.col("max_repeats")
    return rows.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"), (F.col("n_tokens") <= most).alias("within_held"), near.alias("share_reached"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of sentences that another sentence follows in the same paragraph."""
    return sentences(_table(spark, folder, "documents"), "doc_id", "text").where("followed").select("doc_id", "end_char")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every message, whether its sentences stand in order without overlap and are what stands at their places."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = sentences(docs, "doc_id", "text", with_text=True)
    before = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("sentence_no"))
    right = found.withColumn("ordered", (F.coalesce(before, F.lit(-1)) < F.col("start_char")) & (F.col("start_char") <= F.col("end_char")))
    right = right.join(docs, "doc_id").withColumn("same", F.expr("substring(text, start_char + 1, end_char - start_char + 1)") == F.col("sentence"))
    flags = right.groupBy("doc_id").agg(F.bool_and("ordered").alias("in_order"), F.bool_and("same").alias("texts_match"))
    return docs.select("doc_id").join(flags, "doc_id", "left").fillna(True, ["in_order", "texts_match"])


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """All sentences with their texts."""
    return sentences(_table(spark, folder, "documents"), "doc_id", "text", with_text=True).drop("followed")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_overlaps": p2_overlaps, "p2_checked": p2_checked, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_containers": p6_containers, "p6_steered": p6_steered, "p6_kept": p6_kept, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_kept": p7_kept, "p8_found": p8_found, "p8_sentences": p8_sentences, "p8_kept": p8_kept}
SQL = oracle.SQL
