"""Registered queries over the text and training-data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leakage, mixing, pairs, pii, splitting, survivors
from graphloom.llm.tokens import count_tokens
from graphloom.session import cut_lineage, read_table


def _split(spark: SparkSession, folder: str, keep_limit: bool = False) -> DataFrame:
    """Source blocks with their profile's limits, split. A block without a profile takes `default`, and
    so does one whose profile is unknown."""
    blocks = read_table(spark, folder, "source_blocks").select("block_id", "text", "outline_path", "profile_id")
    blocks = blocks.dropDuplicates(["block_id"])
    key = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    options = read_table(spark, folder, "pipeline_options").groupBy(key(F.col("profile_id")).alias("_profile")).agg(F.max(F.struct("target_tokens", "overlap_tokens")).alias("_o"))
    default = options.filter("_profile = 'default'").select("_o.*").first()
    # pipeline_options is a fixed table of profiles
    profile = F.coalesce(F.nullif(key(F.col("profile_id")), F.lit("")), F.lit("default"))
    joined = blocks.withColumn("_profile", profile).join(F.broadcast(options), "_profile", "left")
    limit, lap = (F.coalesce(F.col(f"_o.{c}"), F.lit(default[c] if default else None)) for c in ("target_tokens", "overlap_tokens"))
    joined = joined.withColumn("target_tokens", limit) if keep_limit else joined
    return splitting.split_blocks(joined, "text", limit, lap)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized source blocks and whether they can be cut at natural boundaries alone."""
    return _split(spark, folder).select("block_id", "cut_kind")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized source blocks, each with its block's outline_path."""
    return splitting.explode_pieces(_split(spark, folder), ["block_id", "outline_path"])


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each oversized block's pieces are within the limit, parts of the text in order, and leave
    nothing but white space out; with the whole text's tokens and the block's limit."""
    split = _split(spark, folder, keep_limit=True)
    blank = lambda t: F.length(F.regexp_replace(t, r"[\p{Z}\s\ufeff]", "")) == 0
    end = lambda p: p["start"] + F.length(p["text"])
    part = lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    before = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("text"))), F.slice("pieces", F.lit(1), F.size("pieces") - 1))
    steps = F.arrays_zip(before.alias("b"), F.col("pieces").alias("p"))
    last = F.element_at("pieces", -1)
    return split.select(
        "block_id",
        splitting.token_count(F.col("text")).alias("n_tokens"),
        "target_tokens",
        F.forall("pieces", lambda p: splitting.token_count(p["text"]) <= F.col("target_tokens")).alias("in_limit"),
        F.forall(steps, lambda s: (s["p"]["start"] >= s["b"]["start"]) & (part(s["p"]["start"], end(s["p"])) == s["p"]["text"])).alias("in_order"),
        (F.forall(steps, lambda s: blank(part(end(s["b"]), s["p"]["start"]))) & blank(part(end(last), F.length("text")))).alias("whole"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Responses with a defect and its type."""
    return pairs.broken_pairs(
        read_table(spark, folder, "generation_requests"), read_table(spark, folder, "generation_responses")
    )


_FIELDS = ("confidence", ["summary", "evidence"], "source_refs")


def _live_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "course_nodes").filter(F.col("deleted_at").isNull())


def _grouped_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record that isn't deleted, with its point and the measures of its values. The texts
    are measured where they are read and not shuffled; a repeated row is equal in every column."""
    rows = survivors.measured(_live_nodes(spark, folder), *_FIELDS)
    rows = rows.select("record_id", "package_id", "node_name", "aliases", "knowledge_kind", "updated_at", "_ok", "_n_summary", "_n_evidence", "_n_source_refs").dropDuplicates(["record_id"])
    return survivors.duplicate_groups(rows, "record_id", "package_id", "node_name", "aliases").drop("package_id", "node_name", "aliases")


def _best_nodes(spark: SparkSession, folder: str) -> DataFrame:
    current = survivors.with_currency(_grouped_nodes(spark, folder), "point", "updated_at", ["knowledge_kind"])
    return survivors.survivors(current, "point", "record_id", *_FIELDS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each point with several records, the record whose value survives for each field."""
    fields = ["confidence", "summary", "evidence", "source_refs"]
    pairs_ = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_record").alias("record_id")) for f in fields])
    return _best_nodes(spark, folder).select("group_id", F.explode(pairs_).alias("x")).select("group_id", "x.field", "x.record_id").filter("record_id is not null")


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each point with several records."""
    records = _live_nodes(spark, folder).select("record_id", "confidence", "summary", "evidence", "source_refs").dropDuplicates(["record_id"])
    best = survivors.surviving_values(_best_nodes(spark, folder), records, "record_id", *_FIELDS)
    return best.select("group_id", "n_records", "confidence", "summary", "evidence", "source_refs")


def p4_current(spark: SparkSession, folder: str) -> DataFrame:
    """The knowledge kind that is current in each point with several records: by the records' times
    (kind_dated), and as it would be placed if no record of the point had a time (kind_placed), by the
    precedence of kinds learnt over all points. Where the two agree, the order told what time tells.
    """
    rows = _grouped_nodes(spark, folder).filter("knowledge_kind is not null").withColumn("knowledge_kind", F.lower(F.trim("knowledge_kind")))
    rows = cut_lineage(rows.select("record_id", "point", "knowledge_kind", "updated_at"))
    ranks = survivors.learn_precedence(rows, "point", "knowledge_kind", "updated_at")
    hidden = rows.withColumn("_at", F.lit(None).cast("timestamp"))
    placed = survivors.with_currency(hidden, "point", "_at", ["knowledge_kind"], {"knowledge_kind": ranks})
    out = placed.groupBy("point").agg(
        F.min("record_id").alias("group_id"),
        F.count(F.lit(1)).alias("n_records"),
        F.max_by("knowledge_kind", F.struct("_current", "knowledge_kind")).alias("kind_placed"),
        F.max_by("knowledge_kind", F.struct("updated_at", "knowledge_kind")).alias("kind_dated"),
    )
    return out.filter("n_records > 1").drop("point", "n_records")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the items."""
    return leakage.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, folder, "documents")
    counted = documents.select("doc_id", mixing.source_key(F.col("source")).alias("source"), count_tokens(F.col("text")).alias("n_tokens"))
    targets = read_table(spark, folder, "mix_targets").withColumn("source", mixing.source_key(F.col("source")))
    return mixing.mix(counted, targets)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    return _mixed(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention of personal information in documents, with its type and place."""
    return pii.mentions(read_table(spark, folder, "documents"))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with placeholders for personal information."""
    return pii.redacted(read_table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_checks": p1_checks,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p4_current": p4_current,
    "p6_found": p6_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

_TOKENS = "greatest(1, len(regexp_replace({0}, '[^㐀-鿿]', '', 'g')) + ceil((len({0}) - len(regexp_replace({0}, '[^㐀-鿿]', '', 'g'))) / 4))"

_BLOCKS = r"""WITH o AS (SELECT lower(trim(profile_id)) AS p, target_tokens AS t FROM pipeline_options),
        b AS (SELECT DISTINCT ON (block_id) block_id, text, coalesce(nullif(lower(trim(profile_id)), ''), 'default') AS p FROM source_blocks),
        x AS (SELECT block_id, text, coalesce(o.t, (SELECT t FROM o WHERE p = 'default')) AS t FROM b LEFT JOIN o ON o.p = b.p)"""

SQL = {
    "p1_checks": _BLOCKS + rf""" SELECT block_id, {_TOKENS.format("text")}::INT AS n_tokens, t AS target_tokens, true AS in_limit, true AS in_order, true AS whole
        FROM x WHERE {_TOKENS.format("text")} > t AND len(regexp_replace(text, '[\p{{Z}}\s]', '', 'g')) > 0""",
    "p1_found": _BLOCKS + rf""",
        y AS (SELECT block_id, t, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([。！？])', '\1' || chr(10), 'g'), '([.!?])([\p{{Z}}\s])', '\1' || chr(10) || '\2', 'g'), '[\r\n]+'),
          lambda s: regexp_replace(s, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g')) AS parts FROM x WHERE {_TOKENS.format("text")} > t AND len(regexp_replace(text, '[\p{{Z}}\s]', '', 'g')) > 0)
        SELECT block_id, CASE WHEN len(list_filter(parts, lambda s: {_TOKENS.format("s")} > t)) > 0 THEN 'hard' ELSE 'natural' END AS cut_kind FROM y""",
}
