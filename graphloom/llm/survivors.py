"""One surviving record per group of duplicates: grouping by name, currency, and survival by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.graphs import connected_components
from graphloom.session import cut_lineage

_SPACE = r"[\p{Z}\s﻿​]"
_HAN = "㐀-鿿"
# --- fixed values: what stands in a field that says nothing, and phrases of longer fillers
FILLERS = ["", "-", "--", "—", "...", "…", "n/a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "unknown", "empty", "(empty)", "see evidence", "see summary", "see above", "see text", "无", "暂无", "待补充", "未知", "同上", "略", "空"]
FILLER_PHRASES = [
    r"no (?:summary|evidence|text|content|description) (?:was|is) available", r"left (?:open|blank|empty) by the", r"will add the missing text", r"has to be completed manually",
    r"placeholder", r"to be (?:added|completed|filled in)", "未能得到任何内容", "占位说明", "占位文字", "自动填写", "待补充完整", "暂无内容",
]
#: A word is a slip of another at one edit from it if that one is this many times as frequent. A ratio
#: alone, so that the size of the table doesn't matter.
RARER = 3
#: Slips that are broadcast at most; beyond that the join shuffles both sides.
MOST_BROADCAST = 200_000
#: Values of a clue column at most; a column of more values is free text, from which no order can be learnt.
MOST_VALUES = 10_000


@F.pandas_udf(T.StringType())
def _nfkc(names):
    import unicodedata

    return names.map(lambda s: unicodedata.normalize("NFKC", s) if isinstance(s, str) else None)


def name_words(name: Column) -> Column:
    """Sorted words of a folded name: remarks in brackets, articles, marks and plural endings dropped.

    A name in Han script is one word, without 的 and white space. Null, blank or mark-only names have
    no words.
    """
    plain = F.regexp_replace(name, r"[(\[【（〔][^)\]】）〕]*[)\]】）〕]", " ")
    # an article stands before a word without a comma: "A, Cache Protocol" is another order of "Cache Protocol A"
    plain = F.regexp_replace(plain, r"^[^\p{L}\p{N}]*(?:the|an?)[\p{Z}\s_-]+(?=\p{L}{3})", "")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    plain = F.regexp_replace(plain, r"eies\b", "ey")
    plain = F.regexp_replace(plain, r"(?<=[a-z]{2})ies\b", "y")
    plain = F.regexp_replace(plain, r"(?<=(?:s|x|ch|sh))es\b", "")
    plain = F.regexp_replace(plain, r"(?<=[a-z0-9])(?<!s)s\b", "")
    han = F.array(F.regexp_replace(plain, r"[的\s]+", ""))
    words = F.when(plain.rlike(f"[{_HAN}]"), han).otherwise(F.array_sort(F.split(plain, " ")))
    return F.filter(words, lambda w: F.length(w) > 0)


def word_slips(names: DataFrame, words: str) -> DataFrame:
    """(word, meant): words of more than three letters at one edit from a far more frequent word.

    An edit is one letter more, less, other, or two neighbours swapped. Two words at one edit share a
    variant with one letter deleted, so candidates meet in an equi-join on variants of the vocabulary
    (not of the rows); levenshtein confirms. Words with digits are never slips.
    """
    counts = (
        names.filter(F.size(words) >= 3)
        .select(F.explode(words).alias("word"))
        .filter(F.col("word").rlike(r"^\p{L}{4,}$") & ~F.col("word").rlike(f"[{_HAN}]"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = F.sequence(F.lit(1), F.length("word"))
    variants = counts.select(
        "word",
        "n",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array("word"),
                    F.transform(at, lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))),
                )
            )
        ).alias("variant"),
    )
    other = variants.select(F.col("word").alias("meant"), F.col("n").alias("m"), "variant")
    swapped = (F.array_sort(F.split("word", "")) == F.array_sort(F.split("meant", ""))) & (F.levenshtein("word", "meant") == 2)
    return (
        variants.join(other, "variant")
        .filter((F.col("word") != F.col("meant")) & (F.col("n") * RARER <= F.col("m")))
        .filter((F.levenshtein("word", "meant") <= 1) | swapped)
        .groupBy("word")
        .agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"))
    )


def correct(names: DataFrame, words: str, slips: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """names with the slips among the words of names of three and more words put right.

    The slips, one row per word of the vocabulary that is one, are counted first: as a broadcast they
    are looked up in place; beyond most_broadcast the words of names that have any are joined with them.
    """
    slips = cut_lineage(slips.select("word", "meant"))
    if slips.limit(most_broadcast + 1).count() <= most_broadcast:
        table = names.sparkSession.sparkContext.broadcast({r.word: r.meant for r in slips.toLocalIterator()})

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def put_right(lists):
            meant = table.value
            return lists.map(lambda ws: ws if ws is None or len(ws) < 3 or not any(w in meant for w in ws) else sorted(meant.get(w, w) for w in ws))

        return names.withColumn(words, put_right(words))
    distinct = names.select(words).distinct()
    fixes = (
        distinct.filter(F.size(words) >= 3)
        .select(F.col(words).alias("_own"), F.explode(words).alias("word"))
        .join(slips, "word")
        .groupBy("_own")
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "meant")))).alias("_fix"))
        .withColumnRenamed("_own", words)
    )
    fixed = F.array_sort(F.transform(words, lambda w: F.coalesce(F.element_at("_fix", w), w)))
    return names.join(fixes, words, "left").withColumn(words, F.when(F.col("_fix").isNull(), F.col(words)).otherwise(fixed)).drop("_fix")


def duplicate_groups(records: DataFrame, record_id: str, scope: str, name: str, aliases: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """records with `point`: records of one scope belong to one point if their names have the same words,
    slips aside, or one's name is an alias of the other; chains count.

    records has one row per record_id; its columns pass through, so it should carry only what is needed
    later. point names the group, not its smallest record. Records without any word in their name are
    points of their own. A null or blank alias links nothing; an alias that is no record's name links
    nothing either.
    """
    key = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    in_scope = F.coalesce(F.col(scope).cast("string"), F.lit(""))
    base = cut_lineage(records.withColumns({"_scope": in_scope, "_words": name_words(F.lower(_nfkc(F.col(name))))}))
    # the vocabulary of the distinct names, as they are folded
    slips = word_slips(base.filter(F.size("_words") >= 3).select(F.lower(name).alias("_n"), "_words").distinct(), "_words")
    slips = cut_lineage(slips)
    keyed = correct(base, "_words", slips, most_broadcast).withColumn("_key", key(F.col("_words")))
    # a vertex is a name in a scope; nameless records stand alone
    vertex = F.concat_ws("\u0001", "_scope", F.coalesce("_key", F.concat(F.lit("\u0002"), F.col(record_id).cast("string"))))
    keyed = cut_lineage(keyed.withColumn("_id", vertex).drop("_words", "_key"))
    spelt = keyed.filter(F.size(aliases) > 0).select("_id", "_scope", F.explode(F.array_distinct(aliases)).alias("_raw")).filter("_raw is not null")
    spelt = correct(spelt.withColumn("_words", name_words(F.lower(_nfkc(F.col("_raw"))))), "_words", slips, most_broadcast)
    claims = spelt.filter(F.size("_words") > 0).select(F.col("_id").alias("src"), F.concat_ws("\u0001", "_scope", key(F.col("_words"))).alias("dst"))
    claims = claims.filter("src <> dst").distinct()
    links = cut_lineage(claims.join(keyed.select(F.col("_id").alias("dst")), "dst", "left_semi"))
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = connected_components(ends, links).withColumnsRenamed({"id": "_id", "component": "_label"})
    return keyed.join(labels, "_id", "left").withColumn("point", F.coalesce("_label", "_id")).drop("_id", "_label", "_scope")


def _levels(edges: list[tuple[str, str, int]]) -> dict[str, int]:
    """The level of each value in the order that the votes give: of edges (before, after, margin), the
    greatest margins first, those that close no cycle are kept, and a value's level is the length of the
    longest path to it."""
    after: dict[str, set[str]] = {}

    def reaches(a: str, b: str) -> bool:
        todo, seen = [a], set()
        while todo:
            if (at := todo.pop()) == b:
                return True
            if at not in seen:
                seen.add(at)
                todo += after.get(at, ())
        return False

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not reaches(b, a):
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())
    before = dict.fromkeys(after, 0)
    for ends in after.values():
        for b in ends:
            before[b] += 1
    level, ready = dict.fromkeys(after, 0), sorted(v for v, n in before.items() if not n)
    while ready:
        a = ready.pop()
        for b in after[a]:
            level[b] = max(level[b], level[a] + 1)
            before[b] -= 1
            if not before[b]:
                ready.append(b)
    return level


def learn_precedence(records: DataFrame, group: str, value: str, at: str, most_values: int = MOST_VALUES) -> DataFrame:
    """(value, rank): how late each value of a column comes in time, learnt from timestamped rows.

    In each group the values are put in the order of their first times; neighbours vote for "a before
    b", over any distance in time. The majorities, strongest first, make a partial order (what would
    close a cycle is left out), and a value's rank is its level there: a value has a higher rank than
    all that come before it, directly or by others. Values never seen in a transition have no rank.

    The rows of a group are reduced to its values before they are ordered. The votes, one row per pair
    of values, are ordered in the driver; that is bounded by most_values, beyond which the column is no
    clue and a ValueError is raised.
    """
    first = records.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.min(at).alias("_first"))
    order = Window.partitionBy(group).orderBy("_first", value)
    votes = first.withColumn("_next", F.lead(value).over(order)).filter(F.col("_next").isNotNull()).groupBy(F.col(value).alias("a"), F.col("_next").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    votes = cut_lineage(votes)
    if votes.select(F.explode(F.array("a", "b")).alias("v")).distinct().limit(most_values + 1).count() > most_values:
        raise ValueError(f"{value} has more than {most_values} values: it is no clue to the order of rows")
    counts = {(r.a, r.b): r.n for r in votes.toLocalIterator()}
    won = [(str(a), str(b), n - counts.get((b, a), 0)) for (a, b), n in counts.items() if n > counts.get((b, a), 0)]
    return records.sparkSession.createDataFrame(sorted(_levels(won).items()), "value string, rank int")


def with_currency(records: DataFrame, group: str, at: str, clues: list[str], precedence: dict[str, DataFrame] | None = None) -> DataFrame:
    """records with _current, a struct that orders the records of a group by how late they are.

    A timestamp decides where there is one. A record without one is placed by the ranks of its values
    in the clue columns (see learn_precedence; `precedence` gives (value, rank) by clue instead of
    learning them here), topologically after the timestamped records of its group whose values precede
    its own or are equal, before the others: its time is the latest time of such a record of the group,
    null where there is none. Where all records have a time, nothing is learnt and nothing placed.
    """
    undated = records.filter(F.col(at).isNull())
    if precedence is None and not undated.take(1):
        return records.withColumn("_current", F.struct(F.col(at).alias("t"), F.lit(0).alias("r")))
    out, total = records, F.lit(0)
    for i, clue in enumerate(clues):
        ranks = precedence[clue] if precedence else learn_precedence(records, group, clue, at)
        # at most MOST_VALUES rows
        ranks = ranks.select(F.col("value").alias(f"_value{i}"), F.col("rank").alias(f"_rank{i}"))
        out = out.join(F.broadcast(ranks), F.col(clue).cast("string") == F.col(f"_value{i}"), "left")
        total = total + F.coalesce(F.col(f"_rank{i}") + 1, F.lit(0))
    out = cut_lineage(out.withColumn("_rank", total).select(*records.columns, "_rank"))
    dated, undated = out.filter(F.col(at).isNotNull()), out.filter(F.col(at).isNull())
    # the latest time of each rank in a group, so that a group of any size is a few rows
    lost = undated.select(group, "_rank").distinct()
    known = dated.groupBy(group, F.col("_rank").alias("_r")).agg(F.max(at).alias("_last"))
    placed = lost.join(known, group).filter(F.col("_r") <= F.col("_rank")).groupBy(group, "_rank").agg(F.max("_last").alias("_placed"))
    placed_rows = undated.join(placed, [group, "_rank"], "left").withColumn("_current", F.struct(F.col("_placed").alias("t"), (F.col("_rank") + 1).alias("r")))
    return dated.withColumn("_current", F.struct(F.col(at).alias("t"), F.lit(0).alias("r"))).unionByName(placed_rows.drop("_placed")).drop("_rank")


def clean_text(text: Column) -> Column:
    """text without white space at its ends; null where it says nothing."""
    value = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    low = F.lower(value)
    bare = F.regexp_replace(low, r"[\s.。!！]+$", "")
    filler = low.isin(FILLERS) | bare.isin(FILLERS) | low.rlike("|".join(FILLER_PHRASES)) | ~low.rlike(r"[\p{L}\p{N}]")
    return F.when(~filler, value)


def clean_refs(refs: Column) -> Column:
    """Distinct non-blank references, null where there is none."""
    kept = F.array_distinct(F.filter(F.transform(refs, lambda r: F.regexp_replace(r, f"^{_SPACE}+|{_SPACE}+$", "")), lambda r: F.length(r) > 0))
    return F.when(F.size(kept) > 0, kept)


def measured(records: DataFrame, confidence: str, texts: list[str], refs: str) -> DataFrame:
    """records with what decides which value survives, in place of the values: _ok, the confidence within
    0 to 1; _n_<text>, the characters of a text that says something; _n_<refs>, the distinct non-blank
    references; each null where there is nothing. Nothing large has to be shuffled after that."""
    valid = F.when((F.col(confidence) >= 0) & (F.col(confidence) <= 1), F.col(confidence).cast("double"))
    n_refs = F.when(F.size(clean_refs(F.col(refs))) > 0, F.size(clean_refs(F.col(refs))))
    sizes = {"_ok": valid, **{f"_n_{t}": F.length(clean_text(F.col(t))) for t in texts}, f"_n_{refs}": n_refs}
    return records.withColumns(sizes).drop(confidence, *texts, refs)


def survivors(records: DataFrame, group: str, record_id: str, confidence: str, texts: list[str], refs: str, current: str = "_current") -> DataFrame:
    """One row per group of at least two records: group_id (its smallest record), n_records, and for
    each field, as <field>_record, the record whose value survives.

    records come from measured(). confidence: the highest within 0 to 1. Each of texts: the longest in
    characters of those that say something. refs: the most distinct non-blank references. Ties: higher
    valid confidence (none is lowest), then the later record by `current`, then the smaller record id.
    A field that no record offers is null. All are combining aggregates: a group of any size is reduced
    before the shuffle.
    """
    tie = [F.coalesce("_ok", F.lit(-1.0)), F.col(current), -F.col(record_id)]
    best = lambda size: F.max_by(record_id, F.when(size.isNotNull(), F.struct(size, *tie)))
    fields = {confidence: F.col("_ok"), **{t: F.col(f"_n_{t}") for t in [*texts, refs]}}
    out = records.groupBy(group).agg(F.min(record_id).alias("group_id"), F.count(F.lit(1)).alias("n_records"), *[best(size).alias(f"{name}_record") for name, size in fields.items()])
    return out.filter("n_records > 1").select(group, "group_id", "n_records", *[f"{name}_record" for name in fields])


def surviving_values(best: DataFrame, records: DataFrame, record_id: str, confidence: str, texts: list[str], refs: str) -> DataFrame:
    """best, the result of survivors(), with the values themselves: one record per group, built field by
    field. records has one row per record_id; only records that some field takes are kept."""
    fields = [confidence, *texts, refs]
    wanted = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"{f}_record").alias(record_id)) for f in fields])
    asked = best.select("group_id", F.explode(wanted).alias("_w")).select("group_id", "_w.f", f"_w.{record_id}").filter(F.col(record_id).isNotNull())
    clean = {confidence: F.col(confidence).cast("double"), **{t: clean_text(F.col(t)) for t in texts}, refs: clean_refs(F.col(refs))}
    taken = asked.join(records.select(record_id, *[c.alias(n) for n, c in clean.items()]), record_id)
    values = taken.groupBy("group_id").agg(*[F.max_by(f, F.when(F.col("f") == f, F.col(record_id))).alias(f) for f in fields])
    return best.join(values, "group_id", "left")
