"""Decisions on service areas: validated as rules, applied as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.overlay import GRID, united
from ..session import checkpointed

#: The kinds of decisions, their statuses, the form of a licence number.
KINDS = ("exclude_no_rrr", "merge_into", "relicensed_as", "unresolved_lookup")
STATUSES = ("final", "provisional")
LICENCE = r"^ED-\d{4}-\d{4}$"


def violations(decisions: DataFrame, layer: DataFrame | None = None) -> DataFrame:
    """licence_no, problems of every decision that breaks a rule. layer(licence_no): the areas that exist, if known."""
    own = decisions.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("licence_no", "decision", "target_licence_no", "decided_by", "status")])
    own = own.withColumn("twice", F.count("*").over(Window.partitionBy("licence_no")) > 1)
    lic, target, kind = F.col("licence_no"), F.col("target_licence_no"), F.col("decision")
    if layer is None:
        own = own.withColumn("known", F.lit(None).cast("boolean")).withColumn("target_known", F.lit(None).cast("boolean"))
    else:
        ids = layer.select(F.col("licence_no").alias("id_")).distinct()
        own = own.join(ids, F.col("licence_no") == F.col("id_"), "left").withColumn("known", F.col("id_").isNotNull()).drop("id_")
        own = own.join(ids, F.col("target_licence_no") == F.col("id_"), "left").withColumn("target_known", F.col("id_").isNotNull()).drop("id_")
    aims = kind.isin("merge_into", "relicensed_as")
    rules = {
        "bad licence_no": ~F.rlike(lic, F.lit(LICENCE)), "licence twice": F.col("twice"), "licence not in layer": ~F.col("known"), "bad decision": ~kind.isin(*KINDS), "bad status": ~F.col("status").isin(*STATUSES),
        "decided_by is empty": F.col("decided_by") == "", "target missing": aims & (target == ""), "bad target": aims & (target != "") & ~F.rlike(target, F.lit(LICENCE)), "target is the licence itself": aims & (target == lic),
        "target not in layer": (kind == "merge_into") & ~F.col("target_known"), "target already in layer": (kind == "relicensed_as") & F.col("target_known"), "takes no target": ~aims & (target != ""),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(text)) for text, rule in rules.items()]))
    return own.select("licence_no", found.alias("problems")).where(F.size("problems") > 0)


def validate(decisions: DataFrame, layer: DataFrame | None = None, sequence: str | None = None) -> DataFrame:
    """The decisions, or ValueError: one breaks a rule, they go in a circle, or, in order of sequence, one names a licence that is gone by then."""
    if bad := violations(decisions, layer).limit(5).collect():
        raise ValueError(f"malformed decisions: {[(r[0], r[1]) for r in bad]}")
    resolved(decisions)
    if sequence and (bad := untimely(decisions, sequence).limit(5).collect()):
        raise ValueError(f"decisions on licences that are gone or not there yet: {[r['licence_no'] for r in bad]}")
    return decisions


def _moves(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision").isin("merge_into", "relicensed_as"))


def untimely(decisions: DataFrame, sequence: str) -> DataFrame:
    """Merges whose target, and decisions whose licence, an earlier decision has merged or renamed away, or a later one brings about."""
    own = decisions.select("licence_no", "decision", "target_licence_no", F.col(sequence).alias("at_"))
    gone = _moves(own).select(F.col("licence_no").alias("gone_"), F.col("at_").alias("gone_at_"))
    made = own.where("decision = 'relicensed_as'").select(F.col("target_licence_no").alias("made_"), F.col("at_").alias("made_at_"))
    merges = own.where("decision = 'merge_into'")
    named = own.select("licence_no", F.col("licence_no").alias("named_"), "at_").unionByName(merges.select("licence_no", F.col("target_licence_no").alias("named_"), "at_"))
    late = named.join(gone, F.col("named_") == F.col("gone_")).where((F.col("gone_at_") < F.col("at_")))
    early = named.join(made, F.col("named_") == F.col("made_")).where(F.col("made_at_") > F.col("at_"))
    return late.select("licence_no").unionByName(early.select("licence_no")).distinct()


def resolved(decisions: DataFrame) -> DataFrame:
    """licence_no, final_, merged_, from_ of every licence that is merged or renamed: where its chain of decisions ends, whether a merge is on the way, and the last licence before the end.

    Pointers jump: each round, a licence that points to one that points on takes over what that one has, so a chain of n
    decisions takes about log2(n) rounds. One that is longer than there are decisions is a circle: ValueError.
    """
    now = checkpointed(_moves(decisions).select("licence_no", F.col("target_licence_no").alias("final_"), (F.col("decision") == "merge_into").alias("merged_"), F.col("licence_no").alias("from_")))
    reach, n = 1, now.count()
    while True:
        on = now.select(F.col("licence_no").alias("final_"), F.col("final_").alias("next_"), F.col("merged_").alias("more_"), F.col("from_").alias("last_"))
        if now.join(on, "final_", "left_semi").isEmpty():
            return now
        if reach > n:
            raise ValueError(f"decisions in a circle: {sorted(r[0] for r in now.join(on, 'final_', 'left_semi').select('licence_no').limit(5).collect())}")
        ahead = F.col("next_").isNotNull()
        now = checkpointed(now.join(on, "final_", "left").select("licence_no", F.coalesce("next_", "final_").alias("final_"), (F.col("merged_") | F.coalesce("more_", F.lit(False))).alias("merged_"), F.when(ahead, F.col("last_")).otherwise(F.col("from_")).alias("from_")))
        reach *= 2


def apply(layer: DataFrame, decisions: DataFrame, sequence: str | None = None, grid: float = GRID) -> DataFrame:
    """The analysis layer: merged areas are part of where their chain of decisions ends, others are renamed, flagged or excluded.

    Equal to applying the decisions one by one in order of sequence. Without one, what builds on a decision comes after
    it, and merges after flags of their target. An area that gains others is the union of all; merged_licences are those
    that were merged into it itself, whatever had been merged into these before.
    """
    kind, status = F.col("decision"), F.coalesce(F.col("status"), F.lit(""))
    ends = resolved(decisions)
    chain = lambda of: [F.coalesce("final_", of).alias("end_"), F.coalesce("merged_", F.lit(False)).alias("merged_")]
    own = layer.join(ends, "licence_no", "left").select("licence_no", "utility_name", "geometry", *chain("licence_no"))
    # What happens to the area that ends as end_: decisions on the licences that lead there by renaming, and merges into them.
    at = decisions.withColumn("of_", F.when(kind == "merge_into", F.col("target_licence_no")).otherwise(F.col("licence_no")))
    at = at.join(ends.withColumnRenamed("licence_no", "of_"), "of_", "left").select("licence_no", "decision", "target_licence_no", status.alias("status"), *chain("of_"), *([F.col(sequence).alias("sequence_")] if sequence else []))
    at = at.where("not merged_")
    to_end = F.col("target_licence_no") == F.col("end_")
    rank = F.when((kind == "merge_into") & to_end, 3).when(kind.isin("exclude_no_rrr", "unresolved_lookup"), 2).when((kind == "relicensed_as") & to_end, 1).otherwise(0)
    last = F.col("sequence_") if sequence else F.struct(rank.alias("rank"), status.alias("status"))
    facts = at.groupBy("end_").agg(
        F.max_by(F.struct(F.when(kind == "merge_into", "merge_target").otherwise(kind).alias("decision"), "status"), last).alias("last_"),
        F.array_sort(F.collect_list(F.when(kind == "merge_into", F.col("licence_no")))).alias("merged_licences"), F.coalesce(F.bool_or(kind == "exclude_no_rrr"), F.lit(False)).alias("excluded"),
        F.bool_or(kind == "unresolved_lookup").alias("licence_not_current"), F.max(F.when((kind == "relicensed_as") & to_end, F.col("licence_no"))).alias("legacy_licence_no"),
    )
    gains = own.where("merged_").groupBy("end_").agg(F.flatten(F.collect_list("geometry")).alias("more_"))
    out = own.where("not merged_").drop("merged_").join(facts, "end_", "left").join(gains, "end_", "left")
    whole = united(F.when(F.col("more_").isNotNull(), F.concat("geometry", "more_")), grid)
    return out.select(
        F.col("end_").alias("licence_no"), "utility_name", F.coalesce(whole, "geometry").alias("geometry"), F.coalesce("last_.decision", F.lit("none")).alias("decision"), F.coalesce("last_.status", F.lit("")).alias("decision_status"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("merged_licences", F.array().cast("array<string>")).alias("merged_licences"), "legacy_licence_no", F.coalesce("licence_not_current", F.lit(False)).alias("licence_not_current"),
    )
