"""Per-pixel majority vote across models that label in different spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.operators.vocab import space_ids, space_pairs
from fusemill.sources.files import stored

PIXEL = ["scene_id", "frame_id", "px", "py"]
#: Legal labels of each space, both ends included; a label outside casts no vote.
DOMAIN = {"ade20k": (0, 149), "nyu40id": (1, 40), "wn199": (1, 188), "wn_merged": (1, 188)}

#: Votes that a task counts; a frame stays whole.
VOTES_A_TASK = 1_000_000


def _legal(domain: dict[str, tuple[int, int]]):
    legal = F.lit(True)
    for space, (low, high) in domain.items():
        legal = F.when(F.col("label_space") == space, F.col("label").between(low, high)).otherwise(legal)
    return legal & (F.col("label") >= 0)


def vote_domain(pred: DataFrame, domain: dict[str, tuple[int, int]] = DOMAIN) -> DataFrame:
    """pred without labels that lie outside their space's domain."""
    return pred.where(_legal(domain))


def vote_table(vocab: DataFrame, spaces: list[str], output_space: str) -> DataFrame:
    """label_space, label, candidate: the output ids that a label votes for."""
    out = None
    for space in spaces:
        if space == output_space:
            part = space_ids(vocab, space).select(F.lit(space).alias("label_space"), F.col("id").alias("label"), F.col("id").alias("candidate"))
        else:
            part = space_pairs(vocab, space, output_space).select(F.lit(space).alias("label_space"), F.col("l").alias("label"), F.col("r").alias("candidate"))
        out = part if out is None else out.unionByName(part)
    return out


def cast_votes(pred: DataFrame, table: DataFrame, keys: list[str], *more: str, beside: DataFrame | None = None) -> DataFrame:
    """keys, more, candidate: each voter once for every candidate of its label, or once with null; dealt by frame, with the rows of beside.

    The labels in use are counted first. They leave of the table what is voted for, whatever the vocabulary's size,
    and tell the number of votes, by which the number of tasks grows: a task's votes don't grow with the input.
    """
    on, frame = ["label_space", "label"], [k for k in keys if k not in ("px", "py")]
    legal = pred.withColumn("label", F.when(_legal(DOMAIN), F.col("label")))
    used = stored(legal.groupBy(*on).agg(F.count("*").alias("n")), "labels-used")
    named = stored(table.join(used, on).select(*on, "candidate", "n"), "labels-named")
    # one row
    votes = used.select("n").unionByName(named.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    tasks = max(int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-votes // VOTES_A_TASK))
    cast = legal.join(named.drop("n"), on, "left").select(*keys, *more, "candidate")
    return (cast if beside is None else cast.unionByName(beside, allowMissingColumns=True)).repartition(tasks, *frame)


def vote(pred: DataFrame, table: DataFrame, keys: list[str] = PIXEL, min_votes: int = 2) -> DataFrame:
    """keys, n_votes, label: each voter casts a vote for every candidate of its label; most votes win, ties go to the lowest id, too few votes give 0.

    One shuffle by frame serves both aggregations, whose keys contain the
    frame's; a pixel without a vote stays by way of a null candidate.
    """
    counted = cast_votes(pred, table, keys).groupBy(*keys, "candidate").agg(F.count("candidate").alias("n"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("candidate")).alias("c"))).alias("b"))
    label = F.when(F.col("b.n") < min_votes, 0).otherwise(F.coalesce(-F.col("b.c"), F.lit(0)))
    return best.select(*keys, F.col("b.n").alias("n_votes"), label.alias("label"))


def vote_by_signature(pred: DataFrame, table: DataFrame, keys: list[str] = PIXEL, min_votes: int = 2) -> DataFrame:
    """The rows of vote(), by solving each distinct combination of labels once: for frames that repeat few combinations.

    A pixel's labels in order are its signature; signatures are settled among themselves and joined back, which costs
    two more shuffles than vote() and saves the joins and counts of the pixels that share one.
    """
    legal = F.when(_legal(DOMAIN), F.struct("label_space", "label"))
    pixels = pred.withColumn("__l", legal).groupBy(*keys).agg(F.array_sort(F.collect_list("__l")).alias("signature"))
    each = pixels.select("signature").distinct().select("signature", F.explode_outer("signature").alias("l"))
    each = each.select("signature", "l.label_space", "l.label").join(table, ["label_space", "label"], "left")
    counted = each.groupBy("signature", "candidate").agg(F.count("candidate").alias("n"))
    best = counted.groupBy("signature").agg(F.max(F.struct("n", (-F.col("candidate")).alias("c"))).alias("b"))
    label = F.when(F.col("b.n") < min_votes, 0).otherwise(F.coalesce(-F.col("b.c"), F.lit(0)))
    return pixels.join(best, "signature").select(*keys, F.col("b.n").alias("n_votes"), label.alias("label"))


def exclude_models(pred: DataFrame, variants: DataFrame) -> DataFrame:
    """pred once for each variant (variant, without) but for the model that it leaves out."""
    return pred.crossJoin(variants).where(F.col("without").isNull() | (F.col("model") != F.col("without"))).drop("without")


def vote_state(pred: DataFrame, table: DataFrame, keys: list[str] = PIXEL, truth: DataFrame | None = None) -> DataFrame:
    """keys, voters, votes: for each candidate (null for labels that vote for none) its votes, and those of each model.

    A state from which any model's votes can be taken back; counted once, with the shuffle by frame that vote() has.
    With truth (keys, label), the state has truths as well: t and m, each label of the pixel's and how often it stands
    there. They come by the same shuffle, so variants of a pixel needn't be joined with them; a pixel without a voter is left out.
    """
    side = [] if truth is None else ["of_truth"]
    beside = None if truth is None else truth.dropna(subset=keys).select(*keys, F.col("label").alias("candidate"), F.lit(True).alias("of_truth"))
    by_model = cast_votes(pred, table, keys, "model", beside=beside).groupBy(*keys, "candidate", "model", *side).agg(F.count("candidate").alias("n"), *([F.count("*").alias("m")] if side else []))
    by = by_model.groupBy(*keys, "candidate", *side).agg(F.sum("n").alias("n"), F.collect_list(F.struct("model", "n")).alias("by"), *([F.sum("m").alias("m")] if side else []))
    votes = F.struct("n", (-F.col("candidate")).alias("c"), "by")
    if not side:
        held = by.groupBy(*keys).agg(F.collect_list(votes).alias("votes"))
    else:
        truths = F.when(F.col("of_truth"), F.struct(F.col("candidate").alias("t"), "m"))
        held = by.groupBy(*keys).agg(F.collect_list(F.when(F.col("of_truth").isNull(), votes)).alias("votes"), F.collect_list(truths).alias("truths")).where(F.size("votes") > 0)
    return held.select(*keys, F.array_distinct(F.flatten(F.transform("votes", lambda x: x["by"]["model"]))).alias("voters"), "votes", *(["truths"] if side else []))


def _winner(votes: Column, without: Column | None = None) -> Column:
    """n and c (the negative id, null for none) of the best candidate, once the votes of one model are taken back."""

    def left(x: Column) -> Column:
        n = x["n"] if without is None else x["n"] - F.coalesce(F.get(F.filter(x["by"], lambda y: y["model"] == without), F.lit(0))["n"], F.lit(0))
        return F.struct(n.alias("n"), F.when(n > 0, x["c"]).alias("c"))

    return F.array_max(F.transform(votes, left))


def settle(state: DataFrame, models: DataFrame, min_votes: int = 2) -> DataFrame:
    """variant, keys, n_votes, label: the vote of all models (variant all) and without each of models (model), as vote() would give it.

    A pixel has no row in a variant that leaves it without a voter. A model that gave the winner no vote changes nothing.
    """
    keys = [c for c in state.columns if c not in ("voters", "votes")]
    names = models.agg(F.array_sort(F.collect_set("model"))).scalar()
    won = state.withColumns({"best": _winner(F.col("votes")), "models": names})
    gave = F.flatten(F.transform(F.filter("votes", lambda x: x["c"].eqNullSafe(F.col("best.c"))), lambda x: F.filter(x["by"], lambda y: y["n"] > 0)["model"]))
    won = won.withColumn("gave", gave)

    def without(m: Column) -> Column:
        best = F.when(F.array_contains("gave", m), _winner(F.col("votes"), m)).otherwise(F.col("best"))
        return F.struct(m.alias("variant"), best.alias("b"))

    stay = F.filter("models", lambda m: F.exists("voters", lambda v: v != m))
    each = F.concat(F.array(F.struct(F.lit("all").alias("variant"), F.col("best").alias("b"))), F.transform(stay, without))
    out = won.select(*keys, F.explode(each).alias("v"))
    label = F.when(F.col("v.b.n") < min_votes, 0).otherwise(F.coalesce(-F.col("v.b.c"), F.lit(0)))
    return out.select(F.col("v.variant").alias("variant"), *keys, F.col("v.b.n").alias("n_votes"), label.alias("label"))


def leave_one_out(pred: DataFrame, table: DataFrame, models: DataFrame, min_votes: int = 2) -> DataFrame:
    """The vote of every variant in one job: variant is the model left out (of models), or all."""
    return settle(vote_state(pred, table), models, min_votes)


def leave_one_out_counts(pred: DataFrame, table: DataFrame, models: DataFrame, truth: DataFrame, min_votes: int = 2) -> DataFrame:
    """variant, p, t, n: pixels by the label that a variant's vote gives (p) and that of truth (t)."""
    settled = settle(vote_state(pred, table, truth=truth), models, min_votes)
    each = settled.select("variant", F.col("label").alias("p"), F.explode("truths").alias("x"))
    return each.groupBy("variant", "p", F.col("x.t").alias("t")).agg(F.sum("x.m").alias("n"))
