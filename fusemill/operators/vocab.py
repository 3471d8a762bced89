"""The vocabulary dimension: mapping rows, matching rules and class lists.

A mapping table has a row order (``row_idx``) and one column for each label
space; a cell is a comma list of ids. All matching rules are rules on the
distinct pairs of ids that share a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.sources.files import stored


def id_list(cell: Column) -> Column:
    """A comma list of ids as an array of int; null stays null."""
    return F.transform(F.split(cell.cast("string"), ","), lambda x: F.trim(x).cast("int"))


def space_ids(vocab: DataFrame, space: str) -> DataFrame:
    """Distinct ids of a space: id."""
    return vocab.select(F.explode(id_list(F.col(space))).alias("id")).where("id is not null").distinct()


def space_pairs(vocab: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct ids (l, r) that share a mapping row."""
    both = vocab.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(id_list(F.col(left)).alias("ls"), id_list(F.col(right)).alias("rs"))
    return both.select(F.explode("ls").alias("l"), "rs").select("l", F.explode("rs").alias("r")).distinct()


def map_direction(vocab: DataFrame, left: str, right: str) -> DataFrame:
    """One row: n_left, n_right, and whether ids are mapped from left to right (the larger space to the smaller)."""
    count = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(id_list(F.col(c))))))
    return vocab.agg(count(left).cast("long").alias("n_left"), count(right).cast("long").alias("n_right")).withColumn("left_to_right", F.col("n_left") >= F.col("n_right"))


def targets(pairs: DataFrame, left_to_right: bool = True) -> DataFrame:
    """from_id, targets: the sorted ids that an id maps to."""
    a, b = ("l", "r") if left_to_right else ("r", "l")
    return pairs.groupBy(F.col(a).alias("from_id")).agg(F.array_sort(F.collect_set(b)).alias("targets"))


def translate_label(labels: DataFrame, column: str, vocab: DataFrame, left: str, right: str) -> DataFrame:
    """labels with target: the one id it maps to, -1 for none, -2 for several."""
    to = space_pairs(vocab, left, right).groupBy(F.col("l").alias(column)).agg(F.count("*").alias("__n"), F.min("r").alias("__r"))
    target = F.when(F.col("__n").isNull(), -1).when(F.col("__n") > 1, -2).otherwise(F.col("__r"))
    return labels.join(to, column, "left").withColumn("target", target).drop("__n", "__r")


def ambiguous_targets(vocab: DataFrame, left: str, right: str) -> DataFrame:
    """Ids with several targets: from_id, targets."""
    return targets(space_pairs(vocab, left, right)).where(F.size("targets") > 1)


def match_labels(rows: DataFrame, l: str, r: str, vocab: DataFrame, left: str, right: str, left_to_right: bool) -> DataFrame:
    """rows with match: 1 equal, 0 different, -1 where the ids can't be compared."""
    pairs = space_pairs(vocab, left, right)
    source, other = (l, r) if left_to_right else (r, l)
    a, b = ("l", "r") if left_to_right else ("r", "l")
    mapped = pairs.select(F.col(a).alias(source)).distinct().withColumn("__mapped", F.lit(True))
    known = space_ids(vocab, right if left_to_right else left).select(F.col("id").alias(other)).withColumn("__known", F.lit(True))
    both = pairs.select(F.col(a).alias(source), F.col(b).alias(other)).withColumn("__both", F.lit(True))
    out = rows.join(mapped, source, "left").join(known, other, "left").join(both, [source, other], "left")
    match = F.when(F.col("__mapped").isNull() | F.col("__known").isNull(), -1).when(F.col("__both"), 1).otherwise(0)
    return out.withColumn("match", match).drop("__mapped", "__known", "__both")


def match_by_synset(rows: DataFrame, scannet: str, wordnet: str, vocab: DataFrame) -> DataFrame:
    """rows with match between a raw id and a wn199 id by the raw id's own wn199 cell; -1 if it has none or the wordnet label is -1."""
    own = vocab.groupBy(F.col("id").alias(scannet)).agg(F.min_by(F.col("wn199").cast("int"), "row_idx").alias("__wn"))
    out = rows.join(own, scannet, "left")
    match = F.when(F.col("__wn").isNull() | (F.col(wordnet) == -1), -1).when(F.col("__wn") == F.col(wordnet), 1).otherwise(0)
    return out.withColumn("match", match).drop("__wn")


def first_target(vocab: DataFrame, source: str, to: str) -> DataFrame:
    """from_id, target: the first mapping row wins."""
    rows = vocab.select("row_idx", F.explode(id_list(F.col(source))).alias("from_id"), id_list(F.col(to))[0].alias("t")).where("t is not null")
    return rows.groupBy("from_id").agg(F.min_by("t", "row_idx").alias("target"))


def last_target(vocab: DataFrame, source: str, to: str) -> DataFrame:
    """from_id, target: the last mapping row wins."""
    rows = vocab.select("row_idx", F.explode(id_list(F.col(source))).alias("from_id"), id_list(F.col(to))[0].alias("t")).where("t is not null")
    return rows.groupBy("from_id").agg(F.max_by("t", "row_idx").alias("target"))


def resolve_ids_from_names(rows: DataFrame, key: str, names: str, classes: DataFrame) -> DataFrame:
    """key, ids (comma list in the names' order), unknown (number of names without a class); classes: name, id."""
    one = rows.select(key, F.posexplode(F.split(names, ",")).alias("pos", "name")).withColumn("name", F.trim("name"))
    joined = one.join(classes.groupBy("name").agg(F.min("id").alias("id")), "name", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))))
    ids = F.array_join(F.transform(ordered, lambda x: x["id"].cast("string")), ",")
    return joined.groupBy(key).agg(F.when(F.size(ordered) > 0, ids).alias("ids"), F.count_if(F.col("id").isNull()).alias("unknown"))


def assign_colors(classes: DataFrame, palette: DataFrame, by_name: DataFrame) -> DataFrame:
    """classes with color: the palette's by id, else the one of its name, else a fixed function of the id."""
    own = F.array(*((F.col("id") * k % 256).cast("int") for k in (37, 101, 197)))
    out = classes.join(palette.select("id", F.col("color").alias("__p")), "id", "left").join(by_name.select("name", F.col("color").alias("__n")), "name", "left")
    return out.withColumn("color", F.coalesce("__p", "__n", own)).drop("__p", "__n")


def color_of(cell: Column) -> Column:
    """r-g-b as an array of int."""
    return F.transform(F.split(cell, "-"), lambda x: x.cast("int"))


def numbered_by(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows with their place (from 0) in an order without ties.

    Rows are dealt to ranges of the order by sampled bounds and sorted there, so a row's place is the sum of the
    ranges before its own, which is one row a range, and its place in the range. Long runs of one value are many tasks' work.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the id of a row is its partition and its place there; written, since the bounds are sampled anew with every run
    held = stored(sorted_.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__range", F.shiftright("__at", 33))
    sizes = held.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    place = F.col("__from") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(offsets, "__range").withColumn("place", place.cast("int")).drop("__at", "__range", "__from")


def classes_by_occurrence(vocab: DataFrame, least: int = 3) -> DataFrame:
    """id, name, total, color of the synsets that occur more than least times, most frequent first, and (0, unknown)."""
    named = vocab.where("wnsynsetkey is not null").groupBy(F.col("wnsynsetkey").alias("name"))
    totals = named.agg(F.sum("cnt").alias("total"), F.min_by("color", "row_idx").alias("color")).where(F.col("total") > least)
    ranked = numbered_by(totals, [F.desc("total"), "name"]).withColumn("id", F.col("place") + 1)
    unknown = vocab.sparkSession.createDataFrame([(0, "unknown", 0, "0-0-0")], "id int, name string, total long, color string")
    return ranked.select("id", "name", "total", "color").unionByName(unknown)


def class_list(vocab: DataFrame, space: str) -> DataFrame:
    """id, name, color: the first row of each id, and (0, unknown) where the space has no 0."""
    rows = vocab.select("row_idx", F.explode(id_list(F.col(space))).alias("id"), F.col("category").alias("name"), "color").where("id is not null")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row_idx"))).where("n = 1").drop("n", "row_idx")
    unknown = vocab.sparkSession.createDataFrame([(0, "unknown", "0-0-0")], "id int, name string, color string")
    return first.unionByName(unknown.join(first, "id", "left_anti"))


def compact_ids(ids: DataFrame, unknown_id: int) -> DataFrame:
    """idx, id: a dense index in order of id; the unknown id has the slot after the last."""
    dense = numbered_by(ids.select("id").distinct(), ["id"]).withColumnRenamed("place", "idx")
    slot = dense.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("idx")).withColumn("id", F.lit(unknown_id))
    return dense.select("idx", "id").unionByName(slot.select("idx", "id"))


def shift_nyu(label: Column) -> Column:
    return label + 1


def shift_instance(label: Column) -> Column:
    """Two reserved ids before the classes; the reserved 2 is a 1."""
    return F.when(label + 2 == 2, 1).otherwise(label + 2)


def noun(synset: Column) -> Column:
    """chair.n.01 -> chair; underscores are spaces."""
    return F.replace(F.split_part(synset, F.lit("."), F.lit(1)), F.lit("_"), F.lit(" "))


def class_prompts(classes: DataFrame, templates: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, template_no, size, prompt: each class (id, synset, lemmas, and definition if there is one) in each template and size, with other lemmas if there are any.

    In a template, {} is the noun and {definition} the definition, each after the size.
    """
    other = F.slice("lemmas", F.lit(2), F.size("lemmas"))
    sized = lambda c: F.concat_ws(" ", F.when(F.col("size") != "", F.col("size")), c)
    text = F.replace("template", F.lit("{}"), sized(noun(F.col("synset"))))
    if "definition" in classes.columns:
        text = F.replace(text, F.lit("{definition}"), F.col("definition"))
    also = F.when(F.size(other) > 0, F.concat(F.lit(" It can also be called "), F.array_join(other, ", "))).otherwise("")
    return classes.crossJoin(templates.crossJoin(sizes)).select("id", "template_no", "size", F.concat(text, also).alias("prompt"))


def caption(classes: DataFrame) -> DataFrame:
    """One caption for a list of synsets in order of id: nouns in lower case, ending in a full stop."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("id", noun(F.col("synset")).alias("n")))), lambda x: x["n"])
    text = F.rtrim(F.lower(F.array_join(names, ", ")))
    return classes.agg(F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit("."))).alias("caption"))


def colorize(labels: DataFrame, classes: DataFrame, default: int = 0) -> DataFrame:
    """labels with r, g, b in 0 to 1, by the class id; default for a label without a class."""
    out = labels.join(classes.select(F.col("id").alias("label"), color_of(F.col("color")).alias("__c")), "label", "left")
    return out.withColumns({c: F.coalesce(F.col("__c")[k], F.lit(default)) / 255 for k, c in enumerate("rgb")}).drop("__c")
