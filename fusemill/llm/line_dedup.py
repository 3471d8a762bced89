"""Line dedup by a log-template tree, as column expressions and joins only.

A line's words that hold a digit become ``<*>``; what is left is its template.
Templates hang in a tree of fixed depth: first the number of words, then the
leading words. In a leaf, a line's variable fields are the words that fewest
texts have at their place: the constant words of a family are at least as
frequent there as its lines, a field's values are not. How many of its words
are fields isn't known beforehand, so a template is generalised once for each
number of them, none up to a fifth of its words, rarest first. A generalised
template that occurs in ``min_docs`` distinct texts or more recurs, and the
lines that have it are dropped. Nothing depends on how rare a value is, only on
its being rarer than the words around it, so families stay found as the corpus
grows. Texts are counted, not rows: exact copies of one text don't make its
lines recur.

Work grows with the words of the leaves that hold min_docs lines or more. Only
templates with few enough words below min_docs are generalised, as any other
keeps such a word. All groupings are partial aggregates, joins are on a word of
a place or on a template, never on a leaf alone, and a window holds the words of
one template.

Defined results: a null text stays null with zero lines; an empty text is one
empty line and is kept; lines of fewer than ``min_words`` words are never
dropped; a text of recurring lines only becomes the empty text (share tells how
much of a text recurring lines held, for callers who leave whole copies to
document-level dedup); repeated rows are treated alike; other columns pass
through, whatever their names, but for those of the names asked for, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusemill.llm.common import discard, in_some, table, written

MIN_DOCS = 5
MIN_WORDS = 3
LEADING = 2
SIMILAR = 0.8
NAMES = ("n_lines", "n_dropped", "share")


def _template(line: Column) -> Column:
    """One space between words, and <*> for words with a digit; each regular expression runs only where it finds something."""
    uneven = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    spaced = F.trim(F.when(uneven, F.regexp_replace(line, "[ \\t\\r]+", " ")).otherwise(line))
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "(?<![^ ])[^ ]*[0-9][^ ]*", "<*>")).otherwise(spaced)


def _words(template: Column) -> Column:
    return F.length(template) - F.length(F.replace(template, F.lit(" "), F.lit(""))) + 1


def _leaf(template: Column, leading: int) -> Column:
    return F.xxhash64(_words(template), F.substring_index(template, " ", leading))


def _fields(n_words: Column, similar: float) -> Column:
    """The number of words that may be variable."""
    return n_words - F.ceil(F.lit(similar) * n_words - F.lit(1e-9))


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def _templates(docs: DataFrame, text: str) -> Column:
    return F.transform(F.split(text, "\n"), _template)


def line_keys(docs: DataFrame, row: list[str], text: str = "text", min_words: int = MIN_WORDS, leading: int = LEADING) -> DataFrame:
    """The columns row, pos, leaf and key of each line that may be dropped."""
    lines = docs.select(*row, F.posexplode(_templates(docs, text)).alias("pos", "template"))
    lines = lines.where(_words(F.col("template")) >= min_words)
    return lines.select(*row, "pos", _leaf(F.col("template"), leading).alias("leaf"), F.xxhash64("template").alias("key"))


def recurring(
    docs: DataFrame, keys: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, leading: int = LEADING, similar: float = SIMILAR
) -> DataFrame:
    """leaf, key: the hashes of every template that recurs, as a written table. Leaves of fewer than min_docs lines hold none and are left out first."""
    full = keys.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    lines = docs.select(F.xxhash64(text).alias("body"), F.explode(F.array_distinct(_templates(docs, text))).alias("template"))
    lines = lines.where(_words(F.col("template")) >= min_words).where(in_some(full.select(F.col("leaf").alias("h")))(_leaf(F.col("template"), leading)))
    pairs = written(lines.distinct(), "line-pairs")
    templates = pairs.groupBy("template").agg(F.count("*").alias("n"))
    most = _fields(_words(F.col("template")), similar)
    templates = templates.select(_leaf(F.col("template"), leading).alias("leaf"), F.xxhash64("template").alias("key"), "template", "n", most.alias("most"))
    templates = written(templates, "line-templates")
    # the words beyond the leading ones; the first word stands for its leaf and keeps templates without others
    words = templates.select("leaf", "key", "n", "most", F.posexplode(F.split("template", " ")).alias("at", "word"))
    words = words.where(((F.col("at") >= leading) & (F.col("word") != "<*>")) | (F.col("at") == 0))
    words = words.select("leaf", "key", "n", "most", "at", F.xxhash64("leaf", "at", "word").alias("word"))
    docs_of = written(words.groupBy("word").agg(F.sum("n").alias("docs")), "line-words")
    frequent = in_some(docs_of.where(F.col("docs") >= min_docs).select(F.col("word").alias("h")), bits=24)
    able = words.groupBy("key").agg(F.count_if(~frequent(F.col("word"))).alias("rare"), F.max("most").alias("most")).where(F.col("rare") <= F.col("most"))
    ranked = words.where(in_some(able.select(F.col("key").alias("h")))(F.col("key"))).join(docs_of.hint("merge"), "word")
    # rarest words first: after j of them, the words that are left give the template with j fields
    rarest = Window.partitionBy("leaf", "key").orderBy(F.col("at") >= leading, "docs", "at")
    masked = F.bit_xor(F.when(F.col("at") >= leading, F.col("word")).otherwise(0)).over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.bit_xor("word").over(Window.partitionBy("leaf", "key"))
    general = ranked.select(
        "leaf", "key", "n", "most", (F.row_number().over(rarest) - 1).alias("fields"), F.lead("docs").over(rarest).alias("next"), whole.bitwiseXOR(masked).alias("general")
    )
    general = general.where((F.col("fields") <= F.col("most")) & (F.coalesce("next", F.lit(min_docs)) >= min_docs))
    general = written(general.select("leaf", "key", "n", "general"), "line-general")
    # a text counts once a template here, so no template that recurs is left out
    likely = general.groupBy("general").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("general")
    likely = written(general.join(likely.hint("merge"), "general", "left_semi").select("leaf", "key", "general"), "line-likely")
    some = in_some(likely.select(F.col("key").alias("h")))
    texts = pairs.select(F.xxhash64("template").alias("key"), "body").where(some(F.col("key"))).join(likely.select("key", "general").hint("merge"), "key")
    often = texts.select("general", "body").distinct().groupBy("general").count().where(F.col("count") >= min_docs).select("general")
    found = written(likely.join(often.hint("merge"), "general", "left_semi").select("leaf", "key").distinct(), "line-found")
    discard(pairs, templates, docs_of, general, likely)
    return found


def drop_recurring(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    min_docs: int = MIN_DOCS,
    min_words: int = MIN_WORDS,
    leading: int = LEADING,
    similar: float = SIMILAR,
    names: tuple[str, str, str] = NAMES,
) -> DataFrame:
    """docs with the recurring lines taken out of text; names: the numbers of lines and of dropped ones (long), and the share of the text's characters that these held (double). Columns of these names are replaced."""
    docs = docs.drop(*names)
    row = [_unused("__id", docs.columns), _unused("__text", docs.columns)]
    drop = _unused("__drop", docs.columns)
    keyed = docs.withColumns({row[0]: F.coalesce(F.col(id_col).cast("string"), F.lit("")), row[1]: F.xxhash64(text)})
    keys = written(line_keys(keyed, row, text, min_words, leading), "line-keys")
    found = recurring(docs, keys, text, min_docs, min_words, leading, similar)
    hits = keys.join(found, ["leaf", "key"], "left_semi")
    drops = written(hits.groupBy(*row).agg(F.collect_set("pos").alias(drop)), "line-drops")
    discard(keys, found)
    # texts without a dropped line stay where they are
    some = in_some(drops.select(F.xxhash64(*row).alias("h")))(F.xxhash64(*row))
    out = keyed.where(some).join(drops.hint("merge"), row, "left")
    out = out.unionByName(keyed.where(~some).withColumn(drop, F.lit(None).cast("array<int>")))
    all_lines = F.split(text, "\n")
    out = out.withColumn(drop, F.coalesce(drop, F.array().cast("array<int>")))
    chars = F.aggregate(F.transform(all_lines, lambda x, i: F.when(F.array_contains(drop, i), F.length(x)).otherwise(0)), F.lit(0), lambda a, n: a + n)
    kept = F.array_join(F.filter(F.transform(all_lines, lambda x, i: F.when(~F.array_contains(drop, i), x)), lambda x: x.isNotNull()), "\n")
    return out.withColumns(
        {
            text: F.when(F.size(drop) > 0, kept).otherwise(F.col(text)),
            names[0]: F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)).cast("long"),
            names[1]: F.size(drop).cast("long"),
            names[2]: F.when(F.size(drop) > 0, chars / F.length(text)).otherwise(0.0),
        }
    ).select(*docs.columns, *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("share", F.round("share", 6))


def oracle(docs: str = "documents") -> str:
    """The same over a view, as SQL that keeps whole strings where the plan above keeps hashes."""
    return rf"""
with lines as (
  select doc_id, text, pos, line, regexp_replace(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') as template
  from (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {docs} where text is not null)
), worded as (
  select *, string_split(template, ' ') as words, array_to_string(list_slice(string_split(template, ' '), 1, {LEADING}), ' ') as lead from lines
), templates as (
  select template, len(words) as n_words, lead, count(distinct text) as n from worded where len(words) >= {MIN_WORDS} group by all
), places as (
  select template, n_words, lead, n, unnest(string_split(template, ' ')) as w, generate_subscripts(string_split(template, ' '), 1) as place from templates
), counts as (select n_words, lead, place, w, sum(n) as docs from places group by all
), ranked as (
  select p.template, p.place, p.w, n_words - ceil({SIMILAR} * n_words - 1e-9) as most, docs,
    case when p.place > {LEADING} and p.w <> '<*>' then row_number() over (partition by p.template order by p.place <= {LEADING} or p.w = '<*>', docs, p.place) end as nth
  from places p join counts c using (n_words, lead, place, w)
), able as (
  select template, max(most) as most, count(*) filter (nth is not null and docs < {MIN_DOCS}) as rare, count(nth) as words from ranked group by template having rare <= max(most)
), masks as (
  select template, unnest(generate_series(rare, least(most, words)::bigint)) as fields from able
), named as (
  select template, fields, string_agg(case when nth <= fields then '<*>' else w end, ' ' order by place) as general from masks join ranked using (template) group by template, fields
), often as (
  select general from named join worded using (template) group by general having count(distinct text) >= {MIN_DOCS}
), found as (select template from named join often using (general)
), marked as (
  select doc_id, pos, line, len(words) >= {MIN_WORDS} and template in (select template from found) as hit from worded
), per as (
  select doc_id, sum(case when hit then length(line) else 0 end) as hit_chars, count(*) as n_lines,
    sum(case when hit then 1 else 0 end) as hits, string_agg(line, chr(10) order by pos) filter (not hit) as kept from marked group by doc_id
)
select d.doc_id, case when hits > 0 then coalesce(kept, '') else d.text end as text, coalesce(n_lines, 0)::bigint as n_lines, coalesce(hits, 0)::bigint as n_dropped,
  round(case when hits > 0 then hit_chars::double / length(d.text) else 0.0::double end, 6) as share
from {docs} d left join per p on d.doc_id = p.doc_id
"""


ORACLE_SQL = oracle()
