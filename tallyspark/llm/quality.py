"""Quality rules: rules on one document, then the frequency of lines across the documents of a host.

Lines are normalised (lower case, digits alike, white space collapsed) and hashed. For each host (the
column source) the engine counts the distinct documents that hold a line; exact copies of a text on a
host count once, so that a much-copied document is not taken for boilerplate. A line above the limit,
max(least, share * distinct documents of the host), is removed; a document that keeps less than `remain`
of its words is depleted and rejected. judge() measures, kept() gives the documents that pass, without
their frequent lines.

DataFrame and SQL functions only. Line hashes of the distinct texts are the one thing shuffled (16 bytes
a line); counting is by (host, line), so a host with a third of all rows spreads over all tasks, and
partial sums make a hot line a few rows. The join with the frequent lines and the join of the verdicts
are plain equi-joins: Spark broadcasts a side by its measured size or splits skewed partitions.

Defined results: a null text has no words, fails the base rules and is not kept; a null host counts as a
host of its own; repeated rows get equal results; an empty table gives an empty result. Words are runs
of characters other than the six ASCII white-space characters. Columns of other names do not pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once per row and binds it in body: Spark would evaluate a repeated expression again for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words(text: str) -> str:
    """SQL for the array of words of a text that is not null."""
    return f"if(btrim({text}, {BLANKS}) = '', cast(array() as array<string>), split(btrim({text}, {BLANKS}), '[\\\\x20\\\\x09-\\\\x0D]+'))"


#: Words in three-word windows that occur twice or more: equal hashes meet by sorting, then starts are merged.
REPEATED = let(
    "filter(flatten(transform(array(sort_array(transform(w3, (h, i) -> struct(h, i)))), s -> "
    "zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))[0]), x -> x is not null)",
    "hit",
    let("sort_array(array_distinct(hit))", "starts", "cast(aggregate(zip_with(starts, slice(starts, 2, greatest(size(starts) - 1, 0)), (a, b) -> least(3, coalesce(b - a, 3))), 0, (sum, x) -> sum + x) as bigint)"),
)
WINDOWS = let("transform(ws, w -> xxhash64(w))", "hs", "transform(sequence(0, size(hs) - 3), i -> xxhash64(hs[i], hs[i + 1], hs[i + 2]))")


def base_rules(text: str = "text") -> dict[str, Column]:
    """Columns of the rules on one document."""
    t = f"coalesce({text}, '')"
    lines = f"filter(split({t}, '\\n', -1), l -> btrim(l, {BLANKS}) <> '')"
    measured = let(
        words(t),
        "ws",
        f"struct(cast(size(ws) as bigint) as n_words, if(size(ws) < 4, 0L, {let(WINDOWS, 'w3', f'if(size(array_distinct(w3)) = size(w3), 0L, {REPEATED})')}) as n_repeat_words)",
    )
    return {
        "measured": F.expr(measured),
        "word_chars": F.expr(f"cast(char_length(translate({t}, {BLANKS}, '')) as bigint)"),
        "n_symbols": F.expr(f"cast(char_length({t}) - char_length(translate({t}, '#*$%&|<>', '')) as bigint)"),
        "n_dup_lines": F.expr(let(lines, "ls", "cast(size(ls) - size(array_distinct(ls)) as bigint)")),
    }


#: SQL for the normalised form of a line l.
NORMAL = "btrim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\\\\x20\\\\x09-\\\\x0D]+', ' '))"


def hashed_lines(text: str = "text") -> Column:
    """Array of (hash of the normalised line, number of its words) for the lines with a word."""
    return F.expr(f"transform(filter(split(coalesce({text}, ''), '\\n', -1), l -> btrim(l, {BLANKS}) <> ''), l -> struct(xxhash64({NORMAL}) as h, size({words('l')}) as n))")


def frequent_lines(docs: DataFrame, share: float, least: int) -> DataFrame:
    """For each distinct (source, text) its lines above the limit: host, text_hash, h, n (words)."""
    texts = docs.select(F.col("source").alias("host"), text_hash().alias("text_hash"), hashed_lines().alias("lines"))
    texts = checkpoint(texts.groupBy("host", "text_hash").agg(F.first("lines").alias("lines")))
    held = texts.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = texts.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("n_texts"))
    frequent = held.filter(F.col("n") > least).join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.col("n_texts") * share)
    frequent = frequent.select(F.col("host").alias("of"), F.col("h").alias("line"))
    lines = texts.select("host", "text_hash", F.inline("lines"))
    return lines.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line")), "left_semi")


def text_hash() -> Column:
    """Identity of a text (null: empty): 64-bit hash and length, as one string."""
    return F.expr("concat_ws(':', xxhash64(coalesce(text, '')), octet_length(coalesce(text, '')))")


def verdicts(docs: DataFrame, share: float, least: int, remain: float, *columns: str) -> DataFrame:
    """docs' columns (those named), with the measures, removed_words, the hashes of the removed lines, base_failed and keep_."""
    measured = docs.select(*columns, F.col("source").alias("host_"), text_hash().alias("text_"), *[c.alias(n + "_") for n, c in base_rules().items()])
    lines = F.collect_set("h") if "text" in columns else F.lit(None)
    removed = frequent_lines(docs, share, least).groupBy("host", "text_hash").agg(F.sum("n").alias("removed_words"), lines.alias("lines_"))
    joined = measured.join(removed, F.col("host_").eqNullSafe(F.col("host")) & (F.col("text_") == F.col("text_hash")), "left")
    n_words, repeat = F.col("measured_.n_words"), F.col("measured_.n_repeat_words")
    gone = F.coalesce("removed_words", F.lit(0).cast("long"))
    failed = (n_words < 50) | (repeat * 100 > n_words * 50)
    return joined.select(*columns, "lines_", *[F.col(n + "_") for n in base_rules()], gone.alias("gone_"), failed.alias("failed_"), (~failed & (n_words - gone >= n_words * remain)).alias("keep_"))


def judge(docs: DataFrame, share: float = 0.05, least: int = 10, remain: float = 0.5) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): measures, base_failed, removed_words and kept."""
    return verdicts(docs, share, least, remain, "doc_id").select(
        "doc_id", F.col("measured_.n_words").alias("n_words"), F.col("word_chars_").alias("word_chars"), F.col("n_symbols_").alias("n_symbols"),
        F.col("n_dup_lines_").alias("n_dup_lines"), F.col("measured_.n_repeat_words").alias("n_repeat_words"), F.col("failed_").alias("base_failed"),
        F.col("gone_").alias("removed_words"), F.col("keep_").alias("kept"),
    )


def kept(docs: DataFrame, share: float = 0.05, least: int = 10, remain: float = 0.5) -> DataFrame:
    """The rows of docs that pass, with their columns; text is without its lines above the limit."""
    names = docs.columns
    rest = F.expr(f"array_join(filter(split(text, '\\n', -1), l -> btrim(l, {BLANKS}) = '' or not array_contains(lines_, xxhash64({NORMAL}))), '\\n')")
    passed = verdicts(docs, share, least, remain, *names).filter("keep_")
    return passed.withColumn("text", F.when(F.col("lines_").isNull(), F.col("text")).otherwise(rest)).select(*names)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged, with the production limits."""
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents
), w as (
  select r, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d
), win as (
  select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
), hit as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1
), rep as (
  select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from hit) group by r
), l as (
  select r, source, t, unnest(string_split(t, chr(10))) as line from d
), lw as (
  select r, source, t, line, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) as norm,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')
), dup as (
  select r, count(*) - count(distinct line) as n from lw group by r
), host as (
  select source, count(distinct t) as n from d group by source
), freq as (
  select lw.source, lw.norm from lw join host on lw.source is not distinct from host.source group by lw.source, lw.norm, host.n
  having count(distinct lw.t) > 10 and count(distinct lw.t) > host.n * 0.05
), gone as (
  select lw.r, sum(lw.n) as n from lw join freq on lw.source is not distinct from freq.source and lw.norm = freq.norm group by lw.r
), m as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(coalesce(gone.n, 0) as bigint) as removed_words
  from w left join dup using (r) left join rep using (r) left join gone using (r)
), f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  not base_failed and n_words - removed_words >= n_words * 0.5 as kept from f
"""
