"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is its lines that have words (words: runs without ASCII white space); blank lines only follow. Where lines
begin is counted in words.

1. A *gram* at a line is the shortest run of lines from there with ``gram_words`` words; its hash is the MD5 of the
   lines' MD5s.
2. *Winnowing*: of the grams that begin within each stretch of ``min_words - gram_words`` words, the one with the
   smallest hash is a fingerprint (the first of equals), if ``min_words`` words are left from the stretch's start. Any
   run of ``min_words`` words that occurs twice has a fingerprint in common.
3. *Join positions*: every occurrence of a fingerprint is held against its first, by (id, text hash, line), one row
   each; occurrences are never paired with one another.
4. *Extend*: lines before and after that agree with those at the first occurrence are added, up to ``REACH`` lines to
   either side; runs of neighbouring fingerprints that overlap or touch join up, so a long run is one.
5. *Regroup*: where that leaves open whether a run around a later occurrence stands earlier (the first occurrence of
   the fingerprint is in other text), the minimal runs of whole lines with ``min_words`` words around it are grouped by
   their hash, and each is held against the first of its own group. Again one row each, never pairs.
6. Joined runs of at least ``min_words`` words and repeated minimal runs are deleted from the later document. Together
   they are all lines of every run of ``min_words`` words or more that stands earlier, in the corpus or the document.

Defined cases
  null text: no lines, stays null; empty text: stays; a text all of whose lines go becomes empty (``drop_emptied`` drops
  the row); repeated rows (same id and text): as one, each gets the same result; rows with the same id and other texts: told apart by a
  hash of the text; null ids: come before others; ties between fingerprints: the first place wins; very long texts: whole,
  as one row; empty table: empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import BitFilter, Scratch, free_name

MIN_WORDS, GRAM_WORDS, REACH = 50, 25, 75
_WORD = r"[^\x20\x09-\x0D]+"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def text_lines(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tkey, lines): a document's lines with words, in order, as structs of MD5, words and line number."""
    body = F.col(text).cast("string")
    numbered = F.transform(_split(body), lambda s, i: F.struct(F.unhex(F.md5(s)).alias("h"), F.regexp_count(s, F.lit(_WORD)).alias("w"), i.alias("ln")))
    lines = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("tkey"), F.filter(numbered, lambda x: x["w"] > 0).alias("lines")).filter("size(lines) > 0")
    return lines.dropDuplicates(["id", "tkey"])


def fingerprints(lines: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """(id, tkey, pos, start, gram) of the selected grams. Windows run over one document each."""
    each = lines.repartition("id", "tkey").select("id", "tkey", F.posexplode("lines").alias("pos", "line")).select("id", "tkey", "pos", F.col("line.h").alias("h"), F.col("line.w").cast("long").alias("w"))
    in_order = W.partitionBy("id", "tkey").orderBy("pos")
    each = each.withColumns({"start": F.coalesce(F.sum("w").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")), "total": F.sum("w").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    by_word = W.partitionBy("id", "tkey").orderBy("start")
    span = min_words - gram_words
    hashes = F.collect_list("h").over(by_word.rangeBetween(0, gram_words - 1))
    joined = F.aggregate(hashes, F.lit(b"").cast("binary"), lambda a, h: F.concat(a, h))
    each = each.withColumn("gram", F.when(F.col("total") - F.col("start") >= gram_words, F.unhex(F.md5(joined)))).filter("gram IS NOT NULL")
    least = F.min(F.struct("gram", "start")).over(by_word.rangeBetween(0, span))
    each = each.withColumn("least", F.when(F.col("total") - F.col("start") >= min_words, least["start"]))
    chosen = F.collect_set("least").over(by_word.rangeBetween(-span, 0))
    return each.withColumn("chosen", F.array_contains(chosen, F.col("start"))).filter("chosen").select("id", "tkey", "pos", "start", "gram")


def open_runs(min_words: int, span: int) -> Column:
    """(run, ln_a, ln_b) of the runs of lines around a fingerprint that its first occurrence does not settle.

    Those are the runs that begin at most ``span`` words before the fingerprint, have ``min_words`` words, reach beyond
    the lines that agree with the first occurrence and are minimal: they fall short without their first or their last
    line, or are two lines. Any longer run is made up of such, each overlapping the next. The fingerprint that winnowing
    gives the stretch at a run's start is the same at all its occurrences, so every one of them is here if one is.
    """
    sized = lambda lines: F.transform(lines, lambda x: x["w"].cast("long"))
    total = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda a, w: a + w)
    ended_ahead = (F.col("n_ahead") == F.size("ahead")) | (total(sized(F.slice("ahead", F.lit(2), F.greatest(F.col("n_ahead") - 1, F.lit(0))))) >= min_words)
    ended_behind = (F.col("n_behind") == F.size("behind")) | (total(sized(F.slice("behind", F.lit(1), F.col("n_behind")))) > span)
    near = F.struct(F.concat(F.reverse(F.slice("behind", 1, span)), F.slice("ahead", 1, min_words + 1)).alias("lines"), F.least(F.size("behind"), F.lit(span)).alias("m"))

    def counted(x: Column) -> Column:
        starts = F.aggregate(sized(x["lines"]), F.array(F.lit(0).cast("long")), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))
        return F.struct(x["lines"].alias("lines"), x["m"].alias("m"), starts.alias("at"))

    def minimal(x: Column) -> Column:
        words = lambda a, b: F.get(x["at"], b) - F.get(x["at"], a)
        begins = F.filter(F.sequence(F.lit(0), x["m"]), lambda a: words(a, x["m"]) <= span)
        ends = lambda a: F.filter(F.sequence(a + 1, F.least(a + min_words, F.size(x["lines"]))), lambda b: (words(a, b) >= min_words) & ((words(a, b - 1) < min_words) | (words(a + 1, b) < min_words) | (b == a + 2)) & ((x["m"] - a > F.col("n_behind")) | (b - x["m"] > F.col("n_ahead"))))
        cut = lambda a, b: F.slice(x["lines"], a + 1, b - a)
        run = lambda a, b: F.struct(F.unhex(F.md5(F.aggregate(cut(a, b), F.lit(b"").cast("binary"), lambda h, y: F.concat(h, y["h"])))).alias("run"), F.get(x["lines"], a)["ln"].alias("ln_a"), F.get(x["lines"], b - 1)["ln"].alias("ln_b"))
        return F.flatten(F.transform(begins, lambda a: F.transform(ends(a), lambda b: run(a, b))))

    one = F.element_at(F.transform(F.transform(F.array(near), counted), minimal), 1)
    return F.when(~(ended_ahead & ended_behind), one)


def _united(runs: Column) -> Column:
    """Sorted runs, those that overlap as one."""
    grow = lambda out, r: F.when((F.size(out) > 0) & (r["ln_a"] <= F.element_at(out, -1)["ln_b"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["ln_a"].alias("ln_a"), F.greatest(F.element_at(out, -1)["ln_b"], r["ln_b"]).alias("ln_b"))))).otherwise(F.concat(out, F.array(r)))
    return F.aggregate(runs, F.slice(runs, 1, 0), grow)


def repeated_runs(docs: DataFrame, scratch: Scratch, *, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, reach: int = REACH) -> DataFrame:
    """(id, tkey, runs): for each document with later repeats, the line numbers (from, to, both included) to delete."""
    reach = max(reach, min_words + 1)  # what regrouping sees
    lines = scratch.save(text_lines(docs, id_column=id_column, text=text), "lines")
    prints = scratch.save(fingerprints(lines, min_words, gram_words), "fingerprints")
    place = F.struct(F.col("id"), F.col("tkey"), F.col("pos"))
    first = prints.groupBy("gram").agg(F.min(place).alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "src")
    later = BitFilter(first, "gram", 18).keep(prints, "gram").join(first, "gram").filter(F.col("src") < place).drop("gram")
    own = lines.select(F.col("id").alias("o_id"), F.col("tkey").alias("o_tkey"), "lines")
    later = later.join(own, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("tkey") == F.col("o_tkey"))).drop("o_id", "o_tkey")
    # What surrounds the fingerprint, before the next shuffle: the lines from it on, and those before it, nearest first.
    around = lambda pos: (F.slice("lines", pos + 1, F.lit(reach)), F.reverse(F.slice("lines", F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach)))))
    ahead, behind = around(F.col("pos"))
    later = later.select("id", "tkey", "pos", "start", F.col("src.id").alias("sid"), F.col("src.tkey").alias("stkey"), F.col("src.pos").alias("spos"), ahead.alias("ahead"), behind.alias("behind"))
    source = lines.select(F.col("id").alias("s_id"), F.col("tkey").alias("s_tkey"), "lines")
    both = later.join(source, F.col("sid").eqNullSafe(F.col("s_id")) & (F.col("stkey") == F.col("s_tkey")))
    s_ahead, s_behind = around(F.col("spos"))
    agree = lambda mine, theirs: F.array_position(F.zip_with(mine, theirs, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))), False)
    size = lambda mine, theirs: F.when(agree(mine, theirs) > 0, agree(mine, theirs) - 1).otherwise(F.size(mine)).cast("int")
    both = both.withColumns({"n_ahead": size(F.col("ahead"), s_ahead), "n_behind": size(F.col("behind"), s_behind)})
    taken = lambda column, n: F.slice(column, F.lit(1), n)
    words = lambda column, n: F.aggregate(taken(column, n), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    extents = both.select(
        "id", "tkey", "sid", "stkey", (F.col("pos") - F.col("spos")).alias("shift"),
        (F.col("pos") - F.col("n_behind")).alias("a"), (F.col("pos") + F.col("n_ahead")).alias("b"),
        (F.col("start") - words("behind", F.col("n_behind"))).alias("wa"), (F.col("start") + words("ahead", F.col("n_ahead"))).alias("wb"),
        F.when(F.col("n_behind") > 0, F.element_at("behind", F.greatest("n_behind", F.lit(1)))["ln"]).otherwise(F.element_at("ahead", 1)["ln"]).alias("ln_a"),
        F.element_at("ahead", F.greatest("n_ahead", F.lit(1)))["ln"].alias("ln_b"),
        open_runs(min_words, min_words - gram_words).alias("open"),
    )
    extents = scratch.save(extents, "extents")
    same = ["id", "tkey", "sid", "stkey", "shift"]
    in_order = W.partitionBy(*same).orderBy("a", "b")
    reached = F.max("b").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    islands = extents.withColumn("new", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    islands = islands.groupBy(*same, "island").agg(F.min("wa").alias("wa"), F.max("wb").alias("wb"), F.min("ln_a").alias("ln_a"), F.max("ln_b").alias("ln_b")).filter(F.col("wb") - F.col("wa") >= min_words)
    regrouped = extents.select("id", "tkey", F.explode("open").alias("r")).select("id", "tkey", "r.run", "r.ln_a", "r.ln_b")
    place = F.struct(F.col("id"), F.col("tkey"), F.col("ln_a"))
    origin = regrouped.groupBy("run").agg(F.min(place).alias("src"), F.max(place).alias("last")).filter(F.col("src") < F.col("last")).select("run", "src")
    repeated = BitFilter(origin, "run", 18).keep(regrouped, "run").join(origin, "run").filter(F.col("src") < place)
    found = islands.select("id", "tkey", "ln_a", "ln_b").unionByName(repeated.select("id", "tkey", "ln_a", "ln_b"))
    return found.groupBy("id", "tkey").agg(_united(F.sort_array(F.collect_set(F.struct("ln_a", "ln_b")))).alias("runs"))


def _marked(docs: DataFrame, id_column: str, text: str, runs_name: str, **options) -> DataFrame:
    """``docs`` with the runs to delete (null: none). Only documents that may have some are joined."""
    scratch = Scratch(docs.sparkSession, "lines")
    runs = scratch.save(repeated_runs(docs, scratch, id_column=id_column, text=text, **options), "runs")
    r_id, r_tkey, flag = (free_name(docs, c) for c in ("_r_id", "_r_tkey", "_maybe"))
    runs = runs.select(F.col("id").alias(r_id), F.col("tkey").alias(r_tkey), F.col("runs").alias(runs_name))
    marked = BitFilter(runs, r_id).mark(docs, id_column, flag)
    touched = marked.filter(flag).join(runs, F.col(id_column).eqNullSafe(F.col(r_id)) & (F.xxhash64(F.col(text).cast("string")) == F.col(r_tkey)), "left").drop(r_id, r_tkey, flag)
    rest = marked.filter(~F.col(flag)).drop(flag).withColumn(runs_name, F.lit(None).cast(runs.schema[runs_name].dataType))
    return touched.unionByName(rest)


def _inside(i: Column, runs: str) -> Column:
    return F.exists(runs, lambda r: i.between(r["ln_a"], r["ln_b"]))


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` without later repeated runs of lines; ``n_chars``, if there, follows the new text."""
    runs = free_name(docs, "_runs")
    marked = _marked(docs, id_column, text, runs, **options)
    kept = F.array_join(F.filter(_split(F.col(text)), lambda s, i: ~_inside(i, runs)), "\n")
    changed = F.col(runs).isNotNull()
    out = marked.withColumn(text, F.when(changed, kept).otherwise(F.col(text).cast("string")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(changed, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    if drop_emptied:
        out = out.filter(~changed | F.col(text).rlike(_WORD))
    return out.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = _marked(docs, "doc_id", "text", "runs")
    lines = _split(F.col("text"))
    kept = F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda s, i: ~_inside(i, "runs")), "\n"))
    deleted = F.when(F.col("runs").isNull(), 0).otherwise(F.size(F.filter(lines, lambda s, i: _inside(i, "runs"))))
    return marked.select("doc_id", F.size(lines).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), F.sha2(kept, 256).alias("text_sha256"))
