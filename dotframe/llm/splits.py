"""Pages of evaluation splits that occur, exactly or almost, in training.

A page is the sequence of its patterns; two are nearly the same if at most one
cell in ten of the longer one is changed, missing or added. Equal sequences
form one class, and the join runs between classes:

* An evaluation class of n cells is cut into floor(n / 9) + 1 segments, one
  more than the edits any partner allows. Some segment therefore occurs
  unchanged in every partner, moved by no more cells than there are edits. Of
  each segment the shingle that is rarest in the training pages is indexed:
  the evaluation prefix.
* Training classes probe with all their shingles, under a length and a
  position filter.
* Candidate pairs are verified with a banded edit distance.

No pair is lost: shingles are no longer than the shortest segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotframe.llm.sample import pattern_column
from dotframe.session import spread, staged

CHUNK = 4096
#: Cells of a page whose shingles are cut together; training pages of a class
#: that one task pairs.
BLOCK, PAIR_BLOCK = 256, 1024
#: Shingle length by the least number of cells of the evaluation page: never
#: more than n div (n div 9 + 1), the shortest segment.
SHINGLES = ((9, 4), (12, 6), (72, 8))
NAME_EXTENSIONS = "jpg|jpeg|jpe|png|tif|tiff|bmp|gif|webp"


def shingle_length(n: Column) -> Column:
    out = F.lit(None).cast("int")
    for least, q in SHINGLES:
        out = F.when(n >= least, q).otherwise(out)
    return out


#: Steps that bring the image name of a lower-case crop path into one spelling.
NAME_STEPS = (
    (r"\\", "/"),
    (r"%[0-9a-f]{2}", " "),
    (r"^.*/(train|val|test)/", ""),
    (rf"_\d+\.({NAME_EXTENSIONS})\s*$", ""),
    (rf"(\.({NAME_EXTENSIONS}|labeled))+($|[^a-z0-9])", "$3"),
    (r"[\s_-]*\(\s*(\d+|copy( *\d+)?)\s*\)", ""),
    (r"^copy( \d+)? of[^a-z0-9]+", ""),
    (r"[^a-z0-9]+(copy|duplicate)([^a-z0-9]*\d+)?\s*$", ""),
    (r"0*(\d+)", "|$1|"),
    (r"[^a-z0-9|]+", ""),
)


def image_name(path: Column) -> Column:
    """The image that a crop path names, in one spelling: without folders up
    to the split, cell number, extensions, marks of a copy, case, separators
    and leading zeros. Words and numbers stay."""
    s = F.lower(path)
    for pattern, to in NAME_STEPS:
        s = F.regexp_replace(s, pattern, to)
    return s


def pages(manifest: DataFrame) -> DataFrame:
    """One row per page: page_id, in_train, in_eval, source, seq (a character
    per pattern, in the order of cell_idx; null if it has none) and name (of
    pages on which every bits6 and label_int is null). Equal rows count once;
    rows without a page_id belong to no page. Chunks of a page are put together
    first, so that no task sorts all cells of a long page."""
    cell = F.struct("cell_idx", "crop_id", F.expr("chr(_p + 63)").alias("c"))
    chunk = (
        manifest.where("page_id is not null")
        .select(
            "page_id", "cell_idx", "crop_id", "source", "path", pattern_column().alias("_p"),
            F.floor(F.col("cell_idx") / CHUNK).alias("_chunk"),
            (F.col("split") == "train").alias("_t"), F.col("split").isin("val", "test").alias("_e"),
            (F.col("bits6").isNotNull() | F.col("label_int").isNotNull()).alias("_any"),
        )
        .groupBy("page_id", "_chunk")
        .agg(
            F.collect_set(F.when(F.col("_p").isNotNull(), cell)).alias("_cells"),
            F.max("_t").alias("_t"), F.max("_e").alias("_e"), F.max("_any").alias("_any"),
            F.min(F.lower(F.trim("source"))).alias("_source"), F.min("path").alias("_path"),
        )
        .withColumn("_text", F.array_join(F.transform(F.array_sort("_cells"), lambda x: x["c"]), ""))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_text"))), lambda x: x["_text"]), "")
    return (
        chunk.groupBy("page_id")
        .agg(
            F.coalesce(F.max("_t"), F.lit(False)).alias("in_train"), F.coalesce(F.max("_e"), F.lit(False)).alias("in_eval"),
            F.max("_any").alias("_any"), F.min("_source").alias("source"), F.min("_path").alias("_path"), joined.alias("_seq"),
        )
        .select(
            "page_id", "in_train", "in_eval", "source", F.when(F.col("_seq") != "", F.col("_seq")).alias("seq"),
            F.when(~F.col("_any"), image_name(F.col("_path"))).alias("name"),
        )
    )


def _shingles(classes: DataFrame, lengths: Column, runs: bool) -> DataFrame:
    """(cls, n, q, shingle, at, last) of all shingles of the given lengths; with
    ``runs`` one that follows itself again and again is one row from ``at`` to
    ``last``. Blocks of a sequence are cut first: a shingle is looked for near
    by and not from the beginning of a long page."""
    block = (
        classes.select("cls", "n", "seq", F.explode(lengths).alias("q")).where("n >= q")
        .select("cls", "n", "q", "seq", F.explode(F.expr(f"sequence(0, (n - q) div {BLOCK})")).alias("b"))
        .select("cls", "n", "q", F.expr(f"b * {BLOCK}").alias("base"), F.expr(f"substring(seq, cast(b * {BLOCK} as int) + 1, {BLOCK} + q - 1)").alias("part"))
        .withColumn("starts", F.expr("sequence(0, length(part) - q)"))
    )
    if runs:
        block = block.withColumn("starts", F.expr("filter(starts, i -> i = 0 or substring(part, i + 1, q) <> substring(part, i, q))"))
    each = F.expr("transform(starts, (i, k) -> struct(base + i as at, base + coalesce(get(starts, k + 1) - 1, length(part) - q) as last, substring(part, i + 1, q) as shingle))")
    return block.select("cls", "n", "q", F.explode(each).alias("s")).select("cls", "n", "q", "s.*")


def _candidates(train: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of a training and an evaluation class that share an indexed
    shingle within reach."""
    ends = [least for least, _ in SHINGLES[1:]] + [1 << 30]
    # Lengths that evaluation classes within reach of a training class have.
    met = [F.when((F.col("n") >= int(least * 0.9)) & (F.col("n") <= most * 10 // 9 + 1), q) for (least, q), most in zip(SHINGLES, ends)]
    probe = _shingles(train, F.array_compact(F.array(*met)), runs=True)
    usual = probe.groupBy("q", "shingle").agg(F.count(F.lit(1)).alias("df"))
    segments = F.expr("n div 9 + 1")
    prefix = (
        _shingles(held, F.array_compact(F.array(shingle_length(F.col("n")))), runs=False)
        .withColumn("segment", F.floor(F.col("at") * segments / F.col("n")))
        .where(F.floor((F.col("at") + F.col("q") - 1) * segments / F.col("n")) == F.col("segment"))
        .join(usual, ["q", "shingle"], "left")
        .groupBy("cls", "n", "q", "segment")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "shingle")).alias("rare"))
        .where("rare.df > 0")
        .select(F.col("cls").alias("e_cls"), F.col("n").alias("e_n"), "q", F.col("rare.at").alias("e_at"), F.col("rare.shingle").alias("shingle"))
    )
    edits = F.expr("greatest(n, e_n) div 10")
    return (
        probe.join(prefix, ["q", "shingle"])
        .where((F.abs(F.col("n") - F.col("e_n")) <= edits) & F.col("e_at").between(F.col("at") - edits, F.col("last") + edits))
        .select("cls", "e_cls").distinct()
    )


def class_pairs(classes: DataFrame) -> DataFrame:
    """(cls, e_cls) of different but nearly equal sequences, the first with
    pages in training, the second with pages in evaluation."""
    classes = spread(classes, "cls")  # few bytes, much work
    train, held = classes.where("in_train"), classes.where("in_eval")
    seqs = lambda side, c, s: side.select(F.col("cls").alias(c), F.col("seq").alias(s))
    return (
        _candidates(train, held).where("cls <> e_cls")
        .join(seqs(train, "cls", "a"), "cls")
        .join(seqs(held, "e_cls", "b"), "e_cls")
        .where(F.expr("levenshtein(a, b, cast(greatest(length(a), length(b)) div 10 as int)) >= 0"))
        .select("cls", "e_cls")
    )


def _linked(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links between classes: cls with training pages, e_cls with evaluation
    pages, kind; members: page_id, cls, source, in_train, in_eval)."""
    page = staged(pages(manifest).where("in_train or in_eval"), "pages")
    with_cls = page.where("seq is not null").withColumn("cls", F.sha2("seq", 256))
    classes = staged(
        with_cls.groupBy("cls").agg(F.min("seq").alias("seq"), F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval"))
        .withColumn("n", F.length("seq")), "classes",
    )
    near = class_pairs(classes).withColumn("kind", F.lit("near"))
    same = classes.where("in_train and in_eval").select("cls", F.col("cls").alias("e_cls"), F.lit("exact").alias("kind"))
    named = page.where("name is not null and name <> ''").withColumn("cls", F.concat(F.lit("name:"), "name"))
    by_name = (
        named.groupBy("cls").agg(F.max("in_train").alias("t"), F.max("in_eval").alias("e")).where("t and e")
        .select("cls", F.col("cls").alias("e_cls"), F.lit("name").alias("kind"))
    )
    member = with_cls.unionByName(named).select("page_id", "cls", "source", "in_train", "in_eval")
    return near.unionByName(same).unionByName(by_name), member


def page_links(manifest: DataFrame) -> DataFrame:
    """One row per page of train, val or test: page_id, cls (equal for pages of
    equal patterns, or of equal names where they have none), source, in_train,
    in_eval, n_eval (other evaluation pages that a training page is the same as
    or nearly) and n_train (other training pages that an evaluation page is).
    Counted by classes, so that copies aren't expanded into pairs. Pages with
    neither a pattern nor a name aren't in it."""
    links, member = _linked(manifest)
    member, links = staged(member, "member"), staged(links.select("cls", "e_cls"), "links")
    sizes = member.groupBy("cls").agg(F.count_if("in_train").alias("k_train"), F.count_if("in_eval").alias("k_eval"))
    to_eval = links.join(sizes.select(F.col("cls").alias("e_cls"), "k_eval"), "e_cls").groupBy("cls").agg(F.sum("k_eval").alias("s_eval"))
    to_train = links.join(sizes.select("cls", "k_train"), "cls").groupBy(F.col("e_cls").alias("cls")).agg(F.sum("k_train").alias("s_train"))
    itself = F.expr("if(in_train and in_eval, 1, 0)")  # its class is then linked to itself
    n = lambda role, total: F.when(F.col(role) & F.col(total).isNotNull(), F.col(total) - itself).otherwise(0)
    return (
        member.join(to_eval, "cls", "left").join(to_train, "cls", "left")
        .select("page_id", "cls", "source", "in_train", "in_eval", n("in_train", "s_eval").alias("n_eval"), n("in_eval", "s_train").alias("n_train"))
    )


def overlaps(manifest: DataFrame) -> DataFrame:
    """Pairs (train_page, eval_page) of one page in train and another in val
    or test that are the same or nearly the same, with both sources and
    ``kind``: exact, near or name (pages without any pattern that name the
    same image).

    Pages whose patterns are all spoilt, and those without a readable path,
    match nothing. A page in both sides pairs with other pages in either role.
    Every pair of copies is a row, as the result asks; the join itself runs
    between distinct sequences.
    """
    links, member = _linked(manifest)
    return _expand(links, staged(member, "member"))


def _expand(links: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of the members of linked classes; a class of many training pages
    is dealt out to as many tasks."""
    size = member.where("in_train").groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("page_id"), F.col("blocks")).cast("int").alias("block")
    t = member.where("in_train").join(size, "cls").select("cls", place, F.col("page_id").alias("train_page"), F.col("source").alias("train_source"))
    e = member.where("in_eval").select(F.col("cls").alias("e_cls"), F.col("page_id").alias("eval_page"), F.col("source").alias("eval_source"))
    wide = links.join(size, "cls").join(e, "e_cls").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return wide.join(t, ["cls", "block"]).where("train_page <> eval_page").select("train_page", "eval_page", "train_source", "eval_source", "kind")


def overlap_report(manifest: DataFrame, linked: DataFrame) -> DataFrame:
    """Per split and source: pages, and those of them with an overlap, by
    ``page_links``."""
    page = manifest.where("page_id is not null").groupBy("page_id", "split").agg(F.min(F.lower(F.trim("source"))).alias("source"))
    hit = linked.where("n_eval > 0 or n_train > 0").select("page_id").distinct().withColumn("hit", F.lit(1))
    return (
        page.join(hit, "page_id", "left")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.count("hit").alias("n_overlapping"))
    )
