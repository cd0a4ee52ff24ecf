"""Dot text to print, and the clean-up of what comes out."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.functions.encode import blank_to_space
from dotframe.functions.text import strip_orphans

# Dots of the first ten letters.
FIRST_TEN = ("1", "12", "14", "145", "15", "124", "1245", "125", "24", "245")


def alphabet() -> dict[str, str]:
    """Dot character -> letter of the uncontracted code: k to t are a to j with
    dot 3, u v x y z are a to e with dots 3 and 6, and w is dots 2456."""
    dots = dict(zip("abcdefghij", FIRST_TEN))
    dots |= {k: d + "3" for k, d in zip("klmnopqrst", FIRST_TEN)}
    dots |= {k: d + "36" for k, d in zip("uvxyz", FIRST_TEN)} | {"w": "2456"}
    return {chr(0x2800 + sum(1 << (int(x) - 1) for x in d)): k for k, d in dots.items()} | {chr(0x2800): " "}


def back_translate(text: Column) -> Column:
    """Letters for their cells; everything else stays."""
    table = alphabet()
    return F.translate(text, "".join(table), "".join(table.values()))


def with_translator(lines: DataFrame, translate: Callable[[list[str]], list[str]], column: str = "text") -> DataFrame:
    """Adds ``translated`` by an outside translator that takes a batch of
    lines of dot characters, their blanks as spaces and stripped. Lines that
    are blank then become empty without a call. Where a batch fails, its lines
    are tried one by one, and what a line raises becomes text, as
    ``(error: ...)``."""

    def one(line: str) -> str:
        try:
            return translate([line])[0]
        except Exception as e:  # noqa: BLE001 - the translator is not ours
            return f"(error: {e})"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = pdf["_line"].tolist()
            at = [i for i, x in enumerate(out) if x]
            some = [out[i] for i in at]
            try:
                got = translate(some) if some else []
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} lines for {len(some)}")
            except Exception:  # noqa: BLE001
                got = [one(x) for x in some]
            for i, x in zip(at, got):
                out[i] = x
            yield pdf.drop(columns=["_line"]).assign(translated=out)

    ready = lines.withColumn("_line", F.coalesce(blank_to_space(F.col(column)), F.lit("")))
    return ready.mapInPandas(run, lines.select("*", F.lit("").alias("translated")).schema)


def command(program: str = "lou_translate", tables: str = "en-ueb-g2.ctb", timeout: float = 10.0) -> Callable[[list[str]], list[str]]:
    """A translator that runs a program for each line, with the tables it is to
    use: what it prints, or ``(err: ...)`` with what it complains of. A line
    that takes longer than ``timeout`` seconds raises."""

    def run(lines: list[str]) -> list[str]:
        out = []
        for line in lines:
            done = subprocess.run([program, "-b", tables], input=line, capture_output=True, text=True, timeout=timeout, check=False)
            out.append(done.stdout.strip() if done.returncode == 0 else f"(err: {done.stderr.strip()})")
        return out

    return run


def _deletes(word: Column) -> Column:
    """The word and what is left of it without one or two characters: two
    words within two edits have one of these in common."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(word), one(word), F.flatten(F.transform(one(word), one))))


#: Words that a dictionary of general language lacks.
DOMAIN = (
    "skiing", "leashes", "vibrotactile", "tactile", "slope", "slopes", "strap", "straps", "system", "systems", "function", "functions",
    "signal", "signals", "skier", "skiers", "retractable",
)
#: The dictionary's share of all words of the texts, each counted as often as
#: it occurs.
COVERED = 0.999


def dictionary(words: DataFrame, covered: float = COVERED) -> DataFrame:
    """(word, freq): the most frequent words, with those as frequent as the
    last, that make up ``covered`` of the texts, and the domain words. A share,
    so it's no smaller a part of the job as the texts grow."""
    classes = words.groupBy("freq").agg((F.count(F.lit(1)) * F.col("freq")).alias("n"))
    # a row for each different frequency
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = classes.withColumn("above", above).withColumn("total", F.sum("n").over(W.partitionBy())).where(F.col("above") < F.col("total") * covered).agg(F.min("freq").alias("least"))
    domain = words.sparkSession.createDataFrame([(w, 0) for w in DOMAIN], "word string, freq long")
    usual = words.crossJoin(F.broadcast(least)).where("freq >= least").select("word", "freq")
    rare = words.join(F.broadcast(domain.select("word")), "word", "left_semi").select("word", "freq")
    return usual.unionByName(rare).unionByName(domain).groupBy("word").agg(F.max("freq").alias("freq"))


def unknown_words(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Words of the texts that the dictionary lacks."""
    return words.select("word").join((dictionary(words) if known is None else known).select("word"), "word", "left_anti")


def corrections(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, correction): the dictionary word (word, freq) within two edits
    of each unknown one, by distance, then frequency, then alphabet. Words
    meet by what deletions leave of them, not all with all."""
    keys = lambda df, w: df.select("*", F.explode(_deletes(F.col(w))).alias("_k"))
    u = keys(unknown.select("word").distinct(), "word")
    d = keys(dictionary.select(F.col("word").alias("correction"), "freq"), "correction")
    met = u.join(d, "_k").drop("_k").distinct().withColumn("distance", F.levenshtein("word", "correction", 2)).where("distance >= 0")
    best = F.min_by(F.col("correction"), F.struct("distance", (-F.col("freq")).alias("f"), "correction"))
    return met.groupBy("word").agg(best.alias("correction"))


def clean(text: Column) -> Column:
    return strip_orphans(text)
