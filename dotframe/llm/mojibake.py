"""Documents read in a wrong character encoding, and their original text.

Every distinct clean word of the corpus, and every character of such words, is
put through all encoding chains. The garbled forms are a table that the
corpus's own words are hash-joined against. Which of a matching pair is the
original is told by the look of the two words, else by the words beside them
that are told so, else by the number of different texts that hold each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.session import staged

# Encodings that texts are written in or wrongly read in.
SINGLE_BYTE = (
    "cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp852", "mac-roman",
    "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic",
)
WRITTEN = ("utf-8", *SINGLE_BYTE)
#: Wrong readings of UTF-8 that occur twice in a row.
TWICE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman")
#: Readings in which pairs of letters of a language are valid UTF-8: there
#: only whole words count.
WHOLE_ONLY = ("cp1251", "koi8-r", "iso8859-5", "mac-cyrillic")
#: A character counts as the corpus's own from so many words and documents on,
#: copies included.
OWN_TIMES = 2
#: Where nothing else tells, the original must be so many times as frequent as
#: its garbled form; more for single characters, which many encodings make of
#: each other.
RATIO = 2
SINGLE_RATIO = 20
LOST = "�"

#: Words: ASCII letters, HTML escapes and other characters, at least one of
#: the last; dot cells, their blanks and joiners separate. In both dialects.
_OTHER = r"[^\x00-\x7F⠀-⣿​-‍️﻿]"
_REST = r"[^\x00-\x40\x5B-\x60\x7B-\x7F⠀-⣿​-‍️﻿]"
_ESCAPES = "(?:&[A-Za-z]{2,8};[A-Za-z]*+)*"
TOKEN = rf"(?<![A-Za-z])[A-Za-z]*+{_ESCAPES}{_OTHER}{_REST}*+"
#: ASCII text from a separator to a separator: nothing of it is in a word with
#: other characters.
_SEPARATOR = r"[\x00-\x25\x27-\x3A\x3C-\x40\x5B-\x60\x7B-\x7F]"
ASCII_RUN = rf"{_SEPARATOR}[\x00-\x7F]*{_SEPARATOR}"
CONTROL = "[\u0080-\u0084\u0086-\u009f]"


def _tables(encoding: str) -> tuple[dict[str, int], list[str]]:
    """(character -> byte, byte -> character); bytes an encoding leaves free
    are read as the control characters of the same number, as browsers do."""
    read = []
    for i in range(256):
        try:
            read.append(bytes([i]).decode(encoding))
        except UnicodeDecodeError:
            read.append(chr(i))
    return {c: i for i, c in reversed(list(enumerate(read)))}, read


TABLES = {e: _tables(e) for e in SINGLE_BYTE}


def written(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "replace")
    to = TABLES[encoding][0]
    try:
        return bytes(to[c] for c in text)
    except KeyError:
        return None


def read_as(data: bytes, encoding: str) -> str:
    if encoding == "utf-8":
        return data.decode("utf-8", "replace")
    table = TABLES[encoding][1]
    return "".join([table[b] for b in data])


def garbled_forms(word: str) -> dict[str, str]:
    """{garbled form: chain} of a word under every encoding chain: written in
    one, read in another; UTF-8 misread twice; and written in a single-byte
    encoding but read as UTF-8, with what is lost. Where a form holds blanks,
    its parts count too, since blanks get changed on the way."""
    out: dict[str, str] = {}

    def add(form: str, chain: str) -> None:
        if form != word and any(c > "\x7f" for c in form):
            out.setdefault(form, chain)
            if "\xa0" in form or "\x85" in form:
                for part in form.replace("\x85", "\xa0").split("\xa0"):
                    if part != word and any(c > "\x7f" for c in part):
                        out.setdefault(part, chain + " part")

    for w in WRITTEN:
        data = written(word, w)
        if data is None or data == word.encode("utf-8") and w != "utf-8":
            continue
        for r in SINGLE_BYTE:
            if r != w:
                once = read_as(data, r)
                add(once, f"{w}>{r}")
                if w == "utf-8" and r in TWICE:
                    for r2 in TWICE:
                        add(read_as(once.encode("utf-8"), r2), f"{w}>{r}>utf-8>{r2}")
        if w != "utf-8":
            add(read_as(data, "utf-8"), f"{w}>utf-8")
    return out


_ESCAPE = re.compile("&[A-Za-z]{2,8};")
_BREAKS = re.compile(r"[\s\xa0\xad'’‘“”„‚«»‹›…–—‐‑-]+")


def _script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin" if c <= "ɏ" or "Ḁ" <= c <= "ỿ" else "other"


def looks(word: str) -> int:
    """1 of a word as languages write them; 0 of one with signs between its
    letters, of two scripts, with a capital after a small letter (one of them
    beyond ASCII) or five or more letters beyond ASCII in a row in Latin
    script; -1 of less than three letters, which tell nothing."""
    word = _ESCAPE.sub("e", word)
    if sum(map(str.isalpha, word)) < 3:
        return -1
    for part in _BREAKS.split(word):
        at = [i for i, c in enumerate(part) if c.isalpha()]
        core = part[at[0] : at[-1] + 1] if at else ""
        row = 0
        for k, c in enumerate(core):
            if not c.isalpha() and unicodedata.category(c) not in ("Mn", "Cf"):
                return 0
            before = core[k - 1] if k else ""
            if before.islower() and c.isupper() and max(before, c) > "\x7f":
                return 0
            row = row + 1 if c > "\x7f" and c.isalpha() and _script(c) == "latin" else 0
            if row >= 5:
                return 0
        if len({_script(c) for c in core if c.isalpha()}) > 1:
            return 0
    return 1


def _other(kind: str) -> bool:
    return "Ѐ" <= kind <= "ӿ"


def sequences(own: dict[str, int]) -> dict[str, str]:
    """{garbled sequence: character} of the corpus's own characters, for UTF-8
    read in an encoding where such a sequence is nothing else."""
    out: dict[str, str] = {}
    for r in reversed(SINGLE_BYTE):  # the first overrules
        for c in sorted(own, key=own.get):  # as does the more frequent
            if c > "\x7f" and c != LOST and r not in WHOLE_ONLY and not _other(c):
                out[read_as(c.encode("utf-8"), r)] = c
    return out


def whole_word(token: str, own: dict[str, int], times: int = 3) -> str | None:
    """The token's original if all of it is UTF-8 read in one encoding, up to
    ``times`` times in a row."""
    deeper = None
    for r in SINGLE_BYTE:
        data = written(token, r)
        if data is None or all(b < 0x80 for b in data):
            continue
        try:
            word = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if all(c <= "\x7f" or c in own or "⠀" <= c <= "⣿" for c in word):
            return word
        if deeper is None and times > 1:
            deeper = whole_word(word, own, times - 1)
    return deeper


class Reader:
    """Undoes UTF-8 misreadings by their sequences, again and again."""

    def __init__(self, own: dict[str, int], drop: frozenset[str] = frozenset()):
        self.own = own
        self.map = {s: c for s, c in sequences(own).items() if s not in drop}
        parts = sorted(map(re.escape, self.map), key=len, reverse=True)
        self.pattern = re.compile("|".join(parts)) if parts else None

    def found(self, token: str) -> list[str]:
        return self.pattern.findall(token) if self.pattern else []

    def restore(self, token: str) -> str:
        for _ in range(4):
            word = whole_word(token, self.own)
            if word is None and self.pattern:
                word = self.pattern.sub(lambda m: self.map[m[0]], token)
            if not word or word == token:
                break
            token = word
        return token


def document_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, token, text_id): distinct words with other than ASCII
    characters; copies of a text have the same text_id. A no-break blank may be the text's own or a garbled byte: words with one
    count whole and in parts."""
    plain = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), F.regexp_replace("text", ASCII_RUN, " ").alias("_t"))
    # A step of its own, lest the pattern runs once for each use.
    found = plain.select("doc_id", "text_id", F.expr(f"regexp_extract_all(_t, r'{TOKEN}', 0)").alias("_w")).where("size(_w) > 0")
    parts = F.flatten(F.transform(F.filter("_w", lambda t: F.contains(t, F.lit("\xa0"))), lambda t: F.split(t, "\xa0")))
    other = F.filter(parts, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return (
        found.select("doc_id", F.explode(F.array_union("_w", other)).alias("token"), "text_id")
        .where(~F.col("token").rlike("^\xa0*$"))
    )


def own_characters(vocabulary: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Characters that occur OWN_TIMES or more, at most as many as Unicode has,
    with their weights in documents and in different texts."""
    chars = vocabulary.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c"), "df", "nt").where("c <> ''")
    rows = chars.groupBy("c").agg(F.sum("df").alias("n"), F.sum("nt").alias("nt")).where(F.col("n") >= OWN_TIMES).collect()
    return {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}


def _directed(matched: DataFrame, judged: DataFrame, tokens: DataFrame) -> DataFrame:
    """Of the matched pairs (read, df, nt, look; original, n, n_texts,
    original_look, how) those in which ``original`` is the original. The look
    of the words tells, if it differs. Else the words of the texts that hold
    ``read`` tell, if most of these texts have ones that are told by their look
    under the same chain. Else the original is in RATIO times as many texts,
    or in RATIO times as many documents and no fewer texts."""
    sign = F.expr("case when original_look = 1 and look = 0 then 1 when original_look = 0 and look = 1 then -1 else 0 end")
    signed = staged(matched.withColumn("sign", sign).withColumn("chain", F.regexp_replace("how", " part$", "")), "matched")
    places = judged.select("token", "read").join(tokens.select("text_id", "token"), "token").select("text_id", "read").distinct()
    told = (
        signed.where("sign <> 0").groupBy("read", "chain").agg(F.max("sign").alias("sign"))
        .join(places, "read").groupBy("text_id", "chain").agg(F.sum("sign").alias("sum")).where("sum <> 0")
    )
    beside = (
        signed.where("sign = 0").select("read", "chain").distinct().join(places, "read").join(told, ["text_id", "chain"])
        .groupBy("read", "chain").agg(F.count_if(F.col("sum") > 0).alias("pro"), F.count_if(F.col("sum") < 0).alias("con"))
    )
    ratio = F.when(F.length("read") == 1, SINGLE_RATIO).otherwise(RATIO)
    often = (F.col("n_texts") >= ratio * F.col("nt")) | (F.col("n") >= ratio * F.col("df")) & (F.col("n_texts") >= F.col("nt"))
    by_words = F.when(F.col("pro") * 2 > F.col("nt"), True).when(F.col("con") * 2 > F.col("nt"), False).otherwise(often)
    by_words = F.when(F.length("read") == 1, often).otherwise(by_words)
    return signed.join(beside, ["read", "chain"], "left").where(F.when(F.col("sign") != 0, F.col("sign") > 0).otherwise(by_words))


def substitutions(documents: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(token, original, how) of the garbled words of the corpus. ``original``
    is null where it can't be told. ``tokens`` are document_tokens, if they
    are there already."""
    spark = documents.sparkSession
    tokens = document_tokens(documents) if tokens is None else tokens
    by_text = tokens.groupBy("token", "text_id").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = staged(by_text.groupBy("token").agg(F.sum("df").alias("df"), F.count(F.lit(1)).alias("nt")), "vocabulary")
    own, own_texts = own_characters(vocabulary)
    own_b = spark.sparkContext.broadcast(own)

    # Sequences as frequent as the character they would stand for are no garbling.
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(own_b.value)
        for batch in batches:
            n: dict[str, int] = defaultdict(int)
            nt: dict[str, int] = defaultdict(int)
            for token, df, texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for s in set(reader.found(token)):
                    n[s] += df
                    nt[s] += texts
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(list(nt.values()), pa.int64())], ["s", "n", "nt"])

    counts = vocabulary.mapInArrow(seen, "s string, n long, nt long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("nt").alias("nt")).collect()
    table = sequences(own)
    usual = frozenset(r[0] for r in counts if r[1] * RATIO > own[table[r[0]]] and r[2] * RATIO > own_texts[table[r[0]]])
    drop = spark.sparkContext.broadcast(usual)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(own_b.value, drop.value)
        control = re.compile(CONTROL)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            read = [reader.restore(t) for t in tokens]
            hard = [LOST in t or bool(control.search(t)) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(read, pa.string()), pa.array(hard, pa.bool_()), pa.array(list(map(looks, read)), pa.int32())], ["token", "df", "nt", "read", "hard", "look"]
            )

    judged = staged(vocabulary.mapInArrow(judge, "token string, df long, nt long, read string, hard boolean, look int"), "judged")
    clean = judged.where("not hard and read = token").select("token", "df", "nt", "look")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, g, how = [], [], []
            for i, token in enumerate(batch.column(0).to_pylist()):
                f = garbled_forms(token)
                g += f.keys()
                how += f.values()
                at += [i] * len(f)
            of = [c.take(pa.array(at, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), *of, pa.array(how, pa.string())], ["form", "original", "n", "n_texts", "original_look", "how"])

    table = clean.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(
        forms, "form string, original string, n long, n_texts long, original_look int, how string"
    )
    # A lost character alone can be any, and a single letter of another script
    # is a word of its own, not garbled punctuation.
    letter = F.col("read").rlike(f"^{LOST}+$") | (F.length("read") == 1) & F.col("read").rlike(r"[\p{IsCyrillic}\p{IsGreek}]") & ~F.col("original").rlike(r"\p{L}")
    # The table is many times as large as the words it comes from, which is all
    # that the planner knows of: it is never to be broadcast.
    table = table.hint("merge")
    matched = (
        judged.groupBy("read").agg(F.sum("df").alias("df"), F.sum("nt").alias("nt"), F.first("look").alias("look"))
        .join(table, F.col("read") == F.col("form")).drop("form")
        .where((F.col("original") != F.col("read")) & ~letter)
    )
    by_word = (
        _directed(matched, judged, tokens)
        .groupBy("read").agg(F.max_by(F.struct("original", "how"), F.struct("sign", "n_texts", "n", "original")).alias("best"))
    )
    # Of words whose sequences can be undone the table tells by which chain, if
    # it holds what they are undone to.
    undone = judged.where("read <> token").select(F.col("token").alias("form"), F.col("read").alias("original"))
    by_table = undone.join(table, ["form", "original"]).groupBy(F.col("form").alias("token")).agg(F.min("how").alias("chain"))
    dots = F.col("token").isin(*dot_parts())
    whole = F.expr("if(best.how not like '% part', best.original, null)")
    read = F.expr("if(read <> token, read, null)")
    how = F.coalesce("best.how", "chain", F.expr("if(read <> token, 'sequences', 'lost')"))
    return (
        judged.join(by_word, "read", "left").join(by_table, "token", "left")
        .where(F.expr("best is not null or hard or read <> token") | dots)
        .select("token", F.coalesce(whole, read).alias("original"), how.alias("how"))
    )


def dot_parts() -> list[str]:
    """Garbled forms of two dot cells between no-break blanks that became plain
    ones: the last byte of one cell and the first of the next. Dot cells belong
    to the project's texts whether or not a corpus holds any, so a document is
    told alike in every corpus."""
    out = set()
    for r in ("cp1252", "latin-1", "cp1250", "iso8859-2"):
        for b in range(0x80, 0xC0):
            out.add(read_as(bytes([b, 0xE2]), r))
    return sorted(out)


def affected(documents: DataFrame, subs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, words): documents with garbled words, their number,
    and the garbled words with their originals."""
    tokens = document_tokens(documents) if tokens is None else tokens
    return (
        tokens.join(subs, "token")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_words"), F.collect_list(F.struct("token", "original")).alias("words"))
    )


def restored(documents: DataFrame, subs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_lost) of the affected documents: garbled
    words replaced by their originals, the rest of the text untouched. n_lost
    words have no known original and stay. Null and empty texts are never
    affected; copies of a document are each restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(TOKEN)
        for batch in batches:
            texts = []
            for text, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                to = {w["token"]: w["original"] for w in words if w["original"] is not None}
                texts.append(word.sub(lambda m, to=to: to.get(m[0]) or "\xa0".join(to.get(p, p) for p in m[0].split("\xa0")), text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(3), batch.column(4)], ["doc_id", "text", "n_words", "n_lost"])

    lost = F.size(F.filter("words", lambda w: w["original"].isNull())).cast("long").alias("n_lost")
    some = documents.select("doc_id", "text").join(affected(documents, subs, tokens), "doc_id").select("doc_id", "text", "words", "n_words", lost)
    return some.mapInArrow(run, f"doc_id {dict(some.dtypes)['doc_id']}, text string, n_words long, n_lost long")
