"""Benchmark passages in documents: a prefix-filtered join of shingles, confirmed word by word; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW, SHINGLE = 13, 3
#: Prefix shingles (8 bytes each) that are broadcast; with more of them the join is shuffled.
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def item_words(text: Column) -> Column:
    """A text's words: A-Z lower-cased, runs of digits, a-z and characters beyond ASCII. Null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # there lower() changes A-Z alone, and faster
    t = F.btrim(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(_BREAK_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _BREAK))


def _shingles(df: DataFrame, size: int, carry: list[str]) -> DataFrame:
    """One row for each place (0-based ``pos``) of ``words`` with the ``key`` of the shingle of ``size`` words that starts there, or null; one row with a null place where there are no words."""
    spread = df.select(*carry, "words", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word"))
    rest = [F.get("words", F.col("pos") + k) for k in range(1, size)]
    return spread.withColumn("key", F.when(F.col("pos") + size <= F.col("n"), F.xxhash64(F.lit(size), "word", *rest))).drop("word")


def _few(df: DataFrame) -> bool:
    return len(df.limit(BROADCAST_ROWS + 1).select(F.lit(1)).groupBy().count().where(F.col("count") > BROADCAST_ROWS).take(1)) == 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Find every occurrence of a benchmark window in every document.

    A window is ``window`` consecutive words of an item; a shorter item is one window. Windows are sets of shingles
    (``shingle`` words, fewer in shorter windows). To hold a window a document must hold all its shingles, so the
    rarest one is a sufficient prefix: (1) the shingles of the benchmark are counted over all documents, (2) each
    window keeps the rarest, or drops out if one of its shingles occurs nowhere, (3) the documents' shingles meet
    those prefixes, (4) the place of the prefix in the window must leave room for the window in the document, and
    (5) the words at that place must equal the window's.

    Only the prefixes' 8-byte keys are broadcast, and only up to :data:`BROADCAST_ROWS` of them; beyond it the keys
    are joined by shuffle and the documents fetched by id afterwards. Otherwise no document text is shuffled.

    Returns per row: the id, n_words, n_hit (words inside an occurrence), n_items, item_ids (as sorted strings) and
    spans (start, length). Null or wordless texts have zeros. Rows with the same id and text get the same result
    each; rows that share an id but not a text are judged apart.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"), F.col(text_col).alias("text"))
    worded = d.select("id", "print", item_words(F.col("text")).alias("words"))

    item = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), item_words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    long = F.least(F.size("words"), F.lit(window))
    cut = item.select("item", F.col("words").alias("all"), long.alias("long"), F.explode(F.sequence(F.lit(1), F.size("words") - long + 1)).alias("at"))
    windows = stage(cut.groupBy(F.slice("all", F.col("at"), F.col("long")).alias("words")).agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    sizes = [r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]  # at most ``shingle`` numbers

    near = F.slice("words", F.greatest(F.col("pos") - (window - 1), F.lit(0)) + 1, 2 * window).alias("near")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if not sizes:
        met = worded.select("id", "print", F.size("words").alias("n"), F.lit(0).alias("pos"), F.lit(None).cast("long").alias("key"), F.col("words").alias("near"), F.lit(True).alias("first"))
        prefix = windows.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("offset"), F.col("words").alias("window"), "items").limit(0)
    else:
        own = None
        for s in sizes:
            part = _shingles(windows.where(F.least(F.size("words"), F.lit(shingle)) == s), s, ["items"]).where("key is not null")
            own = part if own is None else own.unionByName(part)
        keys = stage(own.select("key").distinct(), "shingles")
        counted = None
        for s in sizes:
            part = _shingles(worded, s, []).select("key").join(F.broadcast(keys) if _few(keys) else keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
            counted = part if counted is None else counted.union(part)
        counted = stage(counted, "counts")
        rarest = own.join(counted, "key", "left").groupBy("words", "items").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("pos"), F.col("key"))).alias("r"))
        prefix = stage(rarest.where("r.df > 0").select("r.key", F.col("r.pos").alias("offset"), F.col("words").alias("window"), "items"), "prefixes")
        few = stage(prefix.select("key").distinct(), "prefix-keys")
        met = None
        for s in sizes:
            head = first if s == sizes[0] else F.lit(False)  # one row a document tells its words
            if _few(few):
                each = _shingles(worded, s, ["id", "print"]).join(F.broadcast(few.select(F.col("key").alias("hit"))), F.col("key") == F.col("hit"), "left")
                part = each.where(F.col("hit").isNotNull() | head).select("id", "print", "n", "pos", F.col("hit").alias("key"), near, head.alias("first"))
            else:
                thin = _shingles(worded, s, ["id", "print"]).select("id", "print", "pos", "key").join(few, "key", "left_semi").distinct()
                found = thin.groupBy("id", "print").agg(F.collect_list(F.struct("pos", "key")).alias("found"))
                w, f = worded.alias("w"), found.alias("f")
                both = w.join(f, F.col("w.id").eqNullSafe(F.col("f.id")) & (F.col("w.print") == F.col("f.print"))).select("w.id", "w.print", "words", F.size("words").alias("n"), F.explode("found").alias("x"))
                part = both.select("id", "print", "words", "n", "x.pos", "x.key").select("id", "print", "n", "pos", "key", near, F.lit(False).alias("first"))
                if s == sizes[0]:
                    part = part.unionByName(worded.select("id", "print", F.size("words").alias("n"), F.lit(0).alias("pos"), F.lit(None).cast("long").alias("key"), F.array().cast("array<string>").alias("near"), F.lit(True).alias("first")))
            met = part if met is None else met.unionByName(part)
        met = stage(met, "met")

    at, size = F.col("pos") - F.col("offset"), F.size("window")
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    sure = met.where("key is not null").join(prefix, "key").where((at >= 0) & (at + size <= F.col("n"))).where(F.slice("near", F.greatest(at - start, F.lit(0)) + 1, size) == F.col("window"))
    hits = sure.select("id", "print", F.struct(at.alias("start"), size.alias("length")).alias("span"), "items").groupBy("id", "print").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    c, h = met.where("first").select("id", "print", F.col("n").cast("long").alias("n_words")).alias("c"), hits.alias("h")
    out = c.join(h, F.col("c.id").eqNullSafe(F.col("h.id")) & (F.col("c.print") == F.col("h.print")), "left")
    out = out.select("c.id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    add = lambda a, s: F.struct((a["sum"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("sum"), F.greatest(a["end"], s["start"] + s["length"]).alias("end"))
    return out.select(F.col("id").alias(id_col), "n_words", F.aggregate("spans", zero, add)["sum"].alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans")


def contaminated(n_hit: Column, n_words: Column, percent: int = 5) -> Column:
    """A document counts as contaminated when at least ``percent`` of its words are hit, and one at all."""
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)
