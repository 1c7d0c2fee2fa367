"""Line dedup by winnowing: minima of windows of line hashes, joined by place and extended both ways; later runs go.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bind, materialise


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_words(line: Column, words: int) -> Column:
    """Whether a trimmed line has so many words; lines too short to hold them are not split."""
    return (F.length(line) >= 2 * words - 1) & (F.size(F.split(line, r"\s+")) >= words)


def fingerprints(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", long_words: int = 0) -> DataFrame:
    """Winnowed lines, among those that are not blank: in every window of `window` lines the least hash is a fingerprint, of
    equal ones the last, and windows that pick the same line share it. If long_words, every line of so many words or more
    is one, too, for the window that it is itself.

    doc, print (hash of the text), w (lines of its windows), low (the fingerprint), pos (its line, from 1), first (first line of
    the first window that picks it) and lines (at, hash): the lines of all windows that pick it. Any run of `window`
    lines that stands twice has the same fingerprint in both places. Each text is read and cut once.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("print"), _lines(F.col(text_col)).alias("l"))
    told = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line"))), lambda x: x["line"] != "")
    long = (lambda x: _has_words(x["line"], long_words)) if long_words and window > 1 else (lambda x: F.lit(False))
    hashed = F.transform(told, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("hash"), long(x).alias("long")))

    def picked(h: Column) -> Column:
        plain = F.transform(h, lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash")))
        single = F.transform(h, lambda x, i: F.struct(F.lit(1).alias("w"), x["hash"].alias("low"), (i + 1).alias("pos"), (i + 1).alias("first"), F.array(F.struct(x["at"].alias("at"), x["hash"].alias("hash"))).alias("lines"), x["long"].alias("long")))
        alone = F.transform(F.filter(single, lambda x: x["long"]), lambda x: x.dropFields("long"))

        def least(i: Column) -> Column:
            low = F.array_min(F.transform(F.slice(h, i, window), lambda x, k: F.struct(x["hash"].alias("hash"), (-k).alias("back"))))
            return bind(low, lambda m: F.struct(m["hash"].alias("low"), (i - m["back"]).alias("pos"), i.alias("first")))

        def lines(w: Column, h: Column) -> Column:
            new = F.filter(w, lambda x, k: (k == 0) | (F.get(w, F.greatest(k - 1, F.lit(0)))["pos"] != x["pos"]))
            until = lambda n, k: F.coalesce(F.get(n, k + 1)["first"], F.size(w) + 1)
            held = lambda n: F.transform(n, lambda x, k: F.struct(F.lit(window).alias("w"), x["low"].alias("low"), x["pos"].alias("pos"), x["first"].alias("first"), F.slice(h, x["first"], until(n, k) - x["first"] + window - 1).alias("lines")))
            return bind(new, held)

        windows = F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), least)
        found = F.when(F.size(h) >= window, bind(plain, lambda p: bind(windows, lambda w: lines(w, p))))
        return F.concat(F.coalesce(found, F.filter(alone, lambda _: F.lit(False))), alone) if long_words and window > 1 else found

    rows = rows.select("doc", "print", F.explode(bind(hashed, picked)).alias("f"))
    return rows.select("doc", "print", "f.w", "f.low", "f.pos", "f.first", "f.lines")


def repeated_windows(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int = 0) -> DataFrame:
    """Windows that occur earlier, with their first place: doc, print, w, i, at, from_doc, from_print, from_i.

    Fingerprints are joined by their hash; those that stand in one place only end there. The others are extended both
    ways, to the windows that picked them, and matched to the first place of the same lines. Both sides of each join
    are written tables, so that AQE can split the rows of a hot fingerprint.
    """
    f = materialise(fingerprints(docs, window, id_col, text_col, long_words), "fingerprints")
    place = F.struct("doc", "print", "pos")
    twice = materialise(f.groupBy("w", "low").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("not (a <=> b)").select("w", "low"), "twice")
    joined = f.join(twice, ["w", "low"], "left_semi").select("doc", "print", "w", "first", "lines")
    around = F.transform(F.sequence(F.lit(1), F.size("lines") - F.col("w") + 1), lambda k: bind(F.slice("lines", k, F.col("w")), lambda w: F.struct((F.col("first") + k - 1).alias("i"), w["at"].alias("at"), w["hash"].alias("key"))))
    held = materialise(joined.select("doc", "print", "w", F.explode(around).alias("v")).select("doc", "print", "w", "v.*"), "candidates")
    me = F.struct("doc", "print", "i")
    first = materialise(held.groupBy("key").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("not (first <=> last)").select("key", "first"), "first")
    later = held.join(first, "key").where(~me.eqNullSafe(F.col("first")))
    return later.select("doc", "print", "w", "i", "at", F.col("first.doc").alias("from_doc"), F.col("first.print").alias("from_print"), F.col("first.i").alias("from_i"))


def repeated_runs(found: DataFrame, window: int | None = None) -> DataFrame:
    """Matches extended both ways, of windows of any number of lines or of `window` lines only: runs of windows on one diagonal of two documents: doc, print, w, start, lines, from_doc,
    from_print, from_start (numbers of lines that are not blank, from 1) and at (places of the lines in the text)."""
    diagonal = ["doc", "print", "w", "from_doc", "from_print", "shift"]
    found = found if window is None else found.where(F.col("w") == window)
    on = found.distinct().withColumn("shift", F.col("from_i") - F.col("i"))
    island = on.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("i")))
    return island.groupBy(*diagonal, "island").agg(
        F.min("i").alias("start"),
        (F.count("*") + F.first("w") - 1).alias("lines"),
        F.min("from_i").alias("from_start"),
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
    ).drop("shift", "island")


def dedup_lines(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, long_words: int = 0) -> DataFrame:
    """docs with its text short of every run of `window` or more lines that stands earlier, in a lesser id or higher up;
    if long_words, of every single line of so many words or more that stands earlier, too.

    Lines are compared without surrounding spaces; blank lines are left out of runs and stay. Every window of a
    repeated run has the same fingerprint wherever it stands, so no such run is missed; fingerprints that stand twice are
    extended both ways and matched to the first place of the same lines, so a hot run costs one match a place and never
    all pairs. Runs overlap with their own copies only
    from the first place on, which stays.

    Null texts stay null, empty ones empty; null ids come before all others. Rows with equal id and text are one
    document and get the same text; ids with several texts are ordered by a hash of the text. Columns of docs are
    kept, n_deleted and n_lines are added if counts. An empty table gives no rows.
    """
    # The first place of a long line is in no run that goes, so one copy stays. A document loses the lines of all its runs.
    runs = repeated_runs(repeated_windows(docs, window, id_col, text_col, long_words))
    gone = runs.groupBy(F.col("doc").alias("__doc"), F.col("print").alias("__print")).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("__gone"))
    own = F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__print")) & F.col(text_col).isNotNull()
    joined = docs.join(gone, own, "left")
    left = lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("__gone")), lambda i: F.get(l, i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(bind(_lines(F.col(text_col)), left))
    n_lines = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    more = [F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted")] if counts else []
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *more)
