"""Text as column expressions: answers in completions, templates, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import bind


def extract_answer(text: Column, strict: bool = False) -> Column:
    """The last answer word of a completion, in any case; null for none.

    counter-clockwise and counter clockwise read as clockwise, unless strict.
    """
    text = F.lower(text)
    if strict:
        text = F.regexp_replace(text, r"\bcounter[- ]clockwise\b", "counterclockwise")
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(counterclockwise|clockwise|neither)\b"), F.lit(1)), F.lit(-1))


def normal_answer(text: Column) -> Column:
    """Lower case, without white space of any kind around it."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def fill_template(fmt: Column, args: Column) -> Column:
    """fmt with each {} replaced by the next of args. Arguments are not scanned again; null ones are empty."""
    return F.array_join(F.flatten(F.zip_with(F.split(fmt, r"\{\}", -1), args, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")


def gather(values: Column, order: Column) -> Column:
    """values[i] for each i of order."""
    return F.transform(order, lambda i: F.get(values, i))


def prefix_message(messages: Column) -> Column:
    """All messages but the last."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


PAIRS = "array<array<double>>"
#: A number, and texts that are pairs of numbers by line or semicolon throughout; the last repetition never goes back, as
#: Java's patterns do so by recursion.
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
FLAT = rf"^{NUMBER}(?:[ \t]*,[ \t]*|[ \t]+){NUMBER}(?:[ \t]*[;\n][; \t\n]*{NUMBER}(?:[ \t]*,[ \t]*|[ \t]+){NUMBER})*+$"


def parse_coords(text: Column) -> Column:
    """Struct of coords and error from text: a JSON list of pairs (more parts are dropped), one JSON pair, or pairs by
    line or semicolon with or without a comma. One of the two is null."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def by_line(t: Column) -> Column:
        chunks = F.filter(F.transform(F.split(F.regexp_replace(t, ";", "\n"), r"\R", -1), strip), lambda c: c != "")
        words = lambda c: F.filter(F.split(F.regexp_replace(c, ",", " "), r"\s+", -1), lambda w: w != "")
        cut = F.transform(chunks, lambda c: bind(words(c), lambda w: F.struct(c.alias("c"), F.size(w).alias("n"), F.transform(w, lambda v: v.try_cast("double")).alias("v"))))

        def judge(z: Column) -> Column:
            odd = F.get(F.filter(z, lambda x: x["n"] != 2), F.lit(0))["c"]
            bad = F.get(F.filter(z, lambda x: F.exists(x["v"], lambda v: v.isNull())), F.lit(0))["c"]
            error = F.when(odd.isNotNull(), F.concat(F.lit("not a pair: "), odd)).when(bad.isNotNull(), F.concat(F.lit("not a number: "), bad)).when(F.size(z) == 0, F.lit("no pairs"))
            return bind(error, lambda e: F.struct(F.when(e.isNull(), F.transform(z, lambda x: x["v"])).alias("coords"), e.alias("error")))

        return bind(cut, judge)

    whole = lambda p: p.isNotNull() & (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()
    pairs = lambda v: F.when(v.isNotNull() & (F.size(v) > 0) & F.forall(v, whole), F.transform(v, lambda p: F.slice(p, 1, 2)))
    one = lambda v: F.when(v.isNotNull() & (F.size(v) == 2) & F.forall(v, lambda x: x.isNotNull()), F.array(v))

    def of(t: Column) -> Column:
        """Pairs throughout are cut by one pattern. Else, by the first character, lists are tried as JSON, and what is none goes on as lines."""
        empty = F.struct(F.lit(None).cast(PAIRS).alias("coords"), F.lit("empty").alias("error"))
        json = F.when(F.startswith(t, F.lit("[")), F.coalesce(bind(F.from_json(t, PAIRS), pairs), bind(F.from_json(t, "array<double>"), one)))
        told = lambda c: F.struct(c.cast(PAIRS).alias("coords"), F.lit(None).cast("string").alias("error"))
        found = lambda c: F.when(c.isNotNull(), told(c)).otherwise(by_line(t))
        numbers = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)).cast("array<double>")
        flat = bind(numbers, lambda v: told(F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1), lambda i: F.slice(v, 2 * i + 1, F.lit(2)))))
        return F.when(t.isNull() | (t == ""), empty).when(F.rlike(t, F.lit(FLAT)), flat).otherwise(bind(json, found))

    return bind(strip(text), of)
