"""Secret scans with multipart linking: parts of credentials are reported when complementary parts stand nearby.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bind, sums_before

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds of spans in order. The first three are reported wherever they stand; the others are weak candidates.
KINDS = ("assign", "access", "hex", "keyid", "blob", "endpoint")
#: Patterns of the kinds but assign. A run that is long enough is one match, so a least length in the pattern is the same as dropping short matches.
PATTERNS = {
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "keyid": "(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}",
    "blob": "[A-Za-z0-9+/]{40,}",
    "endpoint": r"https?://[A-Za-z0-9.:_-]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.amazonaws\.com",
}
#: What tells without a pattern that a text holds no such part.
HINTS = {"access": ("AKIA",), "keyid": ("ASIA", "AIDA", "AROA"), "endpoint": ("://", ".amazonaws.com")}


def spans(text: Column, kind: str) -> Column:
    """Spans of one kind: structs of start, order of the kind, kind and end, in code points, end exclusive."""
    pattern = ASSIGN if kind == "assign" else PATTERNS[kind]
    none = F.array().cast("array<struct<start:int,nr:int,kind:string,end:int>>")
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else whole
    triples = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), kept.alias("kept"))
    sizes = F.transform(triples, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), _long_enough(x["kept"], kind).alias("long")))

    def placed(z: Column) -> Column:
        before = sums_before(F.transform(z, lambda x: x["gap"] + x["whole"]))
        start = lambda x, n: (n + x["gap"]).cast("int")
        each = F.zip_with(z, before, lambda x, n: F.struct(start(x, n).alias("start"), F.lit(KINDS.index(kind)).alias("nr"), F.lit(kind).alias("kind"), (start(x, n) + x["whole"]).alias("end"), x["long"].alias("long")))
        return F.transform(F.filter(each, lambda x: x["long"]), lambda x: F.struct(x["start"].alias("start"), x["nr"].alias("nr"), x["kind"].alias("kind"), x["end"].alias("end")))

    found = bind(sizes, placed)
    hints = HINTS.get(kind)
    may = F.rlike(text, F.lit(pattern))
    if hints:
        some = F.contains(text, F.lit(hints[0]))
        for h in hints[1:]:
            some = some | F.contains(text, F.lit(h))
        may = some & may
    return F.when(may, found).otherwise(none)


def _long_enough(kept: Column, kind: str) -> Column:
    if kind == "assign":
        return F.length(kept) >= 8
    return F.length(kept) == 40 if kind == "blob" else F.lit(True)


def scan(docs: DataFrame, scope: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets of each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Weak parts (other access identifiers, bare 40-character blobs, endpoints) are joined with the parts at most `scope`
    code points away, from end to start, by running extremes over the document's parts in order: an interval join that
    never makes pairs. A weak identifier needs a secret (an assignment or a blob) there, a blob
    needs an identifier, an endpoint needs both.

    Null and empty texts: no spans, the digest of the empty string. Null ids keep their row; each repeated row is a
    document of its own; equal starts are ordered by kind. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    parts = rows.select("row", "doc_id", F.explode_outer(F.concat(*[spans(F.col("t"), k) for k in KINDS])).alias("s"))
    parts = parts.select("row", "doc_id", "s.start", "s.nr", "s.kind", "s.end")
    # Both frames grow from the first row on, one in either order: a frame that shrinks is made anew for every row.
    before, after = (Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, 0) for order in (F.asc("start"), F.desc("start")))

    def near(*kinds: str) -> Column:
        """Whether a span of the kinds ends at most `scope` before this one's start, or starts as much after its end; spans that overlap are near."""
        of = F.col("kind").isin(*kinds)
        left = F.max(F.when(of, F.col("end"))).over(before) >= F.col("start") - scope
        right = F.min(F.when(of, F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    linked = parts.select("*", near("access", "keyid").alias("id_near"), near("assign", "blob").alias("secret_near"))
    weak = {"keyid": F.col("secret_near"), "blob": F.col("id_near"), "endpoint": F.col("id_near") & F.col("secret_near")}
    keep = F.col("nr") < 3
    for kind, rule in weak.items():
        keep = keep | ((F.col("kind") == kind) & rule)
    one = F.when(keep, F.struct("start", "nr", "kind", "end"))
    kept = linked.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["nr"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["nr"] < 3)
    return kept.select("doc_id", count(0), count(1), count(2), F.sha2(shown(base), 256).alias("base_sha256"), shown("s").alias("spans"))
